"""Cutting texts into pre-token groups that a tokenizer encodes independently of each other."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

# White space as the tokenizers library has it: Python's without the four separators from \x1c.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
LED = re.compile(f"{SPACE}*{OTHER}+|{SPACE}+")  # a run of white space goes with what follows
BARE = re.compile(f"{OTHER}+")
PAIR = re.compile(r"\s\s|[\x00\x1c-\x1f]")
SEPARATORS = re.compile(r"[\x1c-\x1f]")

# The word vocabulary's normaliser and pattern, for groups of printable Latin characters. Those are composed
# already and lower-case one by one, to letters before U+0180; the pattern is the file's, spelled out for them.
LATIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")
LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = ".,;:!?*#$%&|"
KEPT = 400_000  # words whose ids are kept

# Byte-level vocabularies write a printable byte as itself and the n-th other byte as U+0100 + n.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: b for b in _PRINTABLE} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class PreTokens:
    """The groups of a text for one vocabulary file, and their pieces.

    A group is a run of other characters with the white space before it. Both kinds of vocabulary end a
    pre-token before each run of white space, so the pieces of a text are those of its groups, one
    after the other. Byte-level vocabularies keep the white space; the lower-casing word
    vocabulary drops it, and neither its normalisation nor its pattern crosses it. Special strings are
    cut out of the raw text first, as the library does.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        steps = head["pre_tokenizer"] or {}
        steps = steps.get("pretokenizers", [steps])
        first = steps[0]
        if first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and not head["normalizer"]:
            self.keeps_space = True
        elif first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and r"\s" in first["pattern"]["Regex"]:
            self.keeps_space = False
        else:
            raise ValueError(f"{path}: pre-tokens of this vocabulary are not known to end at white space")
        special = [t for t in head["added_tokens"] if not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        if len(special) != len(head["added_tokens"]):
            raise ValueError(f"{path}: added tokens with options are not supported")
        self.special = {t["content"]: t["id"] for t in special}
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if special else None
        self._marks = [s[:2] for s in self.special]
        steps = (head["normalizer"] or {}).get("normalizers", [])
        self._latin = (
            not self.keeps_space and first["pattern"]["Regex"] == PATTERN and [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"]
            and head["model"]["type"] == "BPE"
        )
        self._words: dict[str, tuple[int, ...]] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def groups(self, text: str | None) -> list[str]:
        """Groups of the whole text in order; special strings are groups of their own."""
        if not text:
            return []
        if self._cut and any(m in text for m in self._marks):
            out: list[str] = []
            for i, part in enumerate(self._cut.split(text)):
                out += [part] if i & 1 else self._plain(part)
            return out
        # Without the first characters of a special string none can arise in lower case.
        return self._plain(text.lower() if self._latin and text.isascii() else text)

    def _plain(self, text: str) -> list[str]:
        if not self.keeps_space:
            return BARE.findall(text) if SEPARATORS.search(text) else text.split()
        if PAIR.search(text):
            return LED.findall(text)
        # No two white space characters meet: cut before each blank and line end.
        return [g for g in text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0") if g]

    def encode(self, groups: Sequence[str]) -> list[Sequence[int]]:
        """Ids of each group."""
        if not self._latin:
            return self._whole(groups)
        if len(self._words) > KEPT:
            self._words.clear()
        words, out, rest = self._words, [], []
        tokenize = self.tokenizer.model.tokenize
        for k, group in enumerate(groups):
            core = group.rstrip(MARKS)
            if core.isalpha() and core.isascii():  # most groups: a word, and perhaps marks after it
                parts = (core.lower(), group[len(core) :]) if len(core) < len(group) else (core.lower(),)
            elif LATIN.fullmatch(group) and group not in self.special:
                parts = LATIN_WORD.findall(group.lower())
            else:
                parts = None
            if parts:
                ids: tuple[int, ...] = ()  # tuples of numbers are nothing to the garbage collector
                for word in parts:
                    known = words.get(word)
                    if known is None:
                        text = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
                        known = words[word] = tuple([t.id for t in tokenize(text)])
                    ids = ids + known if ids else known
                out.append(ids)
            else:
                out.append(None)
                rest.append(k)
        for k, ids in zip(rest, self._whole([groups[k] for k in rest])):
            out[k] = ids
        return out

    def _whole(self, groups: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(groups), add_special_tokens=False)]

    def counts(self, groups: Sequence[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(list(groups), add_special_tokens=False)]


_loaded: dict[str, PreTokens] = {}


def load(path: str) -> PreTokens:
    """The vocabulary of a file, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = PreTokens(path)
    return _loaded[path]
