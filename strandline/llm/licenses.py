"""Licence scan: matching statistics of texts against a suffix automaton of licence words, chained into spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.license_texts import PHRASES, TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP_CHAR = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
PIECE = 1 << 20  # characters that are split into words at a time
LEAST = 4  # words of the shortest match that counts for a span; a shorter template counts whole
GAP = 30  # words that may lie between two matches of a span
SHARE = 0.8  # of a template's words that a span has to cover


def exactly_lowered(text: str) -> str:
    return text.translate(LOWER)


def lowered(text: str) -> str:
    """Many times faster; other letters are lowered too, but none becomes ASCII, as only two could."""
    return text.lower() if "\u212a" not in text and "\u0130" not in text else exactly_lowered(text)


def pieces(text: str, lower: Callable[[str], str] = exactly_lowered, size: int = PIECE) -> Iterator[list[str]]:
    """Words of ``text`` in lists; no word is cut."""
    start = 0
    while start < len(text):
        cut = GAP_CHAR.search(text, min(len(text), start + size))
        end = cut.start() if cut else len(text)
        yield WORD.findall(lower(text[start:end]))
        start = end


class Automaton:
    """Generalised suffix automaton of word sequences: a state for each set of places where a sequence ends.

    ``longest``, ``link`` (the state of the longest suffix that ends in more places) and ``after`` (transitions) by
    state; ``phrases[state]``: those that end wherever the state's sequences do; ``anchors[state]``: (template, end,
    length or None) of the places of its sequences (None: as long as what was matched) and of their shorter suffixes of at
    least ``least`` words in other places.
    """

    def __init__(self, templates: Sequence[Sequence[int]], phrases: Sequence[tuple[Sequence[int], str]], least: int):
        self.longest, self.link, self.after = [0], [-1], [{}]
        ends: list[dict] = [{}]
        for t, words in enumerate([*templates, *[p for p, _ in phrases]]):
            last = 0
            for k, word in enumerate(words):
                last = self._extend(last, word)
                while len(ends) < len(self.longest):
                    ends.append({})
                if t < len(templates):
                    ends[last][t, k + 1] = True
        order = sorted(range(1, len(self.longest)), key=lambda s: -self.longest[s])
        for s in order:
            ends[self.link[s]].update(ends[s])
        self.phrases: list[list] = [[] for _ in ends]
        for words, label in phrases:
            self.phrases[self._state(words)].append((len(words), label))
        self.anchors: list[list] = [[] for _ in ends]
        for s in reversed(order):
            up = self.link[s]
            self.phrases[s] = self.phrases[s] + self.phrases[up]
            own = [(t, e, None) for t, e in ends[s]]
            shorter = [(t, e, n or self.longest[up]) for t, e, n in self.anchors[up] if (t, e) not in ends[s]]
            self.anchors[s] = own + [a for a in shorter if a[2] >= least]

    def _extend(self, last: int, word: int) -> int:
        if word in self.after[last]:
            to = self.after[last][word]
            return to if self.longest[to] == self.longest[last] + 1 else self._split(last, word, to)
        new = len(self.longest)
        self.longest.append(self.longest[last] + 1)
        self.link.append(0)
        self.after.append({})
        while last >= 0 and word not in self.after[last]:
            self.after[last][word] = new
            last = self.link[last]
        if last >= 0:
            to = self.after[last][word]
            self.link[new] = to if self.longest[to] == self.longest[last] + 1 else self._split(last, word, to)
        return new

    def _split(self, last: int, word: int, to: int) -> int:
        new = len(self.longest)
        self.longest.append(self.longest[last] + 1)
        self.link.append(self.link[to])
        self.after.append(dict(self.after[to]))
        self.link[to] = new
        while last >= 0 and self.after[last].get(word) == to:
            self.after[last][word] = new
            last = self.link[last]
        return new

    def _state(self, words: Sequence[int]) -> int:
        state = 0
        for w in words:
            state = self.after[state][w]
        return state

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest suffix read so far that is in some template."""
        while word not in self.after[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.longest[state]
        return self.after[state][word], length + 1


@dataclass
class _Chain:
    end: int  # in the text
    at: int  # in the template
    covered: int
    start: int
    extended: bool = False


@dataclass
class Found:
    n_words: int = 0
    n_base: int = 0
    first_word: int | None = None
    last_word: int | None = None
    base: set = field(default_factory=set)
    spans: list = field(default_factory=list)  # (label, start, end, share)
    score: float = 0.0


class Scanner:
    """Templates and phrases ready for scanning; made once, sent to the tasks."""

    def __init__(self, texts=TEXTS, phrases=PHRASES, least: int = LEAST, gap: int = GAP, share: float = SHARE):
        words = [WORD.findall(exactly_lowered(t)) for _, t in texts]
        named = [WORD.findall(exactly_lowered(p)) for p, _ in phrases]
        if min(map(len, [*words, *named])) < 2:
            raise ValueError("templates and phrases need two words at least")
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for text in [*words, *named] for w in text), 1)}
        self.lower = lowered if all(map(str.isascii, self.ids)) else exactly_lowered
        coded = [[self.ids[w] for w in text] for text in words]
        said = [[self.ids[w] for w in text] for text in named]
        self.labels, self.sizes = [label for label, _ in texts], [len(w) for w in words]
        self.least, self.gap, self.share = [min(least, n) for n in self.sizes], gap, share
        self.automaton = Automaton(coded, [(w, label) for w, (_, label) in zip(said, phrases)], min(self.least))
        pairs = {a * (len(self.ids) + 1) + b for text in [*coded, *said] for a, b in zip(text, text[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def scan(self, text: str | None) -> Found:
        """One pass over the words in pieces; what is kept of earlier ones are the open chains."""
        out, chains, spans = Found(), {}, []
        step, phrases = self.automaton.step, self.automaton.phrases
        ids, wide = self.ids, len(self.ids) + 1
        carried = state = length = 0
        pending = None
        for words in pieces(text or "", self.lower):
            n, base = len(words), out.n_words
            codes = np.fromiter((ids.get(w, 0) for w in words), np.int64, n)
            # Only where two words follow each other in some template can a match have two words or more.
            pair = np.concatenate([[carried], codes[:-1]]) * wide + codes
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            before = -2
            for p in np.flatnonzero(self.pairs[place] == pair).tolist():
                if p != before + 1 and not (p == 0 and length):
                    if pending:
                        self._anchor(*pending, chains, spans, out)
                    pending = None
                    state, length = step(0, 0, int(codes[p - 1]) if p else carried)
                was = length
                state, length = step(state, length, int(codes[p]))
                if pending and length != was + 1:
                    self._anchor(*pending, chains, spans, out)
                pending, before = (base + p + 1, state, length), p
                for size, label in phrases[state]:
                    if size <= length:
                        at = base + p + 1 - size
                        out.n_base += 1
                        out.first_word = at if out.first_word is None else min(at, out.first_word)
                        out.last_word = at if out.last_word is None else max(at, out.last_word)
                        out.base.add(label)
            out.n_words += n
            if n:
                carried = int(codes[-1])
                if before != n - 1:  # the last word is in no run: the next piece begins anew
                    state = length = 0
        if pending:
            self._anchor(*pending, chains, spans, out)
        for t in list(chains):
            self._close(t, chains.pop(t), spans, out)
        out.spans = self._merged(spans)
        if out.base:
            out.score = 1.0  # a phrase is covered whole
        return out

    def _anchor(self, end: int, state: int, length: int, chains: dict, spans: list, out: Found) -> None:
        """Chain a match that cannot be made longer: onto the chain that covers most, not too far before it."""
        for t, at, size in self.automaton.anchors[state]:
            size = size or length
            if size < self.least[t]:
                continue
            start, best, gain = end - size, None, size
            known = chains.setdefault(t, [])
            for c in known:
                if c.end < end and c.at < at and start - c.end <= self.gap:
                    more = c.covered + min(size, at - c.at, end - c.end)
                    if more > gain:
                        best, gain = c, more
            if best:
                best.extended = True
            known.append(_Chain(end, at, gain, best.start if best else start))
            far = end - self.gap - self.sizes[t]  # no later match of this template can reach back so far
            if known[0].end < far:
                self._close(t, [c for c in known if c.end < far], spans, out)
                chains[t] = [c for c in known if c.end >= far]

    def _close(self, t: int, chains: list, spans: list, out: Found) -> None:
        for c in chains:
            share = min(1.0, c.covered / self.sizes[t])
            out.score = max(out.score, share)
            if share >= self.share and not c.extended:
                spans.append((self.labels[t], c.start, c.end, share))

    @staticmethod
    def _merged(spans: list) -> list:
        """Spans of a label that overlap become one with the greatest share."""
        out = []
        for label, start, end, share in sorted(spans):
            if out and out[-1][0] == label and start < out[-1][2]:
                out[-1] = (label, out[-1][1], max(end, out[-1][2]), max(share, out[-1][3]))
            else:
                out.append((label, start, end, share))
        return out


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:long,end:long,share:double>>"
)


def scan(docs: DataFrame, scanner: Scanner | None = None, text: str = "text") -> DataFrame:
    """``docs`` with what of licences stands in the whole of every text.

    New columns: ``n_words``; ``n_base``, ``first_word``, ``last_word`` (places where a phrase's words stand consecutively:
    how many, the smallest and largest start, null where there is none); ``base_labels`` and ``labels`` (with those
    of the spans; sorted, comma-joined); ``score`` (the greatest share of a template or phrase that one span covers);
    ``spans`` (label, start, end, share: word places where at least ``scanner.share`` of a template is covered, in order, by
    matches at most ``scanner.gap`` words apart). A text of any length is read in pieces.

    Defined cases: null counts as empty text, which has no word and score 0; repeated rows get equal results; no rows
    give no rows. Columns of the new names are overwritten, all others pass through.
    """
    scanner = scanner or Scanner()

    @F.pandas_udf(RESULT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                f = scanner.scan(t if isinstance(t, str) else None)
                labels = f.base | {s[0] for s in f.spans}
                rows.append((f.n_words, f.n_base, f.first_word, f.last_word, ",".join(sorted(f.base)), ",".join(sorted(labels)), f.score,
                             [dict(zip(("label", "start", "end", "share"), s)) for s in f.spans]))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    new = [c.split()[0] for c in RESULT.split("spans")[0].split(", ") if c] + ["spans"]
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), of(F.col(text)).alias("_found"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in new], *[F.col("_found")[c].alias(c) for c in new])
