"""Licence scan against plain versions: tables of common suffixes, and words compared in every place."""

import random
import re

import numpy as np
import pytest

from strandline.llm import licenses as n
from strandline.llm.license_texts import PHRASES, TEXTS


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-/:-`{-\x7f]+", lower) if w]


def plain_places(words, phrases):
    """(start, label) of each phrase."""
    out = []
    for phrase, label in phrases:
        p = plain_words(phrase)
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(out)


def common_suffixes(words, template):
    out = np.zeros((len(words) + 1, len(template) + 1), int)
    for i, w in enumerate(words):
        for j, t in enumerate(template):
            if w == t:
                out[i + 1, j + 1] = out[i, j] + 1
    return out


def plain_spans(words, texts, phrases, least, gap, share):
    """Best share and the labels of spans, by chaining all matches of each template that cannot be made longer."""
    templates = [plain_words(t) for _, t in texts]
    tables = [common_suffixes(words, t) for t in templates]
    longest = np.max([t.max(axis=1) for t in [*tables, *[common_suffixes(words, plain_words(p)) for p, _ in phrases]]], axis=0)
    ends = [i for i in range(1, len(words) + 1) if longest[i] > 1 and (i == len(words) or longest[i + 1] != longest[i] + 1)]
    best, labels = 0.0, set()
    for (label, _), template, table in zip(texts, templates, tables):
        enough = min(least, len(template))
        matches = [(i, j, table[i, j]) for i in ends for j in range(1, len(template) + 1) if table[i, j] >= enough]
        covered = {}
        for i, j, size in matches:
            before = [covered[a] + min(size, j - a[1], i - a[0]) for a in covered if a[0] < i and a[1] < j and i - size - a[0] <= gap]
            covered[i, j] = max([size, *before])
            got = min(1.0, covered[i, j] / len(template))
            best = max(best, got)
            if got >= share:
                labels.add(label)
    return best, labels


def check(text, texts, phrases, **kw):
    s = n.Scanner(texts, phrases, **kw)
    found, words = s.scan(text), plain_words(text)
    places = plain_places(words, phrases)
    assert found.n_words == len(words) and found.n_base == len(places)
    assert (found.first_word, found.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
    assert found.base == {label for _, label in places}
    score, labels = plain_spans(words, texts, phrases, kw.get("least", n.LEAST), s.gap, s.share)
    assert found.score == (1.0 if places else score) and {x[0] for x in found.spans} == labels
    assert all(0 <= a < b <= len(words) for _, a, b, _ in found.spans)
    return found


def test_lower_case_and_words():
    for c in map(chr, [*range(0x3000), 0x212A, 0x1E9E, 0xFB00, 0x1F600]):
        text, quick = f"A{c}B {c}", [w for p in n.pieces(f"A{c}B {c}", n.lowered) for w in p]
        want = plain_words(text)
        assert [w for p in n.pieces(text) for w in p] == want, hex(ord(c))
        assert len(quick) == len(want) and all(a == b for a, b in zip(quick, want) if a.isascii() or b.isascii()), hex(ord(c))


@pytest.mark.parametrize("piece", [1, 7, 40, n.PIECE])
def test_small_alphabet(piece, monkeypatch):
    monkeypatch.setattr(n.pieces, "__defaults__", (n.exactly_lowered, piece))
    rng = random.Random(piece)
    for _ in range(150):
        letters = "abcd"[: rng.randint(2, 4)]
        texts = [(f"l{k % 2}", " ".join(rng.choice(letters) for _ in range(rng.randint(2, 12)))) for k in range(rng.randint(1, 4))]
        phrases = [(" ".join(rng.choice(letters) for _ in range(rng.randint(2, 3))), f"p{k}") for k in range(2)]
        text = "-".join(rng.choice(letters + "zA") for _ in range(rng.randint(0, 60)))
        check(text, texts, phrases, least=rng.randint(2, 4), gap=rng.randint(0, 6), share=rng.choice([0.5, 0.8, 1.0]))


def test_licences():
    rng = random.Random(3)
    for label, text in TEXTS:
        words = text.split()
        for k in sorted({rng.randrange(len(words)) for _ in range(2)}):
            edited = [*words[:k], "changed", *words[k + 1 :]]
            noise = " ".join(rng.choice(["the", "of", "code", "software", "été", "x1"]) for _ in range(80))
            found = check(f"{noise} {' '.join(edited)}\n{noise}", TEXTS, PHRASES)
            if len(words) > 40:
                assert label in {s[0] for s in found.spans}, (label, k)
        assert check(text, TEXTS, PHRASES).score == 1.0
    found = check("Licensed under CC BY-NC 4.0.\nwords of something else", TEXTS, PHRASES)
    assert {s[0] for s in found.spans} == {"cc-by-nc"} and found.spans[0][1:3] == (0, 7)
    assert not check("the software is free of charge in the source of this work", TEXTS, PHRASES).spans


def test_table(spark):
    rows = [
        (1, "MIT-License, mit LICENSE; MITLicense"), (2, None), (3, ""), (4, " .,;\n"), (5, "Apache\tLicense General Public License " * 3),
        (6, "word " * 400_000 + "General Public License"), (7, "x" * 3_000_000 + " mit license"), (1, "MIT-License, mit LICENSE; MITLicense"), (None, "MİT license, mit license K"),
    ]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, labels string, n_base int").repartition(3)
    got = sorted(map(tuple, n.scan(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()), key=str)
    want = []
    for i, text in rows:
        words = plain_words(text)
        places = plain_places(words, PHRASES)
        names = ",".join(sorted({x for _, x in places}))
        want.append((i, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, names, names, 1.0 if places else 0.0))
    assert got == sorted(want, key=str)
    assert n.scan(df.limit(0)).count() == 0
