"""SimHash groups against a plain version that compares all pairs."""

import random

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash


def plain_fingerprint(text, n=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def plain_components(ids, fps, bits=2):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def test_texts_of_all_kinds(spark):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "été", "gamma's", "x", " ", "漢字", "Zed"]
    texts = [None, "", " \t\n\x0b\x0c\r ", "One", "one", "one two", "a b c", "A\tB\nC"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += [t + " tail" for t in texts[-20:]] + ["long " * 200_000 + "end"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "One", "x"), (None, "stray words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.simhash_groups(docs).collect()
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want = plain_components([r[0] for r in rows], fps)
    expected = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == expected


@pytest.mark.parametrize("block", [1024, 7])
def test_links_equal_all_pairs(spark, block, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    many = [int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 63, (12, 2))]
    many += [0, 1, 3, 7, -1, -2, -4]
    fps = sorted({*map(int, base), *many})
    monkeypatch.setattr(simhash, "meet", lambda *a, f=simhash.meet: f(*a, block=block))
    from strandline.llm.common import components

    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.node: r.component for r in components(simhash.links(table, "fp"), "a", "b").collect()}
    unsigned = [f % (1 << 64) for f in fps]
    want = plain_components(fps, unsigned)
    assert [found.get(f, f) for f in fps] == want


def test_no_rows_and_one_of_each_group(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).count() == 0
    rows = [(5, "p q r s", 1), (2, "p q r s", 2), (2, "p q r s", 2), (None, "u v w", 3), (None, "k l m", 4), (7, "z z z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = sorted((tuple(r) for r in simhash.first_of_groups(docs).collect()), key=str)
    assert kept == sorted([(2, "p q r s", 2), (None, "u v w", 3), (None, "k l m", 4), (7, "z z z", 5)], key=str)


def test_text_ids_and_clashing_names(spark):
    names = ["_row", "_id", "_text", "_fp", "_least", "_component", "_component_id", "_any", "bucket", "fp", "component"]
    rows = [("b", "one two three four"), ("a", "one two three four"), (None, "five six seven"), ("c", None)]
    df = spark.createDataFrame([(*r, *range(11)) for r in rows], "doc_id string, text string, " + ", ".join(f"{n} int" for n in names))
    got = simhash.simhash_groups(df).collect()
    assert sorted(((g.doc_id, g.component_id) for g in got), key=str) == sorted([("a", "a"), ("b", "a"), (None, None), ("c", "c")], key=str)
    assert all([g[n] for n in names] == list(range(11)) for g in got)
    assert sorted((d.doc_id for d in simhash.first_of_groups(df).collect()), key=str) == sorted(["a", None, "c"], key=str)
