"""Near copies of the pipeline's stage against a plain version that compares all pairs of shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import resemblance as r
from strandline.llm import simhash
from strandline.llm.simhash import LOWER, WORD

SF = "/root/testdata/sf0.01"


def plain_set(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain_firsts(rows, share=0.8):
    """Smallest id of each group."""
    sets, holders = [plain_set(t) for _, t in rows], {}
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s or [None] for j in holders.get(g, ())}:
            if len(s & sets[j]) >= share * len(s | sets[j]):
                parent[root(i)] = root(j)
        for g in s or [None]:
            holders.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted(least.values())


def test_stage_drops_what_resembles_by_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, rng = [(d.doc_id, d.text) for d in docs.collect()], random.Random(2)
    base = 1 + max(i for i, _ in rows)
    for k, (_, text) in enumerate(rows[:300]):  # one word changed
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((base + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = corpus_pipeline.simhash_near_duplicates(spark, df, SF)
    assert got.columns == ["doc_id", "text"]
    assert sorted(d.doc_id for d in got.collect()) == plain_firsts(rows)


@pytest.mark.parametrize("block", [512, 3])
def test_groups_of_any_size_and_odd_rows(spark, block, monkeypatch):
    monkeypatch.setattr(r, "SLICE", block)
    rng = random.Random(4)
    text = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = [(k, " ".join(w if i not in (k % 90, 2 * k) else f"n{k}" for i, w in enumerate(text))) for k in range(80)]
    rows += [(200 + k, " ".join(text[: 200 - 9 * k])) for k in range(12)]  # a chain of links
    rows += [(300, None), (301, ""), (302, " \n "), (303, "One two"), (304, "one TWO"), (305, "one two three"), (306, "long " * 100_000 + "end")]
    df = spark.createDataFrame([*rows, (303, "One two"), (None, "stray words"), (None, "one two")], "doc_id long, text string").repartition(4)
    got = [d.doc_id for d in r.first_of_groups(df).collect()]
    assert got.count(None) == 1 and sorted(i for i in got if i is not None) == plain_firsts(rows)
    assert r.first_of_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        r.first_of_groups(df, share=0.5)


def test_pairs_at_the_limit_share_a_band():
    rng = np.random.default_rng(1)
    for _ in range(300):
        own = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
        a, b = np.sort(own[:100]), np.sort(np.concatenate([own[:89], own[100:]]))  # 89 of 111
        assert set(r.bands_of(a)) & set(r.bands_of(b))
        assert r.near_pairs([a, b], 0.8).all() and not r.near_pairs([a, b], 0.81)[0, 1]


def test_text_ids_clashing_names_and_heavy_texts(spark, monkeypatch):
    monkeypatch.setattr(r, "SLICE_BYTES", 300)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = [(f"id{k:02d}", " ".join([*base[:k], f"x{k}", *base[k + 1 :]]) if k % 5 == 0 else " ".join(base)) for k in range(30)] + [("z", "another text of its own"), (None, "stray")]
    names = "_row int, _first int, _text int, _set int, _bands int, _key int, _h0 int, a int, b int, component int, _component int, _bucket int, _n int"
    df = spark.createDataFrame([(*row, *range(13)) for row in rows], f"doc_id string, text string, {names}").repartition(3)
    got = r.first_of_groups(df)
    assert got.columns == df.columns
    want = plain_firsts(rows[:-1])
    kept = got.collect()
    assert sorted(d.doc_id for d in kept if d.doc_id is not None) == want and len(kept) == len(want) + 1
    assert all(tuple(d)[2:] == tuple(range(13)) for d in kept)


def test_stage_goes_by_fingerprints_and_references(spark, monkeypatch):
    rng, seen = np.random.default_rng(6), []
    for shared, own in ((89, 11), (8, 1), (160, 20)):  # at the limit: far more than op9's two bits apart, a table in common all the same
        for _ in range(100):
            h = rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64)
            a, b = (simhash.votes_of(x) for x in (h[: shared + own], np.concatenate([h[:shared], h[shared + own :]])))
            assert (simhash.nearest_references(a) == simhash.nearest_references(b)).any()
            seen.append(simhash.wide_distances([simhash.wide_fingerprint(v) for v in (a, b)])[0, 1])
    assert 10 < min(seen) and max(seen) <= simhash.REACH
    wide = simhash.votes_of(h)  # the table holds mean distances of hashes, the fingerprint their majorities
    each = np.array([simhash.votes_of(h[i : i + 1]) for i in range(len(h))])
    assert (each.sum(axis=0) == wide).all() and simhash.wide_fingerprint(wide) == np.packbits((each > 0).sum(axis=0) * 2 > len(h)).tobytes()
    k = np.argmin([(each != f).sum() for r in simhash._TWISTS[:1] * simhash._FUNCTIONS[: simhash.CELLS] for f in (r, -r)])
    assert simhash.nearest_references(wide)[0] & 255 == k

    text = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(text)), (2, " ".join([*text[:50], "new", *text[51:]])), (3, "some other text that stands alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(d.doc_id for d in corpus_pipeline.simhash_near_duplicates(spark, df, SF).collect()) == [1, 3]
    monkeypatch.setattr(r, "REACH", -1)  # no fingerprint within reach: no candidates, whatever the sets
    assert sorted(d.doc_id for d in r.first_of_groups(df).collect()) == [1, 2, 3]


def spied(monkeypatch):
    """Rows of what the stage writes, by label; of several tables with the same label the last."""
    seen, written = {}, r.written

    def spy(df, label):
        table, path = written(df, label)
        seen[label] = table.count()
        return table, path

    monkeypatch.setattr(r, "written", spy)
    return seen


def test_a_large_group_meets_once_and_not_in_every_table(spark, monkeypatch):
    rng, seen = random.Random(5), spied(monkeypatch)
    rows = []
    for k in range(90):  # two changed words link (0.815 of the shingles), four do not: half of the group belongs to nobody
        base = [f"w{i}" for i in range(200)]
        for at in rng.sample(range(5, 190), 2 if k % 2 else 4):
            base[at] = f"n{k}-{at}"
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_firsts(rows)
    assert sorted(d.doc_id for d in r.first_of_groups(df).collect()) == want and 30 < len(want) < 80
    assert seen["candidates"] > 40 * len(rows) and 0 < seen["buckets"] <= len(rows)


def test_a_long_chain_keeps_to_its_buckets(spark, monkeypatch):
    seen, rows, at = spied(monkeypatch), [], 0
    for k in range(1500):  # neighbours share 0.9 of their shingles; every 50th is four steps on (0.65), which is no link
        at += 3 if k % 50 else 12
        rows.append((k, " ".join(f"w{i}" for i in range(at, at + 60))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_firsts(rows)
    assert sorted(d.doc_id for d in r.first_of_groups(df).collect()) == want and len(want) == 30
    assert seen["once"] < seen["kin"] and seen["buckets"] > len(rows)
