"""Decontamination: the pruned search against scoring every item, and odd rows."""

import random
from collections import Counter

import pytest

from strandline.llm import decontam as d

VOCABULARY = [f"w{k}" for k in range(400)] + ["the", "of", "and", "is"] * 60


def corpus(seed, items=60, docs=150):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    bench = [(k, f"{say(rng.randint(5, 90))}. {say(rng.randint(2, 20))}.") for k in range(items)]
    bench += [(1000, "two words"), (1001, "one"), (1002, ""), (1003, None), (1004, "..."), (None, bench[0][1]), (1005, say(300))]
    texts = []
    for k in range(docs):
        text = [say(rng.randint(0, 400))]
        for _ in range(rng.randint(0, 2)):
            words = (rng.choice(bench)[1] or "").split()
            change = rng.choice([0, 0, 1, 3, len(words) // 2])
            for _ in range(change):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            text += [" ".join(words).upper() if rng.random() < 0.3 else " ".join(words), say(rng.randint(0, 300))]
        texts.append((k, " ".join(text)))
    return bench, texts + [(900, None), (901, ""), (902, "!!!"), (903, bench[0][1]), (903, bench[0][1]), (None, bench[1][1]), (904, "w1 " * 100_000 + bench[2][1])]


def plain(bench, texts, threshold=0.6, overlap=0.6):
    """Every item scored against every passage."""
    items = [(i, t) for i, t in bench if d.words_of(t)]
    frequency = Counter(w for _, t in items for w in set(d.words_of(t)))
    length = sum(len(d.words_of(t)) for _, t in items) / len(items)
    index = d.Index(items, frequency, len(items), length, threshold, overlap)
    out = {}
    for doc, text in texts:
        words = d.words_of(text)
        for band in index.bands:
            for k in range(0, max(1, len(words)), band.stride):
                passage = words[k : k + 2 * band.stride]
                present = set(passage)
                for item in band.items:
                    score = sum(x for t, x in item.weights.items() if t in present)
                    if score >= threshold - 1e-9:
                        q, a = index._verified(item, passage, present)
                        if q >= overlap and a >= overlap:
                            key, new = (doc, item.item_id), (round(min(1.0, score), 9), round(q, 9), round(a, 9))
                            out[key] = max(out.get(key, new), new)
    return out


@pytest.mark.parametrize("shard", [1 << 20, 4000])
def test_nothing_is_lost_by_pruning(spark, shard):
    bench, texts = corpus(shard)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in texts], "doc_id long, text string, score double")
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): tuple(round(x, 9) for x in r[2:]) for r in d.contaminated(docs, items, shard_bytes=shard).collect()}
    want = plain(bench, texts)
    assert got == want and len(want) > 60
    assert {k for k, _ in got} >= {903, 904, None} and not {k for k, _ in got} & {900, 901, 902}
    left = d.clean(docs, items, shard_bytes=shard)
    assert left.columns == docs.columns
    dirty = {k for k, _ in want}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in texts if i not in dirty)


def test_no_rows_and_no_items(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a test item of seven words or more.")], "item_id long, text string")
    assert d.contaminated(docs.limit(0), items).count() == 0
    assert d.contaminated(docs, items.limit(0)).count() == 0 and d.clean(docs, items.limit(0)).count() == 1


def test_planted_items_in_the_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    texts = {r.item_id: b" ".join(d.words_of(r.text)) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if b" " + t + b" " in b" " + b" ".join(d.words_of(r.text)) + b" "}
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()}
    assert want and got >= want and len(got) <= len(want) + 2


@pytest.mark.parametrize("ending", ["Ñ.", "so it is.", "", "and that was the end of it for us all."])
@pytest.mark.parametrize("n", [8, 12, 40, 150])
def test_edits_and_cuts_of_the_end(spark, ending, n):
    rng = random.Random(n)
    item = " ".join(f"q{rng.randrange(500)}" for _ in range(n)) + f". {ending}"
    others = [(k, " ".join(f"q{rng.randrange(500)}" for _ in range(30)) + ".") for k in range(1, 40)]
    words, filler = item.replace(".", "").split(), " ".join(f"z{k}" for k in range(90))
    texts = [" ".join(words[:-1] + ["changed"]), " ".join(words[:-1] + [words[-1] + "ing"]), " ".join(words[:-1])]
    lost = " ".join(words[: len(words) // 2])  # half of it is no leak
    docs = spark.createDataFrame([(k, f"{filler} {t} {filler}") for k, t in enumerate([*texts, lost])], "doc_id long, text string")
    items = spark.createDataFrame([(0, item), *others], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in d.contaminated(docs, items).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert [r.doc_id for r in d.clean(docs, items).collect()] == [3]
