"""The pipeline's stages against plain versions on a small table."""

import zlib
from collections import defaultdict
from hashlib import md5

import numpy as np
from public_tokenizers import path
from test_decontam import plain as plain_leaks
from test_resemblance import plain_firsts
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import quality
from strandline.llm.mixing import WORD

FOLDER = "/root/testdata/sf0.001"


def plain_mix(rows, weights=(5, 2, 1), repeats=3):
    """Copies of each (doc_id, text, source) by one sequential queue; and target by source."""
    import re

    size = {i: len(re.findall(WORD, t or "")) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in by[s]) for s in names}
    budget, open_, target = sum(total.values()), set(names), {}
    while True:
        left = budget - sum(target.values())
        full = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > repeats * total[s]]
        if not full:
            break
        for s in full:
            target[s] = repeats * total[s]
            open_.discard(s)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    entries = []
    for k, s in enumerate(names):
        queue = sorted(by[s], key=lambda i: (md5(f"mix:{i}".encode()).hexdigest(), str(i), size[i]))
        upto = np.cumsum([size[i] for i in queue]).tolist()
        entries += [((u + r * total[s]) / weight[s], k, r, n, i) for r in range(repeats) for n, (i, u) in enumerate(zip(queue, upto))]
    copies, run = defaultdict(int), 0
    for *_, i in sorted(entries):
        run += size[i]
        if run > budget:
            break
        copies[i] += 1
    return copies, target, size


def test_mix_of_odd_rows(spark):
    from strandline.llm.mixing import mix_sources

    rows = [(k, " ".join(["w"] * (k * 7 % 40)), ["a", "b", None, "é", "Z", ""][k * k % 6]) for k in range(300)]
    rows += [(400, None, "b"), (401, "", "a"), (402, "x " * 5000, "only"), (403, "tiny", "small")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, mix_size string").repartition(5)
    copies, target, size = plain_mix(rows)
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.mix_size, r.mix_copies) == (size[r.doc_id], copies[r.doc_id]), r.doc_id
        assert abs(r.mix_target - target[r.source]) < 1e-6
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.mix_copies * r.mix_size
    assert all(abs(taken[s] - target[s]) <= 5001 for s in target)
    again = {r.doc_id: r.mix_copies for r in mix_sources(df.repartition(2)).collect()}
    assert again == {r.doc_id: r.mix_copies for r in got}
    assert mix_sources(df.limit(0)).count() == 0
    doubled = mix_sources(df.union(df.where("doc_id = 7"))).where("doc_id = 7").collect()
    assert len(doubled) == 2 and doubled[0] == doubled[1]


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, items = spark.read.parquet(f"{FOLDER}/labels.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name == "quality_classifier":
            model = quality.learn(docs, labels)
            want = sorted(r.doc_id for r in docs.collect() if model.score(quality.features(r.text)[None, :].astype(float))[0] >= 0.3)
        elif name == "simhash_near_duplicates":
            rows = sorted((r.doc_id, r.text) for r in docs.collect())
            want = plain_firsts(rows)  # all pairs of five-word shingle sets
            assert len(want) < len(rows)
        elif name == "benchmark_decontamination":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            dirty = {k for k, _ in plain_leaks([tuple(r) for r in items.collect()], rows)}
            want = sorted(i for i, _ in rows if i not in dirty)
            assert dirty
        elif name == "source_mixing":
            copies, _, _ = plain_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
            want = sorted(i for i, n in copies.items() for _ in range(n))
        if name != "token_output":
            got = out.collect()
            assert out.columns == docs.columns and sorted(r.doc_id for r in got) == want, name
            docs = spark.createDataFrame(got, docs.schema)
            seen[name] = len(got)
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    start, want = 0, []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == want
    whole = sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()), key=lambda r: r[1])
    assert whole == want
