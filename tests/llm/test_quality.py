"""Quality: the risk estimator, held-out accuracy and odd rows."""

import zlib

import numpy as np

from strandline.llm import quality

SF = "/root/testdata/sf0.01"


def test_risk_separates_without_negatives():
    rng = np.random.default_rng(1)
    x = np.zeros((4000, quality.WIDTH))
    truth = rng.random(4000) < 0.7
    x[:, 0] = np.where(truth, 1, -1) + rng.normal(scale=0.4, size=4000)
    positive = x[:1500][truth[:1500]]
    model = quality.fit_nnpu(positive, x[1500:3000], 0.7)
    right = (model.score(x[3000:]) >= 0.5) == truth[3000:]
    assert right.mean() > 0.95
    assert quality.fit_nnpu(positive[:0], x[:10], 0.7).score(np.zeros((1, quality.WIDTH)))[0] == np.float64(0.7).round(12)


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, junk = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert len(junk) > 5
    assert np.mean([g > j for g in good for j in junk]) > 0.98
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    again = quality.learn(docs, labels)
    assert np.allclose(again.weights, model.weights, atol=1e-3)
    # Held-out labels have no part in the model.
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.remainder("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.learn(docs, turned).weights, model.weights, atol=1e-3)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", "c"), (4, "Plain words here.", "d"), (4, "Plain words here.", "d"), (None, "x" * 2_000_000, None), (5, "😀 \0", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, None), (1, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert quality.score(df.limit(0), quality.learn(df.limit(0), labels.limit(0))).count() == 0
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns


def test_whole_words_count():
    # Words that differ from the seventeenth run on are told apart.
    long = "a1" * 40
    others = {quality._bucket(quality_shape(long[:n])) for n in range(17, 80)}
    assert len(others) > 40


def quality_shape(word):
    import re

    return re.sub("[0-9]+", "0", word).encode()


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "Some plain words.", 7, 8, 9)], "doc_id long, text string, _row int, _text int, predicted int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.accepted(df, labels, threshold=0.0).first() == df.first()
