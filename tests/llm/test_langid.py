"""Language identification: gradients, held-out accuracy and odd rows."""

import zlib

import numpy as np

from strandline.llm import langid

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    side = langid.Direction(rng, 3, 2)
    x, weight = rng.integers(97, 100, (2, 4)), rng.normal(size=(2, 4, 3))
    kept = []
    side.forward(x, kept)
    grads = side.backward(x, kept, weight)
    for name, values in side.p.items():
        for i in np.ndindex(values.shape):
            if name == "e" and not 97 <= i[0] < 100:
                continue
            was = values[i]
            values[i] = was + 1e-5
            up = (side.forward(x) * weight).sum()
            values[i] = was - 1e-5
            down = (side.forward(x) * weight).sum()
            values[i] = was
            assert abs((up - down) / 2e-5 - grads[name][i]) < 1e-6, (name, i)


def test_words():
    assert langid.words_of("It's ÉTÉ,\n42 x") == [b"it", b"s", "ÉtÉ".encode(), b"x"]
    assert langid.words_of(None) == [] and langid.words_of("a" * 50) == [b"a" * 24, b"a" * 24, b"aa"]
    assert not langid.has_letter("12 — !") and langid.has_letter("…ж")


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.learn(docs)
    rows = langid.predict(docs, net).select("doc_id", "lang", "lang_pred", "score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) == docs.count() and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0.25 <= r.score <= 1 for r in rows)
    # Pooled over all positions, word by word, without frequencies or caches.
    text = docs.first().text[:300]
    total = sum(net.probabilities(np.frombuffer(w, np.uint8)[None, :])[0].sum(axis=0) for w in langid.words_of(text))
    lang, score = langid.predict_batch([text], net, -1)
    assert lang == [net.langs[int(total.argmax())]] and abs(score[0] - total.max() / total.sum()) < 1e-4


def test_odd_rows(spark):
    rows = [(k, t, lang, "x") for k, t in enumerate(("the old house by the river", "la vieille maison du bord")) for lang in ("en", "fr")[k : k + 1] for _ in range(40)]
    rows += [(900, None, "en", None), (901, "", None, "x"), (902, " 12 — !! ", "en", "x"), (None, "the house", None, "x"), (903, "ж" * 300_000, None, "x"), (904, "the " * 200_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.learn(df)).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[None][0] == got[904][0] == "en" and got[903][0] in ("en", "fr")
    assert langid.learn(df.where("lang is null")) is None
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), langid.learn(df)).count() == 0


def test_rare_languages_are_learned(spark):
    common, rare = "the old house by the river was sold", "ховајући стару кућу поред реке"
    docs = spark.range(6000).selectExpr("id as doc_id", f"if(id % 1500 = 1, '{rare}', '{common}') as text", "if(id % 1500 = 1, 'sr', 'en') as lang")
    assert docs.where("lang = 'sr'").count() == 4
    net = langid.learn(docs, sample=40)
    assert net.langs == ["en", "sr"]
    assert langid.predict_batch([rare, common], net, -2)[0] == ["sr", "en"]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "the house by the river", "en", 7, 8, 9, 0.5)] * 3 + [(2, "das Haus am Fluss", "de", 7, 8, 9, 0.5)] * 3, "doc_id long, text string, lang string, _lang int, row int, found int, score double")
    got = langid.predict(df, None).collect()
    assert [tuple(r)[:2] + tuple(r)[3:6] for r in got] == [tuple(r)[:2] + tuple(r)[3:6] for r in df.collect()]
    net = langid.learn(df, sample=10, words=4, folds=1, held_out=2)
    out = langid.predict(df, net)
    assert out.columns == ["doc_id", "text", "lang", "_lang", "row", "found", "lang_pred", "score"]
    assert all((r._lang, r.row, r.found) == (7, 8, 9) and r.lang_pred in ("de", "en") for r in out.collect())
