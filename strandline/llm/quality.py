"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPES = 256  # buckets of word shapes
STATS = 10
WIDTH = SHAPES + STATS

# What a byte says of a word's shape: letters by case, digits, white space; other characters stand for themselves.
_SHAPE = bytearray(range(256))
for _c in range(256):
    if ord("a") <= _c <= ord("z") or _c >= 128:
        _SHAPE[_c] = ord("a")
    elif ord("A") <= _c <= ord("Z"):
        _SHAPE[_c] = ord("A")
    elif ord("0") <= _c <= ord("9"):
        _SHAPE[_c] = ord("0")
    elif _c <= 32 or _c == 127:
        _SHAPE[_c] = ord(" ")
_SHAPE = bytes(_SHAPE)

_buckets: dict[bytes, int] = {}


def _bucket(shape: bytes) -> int:
    """Bucket of the whole shape; those of short ones are remembered."""
    if len(shape) > 16:
        return zlib.crc32(shape) % SHAPES
    found = _buckets.get(shape)
    if found is None:
        if len(_buckets) > 100_000:
            _buckets.clear()
        found = _buckets[shape] = zlib.crc32(shape) % SHAPES
    return found


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of word shapes ("Aa," "A!" "a*" "|"), and a few figures of the whole text."""
    out = np.zeros(WIDTH, np.float32)
    raw = (text or "").encode("utf-8", "replace")
    shaped = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    if not shaped.size:
        return out
    runs = shaped[np.concatenate([[True], shaped[1:] != shaped[:-1]])]
    shapes = runs.tobytes().split()
    n = len(shapes)
    if n:
        found = np.fromiter(map(_bucket, shapes), np.int64, n)
        out[:SHAPES] = np.sqrt(np.bincount(found, minlength=SHAPES) / n)
    kinds = np.bincount(shaped, minlength=256)
    letters, blank = kinds[ord("a")] + kinds[ord("A")], kinds[ord(" ")]
    marks = shaped.size - letters - blank - kinds[ord("0")]
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    out[SHAPES:] = (
        np.log1p(n) / 10, kinds[ord("A")] / max(1, letters), marks / shaped.size, kinds[ord("0")] / shaped.size,
        min(1.0, (shaped.size - blank) / max(1, n) / 20), 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 5, 1.0 - runs.size / shaped.size,
        np.sqrt(sum(map(eq, words, words[1:])) / max(1, n)), len(set(words)) / max(1, len(words)),
    )
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -40, 40)))


def _loss(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sigmoid loss of margins, which is bounded, and its derivative."""
    wrong = 1 / (1 + np.exp(np.clip(z, -40, 40)))
    return wrong, -wrong * (1 - wrong)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Minimise the non-negative unbiased risk of a linear model by full-batch Adam.

    The risk is prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). The second
    part estimates the risk on the negatives among the unlabelled; where it falls below zero the model
    has begun to fit the sample, and the step goes back on that part alone.
    """
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), float(np.log(prior / (1 - prior))), prior)
    p, u = positive.astype(np.float32), unlabelled.astype(np.float32)
    w, b = np.zeros(WIDTH, np.float32), 0.0
    m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for step in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        _, as_pos = _loss(zp)
        neg_p, as_neg = _loss(-zp)
        neg_u, un = _loss(-zu)
        gain = -un / len(u)  # d loss(-z) / dz
        loss_back = -as_neg * (-prior / len(p))
        negative = neg_u.mean() - prior * neg_p.mean()
        gw = u.T @ gain + p.T @ loss_back
        gb = gain.sum() + loss_back.sum()
        if negative >= 0:
            plus = prior * as_pos / len(p)
            gw, gb = gw + p.T @ plus, gb + plus.sum()
        else:
            gw, gb = -gw, -gb
        g = np.concatenate([gw + decay * w, [gb]])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return Model(w, b, prior)


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % of


def _sampled(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """About ``n`` rows of ``df`` by a hash of ``key``; all of them where there are fewer."""
    share = min(1.0, n / max(1, df.count()))
    return df if share == 1 else df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30)))


def learn(
    docs: DataFrame, labels: DataFrame, sample: int = 4000, folds: int = 5, held_out: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """Fit on about ``sample`` trusted positives and as many unlabelled documents, none of them held out.

    ``labels`` has ``doc_id`` and ``quality``; an id that is labelled more than once is positive if all its
    labels are 1. The class prior is the share of positives among all labels that may be learned from.
    Features are made on the executors; about a kilobyte for each of at most ``2 * sample`` documents a side
    reaches the driver.
    """
    open_ = labels.where(remainder("doc_id", folds) != held_out).where("quality is not null and doc_id is not null")
    known = open_.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    n, positives = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("_quality"), F.lit(0))).first()
    prior = float(np.clip((positives + 1) / (n + 2), 0.02, 0.98))

    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where(remainder("_id", folds) != held_out)
    trusted = _sampled(known.where("_quality = 1"), "_id", sample, "trusted").select("_id")
    chosen = texts.join(F.broadcast(trusted), "_id", "left_semi")  # at most about ``sample`` ids

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [features(t if isinstance(t, str) else None).tobytes() for t in batch["_text"]]})

    def made(df: DataFrame) -> np.ndarray:
        # Rows of one id are sampled together; the limit only bites where one id has very many.
        rows = _sampled(df, "_id", sample, "vectors").select("_text").mapInPandas(vectors, "x binary").limit(2 * sample).collect()
        return np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, WIDTH)

    return fit_nnpu(made(chosen), made(texts), prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Defined cases: null counts as empty text, whose score is that of the bias; texts without words have the
    figures of their characters alone; repeated rows have equal scores; no rows give no rows. Other
    columns pass through, except ones named as the two new columns.
    """

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t if isinstance(t, str) else None) for t in texts]).reshape(-1, WIDTH)
            yield pd.Series(model.score(x.astype(np.float64)))

    return docs.withColumn("score", of(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` that the classifier does not reject, with their own columns, whatever their names.

    Defined cases: null counts as empty text and is kept or rejected by the score of that; repeated rows are kept
    or rejected alike; without labels every score is the prior's; no rows give no rows.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    return score(rows, learn(docs, labels), threshold, "_text").where("predicted = 1").select("_row.*")
