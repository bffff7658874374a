"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.quality import remainder

WINDOW = 24  # bytes after which the state is reset if no white space comes before
KEPT = 1_000_000  # words whose results a worker keeps between batches

# ASCII letters in lower case and all bytes from 128 on; everything else ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of the whole text, longer ones in windows."""
    found = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if found and max(map(len, found)) > WINDOW:
        found = [w[i : i + WINDOW] for w in found for i in range(0, len(w), WINDOW)]
    return found


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One direction: the byte table holds the products of byte embeddings with the input weights."""

    def __init__(self, rng: np.random.Generator, hidden: int, embedding: int):
        h = hidden
        self.p = {
            "e": rng.normal(scale=0.3, size=(256, embedding)), "w": rng.normal(scale=embedding**-0.5, size=(embedding, 3 * h)),
            "u": rng.normal(scale=h**-0.5, size=(h, 3 * h)), "b": np.zeros(3 * h), "c": np.zeros(h),
        }

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte of words of equal length: (words, length, hidden)."""
        p, h = self.p, self.p["u"].shape[0]
        table = p["e"] @ p["w"] + p["b"]
        state = np.zeros((len(x), h), table.dtype)
        out = np.empty((len(x), x.shape[1], h), table.dtype)
        for t in range(x.shape[1]):
            i, s = table[x[:, t]], state @ p["u"]
            gates = _sigmoid(i[:, : 2 * h] + s[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            m = s[:, 2 * h :] + p["c"]
            n = np.tanh(i[:, 2 * h :] + r * m)
            if keep is not None:
                keep.append((state, z, r, m, n))
            state = n + z * (state - n)
            out[:, t] = state
        return out

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time."""
        p, h = self.p, self.p["u"].shape[0]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_table = np.zeros((256, 3 * h))
        carried = np.zeros_like(d_out[:, 0])
        for t in range(x.shape[1] - 1, -1, -1):
            before, z, r, m, n = kept[t]
            d = d_out[:, t] + carried
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            d_in = np.concatenate([dz, dr, dn], axis=1)
            d_state = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(d_table, x[:, t], d_in)
            g["u"] += before.T @ d_state
            g["c"] += (dn * r).sum(axis=0)
            carried = d * z + d_state @ p["u"].T
        g["b"] = d_table.sum(axis=0)
        g["w"] = p["e"].T @ d_table
        g["e"] = d_table @ p["w"].T
        return g


@dataclass
class Network:
    forwards: Direction
    backwards: Direction
    out: dict[str, np.ndarray]
    langs: list[str]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language at each position of words of equal length: (words, length, languages)."""
        states = np.concatenate([self.forwards.forward(x), self.backwards.forward(x[:, ::-1])[:, ::-1]], axis=2)
        return softmax(states @ self.out["v"] + self.out["d"])

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """Sums of the position probabilities of each word."""
        sums = np.empty((len(words), len(self.langs)), np.float32)
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            for part in np.array_split(at, -(-len(at) // 4096)):
                x = np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n)
                sums[part] = self.probabilities(x).sum(axis=1)
        return sums

    def lean(self) -> Network:
        """In single precision, for use in tasks."""
        for side in (self.forwards, self.backwards):
            side.p = {k: v.astype(np.float32) for k, v in side.p.items()}
        self.out = {k: v.astype(np.float32) for k, v in self.out.items()}
        return self


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(words: list[bytes], labels: np.ndarray, counts: np.ndarray, langs: list[str], hidden: int = 16, embedding: int = 12, steps: int = 500, batch: int = 256, rate: float = 0.02, seed: int = 3) -> Network:
    """Fit by Adam; every position of a word carries the label of the document it was drawn from."""
    rng = np.random.default_rng(seed)
    net = Network(Direction(rng, hidden, embedding), Direction(rng, hidden, embedding), {"v": rng.normal(scale=0.2, size=(2 * hidden, len(langs))), "d": np.zeros(len(langs))}, langs)
    sizes = np.array([len(w) for w in words])
    groups = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        x = np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), n)
        groups.append((x, labels[at], np.cumsum(counts[at]) / counts[at].sum(), counts[at].sum() * n))
    chance = np.array([g[3] for g in groups], float)
    chance /= chance.sum()
    tables = [net.forwards.p, net.backwards.p, net.out]
    first = [{k: np.zeros_like(v) for k, v in t.items()} for t in tables]
    second = [{k: np.zeros_like(v) for k, v in t.items()} for t in tables]
    for step in range(1, steps + 1):
        x, y, upto, _ = groups[rng.choice(len(groups), p=chance)]
        pick = np.minimum(np.searchsorted(upto, rng.random(batch)), len(y) - 1)
        x, y = x[pick], y[pick]
        kept_f: list = []
        kept_b: list = []
        ahead, back = net.forwards.forward(x, kept_f), net.backwards.forward(x[:, ::-1], kept_b)[:, ::-1]
        states = np.concatenate([ahead, back], axis=2)
        d = softmax(states @ net.out["v"] + net.out["d"])
        d[np.arange(len(y)), :, y] -= 1
        d /= d.shape[0] * d.shape[1]
        d_states = d @ net.out["v"].T
        grads = [
            net.forwards.backward(x, kept_f, d_states[:, :, :hidden]),
            net.backwards.backward(x[:, ::-1], kept_b, d_states[:, ::-1, hidden:]),
            {"v": np.einsum("bth,btl->hl", states, d), "d": d.sum(axis=(0, 1))},
        ]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for t, g, m, v in zip(tables, grads, first, second):
            for k in t:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                t[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net.lean()


def learn(docs: DataFrame, sample: int = 3000, words: int = 60, folds: int = 4, held_out: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Fit on labelled documents that are not held out, with ``words`` words drawn from each.

    About ``sample`` documents are taken over all languages, and of each language at least about ``sample`` / 10 or
    all it has, which then weigh as a tenth of the sample: a language is learned however rare it is in the corpus.
    So the sample is bounded by ``sample`` and a tenth of it for each language. The words are drawn from the whole
    text, seeded by its checksum. None where no document has a label and a word.
    """
    label = F.col(lang).cast("string")
    open_ = docs.where(F.col(lang).isNotNull() & (remainder(doc_id, folds) != held_out))
    sizes = {r[0]: r[1] for r in open_.groupBy(label.alias("l")).agg(F.count(F.lit(1))).collect()}  # a row for each language
    share = min(1.0, sample / max(1, sum(sizes.values())))
    shares = {name: min(1.0, max(share, sample / 10 / n)) for name, n in sizes.items()}
    weight = {name: max(1.0, min(sample, sum(sizes.values())) / 10 / (n * shares[name])) for name, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit("langid"), doc_id), F.lit(1 << 30))
    raised = {name: x for name, x in shares.items() if x > share}
    chosen = open_
    if share < 1:
        limit = F.lit(int(share * (1 << 30)))
        if raised:
            limit = F.coalesce(F.create_map(*[F.lit(v) for name, x in raised.items() for v in (name, int(x * (1 << 30)))])[label], limit)
        chosen = open_.where(draw < limit)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, label in zip(batch["t"], batch["l"]):
                found = words_of(t if isinstance(t, str) else None)
                if found:
                    rng = np.random.default_rng(zlib.crc32(b" ".join(found)))
                    rows += [(label, found[i]) for i in rng.integers(0, len(found), words)]
            yield pd.DataFrame(rows, columns=["lang", "word"])

    rows = (
        chosen.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
        .mapInPandas(drawn, "lang string, word binary")
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.xxhash64("lang", "word"), "lang", "word")  # so that the same rows stay where the limit bites
        .limit(2 * words * (sample + len(raised) * (sample // 10 + 1))).collect()  # bites only where one id has very many rows
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.word)))
    langs = sorted({r.lang for r in rows})
    place = {name: i for i, name in enumerate(langs)}
    return train([bytes(r.word) for r in rows], np.array([place[r.lang] for r in rows]), np.array([r.n * weight[r.lang] for r in rows]), langs)


_known: dict[int, tuple[dict[bytes, int], list[np.ndarray]]] = {}


def predict_batch(texts: list[str | None], net: Network, token: int) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each text; ``token`` tells models of one worker apart."""
    index, sums = _known.setdefault(token, ({}, []))
    frequencies = [Counter(words_of(t)) for t in texts]
    new = list(set().union(*frequencies).difference(index))
    if len(index) + len(new) > KEPT:
        index.clear()
        sums.clear()
        new = list(set().union(*frequencies))
    index.update(zip(new, range(len(index), len(index) + len(new))))
    if new:
        sums[:] = [np.concatenate([*sums, net.pooled(new)])]
    langs, scores = [], []
    for text, f in zip(texts, frequencies):
        if not f or not has_letter(text):
            langs.append("und")
            scores.append(0.0)
            continue
        at = np.fromiter(map(index.__getitem__, f), np.int64, len(f))
        times = np.fromiter(f.values(), np.float64, len(f))
        pooled = times @ sums[0][at]
        best = int(pooled.argmax())
        langs.append(net.langs[best])
        scores.append(float(min(1.0, pooled[best] / pooled.sum())))
    return langs, scores


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``.

    The network reads the bytes of each word in both directions, from a state that is reset at white space,
    digits and ASCII punctuation, and labels every position; so a word has the same labels wherever it
    stands and is read once per batch. A document's probabilities are the means over all its positions.

    Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything if nothing
    could be learned; words beyond 24 bytes are read in windows of that size; repeated rows have equal
    results; no rows give no rows. Other columns pass through, except ones named as the two new columns.
    """
    if net is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    token = zlib.crc32(net.out["v"].tobytes())

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = predict_batch([t if isinstance(t, str) else None for t in texts], net, token)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), of(F.col(text)).alias("found"))
    return rows.select(*[F.col("row")[c].alias(c) for c in kept], F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))
