"""Benchmark decontamination: a BM25 index of test items searched with every training passage."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
GRAM = 5  # words of an overlapping shingle
SHORT = 7  # items of up to as many words must occur word for word
WHOLE = 0.85  # share of an item's words, in shingles of the text, from which on a missing answer does not clear it
BLOCK = 8  # items whose largest weights are kept together
SHARD_BYTES = 32 << 20  # text of test items that are searched in one pass

_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 95 else 32 for c in range(256))
_MARKS = "   ‐‑‒–—―‘’‚“”„†•…‰′″‹›«»¿¡·、。「」，：；！？（）"


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of the whole text without punctuation."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        for mark in _MARKS:
            if mark in text:
                text = text.replace(mark, " ")
    return text.encode("utf-8", "replace").translate(_WORD).split()


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: the last sentence or line is the answer, else the last quarter of the words."""
    parts = [w for w in map(words_of, re.split(r"(?<=[.!?])\s+|\n+", text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut] or words, words[cut:]


@dataclass
class Item:
    item_id: object
    question: list[bytes]
    answer: list[bytes]
    weights: dict[bytes, float] = field(default_factory=dict)

    @property
    def words(self) -> list[bytes]:
        return self.question + self.answer if self.question is not self.answer else self.question

    @property
    def tail(self) -> list[bytes]:
        """The answer, extended backwards to a quarter of the words where it is shorter."""
        words = self.words
        return words[-max(len(self.answer), len(words) // 4, 1) :]


def _grams(words: Sequence[bytes], n: int) -> list[tuple]:
    return list(zip(*[words[i:] for i in range(n)]))


def _covered(words: list[bytes], have: set[tuple]) -> float:
    """Share of the words that lie in a shingle of ``have``."""
    covered, upto = 0, 0
    for k, gram in enumerate(_grams(words, GRAM)):
        if gram in have:
            covered += k + GRAM - max(k, upto)
            upto = k + GRAM
    return covered / len(words)


class Band:
    """Items of like length, and passages of twice that length that overlap by half.

    Terms are essential or common: the common terms of any item together weigh less than half the
    threshold, so a passage without enough essential terms is skipped unseen. For the others, the
    essential terms' largest weights in each block of items, plus the block's largest common weight, bound what
    any item of the block can score; only blocks whose bound reaches the threshold are scored.
    """

    def __init__(self, items: list[Item], stride: int, frequency: dict[bytes, int], threshold: float):
        self.items, self.stride, self.threshold = items, stride, threshold
        holders: dict[bytes, list[int]] = {}
        for i, item in enumerate(items):
            for t in item.weights:
                holders.setdefault(t, []).append(i)
        common_weight = np.zeros(len(items))
        essential = []
        for t in sorted(holders, key=lambda t: (-frequency.get(t, 1), t)):
            at = holders[t]
            own = np.array([items[i].weights[t] for i in at])
            if (common_weight[at] + own <= threshold / 2).all():
                common_weight[at] += own
            else:
                essential.append(t)
        self.index = {t: k for k, t in enumerate(essential)}
        self.blocks = -(-len(items) // BLOCK)
        self.common = np.array([common_weight[b * BLOCK : (b + 1) * BLOCK].max() for b in range(self.blocks)])
        starts, blocks, largest = [0], [], []
        for t in essential:
            best: dict[int, float] = {}
            for i in holders[t]:
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), items[i].weights[t])
            blocks += best.keys()
            largest += best.values()
            starts.append(len(blocks))
        self.starts, self.posted, self.weight = np.array(starts), np.array(blocks, np.int64), np.array(largest)
        self.most = np.array([max(largest[a:b]) for a, b in zip(starts, starts[1:])])

    def candidates(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """``(text, passage, block)`` whose bound reaches the threshold."""
        v, step = len(self.index), self.stride
        if not v:
            return
        sizes = np.array([len(w) for w in texts], np.int64)
        get = self.index.get
        terms = np.fromiter((get(w, -1) for words in texts for w in words), np.int64, int(sizes.sum()))
        hit = np.flatnonzero(terms >= 0)
        if not hit.size:
            return
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, hit, side="right")
        passages = -(-sizes // step)
        base = np.cumsum(passages) - passages
        k = (hit - (ends - sizes)[text]) // step
        one = (base[text] + k) * v + terms[hit]
        pairs = np.unique(np.concatenate([one, one[k > 0] - v]))  # each word lies in two passages
        passage, term = pairs // v, pairs % v
        enough = self.threshold - 1e-9
        seen, at = np.unique(passage, return_inverse=True)
        open_ = np.bincount(at, self.most[term], len(seen)) >= enough - self.common.max()
        passage, term = passage[open_[at]], term[open_[at]]
        n = self.starts[term + 1] - self.starts[term]
        upto = np.cumsum(n)
        if not upto.size:
            return
        post = np.repeat(self.starts[term] - upto + n, n) + np.arange(int(upto[-1]))
        keys, at = np.unique(np.repeat(passage, n) * self.blocks + self.posted[post], return_inverse=True)
        bound = np.bincount(at, self.weight[post], len(keys)) + self.common[keys % self.blocks]
        for key in keys[bound >= enough].tolist():
            p, block = divmod(key, self.blocks)
            which = int(np.searchsorted(base, p, side="right")) - 1
            yield which, p - int(base[which]), block


class Index:
    """BM25 weights of test items, each as a share of what the item itself would score."""

    def __init__(self, rows: Sequence[tuple[object, str]], frequency: dict[bytes, int], total: int, length: float, threshold: float, overlap: float):
        self.threshold, self.overlap, self.frequency, self.total = threshold, overlap, frequency, total
        bands: dict[int, list[Item]] = {}
        for item_id, text in rows:
            item = Item(item_id, *split_item(text))
            words = item.words
            if not words:
                continue
            scale = K1 * (1 - B + B * len(words) / length)
            raw = {t: self.idf(t) * n * (K1 + 1) / (n + scale) for t, n in Counter(words).items()}
            whole = sum(raw.values())
            item.weights = {t: x / whole for t, x in raw.items()}
            stride = 64
            while stride < len(words):
                stride *= 2
            bands.setdefault(stride, []).append(item)
        self.bands = [Band(sorted(items, key=lambda i: len(i.words)), stride, frequency, threshold) for stride, items in sorted(bands.items())]

    def idf(self, term: bytes) -> float:
        n = self.frequency.get(term, 1)
        return math.log(1 + (self.total - n + 0.5) / (n + 0.5))

    def _verified(self, item: Item, passage: list[bytes], present: set[bytes]) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words (by weight) that the passage holds.

        What ends an item can be a word or two, so the answer counts as the best of its own words, of the item's last
        quarter, and of the whole item if nearly all of it stands in the passage.
        """
        words = item.words
        if len(words) <= SHORT:
            found = float(tuple(words) in set(_grams(passage, len(words))))
            return found, found
        n = min(GRAM, len(item.question))
        have, need = set(_grams(passage, n)), _grams(item.question, n)
        question = sum(g in have for g in need) / len(need)
        answer = max(self._share(item.answer, present), self._share(item.tail, present))
        if question >= self.overlap and answer < self.overlap:
            covered = _covered(words, set(_grams(passage, GRAM)))
            answer = covered if covered >= WHOLE else answer
        return question, answer

    def _share(self, words: list[bytes], present: set[bytes]) -> float:
        weights = {t: self.idf(t) for t in words}
        return sum(x for t, x in weights.items() if t in present) / sum(weights.values())

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text ``(item, score, question overlap, answer overlap)`` of each item it holds."""
        worded = [words_of(t) for t in texts]
        found: list[dict[int, tuple]] = [{} for _ in texts]
        for band in self.bands:
            for which, k, block in band.candidates(worded):
                passage = worded[which][k * band.stride : (k + 2) * band.stride]
                present = set(passage)
                for item in band.items[block * BLOCK : (block + 1) * BLOCK]:
                    score = sum(x for t, x in item.weights.items() if t in present)
                    if score < self.threshold - 1e-9:
                        continue
                    question, answer = self._verified(item, passage, present)
                    if question >= self.overlap and answer >= self.overlap:
                        best = (item.item_id, min(1.0, score), question, answer)
                        found[which][id(item)] = max(found[which].get(id(item), best), best, key=lambda b: b[1:])
        return [list(f.values()) for f in found]


_built: dict[int, Index] = {}


def search_batch(texts: list[str | None], token: int, parts: tuple) -> list[list[tuple]]:
    """Search with the index that a worker builds once from its ``parts``."""
    if token not in _built:
        _built.clear()
        _built[token] = Index(*parts)
    return _built[token].search(texts)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6, text: str = "text", shard_bytes: int = SHARD_BYTES) -> Column:
    """Column of ``docs``: an array of ``(item_id, score, question, answer)``, one for each test item in the text.

    ``benchmark`` has ``item_id`` and ``text``. Passages of every whole text overlap by half and are at least
    twice as long as the items they are searched for. All items whose BM25 score reaches ``threshold`` of
    their own are retrieved, and kept if ``overlap`` of the question's five-word shingles and of the answer's
    words (by weight) stand in the passage. An answer of less than a quarter of the item may be missing if the
    item's last quarter stands there by as much, and any if ``WHOLE`` of all words stand there in shingles. Term statistics cover all items. The items go to the
    executors in shards of at most about ``shard_bytes`` of text; more items mean more passes.

    Defined cases: null and empty texts hold nothing; null or empty items, and items without a word, are
    never found; items of up to seven words must occur word for word; items that differ in their id alone are found each, equal rows count once; no rows or no
    items give no leaks.
    """
    items = benchmark.select(F.col("item_id"), F.col("text").alias("t")).where("t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))

    @F.pandas_udf("array<binary>")
    def terms(batch: pd.Series) -> pd.Series:
        return pd.Series([words_of(t) for t in batch])

    worded = items.withColumn("w", terms("t"))
    total, length = worded.where("size(w) > 0").agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
    empty = F.array().cast(f"array<struct<item_id: {benchmark.schema['item_id'].dataType.simpleString()}, score: double, question: double, answer: double>>")
    if not total:
        return empty
    seen = worded.select("item_id", "t", F.explode(F.array_distinct("w")).alias("term"))
    every = seen.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    kind = empty  # only its type is used below
    out = None
    for shard in range(shards):
        mine = F.pmod(F.xxhash64("item_id", "t"), F.lit(shards)) == shard
        rows = [(r.item_id, r.t) for r in items.where(mine).collect()]
        known = every.join(seen.where(mine).select("term").distinct(), "term", "left_semi").collect()
        parts = (rows, {bytes(r.term): r.n for r in known}, total, length, threshold, overlap)
        column = _search(docs, parts, text, benchmark.schema["item_id"].dataType.simpleString())
        out = column if out is None else F.concat(out, column)
    return F.coalesce(out, kind)


def _search(docs: DataFrame, parts: tuple, text: str, id_type: str) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # at most a shard
    token = zlib.crc32(repr(parts).encode())

    @F.pandas_udf(f"array<struct<item_id: {id_type}, score: double, question: double, answer: double>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = search_batch([t if isinstance(t, str) else None for t in texts], token, shared.value)
            yield pd.Series([[dict(zip(("item_id", "score", "question", "answer"), x)) for x in f] for f in found])

    return of(docs[text])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row for each document id and test item in it: ``doc_id``, ``item_id``, ``score``, ``question``, ``answer``."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(leaks(docs, benchmark, **options)).alias("x"))
    best = found.groupBy("doc_id", F.col("x.item_id").alias("item_id")).agg(F.max(F.struct("x.score", "x.question", "x.answer")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.question", "b.answer")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` in which no test item was found."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    return rows.where(F.size(leaks(rows, benchmark, text="_text", **options)) == 0).select("_row.*")
