"""SimHash near-duplicates: fingerprints, and their links through pivot distance tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import components, forest, meet, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
SEED = 42
CHUNK = 1 << 16  # hashes whose bits are counted at a time

# Reference fingerprints. The 64 bits are four blocks of 16. Each block has six references, each with one
# of these words in the block and zeros outside, and the same six with the complement in the block.
# The words are Walsh functions, so the six distances are independent of each other.
BLOCKS = 4
WALSH = [sum(((i & m).bit_count() & 1) << i for i in range(16)) for m in (1, 2, 4, 8, 7, 14)]

REFERENCES = np.array(
    [(w ^ flip) << (16 * k) for k in range(BLOCKS) for flip in (0, 0xFFFF) for w in WALSH], np.uint64
)


# Wide fingerprints, for texts that are near but differ in more bits than blocks can leave untouched. The references
# are all Walsh functions of 256 bits, twisted by random words. CELLS of them and their complements form a group: a
# text's cell is the nearest one. The cells of GROUPS groups are a table's key.
WIDE, CELLS, GROUPS, TABLES = 256, 128, 3, 160
_rng = np.random.default_rng(11)
_SALTS, _ODD = _rng.integers(0, 1 << 63, (2, 1, WIDE // 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TWISTS = _rng.choice(np.array([-1, 1], np.float32), (TABLES * GROUPS * CELLS // WIDE, WIDE))
_FUNCTIONS = np.array([[1 - 2 * ((i & m).bit_count() & 1) for i in range(WIDE)] for m in range(WIDE)], np.float32)
REACH = 76  # bits: of 256 that texts with 0.8 of their shingles in common differ in, 38 +- 6; 48 +- 6 of four and five shingles


def votes_of(hashes: np.ndarray) -> np.ndarray:
    """For each bit of the wide hashes of shingles, by how many more ones than zeros vote for it."""
    ones = np.zeros(WIDE, np.int64)
    for i in range(0, len(hashes), CHUNK):
        wide = (hashes[i : i + CHUNK, None] ^ _SALTS) * _ODD
        wide = (wide ^ (wide >> np.uint64(32))) * _ODD
        wide ^= wide >> np.uint64(29)
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return 2 * ones - len(hashes)


def wide_fingerprint(votes: np.ndarray) -> bytes:
    return np.packbits(votes > 0).tobytes()


def nearest_references(votes: np.ndarray) -> np.ndarray:
    """For each table a number of 24 bits: the nearest reference of each of its groups.

    The distance of a text to a reference is the mean of those of its shingles' hashes, (256 - votes . signs / n) / 2.
    """
    table = ((_TWISTS * votes.astype(np.float32)) @ _FUNCTIONS).reshape(-1, CELLS)
    best = np.abs(table).argmax(axis=1)
    cell = 2 * best + (table[np.arange(len(table)), best] < 0)
    return (cell.reshape(TABLES, GROUPS) << np.array([0, 8, 16])).sum(axis=1)


def wide_distances(fingerprints: np.ndarray) -> np.ndarray:
    """Matrix of the differing bits of wide fingerprints."""
    signs = np.unpackbits(np.frombuffer(b"".join(fingerprints), np.uint8).reshape(-1, WIDE // 8), axis=1).astype(np.float32) * 2 - 1
    return (WIDE - signs @ signs.T) / 2


def fingerprint_of(text: str | None, words: int) -> int:
    """64-bit fingerprint; 0 where there is no word."""
    w = WORD.findall(text.translate(LOWER)) if text else []
    if not w:
        return 0
    shingles = map(" ".join, zip(*[w[i:] for i in range(words)])) if len(w) >= words else [" ".join(w)]
    n = max(1, len(w) - words + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> Column:
    """Column: the fingerprint of the whole text as a (signed) long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t, words) for t in texts], np.uint64).view(np.int64))

    return of(docs[text])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivot_distances(fp: str) -> list[Column]:
    """Distances to the references: for each block six, then the six with the complement."""
    return [F.bit_count(F.col(fp).bitwiseXOR(F.lit(_signed(int(r))))).cast("int") for r in REFERENCES]


def links(fps: DataFrame, fp: str, bits: int = 2) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints at most ``bits`` apart that keep all reachability.

    A reference and its twin with the complement in one block differ in that block alone, so half the
    difference of the two distances is a coordinate of that block's bits. Two differing bits touch two of
    the four blocks at most: such fingerprints have all coordinates of two other blocks in common,
    and meet in the bucket of that pair of blocks. In a bucket, pairs whose distances to any reference
    differ by more than ``bits`` are discarded (triangle inequality); the rest are verified. Of the pairs
    verified in one call a spanning forest is returned. More bits than blocks - 2 are refused.
    """
    if not 0 <= bits <= BLOCKS - 2:
        raise ValueError(f"bits must be 0 to {BLOCKS - 2}")
    n = len(WALSH)
    tabled = fps.select(fp, F.array(*pivot_distances(fp)).alias("table"))

    def coordinates(k: int) -> Column:
        one = [(F.col("table")[2 * n * k + j] - F.col("table")[2 * n * k + n + j] + 16) / 2 for j in range(n)]
        return sum((c.cast("long") * (17**j) for j, c in enumerate(one[1:], 1)), one[0].cast("long"))

    pairs = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    keys = F.array(*[F.xxhash64(F.lit(p), coordinates(i), coordinates(j)) for p, (i, j) in enumerate(pairs)])
    rows = tabled.select(F.explode(keys).alias("bucket"), F.col(fp).alias("fp"))

    def link(group: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        f, side = group["fp"].view(np.uint64), group["_side"]
        # The table rows of the members: cheaper to make again than to shuffle six times over.
        t = np.bitwise_count(f[:, None] ^ REFERENCES[None, :]).astype(np.int8)
        low, high = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not high.size:
            low = high = np.arange(f.size)
        near = np.ones((low.size, high.size), bool)
        for column in range(0, t.shape[1], n):  # one reference of each half block discards most
            near &= np.abs(t[low, column][:, None] - t[high, column][None, :]) <= bits
        i, j = np.nonzero(near)
        i, j = low[i], high[j]
        keep = i != j
        i, j = i[keep], j[keep]
        keep = np.abs(t[i] - t[j]).max(axis=1, initial=0) <= bits
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(f[i] ^ f[j]) <= bits
        if not keep.any():
            return None
        root = forest(f.size, i[keep], j[keep])
        hung = np.flatnonzero(root != np.arange(f.size))
        return pa.RecordBatch.from_arrays([pa.array(group["fp"][hung]), pa.array(group["fp"][root[hung]])], names=["a", "b"])

    return meet(rows, "bucket", "fp", ["fp"], link, "a long, b long")


def simhash_groups(
    docs: DataFrame, words: int = 3, bits: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without their text, with ``fingerprint`` (16 hex digits) and ``component_id``.

    The component is the smallest id among the documents reachable over links of fingerprints at most
    ``bits`` apart. Equal fingerprints are folded to one before they are compared, so that thousands of
    copies cost what one costs.

    Defined cases: null and empty texts and texts without a word have fingerprint 0, which links like any
    other; fewer words than a shingle are one shingle; repeated rows stay; null ids are no
    candidates for ``component_id`` (null only where all of a component are null). No rows
    give no rows. Other columns pass through, except ones named as the two new columns.
    """
    kept = [c for c in docs.columns if c not in (text, "fingerprint", "component_id")]
    row = F.struct(*[F.col(c) for c in kept]).alias("_row")
    grouped = _grouped(docs.select(row, F.col(doc_id).alias("_id"), F.col(text).alias("_text")), words, bits)
    return grouped.select(
        *[F.col("_row")[c].alias(c) for c in kept],
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component_id").alias("component_id"),
    )


def _grouped(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """``docs`` (_row, _id, _text) without the text, with ``_fp``, ``_component`` (a fingerprint) and ``_component_id``."""
    marked, _ = written(docs.withColumn("_fp", fingerprints(docs, words, "_text")).drop("_text"), "fingerprints")
    fps, _ = written(marked.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct-fingerprints")
    found = components(links(fps, "_fp", bits), "a", "b").withColumnRenamed("node", "_fp")
    grouped = fps.join(found, "_fp", "left").withColumn("_component", F.coalesce("component", "_fp"))
    least = grouped.groupBy("_component").agg(F.min("_least").alias("_component_id"))
    named, _ = written(grouped.join(least, "_component").select("_fp", "_component", "_component_id"), "components")
    return marked.join(named, "_fp")


def row_keys(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_row, _first, _text): whole rows of ``docs``, and what orders and names them: ids of any type, null after all others."""
    own = F.col(doc_id)
    key = F.concat(F.when(own.isNull(), "-").otherwise("="), F.coalesce(own.cast("string"), F.lit("")))
    digest = [F.xxhash64(F.lit(k), own.isNull(), *[F.col(c).cast("string") for c in docs.columns]) for k in (0, 1)]
    return docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text).alias("_text"),
        F.struct(own.isNull().alias("none"), own.alias("own"), key.alias("key"), digest[0].alias("h0"), digest[1].alias("h1")).alias("_first"),
    )


def rows_named(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The whole rows of ``rows`` (from ``row_keys``) that ``firsts`` (_first) names; equal rows once."""
    by = ["_key", "_h0", "_h1"]

    keys = [F.col(f"_first.{c[1:]}").alias(c) for c in by]
    found = rows.select("_row", *keys).join(firsts.select(*keys), by, "left_semi")
    return found.dropDuplicates(by).select("_row.*")


def first_of_groups(docs: DataFrame, words: int = 3, bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id (null after all others).

    Where that id is repeated, the row with the smallest hashes of all its columns stays. Ids may be of any type that
    has an order, and columns may have any names.
    """
    rows = row_keys(docs, doc_id, text)
    groups = _grouped(rows.select(F.col("_first").alias("_row"), F.col("_first.own").alias("_id"), "_text"), words, bits)
    return rows_named(rows, groups.groupBy("_component").agg(F.min("_row").alias("_first")))
