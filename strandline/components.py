"""Connected components of graphs of any shape: no node, however many edges it has, is gathered in a task.

Edges are first contracted where they lie: each task replaces the edges it reads by the trees of a union-find. Then
large-star and small-star rounds run until nothing changes. A round looks up the least neighbour of each node; the few
nodes that hold more than one ``HEAVY``-th of all edges are looked up by broadcast (fewer than ``HEAVY`` rows, whatever
the graph), all others by a shuffle in which no key has more than that share, or than ``LIGHT`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandline.scale import discard, written

HEAVY = 10_000
LIGHT = 256  # edges with which no node is looked up by broadcast
CHUNK = 1 << 20  # edges that are contracted at a time


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of each of n members under links a[i] - b[i]; the root is the first member of its tree."""
    parent = np.arange(n)
    while a.size:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each ``CHUNK`` replaced by (node, least node of its tree); order of nodes as Spark's."""

    def trees(kept: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        whole = pa.Table.from_batches(kept)
        ends = [whole.column(i).to_numpy() for i in (0, 1)]
        codes, names = pd.factorize(np.concatenate(ends), sort=True)
        root = forest(len(names), *np.split(codes, 2))
        hung = np.flatnonzero(root != np.arange(len(names)))
        kind = whole.schema.field(0).type
        if hung.size:
            return pa.RecordBatch.from_arrays([pa.array(names[hung], kind), pa.array(names[root[hung]], kind)], names=["a", "b"])
        return None

    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            if (out := trees(kept)) is not None:
                yield out
            kept, rows = [], 0
    if rows and (out := trees(kept)) is not None:
        yield out


def _put(edges: DataFrame, label: str) -> tuple[DataFrame, str, tuple]:
    """``edges`` (a, b) written; their number and sums of hashes, observed while writing."""
    seen = Observation()
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.coalesce(F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(i), "a", "b"), 32)), F.lit(0)).alias(f"h{i}") for i in (1, 2)]
    table, path = written(edges.observe(seen, *sums), label)
    return table, path, tuple(seen.get[k] for k in ("n", "h1", "h2"))


def _least(rows: DataFrame, with_self: bool) -> tuple[DataFrame, str]:
    """(a, m, n): the least neighbour of each node (or itself) and how many rows it has; combined before the shuffle."""
    least = F.min("b")
    made = rows.groupBy("a").agg((F.least(F.col("a"), least) if with_self else least).alias("m"), F.count(F.lit(1)).alias("n"))
    return written(made, "least")


def _looked_up(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(a, b, m): ``rows`` with the least neighbour of ``a``."""
    heavy = least.where((F.col("n") * HEAVY > total) & (F.col("n") > LIGHT)).select("a", F.col("m").alias("_m"))
    marked = rows.select("a", "b").join(F.broadcast(heavy), "a", "left")
    light = marked.where("_m is null").select("a", "b").join(least.select("a", "m"), "a")
    return marked.where("_m is not null").select("a", "b", F.col("_m").alias("m")).unionByName(light)


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of ``edges`` that has a neighbour; the label is the least node of its component.

    Edges may be repeated, stand in either direction or lead from a node to itself (which says nothing); those
    with a null end are left out. Every stage is written to the shared folder and deleted when
    the next one stands; only counts reach the driver.
    """
    spark = edges.sparkSession
    # Written first: edges that come from Python would keep two workers a task.
    pairs, drawn = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "edges")
    now, path, mark = _put(pairs.mapInArrow(_contracted, pairs.schema).distinct(), "star")
    discard(spark, drawn)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, at_least = _least(both, True)
        large = _looked_up(both.where("b > a"), least, 2 * mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, at_large, (rows, *_) = _put(large, "star")
        lows, at_lows = _least(large, False)
        hung = _looked_up(large, lows, rows).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, new_path, new_mark = _put(hung.unionByName(lows.select("a", F.col("m").alias("b"))).distinct(), "star")
        for done in (path, at_least, at_large, at_lows):
            discard(spark, done)
        now, path = after, new_path
        if new_mark == mark:
            break
        mark = new_mark
    centres = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres.withColumn("label", F.col("node")))
