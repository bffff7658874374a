"""Helpers shared by the operators: scratch tables, running totals, bucket joins and components.

None of them gathers a key, bucket or component in one task; each holds for keys of any size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.components import component_labels, forest
from strandline.scale import materialize, scratch_root, written


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as tasks outside the JVM need it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and the path in it, for use in tasks."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` in a total ``order``, for keys of any size.

    Rows are range-sliced by key and order; a slice needs only the sum of the slices before it, of
    which there are as many as partitions.
    """
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    sliced = materialize(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    by = [F.col(k) for k in keys] or [F.lit(0)]
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_sum"))
    offsets = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    match = F.col("_slice") == F.col("_s")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("_run", F.sum(value).over(within))
        .join(offsets, match)
        .withColumn(name, F.col("_run") + F.col("_before"))
        .drop("_run", "_before", "_slice", "_s", *[f"_k_{k}" for k in keys])
    )


def meet(
    rows: DataFrame, key: str, member: str, columns: Sequence[str],
    link: Callable[[dict[str, np.ndarray]], pa.RecordBatch | None], schema: str, block: int = 1024,
    payload: DataFrame | None = None, weight: str | None = None, heavy: int = 0,
) -> DataFrame:
    """Let the members of each bucket meet: ``link`` sees every pair of a bucket at least once.

    ``rows`` has one row per (``key``, ``member``). A bucket of n members is cut into slices of about
    ``block``; every two slices meet in one call, so that no task ever holds more than some
    ``2 * block`` members of a bucket, however large it is, and nothing is left out. ``link`` gets
    the arrays of ``columns`` and of ``_side``: members of the lower slice are 0, of the upper 1; all
    are 0 where a slice meets itself. Lone members are dropped before ``payload`` (further columns
    by ``member``) is joined and before the second shuffle. With ``weight``, a column of ``rows``, slices are
    also made so many that one has some ``heavy`` of it.
    """
    load = F.sum(F.coalesce(F.col(weight), F.lit(0))) / heavy if weight else F.lit(0.0)
    # Written, so that the join has two plain sides, whose hot keys are split as it runs.
    sizes, _ = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), load.alias("_load")).where("_n > 1"), "bucket-sizes")
    shared = rows.join(sizes, key)
    if payload is not None:
        shared = shared.join(payload, member)
    cut = (
        shared.withColumn("_slices", F.ceil(F.greatest(F.col("_n") / block, F.least("_load", "_n"))).cast("int"))
        .withColumn("_own", F.pmod(F.xxhash64(F.lit("slice"), member), F.col("_slices")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
        .select(
            F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other")).alias("_group"),
            (F.col("_own") > F.col("_other")).cast("int").alias("_side"),
            *columns,
        )
        .repartition("_group")
        .sortWithinPartitions("_group")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "_group"):
            if group["_group"].size > 1 and (out := link(group)) is not None:
                yield out

    return cut.mapInArrow(run, schema)


def to_numpy(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A flat array; lists of fixed length become rows of a matrix; others stay objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return column.to_numpy(zero_copy_only=False)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Groups of rows with equal ``key`` from batches sorted by it; a group may span batches."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if kept and kept[-1].column(key)[kept[-1].num_rows - 1].as_py() != k[0]:
            yield _arrays(kept)
            kept = []
        if len(starts) == 0:
            kept.append(batch)
            continue
        if kept:
            yield _arrays([*kept, batch.slice(0, starts[0])])
            first = 1
        else:
            first = 0
        names, bounds = batch.schema.names, [0, *starts.tolist()]
        columns = [to_numpy(batch.column(i)) for i in range(batch.num_columns)]
        for a, b in zip(bounds[first:-1], bounds[first + 1 :]):
            yield {n: c[a:b] for n, c in zip(names, columns)}
        kept = [batch.slice(bounds[-1])]
    if kept:
        yield _arrays(kept)


def _arrays(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    whole = pa.Table.from_batches(parts)
    return {n: to_numpy(whole.column(n)) for n in whole.schema.names}


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges``; the component is its smallest node."""
    return component_labels(edges, a, b).withColumnRenamed("label", "component")
