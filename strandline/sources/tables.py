"""Lineage tables and report files in; reports and payloads out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.scale import is_empty, materialize
from strandline.schemas import INJECT_REPORT, LINEAGE, PIPELINE_DOCUMENT, TRACE_REPORT
from strandline.session import tune

# Fixed value: how much of a file is hashed at a time.
HASH_CHUNK = 8 * 1024 * 1024
LISTED = 10_000  # names that a task hands on at a time
ILLEGAL = re.compile(r"[\x00-\x20\x7f\"#%<>?\[\\\]^`{|}]")  # what Spark writes as %.. in the path of a file
STORES = {"file", "hdfs", "s3", "gs"}  # what tasks can open


def read_lineage(
    spark: SparkSession, folder: str, names: Sequence[str] | None = None, views: bool = False
) -> dict[str, DataFrame]:
    """The lineage tables of a folder (all nine, or the named ones), one Parquet directory each."""
    tables = {name: spark.read.schema(LINEAGE[name]).parquet(f"{folder}/{name}") for name in names or LINEAGE}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def write_lineage(tables: dict[str, DataFrame], folder: str, mode: str = "append") -> None:
    """Write lineage tables; edges and jobs are clustered by what later joins use."""
    for name, df in tables.items():
        if name in ("job_inputs", "job_outputs"):
            df = df.sortWithinPartitions("artifact_id")
        df.write.mode(mode).parquet(f"{folder}/{name}")


def file_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and the path in it, for use in tasks."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def write_texts(rows: DataFrame, folder: str) -> None:
    """A file below ``folder`` for each row (path, text), written by the tasks that hold the rows."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, place = file_store(root)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                name = f"{place}/{path}"
                store.create_dir(name.rpartition("/")[0])
                with store.open_output_stream(name) as out:
                    out.write(text.encode())
            yield pd.DataFrame({"files": [len(batch)]})

    rows.select("path", "text").mapInPandas(put, "files long").agg(F.sum("files")).collect()


def read_texts(spark: SparkSession, folder: str, name: str | None = None, skip_errors: bool = False) -> DataFrame:
    """(path, text) of the files below ``folder``, or those of that ``name``; listed and read by tasks.

    A run may have files of its own, so their names are too many for the driver and a split for a few of them too little for a
    task. As Spark's readers do, empty files and names that begin with ``_`` or ``.`` are left out, without ``name`` also what
    lies in folders below, and with ``skip_errors`` what cannot be read. Stores that tasks cannot open are read by Spark.
    """
    tune(spark)  # tasks import this module
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place = target.getFileSystem(spark._jsc.hadoopConfiguration())
    root = place.makeQualified(target)
    if place.getScheme() not in STORES or not place.exists(root) or not place.getFileStatus(root).isDirectory():
        reader = spark.read.option("ignoreCorruptFiles", skip_errors).option("recursiveFileLookup", name is not None)
        found = (reader.option("pathGlobFilter", name) if name else reader).text(folder, wholetext=True)
        return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where("text <> ''")
    root = root.toString()
    below = name is not None

    def shown(entry: fs.FileInfo) -> bool:
        hidden = entry.base_name.startswith(".") or entry.base_name.startswith("_") and "=" not in entry.base_name
        return not hidden and not entry.base_name.endswith("._COPYING_")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = file_store(root)
        found: list[tuple[str, int, bool]] = []
        for batch in batches:
            for at in batch["at"]:
                for entry in filter(shown, store.get_file_info(fs.FileSelector(at))):
                    found.append((entry.path, entry.size, entry.type == fs.FileType.Directory))
                    if len(found) == LISTED:
                        yield pd.DataFrame(found, columns=["at", "size", "is_folder"])
                        found = []
        yield pd.DataFrame(found, columns=["at", "size", "is_folder"])

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = file_store(root)
        for batch in batches:
            rows, held = [], 0
            for at in batch["at"]:
                try:
                    with store.open_input_stream(at) as source:
                        content = source.read()
                except OSError:
                    if not skip_errors:
                        raise
                    continue
                rows.append((ILLEGAL.sub(lambda c: f"%{ord(c[0]):02X}", at), content))
                held += len(content)
                if held > HASH_CHUNK:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["path", "content"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.createDataFrame([(file_store(root)[1],)], "at string")
    files = None
    while True:
        # A level of folders a round, written: the next round lists them in as many tasks as there are partitions.
        level = materialize(folders.mapInPandas(listed, "at string, size long, is_folder boolean"), "listing")
        held = level.where("not is_folder and size > 0")
        held = held.where(F.element_at(F.split("at", "/"), -1) == name) if below else held
        files = held.select("at") if files is None else files.unionByName(held.select("at"))
        folders = level.where("is_folder").select("at").repartition(parts, "at")
        if not below or is_empty(folders):
            read = files.repartition(parts, "at").mapInPandas(texts, "path string, content binary")
            return read.select("path", F.col("content").cast("string").alias("text"))


def _run_id(name: F.Column) -> F.Column:
    return F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?$", 1)


def _file_list(column: str) -> F.Column:
    return F.array_distinct(F.coalesce(F.col(column), F.array().cast("array<string>"))).alias(column)


def read_trace_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One row per trace report, named by its file; missing keys get defaults, paths are kept once."""
    text, many = F.col("text"), T.ArrayType(TRACE_REPORT)
    # A file may hold a list of reports.
    several = F.coalesce(F.from_json(text, many), F.array(F.lit(None).cast(TRACE_REPORT)))
    read = F.when(text.rlike(r"^\s*\["), several).otherwise(F.array(F.from_json(text, TRACE_REPORT)))
    found = F.when(F.col("valid"), read).otherwise(F.array(F.lit(None).cast(TRACE_REPORT)))
    name = F.element_at(F.split("path", "/"), -1)
    plain = F.regexp_replace("text", "^\ufeff", "").alias("text")
    texts = read_texts(spark, folder).select(name.alias("name"), F.is_valid_utf8("text").alias("valid"), plain).where(text.rlike(r"\S"))
    raw = texts.select("name", F.explode(found).alias("report")).select("name", "report.*")
    zero = F.lit(0.0)
    no_map = F.create_map().cast("map<string,string>")
    return raw.select(
        _run_id(F.col("name")).alias("run_id"),
        F.coalesce("processes", F.array().cast(TRACE_REPORT["processes"].dataType)).alias("processes"),
        _file_list("opened_files"), _file_list("read_files"), _file_list("written_files"),
        F.coalesce("env_accessed", no_map).alias("env_accessed"),
        F.coalesce("start_time", zero).alias("start_time"), F.coalesce("end_time", zero).alias("end_time"),
    )


def read_inject_reports(spark: SparkSession, folder: str, runs: DataFrame) -> DataFrame:
    """One row per run of ``runs`` (run_id); an absent or malformed report gives defaults."""
    schema = T.StructType([*INJECT_REPORT.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    named = raw.select(_run_id(F.col("_metadata.file_name")).alias("run_id"), *INJECT_REPORT.names)
    rows = runs.select("run_id").distinct().join(named, "run_id", "left")
    defaults = {"array": F.array(), "map": F.create_map(), "string": F.lit("")}
    return rows.select(
        "run_id",
        *[
            F.coalesce(f.name, defaults[f.dataType.typeName()].cast(f.dataType)).alias(f.name)
            for f in INJECT_REPORT.fields
        ],
    )


def hash_files(spark: SparkSession, folder: str, algorithms: Sequence[str] = ("sha256",)) -> DataFrame:
    """(path, size, digests…): every digest from one read of a file of any size.

    Tasks read the shared file system in chunks, so no file has to fit in memory.
    """
    unknown = [a for a in algorithms if a not in hashlib.algorithms_available]
    if unknown:
        raise ValueError(f"unknown digest algorithms: {', '.join(unknown)}")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["length"]):
                found = [hashlib.new(a) for a in algorithms]
                store, place = file_store(path)
                with store.open_input_stream(place) as source:
                    while chunk := source.read(HASH_CHUNK):
                        for h in found:
                            h.update(chunk)
                rows.append((path, size, *[h.hexdigest() for h in found]))
            yield pd.DataFrame(rows, columns=["path", "size", *algorithms])

    return listed.repartition("path").mapInPandas(digest, "path string, size bigint" + "".join(f", `{a}` string" for a in algorithms))


def read_debug_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_dir, text) of tracker debug logs below a folder; unreadable ones are left out."""
    reader = spark.read.option("pathGlobFilter", "debug.log").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    return reader.text(folder, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/logs/[^/]+$", 1).alias("run_dir"), F.col("value").alias("text")
    )


def read_run_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(run_dir, run_id_text, project, entity) of tracker run metadata files."""
    schema = "run_id string, project string, entity string"
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "wandb-metadata.json").option(
        "recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    return reader.json(folder).select(
        F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/files/[^/]+$", 1).alias("run_dir"),
        F.col("run_id").alias("run_id_text"), "project", "entity",
    )


def read_run_summaries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(run_dir, summary) of tracker run summaries as VARIANT, whatever their shape, and (run_dir, text) of those that are no JSON.

    Empty files are in neither, as no task is given one to read.
    """
    texts = read_texts(spark, folder, "wandb-summary.json", skip_errors=True).select(
        F.regexp_extract("path", "([^/]+)/files/[^/]+$", 1).alias("run_dir"), "text"
    )
    parsed = texts.withColumn("summary", F.try_parse_json("text"))
    return parsed.where("summary is not null").select("run_dir", "summary"), parsed.where("summary is null").select("run_dir", "text")


def read_pipeline_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PIPELINE_DOCUMENT).option("multiLine", True).json(folder)


def write_report(rows: DataFrame, folder: str, key: str, mode: str = "overwrite") -> None:
    """Report rows as JSON lines, those of a key together in key order; no document is gathered."""
    rows.repartitionByRange(F.col(key), F.hash(*[F.col(c) for c in rows.columns])).sortWithinPartitions(key).write.mode(mode).json(folder)


def write_graph_report(nodes: DataFrame, artifacts: DataFrame, summary: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Session graphs as JSON lines: nodes, artifacts and counters side by side, keyed by session."""
    for name, df in (("nodes", nodes), ("artifacts", artifacts), ("summary", summary)):
        write_report(df, f"{folder}/{name}", "session_id", mode)


def write_payloads(payloads: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Batched payload rows, a directory per kind; ``batch`` keeps requests apart."""
    payloads.repartitionByRange("session_hash", "batch").sortWithinPartitions("session_hash", "batch").write.mode(mode).parquet(folder)
