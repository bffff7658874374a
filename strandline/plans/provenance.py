"""From reports of runs to provenance records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import files as I
from strandline.operators.process import root_environment, summarize_processes
from strandline.operators.summary import run_timing
from strandline.operators.telemetry import detected_trackers
from strandline.scale import materialize


@dataclass
class Provenance:
    """The record of every run, as tables keyed by run_id."""

    reads: DataFrame
    writes: DataFrame
    unmanaged_code: DataFrame
    repository_files: DataFrame
    packages: DataFrame
    processes: DataFrame
    environment: DataFrame
    trackers: DataFrame
    timing: DataFrame
    counts: DataFrame


def exploded(reports: DataFrame, column: str) -> DataFrame:
    return reports.select("run_id", F.posexplode(column).alias("position", "path"))


def build_provenance(
    traces: DataFrame,
    injects: DataFrame,
    runs: DataFrame,
    inventory: DataFrame,
    tracked: DataFrame,
    package_files: DataFrame,
    versions: DataFrame,
    owners: DataFrame,
    tool_dir: str = ".provenance",
) -> Provenance:
    """Assemble records from trace and inject reports; ``runs``: (run_id, repo_root).

    ``tool_dir`` is the folder below a repository in which the tool keeps its own files.

    ``versions``: (manager, package, version); ``owners``: (path, package) of system libraries.
    Lists are exploded on reading, so that a run with any number of files stays distributed.
    """
    where = runs.join(injects.select("run_id", "sys_prefix", "sys_base_prefix"), "run_id", "left").select(
        "run_id", "repo_root", "sys_prefix", "sys_base_prefix", F.concat_ws("/", "repo_root", F.lit(tool_dir)).alias("tool_dir")
    )

    def located(reports: DataFrame, column: str) -> DataFrame:
        return exploded(reports, column).join(where, "run_id")

    opened = I.keep_reads(located(traces, "opened_files"))
    read = materialize(I.keep_reads(located(traces, "read_files")), "reads")
    modules = I.keep_reads(located(injects, "modules_files"))
    writes = materialize(I.keep_writes(located(traces, "written_files")), "writes")
    every = I.all_files(opened, read, modules).join(where, "run_id")
    classified = materialize(I.classify(every, inventory, tracked, package_files), "classified")
    pip = versions.where(F.col("manager") == "pip").select("package", "version")
    dpkg = versions.where(F.col("manager") == "dpkg").select("package", "version")
    used = injects.select("run_id", F.explode("used_packages").alias("package", "version"))
    libraries = exploded(injects, "shared_libs").join(where.select("run_id", "sys_prefix"), "run_id")
    installed = injects.select("run_id", F.explode(F.map_keys("installed_packages")).alias("name"))
    attributed = I.attribute_libraries(libraries, installed, owners)
    packages = I.run_packages(used, I.classified_packages(classified, pip), I.system_packages(attributed, dpkg))
    processes = traces.select("run_id", F.explode("processes").alias("p")).select("run_id", "p.*")
    reported = injects.where(F.size("env_reads") > 0).select("run_id", F.col("env_reads").alias("env"))
    fallback = root_environment(processes).join(reported, "run_id", "left_anti")
    return Provenance(
        reads=I.data_inputs(read, classified),
        writes=writes.select("run_id", "path").distinct(),
        unmanaged_code=I.unmanaged_code(classified),
        repository_files=classified.where(F.col("class") == "repo").select("run_id", "path"),
        packages=packages,
        processes=summarize_processes(processes.drop("env")),
        environment=reported.unionByName(fallback),
        trackers=detected_trackers(writes),
        timing=run_timing(traces.select("run_id", "start_time", "end_time")),
        counts=I.class_counts(classified),
    )


def provenance_rows(record: Provenance) -> DataFrame:
    """The records as (run_id, section, name, value) rows, ready for a report sink."""

    def rows(df: DataFrame, section: str, name, value) -> DataFrame:
        return df.select("run_id", F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))

    path = F.col("path")
    counted = F.create_map(*[part for c in I.CLASSES for part in (F.lit(c), F.col(c))])
    counts = record.counts.select("run_id", F.explode(counted).alias("name", "value"))
    return (
        rows(record.reads, "read_files", path, F.lit(None))
        .unionByName(rows(record.writes, "written_files", path, F.lit(None)))
        .unionByName(rows(record.unmanaged_code, "unmanaged_code", path, F.lit(None)))
        .unionByName(rows(record.packages, "packages", F.concat_ws(":", "manager", "package"), F.col("version")))
        .unionByName(rows(record.processes, "processes", F.col("pid"), F.to_json(F.struct("command", "fork_count", "parent_node"))))
        .unionByName(rows(record.repository_files, "repository_files", path, F.lit(None)))
        .unionByName(rows(record.environment.select("run_id", F.explode("env").alias("name", "value")), "environment", F.col("name"), F.col("value")))
        .unionByName(rows(counts, "counts", F.col("name"), F.col("value")))
        .unionByName(rows(record.trackers, "trackers", F.col("tracker"), F.lit(None)))
        .unionByName(rows(record.timing, "timing", F.lit("duration_seconds"), F.col("duration_seconds")))
    )
