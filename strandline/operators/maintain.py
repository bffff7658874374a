"""Set-based rewrites: the hash cache, deletions, orphans, renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.paths import under
from strandline.operators.edges import is_build, newest, with_paths
from strandline.scale import latest

MTIME_TOLERANCE = 0.001
MAX_AGE_DAYS = 30


def valid_cache(cache: DataFrame, inventory: DataFrame) -> DataFrame:
    """Cache entries whose file still has the same size and modification time."""
    files = inventory.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    same = (F.col("size") == F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) < MTIME_TOLERANCE)
    return cache.join(files, "path").where(same).drop("_size", "_mtime")


def missing_digests(wanted: DataFrame, cache: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path, algorithm) pairs that must be computed."""
    key = ["path", "algorithm"]
    return wanted.select(*key).distinct().join(valid_cache(cache, inventory).select(*key), key, "left_anti")


def upsert_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The newest entry per (path, algorithm)."""
    order = [F.col("cached_at").desc(), F.col("digest").desc()]
    return latest(cache.unionByName(fresh), ["path", "algorithm"], order)


def invalidate_cache(cache: DataFrame, targets: DataFrame) -> DataFrame:
    """Cache without the (path, algorithm) targets; a null algorithm drops every entry of the path."""
    whole = targets.where(F.col("algorithm").isNull()).select("path").distinct()
    single = targets.where(F.col("algorithm").isNotNull()).select("path", "algorithm").distinct()
    return cache.join(whole, "path", "left_anti").join(single, ["path", "algorithm"], "left_anti").select(*cache.columns)


def evict_cache(cache: DataFrame, now: float, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    return cache.where(F.col("cached_at") >= now - max_age_days * 86400)


def delete_jobs(doomed: DataFrame, table: DataFrame, column: str = "job_id") -> DataFrame:
    """``table`` (jobs or an edge table) without the jobs of ``doomed`` (job_id)."""
    return table.join(doomed.select(F.col("job_id").alias(column)).distinct(), column, "left_anti").select(*table.columns)


def orphans(candidates: DataFrame, inputs: DataFrame, outputs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Candidate artifacts that nothing refers to any more."""
    used = inputs.select("artifact_id").unionByName(outputs.select("artifact_id"))
    if members is not None:
        used = used.unionByName(members.where(F.col("artifact_id").isNotNull()).select("artifact_id"))
    return candidates.select("artifact_id").distinct().join(used, "artifact_id", "left_anti")


def clear_outputs(artifacts: DataFrame, inputs: DataFrame, outputs: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Output edges without those of the given artifacts, and the artifacts orphaned by that."""
    kept = outputs.join(artifacts.select("artifact_id").distinct(), "artifact_id", "left_anti").select(*outputs.columns)
    return kept, orphans(artifacts, inputs, kept, members)


def popped_jobs(sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """The last job of each given session and where the step pointer goes back to.

    ``sessions`` has (session_id, current_step).
    """
    listed = jobs.join(sessions.select("session_id"), "session_id", "left_semi")
    order = [F.col("step_number").desc(), *newest()]
    last = latest(listed, ["session_id"], order).select(
        "session_id", F.col("id").alias("job_id"), "step_number", "command", "exit_code"
    )
    back = F.greatest(F.lit(1), F.col("step_number") - 1)
    return last.join(sessions, "session_id").withColumn(
        "current_step", F.when(F.col("current_step") >= F.col("step_number"), back).otherwise(F.col("current_step"))
    )


def popped_files(popped: DataFrame, outputs: DataFrame, artifacts: DataFrame, classes: DataFrame) -> DataFrame:
    """Outputs of the popped jobs with whether they may be deleted: repository or unmanaged files.

    ``classes`` has (path, class).
    """
    files = with_paths(outputs.join(popped.select("job_id"), "job_id", "left_semi"), artifacts)
    known = classes.select("path", "class").distinct()
    return files.join(known, "path", "left").select(
        "job_id", "artifact_id", "path", F.coalesce(F.col("class").isin("repo", "unmanaged"), F.lit(False)).alias("deletable")
    )


def clear_sessions(doomed: DataFrame, sessions: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions without the doomed ones (id), and jobs detached from them."""
    gone = doomed.select(F.col("id").alias("session_id"), F.lit(True).alias("_gone")).distinct()
    kept = sessions.join(doomed.select("id"), "id", "left_anti").select(*sessions.columns)
    marked = jobs.join(gone, "session_id", "left")
    detached = [c for c in ("session_id", "step_number", "step_name") if c in jobs.columns]
    return kept, marked.withColumns(
        {c: F.when(F.col("_gone").isNull(), F.col(c)) for c in detached}
    ).select(*jobs.columns)


def rename_steps(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """Jobs with new step names; ``names`` has (session_id, step_number, is_build, new_name)."""
    key = ["session_id", "step_number", "is_build"]
    return jobs.withColumn("is_build", is_build()).join(names, key, "left").withColumn(
        "step_name", F.coalesce("new_name", "step_name")
    ).select(*jobs.columns)


def backup_files(runs: DataFrame, jobs: DataFrame, outputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Files of each script's newest job that lie under the repository of the run about to start.

    ``runs`` has (script, repo_root); jobs are matched by equal script.
    """
    newest_jobs = latest(jobs.where(F.col("script").isNotNull()), ["script"], newest())
    found = runs.select("script", "repo_root").distinct().join(
        newest_jobs.select("script", F.col("id").alias("job_id"), "job_uid"), "script"
    )
    files = with_paths(outputs, artifacts).join(found, "job_id")
    return files.where(under(F.col("path"), F.col("repo_root"))).select(
        "script", "job_id", "path", F.substr("path", F.length("repo_root") + 2).alias("relative_path")
    )
