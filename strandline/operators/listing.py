"""Listings, top-k, search and detail reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.references import exit_status, search_text, step_label
from strandline.operators.edges import is_build, newest, primary_digests, with_facts
from strandline.scale import top_n

METADATA = """
packages map<string,map<string,string>>,
runtime struct<hostname:string,timing:struct<start:string,end:string,duration_seconds:double>,
  command:array<string>,os:map<string,string>,python:map<string,string>,env_vars:map<string,string>,
  container:map<string,string>,vm:map<string,string>,cuda:map<string,string>,
  gpu:array<struct<name:string,memory_mb:string,compute_cap:string>>,
  cpu:struct<count:int,model:string,architecture:string,threads_per_core:int,cores_per_socket:int,sockets:int>,
  memory:struct<total_mb:bigint,available_mb:bigint>>,
git struct<commit:string,branch:string,remote_url:string,clean:boolean,uncommitted_changes:array<string>,
  commit_timestamp:string,commit_message:string>,
analysis string, cwd string, env_vars map<string,string>"""


def linked_files(edges: DataFrame, artifacts: DataFrame, hashes: DataFrame) -> DataFrame:
    """Inputs or outputs of jobs with size, path fallback and primary digest."""
    return with_facts(edges, artifacts, hashes)


def recent_jobs(jobs: DataFrame, n: int = 50) -> DataFrame:
    return jobs.orderBy(*newest()).limit(n)


def recent_jobs_per_session(jobs: DataFrame, n: int = 50) -> DataFrame:
    return top_n(jobs.where(F.col("session_id").isNotNull()), ["session_id"], newest(), n)


def search_jobs(
    jobs: DataFrame,
    every: Sequence[str] = (),
    any_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
    prefixes: Sequence[str] = (),
    phrases: Sequence[str] = (),
    n: int = 50,
) -> DataFrame:
    """Full-text search over command and script, newest first: one scan, no shuffle but the top-k."""

    def matches(text: Column) -> Column:
        def word(term: str) -> Column:
            return F.instr(text, f" {term.lower()} ") > 0

        hit = F.lit(True)
        for term in [*every, *phrases]:
            hit = hit & word(term)
        for prefix in prefixes:
            hit = hit & (F.instr(text, f" {prefix.lower()}") > 0)
        for term in none_of:
            hit = hit & ~word(term)
        if any_of:
            some = F.lit(False)
            for term in any_of:
                some = some | word(term)
            hit = hit & some
        return hit

    # The one-element array names the text, so its words are taken apart once per row.
    hit = F.exists(F.array(search_text("command", "script")), matches)
    return jobs.where(hit).orderBy(*newest()).limit(n)


def jobs_by_script(jobs: DataFrame, scripts: Sequence[str], n: int = 50) -> DataFrame:
    """The newest jobs per script name: equal, as a suffix, or anywhere in the command.

    The few names asked for travel with the scan as an array, so there is no join.
    """
    names = F.array(*[F.lit(s) for s in scripts])
    hits = F.filter(
        names,
        lambda s: F.coalesce(F.col("script").endswith(s), F.lit(False)) | F.col("command").contains(s),
    )
    return top_n(jobs.withColumn("wanted", F.explode(hits)), ["wanted"], newest(), n)


def written_files(outputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    sizes = artifacts.select(F.col("id").alias("artifact_id"), "size")
    return outputs.select("path", "artifact_id").distinct().join(sizes, "artifact_id").select("path", "artifact_id", "size")


def newest_artifacts(artifacts: DataFrame, outputs: DataFrame, n: int = 100) -> DataFrame:
    """The newest artifacts with one of their output paths; only the n kept meet the edges."""
    kept = artifacts.orderBy(F.col("first_seen_at").desc(), F.col("id").desc()).limit(n)
    kept = kept.withColumnRenamed("id", "artifact_id")
    paths = outputs.join(kept.select("artifact_id"), "artifact_id", "left_semi").groupBy("artifact_id").agg(F.min("path").alias("path"))
    return kept.join(paths, "artifact_id", "left")


def recent_outputs(
    outputs: DataFrame, jobs: DataFrame, artifacts: DataFrame, n: int = 50, kind: str | None = None
) -> DataFrame:
    """The newest output edges, of build or run jobs or both."""
    chosen = jobs if kind is None else jobs.where(is_build() == (kind == "build"))
    times = chosen.select(F.col("id").alias("job_id"), F.col("timestamp").alias("job_timestamp"))
    order = [F.col("job_timestamp").desc(), F.col("job_id").desc(), F.col("artifact_id"), F.col("path")]
    top = outputs.join(times, "job_id").orderBy(*order).limit(n)
    return top.join(artifacts.select(F.col("id").alias("artifact_id"), "size"), "artifact_id")


def outputs_with_paths(outputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    facts = artifacts.select(F.col("id").alias("artifact_id"), "size", "first_seen_at")
    return outputs.select("artifact_id", "path").distinct().join(facts, "artifact_id")


def jobs_of_artifacts(inputs: DataFrame, outputs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that produced or consumed an artifact, one row per edge."""
    edges = outputs.select("artifact_id", "job_id", F.lit("produced_by").alias("role")).unionByName(
        inputs.select("artifact_id", "job_id", F.lit("consumed_by").alias("role"))
    )
    return edges.join(jobs.select(F.col("id").alias("job_id"), "timestamp", "command"), "job_id")


def artifact_locations(inputs: DataFrame, outputs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every (artifact, path) seen."""
    first = artifacts.select(F.col("id").alias("artifact_id"), F.col("first_seen_path").alias("path")).where(
        F.coalesce(F.col("path"), F.lit("")) != ""
    )
    return (
        outputs.select("artifact_id", "path").unionByName(inputs.select("artifact_id", "path")).unionByName(first).distinct()
    )


def session_steps(jobs: DataFrame) -> DataFrame:
    """Steps of the sessions; sort by (session_id, step_number, timestamp) when writing."""
    return jobs.where(F.col("session_id").isNotNull()).select(
        "session_id", "step_number", "timestamp", F.col("id").alias("job_id"), "command", "job_type"
    )


def job_log(jobs: DataFrame, n: int = 20) -> DataFrame:
    """The newest jobs of every session with step label and status, numbered oldest first."""
    kept = top_n(jobs.where(F.col("session_id").isNotNull()), ["session_id"], newest(), n, rank="from_newest")
    return kept.select(
        "session_id", F.col("from_newest").cast("bigint").alias("from_newest"), F.col("id").alias("job_id"),
        step_label(F.col("step_number"), is_build()).alias("step"),
        "timestamp", "duration_seconds", exit_status(F.col("exit_code")).alias("status"), "command",
    )


def session_overview(sessions: DataFrame, jobs: DataFrame, n: int = 100) -> DataFrame:
    """Sessions with their newest jobs, one row per job; a session without jobs has one row."""
    rows = job_log(jobs, n).withColumnRenamed("session_id", "id").select(
        "id", "job_id", "step", "status", "command"
    )
    return sessions.select("id", "hash", "git_repo").join(rows, "id", "left").withColumnRenamed("id", "session_id")


def parse_metadata(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("meta", F.from_json("metadata", METADATA))


def job_packages(jobs: DataFrame, shown: int = 15) -> DataFrame:
    """First packages per manager of every job, and how many there are."""
    managers = parse_metadata(jobs).select(
        F.col("id").alias("job_id"), F.explode("meta.packages").alias("manager", "packages")
    )
    entries = F.array_sort(F.map_entries("packages"))
    return managers.select(
        "job_id", "manager", F.size("packages").cast("bigint").alias("package_count"),
        F.explode(F.slice(entries, 1, shown)).alias("entry"),
    ).select("job_id", "manager", "package_count", F.col("entry.key").alias("name"), F.col("entry.value").alias("version"))


def job_runtime(jobs: DataFrame) -> DataFrame:
    """Host facts of every job's metadata."""
    m = parse_metadata(jobs)
    r = F.col("meta.runtime")
    return m.select(
        F.col("id").alias("job_id"), F.col("meta.cwd").alias("cwd"), r["hostname"].alias("hostname"),
        r["os"]["system"].alias("os"), r["python"]["version"].alias("python"),
        r["cpu"]["model"].alias("cpu_model"), r["cpu"]["count"].alias("cpu_count"),
        r["memory"]["total_mb"].alias("memory_mb"), r["cuda"]["cuda_version"].alias("cuda_version"),
        F.array_size(r["gpu"]).alias("gpus"),
    )


def job_gpus(jobs: DataFrame) -> DataFrame:
    return parse_metadata(jobs).select(
        F.col("id").alias("job_id"), F.posexplode("meta.runtime.gpu").alias("index", "gpu")
    ).select("job_id", "index", "gpu.*")


def job_environment(jobs: DataFrame) -> DataFrame:
    return parse_metadata(jobs).select(
        F.col("id").alias("job_id"), F.explode("meta.runtime.env_vars").alias("name", "value")
    )


def job_telemetry(jobs: DataFrame) -> DataFrame:
    """(job_id, name, url): the links of every job's telemetry, a JSON object of links and lists of links; other JSON has none."""
    spark = jobs.sparkSession
    return spark.sql(
        """select job_id, name, coalesce(try_variant_get(each.value, '$', 'string'), try_variant_get(links, '$', 'string')) as url from (
             select id as job_id, t.key as name, t.value as links from {jobs}, lateral variant_explode(try_parse_json(telemetry)) t where t.key is not null),
           lateral variant_explode_outer(if(schema_of_variant(links) like 'ARRAY%', links, null)) each
           where schema_of_variant(links) not like 'ARRAY%' or each.value is not null""", jobs=jobs.select("id", "telemetry")
    )


def artifact_detail(
    artifacts: DataFrame, hashes: DataFrame, inputs: DataFrame, outputs: DataFrame, jobs: DataFrame, n: int = 5
) -> DataFrame:
    """Rows of an artifact's report: its digests, its locations, its newest producers and consumers."""
    order = [F.col("timestamp").desc(), F.col("job_id").desc()]
    linked = top_n(
        jobs_of_artifacts(inputs, outputs, jobs).dropDuplicates(["artifact_id", "role", "job_id"]),
        ["artifact_id", "role"], order, n,
    )
    rows = (
        hashes.select("artifact_id", F.concat(F.lit("hash:"), "algorithm").alias("kind"), F.col("digest").alias("value"))
        .unionByName(
            artifact_locations(inputs, outputs, artifacts).select(
                "artifact_id", F.lit("location").alias("kind"), F.col("path").alias("value"))
        )
        .unionByName(linked.select("artifact_id", F.col("role").alias("kind"), F.col("job_id").cast("string").alias("value")))
    )
    return rows.join(artifacts.select(F.col("id").alias("artifact_id"), "size"), "artifact_id")


def digests_of_paths(keys: DataFrame, outputs: DataFrame, artifacts: DataFrame, hashes: DataFrame) -> DataFrame:
    """Digest of the newest artifact written to each path."""
    facts = outputs.join(keys.select("path").distinct(), "path", "left_semi").select("path", "artifact_id").join(
        artifacts.select(F.col("id").alias("artifact_id"), "first_seen_at"), "artifact_id"
    )
    order = [F.col("first_seen_at").desc(), F.col("artifact_id").desc()]
    return top_n(facts, ["path"], order, 1).join(primary_digests(hashes), "artifact_id").select("path", "digest")
