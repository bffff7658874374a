"""Reproduction plans and environment manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.edges import is_build
from strandline.operators.listing import parse_metadata
from strandline.scale import latest, running_rank, top_n


def plans(targets: DataFrame, made_by: DataFrame, jobs: DataFrame, sessions: DataFrame) -> DataFrame:
    """(plan_id, session_id, git_repo, git_commit) of artifacts whose producer belongs to a session.

    ``targets``: (plan_id, artifact_id); ``sessions``: (id, git_repo, git_commit_start, git_commit_end).
    """
    owner = jobs.select(F.col("id").alias("job_id"), "session_id")
    return (
        targets.join(made_by.select("artifact_id", "job_id"), "artifact_id")
        .join(owner, "job_id")
        .join(sessions.withColumnRenamed("id", "session_id"), "session_id")
        .select("plan_id", "session_id", "git_repo", F.coalesce(F.nullif("git_commit_start", F.lit("")), "git_commit_end").alias("git_commit"))
    )


def session_step_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("session_id").agg(
        F.count_if(is_build()).alias("build_steps"), F.count_if(~is_build()).alias("run_steps")
    )


def execution_order(jobs: DataFrame) -> DataFrame:
    """Steps of every session in execution order: builds first, each kind numbered from 1."""
    steps = jobs.where(F.col("session_id").isNotNull()).select(
        "session_id", F.when(is_build(), 0).otherwise(1).alias("phase"), "step_number", "timestamp", F.col("id").alias("job_id"), "command"
    )
    order = [F.col(c) for c in ("step_number", "timestamp", "job_id")]
    return running_rank(steps, ["session_id", "phase"], order, "number").select(
        "session_id", F.concat(F.when(F.col("phase") == 0, "B").otherwise(""), F.col("number").cast("string")).alias("label"),
        "number", "phase", "job_id", "command",
    )


def step_files(order: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(session_id, label, direction, artifact_id, path): what each step of an execution order reads and writes."""
    edges = inputs.select("job_id", F.lit("in").alias("direction"), "artifact_id", "path").unionByName(
        outputs.select("job_id", F.lit("out").alias("direction"), "artifact_id", "path")
    )
    return order.select("session_id", "label", "job_id").join(edges, "job_id").drop("job_id")


def _entries(jobs: DataFrame, manager: str) -> DataFrame:
    """(session_id, is_build, step_number, timestamp, id, name, version) of one package manager."""
    return (
        parse_metadata(jobs)
        .select("session_id", is_build().alias("is_build"), "step_number", "timestamp", "id",
                F.explode(F.col("meta.packages")[manager]).alias("name", "version"))
        .where(F.col("name") != "")
    )


def pip_requirements(jobs: DataFrame) -> DataFrame:
    """(session_id, requirement): every ``name==version`` any step used, conflicting ones included."""
    version = F.coalesce(F.col("version"), F.lit(""))
    text = F.when(version != "", F.concat("name", F.lit("=="), version)).otherwise(F.col("name"))
    return _entries(jobs, "pip").select("session_id", text.alias("requirement")).distinct()


def first_versions(jobs: DataFrame, manager: str) -> DataFrame:
    """(session_id, name, version): the first version seen in the run steps, else in the build steps."""
    order = F.struct(F.col("is_build"), "step_number", "timestamp", "id")
    # False sorts first, so a run step's version is preferred to any build step's.
    return _entries(jobs, manager).groupBy("session_id", "name").agg(
        F.min_by(F.coalesce("version", F.lit("")), order).alias("version")
    )


def dpkg_requirements(jobs: DataFrame) -> DataFrame:
    return first_versions(jobs, "dpkg")


def build_dpkg_requirements(jobs: DataFrame) -> DataFrame:
    return first_versions(jobs, "build_dpkg")


def build_pip_requirements(jobs: DataFrame) -> DataFrame:
    return first_versions(jobs, "build_pip")


def requirement_preview(jobs: DataFrame, shown: int = 10) -> DataFrame:
    """First names per session and manager with how many more there are; pip names carry versions."""
    rows = parse_metadata(jobs).select("session_id", F.explode("meta.packages").alias("manager", "packages")).where(
        F.col("manager").isin("pip", "dpkg", "build_pip", "build_dpkg")
    ).select("session_id", "manager", F.explode("packages").alias("name", "version")).where(F.col("name") != "")
    label = F.when(
        (F.col("manager") == "pip") & (F.coalesce("version", F.lit("")) != ""), F.concat("name", F.lit("=="), "version")
    ).otherwise(F.col("name"))
    key = ["session_id", "manager"]
    names = rows.select(*key, label.alias("label")).distinct()
    rest = names.groupBy(*key).agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0).cast("bigint")).alias("more"))
    return top_n(names, key, [F.col("label").asc()], shown).join(rest, key)


def environment_drift(jobs: DataFrame, hosts: DataFrame) -> DataFrame:
    """(session_id, host, warnings): how a host differs from where the session ran.

    The first step with runtime metadata speaks for the session (builds first). ``hosts``:
    (session_id, host, system, machine, cuda_version, has_gpu).
    """
    known = parse_metadata(jobs).where(F.col("meta.runtime").isNotNull()).select(
        "session_id", "id", (~is_build()).alias("_run"), "step_number", "timestamp", F.col("meta.runtime").alias("r")
    )
    first = latest(known, ["session_id"], [F.col(c).asc() for c in ("_run", "step_number", "timestamp", "id")])
    os_, cpu, cuda = F.col("r.os"), F.col("r.cpu"), F.col("r.cuda")

    def differs(was: Column, now: Column, text: str) -> Column:
        said = F.concat(F.lit(f"{text}: original="), was, F.lit(", current="), now)
        return F.when((F.coalesce(was, F.lit("")) != "") & (was != now), said)

    wanted = F.coalesce(F.size(cuda), F.lit(0)) > 0
    version = cuda["cuda_version"]
    gpus = F.coalesce(F.array_size("r.gpu"), F.lit(0)) > 0
    names = F.array_join(F.transform("r.gpu", lambda g: F.coalesce(g["name"], F.lit("unknown"))), ", ")
    warnings = F.array_compact(
        F.array(
            differs(os_["system"], F.col("system"), "OS mismatch"),
            differs(os_["machine"], F.col("machine"), "Architecture mismatch"),
            differs(cpu["architecture"], F.col("machine"), "CPU architecture mismatch"),
            F.when(wanted & F.col("cuda_version").isNull(), F.concat(
                F.lit("CUDA required (version "), F.coalesce(version, F.lit("unknown")), F.lit(") but not available"))),
            F.when(wanted, differs(version, F.col("cuda_version"), "CUDA version mismatch")),
            F.when(gpus & ~F.col("has_gpu"), F.concat(F.lit("GPU required ("), names, F.lit(") but not detected"))),
        )
    )
    return first.join(hosts, "session_id").select("session_id", "host", warnings.alias("warnings"))
