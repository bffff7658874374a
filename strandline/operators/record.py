"""From run facts to lineage tables: identities, step numbers, artifacts, edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.components import component_labels
from strandline.functions.paths import normal_path
from strandline.functions.references import primary_script
from strandline.operators.edges import newest
from strandline.schemas import LINEAGE
from strandline.scale import latest, materialize, multiset_digest, running_rank, settled


def normal_edges(edges: DataFrame, home: str) -> DataFrame:
    """(job_id, direction, path) with paths as step identities see them; ``repo_root`` is a column."""
    return edges.select(
        "job_id", "direction", normal_path(F.col("path"), F.col("repo_root"), F.lit(home)).alias("path")
    )


def step_identities(jobs: DataFrame, edges: DataFrame, home: str = "/root") -> DataFrame:
    """(job_id, step_identity) from normalised inputs and outputs; repeated paths count.

    The paths of a side are digested from mergeable sums, so jobs with any number of files are
    identified alike. A job without files is identified by its script or command.
    """
    identities = normal_edges(edges, home).groupBy("job_id").agg(
        *[multiset_digest(F.when(F.col("direction") == side, F.col("path"))).alias(side) for side in ("in", "out")]
    ).select("job_id", F.sha2(F.concat_ws("|", F.lit("FILES"), "in", "out"), 256).alias("step_identity"))
    own = F.sha2(F.concat(F.lit("COMMAND:"), F.coalesce(primary_script(F.col("command")), "command")), 256)
    return jobs.select(F.col("id").alias("job_id"), "command").join(identities, "job_id", "left").select(
        "job_id", F.coalesce("step_identity", own).alias("step_identity")
    )


def number_steps(runs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(session_id, step_identity, step_number): equal identities share a number, new ones follow.

    ``runs`` has (session_id, job_id, timestamp, step_identity); ``known`` keeps the numbers stored
    earlier. New identities count on from the session's highest number in order of first sight.
    """
    key = ["session_id", "step_identity"]
    first = runs.groupBy(*key).agg(F.min(F.struct("timestamp", "job_id")).alias("first"))
    fresh = first if known is None else first.join(known, key, "left_anti")
    flat = fresh.select(*key, "first.timestamp", "first.job_id")
    ranked = running_rank(flat, ["session_id"], [F.col("timestamp"), F.col("job_id")], "nth")
    if known is None:
        return ranked.select(*key, F.col("nth").cast("int").alias("step_number"))
    top = known.groupBy("session_id").agg(F.max("step_number").alias("top"))
    numbered = ranked.join(top, "session_id", "left").select(
        *key, (F.coalesce("top", F.lit(0)) + F.col("nth")).cast("int").alias("step_number")
    )
    return known.select(*key, "step_number").unionByName(numbered)


def hashable_files(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Only files that exist."""
    return files.join(inventory.select("path").distinct(), "path", "left_semi")


def _resolve(sightings: DataFrame, existing: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(sighting_id, label) and, of stored artifacts, (artifact_id, label, seen); both written."""
    names = ["homes"] if existing is None else ["homes", "held"]
    homes, *held = settled(sightings.sparkSession, lambda: _labelled(sightings, existing), *names)
    return homes, held[0] if held else None


def _labelled(sightings: DataFrame, existing: DataFrame | None) -> list[DataFrame]:
    key = F.concat_ws(":", "algorithm", F.lower("digest"))
    seen = materialize(sightings.select("sighting_id", key.alias("k")).distinct(), "sightings")
    links = materialize(seen.groupBy("sighting_id").agg(F.min("k").alias("home"), F.max("k").alias("last")), "links")
    pairs = seen.join(links.where(F.col("home") != F.col("last")), "sighting_id").select(
        F.col("home").alias("a"), F.col("k").alias("b")
    )
    stored = None
    if existing is not None:
        # Only stored artifacts that share a digest with the sightings can matter, with all their digests.
        at = F.col("first_seen_at") if "first_seen_at" in existing.columns else F.lit(0.0)
        keyed = existing.select("artifact_id", key.alias("k"), at.cast("double").alias("seen"))
        touched = keyed.join(seen.select("k").distinct(), "k", "left_semi").select("artifact_id").distinct()
        stored = materialize(keyed.join(touched, "artifact_id", "left_semi"), "touched-artifacts")
        heads = stored.groupBy("artifact_id").agg(F.min("k").alias("home"))
        pairs = pairs.unionByName(stored.join(heads, "artifact_id").select(F.col("home").alias("a"), F.col("k").alias("b")))
    labels = component_labels(pairs)
    homes = links.select("sighting_id", F.col("home").alias("node")).join(labels, "node", "left").select(
        "sighting_id", F.coalesce("label", "node").alias("label")
    )
    if stored is None:
        return [homes]
    held = stored.withColumnRenamed("k", "node").join(labels, "node", "left").groupBy("artifact_id").agg(
        F.min(F.coalesce("label", "node")).alias("label"), F.min("seen").alias("seen")
    )
    return [homes, held]


def resolve_artifacts(sightings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One artifact per set of sightings connected by equal digests.

    ``sightings`` has (sighting_id, algorithm, digest), ``existing`` the stored (artifact_id,
    algorithm, digest[, first_seen_at]). Gives (sighting_id, artifact_id, created). Where several stored
    artifacts turn out to be one, the earliest seen owns it. Copies of one file fold to one digest
    before the components are computed, so many copies cost nothing extra.
    """
    return _owned(*_resolve(sightings, existing))


def _owned(homes: DataFrame, held: DataFrame | None) -> DataFrame:
    made = F.left(F.sha2("label", 256), F.lit(32))
    if held is None:
        return homes.select("sighting_id", made.alias("artifact_id"), F.lit(True).alias("created"))
    owners = held.groupBy("label").agg(F.min_by("artifact_id", F.struct("seen", "artifact_id")).alias("owner"))
    return homes.join(owners, "label", "left").select(
        "sighting_id", F.coalesce("owner", made).alias("artifact_id"), F.col("owner").isNull().alias("created")
    )


def _merged(held: DataFrame) -> DataFrame:
    """(artifact_id, owner) of stored artifacts that have become part of an earlier one."""
    owners = held.groupBy("label").agg(F.min_by("artifact_id", F.struct("seen", "artifact_id")).alias("owner"))
    return held.join(owners, "label").where(F.col("artifact_id") != F.col("owner")).select("artifact_id", "owner")


def first_sightings(sightings: DataFrame) -> DataFrame:
    """First time and path of every artifact; ``sightings`` has (artifact_id, timestamp, job_id, path, size)."""
    first = F.min(F.struct("timestamp", "job_id", "path"))
    return sightings.groupBy("artifact_id").agg(first.alias("first"), F.max("size").alias("size")).select(
        F.col("artifact_id").alias("id"), "size",
        F.col("first.timestamp").alias("first_seen_at"), F.col("first.path").alias("first_seen_path"),
    )


def new_edges(edges: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges once per (job, artifact, path), without those already stored."""
    key = ["job_id", "artifact_id", "path"]
    fresh = edges.select(*key).distinct()
    return fresh if existing is None else fresh.join(existing.select(*key), key, "left_anti")


def link_artifacts(links: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested links with ``linked``: false where the edge is there already."""
    key = ["job_id", "artifact_id", "path"]
    stored = existing.select(*key).distinct().withColumn("stored", F.lit(True))
    return links.select(*key).distinct().join(stored, key, "left").select(*key, F.col("stored").isNull().alias("linked"))


def job_rows(runs: DataFrame) -> DataFrame:
    """Job rows with script, id and uid; both ids derive from what the run is."""
    natural = F.concat_ws("\0", F.col("session_id").cast("string"), F.col("timestamp").cast("string"), "run_id", "command")
    full = F.sha2(natural, 256)
    return runs.withColumn("script", primary_script(F.col("command"))).withColumn("id", full).withColumn(
        "job_uid", F.left(full, F.lit(12))
    )


def duplicate_uids(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_uid").agg(F.count(F.lit(1)).alias("jobs")).where(F.col("jobs") > 1)


def session_commit_range(jobs: DataFrame) -> DataFrame:
    """First and last commit of every session, jobs without a commit left out."""
    known = jobs.where(F.col("git_commit").isNotNull() & F.col("session_id").isNotNull())
    at = F.struct("timestamp", "id")
    return known.groupBy("session_id").agg(
        F.min_by("git_commit", at).alias("git_commit_start"), F.max_by("git_commit", at).alias("git_commit_end")
    )


def session_current_step(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.max_by("step_number", F.struct("timestamp", "id")).alias("current_step")
    )


def active_flags(sessions: DataFrame) -> DataFrame:
    """One active session per project: the one activated last. ``sessions`` has (id, git_repo, activated_at)."""
    chosen = latest(sessions, ["git_repo"], newest("activated_at")).select("id", F.lit(True).alias("chosen"))
    return sessions.drop("is_active").join(chosen, "id", "left").select(
        *[c for c in sessions.columns if c != "is_active"], F.coalesce("chosen", F.lit(False)).alias("is_active")
    )


def assemble_metadata(runs: DataFrame) -> DataFrame:
    """Job metadata as JSON text; empty parts are left out.

    Uses the columns among packages, runtime, analysis, git, cwd and env_vars that are there.
    """
    parts = []
    for name in ("packages", "runtime", "analysis", "git", "cwd", "env_vars"):
        if name not in runs.columns:
            continue
        value = F.col(name)
        kind = runs.schema[name].dataType.typeName()
        if kind in ("map", "array"):
            value = F.when(F.size(value) > 0, value)
        elif kind == "string":
            value = F.nullif(value, F.lit(""))
        parts.append(value.alias(name))
    text = F.to_json(F.struct(*parts))
    return runs.withColumn("metadata", F.when(text != "{}", text))


def without_build_io(edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """Build jobs are recorded without inputs and outputs."""
    builds = jobs.where(F.col("job_type") == "build").select(F.col("id").alias("job_id"))
    return edges.join(builds, "job_id", "left_anti")


def pending_jobs(documents: DataFrame) -> DataFrame:
    """Jobs of remote pipeline documents as pending steps of a new session.

    ``documents`` has (source_artifact_hash, git_repo, git_commit, jobs array<struct<command,
    step_number, git_repo, git_commit, job_type>>).
    """
    nothing = F.lit("")
    rows = documents.select(
        F.sha2(F.concat(F.lit("pulled:"), "source_artifact_hash"), 256).alias("session_hash"),
        "source_artifact_hash", F.col("git_repo").alias("doc_repo"), F.col("git_commit").alias("doc_commit"),
        F.posexplode("jobs").alias("position", "job"),
    )
    return rows.select(
        "session_hash", "source_artifact_hash", F.col("position").cast("bigint").alias("position"),
        F.coalesce("job.command", nothing).alias("command"),
        F.coalesce("job.step_number", F.lit(1)).alias("step_number"),
        F.coalesce(F.nullif("job.git_repo", nothing), "doc_repo").alias("git_repo"),
        F.coalesce(F.nullif("job.git_commit", nothing), "doc_commit").alias("git_commit"),
        F.col("job.job_type").alias("job_type"), F.lit("pending").alias("status"),
    )


@dataclass
class LineageTables:
    jobs: DataFrame
    artifacts: DataFrame
    artifact_hashes: DataFrame
    job_inputs: DataFrame
    job_outputs: DataFrame
    sessions: DataFrame
    # Stored artifacts that were found to be another: (artifact_id, owner). Only after appending.
    merged: DataFrame | None = None


def _as_stored(df: DataFrame, table: str) -> DataFrame:
    """The columns of a stored table in its types; what is not known is null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LINEAGE[table].fields
    ])


def record_runs(
    runs: DataFrame, files: DataFrame, digests: DataFrame, home: str = "/root", stored: LineageTables | None = None
) -> LineageTables:
    """Lineage tables from run facts: those of the runs alone, or what a batch adds to ``stored``.

    ``runs``: (run_id, session_id, timestamp, command, repo_root, git_commit, job_type and, if known, other
    columns of jobs); ``files``: (run_id, direction, path); ``digests``: (path, run_id, algorithm,
    digest, size) of the files that could be hashed. Files without a digest are dropped.

    Appending reads the stored jobs of the batch's sessions and the stored artifacts that share a digest with
    it: step numbers, ids and artifacts go on from there. ``with_recording`` gives the tables
    after it. Runs must have ids that are not stored yet; jobs also keep ``run_id``.
    """
    text_ids = job_rows(runs)
    top = F.lit(0).cast("bigint")
    if stored is not None:
        top = F.lit(stored.jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]).cast("bigint")
    ranked = running_rank(text_ids.withColumn("_all", F.lit(0)), ["_all"], [F.col("timestamp"), F.col("run_id")], "_nth")
    jobs = materialize(ranked.withColumn("id", top + F.col("_nth")).drop("_all", "_nth"), "jobs")
    keys = jobs.select(F.col("id").alias("job_id"), "run_id", "session_id", "timestamp", "repo_root", "job_type")
    edges = files.join(digests.select("run_id", "path").distinct(), ["run_id", "path"], "left_semi").join(keys, "run_id")
    edges = materialize(edges.where(F.coalesce("job_type", F.lit("run")) != "build"), "edges")
    # Only files that some recorded run uses become artifacts.
    digests = digests.join(edges.select("run_id", "path").distinct(), ["run_id", "path"], "left_semi")
    identities = step_identities(jobs, edges, home)
    numbered = jobs.withColumnRenamed("id", "job_id").join(identities, "job_id")
    mine = None
    if stored is not None:
        mine = stored.jobs.join(jobs.select("session_id").distinct(), "session_id", "left_semi")
    known = None if mine is None else mine.where("step_identity is not null").groupBy("session_id", "step_identity").agg(
        F.min("step_number").alias("step_number"))
    numbers = number_steps(numbered.select("session_id", "job_id", "timestamp", "step_identity"), known)
    stepped = materialize(
        numbered.join(numbers, ["session_id", "step_identity"]).withColumnRenamed("job_id", "id"), "steps"
    )
    sighting = F.concat_ws("\0", "run_id", "path")
    sights = digests.select(sighting.alias("sighting_id"), "algorithm", F.lower("digest").alias("digest"))
    existing = None
    if stored is not None:
        first = stored.artifacts.select(F.col("id").alias("artifact_id"), "first_seen_at")
        existing = stored.artifact_hashes.join(first, "artifact_id", "left")
    homes, held = _resolve(sights, existing)
    owners = materialize(_owned(homes, held), "owners")
    merged = None if held is None else materialize(_merged(held), "merged")
    placed = edges.withColumn("sighting_id", sighting).join(owners, "sighting_id")
    sizes = digests.groupBy("run_id", "path").agg(F.max("size").alias("size"))
    created = placed.where("created").join(sizes, ["run_id", "path"])
    hashes = sights.join(owners, "sighting_id").select("artifact_id", "algorithm", "digest").distinct()
    if stored is not None:
        hashes = hashes.join(stored.artifact_hashes, ["artifact_id", "algorithm", "digest"], "left_anti")
    new_jobs = _as_stored(stepped, "jobs")
    every = new_jobs if mine is None else new_jobs.unionByName(mine.select(*new_jobs.columns))
    sessions = session_commit_range(every).join(session_current_step(every), "session_id", "full").join(
        every.groupBy("session_id").agg(F.min("timestamp").alias("created_at"), F.max_by("git_repo", F.struct("timestamp", "id")).alias("git_repo")),
        "session_id", "left",
    ).withColumnRenamed("session_id", "id").withColumn("hash", F.sha2(F.concat(F.lit("session:"), F.col("id")), 256)).withColumn("is_active", F.lit(False))
    if stored is not None:
        old = stored.sessions.select("id", F.col("hash").alias("_hash"), F.col("is_active").alias("_active"), F.col("created_at").alias("_at"))
        sessions = sessions.join(old, "id", "left").withColumns({
            "hash": F.coalesce("_hash", "hash"), "is_active": F.coalesce("_active", "is_active"), "created_at": F.coalesce("_at", "created_at")})
    return LineageTables(
        jobs=new_jobs.join(stepped.select("id", "run_id"), "id"),
        artifacts=_as_stored(first_sightings(created), "artifacts"),
        artifact_hashes=hashes,
        job_inputs=new_edges(placed.where(F.col("direction") == "in")),
        job_outputs=new_edges(placed.where(F.col("direction") == "out")),
        sessions=_as_stored(sessions, "sessions"),
        merged=merged,
    )


def with_recording(stored: LineageTables, made: LineageTables) -> LineageTables:
    """The stored tables after a batch: rows added, sessions replaced, edges of merged artifacts re-pointed."""
    renamed = made.merged

    def repointed(df: DataFrame, column: str = "artifact_id") -> DataFrame:
        if renamed is None:
            return df
        names = renamed.select(F.col("artifact_id").alias(column), "owner")
        moved = df.join(names, column, "left").withColumn(column, F.coalesce("owner", column))
        return moved.select(*df.columns).distinct()

    artifacts = stored.artifacts
    if renamed is not None:
        artifacts = artifacts.join(renamed.select(F.col("artifact_id").alias("id")), "id", "left_anti")
    return LineageTables(
        jobs=stored.jobs.select(*made.jobs.columns).unionByName(made.jobs),
        artifacts=artifacts.select(*made.artifacts.columns).unionByName(made.artifacts),
        artifact_hashes=repointed(stored.artifact_hashes.select(*made.artifact_hashes.columns)).unionByName(made.artifact_hashes),
        job_inputs=repointed(stored.job_inputs).unionByName(made.job_inputs),
        job_outputs=repointed(stored.job_outputs).unionByName(made.job_outputs),
        sessions=stored.sessions.join(made.sessions.select("id"), "id", "left_anti").select(*made.sessions.columns).unionByName(made.sessions),
    )
