"""Upstream closures over the artifact-job graph, for many targets at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.edges import artifact_facts, joined_facts, newest, primary_digests, with_facts
from strandline.scale import bucketed, latest, materialize, materialize_counted, multiset_digest, running_rank, settled


def producers(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The one producer of every artifact, its latest job; written, as closures read it every round."""
    made = outputs.select("artifact_id", "job_id").join(
        jobs.select(F.col("id").alias("job_id"), "timestamp"), "job_id"
    )
    return materialize(latest(made, ["artifact_id"], newest(key="job_id")), "producers")


WORDS = 8  # bitmap columns of 64 classes each


@dataclass
class Ancestors:
    """Upstream jobs of many groups of targets. ``members``: (group columns, class); groups whose targets come from the
    same jobs share a class. ``bitmaps``: (chunk, job_id, depth, b0, b1, …), a bit for each class of the chunk that
    has the job at that least depth."""

    members: DataFrame
    bitmaps: DataFrame
    words: int

    def jobs(self) -> DataFrame:
        """(class, job_id, depth), a row for every bit."""
        bits = [F.expr(f"transform(filter(sequence(0, 63), x -> getbit(b{w}, x) = 1), x -> x + {64 * w})") for w in range(self.words)]
        held = [F.when(F.col(f"b{w}") == 0, F.array().cast("array<int>")).otherwise(bits[w]) for w in range(self.words)]
        return self.bitmaps.select("chunk", "job_id", "depth", F.explode(F.concat(*held)).alias("_bit")).select(
            (F.col("chunk") * (64 * self.words) + F.col("_bit")).alias("class"), "job_id", "depth"
        )


def _classes(seeds: DataFrame, group: list[str], inputs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(group columns, class), (class, job_id) and the number of classes of ``seeds`` (group columns, job_id)."""
    if not group:
        one = F.lit(0).cast("bigint").alias("class")
        return seeds.select(one).limit(1), seeds.select(one, "job_id").distinct(), 1
    signature = multiset_digest(F.col("job_id").cast("string"))
    signed = materialize(seeds.groupBy(*group).agg(signature.alias("_signature"), F.min("job_id").alias("_lead")), "target-groups")
    # Jobs that read the same files have the same ancestors: their classes get neighbouring numbers.
    least = inputs.groupBy(F.col("job_id").alias("_lead")).agg(F.min("artifact_id").alias("_least"))
    named = signed.select("_signature", "_lead").distinct().join(least, "_lead", "left")
    ranked = running_rank(named, [], [F.col("_least"), F.col("_lead"), F.col("_signature")], "class")
    ranked, count = materialize_counted(ranked.select("_signature", (F.col("class") - 1).alias("class")), "classes")
    members = signed.join(ranked, "_signature").select(*group, "class")
    lead = ranked.join(signed.groupBy("_signature").agg(F.min(F.struct(*group)).alias("_group")), "_signature")
    jobs = lead.select("class", *[F.col(f"_group.{c}").alias(c) for c in group]).join(seeds, group).select("class", "job_id")
    return members, jobs, count


def ancestors(targets: DataFrame, made_by: DataFrame, inputs: DataFrame, max_depth: int) -> Ancestors:
    """Jobs upstream of ``targets`` (group columns, artifact_id), each with its least depth; makers of targets have 0.

    All classes of a chunk advance together: a round joins the frontier with the jobs that its jobs read from and
    combines their bitmaps before the shuffle, so its rows grow with the edges and not with targets times
    ancestors. Those edges are written once, bucketed by job, and are not shuffled again. A cycle
    ends where no new bit is set.
    """
    spark = targets.sparkSession
    group = [c for c in targets.columns if c != "artifact_id"]
    made = made_by.select("artifact_id", "job_id")
    seeds = materialize(targets.join(made, "artifact_id").select(*group, "job_id").distinct(), "seeds")
    members, jobs, count = _classes(seeds, group, inputs)
    words = max(1, min(WORDS, -(-count // 64)))
    bits = [f"b{w}" for w in range(words)]
    steps = inputs.select("job_id", "artifact_id").join(made.withColumnRenamed("job_id", "_from"), "artifact_id").select("job_id", "_from").distinct()
    with bucketed(steps, "job_id", "steps") as steps:
        own = F.expr(f"shiftleft(1L, cast(class % 64 as int))")
        word = F.expr(f"class % {64 * words} div 64")
        start = jobs.groupBy(F.floor(F.col("class") / (64 * words)).alias("chunk"), "job_id").agg(
            *[F.bit_or(F.when(word == w, own).otherwise(F.lit(0).cast("bigint"))).alias(b) for w, b in enumerate(bits)]
        )
        frontier = materialize(start.withColumn("depth", F.lit(0)), "frontier")
        visited = frontier
        for depth in range(1, max_depth + 1):
            reached = frontier.join(steps, "job_id").groupBy("chunk", F.col("_from").alias("job_id")).agg(*[F.bit_or(b).alias(b) for b in bits])
            known = visited.groupBy("chunk", "job_id").agg(*[F.bit_or(b).alias(f"_{b}") for b in bits])
            fresh = [F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(F.col(f"_{b}"), F.lit(0).cast("bigint")))).alias(b) for b in bits]
            found = reached.join(known, ["chunk", "job_id"], "left").select("chunk", "job_id", *fresh, F.lit(depth).alias("depth"))
            frontier, rows = materialize_counted(found.where(reduce(or_, [F.col(b) != 0 for b in bits])), "frontier")
            if not rows:
                break
            visited = visited.unionByName(frontier)
    return Ancestors(members, visited, words)


def closure(targets: DataFrame, made_by: DataFrame, inputs: DataFrame, max_depth: int) -> DataFrame:
    """Artifacts upstream of ``targets`` with their least depth.

    ``targets`` has ``artifact_id`` and any grouping columns; every group has its own visited set.
    ``made_by`` comes from ``producers``. What the targets of a class have in common is found once and then
    listed for each of them.
    """
    group = [c for c in targets.columns if c != "artifact_id"]
    node = [*group, "artifact_id"]
    own = targets.select(*node).distinct()

    def upstream_of_classes() -> tuple[DataFrame, DataFrame]:
        found = ancestors(targets, made_by, inputs, max_depth)
        read = found.jobs().where(F.col("depth") < max_depth).join(inputs.select("job_id", "artifact_id"), "job_id")
        return found.members, read.groupBy("class", "artifact_id").agg((F.min("depth") + 1).alias("depth"))

    members, shared = settled(targets.sparkSession, upstream_of_classes, "members", "closure")
    upstream = members.join(shared, "class").select(*node, "depth").join(own, node, "left_anti")
    return own.withColumn("depth", F.lit(0)).unionByName(upstream)


def artifact_tree(
    targets: DataFrame, made_by: DataFrame, inputs: DataFrame, artifacts: DataFrame, depth: int = 3
) -> DataFrame:
    """The lineage tree as rows; what lies one level past the depth is listed as truncated."""
    nodes = closure(targets, made_by, inputs, depth + 1)
    known = artifacts.select(F.col("id").alias("artifact_id"), F.lit(True).alias("known"))
    parents = made_by.select("artifact_id", F.col("job_id").alias("parent_job"))
    truncated = F.col("depth") > depth
    return (
        nodes.join(known, "artifact_id", "left")
        .join(parents, "artifact_id", "left")
        .select(
            *[c for c in targets.columns if c != "artifact_id"],
            "artifact_id",
            F.when(~truncated, F.col("parent_job")).alias("parent_job"),
            "depth",
            truncated.alias("truncated"),
            (F.col("known").isNull() & ~truncated).alias("not_found"),
        )
    )


def closure_jobs(nodes: DataFrame, made_by: DataFrame) -> DataFrame:
    """Distinct producer jobs of a closure, per group."""
    group = [c for c in nodes.columns if c not in ("artifact_id", "depth")]
    return nodes.join(made_by.select("artifact_id", "job_id"), "artifact_id").select(*group, "job_id").distinct()


def lineage_jobs(
    targets: DataFrame, jobs: DataFrame, made_by: DataFrame, inputs: DataFrame, max_depth: int = 10
) -> DataFrame:
    """Every job needed to make the targets, with its facts."""
    needed = closure_jobs(closure(targets, made_by, inputs, max_depth), made_by)
    return needed.join(jobs.withColumnRenamed("id", "job_id"), "job_id")


def job_links(
    job_ids: DataFrame, inputs: DataFrame, outputs: DataFrame, artifacts: DataFrame, hashes: DataFrame
) -> DataFrame:
    """Inputs and outputs of the given jobs as rows, so that a job with many files stays split."""
    edges = inputs.withColumn("direction", F.lit("in")).unionByName(
        outputs.withColumn("direction", F.lit("out"))
    )
    return with_facts(edges, artifacts, hashes).join(job_ids, "job_id")


def filtered_lineage(
    targets: DataFrame,
    made_by: DataFrame,
    inputs: DataFrame,
    outputs: DataFrame,
    artifacts: DataFrame,
    hashes: DataFrame,
    max_depth: int = 10,
) -> DataFrame:
    """Links of the lineage jobs: all inputs, but only outputs on the way to the target."""
    spark = targets.sparkSession
    group = [c for c in targets.columns if c != "artifact_id"]

    def jobs_of_classes() -> tuple[DataFrame, DataFrame]:
        found = ancestors(targets, made_by, inputs, max_depth)
        return found.members, found.jobs().select("class", "job_id")

    members, needed = settled(spark, jobs_of_classes, "members", "lineage_jobs")
    cols = ["job_id", "artifact_id", "path"]

    def links_of_classes() -> tuple[DataFrame, DataFrame]:
        facts = materialize(artifact_facts(artifacts, hashes), "facts")
        read = materialize(inputs.select(*cols).join(needed, "job_id"), "read")
        on_path = read.select("class", "artifact_id").distinct()
        made = outputs.select(*cols).join(needed, "job_id").join(on_path, ["class", "artifact_id"], "left_semi")
        shared = read.withColumn("direction", F.lit("in")).unionByName(made.withColumn("direction", F.lit("out")))
        # The targets themselves, where no job on the way reads them.
        ends = targets.join(members, group) if group else targets.crossJoin(members)
        last = outputs.select(*cols).join(ends, "artifact_id").join(needed, ["class", "job_id"]).join(on_path, ["class", "artifact_id"], "left_anti")
        return joined_facts(shared, facts), joined_facts(last.drop("class").withColumn("direction", F.lit("out")), facts)

    shared, last = settled(spark, links_of_classes, "class_links", "target_links")
    return members.join(shared, "class").drop("class").unionByName(last)


def lineage_report(targets: DataFrame, links: DataFrame, jobs: DataFrame, artifacts: DataFrame, hashes: DataFrame) -> DataFrame:
    """Report rows per target: ``target``, ``job`` and ``artifact`` (each digest once).

    ``targets`` has columns (target, artifact_id); ``links`` comes from ``filtered_lineage``.
    """
    facts = artifacts.select(F.col("id").alias("artifact_id"), "size", "first_seen_path").join(
        primary_digests(hashes), "artifact_id"
    )
    target_rows = materialize(
        targets.join(facts, "artifact_id").select("target", "digest", F.col("first_seen_path").alias("path"), "size"), "target_rows"
    )
    job_rows = links.select("target", "job_id").distinct().join(
        jobs.select(F.col("id").alias("job_id"), "job_uid", "command", "timestamp"), "job_id"
    )
    seen = links.where(F.col("digest").isNotNull()).select("target", "digest", "path", "size")
    by_digest = materialize(
        seen.groupBy("target", "digest").agg(F.min(F.struct("path", "size")).alias("f")).select("target", "digest", "f.path", "f.size"),
        "target_digests",
    )
    appended = target_rows.join(by_digest, ["target", "digest"], "left_anti")
    empty = F.lit(None)
    shape = {
        "kind": empty.cast("string"), "job_uid": empty.cast("string"), "command": empty.cast("string"),
        "timestamp": empty.cast("bigint"), "digest": empty.cast("string"), "path": empty.cast("string"),
        "size": empty.cast("bigint"),
    }

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            "target", F.lit(kind).alias("kind"),
            *[(F.col(c) if c in df.columns else v).alias(c) for c, v in shape.items() if c != "kind"],
        )

    return (
        rows(target_rows, "target")
        .unionByName(rows(job_rows, "job"))
        .unionByName(rows(by_digest.unionByName(appended), "artifact"))
    )


def external_inputs(nodes: DataFrame, made_by: DataFrame) -> DataFrame:
    """Artifacts of a closure that no job made."""
    return nodes.join(made_by, "artifact_id", "left_anti")


def latest_builds(jobs: DataFrame) -> DataFrame:
    """The build job with the greatest id of every (session, step)."""
    builds = jobs.where(F.col("job_type") == "build").groupBy("session_id", "step_number").agg(
        F.max("id").alias("job_id")
    )
    return builds


def io_signatures(
    job_ids: DataFrame, jobs: DataFrame, inputs: DataFrame, outputs: DataFrame, hashes: DataFrame, algorithm: str | None = None
) -> DataFrame:
    """(job_id, signature): equal for jobs with equal input and output digests of the primary ``algorithm``.

    Jobs without digests get a signature of their own. The digests of a job are summed, not
    listed, so a job with any number of files stays distributed.
    """
    digests = primary_digests(hashes, algorithm, strict=True)
    edges = inputs.select("job_id", "artifact_id", F.lit("in").alias("direction")).unionByName(
        outputs.select("job_id", "artifact_id", F.lit("out").alias("direction"))
    ).join(job_ids.select("job_id").distinct(), "job_id", "left_semi")
    summed = edges.join(digests, "artifact_id").groupBy("job_id").agg(
        F.concat_ws(
            "|",
            multiset_digest(F.when(F.col("direction") == "in", F.col("digest"))),
            multiset_digest(F.when(F.col("direction") == "out", F.col("digest"))),
        ).alias("io")
    )
    uids = jobs.select(F.col("id").alias("job_id"), "job_uid")
    own = F.concat(F.lit("unique:"), F.coalesce("job_uid", F.col("job_id").cast("string")))
    return job_ids.select("job_id").distinct().join(uids, "job_id").join(summed, "job_id", "left").select(
        "job_id", F.coalesce("io", own).alias("signature")
    )


def drop_reruns(candidates: DataFrame, signatures: DataFrame) -> DataFrame:
    """Keep the latest job per (group, signature); the earlier listed one (least id) wins a tie."""
    return latest(
        candidates.join(signatures, "job_id"),
        ["group_id", "signature"],
        [F.col("timestamp").desc(), F.col("job_id").asc()],
    )


def collect_lineage(
    targets: DataFrame, jobs: DataFrame, inputs: DataFrame, outputs: DataFrame, hashes: DataFrame, max_depth: int = 10,
    algorithm: str | None = None,
) -> DataFrame:
    """Jobs to register per group: lineage of its targets and its session's builds, re-runs dropped.

    ``targets`` has (group_id, artifact_id); a group is the session it registers.
    """
    made_by = producers(jobs, outputs)
    needed = closure_jobs(closure(targets, made_by, inputs, max_depth), made_by)
    builds = latest_builds(jobs).select(F.col("session_id").alias("group_id"), "job_id").join(
        targets.select("group_id").distinct(), "group_id", "left_semi"
    )
    listed = materialize(needed.unionByName(builds).distinct(), "collected")
    timed = listed.join(jobs.select(F.col("id").alias("job_id"), "timestamp"), "job_id")
    return drop_reruns(timed, io_signatures(listed, jobs, inputs, outputs, hashes, algorithm)).select(
        "group_id", "job_id", "timestamp"
    )


def referenced_digests(
    job_ids: DataFrame, inputs: DataFrame, outputs: DataFrame, hashes: DataFrame, algorithm: str | None = None
) -> DataFrame:
    """Distinct digests of the primary ``algorithm`` that a job set reads or writes, per group."""
    edges = inputs.select("job_id", "artifact_id").unionByName(outputs.select("job_id", "artifact_id"))
    return (
        edges.join(job_ids.select("group_id", "job_id"), "job_id")
        .select("group_id", "artifact_id")
        .distinct()
        .join(primary_digests(hashes, algorithm, strict=True), "artifact_id")
        .select("group_id", "digest")
        .distinct()
    )
