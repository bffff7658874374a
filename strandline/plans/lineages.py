"""Queries over upstream lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import lineage as L
from strandline.plans.registry import query
from strandline.plans.session_graphs import graph
from strandline.sources.derived import World, duckdb_query

PRODUCERS = """producers as (
  select o.artifact_id, o.job_id, j.timestamp from (select distinct artifact_id, job_id from job_outputs) o
  join jobs j on j.id = o.job_id
  qualify row_number() over (partition by o.artifact_id order by j.timestamp desc, j.id desc) = 1)"""
# Every artifact to every artifact its producer read.
STEPS = """steps as (
  select distinct p.artifact_id, i.artifact_id as parent from producers p join job_inputs i on i.job_id = p.job_id)"""


def _walk(targets: str, depth: int) -> tuple[str, ...]:
    """CTEs for the closure of every row of ``targets`` (target, artifact_id) with least depth."""
    return (
        f"""walk as (
  select target, artifact_id, 0 as depth from ({targets})
  union
  select w.target, s.parent, w.depth + 1 from walk w join steps s using (artifact_id) where w.depth < {depth})""",
        "nodes as (select target, artifact_id, min(depth) as depth from walk group by all)",
    )


EVERY_OUTPUT = "select distinct artifact_id as target, artifact_id from job_outputs"
# One group: everything any session produced.
ONE_GROUP = "select distinct 1 as target, artifact_id from job_outputs"
EVERY_ARTIFACT = "select id as target, id as artifact_id from artifacts"


def _targets(w: World):
    return w.outputs.select("artifact_id").distinct().withColumn("target", F.col("artifact_id"))


def _made_by(w: World):
    return L.producers(w.jobs, w.outputs)


@query("artifact_producers", "F0", duckdb_query("select artifact_id, job_id from producers", PRODUCERS))
def _(w):
    return _made_by(w).select("artifact_id", "job_id")


@query("artifact_lineage_tree", "F1", duckdb_query("""
select n.target, n.artifact_id, case when n.depth <= 3 then p.job_id end as parent_job, n.depth,
       n.depth > 3 as truncated, a.id is null and n.depth <= 3 as not_found
from nodes n left join producers p using (artifact_id) left join artifacts a on a.id = n.artifact_id""",
    PRODUCERS, STEPS, *_walk(EVERY_OUTPUT, 4)))
def _(w):
    return L.artifact_tree(_targets(w), _made_by(w), w.inputs, w.artifacts)


@query("lineage_jobs", "F2", duckdb_query("""
select distinct j.id as job_id, j.timestamp, j.command from nodes n join producers p using (artifact_id) join jobs j on j.id = p.job_id""",
    PRODUCERS, STEPS, *_walk(ONE_GROUP, 10)))
def _(w):
    return L.lineage_jobs(
        w.outputs.select("artifact_id").distinct(), w.jobs, _made_by(w), w.inputs
    ).select("job_id", "timestamp", "command")


@query("lineage_job_links", "F2 D14", duckdb_query("""
select e.job_id, e.direction, e.artifact_id, e.path, a.size, a.id as digest
from (select *, 'in' as direction from job_inputs union all select *, 'out' from job_outputs) e
join artifacts a on a.id = e.artifact_id
where e.job_id in (select p.job_id from nodes n join producers p using (artifact_id))""",
    PRODUCERS, STEPS, *_walk(ONE_GROUP, 10)))
def _(w):
    made_by = _made_by(w)
    nodes = L.closure(w.outputs.select("artifact_id").distinct(), made_by, w.inputs, 10)
    return L.job_links(L.closure_jobs(nodes, made_by), w.inputs, w.outputs, w.artifacts, w.hashes)


FILTERED = (
    "tjobs as (select distinct n.target, p.job_id from nodes n join producers p using (artifact_id))",
    "tread as (select t.target, t.job_id, i.artifact_id, i.path from tjobs t join job_inputs i using (job_id))",
    "onpath as (select target, artifact_id from tread union select target, target from nodes)",
    """links as (
  select target, job_id, artifact_id, path, 'in' as direction from tread
  union all
  select t.target, t.job_id, o.artifact_id, o.path, 'out' from tjobs t join job_outputs o using (job_id)
  join onpath p on p.target = t.target and p.artifact_id = o.artifact_id)""",
)


@query("filtered_lineage", "F3", duckdb_query("""
select l.target, l.job_id, l.direction, l.artifact_id, l.path, a.size, a.id as digest
from links l join artifacts a on a.id = l.artifact_id""",
    PRODUCERS, STEPS, *_walk(EVERY_OUTPUT, 10), *FILTERED))
def _(w):
    return L.filtered_lineage(_targets(w), _made_by(w), w.inputs, w.outputs, w.artifacts, w.hashes)


@query("lineage_report", "F10", duckdb_query("""
select target, 'target' as kind, null as job_uid, null as command, cast(null as bigint) as timestamp,
       target as digest, a.first_seen_path as path, a.size
from (select distinct target from nodes) n join artifacts a on a.id = n.target
union all
select t.target, 'job', j.job_uid, j.command, j.timestamp, null, null, null
from (select distinct target, job_id from links) t join jobs j on j.id = t.job_id
union all
select target, 'artifact', null, null, null, digest, path, size from (
  select l.target, l.artifact_id as digest, min(l.path) as path, any_value(a.size) as size
  from links l join artifacts a on a.id = l.artifact_id group by all)
union all
select n.target, 'artifact', null, null, null, n.target, a.first_seen_path, a.size
from (select distinct target from nodes) n join artifacts a on a.id = n.target
where not exists (select 1 from links l where l.target = n.target and l.artifact_id = n.target)""",
    PRODUCERS, STEPS, *_walk(EVERY_OUTPUT, 10), *FILTERED))
def _(w):
    targets = _targets(w)
    links = L.filtered_lineage(targets, _made_by(w), w.inputs, w.outputs, w.artifacts, w.hashes)
    return L.lineage_report(targets, links, w.jobs, w.artifacts, w.hashes)


BUILDS = "builds as (select session_id, step_number, max(id) as job_id from jobs where job_type = 'build' group by all)"


@query("latest_build_jobs", "F5", duckdb_query("select * from builds", BUILDS))
def _(w):
    return L.latest_builds(w.jobs)


# Signature as text: sorted digests of both sides.
SIGNATURES = """sigs as (
  select j.id as job_id, j.timestamp, j.session_id,
         case when i.d is null and o.d is null then 'unique:' || j.job_uid
              else coalesce(i.d, '') || '|' || coalesce(o.d, '') end as signature
  from jobs j
  left join (select job_id, string_agg(artifact_id, ',' order by artifact_id) as d from job_inputs group by all) i on i.job_id = j.id
  left join (select job_id, string_agg(artifact_id, ',' order by artifact_id) as d from job_outputs group by all) o on o.job_id = j.id)"""


@query("io_signature_classes", "F6", duckdb_query(
    "select min(job_id) as first_job, count(*) as runs from sigs group by signature", SIGNATURES))
def _(w):
    sigs = L.io_signatures(w.jobs.select(F.col("id").alias("job_id")), w.jobs, w.inputs, w.outputs, w.hashes)
    return sigs.groupBy("signature").agg(
        F.min("job_id").alias("first_job"), F.count(F.lit(1)).alias("runs")).drop("signature")


# The same digests stored under another algorithm only.
@query("io_signature_classes_md5", "F6 F8 D14", duckdb_query(
    "select min(job_id) as first_job, count(*) as runs from sigs group by signature", SIGNATURES))
def _(w):
    stored = w.hashes.where("algorithm = 'md5'")
    sigs = L.io_signatures(w.jobs.select(F.col("id").alias("job_id")), w.jobs, w.inputs, w.outputs, stored, "md5")
    return sigs.groupBy("signature").agg(
        F.min("job_id").alias("first_job"), F.count(F.lit(1)).alias("runs")).drop("signature")


@query("jobs_without_reruns", "F7", duckdb_query("""
select session_id as group_id, job_id, timestamp from sigs
qualify row_number() over (partition by session_id, signature order by timestamp desc, job_id) = 1""", SIGNATURES))
def _(w):
    listed = w.jobs.select(F.col("session_id").alias("group_id"), F.col("id").alias("job_id"), "timestamp")
    sigs = L.io_signatures(listed, w.jobs, w.inputs, w.outputs, w.hashes)
    return L.drop_reruns(listed, sigs).select("group_id", "job_id", "timestamp")


SESSION_OUTPUTS = "select distinct j.session_id as target, o.artifact_id from job_outputs o join jobs j on j.id = o.job_id"
COLLECTED = (
    BUILDS,
    SIGNATURES,
    """listed as (
  select distinct n.target as group_id, p.job_id from nodes n join producers p using (artifact_id)
  union
  select session_id, job_id from builds where session_id in (select target from nodes))""",
    """collected as (
  select l.group_id, l.job_id, s.timestamp from listed l join sigs s using (job_id)
  qualify row_number() over (partition by l.group_id, s.signature order by s.timestamp desc, l.job_id) = 1)""",
)


def session_outputs(w: World):
    return w.outputs.join(w.jobs.select(F.col("id").alias("job_id"), F.col("session_id").alias("group_id")), "job_id").select(
        "group_id", "artifact_id").distinct()


@query("registration_jobs", "F4 F5 F7", duckdb_query("select * from collected",
    PRODUCERS, STEPS, *_walk(SESSION_OUTPUTS, 10), *COLLECTED))
def _(w):
    return L.collect_lineage(session_outputs(w), w.jobs, w.inputs, w.outputs, w.hashes)


DIGESTS = """digests as (
  select distinct c.group_id, e.artifact_id as digest from collected c
  join (select * from job_inputs union all select * from job_outputs) e using (job_id))"""


@query("registration_digests", "F8", duckdb_query("select * from digests",
    PRODUCERS, STEPS, *_walk(SESSION_OUTPUTS, 10), *COLLECTED, DIGESTS))
def _(w):
    jobs = L.collect_lineage(session_outputs(w), w.jobs, w.inputs, w.outputs, w.hashes)
    return L.referenced_digests(jobs, w.inputs, w.outputs, w.hashes)


@query("registration_artifacts", "F4 F9", duckdb_query("""
select d.group_id, d.digest, a.id as artifact_id, a.size, a.first_seen_path
from digests d join artifacts a on a.id = d.digest""",
    PRODUCERS, STEPS, *_walk(SESSION_OUTPUTS, 10), *COLLECTED, DIGESTS))
def _(w):
    jobs = L.collect_lineage(session_outputs(w), w.jobs, w.inputs, w.outputs, w.hashes)
    digests = L.referenced_digests(jobs, w.inputs, w.outputs, w.hashes)
    owners = w.hashes.where(F.col("algorithm") == "sha256").select("digest", "artifact_id")
    facts = w.artifacts.select(F.col("id").alias("artifact_id"), "size", "first_seen_path")
    return digests.join(owners, "digest").join(facts, "artifact_id")


@query("external_inputs", "F11", duckdb_query("""
select n.target, n.artifact_id, n.depth from nodes n where n.artifact_id not in (select artifact_id from producers)""",
    PRODUCERS, STEPS, *_walk(EVERY_ARTIFACT, 10)))
def _(w):
    made_by = _made_by(w)
    targets = w.artifacts.select(F.col("id").alias("artifact_id"), F.col("id").alias("target"))
    return L.external_inputs(L.closure(targets, made_by, w.inputs, 10), made_by)


@query("lineage_levels", "F12", duckdb_query("""
select n.target, n.depth, n.artifact_id, p.job_id as parent_job
from nodes n left join producers p using (artifact_id)""", PRODUCERS, STEPS, *_walk(EVERY_OUTPUT, 10)))
def _(w):
    made_by = _made_by(w)
    return L.closure(_targets(w), made_by, w.inputs, 10).join(
        made_by.select("artifact_id", F.col("job_id").alias("parent_job")), "artifact_id", "left")
