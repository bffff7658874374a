"""Collections and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import collection_jobs as N
from strandline.operators import maintain as O
from strandline.operators.edges import primary_digests
from strandline.plans.registry import query
from strandline.sources.derived import duckdb_query


@query("added_members", "N1", duckdb_query("""
select concat('n', session_id % 25) as collection_id, artifact_id, cast(null as varchar) as child_collection_id, min(path) as path_in_collection
from io i where not exists (select 1 from collection_members m where m.collection_id = concat('n', i.session_id % 25) and m.artifact_id = i.artifact_id)
group by all"""))
def _(w):
    rows = w.io.selectExpr("concat('n', session_id % 25) as collection_id", "artifact_id", "cast(null as string) as child_collection_id", "path as path_in_collection")
    return N.add_members(rows, w.members)


@query("direct_members", "N2", duckdb_query("""
select m.collection_id, 'artifact' as kind, m.artifact_id as member_id, m.path_in_collection, a.size, a.id as label
from collection_members m join artifacts a on a.id = m.artifact_id
union all
select m.collection_id, 'collection', m.child_collection_id, m.path_in_collection, null, c.name
from collection_members m join collections c on c.id = m.child_collection_id"""))
def _(w):
    return N.direct_members(w.members, w.artifacts, w.collections, primary_digests(w.hashes))


NESTED = """nested as (
  select id as root, id as collection_id from collections
  union
  select n.root, m.child_collection_id from nested n join collection_members m on m.collection_id = n.collection_id
  where m.child_collection_id is not null)"""


@query("nested_artifacts", "N3", duckdb_query("""
select n.root, m.artifact_id, m.path_in_collection from nested n join collection_members m on m.collection_id = n.collection_id
where m.artifact_id is not null""", NESTED))
def _(w):
    return N.nested_artifacts(w.collections, w.members)


@query("nested_artifacts_distinct", "N3", duckdb_query("""
select distinct n.root, m.artifact_id from nested n join collection_members m on m.collection_id = n.collection_id
where m.artifact_id is not null""", NESTED))
def _(w):
    return N.nested_artifacts(w.collections, w.members, distinct=True)


@query("invalid_members", "N4", duckdb_query("""
select job_id, artifact_id, path as child_collection_id from (
  select job_id, case when dir = 'in' then artifact_id end as artifact_id, case when job_id % 2 = 0 then path end as path from io)
where (artifact_id is null) = (path is null)"""))
def _(w):
    rows = w.io.selectExpr("job_id", "case when dir = 'in' then artifact_id end as artifact_id", "case when job_id % 2 = 0 then path end as child_collection_id")
    return N.invalid_members(rows)


@query("artifact_uploads", "N5", duckdb_query("""
select artifact_id, concat('s3://b', job_id % 7) as url, min(timestamp) as first_ts from io group by all"""))
def _(w):
    return N.artifact_uploads(w.io.selectExpr("artifact_id", "concat('s3://b', job_id % 7) as url", "timestamp as ts"))


@query("collection_upload", "N5", duckdb_query("""
select concat('n', session_id % 25) as collection_id, arg_max(concat('s3://b', job_id % 7), (timestamp, concat('s3://b', job_id % 7))) as url from io group by all"""))
def _(w):
    return N.collection_upload(w.io.selectExpr("concat('n', session_id % 25) as collection_id", "concat('s3://b', job_id % 7) as url", "timestamp as ts"))


CACHE = """cache as (
  select h.artifact_id as path, h.algorithm, h.digest, a.size, cast(a.first_seen_at as double) + (a.size % 4) * 0.0004 as mtime,
         cast(a.first_seen_at + 86400 * (a.size % 60) as double) as cached_at
  from artifact_hashes h join artifacts a on a.id = h.artifact_id where h.algorithm = 'sha256' or a.size % 3 > 0),
inventory as (select id as path, size + (size % 5 = 0)::int as size, cast(first_seen_at as double) as mtime from artifacts),
valid as (select c.* from cache c join inventory i on i.path = c.path and i.size = c.size and abs(c.mtime - i.mtime) < 0.001)"""


def _cache(w):
    facts = w.artifacts.selectExpr("id as artifact_id", "size", "first_seen_at")
    return w.hashes.join(facts, "artifact_id").where("algorithm = 'sha256' or size % 3 > 0").selectExpr(
        "artifact_id as path", "algorithm", "digest", "size", "cast(first_seen_at as double) + (size % 4) * 0.0004d as mtime",
        "cast(first_seen_at + 86400 * (size % 60) as double) as cached_at")


def _inventory(w):
    return w.artifacts.selectExpr("id as path", "size + if(size % 5 = 0, 1, 0) as size", "cast(first_seen_at as double) as mtime")


@query("valid_cache", "O1", duckdb_query("select path, algorithm, digest from valid", CACHE))
def _(w):
    return O.valid_cache(_cache(w), _inventory(w)).select("path", "algorithm", "digest")


@query("missing_digests", "O2", duckdb_query("""
select a.id as path, g.algorithm from artifacts a, (values ('sha256'), ('md5'), ('sha512')) g(algorithm)
where not exists (select 1 from valid v where v.path = a.id and v.algorithm = g.algorithm)""", CACHE))
def _(w):
    wanted = w.artifacts.select(F.col("id").alias("path"), F.explode(F.array(*[F.lit(x) for x in ("sha256", "md5", "sha512")])).alias("algorithm"))
    return O.missing_digests(wanted, _cache(w), _inventory(w))


@query("upserted_cache", "O3", duckdb_query("""
select path, algorithm, digest, size, cached_at from (select path, algorithm, digest, size, cached_at from cache
  union all select artifact_id, 'sha256', md5(path), max(bytes), cast(timestamp + 86400 * 30 as double) from io group by artifact_id, path, timestamp)
qualify row_number() over (partition by path, algorithm order by cached_at desc, digest desc) = 1""", CACHE))
def _(w):
    # Two sightings may agree in time and digest but not in size.
    fresh = w.io.groupBy(F.col("artifact_id").alias("path"), F.md5("path").alias("digest"), "timestamp").agg(F.max("bytes").alias("size")).selectExpr(
        "path", "'sha256' as algorithm", "digest", "size", "cast(timestamp as double) as mtime", "cast(timestamp + 86400 * 30 as double) as cached_at")
    return O.upsert_cache(_cache(w), fresh).select("path", "algorithm", "digest", "size", "cached_at")


@query("invalidated_cache", "O4", duckdb_query("""
select path, algorithm from cache c where not exists (select 1 from artifacts a where a.id = c.path and (a.size % 7 = 0 or (a.size % 7 = 1 and c.algorithm = 'md5')))""", CACHE))
def _(w):
    targets = w.artifacts.where("size % 7 < 2").selectExpr("id as path", "if(size % 7 = 0, null, 'md5') as algorithm")
    return O.invalidate_cache(_cache(w), targets).select("path", "algorithm")


@query("evicted_cache", "O4", duckdb_query("select path, algorithm, cached_at from cache where cached_at >= 904608000 - 30 * 86400", CACHE))
def _(w):
    return O.evict_cache(_cache(w), 904608000.0).select("path", "algorithm", "cached_at")


@query("remaining_edges", "O5", duckdb_query("select i.* from job_inputs i join jobs j on j.id = i.job_id where j.exit_code is distinct from 0"))
def _(w):
    return O.delete_jobs(w.jobs.where("exit_code = 0").select(F.col("id").alias("job_id")), w.inputs)


@query("remaining_jobs", "O5", duckdb_query("select id, command from jobs where exit_code is distinct from 0"))
def _(w):
    return O.delete_jobs(w.jobs.where("exit_code = 0").select(F.col("id").alias("job_id")), w.jobs, "id").select("id", "command")


@query("orphaned_artifacts", "O6", duckdb_query("""
select id as artifact_id from artifacts
where id not in (select i.artifact_id from job_inputs i join jobs j on j.id = i.job_id where j.exit_code = 0)
  and id not in (select o.artifact_id from job_outputs o join jobs j on j.id = o.job_id where j.exit_code = 0)
  and id not in (select artifact_id from collection_members where artifact_id is not null)"""))
def _(w):
    failed = w.jobs.where("exit_code is distinct from 0").select(F.col("id").alias("job_id"))
    return O.orphans(w.artifacts.select(F.col("id").alias("artifact_id")), O.delete_jobs(failed, w.inputs), O.delete_jobs(failed, w.outputs), w.members)


@query("cleared_outputs", "O7", duckdb_query("""
select o.job_id, o.artifact_id, 'kept' as what from job_outputs o join artifacts a on a.id = o.artifact_id where a.size % 2 = 0
union all
select null, a.id, 'orphan' from artifacts a where a.size % 2 = 1 and a.id not in (select artifact_id from job_inputs)"""))
def _(w):
    odd = w.artifacts.where("size % 2 = 1").select(F.col("id").alias("artifact_id"))
    kept, gone = O.clear_outputs(odd, w.inputs, w.outputs)
    return kept.select("job_id", "artifact_id", F.lit("kept").alias("what")).unionByName(
        gone.select(F.lit(None).cast("bigint").alias("job_id"), "artifact_id", F.lit("orphan").alias("what")))


POPPED = """popped as (
  select session_id, id as job_id, step_number, command, exit_code,
         case when 8 >= step_number then greatest(1, step_number - 1) else 8 end as current_step
  from jobs qualify row_number() over (partition by session_id order by step_number desc, timestamp desc, id desc) = 1)"""


def _popped(w):
    return O.popped_jobs(w.sessions.selectExpr("id as session_id", "8 as current_step"), w.jobs)


@query("popped_jobs", "O8", duckdb_query("select session_id, job_id, step_number, current_step from popped", POPPED))
def _(w):
    return _popped(w).select("session_id", "job_id", "step_number", "current_step")


@query("popped_files", "O8", duckdb_query("""
select o.job_id, o.artifact_id, o.path, ends_with(o.path, '1') as deletable from job_outputs o where job_id in (select job_id from popped)""", POPPED))
def _(w):
    classes = w.outputs.selectExpr("path", "if(endswith(path, '1'), 'unmanaged', 'system') as class")
    return O.popped_files(_popped(w), w.outputs, w.artifacts, classes)


@query("cleared_sessions", "O9", duckdb_query("""
select id, case when session_id % 100 <> 1 then session_id end as session_id, case when session_id % 100 <> 1 then step_number end as step_number from jobs"""))
def _(w):
    return O.clear_sessions(w.sessions.where("is_active"), w.sessions, w.jobs)[1].select("id", "session_id", "step_number")


@query("renamed_steps", "O10", duckdb_query("""
select id, case when step_number % 2 = 0 and job_type is null then 'renamed' || step_number else script end as step_name from jobs"""))
def _(w):
    names = w.jobs.where("step_number % 2 = 0").selectExpr("session_id", "step_number", "false as is_build", "concat('renamed', step_number) as new_name").distinct()
    return O.rename_steps(w.jobs.withColumn("step_name", F.col("script")), names).select("id", "step_name")


@query("backup_files", "O11", duckdb_query("""
select j.script, j.id as job_id, o.path, substr(o.path, 3) as relative_path
from (select * from jobs qualify row_number() over (partition by script order by timestamp desc, id desc) = 1) j join job_outputs o on o.job_id = j.id"""))
def _(w):
    runs = w.jobs.select("script", F.lit("p").alias("repo_root"))
    return O.backup_files(runs, w.jobs, w.outputs, w.artifacts)
