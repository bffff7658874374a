"""Validation, batching, payload and reproduction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import lineage as L
from strandline.operators import register as M
from strandline.operators import reproduce as H
from strandline.operators import secrets as K
from strandline.plans.lineages import COLLECTED, DIGESTS, PRODUCERS, SESSION_OUTPUTS, STEPS, _walk, session_outputs
from strandline.plans.registry import query
from strandline.plans.secrets_and_rollups import _IDS, chain
from strandline.sources.derived import duckdb_query

_JOIN = "array_join(errors, '; ')"


@query("validated_sessions", "M1", duckdb_query("""
select id, concat_ws('; ', case when id % 7 = 0 then 'session_hash is required' end, case when id % 5 = 0 then 'git_repo is required (not in a git repository?)' end,
  case when id % 3 = 0 then 'git_commit is required (no commits yet?)' end, case when id % 4 = 0 then 'git_branch is required (detached HEAD?)' end) as errors from sessions"""))
def _(w):
    rows = w.sessions.selectExpr("id", "if(id % 7 = 0, '', hash) as session_hash", "if(id % 5 = 0, 'unknown', git_repo) as git_repo",
                                 "if(id % 3 = 0, null, 'c0ffee') as git_commit", "if(id % 4 = 0, 'Unknown', 'main') as git_branch")
    return M.validate_sessions(rows).select("id", F.expr(_JOIN).alias("errors"))


def _job_facts(w):
    return w.jobs.selectExpr("id as job_id", "if(id % 11 = 0, '', command) as command", "if(id % 13 = 0, null, timestamp * (id % 17 - 1)) as timestamp",
                             "sha2(concat('session:', session_id), 256) as session_hash", "if(id % 19 = 0, null, job_uid) as job_uid",
                             "if(id % 4 = 0, 'unknown', git_commit) as git_commit", "git_branch", "job_type", "if(id % 23 = 0, null, step_number - 1) as step_number")


JOB_ERRORS = """joberrors as (
  select id as job_id, session_id, concat_ws('; ', case when id % 11 = 0 then 'command is required' end, case when id % 13 = 0 then 'timestamp is required' end,
    case when id % 13 <> 0 and timestamp * (id % 17 - 1) <= 0 then 'timestamp must be positive, got ' || cast(timestamp * (id % 17 - 1) as bigint) || '.0' end,
    case when id % 19 = 0 then 'job_uid is required' end, case when id % 4 = 0 then 'git_commit is required' end,
    case when id % 23 = 0 then 'step_number is required' when step_number - 1 < 1 then 'step_number must be >= 1, got ' || (step_number - 1) end) as errors from jobs)"""


@query("validated_jobs", "M2", duckdb_query("select job_id, errors from joberrors", JOB_ERRORS))
def _(w):
    return M.validate_jobs(_job_facts(w)).select("job_id", F.expr(_JOIN).alias("errors"))


def _artifact_facts(w):
    return w.artifacts.selectExpr(
        "id", "case when size % 5 = 0 then array() else array(named_struct('algorithm', 'sha256', 'digest', id), named_struct('algorithm', if(size % 3 = 0, '', 'md5'), 'digest', if(size % 3 = 0, null, id))) end as hashes",
        "if(size % 7 = 0, null, if(size % 7 = 1, -size, size)) as size", "element_at(array('s3', 'gs', 'https', 'ftp', null), cast(size % 5 as int) + 1) as source_type",
        "sha2(concat('session:', size % 50), 256) as session_hash")


@query("validated_artifacts", "M3", duckdb_query("""
select id, concat_ws('; ', case when size % 5 = 0 then 'at least one hash is required' when size % 3 = 0 then 'hashes[1].algorithm is required; hashes[1].digest is required' end,
  case when size % 7 < 2 and (size % 7 = 0 or size > 0) then 'size is required and must be non-negative' end,
  case when size % 5 = 3 then 'source_type must be ''s3'', ''gs'', ''https'', or None, got ''ftp''' end) as errors from artifacts"""))
def _(w):
    return M.validate_artifacts(_artifact_facts(w)).select("id", F.expr(_JOIN).alias("errors"))


# Documents as items: sizes from a few bytes to beyond a small limit.
@query("packed_items", "M4", """
with recursive items as (select source, doc_id, cast(n_chars + 2 as bigint) as size, row_number() over (partition by source order by doc_id) as n from documents),
walk as (
  select source, n, doc_id, cast(0 as bigint) as batch, 2 + size as filled from items where n = 1
  union all
  select i.source, i.n, i.doc_id, case when w.filled + i.size > 20000 then w.batch + 1 else w.batch end,
         case when w.filled + i.size > 20000 then 2 + i.size else w.filled + i.size end
  from walk w join items i on i.source = w.source and i.n = w.n + 1)
select source, doc_id, batch from walk""")
def _(w):
    items = w.base("documents").selectExpr("source", "doc_id", "n_chars + 2 as size")
    return M.pack_by_size(items, ["source"], ["doc_id"], "size", limit=20000, slice_rows=500).select("source", "doc_id", "batch")


@query("packed_links", "M5", duckdb_query("""
select session_id, job_id, artifact_id, path, cast(floor((row_number() over (partition by session_id order by job_id, artifact_id, path) - 1) / 10) as bigint) as batch
from (select j.session_id, i.* from job_inputs i join jobs j on j.id = i.job_id)"""))
def _(w):
    links = w.inputs.join(w.jobs.select(F.col("id").alias("job_id"), "session_id"), "job_id")
    return M.pack_links(links, ["session_id"], ["job_id", "artifact_id", "path"], 10)


def _links(w):
    structured = w.outputs.where("job_id % 3 = 0").selectExpr("job_id", "'out' as direction", "artifact_id as digest", "if(endswith(path, '1'), '', path) as path")
    bare = w.outputs.selectExpr("job_id", "'out' as direction", "artifact_id as digest")
    return structured, bare


@query("usable_links", "M6", duckdb_query("""
select job_id, 'out' as direction, artifact_id as digest, path from job_outputs where job_id % 3 = 0 and not ends_with(path, '1')"""))
def _(w):
    return M.usable_links(*_links(w))


@query("session_hashes", "M7", duckdb_query("select id, sha256('/data:' || case when id % 3 = 0 then 'put:' || id else cast(id as varchar) end) as hash from sessions"))
def _(w):
    return w.sessions.select("id", M.session_hash(F.lit("/data"), F.expr("if(id % 3 = 0, null, id)"), F.concat(F.lit("put:"), "id")).alias("hash"))


PAYLOADS = """payloads as (
  select id as digest, case when size % 4 = 0 then 0 else size end as size, case when size % 2 = 0 then 's3' end as source_type from artifacts where size % 9 > 0)"""


def _payloads(w):
    rows = w.artifacts.selectExpr("sha2(concat('session:', size % 50), 256) as session_hash", "if(size % 9 = 0, '', id) as digest", "if(size % 4 = 0, null, size) as size",
                                  "if(size % 2 = 0, 's3', null) as source_type", "'' as source_url")
    return M.payload_bytes(M.artifact_payloads(rows))


@query("artifact_payloads", "M8", duckdb_query("""
select digest, 'sha256' as algorithm, size, source_type, cast(length('{"hashes": [{"algorithm": "sha256", "digest": "' || digest || '"}], "size": ' || size
  || ', "source_type": ' || case when source_type is null then 'null' else '"s3"' end || ', "session_hash": "' || repeat('0', 64) || '"}') + 2 as int) as bytes from payloads""", PAYLOADS))
def _(w):
    return _payloads(w).select(F.col("hashes")[0]["digest"].alias("digest"), F.col("hashes")[0]["algorithm"].alias("algorithm"), "size", "source_type", "bytes")


@query("artifact_payloads_md5", "M8 D14", duckdb_query("""
select digest, 'md5' as algorithm, cast(length('{"hashes": [{"algorithm": "md5", "digest": "' || digest || '"}], "size": ' || size
  || ', "source_type": null, "session_hash": "x", "source_url": "s3://b/' || size || '"}') + 2 as int) as bytes
from (select h.digest, a.size from artifacts a join artifact_hashes h on h.artifact_id = a.id where h.algorithm = 'md5')"""))
def _(w):
    from strandline.operators.edges import primary_digests

    rows = w.artifacts.join(primary_digests(w.hashes, "md5", strict=True).withColumnRenamed("artifact_id", "id"), "id").selectExpr(
        "'x' as session_hash", "digest", "size", "cast(null as string) as source_type", "concat('s3://b/', size) as source_url")
    return M.payload_bytes(M.artifact_payloads(rows, "md5")).select(
        F.col("hashes")[0]["digest"].alias("digest"), F.col("hashes")[0]["algorithm"].alias("algorithm"), "bytes")


def _job_payloads(w):
    sessions = w.sessions.selectExpr("id as session_id", "hash as session_hash", "concat('c', id) as commit", "'trunk' as branch")
    jobs = w.jobs.withColumns({"git_commit": F.expr("if(id % 3 = 0, '', git_commit)"), "git_branch": F.expr("if(id % 4 = 0, null, git_branch)"),
                               "step_number": F.expr("if(id % 23 = 0, null, step_number)"), "job_uid": F.expr("if(id % 19 = 0, null, job_uid)")})
    return M.job_payloads(jobs, sessions)


JOB_PAYLOADS = """jobpay as (
  select j.session_id, s.hash as session_hash, j.id as job_id, case when j.id % 19 > 0 then job_uid end as job_uid, command, timestamp,
    case when j.id % 3 = 0 then 'c' || j.session_id else git_commit end as git_commit, case when j.id % 4 = 0 then 'trunk' else git_branch end as git_branch,
    duration_seconds, coalesce(exit_code, 0) as exit_code, coalesce(job_type, 'run') as job_type, case when j.id % 23 = 0 then 0 else step_number end as step_number
  from jobs j join sessions s on s.id = j.session_id)"""


@query("job_payloads", "M9", duckdb_query("select * from jobpay", JOB_PAYLOADS))
def _(w):
    return _job_payloads(w)


@query("links_of_accepted_jobs", "M10", duckdb_query("""
select i.job_id, i.artifact_id from job_inputs i join jobpay p using (job_id) where p.job_uid is not null and p.step_number > 0 and p.timestamp > 0""", JOB_PAYLOADS))
def _(w):
    return M.links_of_accepted(w.inputs.select("job_id", "artifact_id"), M.validate_jobs(_job_payloads(w)))


@query("uploaded_artifacts", "M11", duckdb_query("select artifact_id, 's3://b/up/' || path as source_url from job_outputs"))
def _(w):
    files = w.outputs.select("artifact_id", F.col("path").alias("relative_path"))
    return M.uploaded_artifacts(files, "s3://b/up/", True).select("artifact_id", "source_url")


@query("registration_outcome", "E9 M10", duckdb_query("""
select coalesce(j.session_hash, a.session_hash) as session_hash, coalesce(jobs_created, 0) as jobs_created, coalesce(jobs_failed, 0) as jobs_failed,
  coalesce(artifacts_registered, 0) as artifacts_registered, coalesce(artifacts_failed, 0) as artifacts_failed, coalesce(links_created, 0) as links_created
from (select sha256('session:' || session_id) as session_hash, count(*) filter (errors = '') as jobs_created, count(*) filter (errors <> '') as jobs_failed from joberrors group by 1) j
full join (select sha256('session:' || (size % 50)) as session_hash,
   count(*) filter (size % 5 <> 0 and size % 3 <> 0 and size % 7 > 1 and size % 5 <> 3) as artifacts_registered,
   count(*) filter (not (size % 5 <> 0 and size % 3 <> 0 and size % 7 > 1 and size % 5 <> 3)) as artifacts_failed from artifacts group by 1) a on a.session_hash = j.session_hash
left join (select sha256('session:' || session_id) as session_hash, count(*) as links_created from joberrors e join job_outputs o using (job_id)
   where errors = '' and job_id % 3 = 0 and not ends_with(o.path, '1') group by 1) l on l.session_hash = j.session_hash""", JOB_ERRORS))
def _(w):
    return M.registration_outcome(M.validate_jobs(_job_facts(w)), M.validate_artifacts(_artifact_facts(w)), M.usable_links(*_links(w)))


@query("registration_preview", "M12", duckdb_query(f"""
select c.group_id, count(*) as jobs, coalesce(any_value(d.n), 0) as artifacts, cast(coalesce(sum(l.n), 0) as bigint) as links, coalesce(any_value(k.n), 0) as secret_kinds
from collected c left join (select group_id, count(*) as n from digests group by all) d using (group_id)
left join (select job_id, count(*) as n from (select job_id from job_inputs union all select job_id from job_outputs) group by all) l using (job_id)
left join (select session_id as group_id, count(distinct v.pattern_id) as n from redacted, lateral (values {_IDS}) v(pattern_id, n) where v.n > 0 group by all) k using (group_id)
group by c.group_id""", PRODUCERS, STEPS, *_walk(SESSION_OUTPUTS, 10), *COLLECTED, DIGESTS, *chain(" union all ".join(
    f"select c.group_id as session_id, '{field}' as field, j.{field} as t from jobs j join collected c on c.job_id = j.id" for field in ("git_repo", "command", "metadata")))))
def _(w):
    collected = L.collect_lineage(session_outputs(w), w.jobs, w.inputs, w.outputs, w.hashes)
    digests = L.referenced_digests(collected, w.inputs, w.outputs, w.hashes)
    mine = collected.select("group_id", F.col("job_id").alias("id")).join(w.jobs.drop("session_id"), "id").withColumnRenamed("group_id", "session_id")
    return M.registration_preview(collected, w.inputs, w.outputs, digests, K.scan_lineage(mine))


@query("rule_violations", "M13", duckdb_query("""
select r.field, r.rule, r.violations from (select
    count(*) filter (length(job_uid) not between 6 and 12) as a, count(*) filter (id % 10 = 0) as b, count(*) filter (length(command) > 40) as c,
    count(*) filter (step_number - 2 < 1) as d, count(*) filter (length(git_commit) > 40) as e, count(*) filter (id % 6 = 0) as f, count(*) filter (id % 5 = 0) as g from jobs) t,
  lateral (values ('job_uid', 'length 6 to 12', a), ('timestamp', 'above 0', b), ('command', 'length 1 to 65535', c), ('step_number', 'at least 1', d),
    ('git_commit', 'length 7 to 40', e), ('git_branch', 'length up to 255', 0), ('duration_seconds', 'at least 0', 0),
    ('step_name', 'length up to 255', f), ('synced_at', 'above 0', g)) r(field, rule, violations)"""))
def _(w):
    rows = w.jobs.withColumns({"timestamp": F.expr("if(id % 10 = 0, null, timestamp)"), "command": F.expr("if(length(command) > 40, '', command)"),
                               "step_number": F.expr("step_number - 2"), "step_name": F.expr("if(id % 6 = 0, repeat('n', 256), if(id % 7 = 0, null, 'prep'))"),
                               "synced_at": F.expr("if(id % 5 = 0, 0, timestamp)")})
    return M.rule_violations("jobs", rows)


# Reproduction.


@query("reproduction_plans", "H1", duckdb_query("""
select p.artifact_id as plan_id, j.session_id, s.git_repo, c.commit as git_commit
from producers p join jobs j on j.id = p.job_id join sessions s on s.id = j.session_id
left join (select session_id, arg_min(git_commit, (timestamp, id)) as commit from jobs group by all) c on c.session_id = s.id""", PRODUCERS))
def _(w):
    from strandline.operators.record import session_commit_range

    sessions = w.sessions.select("id", "git_repo").join(session_commit_range(w.jobs).withColumnRenamed("session_id", "id"), "id", "left")
    targets = w.outputs.select("artifact_id").distinct().withColumn("plan_id", F.col("artifact_id"))
    return H.plans(targets, L.producers(w.jobs, w.outputs), w.jobs, sessions)


@query("session_step_counts", "H1", duckdb_query("""
select session_id, count(*) filter (job_type = 'build') as build_steps, count(*) filter (job_type is null) as run_steps from jobs group by session_id"""))
def _(w):
    return H.session_step_counts(w.jobs)


@query("execution_order", "H3", duckdb_query("""
select session_id, case when job_type = 'build' then 'B' else '' end || n as label, n as number, case when job_type = 'build' then 0 else 1 end as phase, id as job_id, command
from (select *, row_number() over (partition by session_id, job_type order by step_number, timestamp, id) as n from jobs)"""))
def _(w):
    return H.execution_order(w.jobs)


@query("plan_step_files", "H1 H3", duckdb_query("""
select o.session_id, o.label, e.direction, e.artifact_id, e.path from (
  select session_id, case when job_type = 'build' then 'B' else '' end || row_number() over (partition by session_id, job_type order by step_number, timestamp, id) as label, id from jobs) o
join (select job_id, 'in' as direction, artifact_id, path from job_inputs union all select job_id, 'out', artifact_id, path from job_outputs) e on e.job_id = o.id"""))
def _(w):
    return H.step_files(H.execution_order(w.jobs), w.inputs, w.outputs)


@query("pip_requirements", "H4", duckdb_query("select distinct session_id, 'numpy==1.' || (id % 3) as requirement from jobs"))
def _(w):
    return H.pip_requirements(w.jobs)


_FIRST = """
select session_id, '{name}' as name, arg_min({version}, (case when job_type = 'build' then 1 else 0 end, step_number, timestamp, id)) as version from jobs group by session_id"""


@query("dpkg_requirements", "H5", duckdb_query(_FIRST.format(name="libc6", version="'2.' || (id % 2)")))
def _(w):
    return H.dpkg_requirements(w.jobs)


def _with_build_tools(w):
    return w.jobs.withColumn("metadata", F.regexp_replace(F.regexp_replace("metadata", '"pip"', '"build_pip"'), '"dpkg"', '"build_dpkg"'))


@query("build_dpkg_requirements", "H6", duckdb_query(_FIRST.format(name="libc6", version="'2.' || (id % 2)")))
def _(w):
    return H.build_dpkg_requirements(_with_build_tools(w))


@query("build_pip_requirements", "H7", duckdb_query(_FIRST.format(name="numpy", version="'1.' || (id % 3)")))
def _(w):
    return H.build_pip_requirements(_with_build_tools(w))


@query("requirement_preview", "H8", duckdb_query("""
select session_id, manager, label, greatest(n - 2, 0) as more from (
  select *, row_number() over (partition by session_id, manager order by label) as r, count(*) over (partition by session_id, manager) as n from (
    select distinct session_id, 'pip' as manager, 'numpy==1.' || (id % 3) as label from jobs union all select distinct session_id, 'dpkg', 'libc6' from jobs)) where r <= 2"""))
def _(w):
    return H.requirement_preview(w.jobs, 2)


@query("environment_drift", "H9", duckdb_query("""
select session_id, 'h' || session_id as host, concat_ws('; ',
  case when session_id % 2 = 0 then 'OS mismatch: original=Linux, current=Darwin' end,
  case when machine <> 'x86_64' then 'Architecture mismatch: original=' || machine || ', current=x86_64' end,
  case when session_id % 3 = 0 then 'CUDA required (version 12.1) but not available' when session_id % 3 = 1 then 'CUDA version mismatch: original=12.1, current=11' end,
  case when session_id % 5 = 0 then 'GPU required (A100, unknown) but not detected' end) as warnings
from (select session_id, arg_min(case when id % 2 = 0 then 'arm64' else 'x86_64' end, (case when job_type = 'build' then 0 else 1 end, step_number, timestamp, id)) as machine from jobs group by session_id)"""))
def _(w):
    meta = """concat('{"runtime":{"os":{"system":"Linux","machine":"', if(id % 2 = 0, 'arm64', 'x86_64'), '"},"cuda":{"cuda_version":"12.1"},"gpu":[{"name":"A100"},{"memory_mb":"1"}]}}')"""
    hosts = w.sessions.selectExpr("id as session_id", "concat('h', id) as host", "if(id % 2 = 0, 'Darwin', 'Linux') as system", "'x86_64' as machine",
                                  "element_at(array(null, '11', '12.1'), cast(id % 3 as int) + 1) as cuda_version", "id % 5 <> 0 as has_gpu")
    return H.environment_drift(w.jobs.withColumn("metadata", F.expr(meta)), hosts).select("session_id", "host", F.array_join("warnings", "; ").alias("warnings"))


@query("text_digests", "A4", "select doc_id, sha256(text) as sha256, md5(text) as md5 from documents")
def _(w):
    from strandline.functions.hashing import digest_columns

    return w.base("documents").select("doc_id", *digest_columns(F.col("text"), ["sha256", "md5"]))
