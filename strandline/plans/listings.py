"""Listing, search and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import listing as D
from strandline.operators import summary as E
from strandline.plans.lineages import COLLECTED, PRODUCERS, SESSION_OUTPUTS, STEPS, _walk, session_outputs
from strandline.plans.registry import query
from strandline.sources.derived import duckdb_query

for _name, _covers, _table in (("job_input_files", "D1 D14", "job_inputs"), ("job_output_files", "D2 D14", "job_outputs")):
    query(_name, _covers, duckdb_query(f"""
select e.job_id, e.artifact_id, coalesce(nullif(e.path, ''), a.first_seen_path) as path, a.size, h.digest
from {_table} e join artifacts a on a.id = e.artifact_id
left join artifact_hashes h on h.artifact_id = a.id and h.algorithm = 'sha256'"""))(
        lambda w, t=_table: D.linked_files(w.view(t), w.artifacts, w.hashes))


@query("recent_jobs", "D3", duckdb_query("select id, timestamp, command from jobs order by timestamp desc, id desc limit 50"))
def _(w):
    return D.recent_jobs(w.jobs).select("id", "timestamp", "command")


@query("recent_jobs_per_session", "D4", duckdb_query("""
select session_id, id, timestamp from jobs qualify row_number() over (partition by session_id order by timestamp desc, id desc) <= 5"""))
def _(w):
    return D.recent_jobs_per_session(w.jobs, 5).select("session_id", "id", "timestamp")


@query("search_jobs", "D5", duckdb_query(r"""
select id, command from (
  select *, ' ' || regexp_replace(lower(command), '[^\p{L}\p{N}]+', ' ', 'g') || ' |' || ' ' || regexp_replace(lower(script), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' as words from jobs)
where contains(words, ' python ') and (contains(words, ' urgent ') or contains(words, ' high ')) and not contains(words, ' token ')
  and contains(words, ' step') and contains(words, ' py prio ')
order by timestamp desc, id desc limit 200"""))
def _(w):
    return D.search_jobs(
        w.jobs, every=["python"], any_of=["urgent", "high"], none_of=["token"], prefixes=["step"],
        phrases=["py prio"], n=200).select("id", "command")


@query("jobs_by_script", "D6", duckdb_query("""
select s.wanted, j.id from jobs j, (values ('step_3.py'), ('p_1.py'), ('2.py')) s(wanted)
where ends_with(j.script, s.wanted) or contains(j.command, s.wanted)
qualify row_number() over (partition by wanted order by timestamp desc, id desc) <= 50"""))
def _(w):
    return D.jobs_by_script(w.jobs, ["step_3.py", "p_1.py", "2.py"]).select("wanted", "id")


@query("written_files", "D7", duckdb_query(
    "select distinct o.path, o.artifact_id, a.size from job_outputs o join artifacts a on a.id = o.artifact_id"))
def _(w):
    return D.written_files(w.outputs, w.artifacts)


@query("newest_artifacts", "D8", duckdb_query("""
select a.id as artifact_id, a.size, a.first_seen_at, p.path
from (select * from artifacts order by first_seen_at desc, id desc limit 100) a
left join (select artifact_id, min(path) as path from job_outputs group by all) p on p.artifact_id = a.id"""))
def _(w):
    return D.newest_artifacts(w.artifacts, w.outputs).select("artifact_id", "size", "first_seen_at", "path")


@query("recent_outputs", "D9", duckdb_query("""
select t.*, a.size from (
  select o.artifact_id, o.path, o.job_id, j.timestamp as job_timestamp from job_outputs o join jobs j on j.id = o.job_id
  where j.job_type is null or j.job_type = 'run'
  order by j.timestamp desc, j.id desc, o.artifact_id, o.path limit 50) t join artifacts a on a.id = t.artifact_id"""))
def _(w):
    return D.recent_outputs(w.outputs, w.jobs, w.artifacts, kind="run")


@query("outputs_with_paths", "D10", duckdb_query("""
select distinct o.artifact_id, o.path, a.size, a.first_seen_at from job_outputs o join artifacts a on a.id = o.artifact_id"""))
def _(w):
    return D.outputs_with_paths(w.outputs, w.artifacts)


JOBS_OF = """jobsof as (
  select artifact_id, job_id, 'produced_by' as role from job_outputs union all select artifact_id, job_id, 'consumed_by' from job_inputs)"""


@query("jobs_of_artifacts", "D11", duckdb_query(
    "select e.*, j.timestamp, j.command from jobsof e join jobs j on j.id = e.job_id", JOBS_OF))
def _(w):
    return D.jobs_of_artifacts(w.inputs, w.outputs, w.jobs)


LOCATIONS = """locations as (
  select artifact_id, path from job_outputs union select artifact_id, path from job_inputs union select id, first_seen_path from artifacts)"""


@query("artifact_locations", "D12", duckdb_query("select * from locations", LOCATIONS))
def _(w):
    return D.artifact_locations(w.inputs, w.outputs, w.artifacts)


@query("session_steps", "D13", duckdb_query(
    "select session_id, step_number, timestamp, id as job_id, command, job_type from jobs order by 1, 2, 3, 4"))
def _(w):
    return D.session_steps(w.jobs).orderBy("session_id", "step_number", "timestamp", "job_id")


_STEP = "case when job_type = 'build' then '@B' else '@' end || step_number as step"
_STATUS = "case when exit_code is null then '?' when exit_code = 0 then 'OK' else 'FAIL' end as status"
_RANK = "row_number() over (partition by session_id order by timestamp desc, id desc)"


@query("job_log", "D15", duckdb_query(f"""
select session_id, {_RANK} as from_newest, id as job_id, {_STEP}, timestamp, duration_seconds, {_STATUS}, command
from jobs qualify {_RANK} <= 20"""))
def _(w):
    return D.job_log(w.jobs)


@query("session_overview", "D16", duckdb_query(f"""
select s.id as session_id, s.hash, s.git_repo, j.job_id, j.step, j.status, j.command
from sessions s left join (select session_id, id as job_id, {_STEP}, {_STATUS}, command from jobs qualify {_RANK} <= 100) j on j.session_id = s.id"""))
def _(w):
    return D.session_overview(w.sessions, w.jobs)


@query("job_packages", "D17", duckdb_query("""
select id as job_id, m.manager, cast(1 as bigint) as package_count, m.name,
       json_extract_string(metadata, '$.packages.' || m.manager || '.' || m.name) as version
from jobs, (values ('pip', 'numpy'), ('dpkg', 'libc6')) m(manager, name)"""))
def _(w):
    return D.job_packages(w.jobs)


@query("artifact_detail", "D18 C3 D11 D12", duckdb_query("""
select r.*, a.size from (
  select artifact_id, 'hash:' || algorithm as kind, digest as value from artifact_hashes
  union all select artifact_id, 'location', path from locations
  union all select artifact_id, role, cast(job_id as varchar) from (
    select distinct e.artifact_id, e.role, e.job_id, j.timestamp from jobsof e join jobs j on j.id = e.job_id)
    qualify row_number() over (partition by artifact_id, role order by timestamp desc, job_id desc) <= 5) r
join artifacts a on a.id = r.artifact_id""", JOBS_OF, LOCATIONS))
def _(w):
    return D.artifact_detail(w.artifacts, w.hashes, w.inputs, w.outputs, w.jobs)


@query("digests_of_paths", "D19", duckdb_query("""
select path, artifact_id as digest from (
  select distinct o.path, o.artifact_id, a.first_seen_at from job_outputs o join artifacts a on a.id = o.artifact_id)
qualify row_number() over (partition by path order by first_seen_at desc, artifact_id desc) = 1"""))
def _(w):
    return D.digests_of_paths(w.io, w.outputs, w.artifacts, w.hashes)


# Summaries.


@query("build_output_count", "E1", """
select count(distinct l_partkey) as build_outputs from lineitem join orders on o_orderkey = l_orderkey where o_orderkey % 10 = 0""")
def _(w):
    # Build jobs have no outputs in the derived tables, so a part stands for what a build wrote.
    made = w.base("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("artifact_id"))
    return E.build_output_count(made, w.jobs)


@query("next_step_numbers", "E2", duckdb_query("""
select s.id as session_id, coalesce(max(j.step_number), 0) + 1 as next_step from sessions s left join jobs j on j.session_id = s.id group by s.id"""))
def _(w):
    return E.next_step_numbers(w.sessions, w.jobs)


CONSISTENCY = """consistency as (
  select session_id, count(distinct git_commit) <= 1 as consistent, count(distinct git_commit) as commits,
         case when count(distinct git_commit) > 1 then 'Pipeline has ' || count(distinct git_commit) || ' different git commits' end as warning
  from jobs group by session_id)"""


@query("git_consistency", "E3", duckdb_query("select * from consistency", CONSISTENCY))
def _(w):
    return E.git_consistency(w.jobs)


@query("session_commits", "E3", duckdb_query("select distinct session_id, git_commit from jobs where git_commit <> ''"))
def _(w):
    return E.session_commits(w.jobs)


@query("session_summary", "E4", duckdb_query("""
select s.id as session_id, s.hash, s.is_active, coalesce(t.n, 0) as total_steps, t.last_step,
       coalesce(c.consistent, true) as git_consistent, c.warning as git_warning
from sessions s left join (select session_id, count(distinct step_number) as n, max(step_number) as last_step from jobs group by all) t on t.session_id = s.id
left join consistency c on c.session_id = s.id""", CONSISTENCY))
def _(w):
    return E.session_summary(w.sessions, w.jobs)


@query("session_status", "E5", duckdb_query("""
select j.session_id, count(distinct step_number) filter (job_type = 'build') as build_steps,
       count(distinct step_number) filter (job_type is null) as run_steps,
       coalesce(any_value(f.n), 0) as artifacts, coalesce(any_value(f.p), 0) as present, coalesce(any_value(f.n - f.p), 0) as missing
from jobs j left join (
  select session_id, count(*) as n, cast(count(*) filter (path in (select path from job_inputs)) as bigint) as p from (
    select j.session_id, o.artifact_id, o.path from job_outputs o join jobs j on j.id = o.job_id
    qualify row_number() over (partition by j.session_id, o.artifact_id order by j.timestamp desc, j.id desc, o.path) = 1)
  group by session_id) f on f.session_id = j.session_id
group by j.session_id"""))
def _(w):
    return E.session_status(w.jobs, w.outputs, w.artifacts, w.inputs.select("path"))


@query("link_counts", "E6", duckdb_query("""
select session_id as group_id, cast(coalesce(sum(n), 0) as bigint) as links from jobs j
left join (select job_id, count(*) as n from (select job_id from job_inputs union all select job_id from job_outputs) group by all) e on e.job_id = j.id
group by session_id"""))
def _(w):
    return E.link_counts(w.jobs.select(F.col("session_id").alias("group_id"), F.col("id").alias("job_id")), w.inputs, w.outputs)


@query("run_timing", "E10", duckdb_query("""
select id as run_id,
  case when id % 9 > 0 then strftime(to_timestamp(timestamp) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') end as start,
  case when id % 9 > 0 then strftime(to_timestamp(timestamp + id % 100 - 10) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') end as "end",
  case when id % 9 > 0 then greatest(0.0, cast(id % 100 - 10 as double)) end as duration_seconds
from jobs"""))
def _(w):
    runs = w.jobs.selectExpr(
        "id as run_id", "case when id % 9 > 0 then cast(timestamp as double) else 0.0 end as start_time",
        "cast(timestamp + id % 100 - 10 as double) as end_time")
    return E.run_timing(runs)
