"""Queries over files that tasks write and read back: all tables, reports of runs, summaries, digests; and job details."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.operators import listing as D
from strandline.operators import secrets as K
from strandline.operators import telemetry as L
from strandline.plans.registry import CATALOG, query
from strandline.plans.secrets_and_rollups import chain
from strandline.plans.session_graphs import graph
from strandline.scale import scratch_root
from strandline.sources import tables as T
from strandline.sources.derived import World, duckdb_query


def _folder(w: World, label: str) -> str:
    return f"{scratch_root(w.spark)}/{label}-{uuid.uuid4().hex}"


# All nine tables, and their columns as text that both engines write alike.
_TABLES = {
    "artifacts": ["id", "size", "cast(first_seen_at as bigint)", "first_seen_path"],
    "artifact_hashes": ["artifact_id", "algorithm", "digest"],
    "jobs": ["id", "job_uid", "cast(timestamp as bigint)", "command", "script", "session_id", "step_number", "git_repo", "git_commit", "git_branch", "cast(duration_seconds * 2 as bigint)", "exit_code", "job_type", "metadata"],
    "job_inputs": ["job_id", "artifact_id", "path"],
    "job_outputs": ["job_id", "artifact_id", "path"],
    "collections": ["id", "name", "source_url"],
    "collection_members": ["collection_id", "artifact_id", "child_collection_id", "path_in_collection"],
    "sessions": ["id", "hash", "git_repo", "cast(is_active as int)"],
    "hash_cache": ["path", "algorithm", "digest", "size", "cast(mtime as bigint)", "cast(cached_at as bigint)"],
}
_CACHED = "select first_seen_path as path, 'sha256' as algorithm, id as digest, size, cast(first_seen_at as double) as mtime, cast(first_seen_at + size % 90 as double) as cached_at from {artifacts}"


def _sums(table: str, cast: str, number) -> str:
    text = "md5(concat_ws('|', " + ", ".join(f"coalesce(cast({c} as {cast}), '-')" for c in _TABLES[table]) + "))"
    sums = ", ".join(f"cast(sum({number(f'substr({text}, {at}, 8)')}) as bigint) as sum_{k}" for k, at in enumerate((1, 9)))
    return f"select '{table}' as name, count(*) as rows, {sums} from {{{table}}}"


def _duck_number(text: str) -> str:
    return f"cast('0x' || {text} as bigint)"


@query("all_lineage_tables", "A1", duckdb_query(
    " union all ".join(_sums(t, "varchar", _duck_number).replace(f"{{{t}}}", t) for t in _TABLES), "hash_cache as (" + _CACHED.replace("{artifacts}", "artifacts") + ")"))
def _(w):
    folder = _folder(w, "tables")
    tables = {
        "artifacts": w.artifacts, "artifact_hashes": w.hashes, "jobs": w.jobs, "job_inputs": w.inputs, "job_outputs": w.outputs, "collections": w.collections,
        "collection_members": w.members, "sessions": w.sessions, "hash_cache": w.spark.sql(_CACHED, artifacts=w.artifacts),
    }
    doubles = {"artifacts": ["first_seen_at"], "jobs": ["timestamp"]}
    T.write_lineage({n: df.withColumns({c: F.col(c).cast("double") for c in doubles.get(n, ())}) for n, df in tables.items()}, folder)
    back, out = T.read_lineage(w.spark, folder), None
    for name in _TABLES:
        row = w.spark.sql(_sums(name, "string", lambda text: f"cast(conv({text}, 16, 10) as bigint)"), **{name: back[name]})
        out = row if out is None else out.unionByName(row)
    return out


def _graph_report(w: World, part: str):
    g = graph(w)
    parts = {"nodes": g.nodes(), "artifacts": g.artifact_view(w.hashes, show_artifacts=True), "summary": g.summary(w.hashes)}
    folder = _folder(w, "dag")
    T.write_graph_report(parts["nodes"], parts["artifacts"], parts["summary"], folder)
    return w.spark.read.schema(parts[part].schema).json(f"{folder}/{part}")


@query("dag_report_nodes", "A7 G10", CATALOG["dag_nodes"].oracle)
def _(w):
    return _graph_report(w, "nodes")


@query("dag_report_artifacts", "A7 G17", CATALOG["artifact_states"].oracle)
def _(w):
    return _graph_report(w, "artifacts")


# Reports of runs: a session's files stand for a run's. Each is a file of its own.
_REPORTED = "select session_id, min(timestamp) as lo, max(timestamp) as hi from io group by session_id"


def _written_reports(w: World, folder: str) -> None:
    paths = "array_sort(collect_list(case when dir = '{0}' then path end))"
    runs = w.io.groupBy("session_id").agg(
        F.expr(paths.format("in")).alias("read_files"), F.expr(paths.format("out")).alias("written_files"),
        F.min("timestamp").cast("double").alias("start_time"), F.max("timestamp").cast("double").alias("end_time"))
    process = "array(named_struct('pid', session_id, 'parent_pid', cast(null as bigint), 'command', array('python', 'x.py'), 'env', map('HOME', concat('/home/', session_id))))"
    # A third of the reports lack keys.
    full = f"named_struct('processes', {process}, 'opened_files', read_files, 'read_files', read_files, 'written_files', written_files, 'start_time', start_time, 'end_time', end_time)"
    part = "named_struct('read_files', read_files, 'written_files', written_files)"
    text = F.expr(f"if(session_id % 3 = 0, to_json({part}), to_json({full}))")
    T.write_texts(runs.select(F.concat("session_id", F.lit(".json")).alias("path"), text.alias("text")), folder)


@query("trace_reports", "A2", duckdb_query(f"""
select cast(session_id as varchar) as run_id, kind, path from (
  select distinct session_id, case dir when 'in' then 'read' else 'written' end as kind, path from io
  union select distinct session_id, 'opened', path from io where dir = 'in' and session_id % 3 <> 0)
union all
select cast(session_id as varchar), 'time', case when session_id % 3 = 0 then '0-0' else lo || '-' || hi end from ({_REPORTED})
union all
select cast(session_id as varchar), 'process', session_id || ':python x.py:/home/' || session_id from ({_REPORTED}) where session_id % 3 <> 0"""))
def _(w):
    folder = _folder(w, "traces")
    _written_reports(w, folder)
    reports = T.read_trace_reports(w.spark, folder)
    rows = None
    for kind in ("opened", "read", "written"):
        part = reports.select("run_id", F.lit(kind).alias("kind"), F.explode(f"{kind}_files").alias("path"))
        rows = part if rows is None else rows.unionByName(part)
    time = reports.selectExpr("run_id", "'time' as kind", "concat(cast(start_time as bigint), '-', cast(end_time as bigint)) as path")
    processes = reports.select("run_id", F.explode("processes").alias("p")).selectExpr(
        "run_id", "'process' as kind", "concat(p.pid, ':', array_join(p.command, ' '), ':', p.env['HOME']) as path")
    return rows.unionByName(time).unionByName(processes)


@query("inject_reports", "A3", duckdb_query("""
select cast(id as varchar) as run_id, case when id % 7 = 0 or id % 5 = 0 then '' else '/venv' || id % 4 end as sys_prefix,
       cast(case when id % 7 = 0 or id % 5 = 0 then 0 else 2 end as bigint) as modules, case when id % 7 > 0 and id % 5 > 0 and id % 2 > 0 then '1.' || id % 9 end as numpy,
       cast(case when id % 7 = 0 or id % 5 = 0 then 0 else 1 end as bigint) as env_reads from sessions"""))
def _(w):
    # Every fifth run has no report, every seventh a broken one, and half of the others lack a key.
    whole = """named_struct('sys_prefix', concat('/venv', id % 4), 'modules_files', array('/a.py', concat('/m', id, '.py')),
      'used_packages', map('numpy', concat('1.', id % 9)), 'env_reads', map('HOME', 'x'))"""
    less = "named_struct('sys_prefix', concat('/venv', id % 4), 'modules_files', array('/a.py', concat('/m', id, '.py')), 'env_reads', map('HOME', 'x'))"
    texts = w.sessions.where("id % 5 > 0").selectExpr(
        "concat(id, '.json') as path", f"case when id % 7 = 0 then '{{\"sys_prefix\": ' when id % 2 = 0 then to_json({less}) else to_json({whole}) end as text")
    folder = _folder(w, "injects")
    T.write_texts(texts, folder)
    runs = w.sessions.select(F.col("id").cast("string").alias("run_id"))
    return T.read_inject_reports(w.spark, folder, runs).selectExpr(
        "run_id", "sys_prefix", "cast(size(modules_files) as bigint) as modules", "used_packages['numpy'] as numpy", "cast(size(env_reads) as bigint) as env_reads")


# Run summaries of several shapes, some of them broken.
_SUMMARIES = """case id % 6 when 0 then '{{"_wandb": {{"runtime": ' {c} id {c} '}}, "loss": 0.5, "step": ' {c} id {c} '}}' when 1 then '{{"loss": "high", "acc": 1, "nested": {{"x": 1}}}}'
  when 2 then '[1, 2, ' {c} id {c} ']' when 3 then '{{"broken": ' when 4 then '' else '{{"_wandb": "none", "big": 1e3, "flag": true, "none": null}}' end"""


def _summary_files(w: World):
    text = _SUMMARIES.format(c="||")
    rows = w.sessions.selectExpr("concat('wandb/run-', id, '/files/wandb-summary.json') as path", f"{text} as text")
    folder = _folder(w, "summaries")
    T.write_texts(rows, folder)
    return T.read_run_summaries(w.spark, folder)


@query("tracker_summaries", "A5 L3", duckdb_query("""
select 'run-' || id as run_dir, case when id % 6 = 0 then cast(id as double) end as runtime_seconds, cast(case id % 6 when 0 then 2 when 1 then 1 when 5 then 1 else 0 end as bigint) as metrics
from sessions where id % 6 not in (3, 4)"""))
def _(w):
    return L.run_summaries(_summary_files(w)[0])


@query("tracker_summary_values", "A5 L3", duckdb_query("""
select 'run-' || id as run_dir, m as metric, cast(case m when 'loss' then 0.5 when 'step' then id when 'acc' then 1 else 1000 end as double) as value
from sessions, (values (0, 'loss'), (0, 'step'), (1, 'acc'), (5, 'big')) v(k, m) where id % 6 = k"""))
def _(w):
    return L.summary_values(_summary_files(w)[0])


@query("broken_summaries", "A5", duckdb_query("""
select 'run-' || id as run_dir, '{"broken": ' as text from sessions where id % 6 = 3"""))
def _(w):
    return _summary_files(w)[1]


@query("summarised_runs", "A5 L3", duckdb_query("""
select 'run-' || id as run_dir, case when id % 4 > 0 then 'r' || id end as tracker_run, case when id % 6 = 0 and id % 4 = 0 then cast(id as double) end as runtime_seconds from sessions"""))
def _(w):
    runs = w.sessions.selectExpr("concat('run-', id) as run_dir", "if(id % 4 > 0, concat('r', id), null) as tracker_run")
    return L.with_run_summaries(runs, _summary_files(w)[0]).select("run_dir", "tracker_run", "runtime_seconds")


@query("hashed_files", "A4", """
select 'd' || doc_id || '.txt' as name, cast(strlen(text) as bigint) as size, sha256(text) as sha256, md5(text) as md5, sha1(text) as sha1 from documents where text is not null""")
def _(w):
    folder = _folder(w, "files")
    T.write_texts(w.base("documents").where("text is not null").selectExpr("concat(doc_id % 10, '/d', doc_id, '.txt') as path", "text"), folder)
    found = T.hash_files(w.spark, folder, ["sha256", "md5", "sha1"])
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "size", "sha256", "md5", "sha1")


# Job details: metadata with all that a report shows.
def _detailed(w: World):
    jobs = w.jobs.withColumn("many", F.expr("transform(sequence(1, cast(id % 40 + 1 as int)), k -> named_struct('key', concat('pkg', lpad(k, 2, '0')), 'value', concat('1.', id % 7)))"))
    gpu = "transform(sequence(1, cast(id % 3 as int)), k -> named_struct('name', concat('gpu', k), 'memory_mb', cast(k * 1000 as string), 'compute_cap', '8.0'))"
    meta = f"""to_json(named_struct('packages', map('pip', map_from_entries(many)), 'cwd', concat('/work/', session_id), 'runtime', named_struct('hostname', concat('h', id % 5),
      'os', map('system', 'Linux'), 'python', map('version', concat('3.', id % 4)), 'cpu', named_struct('model', 'c', 'count', cast(id % 64 as int)), 'memory', named_struct('total_mb', id % 1000),
      'cuda', map('cuda_version', if(id % 3 > 0, '12.1', null)), 'gpu', if(id % 3 > 0, {gpu}, null), 'env_vars', map('HOME', concat('/home/', id), 'LANG', 'C'))))"""
    return jobs.withColumn("metadata", F.expr(f"if(id % 11 = 0, '{{broken', {meta})"))


@query("job_package_lists", "D17", duckdb_query("""
select id as job_id, 'pip' as manager, cast(id % 40 + 1 as bigint) as package_count, 'pkg' || lpad(k::varchar, 2, '0') as name, '1.' || id % 7 as version
from jobs, unnest(range(1, least(id % 40 + 1, 15) + 1)) u(k) where id % 11 > 0"""))
def _(w):
    return D.job_packages(_detailed(w))


@query("job_runtimes", "D17", duckdb_query("""
select id as job_id, '/work/' || session_id as cwd, 'h' || id % 5 as hostname, 'Linux' as os, '3.' || id % 4 as python, 'c' as cpu_model, cast(id % 64 as int) as cpu_count,
       id % 1000 as memory_mb, case when id % 3 > 0 then '12.1' end as cuda_version, case when id % 3 > 0 then cast(id % 3 as int) end as gpus
from jobs where id % 11 > 0"""))
def _(w):
    return D.job_runtime(_detailed(w)).where("cwd is not null")


@query("job_gpus", "D17", duckdb_query("""
select id as job_id, cast(k as int) as index, 'gpu' || k + 1 as name, (k + 1) * 1000 || '' as memory_mb, '8.0' as compute_cap from jobs, unnest(range(id % 3)) u(k) where id % 11 > 0"""))
def _(w):
    return D.job_gpus(_detailed(w))


@query("job_environments", "D17", duckdb_query("""
select id as job_id, v.name, case v.name when 'HOME' then '/home/' || id else 'C' end as value from jobs, (values ('HOME'), ('LANG')) v(name) where id % 11 > 0"""))
def _(w):
    return D.job_environment(_detailed(w))


@query("job_telemetry", "D17 L8", duckdb_query("""
select id as job_id, n as name, 'https://x/' || id || case n when 'wandb' then '' else '/' || k end as url from jobs, (values ('wandb', 0), ('neptune', 1), ('neptune', 2)) v(n, k)
where id % 5 in (0, 1) and (n = 'wandb' or id % 5 = 1)"""))
def _(w):
    one, more = "'wandb', concat('https://x/', id)", "'neptune', array(concat('https://x/', id, '/1'), concat('https://x/', id, '/2'))"
    jobs = w.jobs.withColumn("telemetry", F.expr(
        f"case id % 5 when 0 then to_json(named_struct({one})) when 1 then to_json(named_struct({one}, {more})) when 2 then '{{broken' when 3 then '[]' end"))
    return D.job_telemetry(jobs)


# Secrets inside the metadata: the command stands in it too, and a variable that is always blanked.
@query("redacted_lineage_metadata", "K13 K8", duckdb_query("""
select id, t as command, case when id % 3 = 0 then '{"n": ' || id || '}' else '{"runtime": {"command": "' || t || '", "env_vars": {"GITHUB_TOKEN": "[REDACTED]", "HOME": "/h"}}, "n": ' || id || '}' end as metadata
from redacted""", *chain("select id, command as t from jobs")))
def _(w):
    jobs = w.jobs.withColumn("metadata", F.expr("""if(id % 3 = 0, concat('{"n": ', id, '}'),
      concat('{"runtime": {"command": "', command, '", "env_vars": {"GITHUB_TOKEN": "x', id, '", "HOME": "/h"}}, "n": ', id, '}'))"""))
    return K.redact_lineage(jobs).select("id", "command", "metadata")
