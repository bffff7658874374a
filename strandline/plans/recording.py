"""Queries that turn run facts into lineage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.paths import normal_path
from strandline.functions.references import primary_script
from strandline.operators import record as B
from strandline.plans.registry import query
from strandline.sources.derived import duckdb_query

COMMANDS = """commands as (
  select id, case id % 5 when 0 then command when 1 then 'bash  -x tools/run_' || step_number || '.sh ' || script
    when 2 then ' python -m pkg.mod' || step_number || ' a.py' when 3 then 'make all.py.o -m' else 'ls -l /data' end as command from jobs)"""


@query("command_scripts", "B1", duckdb_query(r"""
select id, list_filter(list_transform(t, lambda x, i: case when ends_with(x, '.py') or ends_with(x, '.sh') then string_split(x, '/')[-1]
       when x = '-m' then t[i + 1] end), lambda x: x is not null)[1] as script
from (select id, string_split_regex(trim(command), '\s+') as t from commands)""", COMMANDS))
def _(w):
    commands = w.jobs.selectExpr("id", """case id % 5 when 0 then command when 1 then 'bash  -x tools/run_' || step_number || '.sh ' || script
    when 2 then ' python -m pkg.mod' || step_number || ' a.py' when 3 then 'make all.py.o -m' else 'ls -l /data' end as command""")
    return commands.select("id", primary_script(F.col("command")).alias("script"))


# Numbered file names give the masking something to do.
def _files(w):
    return w.run_files.selectExpr(
        "job_id", "dir as direction", "concat('/work/p', session_id % 25) as repo_root",
        "concat(path, case job_id % 3 when 0 then concat('-', 1000 + job_id, '/x_', bytes) else '' end) as path")


FILES = r"""files as (
  select job_id, dir as direction, '/work/p' || (session_id % 25) as root,
         path || case job_id % 3 when 0 then '-' || (1000 + job_id) || '/x_' || bytes else '' end as path from run_files),
normals as (
  select job_id, direction, path as raw, regexp_replace(
    case when starts_with(path, root || '/') then substr(path, length(root) + 2)
         when starts_with(path, '/home/u/') then substr(path, 9) else string_split(path, '/')[-1] end,
    '([_-])\d{3,}(\.|$|/)', '\1*\2', 'g') as path from files)"""


@query("normal_paths", "B2 B3", duckdb_query("select * from normals", FILES))
def _(w):
    return _files(w).select(
        "job_id", "direction", F.col("path").alias("raw"),
        normal_path(F.col("path"), F.col("repo_root"), F.lit("/home/u")).alias("path"))


IDENTITIES = (FILES, """idents as (
  select j.id as job_id, j.session_id, j.timestamp, sha256(case when e.job_id is null then 'COMMAND:' || j.script
    else 'INPUTS:' || coalesce(chr(0) || e.ins, '') || chr(0) || 'OUTPUTS:' || coalesce(chr(0) || e.outs, '') end) as step_identity
  from jobs j left join (
    select job_id, string_agg(path, chr(0) order by path) filter (direction = 'in') as ins,
           string_agg(path, chr(0) order by path) filter (direction = 'out') as outs
    from normals group by job_id) e on e.job_id = j.id)""")


# Identities are digests of their own; what must agree is which jobs share one.
@query("step_identities", "B4", duckdb_query("""
select i.job_id, c.first_job, c.jobs from idents i join (
  select step_identity, min(job_id) as first_job, count(*) as jobs from idents group by step_identity) c on c.step_identity = i.step_identity""", *IDENTITIES))
def _(w):
    found = B.step_identities(w.jobs, _files(w), "/home/u")
    classes = found.groupBy("step_identity").agg(F.min("job_id").alias("first_job"), F.count(F.lit(1)).alias("jobs"))
    return found.join(classes, "step_identity").select("job_id", "first_job", "jobs")


# Identity of a job for numbering: its script within a branch.
def _runs(w):
    return w.jobs.selectExpr("session_id", "id as job_id", "timestamp", "sha2(concat(script, git_branch), 256) as step_identity")


@query("step_numbers", "B5", duckdb_query("""
select session_id, step_identity, cast(row_number() over (partition by session_id order by min((timestamp, id))) as int) as step_number
from (select *, sha256(script || git_branch) as step_identity from jobs) group by session_id, step_identity"""))
def _(w):
    return B.number_steps(_runs(w))


@query("step_numbers_appended", "B5 E2", duckdb_query("""
select * from old union all
select session_id, step_identity, cast(row_number() over (partition by session_id order by first) + coalesce((select max(step_number) from old o where o.session_id = f.session_id), 0) as int)
from (select session_id, sha256(script || git_branch) as step_identity, min((timestamp, id)) as first from jobs group by all) f
where not exists (select 1 from old o where o.session_id = f.session_id and o.step_identity = f.step_identity)""", """old as (
  select session_id, sha256(script || git_branch) as step_identity, min(step_number) + 2 as step_number from jobs where exit_code = 0 group by all)"""))
def _(w):
    known = w.jobs.where("exit_code = 0").groupBy(
        "session_id", F.expr("sha2(concat(script, git_branch), 256)").alias("step_identity")
    ).agg((F.min("step_number") + 2).alias("step_number"))
    return B.number_steps(_runs(w), known)


@query("hashable_files", "B6", duckdb_query("""
select job_id, path from run_files where path in (select path from run_files where dir = 'out')"""))
def _(w):
    inventory = w.run_files.where("dir = 'out'")
    return B.hashable_files(w.run_files.select("job_id", "path"), inventory)


@query("artifact_identities", "B7", duckdb_query("""
select artifact_id as digest, left(sha256('sha256:' || artifact_id), 32) as artifact_id, count(*) as sightings from io group by io.artifact_id"""))
def _(w):
    sights = w.io.select(
        F.concat_ws("|", "job_id", "dir", "path", "bytes").alias("sighting_id"), F.lit("sha256").alias("algorithm"),
        F.upper("artifact_id").alias("digest"))
    owners = B.resolve_artifacts(sights)
    return sights.join(owners, "sighting_id").groupBy(F.lower("digest").alias("digest"), "artifact_id").agg(
        F.count(F.lit(1)).alias("sightings"))


# A document is seen under the digest of its text, and of its first line with its length.
_DOC_SIGHTS = """
select doc_id as sighting_id, 'sha256' as algorithm, {sha} as digest from {{documents}}
union all select doc_id, 'md5', md5(concat(source, n_chars)) from {{documents}}"""


@query("artifact_components", "B7", duckdb_query("""
select sighting_id, min(other) as component from comp group by sighting_id""", """sights as (
  select doc_id as sighting_id, 'sha256' as algorithm, sha256(text) as digest from documents
  union all select doc_id, 'md5', md5(concat(source, n_chars)) from documents)""",
    """comp as (
  select distinct sighting_id, sighting_id as other from sights
  union
  select c.sighting_id, b.sighting_id from comp c join sights a on a.sighting_id = c.other
  join sights b on b.algorithm = a.algorithm and b.digest = a.digest)"""))
def _(w):
    sights = w.spark.sql(_DOC_SIGHTS.format(sha="sha2(text, 256)").replace("{{", "{").replace("}}", "}"), documents=w.base("documents"))
    owners = B.resolve_artifacts(sights)
    least = owners.groupBy("artifact_id").agg(F.min("sighting_id").alias("component"))
    return owners.join(least, "artifact_id").select("sighting_id", "component")


@query("known_artifacts", "B7", duckdb_query("""
select artifact_id, bool_and(artifact_id not in (select artifact_id from job_outputs)) as created, count(*) as sightings
from (select distinct artifact_id, job_id, dir, path, bytes from io) group by artifact_id"""))
def _(w):
    sights = w.io.select(
        F.concat_ws("|", "job_id", "dir", "path", "artifact_id", "bytes").alias("sighting_id"), F.lit("sha256").alias("algorithm"),
        F.col("artifact_id").alias("digest"))
    known = w.hashes.join(w.outputs.select("artifact_id").distinct(), "artifact_id", "left_semi")
    owners = B.resolve_artifacts(sights, known)
    # New artifacts get an id of their own; name them by digest to compare.
    return owners.join(sights, "sighting_id").groupBy(F.col("digest").alias("artifact_id")).agg(
        F.bool_and("created").alias("created"), F.count_distinct("sighting_id").alias("sightings"))


@query("first_sightings", "B8", duckdb_query("""
select artifact_id as id, max(bytes) as size, min(timestamp) as first_seen_at, (min((timestamp, job_id, path)))[3] as first_seen_path
from io group by artifact_id"""))
def _(w):
    return B.first_sightings(w.io.withColumnRenamed("bytes", "size"))


@query("new_edges", "B9", duckdb_query("""
select distinct job_id, artifact_id, path from io
except select job_id, artifact_id, path from job_outputs"""))
def _(w):
    return B.new_edges(w.io, w.outputs)


@query("linked_artifacts", "B10", duckdb_query("""
select i.job_id, i.artifact_id, i.path, o.job_id is null as linked
from (select distinct job_id, artifact_id, path from io) i left join job_outputs o using (job_id, artifact_id, path)"""))
def _(w):
    return B.link_artifacts(w.io, w.outputs)


@query("job_rows", "B11", duckdb_query("""
select sha256(session_id || chr(0) || timestamp || chr(0) || job_uid || chr(0) || command) as id,
       left(sha256(session_id || chr(0) || timestamp || chr(0) || job_uid || chr(0) || command), 12) as job_uid, script, command
from jobs"""))
def _(w):
    runs = w.jobs.select("session_id", "timestamp", F.col("job_uid").alias("run_id"), "command")
    return B.job_rows(runs).select("id", "job_uid", "script", "command")


@query("session_commit_range", "B13", duckdb_query("""
select session_id, arg_min(git_commit, (timestamp, id)) as git_commit_start, arg_max(git_commit, (timestamp, id)) as git_commit_end
from jobs where exit_code is not null group by session_id"""))
def _(w):
    jobs = w.jobs.withColumn("git_commit", F.when(F.col("exit_code").isNotNull(), F.col("git_commit")))
    return B.session_commit_range(jobs)


@query("session_current_step", "B14", duckdb_query(
    "select session_id, arg_max(step_number, (timestamp, id)) as current_step from jobs group by session_id"))
def _(w):
    return B.session_current_step(w.jobs)


@query("active_flags", "B15", duckdb_query("""
select id, git_repo, row_number() over (partition by git_repo order by (id * 7919) % 1000 desc, id desc) = 1 as is_active from sessions"""))
def _(w):
    sessions = w.sessions.selectExpr("id", "git_repo", "(id * 7919) % 1000 as activated_at")
    return B.active_flags(sessions).select("id", "git_repo", "is_active")


@query("job_metadata", "B16", duckdb_query("""
select id, '{"packages":{"pip":{"numpy":"' || git_branch || '"}},"runtime":{"hostname":"h' || (id % 7) || '","command":["' || replace(command, ' ', '","') || '"]}'
  || case when exit_code = 0 then '' else ',"cwd":"' || git_repo || '"' end || case when git_branch = 'dev' then ',"env_vars":{"A":"dev"}' else '' end || '}' as metadata
from jobs"""))
def _(w):
    runs = w.jobs.selectExpr(
        "id", "map('pip', map('numpy', git_branch)) as packages",
        "named_struct('hostname', concat('h', id % 7), 'command', split(command, ' ')) as runtime",
        "case when exit_code = 0 then '' else git_repo end as cwd", "map_filter(map('A', git_branch), (k, v) -> v = 'dev') as env_vars")
    return B.assemble_metadata(runs).select("id", "metadata")


@query("edges_without_builds", "B17", duckdb_query("""
select l_orderkey as job_id, l_partkey as part from lineitem where l_orderkey % 10 <> 0"""))
def _(w):
    edges = w.base("lineitem").selectExpr("l_orderkey as job_id", "l_partkey as part")
    return B.without_build_io(edges, w.jobs)


@query("pending_jobs", "A9 H2", """
select sha256('pulled:s' || l_orderkey) as session_hash, 's' || l_orderkey as source_artifact_hash,
       row_number() over (partition by l_orderkey order by l_linenumber, 'step ' || l_partkey) - 1 as position, 'step ' || l_partkey as command,
       case when l_linenumber % 3 = 0 then 1 else cast(l_linenumber as int) end as step_number,
       case when l_partkey % 4 = 0 then 'doc' else 'repo' end as git_repo, 'c' as git_commit,
       case when l_partkey % 5 = 0 then 'build' end as job_type, 'pending' as status from lineitem""")
def _(w):
    # One document per order; its lines, a handful at most, are the jobs.
    jobs = F.array_sort(F.collect_list(F.expr("""named_struct('n', l_linenumber, 'command', concat('step ', l_partkey),
      'step_number', if(l_linenumber % 3 = 0, null, cast(l_linenumber as int)), 'git_repo', if(l_partkey % 4 = 0, '', 'repo'),
      'git_commit', cast(null as string), 'job_type', if(l_partkey % 5 = 0, 'build', null))""")))
    documents = w.base("lineitem").groupBy("l_orderkey").agg(jobs.alias("jobs")).selectExpr(
        "concat('s', l_orderkey) as source_artifact_hash", "'doc' as git_repo", "'c' as git_commit", "jobs")
    return B.pending_jobs(documents)


def _recorded(w, late=None, stored=None):
    """Run facts of the derived jobs; ``late`` picks every session's later or earlier half."""
    keep = "true" if late is None else f"(timestamp div 86400) {'>' if late else '<='} 9000"
    runs = w.jobs.where(keep).selectExpr("job_uid as run_id", "session_id", "timestamp", "command", "git_repo", "git_branch", "duration_seconds", "exit_code", "metadata",
                                         "concat('/work/p', session_id % 25) as repo_root", "git_commit", "job_type")
    files = w.run_files.where(keep).selectExpr("lower(lpad(hex(job_id), 8, '0')) as run_id", "dir as direction", "path", "artifact_id", "bytes as size")
    digests = files.selectExpr("run_id", "path", "'sha256' as algorithm", "artifact_id as digest", "size")
    return B.record_runs(runs, files.select("run_id", "direction", "path").distinct(), digests, "/home/u", stored)


# A recorded file counts once for each run and direction, under the name it has.
RECORDED = (FILES.replace("select job_id, dir as direction", "select distinct job_id, dir as direction").replace(
    " || case job_id % 3 when 0 then '-' || (1000 + job_id) || '/x_' || bytes else '' end as path", ""), IDENTITIES[1], """recorded as (
  select j.session_id, j.timestamp, lower(lpad(hex(j.id), 8, '0')) as run_id, j.id, i.step_identity, j.exit_code, j.git_branch, j.job_type from jobs j join idents i on i.job_id = j.id)""",
    """firsts as (select session_id, step_identity, row_number() over (partition by session_id order by first) as step_number
  from (select session_id, step_identity, min((timestamp, run_id)) as first from recorded group by session_id, step_identity))""")
_RECORDED_ROWS = duckdb_query("""
select row_number() over (order by r.timestamp, r.run_id) as id, r.session_id, cast(f.step_number as int) as step_number, r.exit_code, r.git_branch,
       coalesce(e.ins, 0) as inputs, coalesce(e.outs, 0) as outputs
from recorded r join firsts f on f.session_id = r.session_id and f.step_identity = r.step_identity
left join (select job_id, count(distinct path || artifact_id) filter (dir = 'in') as ins, count(distinct path || artifact_id) filter (dir = 'out') as outs
  from run_files where job_id % 10 <> 0 group by job_id) e on e.job_id = r.id""", *RECORDED)


def _recorded_rows(t):
    n_in = t.job_inputs.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("inputs"))
    n_out = t.job_outputs.groupBy(F.col("job_id").alias("id")).agg(F.count(F.lit(1)).alias("outputs"))
    zero = F.lit(0).cast("bigint")
    return t.jobs.join(n_in, "id", "left").join(n_out, "id", "left").select(
        "id", "session_id", "step_number", "exit_code", "git_branch", F.coalesce("inputs", zero).alias("inputs"), F.coalesce("outputs", zero).alias("outputs"))


@query("recorded_runs", "B12", _RECORDED_ROWS)
def _(w):
    return _recorded_rows(_recorded(w))


@query("recorded_runs_appended", "B12 B7", _RECORDED_ROWS)
def _(w):
    # The earlier runs are written and read back, the later ones appended.
    from strandline.scale import materialize

    early = _recorded(w, late=False)
    fields = ("jobs", "artifacts", "artifact_hashes", "job_inputs", "job_outputs", "sessions")
    stored = B.LineageTables(**{n: materialize(getattr(early, n), n) for n in fields})
    return _recorded_rows(B.with_recording(stored, _recorded(w, late=True, stored=stored)))
