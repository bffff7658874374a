"""Queries over session graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators.dag import SessionGraph
from strandline.plans.registry import query
from strandline.sources.derived import World, duckdb_query


def graph(w: World) -> SessionGraph:
    return SessionGraph(w.jobs, w.inputs, w.outputs, w.artifacts)


LATEST = """latest as (
  select * from jobs qualify row_number() over (partition by session_id, step_number order by timestamp desc, id desc) = 1)"""
MADE = "made as (select l.session_id, l.step_number, l.id as job_id, o.artifact_id, o.path from latest l join job_outputs o on o.job_id = l.id)"
USED = "used as (select l.session_id, l.step_number, l.id as job_id, i.artifact_id, i.path from latest l join job_inputs i on i.job_id = l.id)"
CURRENT = """cur as (
  select session_id, path, step_number as producer_step, artifact_id as current_artifact from made
  qualify row_number() over (partition by session_id, path order by step_number desc, artifact_id desc) = 1)"""
DEPS = """deps as (
  select u.session_id, u.step_number, c.producer_step, u.path, u.artifact_id as consumed_artifact, c.current_artifact
  from used u join cur c on c.session_id = u.session_id and c.path = u.path and c.producer_step < u.step_number)"""
DIRECT = "direct as (select distinct session_id, step_number from deps where consumed_artifact <> current_artifact)"
STALE = """stale as (
  select session_id, step_number from direct
  union
  select d.session_id, d.step_number from deps d join stale s on s.session_id = d.session_id and s.step_number = d.producer_step)"""
BASE = (LATEST, MADE, USED, CURRENT, DEPS, DIRECT, STALE)

# Expanded view: all runs are shown.
ALLDEPS = """alldeps as (
  select j.session_id, j.id as job_id, j.step_number, c.producer_step
  from jobs j join job_inputs i on i.job_id = j.id
  join cur c on c.session_id = j.session_id and c.path = i.path and c.producer_step < j.step_number)"""
OLDER = "older as (select distinct session_id, step_number from jobs where id not in (select id from latest))"
SPREAD = """spread as (
  select session_id, step_number from older
  union
  select d.session_id, d.step_number from alldeps d join spread s on s.session_id = d.session_id and s.step_number = d.producer_step)"""
TAKEN = "taken as (select * from spread except select * from older)"
EXPANDED = (*BASE, ALLDEPS, OLDER, SPREAD, TAKEN)


def _tracked(deps: str, taken: bool) -> tuple[str, ...]:
    """CTEs of the artifact states; ``deps`` names the dependency rows of the shown nodes."""
    state = "case when k.step_number is not null then 'superseded' when s.step_number is not null then 'stale' else 'active' end" \
        if taken else "case when s.step_number is not null then 'stale' else 'active' end"
    join = "left join taken k on k.session_id = l.session_id and k.step_number = l.step_number" if taken else ""
    return (
        """tracked as (
  select session_id, artifact_id, path, step_number as producer_step from made
  qualify row_number() over (partition by session_id, artifact_id order by step_number desc, path desc) = 1)""",
        """consumers as (
  select distinct t.session_id, t.artifact_id, u.step_number as consumer_step
  from tracked t join used u on u.session_id = t.session_id and u.artifact_id = t.artifact_id and t.producer_step < u.step_number)""",
        """heads as (
  select session_id, path, artifact_id as head from (select session_id, path, artifact_id, min(step_number) as first_step from made group by all)
  qualify row_number() over (partition by session_id, path order by first_step desc, artifact_id desc) = 1)""",
        f"""states as (
  select l.session_id, l.step_number as producer_step, {state} as step_state, s.step_number is not null as is_stale,
         not exists (select 1 from {deps} d where d.session_id = l.session_id and d.producer_step = l.step_number) as is_terminal
  from latest l left join stale s on s.session_id = l.session_id and s.step_number = l.step_number {join})""",
        """arts as (
  select t.session_id, t.artifact_id, t.path, t.artifact_id as hash, t.producer_step, s.is_stale,
         case when h.head <> t.artifact_id or s.step_state = 'superseded' then 'superseded'
              when s.step_state = 'stale' then 'stale'
              when n.consumers is null and not s.is_terminal then 'orphaned' else 'active' end as state,
         s.is_terminal, coalesce(n.consumers, 0) as consumers,
         case when h.head <> t.artifact_id then h.head end as superseded_by, s.step_state
  from tracked t join states s using (session_id, producer_step)
  join heads h using (session_id, path)
  left join (select session_id, artifact_id, count(*) as consumers from consumers group by all) n using (session_id, artifact_id))""",
    )


ARTS = (*BASE, *_tracked("deps", False))
ARTS_EXPANDED = (*EXPANDED, *_tracked("alldeps", True))


@query("latest_runs", "G1", duckdb_query("select session_id, step_number, id, timestamp from latest", LATEST))
def _(w):
    return graph(w).latest.select("session_id", "step_number", "id", "timestamp")


@query("current_artifacts", "G2", duckdb_query("select * from cur", *BASE))
def _(w):
    return graph(w).current


@query("step_dependencies", "G3", duckdb_query("select distinct session_id, step_number, producer_step from deps", *BASE))
def _(w):
    return graph(w).dependencies.select("session_id", "step_number", "producer_step").distinct()


@query("directly_stale_steps", "G4", duckdb_query("select * from direct", *BASE))
def _(w):
    return graph(w).directly_stale


@query("stale_steps", "G5", duckdb_query("select * from stale", *BASE))
def _(w):
    return graph(w).stale


@query("stale_artifacts", "G6", duckdb_query(
    "select m.session_id, m.step_number, m.artifact_id, m.path from made m join stale s using (session_id, step_number)", *BASE))
def _(w):
    return graph(w).stale_artifacts


DOWNSTREAM = """downstream as (
  select distinct m.session_id, m.step_number as source_step, u.step_number
  from made m join used u on u.session_id = m.session_id and u.artifact_id = m.artifact_id and u.step_number <> m.step_number)"""


@query("downstream_steps", "G7", duckdb_query("select * from downstream", *BASE, DOWNSTREAM))
def _(w):
    return graph(w).downstream


@query("stale_upstream_steps", "G8", duckdb_query("""
select distinct u.session_id, u.step_number, j.step_number as upstream_step
from used u join stale s using (session_id, step_number)
join job_outputs o on o.artifact_id = u.artifact_id join jobs j on j.id = o.job_id and j.session_id = u.session_id
join stale t on t.session_id = j.session_id and t.step_number = j.step_number""", *BASE))
def _(w):
    return graph(w).stale_upstream


@query("stale_downstream_steps", "G9", duckdb_query(
    "select d.* from downstream d join stale s using (session_id, step_number)", *BASE, DOWNSTREAM))
def _(w):
    return graph(w).stale_downstream


_METRICS = """
       (select count(*) from job_inputs i where i.job_id = n.id) as inputs,
       (select count(*) from job_outputs o where o.job_id = n.id) as outputs,
       (select count(*) from alldeps d where d.job_id = n.id) as consumed,
       (select count(distinct producer_step) from alldeps d where d.job_id = n.id) as dependencies"""


@query("dag_nodes", "G10 G11", duckdb_query(f"""
select n.session_id, n.step_number, n.id as job_id, n.job_uid, n.command,
       case when s.step_number is not null then 'stale' else 'active' end as state,
       coalesce(n.job_type = 'build', false) as is_build, n.exit_code, {_METRICS}
from latest n left join stale s using (session_id, step_number)""", *EXPANDED))
def _(w):
    return graph(w).nodes()


@query("stale_only_nodes", "G10 G17", duckdb_query("""
select n.session_id, n.step_number, case when n.step_number % 3 > 0 then 'step ' || n.step_number end as step_name, n.id as job_id, 'stale' as state
from latest n join stale s using (session_id, step_number)""", *EXPANDED))
def _(w):
    named = w.jobs.withColumn("step_name", F.expr("if(step_number % 3 > 0, concat('step ', step_number), null)"))
    nodes = SessionGraph(named, w.inputs, w.outputs, w.artifacts).nodes(stale_only=True)
    return nodes.select("session_id", "step_number", "step_name", "job_id", "state")


@query("dag_nodes_expanded", "G10 G11 G12", duckdb_query(f"""
select n.session_id, n.step_number, n.id as job_id, n.job_uid, n.command,
       case when k.step_number is not null then 'superseded'
            when n.id not in (select id from latest) then 'superseded'
            when s.step_number is not null then 'stale' else 'active' end as state,
       coalesce(n.job_type = 'build', false) as is_build, n.exit_code, {_METRICS}
from jobs n left join stale s using (session_id, step_number) left join taken k using (session_id, step_number)""", *EXPANDED))
def _(w):
    return graph(w).nodes(expanded=True)


@query("superseded_steps", "G12", duckdb_query("select * from taken", *EXPANDED))
def _(w):
    return graph(w).superseded_steps


@query("leaf_steps", "G13", duckdb_query("""
select session_id, step_number from latest l
where not exists (select 1 from deps d where d.session_id = l.session_id and d.producer_step = l.step_number)""", *BASE))
def _(w):
    return graph(w).leaf_steps()


@query("artifact_consumers", "G14", duckdb_query("select * from consumers", *ARTS))
def _(w):
    return graph(w).consumers


_ART_COLS = "session_id, artifact_id, path, hash, producer_step, is_stale, state, is_terminal, consumers, superseded_by"


@query("artifact_states", "G15 G16", duckdb_query(f"select {_ART_COLS} from arts", *ARTS))
def _(w):
    return graph(w).artifact_view(w.hashes, show_artifacts=True)


@query("artifact_states_expanded", "G12 G15 G16", duckdb_query(f"select {_ART_COLS} from arts", *ARTS_EXPANDED))
def _(w):
    return graph(w).artifact_view(w.hashes, expanded=True, show_artifacts=True)


@query("terminal_artifacts", "G17", duckdb_query(f"select {_ART_COLS} from arts where is_terminal", *ARTS))
def _(w):
    return graph(w).artifact_view(w.hashes)


@query("stale_only_artifacts", "G17", duckdb_query(
    f"select {_ART_COLS} from arts where state in ('stale', 'superseded')", *ARTS))
def _(w):
    return graph(w).artifact_view(w.hashes, show_artifacts=True, stale_only=True)


def _summary(ctes):
    return duckdb_query("""
select l.session_id, l.total_steps, coalesce(s.n, 0) as stale_count,
       coalesce(a.st, 0) as stale_artifact_count, coalesce(a.su, 0) as superseded_artifact_count
from (select session_id, count(*) as total_steps from latest group by all) l
left join (select session_id, count(*) as n from stale group by all) s using (session_id)
left join (select session_id, cast(count(*) filter (step_state = 'stale') as bigint) as st,
                  cast(count(*) filter (state = 'superseded') as bigint) as su from arts group by all) a using (session_id)""", *ctes)


@query("dag_summary", "G18", _summary(ARTS))
def _(w):
    return graph(w).summary(w.hashes)


@query("dag_summary_expanded", "G18", _summary(ARTS_EXPANDED))
def _(w):
    return graph(w).summary(w.hashes, expanded=True)


@query("dag_children", "G19", duckdb_query("""
select distinct session_id, producer_step as step_number, job_id as child_job, step_number as child_step
from alldeps where job_id in (select id from latest)""", *EXPANDED))
def _(w):
    return graph(w).children()


@query("dag_roots", "G19", duckdb_query("""
select session_id, step_number, id as job_id from latest
where id not in (select job_id from alldeps)""", *EXPANDED))
def _(w):
    return graph(w).roots()


# The same sessions with fewer paths, so that several steps write one path: later steps take over,
# earlier artifacts are superseded and most of a session depends on most of it.
def _shared(column: str) -> str:
    return (f"concat('p/', split_part({column}, '/', 2), '/', cast(split_part({column}, '/', 3) as int) % 3, "
            f"'/', split_part({column}, '/', 4))")


def shared_graph(w: World) -> SessionGraph:
    path = F.expr(_shared("path"))
    return SessionGraph(w.jobs, w.inputs.withColumn("path", path), w.outputs.withColumn("path", path), w.artifacts)


def _share(ctes: tuple[str, ...]) -> tuple[str, ...]:
    swaps = {"o.path from latest": f"{_shared('o.path')} as path from latest", "i.path from latest": f"{_shared('i.path')} as path from latest",
             "c.path = i.path": f"c.path = {_shared('i.path')}"}
    out = []
    for cte in ctes:
        for old, new in swaps.items():
            cte = cte.replace(old, new)
        out.append(cte)
    return tuple(out)


@query("shared_path_stale_steps", "G2 G3 G4 G5", duckdb_query("select * from stale", *_share(BASE)))
def _(w):
    return shared_graph(w).stale


@query("shared_path_artifact_states", "G14 G15 G16", duckdb_query(f"select {_ART_COLS} from arts", *_share(ARTS)))
def _(w):
    return shared_graph(w).artifact_view(w.hashes, show_artifacts=True)


@query("shared_path_dag_summary_expanded", "G12 G18", _summary(_share(ARTS_EXPANDED)))
def _(w):
    return shared_graph(w).summary(w.hashes, expanded=True)


@query("superseded_artifacts", "G16", duckdb_query(
    "select session_id, artifact_id, superseded_by from arts where superseded_by is not null", *_share(ARTS)))
def _(w):
    return shared_graph(w).artifact_states(w.hashes).where(F.col("superseded_by").isNotNull()).select(
        "session_id", "artifact_id", "superseded_by")
