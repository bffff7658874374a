"""Lineage tables derived from the TPC-H-like test tables.

One text per view, rendered for Spark SQL and for DuckDB; the DuckDB rendering is only used to
check results. The views follow the repository's FIXTURES document.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from strandline.scale import materialize
from strandline.session import tune

# Thin projections stay views; the other derived tables are written once per application and
# folder, as the lineage tables they stand for would be.
_VIEWS = {"syscalls", "collections", "artifact_hashes"}
_written: dict[tuple[str, str, str], DataFrame] = {}


class _SparkText:
    @staticmethod
    def sha(x: str) -> str:
        return f"sha2({x}, 256)"

    @staticmethod
    def sec(x: str) -> str:
        return f"unix_seconds(cast({x} as timestamp))"


class _DuckText:
    @staticmethod
    def sha(x: str) -> str:
        return f"sha256({x})"

    @staticmethod
    def sec(x: str) -> str:
        return f"cast(epoch({x}) as bigint)"


def view_texts(d: type) -> dict[str, str]:
    """View name → SQL, in dependency order; ``{name}`` marks a table or an earlier view."""
    path = (
        "concat('p/', session_id, '/', case when l_linenumber <= 2 then step_number "
        "else l_suppkey % step_number end, '/', l_partkey % 2)"
    )
    path_version = (
        path[:-1] + ", ':', case when l_linenumber <= 2 then l_orderkey else l_partkey end % 2)"
    )
    return {
        "jobs": f"""
select id, lower(lpad(hex(id), 8, '0')) as job_uid,
       cast({d.sec("o_orderdate")} as bigint) as timestamp,
       concat('python step_', step_number, '.py --prio=', o_orderpriority,
              case when id % 50 = 7 then ' --api-key=abcdefghijklmnop1234'
                   when id % 50 = 13 then ' MY_TOKEN=abc123'
                   when id % 50 = 29 then ' --from=postgres://u:pw@db/x' else '' end) as command,
       concat('step_', step_number, '.py') as script, session_id, step_number,
       case when id % 10 = 0 then 'build' end as job_type,
       concat('git@github.com:org/p', session_id % 25, '.git') as git_repo,
       {d.sha("concat('commit:', session_id, ':', id % 3)")} as git_commit,
       case when id % 4 = 3 then 'dev' else 'main' end as git_branch,
       cast(id % 7200 as double) / 2 as duration_seconds,
       case o_orderstatus when 'F' then 0 when 'O' then 1 end as exit_code,
       concat('{{"packages":{{"pip":{{"numpy":"1.', id % 3, '"}},"dpkg":{{"libc6":"2.', id % 2, '"}}}}}}') as metadata
from (select cast(o_orderkey as bigint) as id, cast(o_custkey as bigint) as session_id,
             cast((o_orderkey * 7919) % 12 + 1 as int) as step_number, * from <<orders>>) t""",
        "io": f"""
select j.id as job_id, j.session_id, j.timestamp,
       case when l_linenumber <= 2 then 'out' else 'in' end as dir,
       {path} as path, {d.sha(path_version)} as artifact_id,
       cast(floor(l_extendedprice) as bigint) as bytes
from <<lineitem>> l join <<jobs>> j on j.id = l_orderkey
where j.job_type is null""",
        "job_outputs": "select distinct job_id, artifact_id, path from <<io>> where dir = 'out'",
        "job_inputs": "select distinct job_id, artifact_id, path from <<io>> where dir = 'in'",
        "artifacts": """
select artifact_id as id, max(bytes) as size, min(timestamp) as first_seen_at,
       min(path) as first_seen_path
from <<io>> group by artifact_id""",
        "artifact_hashes": """
select id as artifact_id, 'sha256' as algorithm, id as digest from <<artifacts>>
union all select id, 'md5', md5(id) from <<artifacts>>""",
        "sessions": f"""
select cast(c_custkey as bigint) as id, {d.sha("concat('session:', c_custkey)")} as hash,
       concat('git@github.com:org/p', c_custkey % 25, '.git') as git_repo,
       c_custkey % 100 = 1 as is_active
from <<customer>>""",
        "syscalls": """
select event_id, ts, user_id as pid, cast(event_id % 4 as int) as fd,
       case event_type when 'signup' then 'openat' when 'view' then 'read' when 'purchase' then 'write'
                       when 'click' then 'rename' else 'close' end as syscall,
       case when event_type in ('signup', 'click') then concat('/data/f', event_id % 97, '.csv') end as path
from <<events>>""",
        # Regions are parent collections of nations; a nation holds the artifacts of its sessions.
        "collections": """
select concat('r', r_regionkey) as id, r_name as name, concat('s3://bucket/', r_name) as source_url
from <<region>>
union all
select concat('n', n_nationkey), n_name, concat('s3://bucket/nation/', n_name) from <<nation>>""",
        "collection_members": """
select concat('r', n_regionkey) as collection_id, cast(null as string) as artifact_id,
       concat('n', n_nationkey) as child_collection_id, n_name as path_in_collection
from <<nation>>
union all
select distinct concat('n', session_id % 25), artifact_id, cast(null as string), path
from <<io>> where dir = 'out'""",
        # Where a run keeps its files on the machine it ran on.
        "run_files": """
select job_id, session_id, timestamp, dir, artifact_id, bytes,
       concat(case job_id % 8 when 0 then '/usr/lib/' when 1 then '/tmp/torch_' when 2 then '/tmp/'
                   when 3 then concat('/work/p', session_id % 25, '/.venv/lib/python3/site-packages/pkg', job_id % 11, '/')
                   when 4 then '/etc/' when 5 then '/home/u/'
                   else concat('/work/p', session_id % 25, '/') end,
              path, case job_id % 5 when 0 then '.py' when 1 then '.pyc' when 2 then '.so' else '.csv' end) as path
from <<io>>""",
    }


def _render(text: str, name) -> str:
    out, rest = "", text
    while "<<" in rest:
        head, rest = rest.split("<<", 1)
        ref, rest = rest.split(">>", 1)
        out += head + name(ref)
    return out + rest


def duckdb_views() -> str:
    """The views as a ``WITH`` list for DuckDB (the base tables are views there)."""
    texts = view_texts(_DuckText)
    return ",\n".join(f"{k} as ({_render(v, lambda r: r)})" for k, v in texts.items())


def duckdb_query(body: str, *ctes: str) -> str:
    """A DuckDB query over the derived views; ``ctes`` are further ``name as (…)`` entries."""
    return "with recursive " + ",\n".join([duckdb_views(), *ctes]) + "\n" + body


class World:
    """The derived tables of one data folder, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder
        self._views: dict[str, DataFrame] = {}

    def base(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            texts = view_texts(_SparkText)
            refs: dict[str, DataFrame] = {}

            def placeholder(ref: str) -> str:
                refs[ref] = self.view(ref) if ref in texts else self.base(ref)
                return "{" + ref + "}"

            # JSON braces of the text are doubled so that only table names are replaced.
            text = texts[name].replace("{", "{{").replace("}", "}}")
            key = (self.spark.sparkContext.applicationId, self.folder, name)
            if key not in _written:
                derived = self.spark.sql(_render(text, placeholder), **refs)
                _written[key] = derived if name in _VIEWS else materialize(derived, name)
            self._views[name] = _written[key]
        return self._views[name]

    jobs = cached_property(lambda self: self.view("jobs"))
    io = cached_property(lambda self: self.view("io"))
    inputs = cached_property(lambda self: self.view("job_inputs"))
    outputs = cached_property(lambda self: self.view("job_outputs"))
    artifacts = cached_property(lambda self: self.view("artifacts"))
    hashes = cached_property(lambda self: self.view("artifact_hashes"))
    sessions = cached_property(lambda self: self.view("sessions"))
    syscalls = cached_property(lambda self: self.view("syscalls"))
    collections = cached_property(lambda self: self.view("collections"))
    members = cached_property(lambda self: self.view("collection_members"))
    run_files = cached_property(lambda self: self.view("run_files"))
