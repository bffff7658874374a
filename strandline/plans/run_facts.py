"""Queries over files, processes, syscalls and trackers of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import files as I
from strandline.operators import process as J
from strandline.operators import telemetry as L
from strandline.plans.registry import query
from strandline.sources.derived import duckdb_query

# Fixed values, written out once more so that the SQL does not lean on the lists it checks.
SYSTEM_READS = ["/sys/", "/etc/", "/sbin/", "/proc/", "/dev/", "/usr/", "/opt/", "/lib/", "/lib64/"]
COMPILE_CACHES = ["/tmp/torchinductor_", "/tmp/torch_", "/tmp/triton"]
WRITE_NOISE = ["/dev/", "/proc/", "/sys/", "/dev/shm/", "/usr/local/", "/usr/lib/", "/usr/share/", "/opt/"]
SIMPLE_WRITE_NOISE = [*WRITE_NOISE, "/etc/", "/lib/", "/lib64/", "/tmp/"]
SHARED_LIBRARY_DIRS = ["/usr/lib", "/lib", "/usr/lib64", "/lib64", "/usr/local/lib"]
SYSTEM_FILES = ["/usr/lib", "/usr/lib64", "/lib", "/lib64", "/usr/share", "/etc", "/usr/local/lib", "/opt"]
LIBRARY_READS = ["/lib/", "/lib64/", "/usr/lib/", "/usr/lib64/"]
CODE_EXTENSIONS = [".py", ".so", ".pyx", ".pxd", ".c", ".cpp", ".h", ".hpp", ".rs", ".go"]
CLASSES = ["repo", "package", "stdlib", "system", "unmanaged", "external", "skip"]

# Files of runs: every third has a library name, some lie in the environment of the run.
_FILE_SQL = """
select job_id as run_id, dir, case when job_id % 7 = 3 then concat('/usr/lib/x', bytes % 5, '.so.1')
         when job_id % 7 = 4 and dir = 'out' then concat('/tmp/', path) when job_id % 7 = 5 then concat('/dev/', bytes % 3)
         when job_id % 7 = 6 then concat('/opt/py/lib/m', bytes % 5, '.py') else path end as path,
       concat('/work/p', session_id % 25) as repo_root, concat('/work/p', session_id % 25, '/.venv') as sys_prefix,
       '/opt/py' as sys_base_prefix, '/opt/py/lib/m1' as tool_dir
from {run_files}"""


def _files(w):
    return w.spark.sql(_FILE_SQL, run_files=w.run_files)


FILES = (
    f"files as ({_FILE_SQL.replace('{run_files}', 'run_files')})",
    "reads as (select * from files where dir = 'in')",
    "writes as (select * from files where dir = 'out')",
    "inventory as (select distinct path from files where length(path) % 5 > 0)",
    "tracked as (select distinct repo_root, path from files where length(path) % 3 > 0)",
    "pkgfiles as (select distinct path, 'dist' || (length(path) % 4) as package from files where contains(path, 'site-packages') and length(path) % 2 = 0)",
)


def _reads(w):
    return _files(w).where("dir = 'in'")


def _writes(w):
    return _files(w).where("dir = 'out'")


def _any(column, values):
    return "(" + " or ".join(f"starts_with({column}, '{v}')" for v in values) + ")"


_PKG = "(contains(path, 'site-packages') or starts_with(path, sys_prefix) or starts_with(path, sys_base_prefix))"
_KEEP_READ = f"not {_any('path', SYSTEM_READS + COMPILE_CACHES)} and not {_PKG} and not starts_with(path, '/tmp/')"
_KEEP_WRITE = f"not {_any('path', [*WRITE_NOISE, '/etc/', *COMPILE_CACHES])} and not contains(path, '/.provenance/') and not ends_with(path, '.pyc')"


@query("kept_reads", "I1", duckdb_query(f"select run_id, path from reads where {_KEEP_READ}", *FILES))
def _(w):
    return I.keep_reads(_reads(w)).select("run_id", "path")


@query("kept_reads_with_packages", "I1", duckdb_query(f"select run_id, path from reads where not {_any('path', SYSTEM_READS)}", *FILES))
def _(w):
    return I.keep_reads(_reads(w), packages=False, caches=False, tmp=False).select("run_id", "path")


@query("kept_writes", "I2", duckdb_query(f"select run_id, path from writes where {_KEEP_WRITE} and not starts_with(path, '/tmp/')", *FILES))
def _(w):
    return I.keep_writes(_writes(w)).select("run_id", "path")


@query("unread_tmp_files", "I3", duckdb_query(f"""
select distinct run_id, path from writes w where starts_with(path, '/tmp/') and {_KEEP_WRITE}
and not exists (select 1 from reads r where r.run_id = w.run_id and r.path = w.path)""", *FILES))
def _(w):
    return I.unread_tmp_files(_reads(w), _writes(w))


@query("noise_flags", "I4", duckdb_query(f"""
select distinct path, {_any('path', SYSTEM_READS + COMPILE_CACHES)} or contains(path, 'site-packages') or ends_with(path, '.pyc') as read_noise,
  {_any('path', SIMPLE_WRITE_NOISE)} or ends_with(path, '.pyc') as write_noise from files""", *FILES))
def _(w):
    return _files(w).select("path", I.is_noise_read(F.col("path")).alias("read_noise"), I.is_noise_write(F.col("path")).alias("write_noise")).distinct()


_IN_REPO = "starts_with(f.path, f.repo_root || '/') and not contains(f.path, '.venv') and not contains(f.path, 'site-packages')"
CLASSIFIED = f"""classified as (
  select f.run_id, f.path, f.dir, case when i.path is null then 'skip' when starts_with(f.path, f.tool_dir) then 'skip'
      when {_any('f.path', ['/dev/', '/proc/'])} then 'external'
      when {_IN_REPO} then case when t.path is not null then 'repo' else 'unmanaged' end
      when p.package is not null or contains(f.path, 'site-packages') then 'package'
      when contains(f.path, '.so') and {_any('f.path', SHARED_LIBRARY_DIRS)} then 'system'
      when starts_with(f.path, '/opt/py/') then 'stdlib' when starts_with(f.path, f.sys_prefix || '/') then 'package'
      when {_any('f.path', SYSTEM_FILES)} or (contains(f.path, '.so') and (contains(f.path, '/lib') or contains(f.path, '/usr'))) then 'system' else 'unmanaged' end as class,
    coalesce(p.package, 'unknown') as owner
  from files f left join inventory i on i.path = f.path left join tracked t on t.path = f.path and t.repo_root = f.repo_root
  left join pkgfiles p on p.path = f.path)"""


def _classified(w):
    files = _files(w)
    inventory = files.where("length(path) % 5 > 0").select("path")
    tracked = files.where("length(path) % 3 > 0").select("repo_root", "path")
    packages = files.where("contains(path, 'site-packages') and length(path) % 2 = 0").selectExpr("path", "concat('dist', length(path) % 4) as package")
    return I.classify(files, inventory, tracked, packages)


@query("classified_files", "I5", duckdb_query(
    "select run_id, path, class, case when class = 'package' then owner end as package from classified", *FILES, CLASSIFIED))
def _(w):
    return _classified(w).select("run_id", "path", "class", "package")


@query("class_counts", "I6 E8", duckdb_query(
    "select run_id, " + ", ".join(f"count(*) filter (class = '{c}') as {c}" for c in CLASSES) + " from classified group by run_id", *FILES, CLASSIFIED))
def _(w):
    return I.class_counts(_classified(w))


@query("classified_packages", "I6", duckdb_query(
    "select distinct run_id, owner as package, case owner when 'dist1' then 'unknown' else 'v' || owner end as version from classified where class = 'package' and owner <> 'unknown'", *FILES, CLASSIFIED))
def _(w):
    versions = _classified(w).where("package <> 'dist1'").selectExpr("package", "concat('v', package) as version").distinct()
    return I.classified_packages(_classified(w), versions)


@query("version_control_class", "I7", duckdb_query("""
select f.run_id, f.path, case when starts_with(f.path, f.repo_root || '/') then case when t.path is not null then 'tracked' else 'untracked' end
  when contains(f.path, 'site-packages') then 'site-package' else 'external' end as class
from files f left join tracked t on t.path = f.path and t.repo_root = f.repo_root""", *FILES))
def _(w):
    files = _files(w)
    return I.version_control_class(files, files.where("length(path) % 3 > 0")).select("run_id", "path", "class")


@query("all_run_files", "I8", duckdb_query("select distinct run_id, path from files", *FILES))
def _(w):
    return I.all_files(_reads(w), _writes(w))


_CODE = "(contains(path, '.so.') or " + " or ".join(f"ends_with(path, '{e}')" for e in CODE_EXTENSIONS) + ")"


@query("data_inputs", "I9", duckdb_query(f"""
select distinct run_id, path from reads r where not ends_with(path, '.pyc') and not {_any('path', LIBRARY_READS)}
and not exists (select 1 from classified c where c.run_id = r.run_id and c.path = r.path and c.class = 'repo' and {_CODE.replace('path', 'c.path')})""", *FILES, CLASSIFIED))
def _(w):
    return I.data_inputs(_reads(w), _classified(w))


@query("unmanaged_code", "I10", duckdb_query(
    f"select run_id, path from classified where class = 'unmanaged' and not ends_with(path, '.pyc') and {_CODE}", *FILES, CLASSIFIED))
def _(w):
    return I.unmanaged_code(_classified(w))


_LIB_SQL = """
select job_id as run_id, concat('/work/p', session_id % 25, '/.venv') as sys_prefix, case job_id % 6
    when 0 then concat('/x/site-packages/Py-Lib', bytes % 3, '/a.so') when 1 then concat('/x/site-packages/nvidia/cu', bytes % 3, '/a.so')
    when 2 then concat('/x/site-packages/scipy.libs/b', bytes % 3, '.so') when 3 then concat('/work/p', session_id % 25, '/.venv/lib/c.so')
    when 4 then concat('/usr/lib/lib', bytes % 7, '.so') else concat('/proc/', bytes % 7) end as path
from {io}"""
LIBS = (
    f"libs as ({_LIB_SQL.replace('{io}', 'io')})",
    "attributed as (select run_id, path, case when contains(path, 'site-packages') or starts_with(path, sys_prefix || '/') then 'pip' when starts_with(path, '/usr/lib/lib') and path < '/usr/lib/lib5' then 'dpkg' end as manager, "
    "case when contains(path, 'Py-Lib') then replace(string_split(path, '/')[4], 'Py-Lib', case when string_split(path, '/')[4] = 'Py-Lib0' then 'Py-Lib' else 'py_lib' end) "
    "when contains(path, 'nvidia') then 'nvidia-' || string_split(path, '/')[5] when contains(path, 'scipy') then 'scipy' "
    "when starts_with(path, '/usr/lib/lib') and path < '/usr/lib/lib5' then 'pkg' || substr(path, 13, 1) end as package from libs where not starts_with(path, '/proc/'))",
)


def _libraries(w):
    return w.spark.sql(_LIB_SQL, io=w.io)


def _attributed(w):
    libs = _libraries(w)
    installed = libs.select("run_id").distinct().select("run_id", F.explode(F.array(F.lit("py_lib1"), F.lit("py_lib2"))).alias("name"))
    owners = libs.where("startswith(path, '/usr/lib/lib') and path < '/usr/lib/lib5'").selectExpr("path", "concat('pkg', substr(path, 13, 1)) as package").distinct()
    return I.attribute_libraries(libs, installed, owners)


@query("attributed_libraries", "I13 I14", duckdb_query("select run_id, path, manager, package, manager is not null as managed from attributed", *LIBS))
def _(w):
    return _attributed(w)


@query("system_packages", "I15", duckdb_query("select distinct run_id, package, '1.' || package as version from attributed where manager = 'dpkg'", *LIBS))
def _(w):
    versions = _attributed(w).where("manager = 'dpkg'").selectExpr("package", "concat('1.', package) as version").distinct()
    return I.system_packages(_attributed(w), versions)


_MODULES = """
select job_id as run_id, case bytes % 4 when 0 then concat('/v/site-packages/numpy/core', bytes % 3, '.py') when 1 then '/v/site-packages/six.py'
   when 2 then concat('/v/site-packages/local', bytes % 2, '/x.py') else '/v/site-packages/_hidden.py' end as path from {io}"""


def _used(w):
    modules = w.spark.sql(_MODULES, io=w.io)
    dirs = modules.where("contains(path, 'numpy') or contains(path, 'six')").selectExpr(
        "case when contains(path, 'numpy') then 'numpy' else 'six' end as top_dir", "case when contains(path, 'numpy') then 'NumPy' else 'six' end as package").distinct()
    installed = modules.where("run_id % 2 = 0 or contains(path, 'numpy')").selectExpr(
        "run_id", "case when contains(path, 'numpy') then 'NumPy' else 'six' end as package", "'1' as version").distinct()
    return I.used_packages(modules, dirs, installed)


USED = (f"modules as ({_MODULES.replace('{io}', 'io')})", """used as (
  select distinct run_id, case when contains(path, 'numpy') then 'NumPy' when contains(path, 'six') then 'six' else string_split(path, '/')[4] end as package,
         case when contains(path, 'local') then null else '1' end as version
  from modules m where contains(path, 'numpy') or contains(path, 'local') or (contains(path, 'six') and
    exists (select 1 from modules x where x.run_id = m.run_id and x.run_id % 2 = 0)))""")


@query("used_packages", "I17", duckdb_query("select * from used", *USED))
def _(w):
    return _used(w)


@query("run_packages", "I16", duckdb_query("""
select run_id, 'pip' as manager, package, version from used
union all
select distinct run_id, 'pip', owner, 'v' || owner from classified where class = 'package' and owner <> 'unknown' and run_id not in (select run_id from used)
union all
select distinct run_id, 'dpkg', package, '1.' || package from attributed where manager = 'dpkg'""", *FILES, CLASSIFIED, *LIBS, *USED))
def _(w):
    classified = I.classified_packages(_classified(w), _classified(w).selectExpr("package", "concat('v', package) as version").where("package is not null").distinct())
    attributed = _attributed(w)
    system = I.system_packages(attributed, attributed.where("manager = 'dpkg'").selectExpr("package", "concat('1.', package) as version").distinct())
    return I.run_packages(_used(w), classified, system)


# Tools: the part table names programs.
_TOOL_SQL = """
select id as run_id, '/v' as sys_prefix, split(concat(case id % 9 when 0 then '/usr/bin/gcc' when 1 then 'make' when 2 then '/v/bin/pip3' when 3 then 'uv'
   when 4 then 'cmake' when 5 then 'python' when 6 then '/v/bin/ninja' when 7 then 'maturin' else 'ld' end, ' -x ', step_number), ' ') as command from {jobs}"""


def _tools(w):
    started = w.spark.sql(_TOOL_SQL, jobs=w.jobs)
    locations = started.selectExpr("regexp_extract(command[0], '([^/]*)$', 1) as tool").distinct().selectExpr(
        "tool", "case when tool in ('pip3', 'maturin', 'ninja') then concat('/v/bin/', tool) else concat('/usr/bin/', tool) end as location")
    return started, locations


@query("build_tools", "J1", duckdb_query("""
select id as run_id, case id % 9 when 0 then 'p-gcc' when 1 then 'p-make' else 'p-ld' end as package, '2' as version from jobs where id % 9 in (0, 1, 8)"""))
def _(w):
    started, locations = _tools(w)
    owners = locations.where("tool <> 'cmake'").selectExpr("location as path", "concat('p-', tool) as package")
    return I.build_tools(started, locations, owners, owners.selectExpr("package", "'2' as version"))


@query("python_build_tools", "J2", duckdb_query(
    "select id as run_id, case id % 9 when 2 then 'pip' else 'maturin' end as package, '3' as version from jobs where id % 9 in (2, 7)"))
def _(w):
    started, locations = _tools(w)
    versions = locations.selectExpr("if(tool = 'pip3', 'pip', tool) as package", "'3' as version")
    return I.python_build_tools(started, locations, versions)


# All jobs as one process tree of a single run: process n was started by process n div 3.
PROCESSES = """processes as (
  select 1 as run_id, id as pid, case when id > 0 then id // 3 end as parent_pid, case when id % 5 < 3 then 'a' else job_uid end as command from jobs)"""
HEADS = """heads as (
  select p.pid, p.pid as head from processes p left join processes q on q.pid = p.parent_pid where q.pid is null or q.command <> p.command
  union all
  select p.pid, h.head from heads h join processes p on p.parent_pid = h.pid join processes q on q.pid = p.parent_pid where q.command = p.command)"""


def _processes(w):
    return w.jobs.selectExpr("1 as run_id", "id as pid", "if(id > 0, id div 3, null) as parent_pid", "array(if(id % 5 < 3, 'a', job_uid)) as command")


@query("process_summary", "J3 J5", duckdb_query("""
select p.run_id, p.pid, u.head as parent_node, p.command, (select count(*) from heads f where f.head = p.pid and f.pid <> p.pid) as fork_count
from processes p join heads h on h.pid = p.pid and h.head = p.pid left join heads u on u.pid = p.parent_pid""", PROCESSES, HEADS))
def _(w):
    return J.summarize_processes(_processes(w)).withColumn("command", F.col("command")[0])


@query("root_environment", "J4", duckdb_query("select session_id as run_id, arg_min(git_branch, id) as branch from jobs where id % 3 = 0 group by session_id"))
def _(w):
    processes = w.jobs.selectExpr("session_id as run_id", "id as pid", "if(id % 3 = 0, null, 1) as parent_pid", "map('BRANCH', git_branch) as env")
    return J.root_environment(processes).select("run_id", F.col("env")["BRANCH"].alias("branch"))


@query("run_exit_codes", "J8", duckdb_query("""
select session_id as run_id, cast(arg_max(case when id % 4 = 1 then 128 + cast(id % 31 as int) else exit_code end, (timestamp, id)) as int) as exit_code
from jobs where id % 3 = 0 and case when id % 4 = 1 then 1 else exit_code end is not null group by session_id"""))
def _(w):
    exits = w.jobs.where("if(id % 4 = 1, 1, exit_code) is not null").selectExpr(
        "session_id as run_id", "id as pid", "timestamp as ts", "exit_code as code", "if(id % 4 = 1, cast(id % 31 as int), null) as signal")
    processes = w.jobs.selectExpr("session_id as run_id", "id as pid", "if(id % 3 = 0, null, 1) as parent_pid")
    return J.exit_codes(exits, processes)


def _syscalls(w):
    return w.syscalls.selectExpr("pid % 10 as run_id", "pid", "unix_micros(cast(ts as timestamp)) as ts", "event_id as seq", "syscall", "fd", "path")


_SETS = """
select run_id, path, bool_or(touch = 'openat') as opened, bool_or(touch = 'read') as read, bool_or(touch in ('write', 'rename')) as written from (
  select run_id, syscall as touch, last_value(case when syscall = 'openat' then path end ignore nulls) over (partition by run_id, pid, fd order by ts, seq) as path
  from {log} where syscall in ('openat', 'read', 'write')
  union all select run_id, syscall, path from {log} where syscall = 'rename')
where path is not null and touch <> 'inherit' group by run_id, path"""
LOG = "log as (select pid % 10 as run_id, pid, epoch_us(ts) as ts, event_id as seq, syscall, fd, path from syscalls)"


@query("syscall_file_sets", "J6", duckdb_query(_SETS.format(log="log"), LOG))
def _(w):
    return J.file_sets(_syscalls(w))


# Every process forks a child after a third of its time and a grandchild after two thirds; some
# of the later events belong to them.
FORKED = (
    """spans as (select user_id, (min(epoch_us(ts)) * 2 + max(epoch_us(ts))) // 3 as f1, (min(epoch_us(ts)) + max(epoch_us(ts)) * 2) // 3 as f2 from events group by user_id)""",
    """flog as (select pid % 10 as run_id, case when event_id % 7 = 3 and epoch_us(ts) > f2 then 2000000 + pid when event_id % 3 = 2 and epoch_us(ts) > f1 then 1000000 + pid else pid end as pid,
  epoch_us(ts) as ts, event_id as seq, syscall, fd, path from syscalls join spans on user_id = pid)""",
    """forks as (
  select user_id % 10 as run_id, user_id as pid, 1000000 + user_id as child_pid, f1 as ts from spans
  union all
  select user_id % 10, 1000000 + user_id, 2000000 + user_id, f2 from spans)""",
    """opens0 as (select run_id, pid, fd, ts, seq, path from flog where syscall = 'openat')""",
    """opens1 as (select * from opens0 union all select k.run_id, k.child_pid, o.fd, k.ts, -1, arg_max(o.path, (o.ts, o.seq))
  from forks k join opens0 o on o.run_id = k.run_id and o.pid = k.pid and o.ts <= k.ts where k.pid < 1000000 group by all)""",
    """opens2 as (select * from opens1 union all select k.run_id, k.child_pid, o.fd, k.ts, -1, arg_max(o.path, (o.ts, o.seq))
  from forks k join opens1 o on o.run_id = k.run_id and o.pid = k.pid and o.ts <= k.ts where k.pid >= 1000000 group by all)""",
    """allrows as (
  select run_id, pid, fd, ts, seq, syscall as touch, case when syscall = 'openat' then path end as path from flog where syscall in ('openat', 'read', 'write')
  union all select run_id, pid, fd, ts, seq, 'inherit', path from opens2 where seq = -1)""",
)


@query("forked_file_sets", "J7", duckdb_query("""
select run_id, path, bool_or(touch = 'openat') as opened, bool_or(touch = 'read') as read, bool_or(touch in ('write', 'rename')) as written from (
  select run_id, touch, last_value(path ignore nulls) over (partition by run_id, pid, fd order by ts, seq) as path from allrows
  union all select run_id, syscall, path from flog where syscall = 'rename')
where path is not null and touch <> 'inherit' group by run_id, path""", *FORKED))
def _(w):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = w.base("events").withColumn("us", us).groupBy(F.col("user_id").alias("pid")).agg(F.min("us").alias("lo"), F.max("us").alias("hi")).selectExpr(
        "pid", "(lo * 2 + hi) div 3 as f1", "(lo + hi * 2) div 3 as f2")
    log = w.syscalls.withColumn("us", us).join(spans, "pid").selectExpr(
        "pid % 10 as run_id", """case when event_id % 7 = 3 and us > f2 then 2000000 + pid when event_id % 3 = 2 and us > f1 then 1000000 + pid else pid end as pid""",
        "us as ts", "event_id as seq", "syscall", "fd", "path")
    forks = spans.selectExpr("pid % 10 as run_id", "pid", "1000000 + pid as child_pid", "f1 as ts", "cast(-1 as bigint) as seq").unionByName(
        spans.selectExpr("pid % 10 as run_id", "1000000 + pid as pid", "2000000 + pid as child_pid", "f2 as ts", "cast(-1 as bigint) as seq"))
    return J.file_sets(log, forks)


# As before, but the grandchild forks a process that gets the child's pid again, three quarters into the time.
REFORKED = (
    """spans as (select user_id, (min(epoch_us(ts)) * 3 + max(epoch_us(ts))) // 4 as f1, (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 as f2,
  (min(epoch_us(ts)) + max(epoch_us(ts)) * 3) // 4 as f3 from events group by user_id having max(epoch_us(ts)) > min(epoch_us(ts)) + 8)""",
    """rlog as (select pid % 10 as run_id, pid as user_id, case when event_id % 7 = 3 and epoch_us(ts) > f2 then 'b' when event_id % 3 = 2 and epoch_us(ts) > f3 then 'c'
    when event_id % 3 = 2 and epoch_us(ts) > f1 then 'a' else 'u' end as gen, epoch_us(ts) as ts, event_id as seq, syscall, fd, path from syscalls join spans on user_id = pid)""",
    """opens0 as (select user_id, gen, fd, ts, seq, path from rlog where syscall = 'openat')""",
    """opens1 as (select * from opens0 union all select o.user_id, 'a', o.fd, f1, -1, arg_max(o.path, (o.ts, o.seq)) from spans join opens0 o using (user_id) where o.gen = 'u' and o.ts <= f1 group by all)""",
    """opens2 as (select * from opens1 union all select o.user_id, 'b', o.fd, f2, -1, arg_max(o.path, (o.ts, o.seq)) from spans join opens1 o using (user_id) where o.gen = 'a' and o.ts <= f2 group by all)""",
    """opens3 as (select * from opens2 union all select o.user_id, 'c', o.fd, f3, -1, arg_max(o.path, (o.ts, o.seq)) from spans join opens2 o using (user_id) where o.gen = 'b' and o.ts <= f3 group by all)""",
    """allrows as (
  select run_id, user_id, gen, fd, ts, seq, syscall as touch, case when syscall = 'openat' then path end as path from rlog where syscall in ('openat', 'read', 'write')
  union all select user_id % 10, user_id, gen, fd, ts, seq, 'inherit', path from opens3 where seq = -1)""",
)


def reforked_events(w) -> tuple:
    """A log in which pids are used again, and its forks."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = w.base("events").withColumn("us", us).groupBy(F.col("user_id").alias("pid")).agg(F.min("us").alias("lo"), F.max("us").alias("hi")).where("hi > lo + 8").selectExpr(
        "pid", "(lo * 3 + hi) div 4 as f1", "(lo + hi) div 2 as f2", "(lo + hi * 3) div 4 as f3")
    log = w.syscalls.withColumn("us", us).join(spans, "pid").selectExpr(
        "pid % 10 as run_id", "case when event_id % 7 = 3 and us > f2 then 2000000 + pid when event_id % 3 = 2 and us > f1 then 1000000 + pid else pid end as pid",
        "us as ts", "event_id as seq", "syscall", "fd", "path")
    parts = [("pid", "1000000 + pid", "f1"), ("1000000 + pid", "2000000 + pid", "f2"), ("2000000 + pid", "1000000 + pid", "f3")]
    forks = [spans.selectExpr("pid % 10 as run_id", f"{up} as pid", f"{child} as child_pid", f"{at} as ts", "cast(-1 as bigint) as seq") for up, child, at in parts]
    return log, forks[0].unionByName(forks[1]).unionByName(forks[2])


@query("reforked_file_sets", "J7", duckdb_query("""
select run_id, path, bool_or(touch = 'openat') as opened, bool_or(touch = 'read') as read, bool_or(touch in ('write', 'rename')) as written from (
  select run_id, touch, last_value(path ignore nulls) over (partition by user_id, gen, fd order by ts, seq) as path from allrows
  union all select run_id, syscall, path from rlog where syscall = 'rename')
where path is not null and touch <> 'inherit' group by run_id, path""", *REFORKED))
def _(w):
    return J.file_sets(*reforked_events(w))


@query("resolved_paths", "J9", duckdb_query("""
select event_id, case when path is null then null when event_id % 2 = 0 then path else '/home/u' || pid || path end as path from syscalls"""))
def _(w):
    calls = w.syscalls.selectExpr("event_id", "concat('/home/u', pid) as cwd", "if(event_id % 2 = 0, path, concat('./', substr(path, 2))) as path")
    return J.resolve_paths(calls).select("event_id", "path")


# Trackers.
_TRACK_SQL = """
select job_id as run_id, bytes as position, concat('/work/p', session_id % 25, '/', case job_id % 6 when 0 then concat('wandb/run-2024-', bytes % 9, '/files/x')
   when 1 then concat('mlruns/', bytes % 4, '/', {md5}, '/artifacts/m') when 2 then concat('.neptune/async/', bytes % 3) when 3 then concat('logs/runs/events.out.tfevents.', bytes % 3)
   when 4 then 'mlruns/x' else path end) as path from {io} where dir = 'out'"""
TRACKS = (f"tracks as ({_TRACK_SQL.replace('{io}', 'io').replace('{md5}', 'md5(cast(bytes as varchar))')})",)
_DETECTED = """detected as (
  select distinct run_id, t.tracker from tracks, (values ('wandb', 'wandb/'), ('wandb', '.wandb'), ('mlflow', 'mlruns/'), ('mlflow', 'mlartifacts/'), ('neptune', '.neptune/'),
    ('tensorboard', '/runs/'), ('tensorboard', 'events.out.tfevents')) t(tracker, part) where contains(path, t.part))"""


def _tracks(w):
    return w.spark.sql(_TRACK_SQL.replace("{md5}", "md5(cast(bytes as string))"), io=w.io)


@query("detected_trackers", "L1", duckdb_query("select * from detected", *TRACKS, _DETECTED))
def _(w):
    return L.detected_trackers(_tracks(w))


@query("ignore_patterns", "L2", duckdb_query("""
select distinct run_id, p.pattern from detected join (values ('wandb', 'wandb/*'), ('wandb', '*.wandb'), ('mlflow', 'mlruns/*'), ('mlflow', 'mlartifacts/*'), ('neptune', '.neptune/*')) p(tracker, pattern) using (tracker)""", *TRACKS, _DETECTED))
def _(w):
    return L.ignore_patterns(L.detected_trackers(_tracks(w)))


def _environment(w):
    return w.jobs.selectExpr("id as run_id", """map_filter(map('WANDB_ENTITY', git_branch, 'WANDB_PROJECT', concat('p', session_id % 25), 'MLFLOW_TRACKING_URI', concat('http://ml/', id % 3, '/'),
      'NEPTUNE_PROJECT', concat('ws/', session_id % 25)), (k, v) -> id % 4 > 0) as env""")


WANDB_RUNS = duckdb_query("""
select r.run_id, r.base, d.tracker_run, case when d.url is null and id % 4 > 0 then 'p' || (session_id % 25) else d.project end as project,
       case when d.url is null and id % 4 > 0 then git_branch else d.entity end as entity, d.url
from (select distinct run_id, regexp_extract(path, '^(.*?wandb/)', 1) as base from tracks where contains(path, 'wandb/')) r
join jobs j on j.id = r.run_id
left join (select base, arg_max(run_dir, (mtime, run_dir)) as run_dir from dirs group by base) n on n.base = r.base
left join meta d on d.run_dir = n.run_dir""", *TRACKS,
    "dirs as (select distinct regexp_extract(path, '^(.*?wandb/)', 1) as base, regexp_extract(path, '^(.*?wandb/[^/]*)', 1) as run_dir, position % 10 as mtime from tracks where contains(path, 'wandb/'))",
    """meta as (select distinct run_dir, right(run_dir, 1) as tracker_run, 'proj' as project, case when ends_with(run_dir, '8') then null else 'team' end as entity,
  case when ends_with(run_dir, '8') then null else 'https://wandb.ai/team/proj/runs/' || right(run_dir, 1) end as url from dirs)""")


@query("wandb_runs", "L3", WANDB_RUNS)
def _(w):
    return _wandb_runs(w)


@query("wandb_runs_linked", "L3", WANDB_RUNS.replace("(mtime, run_dir)", "(right(run_dir, 1) = '3', mtime, run_dir)"))
def _(w):
    return _wandb_runs(w, linked="right(run_dir, 1) = '3'")


def _wandb_runs(w, linked=None):
    tracks = _tracks(w)
    dirs = tracks.where("contains(path, 'wandb/')").selectExpr(
        "regexp_extract(path, '^(.*?wandb/)', 1) as base", "regexp_extract(path, '^(.*?wandb/[^/]*)', 1) as run_dir", "position % 10 as mtime").distinct()
    meta = dirs.selectExpr("run_dir", "right(run_dir, 1) as run_id_text", "'proj' as project", "if(endswith(run_dir, '8'), null, 'team') as entity").distinct()
    if linked:
        dirs = dirs.withColumn("linked", F.expr(linked))
    return L.wandb_runs(tracks, dirs, meta, _environment(w))


@query("mlflow_runs", "L4", duckdb_query(r"""
select t.run_id, regexp_extract(path, 'mlruns/(\d+)/([a-f0-9]{32})/', 1) as experiment_id, regexp_extract(path, 'mlruns/(\d+)/([a-f0-9]{32})/', 2) as tracker_run,
  case when j.id % 4 > 0 then 'http://ml/' || (j.id % 3) || '/' end as tracking_uri,
  case when j.id % 4 > 0 then 'http://ml/' || (j.id % 3) || '/#/experiments/' || regexp_extract(path, 'mlruns/(\d+)/([a-f0-9]{32})/', 1) || '/runs/' || regexp_extract(path, 'mlruns/(\d+)/([a-f0-9]{32})/', 2) end as url
from (select run_id, arg_min(path, (position, path)) as path from tracks where regexp_matches(path, 'mlruns/(\d+)/([a-f0-9]{32})/') group by run_id) t join jobs j on j.id = t.run_id""", *TRACKS))
def _(w):
    return L.mlflow_runs(_tracks(w), _environment(w))


@query("neptune_runs", "L5", duckdb_query("""
select t.run_id, case when j.id % 4 > 0 then 'ws/' || (session_id % 25) end as project, d.tracker_run,
  case when j.id % 4 > 0 then 'https://app.neptune.ai/ws/' || (session_id % 25) || '/runs/' || d.tracker_run end as url
from (select distinct run_id, regexp_extract(path, '^(.*?\\.neptune/)', 1) as base from tracks where contains(path, '.neptune/')) t join jobs j on j.id = t.run_id
left join (select regexp_extract(path, '^(.*?\\.neptune/)', 1) as base, min(right(path, 1)) as tracker_run from tracks where contains(path, '.neptune/') group by 1) d using (base)""".replace("\\\\", "\\"), *TRACKS))
def _(w):
    tracks = _tracks(w)
    dirs = tracks.where("contains(path, '.neptune/')").selectExpr("regexp_extract(path, r'^(.*?\\.neptune/)', 1) as base", "right(path, 1) as run_dir")
    return L.neptune_runs(tracks, dirs, _environment(w))


_JOB_SPANS = "select id as job_id, 'p' || (session_id % 25) as repo_root, cast(timestamp as double) as start, timestamp + duration_seconds * (id % 200) as \"end\" from jobs"
_DIRS = "select 'p' || (session_id % 25) as repo_root, 'run-' || id as run_dir, cast(timestamp + id % 50 - 10 as double) as ctime, command as text from jobs"


@query("matched_run_dirs", "L6", duckdb_query(
    f"select j.job_id, d.run_dir from ({_JOB_SPANS}) j join ({_DIRS}) d on d.repo_root = j.repo_root and d.ctime between j.start - 5 and j.\"end\" + 5"))
def _(w):
    jobs = w.jobs.selectExpr("id as job_id", "concat('p', session_id % 25) as repo_root", "cast(timestamp as double) as start", "timestamp + duration_seconds * (id % 200) as end")
    dirs = w.jobs.selectExpr("concat('p', session_id % 25) as repo_root", "concat('run-', id) as run_dir", "cast(timestamp + id % 50 - 10 as double) as ctime")
    return L.match_run_dirs(jobs, dirs)


@query("log_run_urls", "L7", duckdb_query("""
select doc_id as run_dir, 'team' as entity, source as project, cast(doc_id as varchar) as tracker_run, 'https://wandb.ai/team/' || source || '/runs/' || doc_id as url
from documents where doc_id % 2 = 0 and source is not null"""))
def _(w):
    logs = w.base("documents").selectExpr("doc_id as run_dir", "concat(text, if(doc_id % 2 = 0, concat('\n finishing run team/', source, '/', doc_id, ' done'), '')) as text", "source")
    return L.log_run_urls(logs.drop("source"))


@query("telemetry_links", "L8", duckdb_query(f"""
select job_id, 'wandb' as provider, 'u' || d.run_dir as url, count(*) over (partition by job_id) as links
from ({_JOB_SPANS}) j join ({_DIRS}) d on d.repo_root = j.repo_root and d.ctime between j.start - 5 and j.\"end\" + 5 where right(d.run_dir, 1) <> '3'"""))
def _(w):
    jobs = w.jobs.selectExpr("id as job_id", "concat('p', session_id % 25) as repo_root", "cast(timestamp as double) as start", "timestamp + duration_seconds * (id % 200) as end")
    dirs = w.jobs.selectExpr("concat('p', session_id % 25) as repo_root", "concat('run-', id) as run_dir", "cast(timestamp + id % 50 - 10 as double) as ctime")
    urls = dirs.selectExpr("run_dir", "if(endswith(run_dir, '3'), null, concat('u', run_dir)) as url")
    return L.telemetry_links(jobs, dirs, urls)
