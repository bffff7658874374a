"""Process trees and syscall logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.paths import resolve_relative
from strandline.scale import fill_forward, is_empty, materialize, materialize_counted

# Syscalls by what they do to a file.
OPENS = ["open", "openat"]
READS = ["read", "pread64", "readv", "preadv", "preadv2"]
WRITES = ["write", "pwrite64", "writev", "pwritev", "pwritev2"]
RENAMES = ["rename", "renameat", "renameat2"]


def fork_heads(processes: DataFrame) -> DataFrame:
    """(run_id, pid, head): the nearest ancestor-or-self that runs another command than its parent.

    Pointers double every round, so a chain of n forks takes log n joins. Processes whose parents lead into a cycle
    (pids that were used again) have no such ancestor and are heads themselves.
    """
    parents = processes.select("run_id", F.col("pid").alias("parent_pid"), F.col("command").alias("_above"))
    joined = processes.join(parents, ["run_id", "parent_pid"], "left")
    same = F.coalesce(F.col("command") == F.col("_above"), F.lit(False))
    state = materialize(
        joined.select("run_id", "pid", F.when(same, F.col("parent_pid")).otherwise(F.col("pid")).alias("head"), (~same).alias("done")),
        "forks",
    )
    settled, open_ = state.where("done"), state.where(~F.col("done"))
    reach, processes_left = 1, state.count()
    while not is_empty(open_):
        if reach > processes_left:
            settled = settled.unionByName(open_.withColumn("head", F.col("pid")))
            break
        reach *= 2
        hop = settled.unionByName(open_).select(
            "run_id", F.col("pid").alias("head"), F.col("head").alias("_next"), F.col("done").alias("_next_done")
        )
        moved = materialize(
            open_.join(hop, ["run_id", "head"]).select("run_id", "pid", F.col("_next").alias("head"), F.col("_next_done").alias("done")),
            "forks",
        )
        settled, open_ = settled.unionByName(moved.where("done")), moved.where(~F.col("done"))
    return settled.select("run_id", "pid", "head")


def summarize_processes(processes: DataFrame) -> DataFrame:
    """One row per command node: fork-only descendants are counted, exec children keep their place.

    ``processes``: (run_id, pid, parent_pid, command). A node's parent is the head of its parent
    process, null for roots.
    """
    heads = materialize(fork_heads(processes), "heads")
    forks = heads.where(F.col("pid") != F.col("head")).groupBy("run_id", "head").agg(F.count(F.lit(1)).alias("fork_count"))
    nodes = processes.join(heads.where(F.col("pid") == F.col("head")).select("run_id", "pid"), ["run_id", "pid"], "left_semi")
    above = heads.select("run_id", F.col("pid").alias("parent_pid"), F.col("head").alias("parent_node"))
    return (
        nodes.join(above, ["run_id", "parent_pid"], "left")
        .join(forks.withColumnRenamed("head", "pid"), ["run_id", "pid"], "left")
        .select("run_id", "pid", "parent_node", "command", F.coalesce("fork_count", F.lit(0).cast("bigint")).alias("fork_count"))
    )


def root_environment(processes: DataFrame) -> DataFrame:
    """(run_id, env) of the first root process; ``processes`` has pid, parent_pid and env."""
    roots = processes.where(F.col("parent_pid").isNull())
    return roots.groupBy("run_id").agg(F.min_by("env", "pid").alias("env"))


def exit_codes(exits: DataFrame, processes: DataFrame) -> DataFrame:
    """Exit code of every run: the last exit of its root, 128 + signal when killed.

    ``exits``: (run_id, pid, ts, code, signal).
    """
    roots = processes.where(F.col("parent_pid").isNull()).select("run_id", "pid")
    code = F.when(F.col("signal").isNotNull(), F.lit(128) + F.col("signal")).otherwise(F.col("code"))
    return exits.join(roots, ["run_id", "pid"], "left_semi").groupBy("run_id").agg(
        F.max_by(code, F.struct("ts", "pid")).alias("exit_code")
    )


def resolve_paths(syscalls: DataFrame) -> DataFrame:
    """Paths made absolute against the process's working directory ``cwd``."""
    return syscalls.withColumn("path", resolve_relative(F.col("path"), F.col("cwd")))


def _column(df: DataFrame, name: str, default) -> F.Column:
    return F.col(name) if name in df.columns else F.lit(default)


def descriptor_touches(syscalls: DataFrame) -> DataFrame:
    """(run_id, pid, fd, ts, seq, path, touch): one row per descriptor a syscall opens or uses."""
    call = F.col("syscall")
    fd = F.col("fd")
    other = _column(syscalls, "fd2", None).cast("int")
    prot = _column(syscalls, "prot", 0).cast("int")
    flags = _column(syscalls, "flags", 0).cast("int")
    ok = F.coalesce(_column(syscalls, "ret", 0).cast("bigint"), F.lit(0).cast("bigint")) >= 0

    def touch(when, kind: str, descriptor, path=None):
        return F.when(
            when,
            F.struct(
                F.lit(kind).alias("touch"), descriptor.cast("int").alias("fd"),
                (F.lit(None).cast("string") if path is None else path).alias("path"),
            ),
        )

    mapped = (call == "mmap") & (fd >= 0)
    touches = F.array_compact(
        F.array(
            touch(call.isin(OPENS) & ok & F.col("path").isNotNull(), "open", fd, F.col("path")),
            touch(call.isin(READS), "read", fd),
            touch(call.isin(WRITES), "write", fd),
            touch(call == "sendfile", "read", other),
            touch(call == "sendfile", "write", fd),
            touch(call == "copy_file_range", "read", fd),
            touch(call == "copy_file_range", "write", other),
            touch(mapped & (prot.bitwiseAND(F.lit(1)) != 0), "read", fd),
            touch(mapped & (flags.bitwiseAND(F.lit(1)) != 0) & (prot.bitwiseAND(F.lit(2)) != 0), "write", fd),
        )
    )
    return syscalls.select("run_id", "pid", "ts", "seq", F.explode(touches).alias("t")).select(
        "run_id", "pid", "t.fd", "ts", "seq", "t.path", "t.touch"
    )


def generations(touches: DataFrame, forks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``touches`` with the generation ``gen`` of their process, and ``births`` (run_id, gen, up, ts, seq).

    A pid can be used again: a generation is a pid from one fork that made it to the next; before the first it is
    the pid's own. A touch belongs to the generation alive when it happened, and ``up`` is the generation of the
    forking pid that was alive before the fork, so parents are older than their children and no chain of them is a
    cycle, whatever pids they have. Forks at one (ts, seq) follow each other by pid and child.
    """
    name = F.concat_ws(":", "pid", "ts", "seq", "by")
    nothing = F.lit(None)
    forks = forks.select("run_id", "pid", "child_pid", "ts", "seq").distinct()
    born = forks.select("run_id", F.col("child_pid").alias("pid"), "ts", "seq", F.col("pid").alias("by"), F.col("child_pid").alias("made"))
    rows = born.select("run_id", "pid", "ts", "seq", F.lit(0).alias("late"), "by", "made", F.lit(1).alias("kind"), name.alias("mark"))
    asked = forks.select("run_id", "pid", "ts", "seq", F.lit(0).alias("late"), F.col("pid").alias("by"), F.col("child_pid").alias("made"), F.lit(0).alias("kind"), nothing.cast("string").alias("mark"))
    seen = touches.select("run_id", "pid", "ts", "seq", F.lit(1).alias("late"), F.lit(0).cast("bigint").alias("by"), F.lit(0).cast("bigint").alias("made"), F.lit(2).alias("kind"), nothing.cast("string").alias("mark"), "fd", "path", "touch")
    timeline = seen.unionByName(rows, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    dated = fill_forward(timeline, ["run_id", "pid"], ["ts", "seq", "late", "by", "made", "kind"], "mark", "alive")
    dated = materialize(dated.withColumn("gen", F.coalesce("alive", F.concat(F.col("pid").cast("string"), F.lit(":")))), "generations")
    births = dated.where("kind = 0").select(
        "run_id", F.concat_ws(":", "made", "ts", "seq", "by").alias("gen"), F.col("gen").alias("up"), "ts", "seq"
    )
    return dated.where("kind = 2").select("run_id", "gen", "fd", "ts", "seq", "path", "touch"), births


def _looked_up(opens: DataFrame, questions: DataFrame, births: DataFrame) -> DataFrame:
    """(run_id, gen, fd, up, found): what ``fd`` was in the parent when ``gen`` was born; null if it had no open of it."""
    nothing = F.lit(None)
    asked = questions.join(births, ["run_id", "gen"]).select(
        "run_id", F.col("up").alias("at"), "fd", "ts", "seq", F.lit(1).alias("late"), nothing.cast("string").alias("path"), F.col("gen").alias("origin")
    )
    known = opens.select("run_id", F.col("gen").alias("at"), "fd", "ts", "seq", F.lit(0).alias("late"), "path", nothing.cast("string").alias("origin"))
    looked = fill_forward(known.unionByName(asked), ["run_id", "at", "fd"], ["ts", "seq", "late", "origin"], "path", "found").where("origin is not null")
    return materialize(looked.select("run_id", F.col("origin").alias("gen"), "fd", F.col("at").alias("up"), "found"), "looked")


def _inherited(opens: DataFrame, lost: DataFrame, births: DataFrame) -> DataFrame:
    """(run_id, gen, fd, inherited): what a descriptor meant in the parent when it forked, or in the nearest ancestor.

    Most questions end at the parent. For the others all ancestors are listed by pointers that double every
    round, all are asked at once, and the answers come down by doubling again: a chain of n forks takes
    about 2 log n joins.
    """
    first = _looked_up(opens, lost.select("run_id", "gen", "fd").distinct(), births)
    hits = first.where("found is not null").select("run_id", "gen", "fd", F.col("found").alias("inherited"))
    open_ = first.where("found is null").select("run_id", "gen", "fd", "up")
    if is_empty(open_):
        return hits
    chain, jump = open_.select("run_id", F.col("up").alias("gen"), "fd").distinct(), births.select("run_id", "gen", "up")
    while True:
        leap = jump.select("run_id", F.col("gen").alias("up"), F.col("up").alias("_over"))
        chain = materialize(chain.unionByName(chain.join(jump, ["run_id", "gen"]).select("run_id", F.col("up").alias("gen"), "fd")).distinct(), "ancestors")
        jump, rows = materialize_counted(jump.join(leap, ["run_id", "up"]).select("run_id", "gen", F.col("_over").alias("up")), "jumps")
        if not rows:
            break
    asked = _looked_up(opens, chain, births)
    settled, waiting = asked.where("found is not null").select("run_id", "gen", "fd", "found"), asked.where("found is null").select("run_id", "gen", "fd", "up")
    while True:
        # Who waits for one that is settled is settled; who waits for another takes over what that one waits for.
        above = settled.select("run_id", "gen", "fd", "found", F.lit(None).cast("string").alias("next")).unionByName(
            waiting.select("run_id", "gen", "fd", F.lit(None).cast("string").alias("found"), F.col("up").alias("next"))
        ).withColumnRenamed("gen", "up")
        moved, rows = materialize_counted(waiting.join(above, ["run_id", "up", "fd"]), "answers")
        if not rows:
            break
        settled = settled.unionByName(moved.where("found is not null").select("run_id", "gen", "fd", "found"))
        waiting = moved.where("found is null").select("run_id", "gen", "fd", F.col("next").alias("up"))
    answers = open_.join(settled.select("run_id", F.col("gen").alias("up"), "fd", "found"), ["run_id", "up", "fd"])
    return hits.unionByName(answers.select("run_id", "gen", "fd", F.col("found").alias("inherited")))


def _bound(touches: DataFrame, forks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Touches with the path they mean (``bound``), what was opened by generation, and the births."""
    touches, births = generations(touches, forks)
    key = ["run_id", "gen", "fd"]
    bound = materialize(fill_forward(touches, key, ["ts", "seq"], "path", "bound"), "bound")
    opens = touches.where(F.col("touch").isin("open", "held"))
    inherited = _inherited(opens, bound.where(F.col("bound").isNull()), births)
    return bound.join(inherited, key, "left").withColumn("bound", F.coalesce("bound", "inherited")), opens, births


def _sets(bound: DataFrame, syscalls: DataFrame) -> DataFrame:
    renamed = syscalls.where(F.col("syscall").isin(RENAMES) & F.col("path").isNotNull()).select(
        "run_id", F.col("path").alias("bound"), F.lit("write").alias("touch")
    )
    used = bound.where(F.col("bound").isNotNull() & (F.col("touch") != "held")).select("run_id", "bound", "touch").unionByName(renamed)
    return used.groupBy("run_id", F.col("bound").alias("path")).agg(
        F.bool_or(F.col("touch") == "open").alias("opened"),
        F.bool_or(F.col("touch") == "read").alias("read"),
        F.bool_or(F.col("touch") == "write").alias("written"),
    )


def file_sets(syscalls: DataFrame, forks: DataFrame | None = None) -> DataFrame:
    """(run_id, path, opened, read, written) from a syscall log.

    ``syscalls``: (run_id, pid, ts, seq, syscall, fd, path[, fd2, prot, flags, ret]); an open binds
    (pid, fd) to its path until the next open; close does not. ``forks``: (run_id, pid, child_pid,
    ts, seq) lets children see the descriptors of their parent at the fork; a pid that is used again
    begins anew.
    """
    touches = descriptor_touches(syscalls)
    if forks is None:
        return _sets(fill_forward(touches, ["run_id", "pid", "fd"], ["ts", "seq"], "path", "bound"), syscalls)
    return _sets(_bound(touches, forks)[0], syscalls)


def continued_file_sets(syscalls: DataFrame, forks: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``file_sets`` of events that go on from a known state, and the state after them.

    ``held``: (run_id, pid, fd, ts, seq, path), what each living pid's descriptors mean at a moment before all of
    the run's events. The state after is (run_id, pid, fd, path): of each pid its last generation, with
    what it opened and what it has from its ancestors.
    """
    touches = descriptor_touches(syscalls).unionByName(
        held.select("run_id", "pid", "fd", "ts", "seq", "path", F.lit("held").alias("touch"))
    )
    bound, opens, births = _bound(touches, forks)
    made = F.split_part("gen", F.lit(":"), F.lit(1)).cast("bigint")
    last = births.groupBy("run_id", made.alias("pid")).agg(F.max_by("gen", F.struct("ts", "seq", "gen")).alias("gen"))
    seen = opens.select("run_id", "gen").distinct().withColumn("pid", made)
    # A pid's own generation is the last one where no fork made another.
    first = seen.where(F.col("gen").endswith(":")).join(last.select("run_id", "pid"), ["run_id", "pid"], "left_anti")
    alive = materialize(last.unionByName(first.select("run_id", "pid", "gen")), "alive")
    own = opens.groupBy("run_id", "gen", "fd").agg(F.max_by("path", F.struct("ts", "seq")).alias("path"))
    asked = last.select("run_id", "gen").join(opens.select("run_id", "fd").distinct(), "run_id").join(own, ["run_id", "gen", "fd"], "left_anti")
    from_above = _inherited(opens, asked, births).withColumnRenamed("inherited", "path")
    after = own.unionByName(from_above.select("run_id", "gen", "fd", "path")).join(alive, ["run_id", "gen"])
    return _sets(bound, syscalls), after.select("run_id", "pid", "fd", "path")
