"""Report files in, reports out, and streams against their batch twins."""

import hashlib
import json

from pyspark.sql import functions as F

from strandline.operators import process as J
from strandline.operators.dag import SessionGraph
from strandline.plans.provenance import build_provenance, provenance_rows
from strandline.sources import tables as T
from strandline.sources.derived import World
from strandline.streaming.live import LiveFileSets, LiveJobs, LiveStaleness, SessionStore

FOLDER = "/root/testdata/sf0.001"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_reports(spark, tmp_path):
    trace = {
        "processes": [{"pid": 1, "parent_pid": None, "command": ["python", "a.py"], "env": {"A": "1"}}, {"pid": 2, "parent_pid": 1, "command": ["gcc"]}],
        "opened_files": ["/repo/a.py", "/repo/a.py", "/repo/d.csv"], "read_files": ["/repo/a.py", "/repo/d.csv", "/etc/x"],
        "written_files": ["/repo/out/wandb/run-1/f", "/tmp/x"], "start_time": 10.0, "end_time": 12.5}
    write(tmp_path / "trace" / "r1.json", json.dumps(trace, indent=1))
    write(tmp_path / "trace" / "r2.json", "{}")
    inject = {"modules_files": ["/v/site-packages/numpy/x.py"], "sys_prefix": "/v", "used_packages": {"numpy": "1"}, "shared_libs": ["/usr/lib/libz.so"], "installed_packages": {"numpy": "1"}}
    write(tmp_path / "inject" / "r1.json", json.dumps(inject))
    write(tmp_path / "inject" / "r2.json", "{broken")
    traces = T.read_trace_reports(spark, str(tmp_path / "trace"))
    rows = {r.run_id: r for r in traces.collect()}
    assert rows["r1"].opened_files == ["/repo/a.py", "/repo/d.csv"] and rows["r2"].written_files == [] and rows["r2"].start_time == 0
    runs = spark.createDataFrame([("r1", "/repo"), ("r2", "/repo"), ("r3", "/repo")], "run_id string, repo_root string")
    injects = T.read_inject_reports(spark, str(tmp_path / "inject"), runs)
    got = {r.run_id: r for r in injects.collect()}
    assert len(got) == 3 and got["r1"].used_packages == {"numpy": "1"} and got["r2"].shared_libs == [] and got["r3"].sys_prefix == ""

    files = spark.createDataFrame([("/repo/a.py",), ("/repo/d.csv",)], "path string")
    record = build_provenance(
        traces, injects, runs, inventory=files, tracked=files.where("path like '%.py'").withColumn("repo_root", F.lit("/repo")),
        package_files=spark.createDataFrame([], "path string, package string"),
        versions=spark.createDataFrame([("dpkg", "zlib", "1.3")], "manager string, package string, version string"),
        owners=spark.createDataFrame([("/usr/lib/libz.so", "zlib")], "path string, package string"))
    assert [r.path for r in record.reads.collect()] == ["/repo/d.csv"]
    assert [r.path for r in record.writes.collect()] == ["/repo/out/wandb/run-1/f"]
    assert {(r.manager, r.package, r.version) for r in record.packages.collect()} == {("pip", "numpy", "1"), ("dpkg", "zlib", "1.3")}
    assert [r.tracker for r in record.trackers.collect()] == ["wandb"]
    assert {r.pid: r.parent_node for r in record.processes.collect()} == {1: None, 2: 1}
    assert record.environment.first().env == {"A": "1"}
    assert {r.run_id: r.start for r in record.timing.collect()} == {"r1": "1970-01-01T00:00:10+00:00", "r2": None}
    T.write_report(provenance_rows(record), str(tmp_path / "out"), "run_id")
    assert spark.read.json(str(tmp_path / "out")).where("section = 'packages'").count() == 2


def test_hashing_and_logs(spark, tmp_path):
    write(tmp_path / "f" / "a.bin", "hello")
    row = T.hash_files(spark, str(tmp_path / "f"), ["sha256", "md5", "sha512"]).first()
    assert (row.sha256, row.md5, row.sha512) == tuple(hashlib.new(a, b"hello").hexdigest() for a in ("sha256", "md5", "sha512"))
    assert row.size == 5
    write(tmp_path / "w" / "run-7" / "logs" / "debug.log", "x\nfinishing run me/proj/abc\n")
    write(tmp_path / "w" / "run-7" / "files" / "wandb-metadata.json", '{"run_id": "abc", "project": "proj"}')
    log = T.read_debug_logs(spark, str(tmp_path / "w")).first()
    assert log.run_dir == "run-7" and "me/proj/abc" in log.text
    meta = T.read_run_metadata(spark, str(tmp_path / "w")).first()
    assert (meta.run_dir, meta.run_id_text, meta.entity) == ("run-7", "abc", None)


def test_lineage_tables_round_trip(spark, tmp_path):
    w = World(spark, FOLDER)
    graph = SessionGraph(w.jobs, w.inputs, w.outputs, w.artifacts)
    T.write_lineage({"job_inputs": w.inputs, "artifact_hashes": w.hashes}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/job_inputs").count() == w.inputs.count()
    T.write_graph_report(graph.nodes(), graph.artifact_view(w.hashes), graph.summary(w.hashes), str(tmp_path / "dag"))
    assert spark.read.json(f"{tmp_path}/dag/summary").count() == graph.summary(w.hashes).count()
    payloads = w.hashes.select(F.col("artifact_id").alias("session_hash"), F.lit(0).alias("batch"), "digest")
    T.write_payloads(payloads, str(tmp_path / "payloads"))
    assert spark.read.parquet(str(tmp_path / "payloads")).count() == payloads.count()


def _events(spark):
    """The syscalls of the test data in three time slices, with forks."""
    w = World(spark, FOLDER)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = w.base("events").withColumn("us", us).groupBy(F.col("user_id").alias("pid")).agg(F.min("us").alias("lo"), F.max("us").alias("hi")).selectExpr(
        "pid", "(lo * 2 + hi) div 3 as f1", "(lo + hi * 2) div 3 as f2")
    log = w.syscalls.withColumn("us", us).join(spans, "pid").selectExpr(
        "pid % 10 as run_id", "case when event_id % 7 = 3 and us > f2 then 2000000 + pid when event_id % 3 = 2 and us > f1 then 1000000 + pid else pid end as pid",
        "us as ts", "event_id as seq", "syscall", "fd", "path", "cast(null as bigint) as child_pid")
    forks = spans.selectExpr("pid % 10 as run_id", "pid", "f1 as ts", "cast(-1 as bigint) as seq", "'fork' as syscall", "cast(null as int) as fd", "cast(null as string) as path", "1000000 + pid as child_pid").unionByName(
        spans.selectExpr("pid % 10 as run_id", "1000000 + pid as pid", "f2 as ts", "cast(-1 as bigint) as seq", "'fork' as syscall", "cast(null as int) as fd", "cast(null as string) as path", "2000000 + pid as child_pid"))
    return log, forks


def test_syscall_stream_equals_batch(spark, tmp_path):
    log, forks = _events(spark)
    want = sorted(map(str, J.file_sets(log.drop("child_pid"), forks).collect()))
    every = log.unionByName(forks)
    lo, hi = every.agg(F.min("ts"), F.max("ts")).first()
    for i in range(3):
        a, b = lo + (hi - lo) * i // 3, lo + (hi - lo) * (i + 1) // 3 + (1 if i == 2 else 0)
        every.where((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.parquet(f"{tmp_path}/src/part={i}")
    live = LiveFileSets(f"{tmp_path}/live")
    for batch, i in enumerate((2, 0, 1)):  # out of order
        live.process(spark.read.schema(every.schema).parquet(f"{tmp_path}/src/part={i}"), batch)
    live.process(spark.read.schema(every.schema).parquet(f"{tmp_path}/src/part=1"), 2)  # a batch run again
    cols = ["run_id", "path", "opened", "read", "written"]
    assert sorted(map(str, live.current(spark).select(*cols).collect())) == want


def test_syscall_stream_runs(spark, tmp_path):
    log, _ = _events(spark)
    log.coalesce(1).write.parquet(f"{tmp_path}/src")
    live = LiveFileSets(f"{tmp_path}/live")
    source = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/src")
    live.start(source, f"{tmp_path}/check").awaitTermination(120)
    assert live.current(spark).count() == J.file_sets(log).count()


def test_live_jobs(spark, tmp_path):
    schema = "event_id bigint, job_uid string, ts bigint, event_time timestamp, session_id bigint, command string, status string, exit_code int, inputs array<struct<artifact_id:string,path:string>>, outputs array<struct<artifact_id:string,path:string>>"
    rows = [
        (1, "u", 1, 7, "run", "running", None, [("a", "/a")], []), (2, "u", 2, None, None, None, None, [("b", "/b"), ("a", "/a")], [("c", "/c")]),
        (2, "u", 2, None, None, None, None, [("b", "/b")], [("c", "/c")]), (3, "u", 3, None, None, "done", 0, [], []), (4, "v", 1, 7, "x", "running", None, [], [])]
    from datetime import datetime

    df = spark.createDataFrame([(*r[:3], datetime(2024, 1, 1), *r[3:]) for r in rows], schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/src")
    live = LiveJobs(f"{tmp_path}/live")
    live.start(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/src"), f"{tmp_path}/check").awaitTermination(120)
    assert {tuple(r) for r in live.jobs(spark).collect()} == {("u", 7, "run", "done", 0), ("v", 7, "x", "running", None)}
    assert {(r.direction, r.artifact_id) for r in live.links(spark).collect()} == {("inputs", "a"), ("inputs", "b"), ("outputs", "c")}


def test_a_late_read_and_late_jobs(spark, tmp_path):
    schema = "run_id bigint, pid bigint, ts bigint, seq bigint, syscall string, fd int, path string, child_pid bigint"
    batches = [[(1, 1, 10, 1, "open", 3, "/a", None), (1, 1, 30, 2, "open", 3, "/b", None)], [(1, 1, 20, 3, "read", 3, None, None)]]
    live = LiveFileSets(f"{tmp_path}/sets")
    for i, rows in enumerate(batches):
        live.process(spark.createDataFrame(rows, schema), i)
    assert {(r.path, r.read) for r in live.current(spark).collect()} == {("/a", True), ("/b", False)}
    events = "event_id bigint, job_uid string, ts bigint, session_id bigint, command string, status string, exit_code int, inputs array<struct<artifact_id:string,path:string>>, outputs array<struct<artifact_id:string,path:string>>"
    for i, ts in enumerate((10**6, 1, 500, 2)):
        spark.createDataFrame([(i, f"u{i}", ts, 1, "c", "done", 0, [], [])], events).coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
    jobs = LiveJobs(f"{tmp_path}/jobs")
    source = spark.readStream.option("maxFilesPerTrigger", 1).schema(events).parquet(f"{tmp_path}/src")
    jobs.start(source, f"{tmp_path}/check").awaitTermination(120)
    assert jobs.jobs(spark).count() == 4


def test_live_staleness(spark, tmp_path):
    w = World(spark, FOLDER)
    want = sorted(map(tuple, SessionGraph(w.jobs, w.inputs, w.outputs, w.artifacts).stale.select("session_id", "step_number").collect()))
    w.jobs.select("id", "session_id").coalesce(1).write.parquet(f"{tmp_path}/src")
    live = LiveStaleness(f"{tmp_path}/live", lambda spark: (w.jobs, w.inputs, w.outputs, w.artifacts))
    source = spark.readStream.schema("id bigint, session_id bigint").parquet(f"{tmp_path}/src")
    live.start(source, f"{tmp_path}/check").awaitTermination(180)
    assert sorted(map(tuple, live.current(spark).select("session_id", "step_number").collect())) == want


def test_live_staleness_reads_the_touched_folders_only(spark, tmp_path):
    w = World(spark, FOLDER)
    store = SessionStore(f"{tmp_path}/lineage", 16)
    store.append(w.jobs, w.inputs, w.outputs, w.artifacts)
    touched = w.jobs.select("session_id").distinct().limit(2)
    mine = [r.session_id for r in touched.collect()]
    touched = spark.createDataFrame([(s,) for s in mine], "session_id bigint")
    jobs, inputs, outputs = store.read(touched)
    for df in (jobs, inputs, outputs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    want = SessionGraph(w.jobs, w.inputs, w.outputs, w.artifacts).stale.where(F.col("session_id").isin(mine))
    live = LiveStaleness(f"{tmp_path}/live", store)
    live.process(touched, 0)
    assert sorted(map(tuple, live.current(spark).collect())) == sorted(map(tuple, want.select("session_id", "step_number").collect()))


def test_live_file_sets_go_on_from_their_state(spark, tmp_path, monkeypatch):
    import random

    from strandline.streaming import live as S
    from test_building_blocks import plain_file_sets

    rng = random.Random(9)
    log, forks = {}, {}
    for run in (1, 2):
        log[run] = [(rng.randrange(5), ts, ts, rng.choice(["open", "read", "read", "write"]), rng.randrange(3), f"/r{run}/f{ts}") for ts in range(1, 150)]
        log[run] = [(p, t, s, c, fd, path if c == "open" else None) for p, t, s, c, fd, path in log[run]]
        forks[run] = [f for f in ((rng.randrange(5), rng.randrange(5), ts, 1000 + ts) for ts in range(3, 150, 5)) if f[0] != f[1]]
    late = (0, 20, 20_000, "open", 1, "/r1/late")
    rows = [(run, p, t, s, "openat" if c == "open" else c, fd, path, None) for run in log for p, t, s, c, fd, path in log[run]]
    rows += [(run, p, t, s, "fork", None, None, child) for run in forks for p, child, t, s in forks[run]]
    schema = "run_id bigint, pid bigint, ts bigint, seq bigint, syscall string, fd int, path string, child_pid bigint"
    stream = LiveFileSets(f"{tmp_path}/live", buckets=4, every=3)
    history, read = S._batches, []
    monkeypatch.setattr(S, "_batches", lambda *a: read.append(a) or history(*a))

    def current():
        return {(r.run_id, r.path): (r.opened, r.read, r.written) for r in stream.current(spark).collect()}

    def want(upto, extra=()):
        out = {}
        for run in log:
            mine = [e for e in [*log[run], *(extra if run == 1 else ())] if e[1] <= upto]
            out |= {(run, p): v for p, v in plain_file_sets(mine, [f for f in forks[run] if f[2] <= upto]).items()}
        return out

    for batch, (a, b) in enumerate([(0, 40), (40, 60), (60, 90), (90, 120), (120, 150)]):
        part = [r for r in rows if a < r[2] <= b]
        if batch in (1, 3):
            part = [r for r in part if r[0] == 1]  # the other run comes with the next micro-batch
        if batch in (2, 4):
            part += [r for r in rows if r[0] == 2 and (40, 90)[batch == 4] < r[2] <= (60, 120)[batch == 4]]
        stream.process(spark.createDataFrame(part, schema), batch)
    assert len(read) == 1  # the first micro-batch alone has no state to go on from
    assert current() == want(150)
    stream.process(spark.createDataFrame([(1, 0, 20, 20_000, "openat", 1, "/r1/late", None)], schema), 5)
    assert len(read) == 2 and current() == want(150, [late])
    stream.process(spark.createDataFrame([(1, 0, 20, 20_000, "openat", 1, "/r1/late", None)], schema), 5)  # run again
    assert current() == want(150, [late])


def test_many_small_files_are_listed_and_read_by_tasks(spark, tmp_path):
    for k in range(600):
        write(tmp_path / "s" / "wandb" / f"run-{k}" / "files" / "wandb-summary.json", '{"loss": %d}' % k if k % 3 else '{"broken": ')
    for path, text in {"wandb/run 9/files/wandb-summary.json": "[1]", "wandb/.run-x/files/wandb-summary.json": "{}", "wandb/_run-y/files/wandb-summary.json": "{}",
                       "wandb/run-z/files/other.json": "{}", "wandb/run-e/files/wandb-summary.json": ""}.items():
        write(tmp_path / "s" / path, text)
    summaries, broken = T.read_run_summaries(spark, str(tmp_path / "s"))
    assert summaries.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.run_dir for r in summaries.collect()) == sorted(["run%209", *[f"run-{k}" for k in range(600) if k % 3]])
    assert sorted(r.run_dir for r in broken.collect()) == sorted(f"run-{k}" for k in range(0, 600, 3))

    reports = {"a b.json": b'{"read_files": ["x", "x"], "start_time": 2}', "b.x.json": b'{"read_files": ["x"],', "c": b'[{"start_time": 1}, {"start_time": 3}]', "d.json": b" \n", "e.json": b"",
               "f.json": b'{"start_time": "bad", "read_files": ["k"]}', "g.json": b'\xef\xbb\xbf{"start_time": 4}', "_h.json": b"{}", ".i.json": b"{}", "j.json": b"[]", "n.json": b'{"read_files": ["\xff"]}'}
    (tmp_path / "t").mkdir()
    for name, content in reports.items():
        (tmp_path / "t" / name).write_bytes(content)
    for k in range(600):
        (tmp_path / "t" / f"run{k}.json").write_text("{}")
    traces = T.read_trace_reports(spark, str(tmp_path / "t"))
    assert traces.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    odd = sorted((r.run_id, r.read_files, r.start_time) for r in traces.where("run_id not like 'run%'").collect())
    assert odd == [("a%20b", ["x"], 2.0), ("b.x", [], 0.0), ("c", [], 1.0), ("c", [], 3.0), ("f", ["k"], 0.0), ("g", [], 4.0), ("n", [], 0.0)]
    assert traces.count() == 607
