"""Pipelines with known outcomes."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import lineage as L
from strandline.operators.dag import SessionGraph, spread_downstream


class Pipeline:
    """Runs of one session: step, inputs and outputs as {path: artifact}."""

    def __init__(self, spark):
        self.spark, self.jobs, self.inputs, self.outputs = spark, [], [], []

    def run(self, step, reads, writes, job_type=None):
        job = len(self.jobs) + 1
        self.jobs.append((job, f"uid{job:05d}", job, f"step {step}", 1, step, job_type, 0))
        self.inputs += [(job, a, p) for p, a in reads.items()]
        self.outputs += [(job, a, p) for p, a in writes.items()]
        return job

    def tables(self):
        edge = "job_id bigint, artifact_id string, path string"
        jobs = self.spark.createDataFrame(
            self.jobs, "id bigint, job_uid string, timestamp bigint, command string, session_id bigint, step_number int, job_type string, exit_code int")
        inputs, outputs = self.spark.createDataFrame(self.inputs, edge), self.spark.createDataFrame(self.outputs, edge)
        ids = sorted({a for _, a, _ in self.inputs + self.outputs})
        artifacts = self.spark.createDataFrame([(a, 1, 1, "") for a in ids], "id string, size bigint, first_seen_at bigint, first_seen_path string")
        hashes = self.spark.createDataFrame([(a, "sha256", "d" + a) for a in ids], "artifact_id string, algorithm string, digest string")
        return jobs, inputs, outputs, artifacts, hashes

    def graph(self, **kw):
        jobs, inputs, outputs, artifacts, self.hashes = self.tables()
        return SessionGraph(jobs, inputs, outputs, artifacts, **kw)


def steps(df):
    return sorted(r.step_number for r in df.collect())


def linear(spark):
    p = Pipeline(spark)
    p.run(1, {"in": "i"}, {"clean": "c1"})
    p.run(2, {"clean": "c1"}, {"model": "m1"})
    return p


def test_linear_is_fresh(spark):
    p = linear(spark)
    p.run(3, {"model": "m1"}, {"eval": "e1"})
    assert steps(p.graph().stale) == []


def test_rerun_makes_dependents_stale(spark):
    p = linear(spark)
    p.run(1, {"in": "i2"}, {"clean": "c2"})
    assert steps(p.graph().stale) == [2]


def test_cascade(spark):
    p = linear(spark)
    p.run(3, {"model": "m1"}, {"eval": "e1"})
    p.run(1, {"in": "i2"}, {"clean": "c2"})
    graph = p.graph()
    assert steps(graph.directly_stale) == [2]
    assert steps(graph.stale) == [2, 3]
    assert sorted(r.artifact_id for r in graph.stale_artifacts.collect()) == ["e1", "m1"]
    assert [(r.step_number, r.upstream_step) for r in graph.stale_upstream.collect()] == [(3, 2)]
    assert [(r.source_step, r.step_number) for r in graph.stale_downstream.collect()] == [(2, 3)]


def test_partial_branch(spark):
    p = Pipeline(spark)
    p.run(1, {"in": "i"}, {"a": "a1", "b": "b1"})
    p.run(2, {"a": "a1"}, {"ma": "ma1"})
    p.run(3, {"b": "b1"}, {"mb": "mb1"})
    p.run(4, {"ma": "ma1", "mb": "mb1"}, {"out": "o1"})
    p.run(2, {"a": "a1"}, {"ma": "ma2"})
    assert steps(p.graph().stale) == [4]


def test_expanded_view(spark):
    p = linear(spark)
    p.run(3, {"model": "m1"}, {"eval": "e1"})
    p.run(1, {"in": "i2"}, {"clean": "c2"})
    graph = p.graph()
    states = {(r.step_number, r.job_id): r.state for r in graph.nodes(expanded=True).collect()}
    assert states == {(1, 1): "superseded", (1, 4): "active", (2, 2): "superseded", (3, 3): "superseded"}
    assert graph.summary(p.hashes, expanded=True).first().superseded_artifact_count >= 1
    assert graph.nodes().count() == 3


def test_consumers_and_leaves(spark):
    p = linear(spark)
    graph = p.graph()
    rows = {r.artifact_id: r for r in graph.artifact_states(p.hashes).collect()}
    assert rows["c1"].consumers == 1 and not rows["c1"].is_terminal
    assert rows["m1"].is_terminal and rows["m1"].state == "active" and rows["m1"].hash == "dm1"
    assert steps(graph.leaf_steps()) == [2]
    assert [r.step_number for r in graph.roots().collect()] == [1]


def test_later_step_at_one_path_wins(spark):
    p = Pipeline(spark)
    p.run(1, {}, {"shared": "x1"})
    p.run(2, {}, {"shared": "x2", "other": "y"})
    p.run(3, {"shared": "x1"}, {"out": "z"})
    graph = p.graph()
    current = {r.path: (r.producer_step, r.current_artifact) for r in graph.current.collect()}
    assert current["shared"] == (2, "x2")
    assert steps(graph.stale) == [3]
    rows = {r.artifact_id: (r.state, r.superseded_by) for r in graph.artifact_states(p.hashes).collect()}
    assert rows["x1"] == ("superseded", "x2")


def test_diamond_lineage(spark):
    p = Pipeline(spark)
    p.run(1, {"raw": "r"}, {"a": "a"})
    p.run(2, {"raw": "r"}, {"b": "b"})
    last = p.run(3, {"a": "a", "b": "b"}, {"c": "c", "log": "l"})
    jobs, inputs, outputs, artifacts, hashes = p.tables()
    targets = spark.createDataFrame([("t", "c")], "target string, artifact_id string")
    made_by = L.producers(jobs, outputs)
    links = L.filtered_lineage(targets, made_by, inputs, outputs, artifacts, hashes).collect()
    assert {r.job_id for r in links} == {1, 2, 3}
    assert {(r.artifact_id, r.direction) for r in links if r.job_id == last} == {("a", "in"), ("b", "in"), ("c", "out")}
    outside = L.external_inputs(L.closure(targets, made_by, inputs, 10), made_by)
    assert [r.artifact_id for r in outside.collect()] == ["r"]


def test_closure_ends_on_cycles_and_grows_with_depth(spark):
    p = Pipeline(spark)
    p.run(1, {"a": "a"}, {"b": "b"})
    p.run(2, {"b": "b"}, {"a": "a"})
    p.run(3, {"b": "b", "c": "c"}, {"c": "c"})
    jobs, inputs, outputs, artifacts, _ = p.tables()
    targets = spark.createDataFrame([("c",)], "artifact_id string")
    made_by = L.producers(jobs, outputs)
    found = [{r.artifact_id for r in L.closure(targets, made_by, inputs, d).collect()} for d in (0, 1, 2, 10)]
    assert found == [{"c"}, {"c", "b"}, {"c", "b", "a"}, {"c", "b", "a"}]
    tree = L.artifact_tree(targets, made_by, inputs, artifacts, 1).collect()
    assert {(r.artifact_id, r.truncated) for r in tree} == {("c", False), ("b", False), ("a", True)}


def test_reruns(spark):
    p = Pipeline(spark)
    p.run(1, {"z": "z", "a": "a", "m": "m"}, {"b": "b"})
    p.run(1, {"a": "a", "m": "m", "z": "z"}, {"b": "b"})
    for _ in range(3):
        p.run(2, {}, {})
    jobs, inputs, outputs, _, hashes = p.tables()
    listed = jobs.select(F.lit(1).alias("group_id"), F.col("id").alias("job_id"), "timestamp")
    signatures = L.io_signatures(listed, jobs, inputs, outputs, hashes)
    assert sorted(r.job_id for r in L.drop_reruns(listed, signatures).collect()) == [2, 3, 4, 5]


def test_spreading_reaches_what_a_walk_reaches(spark):
    edges = spark.range(0, 3000).selectExpr(
        "id % 7 as session_id", "cast(id % 60 + 2 as int) as step_number", "cast(greatest(1, (id % 60 + 2) - 1 - id % 5) as int) as producer_step").distinct()
    seeds = spark.range(0, 7).selectExpr("id as session_id", "cast(id * 7 + 2 as int) as step_number")
    reached = {(r.session_id, r.step_number) for r in seeds.collect()}
    while True:
        more = {(r.session_id, r.step_number) for r in edges.collect() if (r.session_id, r.producer_step) in reached} - reached
        if not more:
            break
        reached |= more
    assert {tuple(r) for r in spread_downstream(seeds, edges).collect()} == reached and len(reached) > 40


def test_recorded_runs_feed_the_graph(spark):
    from strandline.operators.record import record_runs

    runs = spark.createDataFrame(
        [("r1", 1, 1, "python prep.py", "/w", "c1", None), ("r2", 1, 2, "python train.py", "/w", "c1", None),
         ("r3", 1, 3, "python prep.py", "/w", "c2", None), ("b1", 1, 4, "make", "/w", "c2", "build")],
        "run_id string, session_id bigint, timestamp bigint, command string, repo_root string, git_commit string, job_type string")
    files = [("r1", "in", "/w/raw"), ("r1", "out", "/w/clean_001.csv"), ("r2", "in", "/w/clean_001.csv"), ("r2", "out", "/w/model"),
             ("r3", "in", "/w/raw"), ("r3", "out", "/w/clean_001.csv"), ("r1", "in", "/w/gone"), ("b1", "out", "/w/tool")]
    digest = {("r1", "/w/raw"): "A", ("r1", "/w/clean_001.csv"): "B", ("r2", "/w/clean_001.csv"): "b", ("r2", "/w/model"): "C",
              ("r3", "/w/raw"): "A", ("r3", "/w/clean_001.csv"): "D", ("b1", "/w/tool"): "E"}
    made = record_runs(
        runs, spark.createDataFrame(files, "run_id string, direction string, path string"),
        spark.createDataFrame([(r, p, "sha256", d, 5) for (r, p), d in digest.items()], "run_id string, path string, algorithm string, digest string, size bigint"))
    jobs = {r.run_id: r for r in made.jobs.collect()}
    assert [jobs[r].step_number for r in ("r1", "r2", "r3", "b1")] == [1, 2, 1, 3]
    assert jobs["r1"].script == "prep.py" and len(jobs["r1"].job_uid) == 12
    assert made.job_inputs.count() == 3 and made.job_outputs.count() == 3
    assert sorted(r.digest for r in made.artifact_hashes.collect()) == ["a", "b", "c", "d"]
    first = sorted((r.first_seen_path, r.first_seen_at) for r in made.artifacts.collect())
    assert first == [("/w/clean_001.csv", 1), ("/w/clean_001.csv", 3), ("/w/model", 2), ("/w/raw", 1)]
    session = made.sessions.first()
    assert (session.git_commit_start, session.git_commit_end, session.current_step) == ("c1", "c2", 3)
    graph = SessionGraph(made.jobs, made.job_inputs, made.job_outputs, made.artifacts)
    assert steps(graph.stale) == [2]


def test_recording_appends(spark, tmp_path):
    """Two batches give what one gives, written and read back in between; one sighting merges two artifacts."""
    from strandline.operators.record import LineageTables, record_runs, with_recording
    from strandline.sources.tables import read_lineage, write_lineage

    runs = [(f"r{k}", k % 2, k + 1, f"python s{k % 3}.py", "/w", f"c{k % 4}", None) for k in range(8)]
    files = [(f"r{k}", "in", f"/w/in{k % 3}") for k in range(8)] + [(f"r{k}", "out", f"/w/out{k % 3}") for k in range(8)]
    digests = [(r, p, "sha256", f"{p}:{int(r[1:]) // 4 if 'out' in p else 0}", 5) for r, _, p in files]
    digests += [("r1", "/w/in1", "md5", "aa", 5), ("r2", "/w/in2", "md5", "bb", 5)]
    late = [("r7", "/w/in1", "md5", "bb", 5)]  # ties the artifact of in1 to that of in2
    frames = lambda names, extra=(): (
        spark.createDataFrame([r for r in runs if r[0] in names], "run_id string, session_id bigint, timestamp bigint, command string, repo_root string, git_commit string, job_type string"),
        spark.createDataFrame([f for f in files if f[0] in names], "run_id string, direction string, path string"),
        spark.createDataFrame([d for d in [*digests, *extra] if d[0] in names], "run_id string, path string, algorithm string, digest string, size bigint"))
    names = [r[0] for r in runs]
    fields = ["jobs", "artifacts", "artifact_hashes", "job_inputs", "job_outputs", "sessions"]

    def facts(t):
        """Jobs and edges with artifacts named by their digests."""
        label = {}
        for r in t.artifact_hashes.collect():
            label.setdefault(r.artifact_id, set()).add(r.digest)
        jobs = sorted((r.id, r.job_uid, r.session_id, r.step_number, r.step_identity, r.script, r.git_commit) for r in t.jobs.collect())
        edges = sorted((r.job_id, sorted(label[r.artifact_id]), r.path, d) for d, e in (("in", t.job_inputs), ("out", t.job_outputs)) for r in e.collect())
        sessions = sorted((r.id, r.hash, r.created_at, r.current_step, r.git_commit_start, r.git_commit_end) for r in t.sessions.collect())
        first = sorted((sorted(label[r.id]), r.first_seen_at, r.first_seen_path) for r in t.artifacts.collect())
        return jobs, edges, sessions, first

    once = record_runs(*frames(names, late))
    start = record_runs(*frames(names[:5]))
    write_lineage({n: getattr(start, n) for n in fields}, str(tmp_path))
    read = read_lineage(spark, str(tmp_path), fields)
    stored = LineageTables(**read)
    rest = record_runs(*frames(names[5:], late), stored=stored)
    assert rest.merged.count() == 1 and rest.jobs.count() == 3
    stored.jobs = stored.jobs.withColumn("run_id", F.lit(None).cast("string"))
    assert facts(with_recording(stored, rest)) == facts(once)
