"""Session graphs: staleness, node and artifact states, counters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.edges import is_build, newest, primary_digests, with_paths
from strandline.scale import latest, materialize, materialize_counted

def latest_runs(jobs: DataFrame) -> DataFrame:
    """The newest job of every (session, step)."""
    steps = jobs.where(F.col("session_id").isNotNull() & F.col("step_number").isNotNull())
    return latest(steps, ["session_id", "step_number"], newest())


def spread_downstream(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """All (session, step) reachable from ``seeds`` over ``edges`` (session, producer → step).

    All sessions advance together by joins, one written frontier per round, until no new step is
    reached; a session of any size takes as many rounds as its longest chain.
    """
    key = ["session_id", "step_number"]
    frontier = materialize(seeds.select(*key).distinct(), "frontier")
    touched = edges.select(*key, "producer_step").distinct().join(
        frontier.select("session_id").distinct(), "session_id", "left_semi"
    )
    links = materialize(touched, "links")
    reached = frontier
    while True:
        found = (
            links.join(frontier.withColumnRenamed("step_number", "producer_step"), ["session_id", "producer_step"])
            .select(*key)
            .distinct()
            .join(reached, key, "left_anti")
        )
        frontier, rows = materialize_counted(found, "frontier")
        if not rows:
            return reached
        reached = reached.unionByName(frontier)


@dataclass
class SessionGraph:
    """Every session's steps, dependencies and states, for all sessions together."""

    jobs: DataFrame
    inputs: DataFrame
    outputs: DataFrame
    artifacts: DataFrame

    @cached_property
    def latest_keys(self) -> DataFrame:
        """(session_id, step_number, job_id) of the latest runs; written, as everything starts here."""
        keys = self.jobs.select("id", "session_id", "step_number", "timestamp")
        return materialize(
            latest_runs(keys).select("session_id", "step_number", F.col("id").alias("job_id")), "latest"
        )

    @cached_property
    def latest(self) -> DataFrame:
        """The latest runs as full job rows."""
        return self.jobs.join(self.latest_keys.select(F.col("job_id").alias("id")), "id", "left_semi")

    @cached_property
    def made(self) -> DataFrame:
        """Outputs of the latest runs."""
        return materialize(with_paths(self.outputs, self.artifacts).join(self.latest_keys, "job_id"), "made")

    @cached_property
    def used(self) -> DataFrame:
        """Inputs of the latest runs."""
        return materialize(with_paths(self.inputs, self.artifacts).join(self.latest_keys, "job_id"), "used")

    @cached_property
    def current(self) -> DataFrame:
        """The artifact now at every output path: the highest step that writes it decides."""
        order = [F.col("step_number").desc(), F.col("artifact_id").desc()]
        return latest(self.made, ["session_id", "path"], order).select(
            "session_id",
            "path",
            F.col("step_number").alias("producer_step"),
            F.col("artifact_id").alias("current_artifact"),
        )

    @cached_property
    def dependencies(self) -> DataFrame:
        """What a step consumes, by path, from an earlier step."""
        found = (
            self.used.join(self.current, ["session_id", "path"])
            .where(F.col("producer_step") < F.col("step_number"))
            .select("session_id", "step_number", "producer_step", "path",
                    F.col("artifact_id").alias("consumed_artifact"), "current_artifact")
        )
        return materialize(found, "dependencies")

    @cached_property
    def directly_stale(self) -> DataFrame:
        changed = F.col("consumed_artifact") != F.col("current_artifact")
        return self.dependencies.where(changed).select("session_id", "step_number").distinct()

    @cached_property
    def stale(self) -> DataFrame:
        return materialize(
            spread_downstream(self.directly_stale, self.dependencies), "stale"
        )

    @cached_property
    def stale_artifacts(self) -> DataFrame:
        """Outputs of stale steps' latest runs, one row per output edge."""
        return self.made.join(self.stale, ["session_id", "step_number"], "left_semi").select(
            "session_id", "step_number", "artifact_id", "path"
        )

    @cached_property
    def downstream(self) -> DataFrame:
        """Steps that read an artifact another step of the session made (any step order)."""
        made = self.made.select("session_id", "artifact_id", F.col("step_number").alias("source_step")).distinct()
        used = self.used.select("session_id", "artifact_id", "step_number").distinct()
        return (
            made.join(used, ["session_id", "artifact_id"])
            .where(F.col("source_step") != F.col("step_number"))
            .select("session_id", "source_step", "step_number")
            .distinct()
        )

    @cached_property
    def stale_downstream(self) -> DataFrame:
        return self.downstream.join(self.stale, ["session_id", "step_number"], "left_semi")

    @cached_property
    def stale_upstream(self) -> DataFrame:
        """For stale steps: the stale steps any run of which made an artifact they read."""
        stale = self.stale
        used = self.used.join(stale, ["session_id", "step_number"], "left_semi").select(
            "session_id", "step_number", "artifact_id"
        )
        runs = self.jobs.select(
            F.col("id").alias("job_id"), "session_id", F.col("step_number").alias("upstream_step")
        )
        made = (
            self.outputs.join(runs, "job_id")
            .join(stale.withColumnRenamed("step_number", "upstream_step"), ["session_id", "upstream_step"], "left_semi")
            .select("session_id", "artifact_id", "upstream_step")
            .distinct()
        )
        return used.distinct().join(made, ["session_id", "artifact_id"]).select(
            "session_id", "step_number", "upstream_step"
        ).distinct()

    # -- nodes ---------------------------------------------------------------------------------

    def _shown(self, expanded: bool) -> DataFrame:
        if not expanded:
            return self.latest.withColumn("is_latest", F.lit(True))
        newest_ids = self.latest_keys.select(F.col("job_id").alias("id"), F.lit(True).alias("is_latest"))
        runs = self.jobs.where(F.col("session_id").isNotNull() & F.col("step_number").isNotNull())
        return runs.join(newest_ids, "id", "left").withColumn(
            "is_latest", F.coalesce("is_latest", F.lit(False))
        )

    def node_dependencies(self, expanded: bool = False) -> DataFrame:
        """One row per consumed input edge of a shown node."""
        if not expanded:
            return self.dependencies.join(self.latest_keys, ["session_id", "step_number"]).select(
                "session_id", "job_id", "step_number", "producer_step"
            )
        return self._expanded_dependencies

    @cached_property
    def _expanded_dependencies(self) -> DataFrame:
        shown = self._shown(True).select(F.col("id").alias("job_id"), "session_id", "step_number")
        found = (
            with_paths(self.inputs, self.artifacts)
            .join(shown, "job_id")
            .join(self.current.drop("current_artifact"), ["session_id", "path"])
            .where(F.col("producer_step") < F.col("step_number"))
            .select("session_id", "job_id", "step_number", "producer_step")
        )
        return materialize(found, "run_dependencies")

    def step_links(self, expanded: bool = False) -> DataFrame:
        return self.node_dependencies(expanded).select("session_id", "step_number", "producer_step").distinct()

    @cached_property
    def superseded_steps(self) -> DataFrame:
        """Steps that take over the superseded state in the expanded view."""
        older = self._shown(True).where(~F.col("is_latest")).select("session_id", "step_number")
        spread = spread_downstream(older, self.step_links(True))
        return materialize(spread.join(older.distinct(), ["session_id", "step_number"], "left_anti"), "superseded")

    def nodes(self, expanded: bool = False, stale_only: bool = False) -> DataFrame:
        """Shown nodes with their state and metrics, and their step name where jobs have one."""
        shown = self._shown(expanded)
        stale = self.stale.withColumn("is_stale", F.lit(True))
        n_in = self.inputs.groupBy("job_id").agg(F.count(F.lit(1)).alias("inputs"))
        n_out = self.outputs.groupBy("job_id").agg(F.count(F.lit(1)).alias("outputs"))
        deps = self.node_dependencies(expanded).groupBy("job_id").agg(
            F.count(F.lit(1)).alias("consumed"),
            F.count_distinct("producer_step").alias("dependencies"),
        )
        base = (
            shown.withColumnRenamed("id", "job_id")
            .join(stale, ["session_id", "step_number"], "left")
            .join(n_in, "job_id", "left")
            .join(n_out, "job_id", "left")
            .join(deps, "job_id", "left")
        )
        state = (
            F.when(~F.col("is_latest"), "superseded")
            .when(F.col("is_stale"), "stale")
            .otherwise("active")
        )
        if expanded:
            taken = self.superseded_steps.withColumn("taken", F.lit(True))
            base = base.join(taken, ["session_id", "step_number"], "left")
            state = F.when(F.col("taken"), "superseded").otherwise(state)
        zero = F.lit(0).cast("bigint")
        named = ["step_name"] if "step_name" in base.columns else []
        nodes = base.select(
            "session_id", "step_number", *named, "job_id", "job_uid", "command",
            state.alias("state"), is_build().alias("is_build"), "exit_code",
            *[F.coalesce(c, zero).alias(c) for c in ("inputs", "outputs", "consumed", "dependencies")],
        )
        return nodes.where(F.col("state").isin("stale", "superseded")) if stale_only else nodes

    def leaf_steps(self, expanded: bool = False) -> DataFrame:
        used = self.step_links(expanded).select(
            "session_id", F.col("producer_step").alias("step_number")
        )
        return self.latest_keys.select("session_id", "step_number").join(
            used, ["session_id", "step_number"], "left_anti"
        )

    # -- artifacts -----------------------------------------------------------------------------

    @cached_property
    def tracked(self) -> DataFrame:
        """Artifacts of the latest runs; the highest producing step counts."""
        order = [F.col("step_number").desc(), F.col("path").desc()]
        return latest(self.made, ["session_id", "artifact_id"], order).select(
            "session_id", "artifact_id", "path", F.col("step_number").alias("producer_step"), "job_id"
        )

    @cached_property
    def consumers(self) -> DataFrame:
        """Later steps that read an artifact, by artifact id."""
        return (
            self.used.select("session_id", "artifact_id", F.col("step_number").alias("consumer_step"))
            .distinct()
            .join(self.tracked.select("session_id", "artifact_id", "producer_step"), ["session_id", "artifact_id"])
            .where(F.col("producer_step") < F.col("consumer_step"))
            .select("session_id", "artifact_id", "consumer_step")
        )

    @cached_property
    def path_heads(self) -> DataFrame:
        """The last artifact to appear at a path among the latest runs."""
        first_seen = self.made.groupBy("session_id", "path", "artifact_id").agg(
            F.min("step_number").alias("first_step")
        )
        order = [F.col("first_step").desc(), F.col("artifact_id").desc()]
        return latest(first_seen, ["session_id", "path"], order).select(
            "session_id", "path", F.col("artifact_id").alias("head")
        )

    def _step_states(self, expanded: bool) -> DataFrame:
        states = self.latest_keys.select("session_id", "step_number").join(
            self.stale.withColumn("is_stale", F.lit(True)), ["session_id", "step_number"], "left"
        )
        state = F.when(F.col("is_stale"), "stale").otherwise("active")
        if expanded:
            taken = self.superseded_steps.withColumn("taken", F.lit(True))
            states = states.join(taken, ["session_id", "step_number"], "left")
            state = F.when(F.col("taken"), "superseded").otherwise(state)
        return states.select(
            "session_id", F.col("step_number").alias("producer_step"),
            state.alias("step_state"), F.coalesce("is_stale", F.lit(False)).alias("is_stale"),
        )

    def artifact_states(self, hashes: DataFrame, expanded: bool = False) -> DataFrame:
        """State, terminal flag and successor of every artifact of the latest runs."""
        n_consumers = self.consumers.groupBy("session_id", "artifact_id").agg(
            F.count(F.lit(1)).alias("consumers")
        )
        leaves = self.leaf_steps(expanded).select(
            "session_id", F.col("step_number").alias("producer_step"), F.lit(True).alias("leaf")
        )
        rows = (
            self.tracked.join(self._step_states(expanded), ["session_id", "producer_step"])
            .join(leaves, ["session_id", "producer_step"], "left")
            .join(n_consumers, ["session_id", "artifact_id"], "left")
            .join(self.path_heads, ["session_id", "path"])
            .join(primary_digests(hashes), "artifact_id", "left")
        )
        terminal = F.coalesce("leaf", F.lit(False))
        consumers = F.coalesce("consumers", F.lit(0).cast("bigint"))
        superseded_by = F.when(F.col("head") != F.col("artifact_id"), F.col("head"))
        state = (
            F.when(superseded_by.isNotNull() | (F.col("step_state") == "superseded"), "superseded")
            .when(F.col("step_state") == "stale", "stale")
            .when((consumers == 0) & ~terminal, "orphaned")
            .otherwise("active")
        )
        return rows.select(
            "session_id", "artifact_id", "path", F.col("digest").alias("hash"), "producer_step",
            "is_stale", state.alias("state"), terminal.alias("is_terminal"), consumers.alias("consumers"),
            superseded_by.alias("superseded_by"), (F.col("step_state") == "stale").alias("made_stale"),
        )

    def artifact_view(
        self, hashes: DataFrame, expanded: bool = False, show_artifacts: bool = False, stale_only: bool = False
    ) -> DataFrame:
        """Artifacts as shown: terminal ones, or all; the stale view keeps stale and superseded."""
        rows = self.artifact_states(hashes, expanded).drop("made_stale")
        if not show_artifacts:
            rows = rows.where("is_terminal")
        if stale_only:
            rows = rows.where(F.col("state").isin("stale", "superseded"))
        return rows

    def summary(self, hashes: DataFrame, expanded: bool = False) -> DataFrame:
        """Counters per session, taken before any view filter."""
        steps = self.latest_keys.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_steps"))
        stale = self.stale.groupBy("session_id").agg(F.count(F.lit(1)).alias("stale_count"))
        arts = self.artifact_states(hashes, expanded).groupBy("session_id").agg(
            F.count_if("made_stale").alias("stale_artifact_count"),
            F.count_if(F.col("state") == "superseded").alias("superseded_artifact_count"),
        )
        zero = F.lit(0).cast("bigint")
        return steps.join(stale, "session_id", "left").join(arts, "session_id", "left").select(
            "session_id", "total_steps",
            *[F.coalesce(c, zero).alias(c)
              for c in ("stale_count", "stale_artifact_count", "superseded_artifact_count")],
        )

    def children(self, expanded: bool = False) -> DataFrame:
        """(node, child node) by step dependency; children repeat per run in the expanded view."""
        deps = self.node_dependencies(expanded).select(
            "session_id", F.col("job_id").alias("child_job"), F.col("step_number").alias("child_step"), "producer_step"
        ).distinct()
        return deps.select("session_id", F.col("producer_step").alias("step_number"), "child_job", "child_step")

    def roots(self, expanded: bool = False) -> DataFrame:
        """Shown nodes that depend on no shown step."""
        fed = self.node_dependencies(expanded).select("job_id").distinct()
        return self._shown(expanded).select(
            "session_id", "step_number", F.col("id").alias("job_id")
        ).join(fed, "job_id", "left_anti")
