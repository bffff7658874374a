"""Experiment trackers: which ones a run used, and the runs they recorded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.paths import contains_any
from strandline.scale import latest, running_sum

# Path parts that give a tracker away, and what each implies to ignore.
TRACKERS = {
    "wandb": ["wandb/", ".wandb"],
    "mlflow": ["mlruns/", "mlartifacts/"],
    "neptune": [".neptune/"],
    "tensorboard": ["/runs/", "events.out.tfevents"],
}
IGNORE = {
    "wandb": ["wandb/*", "*.wandb"],
    "mlflow": ["mlruns/*", "mlartifacts/*"],
    "neptune": [".neptune/*"],
    "tensorboard": [],
}
MATCH_WINDOW = 5.0


def detected_trackers(written: DataFrame) -> DataFrame:
    """(run_id, tracker) from written paths."""
    path = F.col("path")
    hits = F.array_compact(F.array(*[F.when(contains_any(path, parts), t) for t, parts in TRACKERS.items()]))
    return written.select("run_id", F.explode(hits).alias("tracker")).distinct()


def ignore_patterns(trackers: DataFrame) -> DataFrame:
    """(run_id, pattern) implied by the detected trackers."""
    implied = F.create_map(*[x for t, ps in IGNORE.items() for x in (F.lit(t), F.array(*[F.lit(p) for p in ps]).cast("array<string>"))])
    return trackers.select("run_id", F.explode(implied[F.col("tracker")]).alias("pattern")).distinct()


def wandb_runs(written: DataFrame, run_dirs: DataFrame, metadata: DataFrame, environment: DataFrame) -> DataFrame:
    """Run facts per (run_id, base folder): from the newest run folder, else from the environment.

    ``run_dirs``: (base, run_dir, mtime[, linked]), a folder that the latest-run link names comes first; ``metadata``: (run_dir, run_id_text, project, entity);
    ``environment``: (run_id, env map).
    """
    base = F.regexp_extract("path", "^(.*?wandb/)", 1)
    bases = written.select("run_id", base.alias("base")).where(F.col("base") != "").distinct()
    linked = [F.coalesce("linked", F.lit(False)).desc()] if "linked" in run_dirs.columns else []
    newest = latest(run_dirs, ["base"], [*linked, F.col("mtime").desc(), F.col("run_dir").desc()]).select("base", "run_dir")
    rows = bases.join(newest, "base", "left").join(metadata, "run_dir", "left").join(environment, "run_id", "left")
    known = F.col("run_id_text").isNotNull() & F.col("project").isNotNull() & F.col("entity").isNotNull()
    url = F.when(
        known, F.concat(F.lit("https://wandb.ai/"), "entity", F.lit("/"), "project", F.lit("/runs/"), "run_id_text")
    )
    env = F.col("env")
    both = (F.coalesce(env["WANDB_ENTITY"], F.lit("")) != "") & (F.coalesce(env["WANDB_PROJECT"], F.lit("")) != "")
    fallback = url.isNull() & both
    return rows.select(
        "run_id", "base", F.col("run_id_text").alias("tracker_run"),
        F.when(fallback, env["WANDB_PROJECT"]).otherwise(F.col("project")).alias("project"),
        F.when(fallback, env["WANDB_ENTITY"]).otherwise(F.col("entity")).alias("entity"),
        url.alias("url"),
    )


def run_summaries(summaries: DataFrame) -> DataFrame:
    """(run_dir, runtime_seconds, metrics) of summaries of any shape: the tracker's own runtime, and how many numbers they hold."""
    numbers = F.expr("""aggregate(map_values(coalesce(try_cast(summary as map<string, variant>), map())), 0L,
      (n, v) -> n + if(v is not null and schema_of_variant(v) rlike '^(BIGINT|DOUBLE|DECIMAL|FLOAT)', 1, 0))""")
    return summaries.select("run_dir", F.try_variant_get("summary", "$._wandb.runtime", "double").alias("runtime_seconds"), numbers.alias("metrics"))


def summary_values(summaries: DataFrame) -> DataFrame:
    """(run_dir, metric, value): the numbers at the top of every summary."""
    spark = summaries.sparkSession
    return spark.sql(
        """select run_dir, m.key as metric, try_variant_get(m.value, '$', 'double') as value from {summaries}, lateral variant_explode(summary) m
           where m.key is not null and schema_of_variant(m.value) rlike '^(BIGINT|DOUBLE|DECIMAL|FLOAT)'""", summaries=summaries
    )


def with_run_summaries(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """``runs`` (run_dir, tracker_run, …) with ``runtime_seconds`` of the summary where no metadata named the run."""
    found = run_summaries(summaries).select("run_dir", "runtime_seconds")
    return runs.join(found, "run_dir", "left").withColumn("runtime_seconds", F.when(F.col("tracker_run").isNull(), F.col("runtime_seconds")))


def mlflow_runs(written: DataFrame, environment: DataFrame) -> DataFrame:
    """Experiment and run of the first matching path of every run; ``written`` has a position."""
    pattern = r"mlruns/(\d+)/([a-f0-9]{32})/"
    path = F.col("path")
    hits = written.where(path.rlike(pattern)).groupBy("run_id").agg(F.min_by("path", F.struct("position", "path")).alias("path"))
    rows = hits.join(environment, "run_id", "left").select(
        "run_id", F.regexp_extract("path", pattern, 1).alias("experiment_id"), F.regexp_extract("path", pattern, 2).alias("tracker_run"),
        F.col("env")["MLFLOW_TRACKING_URI"].alias("tracking_uri"),
    )
    web = F.coalesce(F.col("tracking_uri").startswith("http"), F.lit(False))
    return rows.withColumn(
        "url",
        F.when(
            web,
            F.concat(F.regexp_replace("tracking_uri", "/+$", ""), F.lit("/#/experiments/"), "experiment_id", F.lit("/runs/"), "tracker_run"),
        ),
    )


def neptune_runs(written: DataFrame, run_dirs: DataFrame, environment: DataFrame) -> DataFrame:
    """Project and run per run_id; ``run_dirs``: (base, run_dir name)."""
    base = F.regexp_extract("path", r"^(.*?\.neptune/)", 1)
    bases = written.where(F.col("path").contains(".neptune/")).groupBy("run_id").agg(
        F.min_by(base, F.struct("position", "path")).alias("base")
    )
    dirs = run_dirs.groupBy("base").agg(F.min("run_dir").alias("tracker_run"))
    rows = bases.join(dirs, "base", "left").join(environment, "run_id", "left").withColumn("project", F.col("env")["NEPTUNE_PROJECT"])
    slash = F.coalesce(F.col("project").contains("/"), F.lit(False))
    url = F.when(
        slash & F.col("tracker_run").isNotNull() & ~F.col("project").startswith("/"),
        F.concat(F.lit("https://app.neptune.ai/"), "project", F.lit("/runs/"), "tracker_run"),
    )
    return rows.select("run_id", "project", "tracker_run", url.alias("url"))


def _spans(jobs: DataFrame, window: float) -> DataFrame:
    bounds = {"lo": F.col("start") - window, "hi": F.col("end") + window}
    return jobs.withColumns(bounds).drop("start", "end").where(F.col("lo") <= F.col("hi"))


def match_run_dirs(
    jobs: DataFrame, run_dirs: DataFrame, window: float = MATCH_WINDOW, columns: Sequence[str] = ("job_id", "run_dir")
) -> DataFrame:
    """(job_id, run_dir), or other ``columns`` of both, with the folder's time inside the job's time, widened by the window.

    ``jobs``: (job_id, repo_root, start, end); ``run_dirs``: (repo_root, run_dir, ctime). A job is
    put on a time grid about as coarse as it is long, so it meets at most two cells, and folders
    appear once on each grid in use: an equi-join for short and long jobs alike.
    """
    mine = [c for c in columns if c in jobs.columns]
    spans = _spans(jobs, window).select(*dict.fromkeys(["repo_root", "lo", "hi", *mine]))
    run_dirs = run_dirs.select(*dict.fromkeys(["repo_root", "ctime", *[c for c in columns if c not in mine]]))
    level = F.ceil(F.log2(F.greatest(F.col("hi") - F.col("lo"), F.lit(1.0)))).cast("int")
    spans = spans.withColumn("level", level)
    # At most about forty grids: job lengths between a second and centuries.
    levels = sorted(r[0] for r in spans.select("level").distinct().collect())
    width = F.pow(F.lit(2.0), F.col("level"))
    first, last_ = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
    cells = spans.withColumn("cell", F.explode(F.sequence(first, last_)))
    points = run_dirs.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn(
        "cell", F.floor(F.col("ctime") / width)
    )
    return (
        cells.join(points, ["repo_root", "level", "cell"])
        .where(F.col("ctime").between(F.col("lo"), F.col("hi")))
        .select(*columns)
    )


def _match_counts(jobs: DataFrame, run_dirs: DataFrame, window: float) -> DataFrame:
    """(job_id, links): how many folders ``match_run_dirs`` finds for each job, from folders counted up to both ends of its
    time; rows grow with jobs and folders, not with their pairs."""
    spans = _spans(jobs, window).select("job_id", "repo_root", "lo", "hi")
    ends = spans.select("job_id", "repo_root", F.expr("inline(array(struct(lo as at, 0 as kind), struct(hi as at, 2 as kind)))"))
    points = run_dirs.select("repo_root", F.col("ctime").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("is_dir"))
    rows = ends.unionByName(points, allowMissingColumns=True).where("repo_root is not null and at is not null")
    # Equal rows may come in any order: only those of another kind change the count.
    upto = running_sum(rows, ["repo_root"], [F.col("at"), F.col("kind")], "is_dir", "upto").where("kind <> 1")
    signed = F.coalesce("upto", F.lit(0)) * F.when(F.col("kind") == 2, 1).otherwise(-1)
    return upto.groupBy("job_id").agg(F.sum(signed).alias("links"))


def log_run_urls(logs: DataFrame) -> DataFrame:
    """Run URL in the text of a tracker's debug log; ``logs``: (run_dir, text)."""
    pattern = r"finishing run ([^/\s]+)/([^/\s]+)/([^/\s]+)"
    parts = [F.regexp_extract("text", pattern, i) for i in (1, 2, 3)]
    return logs.where(F.col("text").rlike(pattern)).select(
        "run_dir", parts[0].alias("entity"), parts[1].alias("project"), parts[2].alias("tracker_run"),
        F.concat(F.lit("https://wandb.ai/"), parts[0], F.lit("/"), parts[1], F.lit("/runs/"), parts[2]).alias("url"),
    )


def telemetry_links(
    jobs: DataFrame, run_dirs: DataFrame, urls: DataFrame, provider: str = "wandb", window: float = MATCH_WINDOW
) -> DataFrame:
    """(job_id, provider, url, links): every link of a job with how many its provider has.

    ``jobs`` and ``run_dirs`` as in ``match_run_dirs``, ``urls``: (run_dir, url). Links are counted before the folders are matched,
    so matches, of which there may be far more than jobs and folders, are never shuffled.
    """
    linked = run_dirs.join(urls.select("run_dir", "url").where(F.col("url").isNotNull()), "run_dir")
    counted = jobs.join(_match_counts(jobs, linked, window), "job_id")
    matches = match_run_dirs(counted, linked, window, ["job_id", "url", "links"])
    return matches.select("job_id", F.lit(provider).alias("provider"), "url", "links")
