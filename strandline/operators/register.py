"""Validation, batching and payload tables before registration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.urls import upload_url
from strandline.scale import materialize, running_rank

# Limits of one registration request and the accepted source types.
MAX_BATCH_BYTES = 90 * 1024
LINKS_PER_REQUEST = 100
SOURCE_TYPES = ["s3", "gs", "https"]
PLACEHOLDERS = ["unknown", "Unknown", ""]


def _missing(column: str) -> Column:
    return F.col(column).isNull() | F.col(column).isin(PLACEHOLDERS)


def _errors(*checks: tuple[Column, Column | str]) -> Column:
    found = [F.when(F.coalesce(bad, F.lit(False)), F.lit(text) if isinstance(text, str) else text) for bad, text in checks]
    return F.array_compact(F.array(*found))


def validate_sessions(sessions: DataFrame) -> DataFrame:
    """Adds ``errors``; a session is valid when it is empty."""
    return sessions.withColumn(
        "errors",
        _errors(
            (_missing("session_hash"), "session_hash is required"),
            (_missing("git_repo"), "git_repo is required (not in a git repository?)"),
            (_missing("git_commit"), "git_commit is required (no commits yet?)"),
            (_missing("git_branch"), "git_branch is required (detached HEAD?)"),
        ),
    )


def validate_jobs(jobs: DataFrame) -> DataFrame:
    ts, step = F.col("timestamp"), F.col("step_number")
    return jobs.withColumn(
        "errors",
        _errors(
            (_missing("command"), "command is required"),
            (ts.isNull(), "timestamp is required"),
            (ts <= 0, F.format_string("timestamp must be positive, got %.1f", ts.cast("double"))),
            (_missing("session_hash"), "session_hash is required"),
            (_missing("job_uid"), "job_uid is required"),
            (_missing("git_commit"), "git_commit is required"),
            (_missing("git_branch"), "git_branch is required"),
            (step.isNull(), "step_number is required"),
            (step < 1, F.concat(F.lit("step_number must be >= 1, got "), step.cast("string"))),
        ),
    )


def validate_artifacts(artifacts: DataFrame) -> DataFrame:
    """``artifacts``: (hashes array<struct<algorithm, digest>>, size, source_type, session_hash, …)."""

    def lacks(part: str):
        def message(h: Column, i: Column) -> Column:
            return F.when(
                F.coalesce(h[part], F.lit("")) == "",
                F.concat(F.lit("hashes["), i.cast("string"), F.lit(f"].{part} is required")),
            )

        return message

    # Messages of one hash follow each other: algorithm, then digest.
    per_hash = F.flatten(
        F.transform("hashes", lambda h, i: F.array(lacks("algorithm")(h, i), lacks("digest")(h, i)))
    )
    none = F.coalesce(F.size("hashes"), F.lit(0)) < 1
    source = F.col("source_type")
    rest = _errors(
        (F.col("size").isNull() | (F.col("size") < 0), "size is required and must be non-negative"),
        (
            source.isNotNull() & ~source.isin(SOURCE_TYPES),
            F.concat(F.lit("source_type must be 's3', 'gs', 'https', or None, got '"), source, F.lit("'")),
        ),
        (_missing("session_hash"), "session_hash is required"),
    )
    first = F.when(none, F.array(F.lit("at least one hash is required"))).otherwise(F.array_compact(per_hash))
    return artifacts.withColumn("errors", F.concat(first, rest))


# -- batching ----------------------------------------------------------------------------------


def _batch_ends(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For a batch begun at each item, where the next one begins; and the running byte totals.

    An empty batch counts two bytes; an item above the limit stands alone.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    full = np.searchsorted(total, total[:-1] + (limit - 2), side="right") - 1
    return np.maximum(full, np.arange(len(sizes)) + 1), total


def _first_start(taken: np.ndarray, carry: int, limit: int) -> int:
    """The first item that no longer fits into a batch open with ``carry`` bytes; 0 bytes = none open."""
    if carry == 0:
        return 0
    return max(0, int(np.searchsorted(taken, limit - carry, side="right")) - 1)


# How a run of items goes on, for every number of bytes that the batch before it may be open with: rows (lo, hi, begun,
# carry, adds), each for more than ``lo`` and at most ``hi`` bytes. ``begun`` batches are begun in it and the last is
# open with ``carry`` bytes; with ``adds`` none is begun, and the open one has ``carry`` bytes more.
STEPS = ["lo", "hi", "begun", "carry", "adds"]
FAR = np.iinfo(np.int64).max // 4


def _steps_of(sizes: np.ndarray, limit: int) -> pd.DataFrame:
    ends, total = _batch_ends(sizes, limit)
    n = len(ends)
    begun, carry = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        nxt = ends[i]
        begun[i] = 1 + begun[nxt]
        carry[i] = carry[nxt] if nxt < n else 2 + total[n] - total[i]
    # The first batch of its own begins within a limit's worth of items.
    spots = np.arange(min(n, int(np.searchsorted(total, limit, side="right"))) + 1)
    hi = np.maximum(limit - total[spots], 0)
    hi[0] = FAR
    lo = np.append(hi[1:], 0)
    out = pd.DataFrame({"lo": lo, "hi": hi, "begun": begun[spots], "carry": np.where(spots == n, total[n], carry[spots]), "adds": spots == n})
    none_open = pd.DataFrame({"lo": [-1], "hi": [0], "begun": [begun[0]], "carry": [carry[0]], "adds": [False]})
    return _merged_steps(pd.concat([none_open, out[out["lo"] < out["hi"]]]))


def _merged_steps(steps: pd.DataFrame) -> pd.DataFrame:
    """Neighbours with one outcome become one."""
    steps = steps.sort_values("lo", ignore_index=True)
    same = (steps[["begun", "carry", "adds"]] == steps[["begun", "carry", "adds"]].shift()).all(axis=1)
    firsts = steps[~same].copy()
    firsts["hi"] = steps.groupby((~same).cumsum().to_numpy())["hi"].max().to_numpy()
    return firsts[STEPS]


def _one_after_other(first: pd.DataFrame, then: pd.DataFrame) -> pd.DataFrame:
    """The steps of two runs of items as of one."""
    then = then.sort_values("lo", ignore_index=True)
    edge = then["hi"].to_numpy()
    rows = []
    for lo, hi, begun, carry, adds in first[STEPS].itertuples(index=False):
        if not adds:
            t = then.iloc[int(np.searchsorted(edge, carry, side="left"))]
            rows.append((lo, hi, begun + t.begun, carry + t.carry if t.adds else t.carry, False))
            continue
        for t_lo, t_hi, t_begun, t_carry, t_adds in then[STEPS].itertuples(index=False):
            a, b = max(lo, t_lo - carry), min(hi, t_hi - carry)
            if a < b:
                rows.append((a, b, t_begun, carry + t_carry if t_adds else t_carry, t_adds))
    return _merged_steps(pd.DataFrame(rows, columns=STEPS))


def pack_by_size(
    items: DataFrame, keys: list[str], order: list[str], size: str, limit: int = MAX_BATCH_BYTES, slice_rows: int = 1_000_000
) -> DataFrame:
    """Adds ``batch`` (from 0): items in order, every batch as full as the byte limit allows.

    The packing is the sequential one, for groups of any size. A group is cut into slices by position. A slice is a
    map from the bytes that the batch before it is open with to the batches it begins and the bytes the last of them is
    open with: a few steps, as its first new batch begins within one limit's worth of items. Such maps follow each
    other by pairs, which doubles the items they stand for every round; then the bytes at the start of each slice
    come down the same way, and every slice is packed by itself. No task sees more than two maps or one slice.
    """
    placed = running_rank(items, keys, [F.col(c) for c in order], "_pos")
    placed = materialize(placed.withColumn("_slice", F.floor((F.col("_pos") - 1) / slice_rows).cast("bigint")), "placed")
    named = ", ".join(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys)
    thin = placed.select(*keys, "_slice", "_pos", F.col(size).cast("bigint").alias("_size"))
    steps_type = f"lo bigint, hi bigint, begun bigint, carry bigint, adds boolean, _node bigint, {named}"

    def labelled(out: pd.DataFrame, pdf: pd.DataFrame, **more) -> pd.DataFrame:
        return out.assign(**more, **{k: pdf[k].iloc[0] for k in keys})

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        return labelled(_steps_of(pdf.sort_values("_pos")["_size"].to_numpy(), limit), pdf, _node=pdf["_slice"].iloc[0])

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        node = int(pdf["_node"].min())
        first, then = pdf[pdf["_node"] == node], pdf[pdf["_node"] != node]
        return labelled(_one_after_other(first, then) if len(then) else first[STEPS], pdf, _node=node // 2)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        ends, total = _batch_ends(pdf["_size"].to_numpy(), limit)
        starts, at = [], _first_start(total, int(pdf["_carry"].iloc[0]), limit)
        while at < len(ends):
            starts.append(at)
            at = ends[at]
        nth = np.searchsorted(np.array(starts, dtype=np.int64), np.arange(len(ends)), side="right")
        return pdf[[*keys, "_pos"]].assign(batch=int(pdf["_batches"].iloc[0]) + nth - 1)

    levels = [materialize(thin.groupBy(*keys, "_slice").applyInPandas(report, steps_type), "steps")]
    last = levels[0].agg(F.coalesce(F.max("_node"), F.lit(0))).first()[0]
    while last:
        levels.append(materialize(levels[-1].groupBy(*keys, F.floor(F.col("_node") / 2)).applyInPandas(pair, steps_type), "steps"))
        last //= 2
    none = F.lit(0).cast("bigint")
    starts = levels.pop().select(*keys, "_node").distinct().withColumns({"_carry": none, "_batches": none})
    while levels:
        level = levels.pop()
        left = starts.withColumn("_node", F.col("_node") * 2)
        met = left.join(level, [*keys, "_node"]).where("lo < _carry and _carry <= hi")
        right = met.select(
            *keys, (F.col("_node") + 1).alias("_node"), F.when(F.col("adds"), F.col("_carry") + F.col("carry")).otherwise(F.col("carry")).alias("_carry"),
            (F.col("_batches") + F.when(F.col("adds"), 0).otherwise(F.col("begun"))).alias("_batches"),
        )
        starts = materialize(left.unionByName(right).join(level.select(*keys, "_node").distinct(), [*keys, "_node"], "left_semi"), "slice-starts")
    packed = thin.join(starts.withColumnRenamed("_node", "_slice"), [*keys, "_slice"]).groupBy(*keys, "_slice").applyInPandas(pack, f"{named}, _pos bigint, batch bigint")
    return placed.join(packed, [*keys, "_pos"]).drop("_pos", "_slice")


def pack_links(links: DataFrame, keys: list[str], order: list[str], per_request: int = LINKS_PER_REQUEST) -> DataFrame:
    """Adds ``batch``: links in order, a fixed number per request."""
    placed = running_rank(links, keys, [F.col(c) for c in order], "_pos")
    return placed.withColumn("batch", F.floor((F.col("_pos") - 1) / per_request).cast("bigint")).drop("_pos")


# -- payloads ----------------------------------------------------------------------------------


def usable_links(structured: DataFrame, digests: DataFrame) -> DataFrame:
    """(job_id, direction, digest, path): structured links where a job has any, else bare digests;
    links without digest or path go.

    ``structured``: (job_id, direction, digest, path); ``digests``: (job_id, direction, digest).
    """
    have = structured.select("job_id", "direction").distinct()
    bare = digests.join(have, ["job_id", "direction"], "left_anti").select(
        "job_id", "direction", "digest", F.lit("").alias("path")
    )
    every = structured.select("job_id", "direction", "digest", "path").unionByName(bare)
    return every.where((F.coalesce("digest", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != ""))


def session_hash(folder: Column, session_id: Column, suffix: Column) -> Column:
    """sha256 of ``folder:id``, or ``folder:suffix`` without a session."""
    return F.sha2(F.concat_ws(":", folder, F.coalesce(session_id.cast("string"), suffix)), 256)


def artifact_payloads(artifacts: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Payload rows of artifacts with a digest of ``algorithm``; a missing size counts as 0.

    ``artifacts``: (session_hash, digest, size, source_type, source_url).
    """
    return artifacts.where(F.coalesce("digest", F.lit("")) != "").select(
        "session_hash",
        F.array(F.struct(F.lit(algorithm).alias("algorithm"), "digest")).alias("hashes"),
        F.coalesce("size", F.lit(0).cast("bigint")).alias("size"),
        "source_type",
        F.nullif("source_url", F.lit("")).alias("source_url"),
    )


def payload_bytes(payloads: DataFrame) -> DataFrame:
    """Adds ``bytes``: the length of a payload row as ASCII JSON with blanks after its separators, and of the
    separator to the next. A source type may be null; a URL is only there if it is set.
    """
    per_hash = F.aggregate(
        "hashes", F.lit(0),
        lambda total, h: total + len('{"algorithm": , "digest": }, ') + _json_text(h["algorithm"]) + _json_text(h["digest"]),
    )
    size = (
        len('{"hashes": [], "size": , "source_type": , "session_hash": }') + per_hash - len(", ")
        + F.length(F.col("size").cast("string")) + _json_text(F.col("source_type")) + _json_text(F.col("session_hash"))
    )
    if "source_url" in payloads.columns:
        size = size + F.when(F.coalesce("source_url", F.lit("")) != "", len(', "source_url": ') + _json_text(F.col("source_url"))).otherwise(0)
    return payloads.withColumn("bytes", (size + 2).cast("int"))


def _json_text(text: Column) -> Column:
    """Length of a text as an ASCII JSON string, or of null."""

    def many(characters: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{characters}]", ""))

    two = many(r'"\\\n\r\t\x08\f')  # one more character each
    six = many(r"\x00-\x07\x0b\x0e-\x1f\x80-\x{ffff}")
    twelve = many(r"\x{10000}-\x{10ffff}")
    escaped = two + 5 * six + 11 * twelve
    plain = F.length(text) + 2
    return F.when(text.isNull(), 4).when(text.rlike(r'["\\\x00-\x1f\x80-\x{10ffff}]'), plain + escaped).otherwise(plain)


def job_payloads(jobs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Job rows with defaults filled from the session; ``sessions``: (session_id, session_hash, commit, branch)."""
    blank = F.lit("")

    def first(*cols: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(c), blank) for c in cols], blank)

    return jobs.join(sessions, "session_id").select(
        "session_id", "session_hash", F.col("id").alias("job_id"), "job_uid",
        F.coalesce("command", blank).alias("command"), F.coalesce("timestamp", F.lit(0).cast("bigint")).alias("timestamp"),
        first("git_commit", "commit").alias("git_commit"), first("git_branch", "branch").alias("git_branch"),
        F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"), F.coalesce("exit_code", F.lit(0)).alias("exit_code"),
        F.coalesce(F.nullif("job_type", blank), F.lit("run")).alias("job_type"), F.coalesce("step_number", F.lit(0)).alias("step_number"),
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def links_of_accepted(links: DataFrame, jobs: DataFrame) -> DataFrame:
    """Links of the jobs that passed validation."""
    return links.join(accepted(jobs).select("job_id"), "job_id", "left_semi")


def uploaded_artifacts(files: DataFrame, destination: str, is_dir: bool) -> DataFrame:
    """Adds ``source_url``: where each file (relative_path) was uploaded."""
    return files.withColumn("source_url", upload_url(destination, F.col("relative_path"), is_dir))


def registration_outcome(jobs: DataFrame, artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """Counters per session_hash from validated jobs and artifacts (``errors``) and usable links."""
    ok = F.size("errors") == 0

    def counted(df: DataFrame, good: str, bad: str) -> DataFrame:
        return df.groupBy("session_hash").agg(F.count_if(ok).alias(good), F.count_if(~ok).alias(bad))

    linked = links_of_accepted(links, jobs).join(accepted(jobs).select("job_id", "session_hash"), "job_id").groupBy(
        "session_hash").agg(F.count(F.lit(1)).alias("links_created"))
    zero = F.lit(0).cast("bigint")
    return (
        counted(jobs, "jobs_created", "jobs_failed")
        .join(counted(artifacts, "artifacts_registered", "artifacts_failed"), "session_hash", "full")
        .join(linked, "session_hash", "full")
        .select("session_hash", *[F.coalesce(c, zero).alias(c) for c in (
            "jobs_created", "jobs_failed", "artifacts_registered", "artifacts_failed", "links_created")])
    )


# Bounds of the record fields; (table, field, rule, SQL predicate that must hold).
RULES = [
    ("jobs", "job_uid", "length 6 to 12", "length(job_uid) between 6 and 12"),
    ("jobs", "timestamp", "above 0", "timestamp > 0"),
    ("jobs", "command", "length 1 to 65535", "length(command) between 1 and 65535"),
    ("jobs", "step_number", "at least 1", "step_number >= 1"),
    ("jobs", "git_commit", "length 7 to 40", "length(git_commit) between 7 and 40"),
    ("jobs", "git_branch", "length up to 255", "length(git_branch) <= 255"),
    ("jobs", "duration_seconds", "at least 0", "duration_seconds >= 0"),
    ("jobs", "step_name", "length up to 255", "length(step_name) <= 255"),
    ("jobs", "synced_at", "above 0", "synced_at > 0"),
    ("artifacts", "id", "length 1 to 64", "length(id) between 1 and 64"),
    ("artifacts", "size", "at least 0", "size >= 0"),
    ("artifacts", "first_seen_at", "above 0", "first_seen_at > 0"),
    ("artifacts", "source_type", "length up to 32", "length(source_type) <= 32"),
    ("artifacts", "source_url", "length up to 2048", "length(source_url) <= 2048"),
    ("artifacts", "synced_at", "above 0", "synced_at > 0"),
]
REQUIRED = {"jobs": ["job_uid", "timestamp", "command"], "artifacts": ["id", "size", "first_seen_at"]}


def rule_violations(table: str, rows: DataFrame) -> DataFrame:
    """(field, rule, violations) of one table; a missing value only breaks a required field."""
    rules = [r for r in RULES if r[0] == table and r[1] in rows.columns]
    counts = []
    for i, (_, field, _, predicate) in enumerate(rules):
        broken = f"not ({predicate})" + (f" or {field} is null" if field in REQUIRED[table] else "")
        counts.append(F.count_if(F.expr(f"coalesce({broken}, false)")).alias(f"v{i}"))
    listed = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"))
        for i, (_, f, rule, _) in enumerate(rules)
    ])
    return rows.agg(*counts).select(F.explode(listed).alias("r")).select("r.*")


# -- preview -----------------------------------------------------------------------------------


def registration_preview(collected: DataFrame, inputs: DataFrame, outputs: DataFrame, digests: DataFrame, detections: DataFrame) -> DataFrame:
    """What a registration would send, one row per group: jobs, artifacts, links, kinds of secrets.

    ``collected``: (group_id, job_id); ``digests``: (group_id, digest); ``detections``: (session_id,
    pattern_id, …) of the sessions' records.
    """
    from strandline.operators.summary import link_counts

    jobs = collected.groupBy("group_id").agg(F.count(F.lit(1)).alias("jobs"))
    artifacts = digests.groupBy("group_id").agg(F.count(F.lit(1)).alias("artifacts"))
    kinds = detections.select(F.col("session_id").alias("group_id"), "pattern_id").groupBy("group_id").agg(
        F.count_distinct("pattern_id").alias("secret_kinds"))
    zero = F.lit(0).cast("bigint")
    return (
        jobs.join(artifacts, "group_id", "left")
        .join(link_counts(collected, inputs, outputs), "group_id", "left")
        .join(kinds, "group_id", "left")
        .select("group_id", "jobs", *[F.coalesce(c, zero).alias(c) for c in ("artifacts", "links", "secret_kinds")])
    )
