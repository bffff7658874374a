"""Job-artifact edges with their artifact facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIMARY_ALGORITHM = "sha256"


def with_paths(edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Edges whose empty path is replaced by the artifact's first-seen path; pathless ones go.

    Only the edges without a path meet the artifact table, so the usual edge costs no shuffle.
    """
    named = F.coalesce(F.col("path"), F.lit("")) != ""
    filled = (
        edges.where(~named)
        .drop("path")
        .join(
            artifacts.select(F.col("id").alias("artifact_id"), F.col("first_seen_path").alias("path")),
            "artifact_id",
        )
        .where(F.coalesce(F.col("path"), F.lit("")) != "")
    )
    return edges.where(named).unionByName(filled)


def primary_digests(hashes: DataFrame, algorithm: str | None = None, strict: bool = False) -> DataFrame:
    """One digest per artifact: the primary algorithm's, else (unless strict) the first by name."""
    algorithm = algorithm or PRIMARY_ALGORITHM
    if strict:
        kept = hashes.where(F.col("algorithm") == algorithm)
        return kept.groupBy("artifact_id").agg(F.min("digest").alias("digest"))
    order = F.struct((F.col("algorithm") != algorithm).alias("other"), "algorithm", "digest")
    return hashes.groupBy("artifact_id").agg(F.min(order).alias("_first")).select(
        "artifact_id", F.col("_first.digest").alias("digest")
    )


def artifact_facts(artifacts: DataFrame, hashes: DataFrame, algorithm: str | None = None) -> DataFrame:
    """(artifact_id, size, first_seen_path, digest) of every artifact."""
    return artifacts.select(F.col("id").alias("artifact_id"), "size", "first_seen_path").join(
        primary_digests(hashes, algorithm), "artifact_id", "left"
    )


def with_facts(
    edges: DataFrame, artifacts: DataFrame, hashes: DataFrame, algorithm: str | None = None
) -> DataFrame:
    """Edges with size, path fallback and primary digest."""
    return joined_facts(edges, artifact_facts(artifacts, hashes, algorithm))


def joined_facts(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges with what ``artifact_facts`` has of their artifacts."""
    return edges.join(facts, "artifact_id").select(
        *[c for c in edges.columns if c not in ("path", "artifact_id")],
        "artifact_id",
        F.coalesce(F.nullif(F.col("path"), F.lit("")), F.col("first_seen_path")).alias("path"),
        "size",
        "digest",
    )


def newest(time: str = "timestamp", key: str = "id") -> list[Column]:
    """Newest first, ties by id."""
    return [F.col(time).desc(), F.col(key).desc()]


def is_build(job_type: str = "job_type") -> Column:
    return F.coalesce(F.col(job_type), F.lit("run")) == "build"
