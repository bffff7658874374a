"""Collections of artifacts and child collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.scale import latest, materialize, materialize_counted


def add_members(members: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New members, once per (collection, artifact or child); the least path is kept."""
    key = ["collection_id", "artifact_id", "child_collection_id"]
    fresh = members.groupBy(*key).agg(F.min("path_in_collection").alias("path_in_collection"))
    if existing is None:
        return fresh
    e = existing.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = [fresh[k].eqNullSafe(e[f"_{k}"]) for k in key]
    return fresh.join(e, same, "left_anti")


def invalid_members(members: DataFrame) -> DataFrame:
    """Members that are not exactly one of artifact and child collection."""
    return members.where(F.col("artifact_id").isNull() == F.col("child_collection_id").isNull())


def direct_members(members: DataFrame, artifacts: DataFrame, collections: DataFrame, digests: DataFrame) -> DataFrame:
    """Artifacts (with digest) and child collections (with name) of every collection."""
    files = (
        members.where(F.col("artifact_id").isNotNull())
        .join(artifacts.select(F.col("id").alias("artifact_id"), "size"), "artifact_id")
        .join(digests, "artifact_id", "left")
        .select("collection_id", F.lit("artifact").alias("kind"), F.col("artifact_id").alias("member_id"),
                "path_in_collection", "size", F.col("digest").alias("label"))
    )
    children = (
        members.where(F.col("child_collection_id").isNotNull())
        .join(collections.select(F.col("id").alias("child_collection_id"), "name"), "child_collection_id")
        .select("collection_id", F.lit("collection").alias("kind"), F.col("child_collection_id").alias("member_id"),
                "path_in_collection", F.lit(None).cast("bigint").alias("size"), F.col("name").alias("label"))
    )
    return files.unionByName(children)


def nested_artifacts(collections: DataFrame, members: DataFrame, distinct: bool = False) -> DataFrame:
    """(root, artifact_id, path_in_collection) of everything below each collection.

    A collection counts once per root, so cycles end; an artifact in two of them is listed twice
    unless ``distinct``.
    """
    children = materialize(
        members.where(F.col("child_collection_id").isNotNull()).select(
            F.col("collection_id").alias("parent"), F.col("child_collection_id").alias("collection_id")
        ).distinct(), "children",
    )
    frontier = collections.select(F.col("id").alias("root"), F.col("id").alias("collection_id"))
    reached = frontier
    while True:
        found = frontier.withColumnRenamed("collection_id", "parent").join(children, "parent").select(
            "root", "collection_id"
        ).distinct().join(reached, ["root", "collection_id"], "left_anti")
        frontier, rows = materialize_counted(found, "nested")
        if not rows:
            break
        reached = reached.unionByName(frontier)
    files = members.where(F.col("artifact_id").isNotNull()).select("collection_id", "artifact_id", "path_in_collection")
    rows = reached.join(files, "collection_id").select("root", "artifact_id", "path_in_collection")
    return rows.select("root", "artifact_id").distinct() if distinct else rows


def artifact_uploads(uploads: DataFrame) -> DataFrame:
    """Each destination of an artifact once, numbered by first upload; ``uploads`` has (artifact_id, url, ts)."""
    first = uploads.groupBy("artifact_id", "url").agg(F.min("ts").alias("first_ts"))
    return first


def collection_upload(uploads: DataFrame) -> DataFrame:
    """The last destination of every collection; ``uploads`` has (collection_id, url, ts)."""
    return latest(uploads, ["collection_id"], [F.col("ts").desc(), F.col("url").desc()]).select("collection_id", "url")
