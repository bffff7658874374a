"""Roll-ups per repository and per storage location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.urls import (
    canonical_repository, https_address, is_ssh, storage_bucket, storage_folder, storage_scheme,
)


def repository_activity(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Jobs, sessions, produced artifacts and URL spellings per canonical repository."""
    keyed = jobs.where(F.col("git_repo").isNotNull()).withColumn("repository", canonical_repository(F.col("git_repo")))
    totals = keyed.groupBy("repository").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("git_repo").alias("spellings"),
    )
    made = outputs.select("job_id", "artifact_id").join(keyed.select(F.col("id").alias("job_id"), "repository"), "job_id")
    artifacts = made.groupBy("repository").agg(F.count_distinct("artifact_id").alias("artifacts"))
    return totals.join(artifacts, "repository", "left").select(
        "repository", "jobs", "sessions", "spellings", F.coalesce("artifacts", F.lit(0).cast("bigint")).alias("artifacts")
    )


def repository_spellings(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("git_repo").isNotNull()).select(
        canonical_repository(F.col("git_repo")).alias("repository"), F.col("git_repo").alias("url")
    ).distinct()


def clone_urls(jobs: DataFrame) -> DataFrame:
    """Per repository address: whether it is ssh and its HTTPS form."""
    urls = jobs.where(F.col("git_repo").isNotNull()).select(F.col("git_repo").alias("url")).distinct()
    return urls.select("url", is_ssh(F.col("url")).alias("is_ssh"), https_address(F.col("url")).alias("https_url"))


def matching_checkouts(plans: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Plans whose repository is checked out: (plan_id, checkout, checkouts) by equal canonical addresses.

    The checkouts of a repository are folded to the first by name and their number before they meet the
    plans, so that many of both do not multiply.
    """
    wanted = plans.select("plan_id", canonical_repository(F.col("git_repo")).alias("repository"))
    have = checkouts.select("checkout", canonical_repository(F.col("remote_url")).alias("repository")).groupBy("repository").agg(
        F.min("checkout").alias("checkout"), F.count(F.lit(1)).alias("checkouts"))
    return wanted.join(have, "repository").select("plan_id", "checkout", "checkouts")


def storage_usage(objects: DataFrame) -> DataFrame:
    """Objects and bytes per scheme, bucket and folder, with subtotals; ``objects`` has (source_url, size)."""
    url = F.col("source_url")
    return (
        objects.where(url.isNotNull())
        .select(storage_scheme(url).alias("scheme"), storage_bucket(url).alias("bucket"), storage_folder(url).alias("folder"), "size")
        .rollup("scheme", "bucket", "folder")
        .agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"), F.grouping_id().alias("level"))
    )
