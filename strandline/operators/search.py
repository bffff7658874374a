"""Full-text search by a positional inverted index: many queries at once, answered by joins on postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.references import search_text
from strandline.operators.edges import newest
from strandline.scale import materialize, prefix_keys, top_n

GAP = 1_000_000  # positions between two columns, so that no phrase reaches from one into the next


def words(text_columns: list[str], table: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, position): every word of the columns; positions of one column follow each other."""
    texts = F.split(search_text(*text_columns), r"\|") if len(text_columns) > 1 else F.array(search_text(*text_columns))
    parts = table.select(*keys, F.posexplode(texts).alias("_column", "_text"))
    split = parts.select(*keys, "_column", F.posexplode(F.split(F.trim("_text"), " +")).alias("_at", "term"))
    return split.where("term <> ''").select(*keys, "term", (F.col("_column").cast("bigint") * GAP + F.col("_at")).alias("position"))


def literals(queries: DataFrame) -> DataFrame:
    """(query_id, clause, literal, kind, negated, words) of queries (query_id, query).

    A query is a row of terms, all of which must be found; ``"a b"`` is a phrase, ``a*`` a beginning, ``OR`` between two
    terms accepts either, ``NOT`` before a term excludes it. There are no brackets and no column names.
    """
    token = F.regexp_extract_all("query", F.lit(r'("[^"]*"\*?|[^\s"]+)'), F.lit(1))
    tokens = queries.select("query_id", F.posexplode(token).alias("at", "token")).where("token <> 'AND'")
    # Windows over the tokens of one query, a handful.
    order = Window.partitionBy("query_id").orderBy("at")
    marked = tokens.withColumn("before", F.lag("token").over(order))
    terms = marked.where("token not in ('OR', 'NOT')").withColumns({
        "negated": F.coalesce(F.col("before") == "NOT", F.lit(False)),
        "joined": F.coalesce(F.col("before") == "OR", F.lit(False)),
        "text": F.trim(F.regexp_replace(F.lower("token"), r"[^\p{L}\p{N}]+", " ")),
    }).where("text <> ''")
    clause = F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order)
    return terms.select(
        "query_id", clause.alias("clause"), F.col("at").alias("literal"),
        F.when(F.col("token").endswith("*"), "prefix").otherwise("phrase").alias("kind"), "negated", F.split("text", " ").alias("words"),
    )


class SearchIndex:
    """Postings (term, job_id, timestamp, position) of commands and scripts in a folder, appended batch by batch.

    Postings lie in ``buckets`` folders by term and are sorted by it, so a search opens the folders of its own terms
    and reads their row groups alone; jobs are never scanned. A batch written again replaces itself.
    """

    def __init__(self, folder: str, buckets: int = 64):
        self.folder, self.buckets = folder.rstrip("/"), buckets

    def _bucket(self, term: str = "term"):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def append(self, jobs: DataFrame, batch: int) -> None:
        """Add ``jobs`` (id, timestamp, command, script); those known from earlier batches are found as they are now."""
        spark = jobs.sparkSession
        ids = jobs.select(F.col("id").alias("job_id")).distinct()
        ids.write.mode("overwrite").parquet(f"{self.folder}/ids/batch={batch}")
        known = self._table(spark, "ids").where(F.col("batch") < batch).select("job_id").distinct()
        self.remove(ids.join(known, "job_id", "left_semi"), batch)
        found = words(["command", "script"], jobs.withColumnRenamed("id", "job_id"), "job_id", "timestamp").withColumn("bucket", self._bucket())
        # Buckets of a hot term are split by job before they are written.
        spread = found.repartitionByRange("bucket", "term", "job_id").sortWithinPartitions("bucket", "term", "job_id")
        spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/batch={batch}")
        terms = found.groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
        terms.write.mode("overwrite").parquet(f"{self.folder}/terms/batch={batch}")

    def remove(self, ids: DataFrame, batch: int) -> None:
        """Postings of the jobs ``ids`` (job_id) from before ``batch`` are no longer found."""
        ids.select("job_id").write.mode("overwrite").parquet(f"{self.folder}/removed/batch={batch}")

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def terms(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "terms").groupBy("term").agg(F.sum("postings").alias("postings"))

    def search(self, queries: DataFrame, n: int = 50) -> DataFrame:
        """(query_id, job_id, timestamp): the newest ``n`` jobs of each query (query_id, query), newest first by ``timestamp``.

        All literals of all queries meet the postings in one join; words of a phrase are matched by their distance,
        and beginnings are the terms of the vocabulary that have them. A job matches if each clause has a literal in
        it that is not negated and none of its negated ones are. Queries without a term that must be found have no result.
        """
        spark = queries.sparkSession
        asked = materialize(literals(queries), "literals")
        each = asked.select("query_id", "clause", "literal", "kind", "negated", F.size("words").alias("length"), F.posexplode("words").alias("offset", "term"))
        # The last word of a beginning stands for every term that begins with it.
        open_ = (F.col("kind") == "prefix") & (F.col("offset") == F.col("length") - 1)
        begins = each.where(open_).withColumnRenamed("term", "begin")
        known = prefix_keys(begins, "begin", self.terms(spark).select("term"), "term")
        spelled = known.select("term", F.explode("_keys").alias("_n")).select("term", F.expr("substring(term, 1, _n)").alias("begin"))
        wanted = materialize(each.where(~open_).unionByName(begins.join(spelled, "begin").drop("begin")), "wanted-terms")
        places = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # at most ``buckets``
        postings = self._table(spark, "postings").where(F.col("bucket").isin(places)).drop("bucket")
        removed = self._table(spark, "removed").groupBy("job_id").agg(F.max("batch").alias("until"))
        hits = postings.join(wanted, "term").join(removed, "job_id", "left").where("until is null or batch >= until")
        # A phrase begins where all of its words stand at their distances.
        start = hits.groupBy("query_id", "clause", "literal", "negated", "length", "job_id", "timestamp", (F.col("position") - F.col("offset")).alias("start")).agg(
            F.count_distinct("offset").alias("found")
        )
        met = start.where("found = length").select("query_id", "clause", "literal", "negated", "job_id", "timestamp").distinct()
        needed = asked.where("not negated").groupBy("query_id").agg(F.count_distinct("clause").alias("clauses"))
        by_job = met.groupBy("query_id", "job_id", "timestamp").agg(
            F.count_distinct(F.when(~F.col("negated"), F.col("clause"))).alias("clauses"), F.bool_or("negated").alias("excluded")
        )
        matching = by_job.where("not excluded").join(needed, ["query_id", "clauses"]).select("query_id", F.col("job_id").alias("id"), "timestamp")
        return top_n(matching, ["query_id"], newest(), n).withColumnRenamed("id", "job_id")
