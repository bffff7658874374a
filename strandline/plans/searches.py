"""Full-text search through the inverted index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.operators.search import SearchIndex
from strandline.plans.registry import query
from strandline.scale import scratch_root
from strandline.sources.derived import World, duckdb_query

# Query texts, and what they ask of the words of a job.
SEARCHES = {
    "both": ("python urgent", "contains(words, ' python ') and contains(words, ' urgent ')"),
    "either": ("urgent OR high step_3", "(contains(words, ' urgent ') or contains(words, ' high ')) and contains(words, ' step 3 ')"),
    "none": ("python NOT token NOT key", "contains(words, ' python ') and not contains(words, ' token ') and not contains(words, ' key ')"),
    "beginning": ("ste* med*", "contains(words, ' ste') and contains(words, ' med')"),
    "phrase": ('"step 7 py prio" AND low', "contains(words, ' step 7 py prio ') and contains(words, ' low ')"),
    "phrase_beginning": ('"prio 4"* Python', "contains(words, ' prio 4') and contains(words, ' python ')"),
    "across_columns": ('"low step"', "contains(words, ' low step ')"),
    "nothing": ("python absentword", "false"),
    "only_excluded": ("NOT python", "false"),
    "alternatives": ('abcdefghijklmnop1234 OR "my token" OR postg* NOT urgent', """(contains(words, ' abcdefghijklmnop1234 ') or contains(words, ' my token ')
       or contains(words, ' postg')) and not contains(words, ' urgent ')"""),
}
_SPOKEN = """spoken as (select *, ' ' || regexp_replace(lower(command), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' |' || ' ' ||
  regexp_replace(lower(script), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' as words from jobs)"""


def indexed_jobs(w: World) -> SearchIndex:
    """The jobs in two batches; a tenth come in both, with another command at first."""
    index = SearchIndex(f"{scratch_root(w.spark)}/search-{uuid.uuid4().hex}")
    jobs = w.jobs.select("id", "timestamp", "command", "script")
    early = jobs.where("id % 3 <> 0 or id % 10 = 3").withColumn("command", F.when(F.expr("id % 10 = 3"), "python urgent absentword low step").otherwise(F.col("command")))
    index.append(early, 0)
    index.append(jobs.where("id % 3 = 0 or id % 10 = 3"), 1)
    return index


@query("searched_jobs", "D5", duckdb_query(" union all ".join(
    f"(select '{name}' as query_id, id as job_id, timestamp from spoken where {condition} order by timestamp desc, id desc limit 25)"
    for name, (_, condition) in SEARCHES.items()), _SPOKEN))
def _(w):
    asked = w.spark.createDataFrame([(name, text) for name, (text, _) in SEARCHES.items()], "query_id string, query string")
    return indexed_jobs(w).search(asked, 25)


@query("search_terms", "D5", duckdb_query(
    "select term, count(*) as jobs from (select distinct id, unnest(string_split(replace(words, '|', ' '), ' ')) as term from spoken) where term <> '' group by term", _SPOKEN))
def _(w):
    from strandline.operators.search import words

    found = words(["command", "script"], w.jobs.withColumnRenamed("id", "job_id"), "job_id")
    return found.select("job_id", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("jobs"))
