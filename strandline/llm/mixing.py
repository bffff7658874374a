"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import running_total, written

FEW_SOURCES = 100_000  # one small row each
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Number of words of the whole text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, seed: str = "mix",
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """All of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies``.

    The budget is the sum of all sizes (words). Sources in code-point order, null last, have the
    given weights in turn. A source's target is its share by weight, at most ``repeats`` times its
    size; what exceeds that is shared again by weight.

    Each source is a queue: its documents in hashed order, ``repeats`` times over. A queued document
    finishes at the virtual time (source words up to and with it) / weight. The queue entries are
    sorted by that time over all sources and cut off where their running total passes the
    budget. Where the cut falls in a queue is one row per source (rounds completed and the last
    document taken), so that texts themselves are never shuffled.

    Defined cases: null or empty text has size 0 and is taken as often as its neighbours in the queue;
    null sources are one source; rows equal in source, id and size enter the queue together; null ids
    are equal ids; no rows give no rows. Other columns pass through; columns named ``mix_*`` as above are
    replaced.
    """
    keyed = docs.withColumns({
        "_mix_none": F.col(source).isNull().cast("int"),
        "_mix_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "_mix_id": F.col(doc_id).cast("string"),
        "mix_size": word_count(text),
    }).withColumn("_mix_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("_mix_id", F.lit("")))))
    key = ["_mix_none", "_mix_source"]
    entry = ["_mix_order", "_mix_id", "mix_size"]

    units, _ = written(
        keyed.groupBy(*key, *entry).agg(F.count(F.lit(1)).alias("rows")).withColumn("words", F.col("mix_size") * F.col("rows")),
        "units",
    )
    sources, _ = written(_targets(units, key, weights, repeats), "sources")

    queued = running_total(units, key, [F.col(c) for c in entry], "words", "upto").join(sources, key)
    entries = (
        queued.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("finish", (F.col("upto") + F.col("round") * F.col("mix_source_size")).cast("double") / F.col("weight"))
        .select("finish", "position", "round", *entry, "words", "budget")
    )
    order = [F.col(c) for c in ("finish", "position", "round", *entry)]
    taken = running_total(entries, [], order, "words", "total").where("total <= budget")
    cut = taken.groupBy("position").agg(F.max(F.struct("round", *entry)).alias("_mix_last"))

    per_source = sources.join(cut, "position", "left").select(
        *[F.col(k).alias(f"{k}_s") for k in key], "mix_source_size", "mix_target", "_mix_last"
    )
    # Texts stay where they are unless there are very many sources; then the join is split by size.
    if sources.count() <= FEW_SOURCES:
        per_source = F.broadcast(per_source)
    last = F.struct(*[F.col("_mix_last")[c].alias(c) for c in entry])
    copies = F.when(F.col("_mix_last").isNull(), 0).otherwise(F.col("_mix_last")["round"] + (F.struct(*entry) <= last).cast("int"))
    return (
        keyed.drop("mix_source_size", "mix_target", "mix_copies")
        .join(per_source, (F.col(key[0]) == F.col(f"{key[0]}_s")) & (F.col(key[1]) == F.col(f"{key[1]}_s")))
        .withColumn("mix_copies", copies)
        .drop("_mix_order", "_mix_id", "_mix_last", *key, *[f"{k}_s" for k in key])
    )


def _targets(units: DataFrame, key: list[str], weights: Sequence[int], repeats: int) -> DataFrame:
    """One row per source: position, weight, size, target and the budget of all."""
    sized, _ = written(units.groupBy(*key).agg(F.sum("words").alias("mix_source_size"), F.lit(1).alias("one")), "sized")
    # Code-point order is the order of UTF-8 bytes, which is how Spark compares strings.
    ranked = running_total(sized, [], [F.col(k) for k in key], "one", "position")
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    ranked, _ = written(
        ranked.withColumn("weight", turn)
        .withColumn("cap", F.col("mix_source_size") * repeats)
        .withColumn("full_at", F.col("cap").cast("double") / F.col("weight")),
        "ranked",
    )
    zero = F.lit(0).cast("long")
    budget, all_weight = ranked.agg(F.coalesce(F.sum("mix_source_size"), zero), F.coalesce(F.sum("weight"), zero)).first()
    order = [F.col("full_at"), F.col("position")]
    filling = running_total(running_total(ranked, [], order, "cap", "caps"), [], order, "weight", "weights")
    # The first source, in the order in which they fill up, that is not full by its fair share: it and
    # all after it share by weight what the full ones leave.
    level = (
        filling.withColumn("rest", F.lit(budget).cast("long") - F.col("caps") + F.col("cap"))
        .withColumn("sharing", F.lit(all_weight).cast("long") - F.col("weights") + F.col("weight"))
        .where(F.col("rest") * F.col("weight") <= F.col("cap") * F.col("sharing"))
        .agg(F.min(F.struct("full_at", "position", "rest", "sharing")))
        .first()[0]
    ) or (0.0, 0, 0, 1)
    full_at, position, rest, sharing = level
    before = (F.col("full_at") < full_at) | ((F.col("full_at") == full_at) & (F.col("position") < position))
    return ranked.select(
        *key, "position", "weight", "mix_source_size", F.lit(budget).cast("long").alias("budget"),
        F.when(before, F.col("cap").cast("double")).otherwise(
            F.lit(rest).cast("double") * F.col("weight") / F.lit(sharing)
        ).alias("mix_target"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    out = mix_sources(docs, **options).where("mix_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*docs.columns)
