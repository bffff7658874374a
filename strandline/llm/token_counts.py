"""Token counts from piece counts of distinct pre-tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import mul

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import pretokens

KEPT = 500_000  # pre-tokens whose counts a worker keeps between batches
LONGEST = 64  # longer pre-tokens are counted for their batch only

_known: dict[str, dict[str, int]] = {}


def count_batch(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text: its pre-token frequencies joined to the pieces of each distinct pre-token."""
    vocabulary, pieces = pretokens.load(path), _known.setdefault(path, {})
    frequencies = [Counter(vocabulary.groups(t)) for t in texts]
    new = list(set().union(*frequencies).difference(pieces))
    if len(pieces) + len(new) > KEPT:
        pieces.clear()
        new = list(set().union(*frequencies))
    pieces.update(zip(new, vocabulary.counts(new)))
    totals = [sum(map(mul, f.values(), map(pieces.__getitem__, f))) for f in frequencies]
    for g in new:
        if len(g) > LONGEST:
            del pieces[g]
    return totals


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """``docs`` without their text, with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``path`` names a vocabulary file of the tokenizers library (see ``PreTokens``) on every
    executor. Each distinct pre-token of a batch is encoded at most once and only its number of
    pieces is kept; a text's count is the sum over its pre-token frequencies. The join is made in the
    task that holds the texts: the (document, pre-token) pairs are a few times the size of the texts, so
    shuffling them to a global table would cost more than the encoding it saves.

    Defined cases: null counts as empty (0 bytes, 0 tokens); special strings in a text are one token
    each, as the library has it; white space alone is counted as any text. Repeated rows stay; no rows
    give no rows; other columns pass through, except ones named as the three new columns.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(count_batch([t if isinstance(t, str) else None for t in texts], path), dtype="int64")

    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    return docs.select(
        *kept,
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        count(F.col(text)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
