"""The named queries: what to run on a data folder, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from strandline.sources.derived import World


@dataclass(frozen=True)
class Query:
    name: str
    covers: str  # operator ids of the inventory
    run: Callable[[World], DataFrame]
    oracle: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None):
    """Register a function of a World under a name."""

    def add(fn: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, covers, fn, oracle)
        return fn

    return add
