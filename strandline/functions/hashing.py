"""Digest algorithms by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHMS: dict[str, Callable[[Column], Column]] = {
    "sha256": lambda content: F.sha2(content, 256),
    "sha512": lambda content: F.sha2(content, 512),
    "md5": F.md5,
}

def register_algorithm(name: str, digest: Callable[[Column], Column]) -> None:
    ALGORITHMS[name] = digest


def chosen_algorithms(
    primary: str, operation: Sequence[str] = (), extra: Sequence[str] = (), only: bool = False
) -> list[str]:
    """Primary, per-operation and the caller's algorithms once each; the caller's alone if ``only``."""
    wanted = list(extra) if only and extra else [primary, *operation, *extra]
    return list(dict.fromkeys(wanted))


def digest_columns(content: Column, algorithms: Sequence[str]) -> list[Column]:
    unknown = [a for a in algorithms if a not in ALGORITHMS]
    if unknown:
        raise ValueError(f"unknown digest algorithms: {', '.join(unknown)}")
    return [ALGORITHMS[a](content).alias(a) for a in algorithms]
