"""Column expressions over file paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_with_any(path: Column, prefixes: Iterable[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | path.startswith(prefix)
    return hit


def contains_any(path: Column, parts: Iterable[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | path.contains(part)
    return hit


def under(path: Column, folder: Column) -> Column:
    """Whether ``path`` is ``folder`` or lies in it; false for an empty folder."""
    inside = (path == folder) | path.startswith(F.concat(folder, F.lit("/")))
    return F.coalesce(inside & (folder != ""), F.lit(False))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def mask_numbers(path: Column) -> Column:
    """Runs of three or more digits after ``_`` or ``-`` at the end of a name part become ``*``."""
    return F.regexp_replace(path, r"([_-])\d{3,}(?=\.|$|/)", "$1*")


def normal_path(path: Column, root: Column, home: Column) -> Column:
    """Path relative to the repository, else to the home folder, else its base name; numbers masked."""

    def inner(folder: Column) -> Column:
        rest = F.substr(path, F.length(folder) + 2)
        return F.when(under(path, folder), F.when(path == folder, ".").otherwise(rest))

    return mask_numbers(F.coalesce(inner(root), inner(home), base_name(path)))


def resolve_relative(path: Column, cwd: Column) -> Column:
    """Absolute path of a syscall argument: joined to the working directory, ``./`` removed."""
    relative = F.concat(cwd, F.lit("/"), F.regexp_replace(path, r"^(?:\./+)+", ""))
    return F.when(path.startswith("/") | cwd.isNull(), path).otherwise(F.regexp_replace(relative, r"/\./", "/"))


def after_site_packages(path: Column) -> Column:
    """What follows the first ``site-packages/``; null without it."""
    marker = "site-packages/"
    return F.when(path.contains(marker), F.substr(path, F.instr(path, marker) + F.lit(len(marker))))
