"""Column expressions over repository and storage URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCP = r"^git@([^:/]+):(.+)$"
_SSH = r"^ssh://git@([^/]+)/(.+)$"
_WEB = r"^https?://([^/]+)/(.+)$"


def canonical_repository(url: Column) -> Column:
    """``host/path`` of an scp, ssh or http(s) address without ``.git``; other text as it is."""

    def parts(pattern: str) -> Column:
        return F.when(
            url.rlike(pattern),
            F.concat(F.regexp_extract(url, pattern, 1), F.lit("/"), F.regexp_extract(url, pattern, 2)),
        )

    return F.regexp_replace(F.coalesce(parts(_SCP), parts(_SSH), parts(_WEB), url), r"\.git$", "")


def is_ssh(url: Column) -> Column:
    return url.rlike(r"^(?:ssh://)?git@[^:/]+[:/]")


def https_address(url: Column) -> Column:
    """HTTPS form of an ssh address; null for anything else."""
    return F.when(url.rlike(_SCP), F.regexp_replace(url, _SCP, "https://$1/$2")).when(
        url.rlike(_SSH), F.regexp_replace(url, _SSH, "https://$1/$2")
    )


_STORAGE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)/?([^?#]*)"


def storage_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _STORAGE, 1))


def storage_bucket(url: Column) -> Column:
    return F.regexp_extract(url, _STORAGE, 2)


def storage_key(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _STORAGE, 3), "^/+", "")


def is_directory(url: Column) -> Column:
    """Whether a URL names a folder: it ends with a slash or has no last path part."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return url.endswith("/") | (F.regexp_extract(path, "([^/]*)$", 1) == "")


def storage_folder(url: Column) -> Column:
    """The key without its last part; the whole key of a folder URL."""
    key = storage_key(url)
    return F.when(is_directory(url), F.regexp_replace(key, "/+$", "")).otherwise(F.regexp_replace(key, "/?[^/]*$", ""))


def upload_url(destination: str, relative: Column, is_dir: bool) -> Column:
    """Where a file lands: under the destination folder, or the destination itself."""
    if not is_dir:
        return F.lit(destination)
    return F.concat(F.lit(destination.rstrip("/") + "/"), relative)
