"""Provenance and lineage analytics as Spark jobs."""

from strandline.session import build_session, tune

__all__ = ["build_session", "tune"]
