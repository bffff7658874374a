"""Registered queries by topic."""

import importlib

TOPICS = [
    "session_graphs",
    "lineages",
    "lookups",
    "listings",
    "searches",
    "recording",
    "secrets_and_rollups",
    "upkeep",
    "run_facts",
    "registration",
    "sinks_and_streams",
    "files_and_reports",
]


def catalog():
    """All registered queries by name."""
    for topic in TOPICS:
        importlib.import_module(f"strandline.plans.{topic}")
    from strandline.plans.registry import CATALOG

    return CATALOG
