"""End-to-end jobs, the query registry and its SQL oracles."""

import importlib

QUERY_MODULES = [
    "spatial_queries", "text_queries", "geocode_queries", "search_queries",
    "event_queries", "compare_queries", "stream_queries", "io_queries",
]


def load_queries():
    """Import every query module and return the registry."""
    for name in QUERY_MODULES:
        importlib.import_module(f"geoweave.plans.{name}")
    return importlib.import_module("geoweave.plans.registry")
