"""Compositions of operators and the registered queries."""

from importlib import import_module

QUERY_MODULES = ("retrieval_queries", "function_queries", "catalog_queries",
                 "streaming_queries")


def load_queries() -> tuple[dict, dict]:
    """All registered queries and their oracle texts."""
    for name in QUERY_MODULES:
        import_module(f"soundalike.plans.{name}")
    from soundalike.plans.registry import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
