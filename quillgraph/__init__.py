"""Spark-native bibliographic graph analytics."""

import importlib

_HOME = {
    "Pipeline": "plans.pipeline", "Config": "plans.pipeline", "Result": "plans.pipeline", "Truncated": "plans.pipeline", "estimate": "plans.pipeline",
    "Graph": "operators.graph", "DedupConfig": "operators.dedup", "EnrichConfig": "operators.enrich", "normalize_authors": "operators.authors", "parse_author": "functions.names",
    "has_any_author": "operators.terms", "term_counts": "operators.terms", "PAPERS": "sources.schema", "REFERENCES": "sources.schema", "EDGES": "sources.schema",
}
__all__ = list(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(importlib.import_module(f".{_HOME[name]}", __name__), name)
