"""skein: a PySpark engine for SQL-corpus lineage and corpus data processing.

The public names below are loaded when they are first asked for.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_PUBLIC = {
    "Analyzer": "api", "Cursor": "api", "repository": "api",
    "scan": "sources.files", "read_sources": "sources.files", "memory_sources": "sources.files",
    "canonical_sources": "plans.parse", "parse_sources": "plans.parse", "tokens": "plans.parse", "lint_counts": "plans.parse", "file_kind": "plans.parse",
    "Graph": "plans.graph", "build_graph": "plans.graph", "union_graphs": "plans.graph", "cross_references": "plans.graph", "degrees": "plans.graph",
    "impact": "operators.closure", "impact_paths": "operators.closure", "impact_tree": "operators.closure", "cycles": "operators.closure", "strong_components": "operators.closure",
    "detect": "operators.dead",
    "Engine": "plans.rules", "Context": "plans.rules", "CircularRule": "plans.rules", "DeadObjectRule": "plans.rules",
    "graph_lines": "plans.report",
}

__all__ = ["__version__", *_PUBLIC]


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_PUBLIC[name]}"), name)
