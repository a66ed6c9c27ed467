"""Registered queries; load() imports the modules that register them."""

import importlib

MODULES = ("graph_queries", "session_queries", "shape_queries", "object_queries", "svg_queries", "stream_queries", "audit_queries", "report_queries", "table_queries")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"planwalk.plans.{name}")
