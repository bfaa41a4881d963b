"""Registered queries of the transcript operators, one module per group."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "score_queries", "chunk_queries", "match_queries", "state_queries", "source_queries", "flow_queries")


def _load():
    for name in MODULES:
        importlib.import_module(f"plenum.plans.{name}")
    from plenum.plans import registry

    return registry


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().ORACLES)
