"""Named queries over the tables, with the SQL that says the same."""

from __future__ import annotations

from lectern.plans import dataset_queries, evidence_queries, text_queries

FLAGSHIP = "zscore_signals"
_MODULES = (text_queries, evidence_queries, dataset_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
