"""All registered queries and their DuckDB oracles, in one place."""

from __future__ import annotations

from tidewater.plans import q_alerts, q_cdc, q_ddl, q_docs, q_engines, q_history, q_keys, q_load, q_mapping, q_monitor, q_schema, q_sinks, q_streams  # noqa: F401  (registers queries)
from tidewater.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
