"""All queries for the analytics operators, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.operators import audits, coverage, cycles, details, documents, drafts, evidence, graphs, ledger, matching, metrics, plumbing, readings, reviews, scripts, splitting, structure, textindex
from heddle.plans import document_sql, evidence_sql, graph_script_sql, ledger_sql, metric_sql
from heddle.sources import ledger_tables
from heddle.sources.views import with_views
from heddle.streaming import jobs, timeouts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {key: m.compute for key, m in metrics.METRICS.items()}
QUERIES["p12_metric_rollup"] = metrics.rollup
QUERIES |= ledger.QUERIES | documents.QUERIES | evidence.QUERIES | graphs.QUERIES | scripts.QUERIES | jobs.QUERIES | plumbing.QUERIES | audits.QUERIES | drafts.QUERIES | reviews.QUERIES | structure.QUERIES | coverage.QUERIES | details.QUERIES | matching.QUERIES | cycles.QUERIES | splitting.QUERIES | textindex.QUERIES | timeouts.QUERIES | ledger_tables.QUERIES | readings.QUERIES

_SQL = metric_sql.SQL | ledger_sql.SQL | document_sql.SQL | evidence_sql.SQL | graph_script_sql.SQL | jobs.SQL | plumbing.SQL | audits.SQL | drafts.SQL | reviews.SQL | structure.SQL | coverage.SQL | details.SQL | matching.SQL | cycles.SQL | splitting.SQL | textindex.SQL | timeouts.SQL | ledger_tables.SQL | readings.SQL
ORACLE_SQL: dict[str, str] = {key: with_views(sql) for key, sql in _SQL.items()}
ORACLE_SQL["p12_metric_rollup"] = " UNION ALL ".join(
    f"SELECT '{key}' AS metric_key, day, dimension_json, value, numerator, denominator FROM ({ORACLE_SQL[key]}) WHERE day IS NOT NULL AND value IS NOT NULL" for key in metric_sql.SQL
)
ORACLE_SQL["p13_recent_days"] = f"SELECT dimension_json, day, value, row_number() OVER (PARTITION BY dimension_json ORDER BY day DESC)::INT AS place FROM ({ORACLE_SQL['m35_stage_failure_rate']}) QUALIFY place <= 3"
