"""DuckDB SQL for the ledger and pricing operators, over the views of heddle.sources.views."""

from __future__ import annotations

from heddle.operators.ledger import REDACTIONS

NODES = """nodes AS (
    SELECT 'span' AS kind, span_id AS node_id, parent_id, trace_id, duration_ms FROM spans
    UNION ALL SELECT 'call', 'c' || call_id, 'l' || call_id, trace_id, latency_ms FROM model_calls)"""
PRICED = """p AS (
    SELECT c.*, CASE WHEN q.model IS NOT NULL THEN per_call + coalesce(round_even(c.input_tokens * input_per_million / 1e6, 0), 0)::BIGINT + coalesce(round_even(c.output_tokens * output_per_million / 1e6, 0), 0)::BIGINT END AS price_micros
    FROM model_calls c ASOF LEFT JOIN prices q ON q.model = c.model AND c.started_at >= q.effective_from)"""


def _redacted() -> str:
    out = "coalesce(text, '')"
    for pattern, mask in REDACTIONS:
        options = "gi" if pattern.startswith("(?i)") else "g"
        out = f"regexp_replace({out}, '{pattern.removeprefix('(?i)')}', '{mask.replace('$1', chr(92) + '1')}', '{options}')"
    return out


SQL: dict[str, str] = {
    "o01_project_summary": """
        SELECT project_id, count(*) AS calls, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'rejected') AS rejected,
               sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(latency_ms)::BIGINT AS latency_ms, max(latency_ms) AS latency_max_ms, count(cost_micros) AS priced_count,
               count(*) FILTER (cost_micros IS NULL) AS unpriced_count, sum(cost_micros)::BIGINT AS cost_micros, (sum(cost_micros) FILTER (status <> 'succeeded'))::BIGINT AS wasted_micros
        FROM model_calls WHERE NOT is_synthetic GROUP BY 1""",
    "o02_stage_self_time": """
        SELECT project_id, name, count(*) AS spans, sum(duration_ms)::BIGINT AS total_ms, sum(greatest(0, duration_ms - coalesce(inside, 0)))::BIGINT AS self_ms
        FROM spans s LEFT JOIN (SELECT parent_id AS pid, sum(duration_ms) AS inside FROM spans GROUP BY 1) c ON c.pid = s.span_id GROUP BY ALL""",
    "o03_cost_breakdown": """
        SELECT project_id, stage, provider, model, count(*) AS calls, (sum(cost_micros) FILTER (status = 'succeeded'))::BIGINT AS delivered_micros, (sum(cost_micros) FILTER (status <> 'succeeded'))::BIGINT AS wasted_micros, count(*) FILTER (cost_micros IS NULL) AS unpriced_count
        FROM model_calls WHERE NOT is_synthetic GROUP BY ALL""",
    "o05_latency_percentiles": """
        SELECT project_id, stage, l[round_even((len(l) - 1) * 0.5, 0)::INT + 1] AS p50_ms, l[round_even((len(l) - 1) * 0.95, 0)::INT + 1] AS p95_ms
        FROM (SELECT project_id, stage, list_sort(list(latency_ms)) AS l FROM model_calls WHERE NOT is_synthetic GROUP BY ALL)""",
    "o06_cache_hit_rates": """
        SELECT project_id, 'cache' || (k % 3) AS cache, count(*) FILTER (k % 2 = 0) AS hits, count(*) FILTER (k % 2 = 1) AS misses, coalesce((count(*) FILTER (k % 2 = 0))::DOUBLE / nullif(count(*), 0), 0) AS hit_rate
        FROM core_events WHERE NOT is_synthetic GROUP BY ALL""",
    "o08_trace_nodes": f"WITH {NODES} SELECT trace_id, count(*) FILTER (kind = 'span') AS spans, count(*) FILTER (kind = 'call') AS calls, max(duration_ms) AS longest_ms FROM nodes GROUP BY 1",
    "o10_trace_tree": f"""WITH RECURSIVE {NODES}, tree AS (
            SELECT node_id, trace_id, 0 AS depth FROM nodes WHERE parent_id IS NULL OR parent_id NOT IN (SELECT node_id FROM nodes)
            UNION ALL SELECT n.node_id, n.trace_id, depth + 1 FROM nodes n JOIN tree t ON n.parent_id = t.node_id WHERE depth < 3)
        SELECT trace_id, count(*) AS nodes, max(depth) AS deepest, count(*) FILTER (depth = 1) AS first_level FROM tree GROUP BY 1""",
    "o11_waterfall": """
        WITH w AS (SELECT span_id, epoch_ms(started_at) AS a, duration_ms AS d, min(epoch_ms(started_at)) OVER t AS f, max(epoch_ms(started_at) + duration_ms) OVER t AS e FROM spans WHERE status <> 'running' WINDOW t AS (PARTITION BY trace_id))
        SELECT span_id, coalesce(100.0::DOUBLE * (a - f) / nullif(e - f, 0), 0)::DOUBLE AS offset_pct, greatest(0.8::DOUBLE, coalesce(100.0::DOUBLE * d / nullif(e - f, 0), 0))::DOUBLE AS width_pct FROM w""",
    "o12_first_spans": "SELECT trace_id, span_id, name, status FROM spans QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY parent_id IS NOT NULL, started_at, span_id) = 1",
    "o13_open_spans": "SELECT project_id, span_id, name FROM spans WHERE status = 'running' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, span_id DESC) = 1",
    "o14_live_status": """
        SELECT project_id, arg_max(span_id, (started_at, span_id)) FILTER (parent_id IS NULL) AS latest_root, arg_max(span_id, (started_at, span_id)) FILTER (status = 'failed') AS latest_error,
               arg_max(span_id, (started_at, span_id)) FILTER (status = 'running') AS current FROM spans GROUP BY 1""",
    "o15_run_statistics": """
        SELECT run_id, stage, count(*) AS calls, sum(input_tokens + output_tokens)::BIGINT AS tokens, sum(latency_ms)::BIGINT AS stage_ms, sum(cost_micros)::BIGINT AS cost_micros, count(*) FILTER (cost_micros IS NULL) AS unpriced_count,
               count(*) FILTER (status = 'rejected') AS retries FROM model_calls GROUP BY ALL""",
    "o16_distribution": """
        SELECT stage, avg(latency_ms) AS mean, median(latency_ms)::DOUBLE AS median, quantile_disc(latency_ms, 0.95)::DOUBLE AS p95, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
               count(*) FILTER (status = 'rejected') AS rejected FROM model_calls GROUP BY 1""",
    "o17_compare_runs": """
        WITH a AS (SELECT stage, model, sum(latency_ms) AS n FROM model_calls WHERE run_id = 'r1' GROUP BY ALL), b AS (SELECT stage, model, sum(latency_ms) AS n FROM model_calls WHERE run_id = 'r2' GROUP BY ALL),
             j AS (SELECT stage, model, coalesce(a.n, 0)::BIGINT AS before, coalesce(b.n, 0)::BIGINT AS after FROM a FULL JOIN b USING (stage, model))
        SELECT stage, model, before, after, after - before AS absolute, 100.0::DOUBLE * (after - before) / nullif(before, 0) AS percent FROM j""",
    "o22_run_rollup": """
        SELECT run_id, count(*) AS calls, bool_or(status = 'failed') AS failed, sum(input_tokens)::BIGINT AS input_tokens, sum(cost_micros)::BIGINT AS cost_micros, count(cost_micros) AS priced_count, count(*) FILTER (cost_micros IS NULL) AS unpriced_count,
               string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(DISTINCT trace_id) AS traces FROM model_calls GROUP BY 1""",
    "o24_recent_traces": "SELECT project_id, trace_id, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, trace_id)::INT AS place FROM spans WHERE parent_id IS NULL QUALIFY place <= 5",
    "o25_list_calls": "SELECT call_id, project_id, model, latency_ms FROM model_calls WHERE NOT is_synthetic AND stage = 'R' AND status = 'failed' ORDER BY started_at DESC, call_id LIMIT 50",
    "o27_linkage_issues": """
        SELECT * FROM (SELECT 'span' AS subject, 'parent_id' AS field, count(*) FILTER (parent_id IS NULL) AS missing FROM spans UNION ALL SELECT 'span', 'trace_id', count(*) FILTER (trace_id IS NULL) FROM spans
            UNION ALL SELECT 'span', 'project_id', count(*) FILTER (project_id IS NULL) FROM spans UNION ALL SELECT 'call', 'run_id', count(*) FILTER (run_id IS NULL) FROM model_calls
            UNION ALL SELECT 'call', 'model', count(*) FILTER (model IS NULL) FROM model_calls UNION ALL SELECT 'call', 'cost_micros', count(*) FILTER (cost_micros IS NULL) FROM model_calls) WHERE missing > 0""",
    "o28_reaped_spans": """
        WITH s AS (SELECT *, CASE WHEN status = 'running' AND epoch_us(TIMESTAMP '1999-01-01') - epoch_us(started_at) > 1440 * 60000000::BIGINT THEN 'interrupted' ELSE status END AS now FROM spans)
        SELECT project_id, count(*) FILTER (now = 'interrupted') AS interrupted, count(*) FILTER (now = 'running') AS running, count(*) FILTER (now = 'interrupted' AND parent_id IS NULL) AS failed_traces FROM s GROUP BY 1""",
    "c02_priced_calls": f"WITH {PRICED} SELECT project_id, stage, sum(price_micros)::BIGINT AS price_micros, count(*) FILTER (price_micros IS NULL) AS unpriced_count, max(price_micros) AS dearest FROM p GROUP BY ALL",
    "c14_totals_if_priced": f"WITH {PRICED} SELECT run_id, CASE WHEN count(price_micros) = count(*) THEN sum(price_micros)::BIGINT END AS total_micros, count(*) AS calls FROM p GROUP BY 1",
    "o29_reprice": f"WITH {PRICED} SELECT project_id, count(*) FILTER (cost_micros IS DISTINCT FROM price_micros) AS changed, sum(cost_micros)::BIGINT AS before, sum(price_micros)::BIGINT AS after FROM p WHERE status <> 'rejected' GROUP BY 1",
    "o30_priced_verdict": """
        WITH b AS (SELECT project_id, avg((status = 'failed')::INT) FILTER (stage = 'A') - avg((status = 'failed')::INT) FILTER (stage = 'R') AS fall, sum(cost_micros) FILTER (stage = 'R')::DOUBLE / nullif(sum(cost_micros) FILTER (stage = 'A'), 0) AS ratio,
                          count(*) FILTER (stage IN ('A', 'R') AND cost_micros IS NULL) AS unpriced FROM model_calls GROUP BY 1)
        SELECT project_id, CASE WHEN unpriced > 0 OR fall IS NULL OR ratio IS NULL THEN 'undecidable' WHEN fall > 0.15 AND ratio <= 1.2 THEN 'switch' ELSE 'keep' END AS verdict, unpriced FROM b""",
    "c08_calibration": "SELECT project_id, stage, median(input_tokens / (latency_ms / 60000.0::DOUBLE)) AS tokens_per_minute, count(*) AS samples, count(*) >= 3 AS ready FROM model_calls WHERE status = 'succeeded' AND latency_ms > 0 GROUP BY ALL",
    "o32_redact": f"WITH r AS (SELECT doc_id, coalesce(text, '') AS t, {_redacted()} AS x FROM documents) SELECT doc_id, (length(t) - length(x))::BIGINT AS shorter_by, md5(x) AS text_md5 FROM r",
}
