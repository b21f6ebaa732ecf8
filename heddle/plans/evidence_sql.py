"""DuckDB SQL for the evidence operators, over the views of heddle.sources.views."""

from __future__ import annotations

from heddle.plans.document_sql import tokens

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HITS = f"""
    iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM benchmark), dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM documents),
    ig AS (SELECT item_id, len(w) AS item_words, (i - 1)::INT AS item_at, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS i FROM iw WHERE len(w) >= 5)),
    dg AS (SELECT doc_id, (i - 1)::INT AS doc_at, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) AS i FROM dw WHERE len(w) >= 5)),
    hits AS (SELECT * FROM dg JOIN ig USING (gram))"""

SQL: dict[str, str] = {
    "e04_excerpt_coverage": f"""WITH {HITS}, p AS (SELECT DISTINCT item_id, doc_id, item_words, unnest(generate_series(item_at, item_at + 4)) AS word FROM hits)
        SELECT item_id, doc_id, count(*) AS covered_words, count(*)::DOUBLE / any_value(item_words) AS coverage FROM p GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY item_id, doc_id"),
    "e02_first_spans": f"WITH {HITS} SELECT item_id, doc_id, doc_at AS word_at, gram FROM hits QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY doc_at, item_at, gram) = 1",
    "e22_budgeted_selection": f"""
        WITH b AS (SELECT doc_id, idx, {tokens()} AS tokens, length(text) % 97 + CASE WHEN is_heading THEN 100 ELSE 0 END AS score FROM blocks), r AS (
            SELECT *, coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY score DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(tokens) OVER (PARTITION BY doc_id) AS total FROM b)
        SELECT doc_id, count(*) AS blocks, sum(tokens)::BIGINT AS tokens, sum(idx)::BIGINT AS idx_sum FROM r WHERE before < ceil(total * 0.4::DOUBLE) GROUP BY 1""",
    "e34_claims_fully_supported": """
        WITH c AS (SELECT l_orderkey, count(*) AS evidence, count(*) FILTER (p_size <= 40) AS held FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT l_orderkey % 20 AS bucket, count(*) AS claims, count(*) FILTER (evidence = held) AS kept, count(*) FILTER (held = 0) AS unsupported FROM c GROUP BY 1""",
    "e35_scoped_blocks": """
        SELECT 'good' AS scope, source, count(*) AS blocks, sum(length(text))::BIGINT AS characters FROM blocks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 2
        UNION ALL SELECT 'unlabelled', source, count(*), sum(length(text))::BIGINT FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2""",
    "e32_support_status": "SELECT project_id, CASE WHEN stage = 'N' THEN 'moderate' WHEN latency_ms % 100 / 100::DOUBLE >= 0.75 THEN 'strong' WHEN latency_ms % 100 / 100::DOUBLE >= 0.4 THEN 'moderate' ELSE 'uncertain' END AS support, count(*) AS claims FROM model_calls GROUP BY ALL",
    "e37_disagreements": """
        WITH s AS (SELECT l_partkey, l_suppkey, bool_or(l_returnflag = 'R') AS dispute FROM lineitem GROUP BY ALL)
        SELECT l_partkey AS claim, count(*) FILTER (NOT dispute) AS supports, count(*) FILTER (dispute) AS disputes FROM s GROUP BY 1 HAVING bool_or(dispute) AND bool_or(NOT dispute)""",
    "e40_priorities": """
        WITH c AS (SELECT run_id, call_id, latency_ms, least(100, greatest(0, input_tokens % 90 + CASE WHEN stage = 'A' THEN 15 ELSE 0 END)) AS score FROM model_calls WHERE status = 'succeeded'),
             r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, call_id, latency_ms) AS place FROM c)
        SELECT run_id, CASE WHEN place <= 3 THEN 'must' WHEN place <= 8 THEN 'supporting' WHEN place <= 16 THEN 'optional' ELSE 'deferred' END AS tier, count(*) AS claims, sum(score)::BIGINT AS score, min(score) AS least FROM r GROUP BY ALL""",
    "e60_latest_judgements": "SELECT user_id, name, event_id, project_id, value FROM core QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY ts DESC, event_id DESC) = 1",
    "e27_conservation": """
        WITH b AS (SELECT l_orderkey, l_suppkey, count(*) FILTER (l_returnflag <> 'N') AS used, count(*) FILTER (l_returnflag = 'N') AS unresolved, count(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') AS types, count(DISTINCT (l_returnflag, l_quantity)) FILTER (l_returnflag <> 'N') AS texts FROM lineitem GROUP BY ALL)
        SELECT CASE WHEN used > 0 AND unresolved > 0 THEN 'both' WHEN types > 1 THEN 'several_types' WHEN used > texts THEN 'repeated' WHEN used > 0 THEN 'used' ELSE 'unresolved' END AS state, count(*) AS ids FROM b GROUP BY 1
        UNION ALL SELECT 'no_evidence', n FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) WHERE n > 0""",
    "e20_block_scores": f"""
        WITH b AS (SELECT doc_id, idx, source, is_heading, list_distinct(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM blocks), c AS (SELECT source, word, count(*) AS n FROM (SELECT source, unnest(w) AS word FROM b) WHERE length(word) > 4 GROUP BY ALL),
             t AS (SELECT source, list(word) AS terms FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, word) <= 20) GROUP BY 1), p AS (
             SELECT doc_id, least(30, len(list_intersect(w, terms)) * 5) + CASE WHEN is_heading THEN 35 ELSE 0 END AS points FROM b JOIN t USING (source))
        SELECT doc_id, sum(points)::BIGINT AS points, max(points)::BIGINT AS best FROM p GROUP BY 1""",
}
