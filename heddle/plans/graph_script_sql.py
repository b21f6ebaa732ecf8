"""DuckDB SQL for the graph and script operators, over the views of heddle.sources.views."""

from __future__ import annotations

from heddle.plans.evidence_sql import WORDS

BEST = "best AS (SELECT source, target, type, m.w AS weight, m.c AS confidence, drafts FROM (SELECT source, target, type, max({'w': weight, 'c': confidence}) AS m, count(*) AS drafts FROM edges GROUP BY ALL))"
W = f"regexp_extract_all(lower(text), '{WORDS}')"
CALL_ORDER = "PARTITION BY run_id ORDER BY started_at, call_id, latency_ms"


def share(n: str, d: str) -> str:
    return f"({n})::DOUBLE / nullif(({d})::DOUBLE, 0)"


SQL: dict[str, str] = {
    "g02_prerequisite_closure": """
        WITH RECURSIVE s AS (SELECT DISTINCT target AS f, source AS t FROM edges WHERE type = 'prerequisite'), r AS (SELECT cell, 0 AS hop FROM cells WHERE tier = 1 UNION SELECT s.t, hop + 1 FROM r JOIN s ON s.f = r.cell WHERE hop < 25)
        SELECT cell, min(hop) AS hop FROM r GROUP BY 1""",
    "g01_selected_cells": """
        WITH RECURSIVE s AS (SELECT DISTINCT target AS f, source AS t FROM edges WHERE type = 'prerequisite' AND source IN (SELECT cell FROM cells)),
        r AS (SELECT cell, 0 AS hop FROM cells WHERE tier <= 2 UNION SELECT s.t, hop + 1 FROM r JOIN s ON s.f = r.cell WHERE hop < 25), m AS (SELECT cell, min(hop) AS hop FROM r GROUP BY 1),
        o AS (SELECT cell, hop, cell AS origin FROM m WHERE hop = 0 UNION ALL SELECT m.cell, m.hop, min(o.origin) FROM o JOIN s ON s.f = o.cell JOIN m ON m.cell = s.t AND m.hop = o.hop + 1 GROUP BY m.cell, m.hop)
        SELECT cell, hop, origin FROM o""",
    "g09_strongest_edges": f"WITH {BEST} SELECT * FROM best",
    "g03_promoted_tiers": f"""WITH {BEST}, o AS (SELECT source AS cell, count(*) AS n FROM best WHERE type = 'prerequisite' GROUP BY 1)
        SELECT cell, tier, coalesce(n, 0) AS prerequisite_out, greatest(1, tier - CASE WHEN coalesce(n, 0) >= 6 THEN 2 WHEN coalesce(n, 0) >= 3 THEN 1 ELSE 0 END) AS promoted FROM cells LEFT JOIN o USING (cell)""",
    "g05_statistics": "SELECT chapter, tier, count(*) AS cells, count(*) FILTER (cell NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)) AS orphans, sum(minutes)::BIGINT AS minutes FROM cells GROUP BY ALL",
    "g35_cross_chapter": "SELECT type, count(*) AS edges, count(*) FILTER (a.chapter <> b.chapter) AS crossing FROM edges JOIN cells a ON a.cell = source JOIN cells b ON b.cell = target GROUP BY type",
    "g06_integrity": """
        SELECT 'source' AS problem, type, count(*) AS edges FROM edges WHERE source NOT IN (SELECT cell FROM cells WHERE tier <= 2) GROUP BY type UNION ALL
        SELECT 'target', type, count(*) FROM edges WHERE target NOT IN (SELECT cell FROM cells WHERE tier <= 2) GROUP BY type""",
    "g10_capped_edges": f"""WITH {BEST}, k AS (SELECT chapter, least(2 * count(*), 60) AS cap FROM cells GROUP BY 1), r AS (
            SELECT a.chapter, confidence, cap, row_number() OVER (PARTITION BY a.chapter ORDER BY weight DESC, confidence DESC, source, target, type) AS place FROM best JOIN cells a ON a.cell = source JOIN cells b ON b.cell = target AND a.chapter = b.chapter JOIN k ON k.chapter = a.chapter)
        SELECT chapter, count(*) AS edges, sum(confidence)::BIGINT AS confidence, max(cap) AS cap FROM r WHERE place <= cap GROUP BY 1""",
    "g11_two_cycles": f"""WITH {BEST}, e AS (SELECT * FROM best WHERE type IN ('prerequisite', 'depends_on', 'extends')), c AS (SELECT *, least(source, target) AS low, greatest(source, target) AS high FROM e WHERE EXISTS (SELECT 1 FROM e x WHERE x.source = e.target AND x.target = e.source))
        SELECT low, high, count(*) AS edges, arg_min(source, (weight, confidence, source, target, type)) AS drop_source, arg_min(type, (weight, confidence, source, target, type)) AS drop_type FROM c GROUP BY low, high""",
    "g19_cell_keys": "WITH f AS (SELECT l_partkey AS cell, min(l_orderkey) AS first FROM lineitem GROUP BY 1) SELECT cell, printf('%s-%03d', chapter, row_number() OVER (PARTITION BY chapter ORDER BY first, cell)) AS cell_key FROM cells JOIN f USING (cell)",
    "g22_chapter_pairs": """
        WITH n AS (SELECT chapter, count(*) AS cells, row_number() OVER (ORDER BY min(cell)) AS no FROM cells GROUP BY 1)
        SELECT a.chapter, b.chapter AS other, (b.no - a.no)::INT AS distance, a.cells + b.cells AS cells FROM n a JOIN n b ON b.no - a.no BETWEEN 1 AND 2""",
    "g23_tier_distribution": """
        WITH s AS (SELECT chapter, count(*) AS n, avg((tier = 1)::INT) AS first_share, avg((tier = 3)::INT) AS third_share FROM cells GROUP BY 1)
        SELECT *, CASE WHEN first_share < 0.15 OR first_share > 0.45 THEN 'first' WHEN n >= 6 AND third_share < 0.10 THEN 'third' ELSE 'none' END AS failure FROM s""",
    "g25_overlay": """
        WITH base AS (SELECT *, CASE WHEN cell % 7 = 0 THEN 1 ELSE tier END AS t FROM cells WHERE cell % 50 <> 0), d AS (SELECT source AS cell, count(*) AS n FROM edges WHERE source IN (SELECT cell FROM base) AND target IN (SELECT cell FROM base) GROUP BY 1)
        SELECT chapter, t AS tier, count(*) AS cells, sum(coalesce(n, 0))::BIGINT AS edges FROM base LEFT JOIN d USING (cell) GROUP BY ALL""",
    "g26_minutes": """
        WITH c AS (SELECT chapter, CASE WHEN minutes % 3 <> 0 THEN minutes::DOUBLE END AS known FROM cells), m AS (SELECT chapter, median(known) AS middle FROM c GROUP BY 1)
        SELECT chapter, sum(coalesce(known, middle)) AS minutes, count(*) FILTER (known IS NULL) AS filled FROM c JOIN m USING (chapter) GROUP BY 1""",
    "t02_speaker_runs": """
        WITH n AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS new FROM turns WHERE length(text) >= 400 WINDOW w AS (PARTITION BY segment_id ORDER BY position)), r AS (SELECT *, sum(new) OVER (PARTITION BY segment_id ORDER BY position) AS run FROM n)
        SELECT segment_id, speaker, count(*) AS turns, min(position) AS first_position FROM r GROUP BY segment_id, run, speaker HAVING count(*) > 1""",
    "t03_near_repeats": f"""
        WITH t AS (SELECT doc_id, {W} AS w, min(idx) AS position, count(*) AS times FROM (SELECT * FROM blocks) GROUP BY doc_id, text), g AS (SELECT DISTINCT doc_id, position, times, array_to_string(w[i : i + 2], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 3)),
             s AS (SELECT doc_id, position, any_value(times) AS times, count(*) AS n FROM g GROUP BY doc_id, position), p AS (SELECT a.doc_id, a.position, b.position AS later, count(*) AS c FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.gram = b.gram AND a.position < b.position GROUP BY ALL)
        SELECT p.doc_id, p.position, later, c::DOUBLE / (x.n + y.n - c) AS similarity FROM p JOIN s x ON x.doc_id = p.doc_id AND x.position = p.position JOIN s y ON y.doc_id = p.doc_id AND y.position = later WHERE c::DOUBLE / (x.n + y.n - c) >= 0.6
        UNION ALL SELECT doc_id, position, position, 1.0 FROM s WHERE times > 1""",
    "t05_opening_repeats": f"SELECT array_to_string(w[1:4], ' ') AS opening, count(*) AS turns, count(DISTINCT segment_id) AS segments FROM (SELECT segment_id, {W} AS w FROM turns) WHERE len(w) >= 4 GROUP BY 1 HAVING count(*) > 1",
    "t13_durations": f"WITH s AS (SELECT segment_id, sum(len({W}))::BIGINT AS words FROM turns GROUP BY 1) SELECT segment_id, words, words / 130::DOUBLE AS minutes, words / 130::DOUBLE BETWEEN 0.8 * 2::DOUBLE AND 1.2 * 2::DOUBLE AS in_range FROM s",
    "t14_balance": f"""SELECT segment_id, count(*) AS turns, count(*) FILTER (speaker = 'editorial') AS editorial, {share("count(*) FILTER (speaker = 'editorial')", "count(*)")} AS editorial_share,
        {share("abs(count(*) FILTER (speaker = 'A') - count(*) FILTER (speaker = 'B'))", "count(*) FILTER (speaker <> 'editorial')")} AS skew, {share("count(*) FILTER (length(text) >= 200)", "count(*)")} AS substantive_share FROM turns GROUP BY 1""",
    "t06_specifics": """
        WITH t AS (SELECT segment_id, list_distinct(list_concat(regexp_extract_all(text, '([0-9]{2,})', 1), regexp_extract_all(text, '([A-ZÉÈ][a-zà-ÿ]{7,})', 1))) AS f, coalesce(lag(text) OVER (PARTITION BY segment_id ORDER BY position), '') AS before FROM turns)
        SELECT segment_id, sum(len(f))::BIGINT AS specifics, sum(len(list_filter(f, lambda x: NOT contains(before, x))))::BIGINT AS unsupported FROM t GROUP BY 1""",
    "t20_rolling_rules": f"""
        WITH c AS (SELECT run_id, sum((status = 'failed')::INT) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS two, sum((status = 'failed')::INT) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS five, sum((status = 'failed')::INT) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ten
                   FROM model_calls WINDOW w AS ({CALL_ORDER}))
        SELECT run_id, count(*) FILTER (two >= 2) AS two_in_a_row, count(*) FILTER (five >= 3) AS three_of_five, count(*) FILTER (ten >= 5) AS five_of_ten FROM c GROUP BY 1""",
    "t27_arms": f"""SELECT segment_id, count(*) FILTER (speaker = 'A') AS a_turns, coalesce(sum(len({W})) FILTER (speaker = 'A'), 0)::BIGINT AS a_words, count(*) FILTER (speaker = 'B') AS b_turns, coalesce(sum(len({W})) FILTER (speaker = 'B'), 0)::BIGINT AS b_words FROM turns GROUP BY 1""",
    "t31_segments": r"""
        WITH RECURSIVE s AS (SELECT segment_id, position, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM turns), n AS (
            SELECT segment_id, position, unnest(l) AS x, unnest(generate_series(1, len(l))) AS i FROM s WHERE len(l) > 0), w AS (
            SELECT segment_id, position, i, 0 AS bin, length(x) AS held FROM n WHERE i = 1
            UNION ALL SELECT n.segment_id, n.position, n.i, w.bin + y.anew::INT, CASE WHEN y.anew THEN 0 ELSE w.held END + length(n.x)
            FROM w JOIN n ON n.segment_id = w.segment_id AND n.position = w.position AND n.i = w.i + 1, LATERAL (SELECT w.held > 0 AND (w.held + length(n.x) > 300 OR w.held >= 300) AS anew) y)
        SELECT segment_id, sum(c)::BIGINT AS sentences, sum(b)::BIGINT AS chunks FROM (SELECT segment_id, position, count(*) AS c, max(bin) + 1 AS b FROM w GROUP BY ALL) GROUP BY 1""",
    "t35_repeated_phrases": f"""
        SELECT segment_id, position, array_to_string(w[i : i + 5], ' ') AS phrase, count(*) AS times FROM (SELECT *, unnest(generate_series(1, len(w) - 5)) AS i FROM (SELECT segment_id, position, {W} AS w FROM turns) WHERE len(w) >= 12) GROUP BY ALL HAVING count(*) >= 2""",
    "t40_identical_retries": f"WITH c AS (SELECT run_id, stage || '|' || model || '|' || status AS mark, lag(stage || '|' || model || '|' || status) OVER ({CALL_ORDER}) AS before FROM model_calls) SELECT run_id, count(*) AS repeats, count(DISTINCT mark) AS marks FROM c WHERE mark = before GROUP BY 1",
    "t41_backoff": f"""
        WITH c AS (SELECT run_id, status, row_number() OVER ({CALL_ORDER}) AS a FROM model_calls WHERE status <> 'succeeded'), s AS (SELECT *, CASE WHEN status = 'rejected' THEN 'not_retryable' WHEN a >= 3 THEN 'attempts_used' ELSE 'retry' END AS stop FROM c)
        SELECT run_id, sum(2.0::DOUBLE * pow(2, a - 1)) FILTER (stop = 'retry') AS delay, count(*) FILTER (stop = 'retry') AS retried, count(*) FILTER (stop = 'not_retryable') AS refused FROM s GROUP BY 1""",
    "t43_transitions": """
        WITH m AS (SELECT project_id, stage, lag(stage) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS from_stage FROM core WHERE name = 'project.stage_entered')
        SELECT from_stage, stage, count(*) AS moves, count(DISTINCT project_id) AS projects FROM m WHERE stage <> from_stage AND stage <> from_stage + 1 GROUP BY ALL""",
    "t51_start_times": "SELECT segment_id, position, coalesce(sum(length(text)) OVER w, 0) / 14.0::DOUBLE + 0.5 * count(*) OVER w AS starts_at FROM turns WINDOW w AS (PARTITION BY segment_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
}
