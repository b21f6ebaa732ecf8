"""DuckDB SQL for the document operators, over the views of heddle.sources.views."""

from __future__ import annotations

from heddle.functions.columns import ARABIC_FROM, ARABIC_TO, MARKS_FROM, MARKS_TO
from heddle.operators.documents import DAMAGED, DISPLAY, LATEX, PIPE_ROW, SYMBOLS, TAB_ROW

WS = r"[ \t\n\x0B\f\r]+"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def tokens(x: str = "text") -> str:
    return f"(CASE WHEN length({collapse(x)}) = 0 THEN 0 ELSE greatest(1, ceil(length({collapse(x)}) / 3.5)) END)::BIGINT"


def fold(x: str) -> str:
    marks = MARKS_FROM.replace("'", "''"), MARKS_TO.replace("'", "''")
    dropped = "​‌‍⁠﻿ً-ٰٟـ"
    return collapse(f"lower(regexp_replace(translate(translate({x}, '{ARABIC_FROM}', '{ARABIC_TO}'), '{marks[0]}', '{marks[1]}'), '[{dropped}]', '', 'g'))")


def count(pattern: str, x: str = "t") -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


RUNS = "runs AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS run FROM blocks)"
FEATURES = f"""
    reps AS (SELECT doc_id, sum((n - 1) * length(norm))::DOUBLE / nullif(sum(n * length(norm)), 0) AS duplicate_ratio FROM (SELECT doc_id, lower({collapse("text")}) AS norm, count(*) AS n FROM blocks WHERE length({collapse("text")}) >= 80 GROUP BY ALL) GROUP BY 1),
    per AS (SELECT doc_id, count(*) AS blocks, sum(length(text)) AS characters, avg(regexp_matches(text, '{DAMAGED}')::INT) AS corruption_ratio, bool_or(is_heading) AS has_heading, count(*) FILTER (is_heading) AS headings, count(DISTINCT page) AS pages, max(page) AS last_page FROM blocks GROUP BY 1),
    marks AS (SELECT doc_id, source, {count(LATEX)} AS latex, {count(DISPLAY)} AS display, {count(SYMBOLS)} AS symbols, len(regexp_extract_all(regexp_replace(t, '[$][$]+', '', 'g'), '[$][^$\\n]{{1,120}}[$]')) AS inline, greatest({count(PIPE_ROW)}, {count(TAB_ROW)}) AS rows
        FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
    f AS (SELECT doc_id, source, coalesce(blocks, 0) AS blocks, coalesce(characters, 0) AS characters, coalesce(duplicate_ratio, 0) AS duplicate_ratio, coalesce(corruption_ratio, 0) AS corruption_ratio, coalesce(has_heading, false) AS has_heading,
            coalesce(headings, 0) AS headings, coalesce(pages, 0) AS pages, coalesce(last_page, 0) AS last_page,
            CASE WHEN latex >= 4 OR (latex >= 2 AND inline >= 2) OR symbols >= 10 THEN 3 WHEN latex >= 2 OR display >= 1 OR (latex >= 1 AND inline >= 1) THEN 2 WHEN latex >= 1 OR inline >= 2 OR symbols >= 4 THEN 1 ELSE 0 END AS math,
            CASE WHEN rows >= 4 THEN 3 WHEN rows >= 2 THEN 2 WHEN rows >= 1 THEN 1 ELSE 0 END AS tab
        FROM marks LEFT JOIN per USING (doc_id) LEFT JOIN reps USING (doc_id)),
    j AS (SELECT *, list_filter([CASE WHEN blocks = 0 THEN 'missing_text:blocking' END, CASE WHEN blocks > 0 AND characters < 200 THEN 'missing_text:medium' END,
            CASE WHEN blocks > 0 AND duplicate_ratio >= 0.25 THEN 'repetition:' || if(duplicate_ratio >= 0.5, 'high', 'medium') END, CASE WHEN blocks > 0 AND corruption_ratio >= 0.02 THEN 'ocr_corruption:' || if(corruption_ratio >= 0.08, 'high', 'medium') END,
            CASE WHEN blocks >= 12 AND NOT has_heading THEN 'lost_headings:medium' END, CASE WHEN blocks > 0 AND math >= 1 THEN 'formula_damage:' || if(math >= 2, 'high', 'medium') END,
            CASE WHEN blocks > 0 AND tab >= 2 AND last_page >= 2 THEN 'table_damage:' || if(tab >= 3, 'high', 'medium') END], lambda x: x IS NOT NULL) AS issues FROM f),
    v AS (SELECT *, len(issues) AS issue_count, CASE WHEN array_to_string(issues, ',') LIKE '%:blocking%' THEN 'manual_review' WHEN array_to_string(issues, ',') LIKE '%:high%' THEN 'retry' WHEN len(issues) > 0 THEN 'warning' ELSE 'pass' END AS verdict FROM j),
    scored AS (SELECT *, verdict IN ('pass', 'warning') AS safe, least(greatest(
            (CASE verdict WHEN 'pass' THEN 60 WHEN 'warning' THEN 48 WHEN 'retry' THEN 20 ELSE 5 END)::DOUBLE + 12 * (blocks > 0)::INT + 12 * coalesce(pages::DOUBLE / nullif(last_page, 0), 0) + 8 * least(coalesce(headings::DOUBLE / nullif(blocks, 0), 0) * 4, 1)
            + 8 * (verdict IN ('pass', 'warning'))::INT - 12 * duplicate_ratio - least(issue_count * 2, 10) - (CASE WHEN math >= 2 THEN 8 WHEN math >= 1 THEN 4 ELSE 0 END) - (CASE WHEN tab >= 2 THEN 6 WHEN tab >= 1 THEN 3 ELSE 0 END), 0), 100)::DOUBLE AS score FROM v)
"""

SQL: dict[str, str] = {
    "b03_html_blocks": r"""
        WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<nav.*?</nav>', ' ', 'g') AS h FROM pages), f AS (
            SELECT page_id, list_concat(list_concat(list_concat(list_concat(regexp_extract_all(h, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), regexp_extract_all(h, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1>', 1)), regexp_extract_all(h, '(?is)<h2(?:\s[^>]*)?>(.*?)</h2>', 1)),
                regexp_extract_all(h, '(?is)<h3(?:\s[^>]*)?>(.*?)</h3>', 1)), regexp_extract_all(h, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1)) AS l FROM p), c AS (
            SELECT page_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda x: x <> '') AS b FROM f)
        SELECT page_id, len(b) AS blocks, md5(coalesce(array_to_string(b, chr(10)), '')) AS text_md5 FROM c""",
    "b07_repeated_margins": f"""
        WITH b AS (SELECT *, lower({collapse("text")}) AS norm FROM blocks), m AS (SELECT doc_id, norm FROM b WHERE NOT is_heading AND length(norm) <= 160 GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT page) >= 3)
        SELECT b.doc_id, count(*) FILTER (m.norm IS NOT NULL AND NOT is_heading) AS dropped, count(*) FILTER (m.norm IS NULL OR is_heading) AS kept FROM b LEFT JOIN m ON b.doc_id = m.doc_id AND b.norm = m.norm GROUP BY 1""",
    "b15_block_identity": f"""
        WITH n AS (SELECT doc_id, idx, 'blk-' || md5(doc_id::VARCHAR)[1:8] || '-' || lpad(idx::VARCHAR, 5, '0') || '-' || sha256(text)[1:12] AS block_id, {tokens()} AS tokens FROM blocks)
        SELECT *, lag(block_id) OVER w AS previous_id, lead(block_id) OVER w AS next_id FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""",
    "b09_packed_blocks": f"""
        WITH RECURSIVE n AS (SELECT doc_id, idx, {tokens()} AS tokens, is_heading AS alone FROM blocks), w AS (
            SELECT doc_id, idx, tokens, alone, 0 AS bin, tokens AS held FROM n WHERE idx = 0
            UNION ALL SELECT n.doc_id, n.idx, n.tokens, n.alone, CASE WHEN x.anew THEN w.bin + 1 ELSE w.bin END, CASE WHEN x.anew THEN 0 ELSE w.held END + n.tokens
            FROM w JOIN n ON n.doc_id = w.doc_id AND n.idx = w.idx + 1, LATERAL (SELECT w.held > 0 AND (w.alone OR n.alone OR w.held + n.tokens > 180 OR w.held >= 120) AS anew) x)
        SELECT doc_id, bin, count(*) AS blocks, sum(tokens)::BIGINT AS tokens, min(idx) AS first_idx FROM w GROUP BY ALL""",
    "b19_equal_documents": f"""
        WITH k AS (SELECT doc_id, sha256(string_agg({fold("text")}, chr(31) ORDER BY idx)) AS content_key FROM blocks GROUP BY 1) SELECT content_key, count(*) AS documents, min(doc_id) AS first_doc FROM k GROUP BY 1""",
    "b27_heading_runs": f"WITH {RUNS} SELECT doc_id, run, count(*) AS blocks, min(idx) AS first_idx, sum({tokens()})::BIGINT AS tokens, min(text) FILTER (is_heading) AS heading FROM runs GROUP BY doc_id, run",
    "b29_heading_heuristic": f"""WITH {RUNS}, s AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL), g AS (SELECT doc_id, count(*) AS runs, median(n) AS median_size, max(n)::DOUBLE / sum(n) AS max_share FROM s GROUP BY 1)
        SELECT *, runs >= 2 AND median_size >= 8 AND max_share <= 0.6 AS passes FROM g""",
    "b53_script_kind": """
        WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ɏ]')) AS latin, len(regexp_extract_all(coalesce(text, ''), '[؀-ۿ]')) AS arabic FROM documents)
        SELECT *, CASE WHEN latin + arabic = 0 THEN 'unknown' WHEN latin >= 0.75 * (latin + arabic) THEN 'latin' WHEN arabic >= 0.75 * (latin + arabic) THEN 'arabic' ELSE 'mixed' END AS script FROM c""",
    "q01_parse_quality": f"WITH {FEATURES} SELECT doc_id, blocks, duplicate_ratio, corruption_ratio, array_to_string(issues, ',') AS issues, verdict, safe FROM scored",
    "q11_document_scores": f"WITH {FEATURES} SELECT doc_id, score FROM scored",
    "q14_source_scores": f"WITH {FEATURES} SELECT source, count(*) AS documents, count(*) FILTER (safe) AS safe_documents, avg(score) AS mean_score, arg_max(doc_id, (safe, round(score, 6), -doc_id)) AS best_doc FROM scored GROUP BY 1",
    "q20_first_results": r"""
        WITH p AS (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS host, url, min(page_id) AS page_id FROM pages WHERE url IS NOT NULL GROUP BY ALL)
        SELECT host, url, page_id, row_number() OVER (PARTITION BY host ORDER BY page_id)::INT AS place FROM p QUALIFY place <= 12""",
    "q22_gates": f"""WITH {FEATURES}, r AS (SELECT avg(quality) AS quality, avg((verdict = 'retry')::INT) AS retried, avg((blocks = 0)::INT) AS empty FROM labels JOIN scored USING (doc_id)), u AS (
            SELECT 'quality' AS gate, quality AS value, 0.8::DOUBLE AS threshold FROM r UNION ALL SELECT 'retried', retried, 0.05 FROM r UNION ALL SELECT 'empty', empty, 0 FROM r)
        SELECT *, CASE WHEN value IS NULL THEN 'skipped' WHEN CASE WHEN gate = 'quality' THEN value >= threshold ELSE value <= threshold END THEN 'passed' ELSE 'failed' END AS status FROM u""",
    # edit distances count bytes: characters, and words, are first numbered, which 127 different ones of a pair allow
    "q29_text_metrics": f"""
        WITH i AS (SELECT item_id, {collapse("coalesce(text, '')")} AS t FROM benchmark), p AS (SELECT a.item_id, a.t, b.t AS u, list_distinct(string_split(a.t || ' ' || b.t, '')) AS cs, list_filter(string_split(a.t, ' '), lambda w: w <> '') AS v, list_filter(string_split(b.t, ' '), lambda w: w <> '') AS x FROM i a JOIN i b ON b.item_id = a.item_id + 1),
            q AS (SELECT *, list_distinct(v || x) AS ws FROM p), d AS (SELECT *, levenshtein(array_to_string(list_transform(string_split(t, ''), lambda c: chr(list_position(cs, c)::INT)), ''), array_to_string(list_transform(string_split(u, ''), lambda c: chr(list_position(cs, c)::INT)), '')) AS n,
                levenshtein(coalesce(array_to_string(list_transform(v, lambda c: chr(list_position(ws, c)::INT)), ''), ''), coalesce(array_to_string(list_transform(x, lambda c: chr(list_position(ws, c)::INT)), ''), '')) AS m FROM q)
        SELECT item_id, n AS distance, n / greatest(length(t), 1)::DOUBLE AS error_rate, m AS word_distance, m / greatest(len(v), 1)::DOUBLE AS word_error_rate, t = u AS exact FROM d""",
}
