"""The queries of this package, as they are registered, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.quality import fit, quality

    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.license_scan import license_scan, template_table

    return license_scan(table(spark, sf_dir, "documents"), template_table(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op7_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.shard_ring import ring_shards

    return ring_shards(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heddle.llm.pack import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.conversation_repair import repair

    return repair(table(spark, sf_dir, "conversations"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from heddle.llm.secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op13_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from heddle.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_shard_ring": op7_shard_ring,
    "op8_url_filter": op8_url_filter,
    "op9_pack": op9_pack,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_secret_scan": op12_secret_scan,
    "op13_align_tokens": op13_align_tokens,
}

def _license_sql() -> str:
    from heddle.llm.license_scan import TEMPLATES

    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    return rf"""
        WITH templates(license_id, text) AS (VALUES {values}), tw AS (
            SELECT license_id, row_number() OVER () AS k, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM templates
        ), t AS (
            SELECT DISTINCT license_id, k, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM tw)
        ), dw AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), d AS (
            SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM dw WHERE len(w) > 0)
        ), firsts AS (
            SELECT d.doc_id, d.s, min(d.i) AS i FROM d SEMI JOIN t ON d.s = t.s GROUP BY ALL
        ), held AS (
            SELECT f.doc_id, t.license_id, t.k, count(*) AS n, min(f.i) AS i FROM firsts f JOIN t ON f.s = t.s GROUP BY ALL
        ), shares AS (
            SELECT doc_id, license_id, n / m AS containment, i FROM held JOIN (SELECT k, count(*) AS m FROM t GROUP BY k) USING (k) WHERE n / m >= 0.8
        )
        SELECT doc_id, license_id, max(containment) AS containment, arg_max(i, (containment, -i)) - 1 AS first_shingle FROM shares GROUP BY doc_id, license_id
    """.replace("\\\\x", "\\x")


def _secrets_sql() -> str:
    from heddle.llm.secret_scan import ALLOWED, CLASSES, KINDS, PATTERNS, SCALE, VALUE, limit

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def values(of) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches(match, {quoted(c[0])}) THEN {of(c)}" for c in CLASSES) + " END"

    matches = " UNION ALL ".join(
        f"SELECT uid, {k} AS k, regexp_extract_all(t, {quoted(p)}) AS m, regexp_extract_all(t, {quoted(p)}, {2 if k == 0 else 0}) AS v, regexp_split_to_array(t, {quoted(p)}) AS g FROM d" for k, p in enumerate(PATTERNS)
    )
    names = "[" + ", ".join(map(quoted, KINDS)) + "]"
    said = f"string_agg({names}[k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k)"
    return f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS uid FROM documents
        ), m AS ({matches}), e AS (
            SELECT uid, k, i, m[i] AS match, v[i] AS value, length(g[i]) AS gap FROM m, unnest(generate_series(1, len(m))) AS u(i)
        ), p AS (
            SELECT *, sum(gap + length(match)) OVER (PARTITION BY uid, k ORDER BY i) - length(match) AS pos FROM e
        ), base AS (
            SELECT uid, k, pos AS a, pos + length(match) AS b FROM p WHERE k IN (1, 2) OR k = 0 AND length(value) >= {VALUE}
        ), c AS (
            SELECT uid, pos, match, {values(lambda c: c[1])} AS w, {values(lambda c: limit(*c[1:]))} AS most FROM p
            WHERE k = 3 AND regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]') AND NOT regexp_matches(match, {quoted("|".join(f"(?:{p})" for p in ALLOWED))})
        ), chars AS (
            SELECT uid, pos, w, most, s, match[s + j] AS ch FROM c, unnest(generate_series(0, length(match) - w)) AS x(s), unnest(generate_series(1, w)) AS y(j)
        ), counts AS (
            SELECT uid, pos, w, most, s, count(*) AS n FROM chars GROUP BY uid, pos, w, most, s, ch
        ), hot AS (
            SELECT uid, pos, w, s FROM counts GROUP BY uid, pos, w, most, s HAVING sum(round(n * log2(n) * {SCALE})) <= most
        ), added AS (
            SELECT uid, 3 AS k, pos + min(s) AS a, pos + max(s) + any_value(w) AS b FROM hot GROUP BY uid, pos
        ), every AS (
            FROM base UNION ALL SELECT * FROM added x WHERE NOT EXISTS (FROM base y WHERE y.uid = x.uid AND y.a < x.b AND x.a < y.b)
        ), told AS (
            SELECT uid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_entropy, {said} FILTER (k < 3) AS base, {said} AS spans FROM every GROUP BY uid
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
        FROM d LEFT JOIN told USING (uid)
    """


def _repair_sql() -> str:
    """Costs, audits and repaired lines of the four states (start, behind a system, user, assistant row), row by row from the end."""

    def least(*options: tuple[str, str]) -> str:  # (condition, a struct of cost, audit, lines)
        return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {when} THEN {{{what}}} END" for when, what in options) + "], lambda x: x IS NOT NULL))[1]"

    after = {1: 3, 2: 3, 3: 4, 4: 3}  # lists count from 1
    role = {1: "user", 2: "user", 3: "assistant", 4: "user"}

    def moved(k: int, edit: str, cost: str, line: str) -> str:
        return f"'c': {cost} + f[{k}].c, 'a': '{edit}' || f[{k}].a, 't': list_prepend({line}, f[{k}].t)"

    def base(k: int) -> str:
        keeps = [("NOT gone AND initial = '%s'" % role[k][0], moved(after[k], "K", "extra", "role || ':' || text"))]
        if k == 1:
            keeps.append(("NOT gone AND initial = 's'", moved(2, "K", "extra", "role || ':' || text")))
        return least(("true", f"'c': 3 + f[{k}].c, 'a': 'D' || f[{k}].a, 't': f[{k}].t"), *keeps, ("NOT gone", moved(after[k], "R", "2 + extra", f"'{role[k]}:' || text")))

    def inserted(own: str, other: str, name: str) -> str:
        return least(("true", f"'c': {own}.c, 'a': {own}.a, 't': {own}.t"), ("true", f"'c': 2 + {other}.c, 'a': 'I' || {other}.a, 't': list_prepend('{name}:', {other}.t)"))

    return f"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS table_of
        ), said AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS b FROM conversations
        ), told AS (
            SELECT said.*, xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(table_of[1 + (xor(x, y) & 255)], x >> 8)), 4294967295) % 20 AS kind FROM said, crc
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM told, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text)) AS i FROM damaged
        ), faults AS (
            SELECT *, role[1] AS initial, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last_of, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
        ), symbols AS (
            SELECT *, last_of = '' AS blank, last_of <> '' AND seen AS duplicate, last_of <> '' AND NOT seen AND last_of NOT IN ('.', '!', '?') AS truncated, last_of = '' OR seen AS gone, (last_of <> '' AND NOT seen AND last_of NOT IN ('.', '!', '?'))::INT AS extra FROM faults
        ), counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM symbols GROUP BY conv_id
        ), ways AS (
            SELECT conv_id, n AS i, [{{'c': 0, 'a': '', 't': []::VARCHAR[]}}, {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}}, {{'c': 2, 'a': 'I', 't': ['assistant:']}}, {{'c': 0, 'a': '', 't': []::VARCHAR[]}}] AS f FROM counts
            UNION ALL
            SELECT conv_id, i, [{inserted("b1", "x3", "user")}, {inserted("b2", "x3", "user")}, x3, {inserted("b4", "b3", "user")}] FROM (
                SELECT *, {inserted("b3", "b4", "assistant")} AS x3 FROM (
                    SELECT w.conv_id, w.i - 1 AS i, {base(1)} AS b1, {base(2)} AS b2, {base(3)} AS b3, {base(4)} AS b4 FROM ways w JOIN symbols r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i
                )
            )
        ), best AS (
            SELECT conv_id, f[1] AS f FROM ways WHERE i = 0
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(f.c, 0)::BIGINT AS cost, coalesce(f.a, '') AS audit, sha256(coalesce(array_to_string(f.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
    """.replace("\\\\x", "\\x")


ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": _repair_sql(),
    "op12_secret_scan": _secrets_sql(),
    "op5_license_scan": _license_sql(),
    "op2_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS n FROM documents
        ), g AS (
            SELECT t, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY t
        )
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)
        ), k AS (
            SELECT doc_id, sha256(string_agg(s, '|' ORDER BY s)) AS k FROM s GROUP BY 1 UNION ALL SELECT doc_id, doc_id::VARCHAR FROM w WHERE len(w) = 0
        ), c AS (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS rep, count(*) OVER (PARTITION BY k) AS size FROM k
        ), r AS (
            SELECT s.doc_id, s.s, count(*) OVER (PARTITION BY s.doc_id) AS n FROM s JOIN c ON c.doc_id = s.doc_id AND c.rep = c.doc_id
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT DISTINCT a AS node, a AS root FROM links UNION SELECT l.b, reach.root FROM reach JOIN links l ON l.a = reach.node
        ), root AS (
            SELECT node, min(root) AS root FROM reach GROUP BY 1
        ), linked AS (
            SELECT l.a, sum(c.size) AS n FROM links l JOIN c ON c.doc_id = l.b GROUP BY 1
        )
        SELECT c.doc_id, coalesce(root.root, c.rep) AS class_id, (c.size - 1 + coalesce(linked.n, 0))::BIGINT AS n_links, c.rep AS copies_id
        FROM c LEFT JOIN root ON root.node = c.rep LEFT JOIN linked ON linked.a = c.rep
    """,
    "op10_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS body
            FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM b WHERE len(w) > 0)
        ), dw AS (
            SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS body
            FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
        ), hits AS (
            SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.body = bw.body AND dw.n = bw.n
        ), words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
}
