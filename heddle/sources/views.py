"""Derived views: the driver's tables in the shapes that the operators read, and the same views as SQL.

``VIEWS`` holds, for DuckDB, the SQL of each view; ``with_views`` puts those that a query names in
front of it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.columns import iso, lower, pattern, ref_week, trim


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(k, names: list[str]):
    out = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(names))):
        out = F.when(k == i, F.lit(name)).otherwise(out)
    return out


#: Event names by position in each derived event family.
AUTH = ["auth.code_requested", "auth.code_verified", "auth.code_failed", "auth.locked_out", "auth.password_failed"]
GATE = ["gate.blocked", "gate.resolved", "gate.brief_confirmed", "gate.brief_edited", "gate.corpus_confirmed", "gate.source_toggled", "plan.reviewed", "plan.omitted_list_opened", "plan.duration_changed", "workflow.rewound"]
FLOW = [
    "gate.script_approved", "gate.script_review_requested", "project.stage_entered", "project.stage_entered", "project.stage_entered", "project.stage_entered",
    "project.stage_failed", "episode.source_trace_opened", "project.recovered", "project.created", "plan.duration_changed", "corpus.evidence_attempts",
]
TO_STATE = {2: "episode_planned", 3: "episode_planning", 4: "script_drafting", 5: "complete"}
FROM_STATE = {2: "episode_planning", 3: "episode_planned", 4: "script_verifying", 5: "audio_verifying"}
CORE = {"signup": "user.registered", "view": "project.stage_entered", "purchase": "episode.audio_downloaded", "click": "project.created", "error": "project.stage_failed"}


def product_events(spark: SparkSession, sf_dir: str, family: str = "core", projects: int = 60) -> DataFrame:
    """Product events with parsed payload fields; ``family`` chooses how names are derived."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    base = e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("anon_id"),
        F.concat(F.lit("p"), (F.col("user_id") * 7 + k % 5) % projects).alias("project_id"),
        (F.col("event_id") % 10 == 0).alias("is_synthetic"),
        F.lit("production").alias("environment"),
        "event_type",
        "value",
        k.alias("k"),
    )
    if family == "core":
        name = F.lit(None).cast("string")
        for kind, to in CORE.items():
            name = F.when(F.col("event_type") == kind, F.lit(to)).otherwise(name)
        out = base.withColumns({"name": name, "stage": 1 + F.col("k") % 7})
    elif family == "auth":
        anonymous = F.col("event_id") % 4 == 0
        out = base.withColumns(
            {"name": _cases(F.col("k") % 5, AUTH), "anon_id": F.when(anonymous, F.concat(F.lit("a"), F.col("user_id"))), "user_id": F.when(~anonymous, F.col("user_id"))}
        )
    elif family == "gate":
        out = base.withColumns(
            {
                "name": _cases(F.col("k") % 10, GATE),
                "gate_name": F.concat(F.lit("g"), F.col("k") % 4),
                "from_stage": F.col("k") % 7,
                "direction": F.when(F.col("k") % 4 == 0, "up").otherwise("down"),
                "source_count": F.col("k") % 6 + 1,
                "blocked_seconds": F.floor("value"),
                "origin": F.concat(F.lit("o"), F.col("k") % 3),
            }
        )
    else:
        m = F.col("k") % 12
        to, source = F.lit(None).cast("string"), F.lit(None).cast("string")
        for i in TO_STATE:
            to, source = F.when(m == i, TO_STATE[i]).otherwise(to), F.when(m == i, FROM_STATE[i]).otherwise(source)
        out = base.withColumns(
            {"name": _cases(m, FLOW), "stage": 1 + F.col("k") % 7, "state": to, "from_state": source, "permanent": F.col("k") % 2 == 0, "kept": F.col("k") % 9, "dropped": F.col("k") % 4}
        )
    day = F.to_date("ts")
    return out.withColumns({"day": iso(day), "week": iso(ref_week(day))}).drop("event_type")


def real(events: DataFrame) -> DataFrame:
    """Not synthetic and in production."""
    return events.where(~F.col("is_synthetic") & (F.col("environment") == "production"))


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of model calls."""
    lines, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("rejected")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"], "left")
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"),
        F.concat(F.lit("o"), "o_orderkey").alias("trace_id"),
        F.concat(F.lit("p"), F.col("o_custkey") % 50).alias("project_id"),
        F.concat(F.lit("r"), F.col("o_custkey") % 200).alias("run_id"),
        F.col("l_returnflag").alias("stage"),
        F.col("p_brand").alias("model"),
        F.col("p_type").alias("provider"),
        status.alias("status"),
        F.floor(F.col("l_quantity") * 100).alias("input_tokens"),
        F.floor(F.col("l_quantity") * 10).alias("output_tokens"),
        F.floor("l_extendedprice").alias("latency_ms"),
        F.when(F.col("l_tax") >= 0.01, F.floor(F.round(F.col("l_quantity") * F.col("l_discount") * 1000, 3))).alias("cost_micros"),
        F.col("l_shipdate").cast("timestamp").alias("started_at"),
        (F.col("l_linenumber") == 7).alias("is_synthetic"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans: one root for each order, a child for each of its lines."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    roots = orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("span_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.concat(F.lit("o"), "o_orderkey").alias("trace_id"),
        F.concat(F.lit("p"), F.col("o_custkey") % 50).alias("project_id"),
        F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "failed").otherwise("succeeded").alias("status"),
        F.floor("o_totalprice").alias("duration_ms"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
    )
    children = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.concat(F.lit("l"), F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"),
        F.concat(F.lit("o"), "l_orderkey").alias("parent_id"),
        F.concat(F.lit("o"), "l_orderkey").alias("trace_id"),
        F.concat(F.lit("p"), F.col("o_custkey") % 50).alias("project_id"),
        F.col("l_returnflag").alias("name"),
        F.when(F.col("l_linestatus") == "O", "running").otherwise("succeeded").alias("status"),
        F.floor("l_extendedprice").alias("duration_ms"),
        F.col("l_shipdate").cast("timestamp").alias("started_at"),
    )
    return roots.unionByName(children)


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective-dated prices: three rows for each model but every fifth."""
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model")).agg(F.min("p_size").alias("s")).where("pmod(s, 5) <> 0 or s < 3")
    dates = F.explode(F.array(F.lit("1996-01-01"), F.lit("1998-01-01"), F.lit("2000-01-01"))).alias("d")
    return brands.select("model", "s", dates).select(
        "model",
        F.to_timestamp("d").alias("effective_from"),
        (F.col("s") * 1000 + F.year(F.to_date("d"))).cast("long").alias("input_per_million"),
        (F.col("s") * 3000 + 7).cast("long").alias("output_per_million"),
        F.col("s").cast("long").alias("per_call"),
    )


def lines_of(text: str):
    """The trimmed lines of a text that aren't empty."""
    # Not F.trim itself: transform hands a function of two parameters the place too, which would be the characters to trim.
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: trim(x)), lambda x: x != "")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: trimmed, not empty, numbered from 0; five to a page."""
    docs, lines = table(spark, sf_dir, "documents"), lines_of("text")
    # Outer, and filtered on what comes out: else Spark would split every text once more to see whether it has lines.
    out = docs.select("doc_id", "lang", "source", F.posexplode_outer(lines).alias("idx", "text")).where("text is not null")
    heading = (F.length("text") <= 60) & ~F.col("text").rlike(pattern(r"[.!?:;,|]$"))
    return out.select("doc_id", "lang", "source", F.col("idx").cast("long").alias("idx"), (1 + F.floor(F.col("idx") / 5)).alias("page"), "text", heading.alias("is_heading"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script turns: speaker A, B or editorial; a conversation is a segment."""
    speaker = F.when(F.col("role") == "user", "A").when(F.col("role") == "assistant", "B").otherwise("editorial")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("segment_id"), F.col("turn").alias("position"), speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed weighted edges between parts that follow each other in an order."""
    from pyspark.sql import Window

    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = lines.select("l_partkey", "l_discount", "l_quantity", F.lead("l_partkey").over(w).alias("target")).where("target is not null and target <> l_partkey")
    kinds = F.element_at(F.array(*[F.lit(t) for t in EDGE_TYPES]), (F.col("p_size") % 8 + 1).cast("int"))
    return pairs.join(parts.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("source"), "target", kinds.alias("type"), F.col("l_discount").alias("weight"), F.floor("l_quantity").alias("confidence")
    )


#: Edge types of the concept graph.
EDGE_TYPES = ["prerequisite", "depends_on", "extends", "contrasts", "example_of", "supports", "part_of", "related"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("cell"), (1 + F.col("p_size") % 3).cast("int").alias("tier"), F.col("p_brand").alias("chapter"), F.col("p_name").alias("label"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("minutes")
    )


#: Claim types.
CLAIM_TYPES = ["definition", "distinction", "example", "finding"]


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence drawn from blocks of twenty characters or more: an excerpt, a claim, its type, and the pages it names.  Some
    excerpts are too short, altered or the next block's, some ids repeat and some page ranges are wrong."""
    from pyspark.sql import Window

    i, after = F.col("idx"), F.lead("text").over(Window.partitionBy("doc_id").orderBy("idx"))
    piece = lambda text, at, size: F.substring(text, at, size)
    excerpt = (
        F.when(i % 7 == 3, piece(F.col("text"), 1, 8))
        .when(i % 11 == 5, F.concat(F.lit("zz"), piece(F.col("text"), 1, 28)))
        .when((i % 9 == 4) & (F.length("after") >= 20), piece(F.col("after"), 1, 20))
        .otherwise(F.substr(F.col("text"), (1 + i % 5).cast("int"), F.lit(30)))
    )
    return (
        blocks(spark, sf_dir)
        .withColumn("after", after)
        .where(F.length("text") >= 20)
        .select(
            "doc_id", "source", "idx", "page", "text",
            F.concat(F.lit("e"), F.col("doc_id") % 5000, F.lit("-"), i % 40).alias("evidence_id"),
            excerpt.alias("excerpt"),
            lower(trim(piece(F.col("text"), 1, 60))).alias("claim"),
            F.element_at(F.array(*[F.lit(t) for t in CLAIM_TYPES]), (i % 4 + 1).cast("int")).alias("claim_type"),
            F.when(i % 3 != 0, F.concat(F.lit("t"), i % 6)).alias("term"),
            (i % 5 != 0).alias("has_contrast"),
            F.col("page").alias("page_start"),
            (F.col("page") + F.when(i % 13 == 0, 1).otherwise(0) - F.when(i % 17 == 0, 2).otherwise(0)).alias("page_end"),
            ((F.col("doc_id") + i) % 10 / 10).alias("confidence"),
        )
    )


_WEEK = "strftime(CASE WHEN isodow(ts) = 1 THEN ts::DATE - 7 ELSE date_trunc('week', ts)::DATE END, '%Y-%m-%d')"
_K = "json_extract_string(props, '$.k')::INT"


def _sql_cases(expr: str, names: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


_EVENTS = f"""
    SELECT event_id, ts, {{user}} AS user_id, {{anon}} AS anon_id, 'p' || ((user_id * 7 + k % 5) % 60) AS project_id, event_id % 10 = 0 AS is_synthetic, 'production' AS environment,
           value, k, {{columns}}, strftime(ts, '%Y-%m-%d') AS day, {_WEEK} AS week
    FROM (SELECT *, {_K} AS k FROM events)
"""
_USER = "user_id::VARCHAR"

VIEWS: dict[str, str] = {
    "core_events": _EVENTS.format(user=_USER, anon="NULL::VARCHAR", columns="CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CORE.items()) + " END AS name, 1 + k % 7 AS stage"),
    "auth_events": _EVENTS.format(user=f"CASE WHEN event_id % 4 <> 0 THEN {_USER} END", anon=f"CASE WHEN event_id % 4 = 0 THEN 'a' || user_id END", columns=_sql_cases("k % 5", AUTH) + " AS name"),
    "gate_events": _EVENTS.format(
        user=_USER,
        anon="NULL::VARCHAR",
        columns=_sql_cases("k % 10", GATE)
        + " AS name, 'g' || (k % 4) AS gate_name, k % 7 AS from_stage, CASE WHEN k % 4 = 0 THEN 'up' ELSE 'down' END AS direction, k % 6 + 1 AS source_count, floor(value) AS blocked_seconds, 'o' || (k % 3) AS origin",
    ),
    "flow_events": _EVENTS.format(
        user=_USER,
        anon="NULL::VARCHAR",
        columns=_sql_cases("k % 12", FLOW)
        + " AS name, 1 + k % 7 AS stage, CASE k % 12 "
        + " ".join(f"WHEN {i} THEN '{s}'" for i, s in TO_STATE.items())
        + " END AS state, CASE k % 12 "
        + " ".join(f"WHEN {i} THEN '{s}'" for i, s in FROM_STATE.items())
        + " END AS from_state, k % 2 = 0 AS permanent, k % 9 AS kept, k % 4 AS dropped",
    ),
    "fine": "SELECT * REPLACE ('p' || ((user_id::BIGINT * 7 + k % 5) % 600) AS project_id) FROM core",
    "core": "SELECT * FROM core_events WHERE NOT is_synthetic AND environment = 'production'",
    "auth": "SELECT * FROM auth_events WHERE NOT is_synthetic AND environment = 'production'",
    "gate": "SELECT * FROM gate_events WHERE NOT is_synthetic AND environment = 'production'",
    "flow": "SELECT * FROM flow_events WHERE NOT is_synthetic AND environment = 'production'",
    "model_calls": """
        SELECT l_orderkey * 10 + l_linenumber AS call_id, 'o' || o_orderkey AS trace_id, 'p' || (o_custkey % 50) AS project_id, 'r' || (o_custkey % 200) AS run_id, l_returnflag AS stage, p_brand AS model, p_type AS provider,
               CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'rejected' END AS status,
               floor(l_quantity * 100)::BIGINT AS input_tokens, floor(l_quantity * 10)::BIGINT AS output_tokens, floor(l_extendedprice)::BIGINT AS latency_ms,
               CASE WHEN l_tax >= 0.01 THEN floor(round(l_quantity * l_discount * 1000, 3))::BIGINT END AS cost_micros, l_shipdate AS started_at, l_linenumber = 7 AS is_synthetic
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
    """,
    "spans": """
        SELECT 'o' || o_orderkey AS span_id, NULL::VARCHAR AS parent_id, 'o' || o_orderkey AS trace_id, 'p' || (o_custkey % 50) AS project_id, o_orderpriority AS name,
               CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'failed' ELSE 'succeeded' END AS status, floor(o_totalprice)::BIGINT AS duration_ms, o_orderdate AS started_at FROM orders
        UNION ALL
        SELECT 'l' || (l_orderkey * 10 + l_linenumber), 'o' || l_orderkey, 'o' || l_orderkey, 'p' || (o_custkey % 50), l_returnflag, CASE l_linestatus WHEN 'O' THEN 'running' ELSE 'succeeded' END, floor(l_extendedprice)::BIGINT, l_shipdate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
    "prices": """
        SELECT model, d::TIMESTAMP AS effective_from, s * 1000 + year(d::DATE) AS input_per_million, s * 3000 + 7 AS output_per_million, s AS per_call
        FROM (SELECT p_brand AS model, min(p_size)::BIGINT AS s FROM part GROUP BY 1), (VALUES ('1996-01-01'), ('1998-01-01'), ('2000-01-01')) AS v(d) WHERE s % 5 <> 0 OR s < 3
    """,
    "blocks": r"""
        SELECT doc_id, lang, source, (i - 1)::BIGINT AS idx, 1 + ((i - 1) // 5) AS page, text, length(text) <= 60 AND NOT regexp_matches(text, '[.!?:;,|]$') AS is_heading
        FROM (SELECT doc_id, lang, source, unnest(l) AS text, unnest(generate_series(1, len(l))) AS i
              FROM (SELECT doc_id, lang, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))
    """,
    "evidence": f"""
        SELECT doc_id, source, idx, page, text, 'e' || (doc_id % 5000) || '-' || (idx % 40) AS evidence_id,
               CASE WHEN idx % 7 = 3 THEN substring(text, 1, 8) WHEN idx % 11 = 5 THEN 'zz' || substring(text, 1, 28)
                    WHEN idx % 9 = 4 AND length(after) >= 20 THEN substring(after, 1, 20) ELSE substring(text, 1 + (idx % 5)::INT, 30) END AS excerpt,
               lower(trim(substring(text, 1, 60))) AS claim, [{", ".join(f"'{t}'" for t in CLAIM_TYPES)}][(idx % 4 + 1)::INT] AS claim_type, CASE WHEN idx % 3 <> 0 THEN 't' || (idx % 6) END AS term,
               idx % 5 <> 0 AS has_contrast, page AS page_start, page + CASE WHEN idx % 13 = 0 THEN 1 ELSE 0 END - CASE WHEN idx % 17 = 0 THEN 2 ELSE 0 END AS page_end,
               ((doc_id + idx) % 10) / 10 AS confidence
        FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY idx) AS after FROM blocks) WHERE length(text) >= 20
    """,
    "turns": "SELECT conv_id AS segment_id, turn AS position, CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' ELSE 'editorial' END AS speaker, coalesce(text, '') AS text FROM conversations",
    "edges": f"""
        SELECT l_partkey AS source, target, [{", ".join(f"'{t}'" for t in EDGE_TYPES)}][p_size % 8 + 1] AS type, l_discount AS weight, floor(l_quantity)::BIGINT AS confidence
        FROM (SELECT l_partkey, l_discount, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS target FROM lineitem) JOIN part ON l_partkey = p_partkey
        WHERE target IS NOT NULL AND target <> l_partkey
    """,
    "cells": "SELECT p_partkey AS cell, 1 + p_size % 3 AS tier, p_brand AS chapter, p_name AS label, p_type AS kind, p_size::BIGINT AS minutes FROM part",
}


def with_views(sql: str) -> str:
    """Puts the views that ``sql`` names (and those that they name) in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE" if recursive else "WITH") :].strip()
        return f"WITH {'RECURSIVE ' if recursive else ''}{head + ', ' if head else ''}{body}"
    return f"WITH {head} {body}" if head else body
