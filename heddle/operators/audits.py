"""Merging, validation and budgets over plans: sections, claims, cells, approvals and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import fold_for_match, half_even, share, token_estimate
from heddle.operators.documents import pack_in_order
from heddle.operators.evidence import word_list
from heddle.operators.ledger import priced_calls
from heddle.sources.views import blocks, cells, edges, model_calls, prices, product_events, real, spans, table, turns


def b31_partitions(spark, sf_dir, most: int = 2000):
    """Blocks of a document in order under a character budget; a block over it alone is an error row's flag."""
    b = blocks(spark, sf_dir).select("doc_id", "idx", F.length("text").cast("long").alias("tokens"), F.lit(False).alias("alone"))
    docs = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "tokens", "alone"))).alias("items"))
    binned = docs.select("doc_id", F.size("items").alias("blocks"), pack_in_order(F.col("items"), most, most).alias("bins"), F.exists("items", lambda x: x["tokens"] > most).alias("oversize"))
    return binned.select("doc_id", "blocks", (F.array_max("bins") + 1).alias("parts"), "oversize")


def b35_first_sections(spark, sf_dir):
    """A block (part) belongs to the first section (order) that has it; sections left empty are counted."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section"), F.col("l_partkey").alias("block")).distinct()
    kept = pairs.groupBy("block").agg(F.min("section").alias("section"))
    sections = pairs.select("section").distinct().join(kept.groupBy("section").agg(F.count("*").alias("blocks")), "section", "left")
    return sections.groupBy((F.col("section") % 10).alias("bucket")).agg(F.count("*").alias("sections"), F.count_if(F.col("blocks").isNull()).alias("emptied"), F.sum("blocks").alias("blocks"))


def b38_merged_sections(spark, sf_dir):
    """Sections of several drafts: parts united in order of their first line, required if any draft says so."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("required"))
    first = lines.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("at"), F.bool_or("required").alias("required"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",")
    return first.groupBy(F.col("l_orderkey").alias("section")).agg(listed.alias("blocks"), F.bool_or("required").alias("required"))


def b45_best_attempts(spark, sf_dir):
    """First safe attempt in route order, else the best by verdict and size; attempts are an order's lines."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "A").alias("safe"), F.floor("l_extendedprice").alias("size"))
    first_safe = F.min(F.when(F.col("safe"), F.struct("l_linenumber", F.col("size").alias("s"))))
    best = F.max(F.struct("size", -F.col("l_linenumber")))
    by = a.groupBy("l_orderkey").agg(first_safe.alias("f"), best.alias("b"))
    return by.select("l_orderkey", F.coalesce("f.l_linenumber", -F.col("b.col2")).alias("attempt"), F.col("f").isNotNull().alias("safe"))


def b59_section_texts(spark, sf_dir):
    """The text of each page of a document from its blocks in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    return blocks(spark, sf_dir).groupBy("doc_id", "page").agg(F.md5(F.array_join(ordered, "\n").cast("binary")).alias("text_md5"), F.count("*").alias("blocks"))


def e29_merged_claims(spark, sf_dir):
    """Claims of one group become one: the smallest text, evidence united, flags or-ed, first known term."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws("|", "p_brand", "p_type").alias("claim"), "p_size")
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", (F.col("l_discount") > 0.09).alias("flag"))
    joined = parts.join(evidence, "p_partkey", "left")
    listed = F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",")
    return joined.groupBy("claim").agg(F.min("p_name").alias("text"), F.md5(listed.cast("binary")).alias("evidence_md5"), F.countDistinct("l_suppkey").alias("evidence"), F.coalesce(F.bool_or("flag"), F.lit(False)).alias("flag"), F.min_by("p_size", "p_partkey").alias("first_size"))


def e48_claim_cells(spark, sf_dir):
    """Claims linked to chapters through their evidence; the smallest is the primary one."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("claim"), F.col("l_partkey").alias("cell"))
    linked = lines.join(cells(spark, sf_dir).select("cell", "chapter"), "cell")
    return linked.groupBy("claim").agg(F.min("chapter").alias("primary_chapter"), F.countDistinct("chapter").alias("chapters"), F.count("*").alias("evidence"))


def e54_plan_order(spark, sf_dir):
    """Plan items whose prerequisite is introduced later, by type of the edge."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell")).agg(F.min("l_orderkey").alias("at"))
    e = edges(spark, sf_dir).where(F.col("type").isin("prerequisite", "depends_on"))
    a, b = first.select(F.col("cell").alias("source"), F.col("at").alias("source_at")), first.select(F.col("cell").alias("target"), F.col("at").alias("target_at"))
    return e.join(a, "source").join(b, "target").groupBy("type").agg(F.count("*").alias("edges"), F.count_if(F.col("source_at") > F.col("target_at")).alias("too_late"))


def take_what_fits(items: Column, budget: int) -> Column:
    """Greedy over an ordered array of structs (key, cost): the keys taken; one that doesn't fit is skipped and the next tried."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("keys"))

    def step(s, x):
        fits = s["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["keys"], F.array(x["key"]))).otherwise(s["keys"]).alias("keys"))

    return F.aggregate(items, start, step, lambda s: s["keys"])


def e77_evidence_packs(spark, sf_dir, budget: int = 600):
    """Blocks of a document, longest first, packed under a token budget; what doesn't fit is passed over."""
    b = blocks(spark, sf_dir).select("doc_id", F.col("idx").alias("key"), token_estimate(F.col("text")).alias("cost"))
    docs = b.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cost")).alias("o"), "key", "cost"))), lambda x: F.struct(x["key"].alias("key"), x["cost"].alias("cost"))).alias("items"))
    taken = docs.select("doc_id", F.size("items").alias("blocks"), take_what_fits(F.col("items"), budget).alias("keys"))
    return taken.select("doc_id", "blocks", F.size("keys").alias("taken"), F.aggregate("keys", F.lit(0).cast("long"), lambda s, x: s + x).alias("idx_sum"))


def e78_input_keys(spark, sf_dir):
    """Identity of a plan's input: hash of its sorted distinct parts and suppliers."""
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.concat_ws("|", text("l_partkey"), text("l_suppkey")).cast("binary"), 256).alias("key"))
    return by.groupBy(F.substring("key", 1, 2).alias("prefix")).agg(F.count("*").alias("plans"), F.min("key").alias("least"))


def g17_merged_labels(spark, sf_dir):
    """Cells of a chapter with one label become the smallest of them, with the best tier and all minutes."""
    return cells(spark, sf_dir).groupBy("chapter", "label").agg(F.min("cell").alias("cell"), F.min("tier").alias("tier"), F.sum("minutes").alias("minutes"), F.count("*").alias("merged"))


def g18_related_candidates(spark, sf_dir):
    """The same label and kind in two chapters, as pairs of chapters with how many labels they share."""
    c = cells(spark, sf_dir).select("label", "kind", "chapter").distinct()
    other = c.withColumnRenamed("chapter", "other")
    return c.join(other, ["label", "kind"]).where("chapter < other").groupBy("chapter", "other").agg(F.count("*").alias("labels"))


def g28_objectives(spark, sf_dir, most: int = 5):
    """The first five kinds of a chapter by size, with their labels in order."""
    by = cells(spark, sf_dir).groupBy("chapter", "kind").agg(F.count("*").alias("cells"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    place = F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("cells"), "kind"))
    return by.withColumn("place", place).where(F.col("place") <= most).select("chapter", "kind", "cells", F.md5(F.col("labels").cast("binary")).alias("labels_md5"), "place")


def g33_last_edits(spark, sf_dir):
    """An edit log folded into a change set: the last edit of each (project, stage) wins."""
    e = product_events(spark, sf_dir, "flow").where("name = 'project.stage_entered'")
    last = e.groupBy("project_id", "stage").agg(F.max(F.struct("ts", "event_id", "state")).alias("m"), F.count("*").alias("edits"))
    return last.select("project_id", "stage", "m.state", "edits")


def g44_next_numbers(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("chapter").agg((F.max(F.col("cell") % 1000) + 1).alias("next_number"), F.count("*").alias("cells"))


def q18_exact_spans(spark, sf_dir, number: int = 20, size: int = 40):
    """Share of twenty evenly spaced spans of forty characters that are found again in the folded text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).where(F.length("t") >= number * size)
    folded = docs.select("doc_id", "t", fold_for_match(F.col("t")).alias("f"))
    step = F.floor((F.length("t") - size) / F.lit(number - 1)).cast("int")
    spans_ = F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.substring(F.col("t"), i * F.col("step") + 1, F.lit(size)))
    each = folded.withColumn("step", step).select("doc_id", "f", F.explode_outer(spans_).alias("s"))
    found = F.contains(F.col("f"), fold_for_match(F.col("s")))
    return each.groupBy("doc_id").agg(F.avg(found.cast("double")).alias("recovered"))


def q24_readiness(spark, sf_dir):
    """Gates of each project in order; the first that isn't passed blocks the rest."""
    e = real(product_events(spark, sf_dir, "gate"))
    has = lambda name: F.bool_or(F.col("name") == name)
    p = e.groupBy("project_id").agg(has("gate.brief_confirmed").alias("brief"), has("gate.corpus_confirmed").alias("corpus"), has("plan.reviewed").alias("plan"), (~has("workflow.rewound")).alias("steady"))
    gates = p.unpivot(["project_id"], ["brief", "corpus", "plan", "steady"], "gate", "passed")
    number = F.element_at(F.create_map(*[F.lit(x) for pair in (("brief", 1), ("corpus", 2), ("plan", 3), ("steady", 4)) for x in pair]), F.col("gate"))
    before = F.min(F.col("passed").cast("int")).over(Window.partitionBy("project_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1))
    status = F.when(F.coalesce(before, F.lit(1)) == 0, "blocked").when(F.col("passed"), "passed").otherwise("open")
    return gates.withColumn("no", number).withColumn("status", status).select("project_id", "gate", "no", "status")


def q26_retention(spark, sf_dir):
    """Planned and kept tokens of a run; holds at 0.85, or at 0.75 with the largest loss forgiven."""
    c = model_calls(spark, sf_dir)
    lost = F.when(F.col("status") == "failed", F.col("input_tokens")).otherwise(0)
    by = c.groupBy("run_id").agg(F.sum("input_tokens").alias("planned"), F.sum(F.col("input_tokens") - lost).alias("kept"), F.max(lost).alias("largest"))
    holds = (share(F.col("kept"), F.col("planned")) >= 0.85) | (share(F.col("kept") + F.col("largest"), F.col("planned")) >= 0.75)
    return by.select("run_id", "planned", "kept", holds.alias("holds"))


def q32_outside_evidence(spark, sf_dir):
    """Lines whose supplier is none of those that their part's other orders cite, by part size."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    cited = lines.groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"))
    flagged = lines.join(cited, ["l_partkey", "l_suppkey"]).withColumn("outside", F.col("orders") == 1)
    return flagged.groupBy((F.col("l_partkey") % 10).alias("bucket")).agg(F.count("*").alias("citations"), F.count_if("outside").alias("outside"), F.avg(F.col("outside").cast("double")).alias("rate"))


def q40_stale_approvals(spark, sf_dir, days: int = 30):
    """Approvals - of what an order's plan held so many days after it was placed - whose plan has another hash now."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    held = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    then = F.when(F.col("l_shipdate") <= F.date_add("o_orderdate", days).cast("timestamp"), item)
    plans = held.groupBy("o_orderkey", "o_custkey").agg(F.array_sort(F.collect_list(item)).alias("now"), F.array_sort(F.collect_list(then)).alias("then"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])), "|")
    key = lambda a: F.sha2(text(a).cast("binary"), 256)
    return plans.groupBy((F.col("o_custkey") % 10).alias("bucket")).agg(F.count("*").alias("approvals"), F.count_if(key("now") != key("then")).alias("stale"), F.count_if(F.size("then") == 0).alias("empty"))


def c05_cost_estimate(spark, sf_dir):
    """Estimated cost of each chapter: distinct parts of its cells, tokens by size, times 1.3, at the latest price."""
    tokens = half_even(F.sum("minutes") * 300 * 1.3).cast("long")
    by = cells(spark, sf_dir).groupBy(F.col("chapter").alias("model")).agg(tokens.alias("tokens"), F.count("*").alias("cells"))
    latest = prices(spark, sf_dir).groupBy("model").agg(F.max_by("input_per_million", "effective_from").alias("rate"))
    return by.join(latest, "model", "left").select("model", "cells", "tokens", half_even(F.col("tokens") * F.col("rate") / 1_000_000).cast("long").alias("cost_micros"))


def c09_supported_minutes(spark, sf_dir):
    """The least of 120, claim seconds and evidence tokens in minutes; what limits it."""
    by = model_calls(spark, sf_dir).groupBy("project_id").agg((F.sum("latency_ms") / 1000 * 4 / 60 / 1000).alias("by_claims"), (F.sum("input_tokens") / 20 / 1000).alias("by_evidence"))
    least = F.least(F.lit(120.0), "by_claims", "by_evidence")
    limit = F.when(least == F.col("by_claims"), "claims").when(least == F.col("by_evidence"), "evidence").otherwise("most")
    return by.select("project_id", least.alias("minutes"), limit.alias("limited_by"))


def c13_estimate_and_actual(spark, sf_dir):
    """The cost of each stage's calls under the prices in force against what those that succeeded cost, over the union of both sides' keys;
    a side without a price is null, never 0."""
    c = model_calls(spark, sf_dir)
    actual = c.where("status = 'succeeded'").groupBy("project_id", "stage").agg(F.sum("cost_micros").alias("actual"))
    estimate = priced_calls(c, prices(spark, sf_dir)).groupBy("project_id", "stage").agg(F.sum("price_micros").alias("estimate"), F.count_if(F.col("price_micros").isNull()).alias("unpriced"))
    both = estimate.join(actual, ["project_id", "stage"], "full")
    return both.select("project_id", "stage", "estimate", "actual", F.coalesce("unpriced", F.lit(0)).alias("unpriced"), share(F.col("actual"), F.col("estimate")).alias("ratio"))


def o38_attempts(spark, sf_dir):
    """Attempts of each call: lines of one order and part, with the last one's status."""
    c = model_calls(spark, sf_dir)
    by = c.groupBy("trace_id", "model").agg(F.count("*").alias("attempts"), F.max(F.struct("started_at", "call_id", "latency_ms", "status")).alias("m"))
    return by.groupBy("attempts", F.col("m.status").alias("last_status")).agg(F.count("*").alias("calls"))


def o21_trace_runs(spark, sf_dir):
    """Roots, first start and last end of each project's finished traces, with the names that occur."""
    s = spans(spark, sf_dir).where("status <> 'running' and parent_id is null")
    end = F.unix_millis("started_at") + F.col("duration_ms")
    return s.groupBy("project_id").agg(F.count("*").alias("roots"), (F.max(end) - F.min(F.unix_millis("started_at"))).alias("span_ms"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def t28_claim_repeats(spark, sf_dir):
    """Words that more than two turns of a segment use, of eight letters or more."""
    t = turns(spark, sf_dir).select("segment_id", "position", F.explode_outer(F.array_distinct(word_list(F.col("text")))).alias("word")).where("length(word) >= 8")
    return t.groupBy("segment_id", "word").agg(F.count("*").alias("turns")).where("turns > 2")


def t29_glossary(spark, sf_dir):
    """Terms with the forms in which they are written: one form is settled, more are a conflict."""
    term = F.explode_outer(F.regexp_extract_all("text", F.lit(r"(\p{L}{9,})")))
    t = turns(spark, sf_dir).select(term.alias("form")).where("form is not null")
    by = t.groupBy(F.lower("form").alias("term")).agg(F.count("*").alias("uses"), F.countDistinct("form").alias("forms"), F.min("form").alias("first_form"))
    return by.where("uses >= 2").select("term", "uses", "forms", F.when(F.col("forms") == 1, F.col("first_form")).alias("preferred"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] in "bcegoqt" and name[1:3].isdigit()}

_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _sql() -> dict[str, str]:
    from heddle.plans.document_sql import fold, tokens
    from heddle.plans.ledger_sql import PRICED

    pack = lambda cost, budget: f"""WITH RECURSIVE n AS (SELECT doc_id, idx, ({cost})::BIGINT AS c FROM blocks), w AS (
            SELECT doc_id, idx, 0 AS bin, c AS held, c > {budget} AS big FROM n WHERE idx = 0
            UNION ALL SELECT n.doc_id, n.idx, w.bin + x.anew::INT, CASE WHEN x.anew THEN 0 ELSE w.held END + n.c, n.c > {budget} FROM w JOIN n ON n.doc_id = w.doc_id AND n.idx = w.idx + 1, LATERAL (SELECT w.held > 0 AND (w.held + n.c > {budget} OR w.held >= {budget}) AS anew) x)"""  # noqa: E731
    return {
        "b31_partitions": pack("length(text)", 2000) + " SELECT doc_id, count(*)::INT AS blocks, max(bin) + 1 AS parts, bool_or(big) AS oversize FROM w GROUP BY 1",
        "b35_first_sections": """WITH p AS (SELECT DISTINCT l_orderkey AS section, l_partkey AS block FROM lineitem), k AS (SELECT section, count(*) AS n FROM (SELECT block, min(section) AS section FROM p GROUP BY 1) GROUP BY 1)
            SELECT section % 10 AS bucket, count(*) AS sections, count(*) FILTER (n IS NULL) AS emptied, sum(n)::BIGINT AS blocks FROM (SELECT DISTINCT section FROM p) LEFT JOIN k USING (section) GROUP BY 1""",
        "b38_merged_sections": """WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS no, bool_or(l_returnflag = 'R') AS required FROM lineitem GROUP BY ALL)
            SELECT l_orderkey AS section, string_agg(l_partkey::VARCHAR, ',' ORDER BY no, l_partkey) AS blocks, bool_or(required) AS required FROM f GROUP BY 1""",
        "b45_best_attempts": """WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS safe, floor(l_extendedprice) AS size FROM lineitem)
            SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (safe), -arg_max(-l_linenumber, (size, -l_linenumber))) AS attempt, bool_or(safe) AS safe FROM a GROUP BY 1""",
        "b59_section_texts": "SELECT doc_id, page, md5(string_agg(text, chr(10) ORDER BY idx)) AS text_md5, count(*) AS blocks FROM blocks GROUP BY doc_id, page",
        "e29_merged_claims": """WITH j AS (SELECT p_partkey, p_name, p_brand || '|' || p_type AS claim, p_size, l_suppkey, l_discount > 0.09 AS flag FROM part LEFT JOIN lineitem ON l_partkey = p_partkey)
            SELECT claim, min(p_name) AS text, md5(coalesce(array_to_string(list_sort(list(DISTINCT l_suppkey) FILTER (l_suppkey IS NOT NULL)), ','), '')) AS evidence_md5, count(DISTINCT l_suppkey) AS evidence, coalesce(bool_or(flag), false) AS flag, arg_min(p_size, p_partkey) AS first_size FROM j GROUP BY 1""",
        "e48_claim_cells": "SELECT l_suppkey AS claim, min(chapter) AS primary_chapter, count(DISTINCT chapter) AS chapters, count(*) AS evidence FROM lineitem JOIN cells ON cell = l_partkey GROUP BY 1",
        "e54_plan_order": """WITH f AS (SELECT l_partkey AS cell, min(l_orderkey) AS at FROM lineitem GROUP BY 1)
            SELECT type, count(*) AS edges, count(*) FILTER (a.at > b.at) AS too_late FROM edges JOIN f a ON a.cell = source JOIN f b ON b.cell = target WHERE type IN ('prerequisite', 'depends_on') GROUP BY type""",
        "e77_evidence_packs": f"""WITH RECURSIVE n AS (SELECT doc_id, idx, {tokens()} AS c, row_number() OVER (PARTITION BY doc_id ORDER BY {tokens()} DESC, idx) AS r FROM blocks), w AS (
            SELECT doc_id, r, CASE WHEN c <= 600 THEN c ELSE 0 END AS used, c <= 600 AS took, idx FROM n WHERE r = 1
            UNION ALL SELECT n.doc_id, n.r, CASE WHEN w.used + n.c <= 600 THEN w.used + n.c ELSE w.used END, w.used + n.c <= 600, n.idx FROM w JOIN n ON n.doc_id = w.doc_id AND n.r = w.r + 1)
            SELECT doc_id, count(*)::INT AS blocks, (count(*) FILTER (took))::INT AS taken, coalesce(sum(idx) FILTER (took), 0)::BIGINT AS idx_sum FROM w GROUP BY 1""",
        "e78_input_keys": """WITH k AS (SELECT sha256(array_to_string(list_sort(list(DISTINCT l_partkey)), ',') || '|' || array_to_string(list_sort(list(DISTINCT l_suppkey)), ',')) AS key FROM lineitem GROUP BY l_orderkey)
            SELECT key[1:2] AS prefix, count(*) AS plans, min(key) AS least FROM k GROUP BY 1""",
        "g17_merged_labels": "SELECT chapter, label, min(cell) AS cell, min(tier) AS tier, sum(minutes)::BIGINT AS minutes, count(*) AS merged FROM cells GROUP BY ALL",
        "g18_related_candidates": "WITH c AS (SELECT DISTINCT label, kind, chapter FROM cells) SELECT a.chapter, b.chapter AS other, count(*) AS labels FROM c a JOIN c b ON a.label = b.label AND a.kind = b.kind AND a.chapter < b.chapter GROUP BY ALL",
        "g28_objectives": """WITH k AS (SELECT chapter, kind, count(*) AS cells, md5(array_to_string(list_sort(list(DISTINCT label)), ',')) AS labels_md5 FROM cells GROUP BY ALL)
            SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY cells DESC, kind)::INT AS place FROM k QUALIFY place <= 5""",
        "g33_last_edits": "SELECT project_id, stage, arg_max(state, (ts, event_id)) AS state, count(*) AS edits FROM flow_events WHERE name = 'project.stage_entered' GROUP BY ALL",
        "g44_next_numbers": "SELECT chapter, max(cell % 1000) + 1 AS next_number, count(*) AS cells FROM cells GROUP BY 1",
        "q18_exact_spans": f"""WITH d AS (SELECT doc_id, text AS t, {fold("text")} AS f, floor((length(text) - 40) / 19.0)::INT AS step FROM documents WHERE length(coalesce(text, '')) >= 800), s AS (SELECT doc_id, f, substring(t, i::INT * step + 1, 40) AS x FROM d, generate_series(0, 19) AS g(i))
            SELECT doc_id, avg(contains(f, {fold("x")})::INT) AS recovered FROM s GROUP BY 1""",
        "q24_readiness": """WITH p AS (SELECT project_id, bool_or(name = 'gate.brief_confirmed') AS brief, bool_or(name = 'gate.corpus_confirmed') AS corpus, bool_or(name = 'plan.reviewed') AS plan, NOT bool_or(name = 'workflow.rewound') AS steady FROM gate GROUP BY 1),
            g AS (SELECT project_id, 'brief' AS gate, 1 AS no, brief AS passed FROM p UNION ALL SELECT project_id, 'corpus', 2, corpus FROM p UNION ALL SELECT project_id, 'plan', 3, plan FROM p UNION ALL SELECT project_id, 'steady', 4, steady FROM p)
            SELECT project_id, gate, no, CASE WHEN coalesce(bool_and(passed) OVER (PARTITION BY project_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) = false THEN 'blocked' WHEN passed THEN 'passed' ELSE 'open' END AS status FROM g""",
        "q26_retention": """WITH b AS (SELECT run_id, sum(input_tokens)::BIGINT AS planned, sum(CASE WHEN status = 'failed' THEN 0 ELSE input_tokens END)::BIGINT AS kept, max(CASE WHEN status = 'failed' THEN input_tokens ELSE 0 END) AS largest FROM model_calls GROUP BY 1)
            SELECT run_id, planned, kept, kept::DOUBLE / nullif(planned, 0) >= 0.85 OR (kept + largest)::DOUBLE / nullif(planned, 0) >= 0.75 AS holds FROM b""",
        "q32_outside_evidence": """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem), c AS (SELECT l_partkey, l_suppkey, count(*) AS orders FROM l GROUP BY ALL)
            SELECT l_partkey % 10 AS bucket, count(*) AS citations, count(*) FILTER (orders = 1) AS outside, avg((orders = 1)::INT) AS rate FROM l JOIN c USING (l_partkey, l_suppkey) GROUP BY 1""",
        "q40_stale_approvals": """WITH h AS (SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey, l_shipdate <= o_orderdate::DATE + 30 AS early FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
            p AS (SELECT o_orderkey, o_custkey, list({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey} ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, coalesce(list({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey} ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (early), []) AS b FROM h GROUP BY ALL)
            SELECT o_custkey % 10 AS bucket, count(*) AS approvals, count(*) FILTER (a <> b) AS stale, count(*) FILTER (len(b) = 0) AS empty FROM p GROUP BY 1""",
        "c05_cost_estimate": """WITH b AS (SELECT chapter AS model, round_even(sum(minutes) * 300 * 1.3::DOUBLE, 0)::BIGINT AS tokens, count(*) AS cells FROM cells GROUP BY 1), p AS (SELECT model, arg_max(input_per_million, effective_from) AS rate FROM prices GROUP BY 1)
            SELECT model, cells, tokens, round_even(tokens * rate / 1e6, 0)::BIGINT AS cost_micros FROM b LEFT JOIN p USING (model)""",
        "c09_supported_minutes": """WITH b AS (SELECT project_id, sum(latency_ms) / 1000::DOUBLE * 4 / 60 / 1000 AS x, sum(input_tokens) / 20::DOUBLE / 1000 AS y FROM model_calls GROUP BY 1)
            SELECT project_id, least(120, x, y)::DOUBLE AS minutes, CASE WHEN least(120, x, y) = x THEN 'claims' WHEN least(120, x, y) = y THEN 'evidence' ELSE 'most' END AS limited_by FROM b""",
        "c13_estimate_and_actual": f"""WITH {PRICED}, a AS (SELECT project_id, stage, sum(cost_micros)::BIGINT AS actual FROM model_calls WHERE status = 'succeeded' GROUP BY ALL), e AS (SELECT project_id, stage, sum(price_micros)::BIGINT AS estimate, count(*) FILTER (price_micros IS NULL) AS unpriced FROM p GROUP BY ALL)
            SELECT project_id, stage, estimate, actual, coalesce(unpriced, 0) AS unpriced, actual::DOUBLE / nullif(estimate::DOUBLE, 0) AS ratio FROM e FULL JOIN a USING (project_id, stage)""",
        "o38_attempts": """WITH b AS (SELECT trace_id, model, count(*) AS attempts, arg_max(status, (started_at, call_id, latency_ms)) AS last_status FROM model_calls GROUP BY ALL) SELECT attempts, last_status, count(*) AS calls FROM b GROUP BY ALL""",
        "o21_trace_runs": "SELECT project_id, count(*) AS roots, max(epoch_ms(started_at) + duration_ms) - min(epoch_ms(started_at)) AS span_ms, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM spans WHERE status <> 'running' AND parent_id IS NULL GROUP BY 1",
        "t28_claim_repeats": f"SELECT segment_id, word, count(*) AS turns FROM (SELECT segment_id, unnest(list_distinct(regexp_extract_all(lower(text), '{_W}'))) AS word FROM turns) WHERE length(word) >= 8 GROUP BY ALL HAVING count(*) > 2",
        "t29_glossary": r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '(\p{L}{9,})', 1)) AS form FROM turns) SELECT lower(form) AS term, count(*) AS uses, count(DISTINCT form) AS forms, CASE WHEN count(DISTINCT form) = 1 THEN min(form) END AS preferred FROM t GROUP BY 1 HAVING count(*) >= 2""",
    }


SQL = _sql()
