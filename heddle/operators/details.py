"""Single steps that larger queries share, as queries of their own: folding, keys, flags, reports and stored tables.

``SQL`` holds the same rules for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.functions.columns import fold_for_match, fold_label, half_even, jaccard, share, token_estimate, word_set
from heddle.operators.documents import by_doc, heading_runs, judged, quality_features
from heddle.operators.drafts import violations
from heddle.operators.evidence import word_list
from heddle.operators.reviews import error_class, grounded, script_turns
from heddle.operators.structure import block_kind, pathed
from heddle.sources import io
from heddle.sources.store import fresh_path
from heddle.sources.views import blocks, cells, evidence, model_calls, prices, product_events, real, table, turns


def b11_merged_neighbours(spark, sf_dir, small: int = 10):
    """A small block joins the one before it under the same heading, if neither is a heading: what is left of each run."""
    b = heading_runs(spark, sf_dir).withColumn("tokens", token_estimate(F.col("text")))
    w = Window.partitionBy("doc_id", "run").orderBy("idx")
    joins = ~F.col("is_heading") & (F.col("tokens") < small) & ~F.coalesce(F.lag("is_heading").over(w), F.lit(True))
    return b.withColumn("joins", joins).groupBy("doc_id").agg(F.count_if(~F.col("joins")).alias("blocks"), F.count_if("joins").alias("merged"), F.sum("tokens").alias("tokens"))


def b17_identity_texts(spark, sf_dir):
    folded = blocks(spark, sf_dir).select("doc_id", fold_for_match(F.col("text")).alias("t")).distinct()
    return folded.groupBy("doc_id").agg(F.count("t").alias("texts"), F.md5(F.max("t").cast("binary")).alias("greatest_md5"))


def b23_canonical_hashes(spark, sf_dir):
    """Hash of a row as JSON with sorted keys."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.to_json(F.struct("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))).cast("binary"), 256).alias("hash"))


def b30_detector_agreement(spark, sf_dir):
    """Share of blocks that both detectors give the same chapter number."""
    p = pathed(spark, sf_dir)
    any_run, top_run = F.sum(F.col("is_heading").cast("int")).over(by_doc()), F.sum((F.coalesce("level", F.lit(0)) == 1).cast("int")).over(by_doc())
    return p.withColumns({"a": any_run, "b": top_run}).groupBy("doc_id").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("same")).withColumn("agree", F.col("same") >= 0.8)


def b33_level_runs(spark, sf_dir):
    """Islands of equal headings of level 1."""
    change = F.when(F.coalesce("h1", F.lit("")) != F.coalesce(F.lag("h1").over(by_doc()), F.lit("")), 1).otherwise(0)
    p = pathed(spark, sf_dir).withColumn("change", change).withColumn("island", F.sum("change").over(by_doc()))
    return p.groupBy("doc_id", "island").agg(F.count("*").alias("blocks"), F.min("idx").alias("first_idx"))


def b50_final_sections(spark, sf_dir):
    """Sections of a document with their scope: tokens, pages and kinds of blocks."""
    r = heading_runs(spark, sf_dir).withColumn("kind", block_kind())
    return r.groupBy("doc_id", "run").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.countDistinct("page").alias("pages"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def q02_duplicate_ratio(spark, sf_dir):
    return quality_features(spark, sf_dir).select("doc_id", "duplicate_ratio")


def q03_corruption_ratio(spark, sf_dir):
    return quality_features(spark, sf_dir).select("doc_id", "corruption_ratio")


def q06_reading_order(spark, sf_dir):
    """Share of evidence whose page lies before that of the item before it; needs eight items."""
    back = F.when(F.col("page_start") < F.lag("page_end").over(by_doc()), 1.0).otherwise(0.0)
    by = evidence(spark, sf_dir).withColumn("back", back).groupBy("doc_id").agg(F.sum("back").alias("backs"), F.count("*").alias("n"))
    return by.select("doc_id", F.when(F.col("n") >= 8, F.col("backs") / (F.col("n") - 1)).otherwise(0.0).alias("regression"))


def q09_verdicts(spark, sf_dir):
    return judged(quality_features(spark, sf_dir)).groupBy("source", "verdict").agg(F.count("*").alias("documents"))


def q12_page_coverage(spark, sf_dir):
    """Pages that valid evidence names over the pages of the document."""
    e = evidence(spark, sf_dir).where("page_end >= page_start").groupBy("doc_id").agg(F.countDistinct("page_start").alias("located"))
    b = blocks(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("pages"))
    return b.join(e, "doc_id", "left").select("doc_id", share(F.coalesce("located", F.lit(0)), F.col("pages")).alias("coverage"))


def q16_canonical_texts(spark, sf_dir):
    """Texts without control characters and soft hyphens, with how many there were."""
    t = F.coalesce("text", F.lit(""))
    odd = "[\x00-\x08\x0e-\x1f\x7f­﻿]"
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit(odd)).alias("dropped"), F.md5(F.regexp_replace(t, odd, "").cast("binary")).alias("text_md5"))


def q25_planned_tokens(spark, sf_dir):
    """Planned and kept tokens of each customer's orders, with the largest loss of one order."""
    s = script_turns(spark, sf_dir).groupBy("segment").agg(F.sum("words").alias("planned"), F.sum(F.when(F.col("flag") != "R", F.col("words")).otherwise(0)).alias("kept"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment"), (F.col("o_custkey") % 50).alias("project"))
    return s.join(o, "segment").groupBy("project").agg(F.sum("planned").alias("planned"), F.sum("kept").alias("kept"), F.max(F.col("planned") - F.col("kept")).alias("largest_loss"))


#: Letters that only one of the tables' languages has.
OWN_LETTERS = {"de": "äöß", "fr": "çèêàùâîûëïœ", "es": "ñáíóú¿¡"}


def q31_identifiable(spark, sf_dir, least: float = 0.8):
    """Texts of four fifths Latin letters or more by the language whose own letters they have most of; none where two have as many, or where
    there are none, as in English."""
    t = F.coalesce("text", F.lit(""))
    latin = share(F.length(F.regexp_replace(t, "[^A-Za-zÀ-ɏ]", "")), F.length(F.regexp_replace(t, r"[ \n]", "")))
    rows = table(spark, sf_dir, "documents").select("doc_id", latin.alias("latin"), *(F.length(F.regexp_replace(F.lower(t), f"[^{letters}]", "")).alias(lang) for lang, letters in OWN_LETTERS.items()))
    most = F.greatest(*OWN_LETTERS)
    leaders = F.filter(F.array(*(F.when((F.col(lang) == most) & (most > 0), F.lit(lang)) for lang in OWN_LETTERS)), lambda x: x.isNotNull())
    told = F.when((F.col("latin") >= least) & (F.size(leaders) == 1), F.get(leaders, F.lit(0)))
    return rows.select("doc_id", told.alias("told"), most.alias("own_letters"))


def q36_fixture_report(spark, sf_dir):
    """Failed checks of each document together: size, language, locators."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"), "lang")
    e = evidence(spark, sf_dir).groupBy("doc_id").agg(F.avg((F.col("page_end") >= F.col("page_start")).cast("double")).alias("located"))
    j = d.join(e, "doc_id", "left")
    return violations(j, {"too_small": F.col("n") < 400, "no_language": F.col("lang").isNull(), "no_evidence": F.col("located").isNull(), "unlocated": F.col("located") < 0.95})


def q37_scope_markers(spark, sf_dir):
    """Documents that hold a start marker before an end marker: the first and the last 20 characters of their first and last block."""
    b = blocks(spark, sf_dir).groupBy("doc_id").agg(F.min_by("text", "idx").alias("first"), F.max_by("text", "idx").alias("last"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(b, "doc_id")
    a, z = F.instr("text", F.substring("first", 1, 20)), F.instr("text", F.substring("last", 1, 20))
    return d.select("doc_id", ((a > 0) & (z > 0) & (a <= z)).alias("in_scope"))


def g15_folded_labels(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("chapter").agg(F.countDistinct(fold_label(F.col("label"))).alias("labels"), F.min(fold_label(F.col("label"))).alias("least"))


def g20_cell_budgets(spark, sf_dir):
    n = cells(spark, sf_dir).groupBy("chapter").agg(F.countDistinct("kind").alias("sections"))
    return n.withColumn("budget", F.least(F.lit(40), F.greatest(F.lit(6), F.ceil(F.col("sections") * 1.5))))


def g21_edge_budgets(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("chapter").agg(F.count("*").alias("cells"), F.least(F.count("*") * 2, F.lit(60)).alias("edges"))


def g36_label_tokens(spark, sf_dir):
    return cells(spark, sf_dir).select("cell", F.array_join(F.array_sort(word_set(fold_label(F.col("label")))), ",").alias("tokens"))


def t05_opening_similarity(spark, sf_dir):
    """Set similarity of each turn's words with those of the turn before it; 0 where either has none."""
    w = Window.partitionBy("segment_id").orderBy("position")
    t = turns(spark, sf_dir).withColumn("w", F.array_distinct(word_list(F.col("text")))).withColumn("before", F.lag("w").over(w)).where("before is not null")
    return t.groupBy("segment_id").agg(F.avg(jaccard(F.col("w"), F.col("before"))).alias("similarity"), F.count("*").alias("pairs"))


def t09_known_forms(spark, sf_dir):
    """Forms (words of eight letters or more) that a glossary of each segment would hold."""
    return turns(spark, sf_dir).select("segment_id", F.explode(word_list(F.col("text"))).alias("form")).where(F.length("form") >= 8).groupBy("segment_id").agg(F.countDistinct("form").alias("forms"), F.min("form").alias("least"))


def t42_error_kinds(spark, sf_dir):
    return model_calls(spark, sf_dir).withColumn("class", error_class()).where("class is not null").groupBy("project_id", "class").agg(F.count("*").alias("errors"), F.countDistinct("trace_id").alias("traces"))


def t48_delays(spark, sf_dir):
    """Waiting before each further attempt of a trace, twice the one before, ten minutes at most."""
    n = F.row_number().over(Window.partitionBy("trace_id").orderBy("call_id"))
    c = model_calls(spark, sf_dir).where("status = 'failed'").withColumn("n", n)
    return c.groupBy("project_id").agg(F.sum(F.least(F.lit(600.0), F.lit(2.0) * F.pow(F.lit(2.0), F.col("n") - 1))).alias("seconds"), F.max("n").alias("attempts"))


def t52_preferred_forms(spark, sf_dir):
    """For each language the commonest form of six letters: in Latin letters if there is one, else any."""
    w = table(spark, sf_dir, "documents").where("lang is not null").select("lang", F.explode(word_list(F.col("text"))).alias("form")).where(F.length("form") == 6)
    n = w.groupBy("lang", "form").agg(F.count("*").alias("n")).withColumn("latin", F.col("form").rlike("^[a-z]+$"))
    return n.groupBy("lang").agg(F.min_by("form", F.struct((~F.col("latin")).alias("o"), (-F.col("n")).alias("c"), "form")).alias("form"), F.count("*").alias("forms"))


def t55_linked_turns(spark, sf_dir):
    return grounded(spark, sf_dir).groupBy("flag").agg(F.count("*").alias("turns"), F.count_if("linked").alias("linked"), F.count_if("known").alias("known"))


def o18_metric_deltas(spark, sf_dir):
    """Before, after, difference and percent of each stage's tokens in the first and the second half of the runs; percent of 0 is null."""
    c = model_calls(spark, sf_dir).withColumn("n", F.substring("run_id", 2, 9).cast("int"))
    by = c.groupBy("stage").agg(F.sum(F.when(F.col("n") < 100, F.col("input_tokens"))).alias("before"), F.sum(F.when(F.col("n") >= 100, F.col("input_tokens"))).alias("after"))
    change = F.col("after") - F.col("before")
    return by.select("stage", "before", "after", change.alias("absolute"), (100.0 * share(change, F.col("before"))).alias("percent"))


def o19_key_deltas(spark, sf_dir):
    """Differences over all models that either of two projects uses; a model that one lacks counts 0 there."""
    c = model_calls(spark, sf_dir).where("project_id in ('p3', 'p4')")
    n = lambda p: F.count_if(F.col("project_id") == p)
    return c.groupBy("model").agg((n("p4") - n("p3")).alias("delta"))


def o37_hit_rates(spark, sf_dir):
    e = product_events(spark, sf_dir).where("not is_synthetic").groupBy("name").agg(F.count_if(F.col("k") % 4 == 0).alias("hits"), F.count_if(F.col("k") % 4 == 1).alias("misses"))
    return e.select("name", F.coalesce(share(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)).alias("hit_rate"))


def o46_elapsed(spark, sf_dir):
    """Milliseconds from a project's first to its last event."""
    return real(product_events(spark, sf_dir)).groupBy("project_id").agg((F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))).alias("elapsed_ms"))


def c01_prices_in_force(spark, sf_dir):
    """Each price with the day from which the next one of its model holds."""
    until = F.lead("effective_from").over(Window.partitionBy("model").orderBy("effective_from"))
    return prices(spark, sf_dir).select("model", F.unix_millis("effective_from").alias("from_ms"), F.unix_millis(until).alias("until_ms"), "per_call")


def c03_token_costs(spark, sf_dir):
    """Costs of tokens at one rate, rounded half to even; a missing rate costs nothing."""
    rate = F.when(F.col("stage") != "N", F.lit(1500))
    cost = F.coalesce(half_even(F.col("input_tokens") * rate / 1_000_000), F.lit(0)).cast("long")
    return model_calls(spark, sf_dir).groupBy("stage").agg(F.sum(cost).alias("cost"), F.count("*").alias("calls"))


def e62_lifted_items(spark, sf_dir):
    """Old items (strings) with ids and locators injected."""
    old = evidence(spark, sf_dir).groupBy(F.concat_ws("-", "doc_id", "page").alias("block_id"), "page").agg(F.array_sort(F.collect_set("excerpt")).alias("items"))
    up = io.upgraded_evidence(old.select("block_id", "items"), old.select("block_id", F.col("page").cast("int").alias("page_start")))
    return up.groupBy("block_id").agg(F.count("*").alias("items"), F.countDistinct("evidence_id").alias("ids"), F.max("page_start").alias("page"))


def e73_located_claims(spark, sf_dir):
    """Claims with the id and the locator of their block."""
    b = blocks(spark, sf_dir).select("doc_id", "idx", F.col("page").alias("block_page"), "is_heading")
    e = evidence(spark, sf_dir).join(b, ["doc_id", "idx"])
    return e.groupBy("doc_id", "block_page").agg(F.count("*").alias("claims"), F.count_if("is_heading").alias("from_headings"))


def e74_extraction_units(spark, sf_dir):
    """Planned units (pages with three claims or more) first, what is left one by one."""
    p = evidence(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    return p.groupBy("doc_id").agg(F.count_if(F.col("n") >= 3).alias("units"), F.sum(F.when(F.col("n") < 3, F.col("n")).otherwise(0)).alias("single"))


def e76_capped_plans(spark, sf_dir, budget: int = 1500):
    return blocks(spark, sf_dir).groupBy("doc_id").agg(F.sum(token_estimate(F.col("text"))).alias("tokens")).withColumn("capped", F.col("tokens") > budget)


def e86_flagged_evidence(spark, sf_dir):
    """Claims with an item of no confidence, and all their items' ids."""
    e = evidence(spark, sf_dir).groupBy("doc_id", "claim").agg(F.min("confidence").alias("least"), F.array_join(F.array_sort(F.collect_set("evidence_id")), ",").alias("ids")).where("least = 0")
    return e.groupBy("doc_id").agg(F.count("*").alias("claims"), F.min("ids").alias("first_ids"))


def x12_daily_metrics(spark, sf_dir):
    """Rows of the daily metric table with its key (metric, day, dimension), written and read back."""
    e = real(product_events(spark, sf_dir)).groupBy(F.col("name").alias("metric_key"), "day").agg(F.count("*").alias("value"))
    path = fresh_path(spark)
    for _ in range(2):  # the second write replaces the first
        e.write.mode("overwrite").partitionBy("metric_key").parquet(path)
    return spark.read.parquet(path).groupBy("metric_key").agg(F.count("*").alias("days"), F.sum("value").alias("events"))


def x15_scanned_lines(spark, sf_dir):
    """JSON lines scanned with blank ones between them."""
    path = fresh_path(spark)
    d = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang")).alias("value"))
    d.unionByName(d.select(F.lit("  ").alias("value"))).write.text(path)
    good, bad = io.read_jsonl(spark, path, "doc_id long, lang string")
    return good.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("doc_id").alias("id_sum"))


def x18_decoded_texts(spark, sf_dir):
    """Texts written in UTF-16 and decoded again."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-16").alias("raw"))
    path = fresh_path(spark)
    d.write.parquet(path)
    text = F.regexp_replace(F.decode("raw", "UTF-16"), "^﻿", "")
    return spark.read.parquet(path).select("doc_id", F.md5(text.cast("binary")).alias("text_md5"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] in "bqgtocex" and name[1:3].isdigit()}


def _sql() -> dict[str, str]:
    from heddle.operators import reviews, structure
    from heddle.plans.document_sql import SQL as documents
    from heddle.plans.document_sql import fold

    words, tok, runs, paths, kind = structure.WORDS, structure.TOKENS, structure._RUNS, structure._PATHS, structure.KIND
    q01 = documents["q01_parse_quality"]
    label = fold_label_sql
    return {
        "b11_merged_neighbours": f"""WITH {runs}, j AS (SELECT doc_id, {tok} AS tokens, NOT is_heading AND {tok} < 10 AND NOT coalesce(lag(is_heading) OVER (PARTITION BY doc_id, run ORDER BY idx), true) AS joins FROM r)
            SELECT doc_id, count(*) FILTER (NOT joins) AS blocks, count(*) FILTER (joins) AS merged, sum(tokens)::BIGINT AS tokens FROM j GROUP BY 1""",
        "b17_identity_texts": f"WITH f AS (SELECT doc_id, {fold('text')} AS t FROM blocks) SELECT doc_id, count(DISTINCT t) AS texts, md5(max(t)) AS greatest_md5 FROM f GROUP BY 1",
        "b23_canonical_hashes": """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || coalesce(lang, '') || '","source":"' || coalesce(source, '') || '"}') AS hash FROM documents""",
        "b30_detector_agreement": f"""WITH {paths}, s AS (SELECT doc_id, sum(is_heading::INT) OVER w AS a, sum((coalesce(level, 0) = 1)::INT) OVER w AS b FROM pt WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
            SELECT doc_id, avg((a = b)::INT) AS same, avg((a = b)::INT) >= 0.8 AS agree FROM s GROUP BY 1""",
        "b33_level_runs": f"""WITH {paths}, c AS (SELECT *, CASE WHEN coalesce(h1, '') <> coalesce(lag(h1) OVER (PARTITION BY doc_id ORDER BY idx), '') THEN 1 ELSE 0 END AS change FROM pt),
            i AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS island FROM c) SELECT doc_id, island, count(*) AS blocks, min(idx) AS first_idx FROM i GROUP BY 1, 2""",
        "b50_final_sections": f"WITH {runs}, k AS (SELECT *, {kind} AS kind FROM r) SELECT doc_id, run, sum({tok})::BIGINT AS tokens, count(DISTINCT page) AS pages, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM k GROUP BY 1, 2",
        "q02_duplicate_ratio": f"SELECT doc_id, duplicate_ratio FROM ({q01})",
        "q03_corruption_ratio": f"SELECT doc_id, corruption_ratio FROM ({q01})",
        "q06_reading_order": """WITH b AS (SELECT doc_id, (page_start < lag(page_end) OVER (PARTITION BY doc_id ORDER BY idx))::INT AS back FROM evidence) SELECT doc_id, CASE WHEN count(*) >= 8 THEN coalesce(sum(back), 0)::DOUBLE / (count(*) - 1) ELSE 0 END::DOUBLE AS regression FROM b GROUP BY 1""",
        "q09_verdicts": f"SELECT source, verdict, count(*) AS documents FROM ({q01}) JOIN documents USING (doc_id) GROUP BY ALL",
        "q12_page_coverage": """WITH e AS (SELECT doc_id, count(DISTINCT page_start) AS n FROM evidence WHERE page_end >= page_start GROUP BY 1), b AS (SELECT doc_id, max(page) AS p FROM blocks GROUP BY 1) SELECT doc_id, coalesce(n, 0)::DOUBLE / p AS coverage FROM b LEFT JOIN e USING (doc_id)""",
        "q16_canonical_texts": r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x00-\x08\x0e-\x1f\x7f\x{00ad}\x{feff}]'))::INT AS dropped, md5(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0e-\x1f\x7f\x{00ad}\x{feff}]', '', 'g')) AS text_md5 FROM documents""",
        "q25_planned_tokens": f"""WITH {reviews._S}, g AS (SELECT segment, sum(words)::BIGINT AS planned, coalesce(sum(words) FILTER (flag <> 'R'), 0)::BIGINT AS kept FROM s GROUP BY 1)
            SELECT o_custkey % 50 AS project, sum(planned)::BIGINT AS planned, sum(kept)::BIGINT AS kept, max(planned - kept) AS largest_loss FROM g JOIN orders ON o_orderkey = segment GROUP BY 1""",
        "q31_identifiable": r"""WITH c AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ɏ]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(coalesce(text, ''), '[ \n]', '', 'g')), 0) AS latin, {counts} FROM documents)
            SELECT doc_id, CASE WHEN latin >= 0.8 AND greatest({langs}) > 0 AND {ties} = 1 THEN {pick} END AS told, greatest({langs})::INT AS own_letters FROM c""".replace("{counts}", ", ".join(f"length(regexp_replace(lower(coalesce(text, '')), '[^{letters}]', '', 'g')) AS {lang}" for lang, letters in OWN_LETTERS.items()))
            .replace("{langs}", ", ".join(OWN_LETTERS)).replace("{ties}", " + ".join(f"({lang} = greatest({', '.join(OWN_LETTERS)}))::INT" for lang in OWN_LETTERS)).replace("{pick}", "CASE " + " ".join(f"WHEN {lang} = greatest({', '.join(OWN_LETTERS)}) THEN '{lang}'" for lang in OWN_LETTERS) + " END"),
        "q36_fixture_report": "WITH e AS (SELECT doc_id, avg((page_end >= page_start)::INT) AS located FROM evidence GROUP BY 1), j AS (SELECT coalesce(n_chars, 0) AS n, lang, located FROM documents LEFT JOIN e USING (doc_id)) "
        + structure.kinds("SELECT * FROM j", {"too_small": "n < 400", "no_language": "lang IS NULL", "no_evidence": "located IS NULL", "unlocated": "located < 0.95"}),
        "q37_scope_markers": """WITH b AS (SELECT doc_id, arg_min(text, idx) AS f, arg_max(text, idx) AS l FROM blocks GROUP BY 1), m AS (SELECT doc_id, strpos(text, substring(f, 1, 20)) AS a, strpos(text, substring(l, 1, 20)) AS z FROM documents JOIN b USING (doc_id))
            SELECT doc_id, a > 0 AND z > 0 AND a <= z AS in_scope FROM m""",
        "g15_folded_labels": f"WITH f AS (SELECT chapter, {label('label')} AS l FROM cells) SELECT chapter, count(DISTINCT l) AS labels, min(l) AS least FROM f GROUP BY 1",
        "g20_cell_budgets": "SELECT chapter, count(DISTINCT kind) AS sections, least(40, greatest(6, ceil(count(DISTINCT kind) * 1.5)))::BIGINT AS budget FROM cells GROUP BY 1",
        "g21_edge_budgets": "SELECT chapter, count(*) AS cells, least(2 * count(*), 60) AS edges FROM cells GROUP BY 1",
        "g36_label_tokens": f"SELECT cell, array_to_string(list_sort(list_distinct(list_filter(string_split({label('label')}, ' '), lambda w: w <> ''))), ',') AS tokens FROM cells",
        "t05_opening_similarity": f"""WITH t AS (SELECT segment_id, position, list_distinct({words.format(x='text')}) AS w FROM turns), p AS (SELECT segment_id, w, lag(w) OVER (PARTITION BY segment_id ORDER BY position) AS b FROM t)
            SELECT segment_id, avg(CASE WHEN len(w) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(w, b))::DOUBLE / (len(w) + len(b) - len(list_intersect(w, b))) END) AS similarity, count(*) AS pairs FROM p WHERE b IS NOT NULL GROUP BY 1""",
        "t09_known_forms": f"WITH w AS (SELECT segment_id, unnest({words.format(x='text')}) AS form FROM turns) SELECT segment_id, count(DISTINCT form) AS forms, min(form) AS least FROM w WHERE length(form) >= 8 GROUP BY 1",
        "t42_error_kinds": f"SELECT project_id, {reviews._CLASS} AS class, count(*) AS errors, count(DISTINCT trace_id) AS traces FROM model_calls WHERE status <> 'succeeded' GROUP BY ALL",
        "t48_delays": """WITH c AS (SELECT project_id, row_number() OVER (PARTITION BY trace_id ORDER BY call_id) AS n FROM model_calls WHERE status = 'failed') SELECT project_id, sum(least(600.0, 2.0 * 2.0 ** (n - 1)))::DOUBLE AS seconds, max(n)::INT AS attempts FROM c GROUP BY 1""",
        "t52_preferred_forms": f"""WITH w AS (SELECT lang, unnest({words.format(x="coalesce(text, '')")}) AS form FROM documents WHERE lang IS NOT NULL), n AS (SELECT lang, form, count(*) AS n FROM w WHERE length(form) = 6 GROUP BY 1, 2)
            SELECT lang, first(form ORDER BY NOT regexp_matches(form, '^[a-z]+$'), n DESC, form) AS form, count(*) AS forms FROM n GROUP BY 1""",
        "t55_linked_turns": f"WITH {reviews._G} SELECT flag, count(*) AS turns, count(*) FILTER (linked) AS linked, count(*) FILTER (known) AS known FROM g GROUP BY 1",
        "o18_metric_deltas": """WITH b AS (SELECT stage, sum(input_tokens) FILTER (substring(run_id, 2)::INT < 100)::BIGINT AS before, sum(input_tokens) FILTER (substring(run_id, 2)::INT >= 100)::BIGINT AS after FROM model_calls GROUP BY 1)
            SELECT stage, before, after, after - before AS absolute, 100.0 * (after - before)::DOUBLE / nullif(before, 0) AS percent FROM b""".replace("AS absolute", 'AS "absolute"'),
        "o19_key_deltas": "SELECT model, count(*) FILTER (project_id = 'p4') - count(*) FILTER (project_id = 'p3') AS delta FROM model_calls WHERE project_id IN ('p3', 'p4') GROUP BY 1",
        "o37_hit_rates": "SELECT name, coalesce(count(*) FILTER (k % 4 = 0)::DOUBLE / nullif(count(*) FILTER (k % 4 <= 1), 0), 0) AS hit_rate FROM core_events WHERE NOT is_synthetic GROUP BY 1",
        "o46_elapsed": "SELECT project_id, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS elapsed_ms FROM core GROUP BY 1",
        "c01_prices_in_force": "SELECT model, epoch_ms(effective_from) AS from_ms, epoch_ms(lead(effective_from) OVER (PARTITION BY model ORDER BY effective_from)) AS until_ms, per_call FROM prices",
        "c03_token_costs": "SELECT stage, sum(CASE WHEN stage <> 'N' THEN round_even(input_tokens * 1500 / 1000000, 0) ELSE 0 END)::BIGINT AS cost, count(*) AS calls FROM model_calls GROUP BY 1",
        "e62_lifted_items": "SELECT doc_id || '-' || page AS block_id, count(DISTINCT excerpt) AS items, count(DISTINCT excerpt) AS ids, page FROM evidence GROUP BY doc_id, page",
        "e73_located_claims": "SELECT e.doc_id, b.page AS block_page, count(*) AS claims, count(*) FILTER (b.is_heading) AS from_headings FROM evidence e JOIN blocks b ON b.doc_id = e.doc_id AND b.idx = e.idx GROUP BY 1, 2",
        "e74_extraction_units": "WITH p AS (SELECT doc_id, page, count(*) AS n FROM evidence GROUP BY 1, 2) SELECT doc_id, count(*) FILTER (n >= 3) AS units, coalesce(sum(n) FILTER (n < 3), 0)::BIGINT AS single FROM p GROUP BY 1",
        "e76_capped_plans": f"SELECT doc_id, sum({tok})::BIGINT AS tokens, sum({tok}) > 1500 AS capped FROM blocks GROUP BY 1",
        "e86_flagged_evidence": """WITH c AS (SELECT doc_id, claim, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS ids FROM evidence GROUP BY 1, 2 HAVING min(confidence) = 0) SELECT doc_id, count(*) AS claims, min(ids) AS first_ids FROM c GROUP BY 1""",
        "x12_daily_metrics": "WITH e AS (SELECT name AS metric_key, day, count(*) AS v FROM core GROUP BY 1, 2) SELECT metric_key, count(*) AS days, sum(v)::BIGINT AS events FROM e GROUP BY 1",
        "x15_scanned_lines": "SELECT lang, count(*) AS rows, sum(doc_id)::BIGINT AS id_sum FROM documents GROUP BY 1",
        "x18_decoded_texts": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    }


def fold_label_sql(x: str) -> str:
    """Labels of the tables are ASCII: lower case, marks to spaces, spaces collapsed."""
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_ ]+', ' ', 'g'), ' +', ' ', 'g'))"


SQL = _sql()
