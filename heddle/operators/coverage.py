"""Coverage views, costs before a run, parse and fixture checks, and reads of stored artifacts.

``SQL`` holds the same rules for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import collapse, half_even, share, token_estimate
from heddle.operators.documents import judged, quality_features
from heddle.operators.evidence import word_list
from heddle.operators.reviews import script_turns
from heddle.sources import io
from heddle.sources.store import fresh_path
from heddle.sources.views import blocks, cells, evidence, model_calls, prices, product_events, table


def levels(spark, sf_dir) -> DataFrame:
    """Each cell with whether its claims were extracted, planned (returned lines) and spoken (accepted ones)."""
    s = script_turns(spark, sf_dir).groupBy(F.col("claim").alias("cell")).agg(F.count("*").alias("claims"), F.bool_or(F.col("flag") == "R").alias("planned"), F.bool_or(F.col("flag") == "A").alias("spoken"))
    return cells(spark, sf_dir).join(s, "cell", "left")


def e49_cell_coverage(spark, sf_dir):
    by = levels(spark, sf_dir).groupBy("chapter")
    return by.agg(F.count("*").alias("cells"), F.count("claims").alias("extracted"), F.count_if("planned").alias("planned"), F.count_if("spoken").alias("spoken"))


def e50_coverage_report(spark, sf_dir):
    """Shares of each chapter that were extracted and spoken, and what was left out for which reason."""
    c = levels(spark, sf_dir)
    return c.groupBy("chapter").agg(
        share(F.count("claims"), F.count("*")).alias("coverage"), share(F.count_if("spoken"), F.count("*")).alias("spoken_share"),
        F.count_if(F.col("claims").isNull()).alias("no_claim"), F.count_if(F.col("claims").isNotNull() & ~F.col("spoken")).alias("not_spoken"),
    )


def e51_gap_reasons(spark, sf_dir, least: float = 3.0):
    """Why cells are not spoken: thin extraction where the chapter has few claims a cell, no claim, else excised."""
    c = levels(spark, sf_dir).withColumn("mean", F.avg(F.coalesce("claims", F.lit(0))).over(Window.partitionBy("chapter")))
    reason = F.when(F.col("claims").isNull() & (F.col("mean") < least), "thin_extraction").when(F.col("claims").isNull(), "no_claim").otherwise("excised")
    return c.where("spoken is null or not spoken").groupBy("chapter", reason.alias("reason")).agg(F.count("*").alias("cells"))


def e52_flagged_claims(spark, sf_dir):
    """Claims with a contradicted item (confidence 0) and whether the plan (even pages) uses them."""
    c = evidence(spark, sf_dir).groupBy("doc_id", "claim").agg(F.min("confidence").alias("least"), F.bool_or(F.col("page") % 2 == 0).alias("used")).where("least = 0")
    return c.groupBy("doc_id").agg(F.count("*").alias("flagged"), F.count_if(~F.col("used")).alias("unused"))


def e53_repeated_ids(spark, sf_dir):
    """Evidence ids that several documents of a source have: errors when sources are united."""
    ids = evidence(spark, sf_dir).groupBy("source", "evidence_id").agg(F.countDistinct("doc_id").alias("docs"))
    return ids.groupBy("source").agg(F.count("*").alias("ids"), F.count_if(F.col("docs") > 1).alias("repeated"))


def e55_evidence_rows(spark, sf_dir):
    """The row of each evidence id: one that is usable (a good excerpt) before others, then the first."""
    usable = F.instr("text", F.col("excerpt")) > 0
    e = evidence(spark, sf_dir).groupBy("source", "evidence_id").agg(F.min_by(F.struct("doc_id", "idx"), F.struct((~usable).alias("removed"), "doc_id", "idx")).alias("m"), F.count("*").alias("rows"))
    return e.select("source", "evidence_id", "m.doc_id", "m.idx", "rows")


def e56_turn_evidence(spark, sf_dir):
    """Evidence of a turn's claim that the turn itself cites."""
    s = script_turns(spark, sf_dir)
    all_of = s.groupBy("claim").agg(F.countDistinct("evidence").alias("known"))
    by = s.groupBy("segment", "claim").agg(F.countDistinct("evidence").alias("cited"))
    return by.join(all_of, "claim").groupBy("segment").agg(F.sum("cited").alias("cited"), F.sum("known").alias("known"))


def e57_nested_views(spark, sf_dir):
    """Segment, turns, claims and evidence as one nested value each."""
    turn = F.struct("turn", "claim", "evidence")
    nested = F.array_sort(F.collect_list(turn))
    text = F.array_join(F.transform(nested, lambda t: F.concat_ws(":", t["turn"].cast("string"), t["claim"].cast("string"), t["evidence"].cast("string"))), ";")
    return script_turns(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("turns"), F.md5(text.cast("binary")).alias("view_md5"))


def e58_first_usable(spark, sf_dir):
    usable = F.instr("text", F.col("excerpt")) > 0
    return evidence(spark, sf_dir).where(usable).groupBy("doc_id", "claim_type").agg(F.min("idx").alias("idx"))


def e59_locator_texts(spark, sf_dir):
    text = F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("p. "), "page_start")).when(F.col("page_end") > F.col("page_start"), F.concat(F.lit("pp. "), "page_start", F.lit("-"), "page_end")).otherwise("unlocated")
    return evidence(spark, sf_dir).groupBy("source", text.alias("locator")).agg(F.count("*").alias("n"))


def e63_flagged_in_plan(spark, sf_dir):
    """Flagged claims of the plan, in the order in which they are first seen."""
    c = evidence(spark, sf_dir).groupBy("doc_id", "claim").agg(F.min("confidence").alias("least"), F.min(F.when(F.col("page") % 2 == 0, F.col("idx"))).alias("first")).where("least = 0 and first is not null")
    return c.select("doc_id", F.md5(F.col("claim").cast("binary")).alias("claim_md5"), F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("place"))


def e64_raised_levers(spark, sf_dir):
    """Levers raised by half and held under their ceilings."""
    o = table(spark, sf_dir, "orders").withColumn("tier", F.col("o_orderkey") % 4 + 1)
    return o.groupBy("tier").agg(F.count("*").alias("plans")).select("tier", "plans", F.least(F.lit(1.0), F.col("tier") * 0.25 * 1.5).alias("coverage"), F.least(F.lit(6), F.ceil(F.col("tier") * 1.5)).alias("claims"))


def e66_required_blocks(spark, sf_dir):
    """Blocks of required sections (orders with a returned line)."""
    s = script_turns(spark, sf_dir)
    need = s.where("flag = 'R'").select("segment").distinct()
    return s.join(need, "segment", "left_semi").groupBy((F.col("segment") % 10).alias("bucket")).agg(F.countDistinct("segment", "claim").alias("blocks"))


def e67_seed_blocks(spark, sf_dir):
    """All blocks of first-tier cells and their tokens, by chapter."""
    c = cells(spark, sf_dir).where("tier = 1").select(F.col("cell").alias("claim"), "chapter")
    return script_turns(spark, sf_dir).join(c, "claim").groupBy("chapter").agg(F.count("*").alias("blocks"), F.sum("words").alias("tokens"))


def e68_core_blocks(spark, sf_dir):
    """Segments whose first cell is of tier 1 or 2."""
    first = script_turns(spark, sf_dir).groupBy("segment").agg(F.min_by("claim", F.struct("turn", "claim")).alias("cell"))
    return first.join(cells(spark, sf_dir), "cell").groupBy("chapter").agg(F.count("*").alias("segments"), F.count_if(F.col("tier") <= 2).alias("core"))


def e69_query_tokens(spark, sf_dir):
    words = F.array_distinct(F.filter(word_list(F.col("text")), lambda w: F.length(w) > 2))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(words).alias("tokens"), F.md5(F.array_join(words, ",").cast("binary")).alias("tokens_md5"))


def e70_repaired_excerpts(spark, sf_dir):
    """Excerpts that are found in their block only after case and spaces are folded, and where."""
    at = F.instr(F.lower(collapse(F.col("text"))), F.lower(collapse(F.col("excerpt"))))
    e = evidence(spark, sf_dir).where(F.length("excerpt") >= 12).withColumn("at", at)
    return e.groupBy("doc_id").agg(F.count_if(F.col("at") > 0).alias("found"), F.count_if(F.col("at") == 0).alias("lost"), F.sum("at").alias("at_sum"))


def e71_numbered_entries(spark, sf_dir):
    """Drafts whose entries are not exactly 1 to n."""
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("d"), F.max("l_linenumber").alias("m"), F.min("l_linenumber").alias("low"))
    return by.groupBy("n").agg(F.count("*").alias("drafts"), F.count_if((F.col("d") != F.col("n")) | (F.col("m") != F.col("n")) | (F.col("low") != 1)).alias("wrong"))


def e72_claim_caps(spark, sf_dir):
    """Pages over their cap of claims; examples don't count."""
    return evidence(spark, sf_dir).groupBy("doc_id", "page").agg(F.count_if(F.col("claim_type") != "example").alias("n")).groupBy("doc_id").agg(F.count_if(F.col("n") > 2).alias("over"), F.max("n").alias("most"))


def e75_extracted_coverage(spark, sf_dir):
    """Share of each extracted block's characters that its excerpt covers."""
    return evidence(spark, sf_dir).groupBy("doc_id").agg(F.avg(F.length("excerpt") / F.length("text")).alias("coverage"), F.count("*").alias("blocks"))


def e82_locators_by_block(spark, sf_dir):
    """Locators for references (the block two places on): found, or an error."""
    b = blocks(spark, sf_dir).select("doc_id", "idx", "page")
    refs = b.select("doc_id", (F.col("idx") + 2).alias("idx"))
    found = refs.join(b, ["doc_id", "idx"], "left")
    return found.groupBy("doc_id").agg(F.count("*").alias("references_"), F.count_if(F.col("page").isNull()).alias("errors"), F.max("page").alias("last_page"))


def e85_omitted_claims(spark, sf_dir):
    """Claims that the plan leaves out: rejected lines only, by reason, with their evidence."""
    by = script_turns(spark, sf_dir).groupBy("claim").agg(F.bool_and(F.col("flag") == "N").alias("never"), F.bool_and(F.col("flag") == "R").alias("returned"), F.countDistinct("evidence").alias("evidence"))
    reason = F.when(F.col("never"), "not_selected").when(F.col("returned"), "returned")
    return by.withColumn("reason", reason).where("reason is not null").select("claim", "reason", "evidence")


def e88_first_sources(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("evidence_id").agg(F.min("source").alias("first_source"), F.countDistinct("source").alias("sources"))


def e90_reason_texts(spark, sf_dir):
    """The reasons against each order, in a fixed order, joined."""
    o = table(spark, sf_dir, "orders")
    reasons = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_totalprice") < 50000, "small"), F.when(F.col("o_orderkey") % 5 == 0, "sampled")))
    return o.groupBy(F.array_join(reasons, ",").alias("reasons")).agg(F.count("*").alias("plans"))


def e91_unknown_references(spark, sf_dir):
    known = cells(spark, sf_dir).where("tier <> 3").select(F.col("cell").alias("claim"))
    return script_turns(spark, sf_dir).join(known, "claim", "left_anti").groupBy("segment").agg(F.count("*").alias("unknown"), F.min("turn").alias("first_turn"))


def c04_token_multipliers(spark, sf_dir):
    """Tokens that a run of each document will need: the map as many as the text has, cells a tenth more."""
    tokens = token_estimate(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(tokens).alias("map_tokens"), half_even(F.sum(tokens) * F.lit(1.1)).cast("long").alias("cell_tokens"))


def c06_scope_tokens(spark, sf_dir):
    """Tokens of the distinct blocks that the cells of a chapter have."""
    s = script_turns(spark, sf_dir).join(cells(spark, sf_dir).select(F.col("cell").alias("claim"), "chapter"), "claim")
    one = s.groupBy("chapter", "segment", "turn").agg(F.max("words").alias("words"))
    return one.groupBy("chapter").agg(F.count("*").alias("blocks"), F.sum("words").alias("tokens"))


def c07_calibration_points(spark, sf_dir):
    """The last point of each (project, target duration)."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("project"), (F.col("o_orderkey") % 6 * 10).alias("minutes"), "o_orderkey", "o_totalprice")
    return o.groupBy("project", "minutes").agg(F.max("o_orderkey").alias("point"), F.max_by("o_totalprice", "o_orderkey").alias("tokens"), F.count("*").alias("recorded"))


def plans(spark, sf_dir) -> DataFrame:
    """Stored (N lines) against planned blocks (others) of each order: whether extraction has to run again."""
    listed = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("l_suppkey").cast("string")))), ",")
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(listed(F.col("l_returnflag") == "N").alias("stored"), listed(F.col("l_returnflag") != "N").alias("planned"))
    return by.withColumn("again", F.when(F.col("stored") == "", "no_plan").when(F.col("stored") == F.col("planned"), "same").otherwise("changed"))


def c10_reextractions(spark, sf_dir):
    return plans(spark, sf_dir).groupBy("again").agg(F.count("*").alias("plans"))


def c11_chapter_tokens(spark, sf_dir):
    """Tokens of the chapters in scope; without a scope all count."""
    c = cells(spark, sf_dir).select(F.col("cell").alias("claim"), "chapter", (F.col("tier") <= 2).alias("in_scope"))
    s = script_turns(spark, sf_dir).join(c, "claim")
    return s.groupBy("chapter").agg(F.sum(F.when(F.col("in_scope"), F.col("words")).otherwise(0)).alias("scoped"), F.sum("words").alias("whole"))


def c12_projects_to_redo(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).alias("project"))
    return plans(spark, sf_dir).join(o, "l_orderkey").groupBy("project").agg(F.bool_or(F.col("again") == "changed").alias("redo"), F.count_if(F.col("again") == "changed").alias("changed"))


def q07_fragmentation(spark, sf_dir):
    b = blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("page").alias("pages"), F.avg(F.length("text")).alias("mean_characters")).where("pages > 1")
    return b.select("doc_id", (F.col("n") / F.col("pages")).alias("blocks_per_page"), "mean_characters")


def q08_located_pages(spark, sf_dir):
    """Pages that evidence names, ranges expanded; a range that runs backwards is its first page."""
    pages = F.explode(F.sequence("page_start", F.greatest("page_start", "page_end")))
    return evidence(spark, sf_dir).select("doc_id", pages.alias("page")).groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.max("page").alias("last_page"))


def q13_recommended(spark, sf_dir):
    """The best document of each language by safety, number of issues and shortness."""
    j = judged(quality_features(spark, sf_dir))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    key = F.struct(F.col("verdict").isin("pass", "warning").alias("safe"), (-F.col("issue_count")).alias("i"), (-F.col("n_chars")).alias("c"), (-F.col("doc_id")).alias("d"))
    return d.join(j.select("doc_id", "verdict", "issue_count"), "doc_id").groupBy("lang").agg((-F.max(key)["d"]).alias("doc_id"), F.count("*").alias("documents"))


def q15_language_sanity(spark, sf_dir):
    """Shares of Latin letters and marks of broken encodings, against the language expected."""
    t = F.coalesce("text", F.lit(""))
    latin, broken = F.length(F.regexp_replace(t, "[^A-Za-z]", "")), F.regexp_count(t, F.lit("Ã|â€|�"))
    return table(spark, sf_dir, "documents").select("doc_id", share(latin, F.length(t)).alias("latin"), broken.alias("broken"), (F.coalesce(share(latin, F.length(t)), F.lit(0.0)) >= 0.5).alias("plausible"))


def q17_locator_viability(spark, sf_dir):
    """Documents whose evidence has locators on 95 percent of items and four fifths of pages."""
    e = evidence(spark, sf_dir).groupBy("doc_id").agg(F.avg((F.col("page_end") >= F.col("page_start")).cast("double")).alias("located"), F.countDistinct("page").alias("pages"))
    b = blocks(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("last_page"))
    return e.join(b, "doc_id").select("doc_id", ((F.col("located") >= 0.95) & (F.col("pages") >= 0.8 * F.col("last_page"))).alias("viable"))


def q19_diverging_captures(spark, sf_dir):
    """Each page's raw markup against its text: whether lengths differ by over a fifth."""
    raw = F.length(F.coalesce("html", F.lit("")))
    text = F.length(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", ""))
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), text.alias("text"), (F.abs(raw - text) > 0.2 * F.greatest(raw, text)).alias("diverges"))


def q21_hosts(spark, sf_dir):
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"))


def q28_word_distances(spark, sf_dir):
    """Edit distance of each benchmark item's first 12 words to the next item's, in characters."""
    head = F.array_join(F.slice(word_list(F.regexp_replace("text", "[^ -~]", "")), 1, 12), " ")
    i = table(spark, sf_dir, "benchmark").select("item_id", head.alias("t"))
    return i.join(i.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u")), "item_id").select("item_id", F.levenshtein("t", "u").cast("long").alias("distance"))


def q30_systems(spark, sf_dir):
    """Mean latency, failures and exact answers of each system (provider)."""
    c = model_calls(spark, sf_dir).groupBy("provider").agg(F.count("*").alias("samples"), F.avg("latency_ms").alias("latency"), F.avg((F.col("status") == "succeeded").cast("double")).alias("accuracy"))
    return c


def q33_blocked_sources(spark, sf_dir):
    """Sources with an unsafe document."""
    j = judged(quality_features(spark, sf_dir))
    return j.groupBy("source").agg(F.bool_and(F.col("verdict").isin("pass", "warning")).alias("safe"), F.count_if(~F.col("verdict").isin("pass", "warning")).alias("unsafe_documents"))


def q34_bound_gates(spark, sf_dir):
    """Scripts (even orders) that are bound to the plan of the same hash: the customer's order before them."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("plan", F.md5(F.concat_ws("|", "o_orderpriority", "o_orderstatus").cast("binary")))
    s = o.withColumn("was", F.lag("plan").over(w)).where("o_orderkey % 2 = 0")
    state = F.when(F.col("was").isNull(), "no_plan").when(F.col("was") == F.col("plan"), "current").otherwise("stale")
    return s.groupBy(state.alias("state")).agg(F.count("*").alias("scripts"))


def q38_code_points(spark, sf_dir):
    """Characters in the ranges of Latin letters with marks, dashes and quotes."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit("[À-ɏ]")).alias("marked"), F.regexp_count(t, F.lit("[‐-‟]")).alias("typographic"))


def q39_plan_hashes(spark, sf_dir):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(listed.cast("binary"), 256).alias("plan_hash")).groupBy(F.substring("plan_hash", 1, 2).alias("prefix")).agg(F.count("*").alias("plans"), F.max("plan_hash").alias("greatest"))


def q41_valid_captures(spark, sf_dir):
    t = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", ((F.length(t) >= 400) & F.contains(F.coalesce("html", F.lit("")), F.lit("<p"))).alias("valid"))


def q42_source_counts(spark, sf_dir):
    return model_calls(spark, sf_dir).groupBy("run_id").agg(F.countDistinct(F.when(F.col("status") == "succeeded", F.col("provider"))).alias("succeeded"), F.countDistinct("provider").alias("selected"), F.count_if(F.col("status") == "rejected").alias("skipped"))


def p05_appended_events(spark, sf_dir):
    """Events appended as JSONL, by day and in ISO time, and read back with their declared schema."""
    e = product_events(spark, sf_dir).select(F.col("event_id").cast("string"), F.col("ts").alias("occurred_at"), "name", "user_id", "project_id", "environment", "is_synthetic")
    path = fresh_path(spark)
    for part in (0, 1):
        io.append_jsonl(e.where(F.col("event_id").cast("long") % 2 == part), path)
    good, _ = io.read_jsonl(spark, path, io.EVENT_SCHEMA)
    return good.groupBy("name").agg(F.count("*").alias("events"), F.count_if("is_synthetic").alias("synthetic"), F.max(F.unix_micros("occurred_at")).alias("latest_micros"))


def x01_stored_blocks(spark, sf_dir):
    """Blocks written by source, one source again, and scanned with their schema."""
    b = blocks(spark, sf_dir).select(F.col("idx").cast("string").alias("block_id"), F.coalesce("source", F.lit("none")).alias("source_id"), "idx", "text")
    path = fresh_path(spark)
    io.write_blocks(b, path)
    io.write_blocks(b.where("source_id = 'src1'"), path)
    return spark.read.parquet(path).groupBy("source_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"))


def x03_stored_evidence(spark, sf_dir):
    e = evidence(spark, sf_dir).select("evidence_id", F.col("source").alias("source_id"), F.col("idx").cast("string").alias("block_id"), "excerpt", "claim", "confidence")
    path = fresh_path(spark)
    io.append_jsonl(e, path)
    good, bad = io.read_jsonl(spark, path, io.EVIDENCE_SCHEMA)
    return good.groupBy("source_id").agg(F.count("*").alias("items"), F.countDistinct("evidence_id").alias("ids")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("bad"))))  # one row


def x04_upgraded_extractions(spark, sf_dir):
    """Evidence of an old schema (plain strings) lifted to items with ids and locators."""
    b = blocks(spark, sf_dir)
    old = b.groupBy(F.concat_ws("-", "doc_id", F.col("page").cast("string")).alias("block_id")).agg(F.collect_list(F.substring("text", 1, 20)).alias("items"), F.max("page").alias("page_start"))
    up = io.upgraded_evidence(old.select("block_id", "items"), old.where("page_start % 3 <> 0").select("block_id", F.col("page_start").cast("int")))
    return up.groupBy("block_id").agg(F.count("*").alias("items"), F.max("page_start").alias("page"))


def x06_ready_sources(spark, sf_dir):
    """Sources whose manifest says that they are ready: all documents labelled good."""
    m = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("q"), F.count("*").alias("documents"))
    return m.where("q >= 0.5").select("source", "documents")


def x07_block_locators(spark, sf_dir):
    return blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum("page").alias("page_sum"))


def x08_event_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"))


def x16_exports(spark, sf_dir):
    """Ledger tables exported as JSONL with their numbers of rows."""
    tables = {"calls": model_calls(spark, sf_dir).select("call_id", "status"), "prices": prices(spark, sf_dir).select("model"), "cells": cells(spark, sf_dir).select("cell")}
    path = fresh_path(spark)
    io.export_with_manifest(tables, path)
    read = None
    for name in tables:
        part = spark.read.text(f"{path}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        read = part if read is None else read.unionByName(part)
    return read


def x20_migration(spark, sf_dir):
    """Artifacts as they are, upgraded (no term where one is needed) and unfixable (no excerpt in the block)."""
    state = F.when(F.instr("text", F.col("excerpt")) == 0, "unfixable").when(F.col("term").isNull(), "upgraded").otherwise("as_is")
    return evidence(spark, sf_dir).groupBy("source", state.alias("state")).agg(F.count("*").alias("items"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] in "ecqpx" and name[1:3].isdigit()}

WS = r"[ \t\n\x0B\f\r]+"
WORDS = r"regexp_extract_all(lower({x}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ONE = "trim(regexp_replace({x}, '" + WS + "', ' ', 'g'))"
_TOK = "(CASE WHEN length({t}) = 0 THEN 0 ELSE greatest(1, ceil(length({t}) / 3.5)) END)::BIGINT"
_S = "s AS (SELECT l_orderkey AS segment, l_linenumber AS turn, l_partkey AS claim, l_suppkey AS evidence, l_returnflag AS flag, floor(l_quantity)::BIGINT AS words FROM lineitem)"
_L = _S + ", v AS (SELECT claim AS cell, count(*) AS claims, bool_or(flag = 'R') AS planned, bool_or(flag = 'A') AS spoken FROM s GROUP BY 1), lv AS (SELECT * FROM cells LEFT JOIN v USING (cell))"
_P = """pl AS (SELECT l_orderkey, coalesce(string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) FILTER (l_returnflag = 'N'), '') AS stored, coalesce(string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) FILTER (l_returnflag <> 'N'), '') AS planned
    FROM lineitem GROUP BY 1), pa AS (SELECT *, CASE WHEN stored = '' THEN 'no_plan' WHEN stored = planned THEN 'same' ELSE 'changed' END AS again FROM pl)"""

SQL = {
    "e49_cell_coverage": f"WITH {_L} SELECT chapter, count(*) AS cells, count(claims) AS extracted, count(*) FILTER (planned) AS planned, count(*) FILTER (spoken) AS spoken FROM lv GROUP BY 1",
    "e50_coverage_report": f"WITH {_L} SELECT chapter, count(claims)::DOUBLE / count(*) AS coverage, count(*) FILTER (spoken)::DOUBLE / count(*) AS spoken_share, count(*) FILTER (claims IS NULL) AS no_claim, count(*) FILTER (claims IS NOT NULL AND NOT spoken) AS not_spoken FROM lv GROUP BY 1",
    "e51_gap_reasons": f"""WITH {_L}, m AS (SELECT *, avg(coalesce(claims, 0)) OVER (PARTITION BY chapter) AS mean FROM lv) SELECT chapter, CASE WHEN claims IS NULL AND mean < 3 THEN 'thin_extraction' WHEN claims IS NULL THEN 'no_claim' ELSE 'excised' END AS reason,
        count(*) AS cells FROM m WHERE spoken IS NULL OR NOT spoken GROUP BY ALL""",
    "e52_flagged_claims": "WITH c AS (SELECT doc_id, claim, bool_or(page % 2 = 0) AS used FROM evidence GROUP BY 1, 2 HAVING min(confidence) = 0) SELECT doc_id, count(*) AS flagged, count(*) FILTER (NOT used) AS unused FROM c GROUP BY 1",
    "e53_repeated_ids": "WITH i AS (SELECT source, evidence_id, count(DISTINCT doc_id) AS d FROM evidence GROUP BY 1, 2) SELECT source, count(*) AS ids, count(*) FILTER (d > 1) AS repeated FROM i GROUP BY 1",
    "e55_evidence_rows": """SELECT source, evidence_id, doc_id, idx, count(*) OVER (PARTITION BY source, evidence_id) AS rows FROM evidence
        QUALIFY row_number() OVER (PARTITION BY source, evidence_id ORDER BY NOT contains(text, excerpt), doc_id, idx) = 1""",
    "e56_turn_evidence": f"""WITH {_S}, k AS (SELECT claim, count(DISTINCT evidence) AS known FROM s GROUP BY 1), b AS (SELECT segment, claim, count(DISTINCT evidence) AS cited FROM s GROUP BY 1, 2)
        SELECT segment, sum(cited)::BIGINT AS cited, sum(known)::BIGINT AS known FROM b JOIN k USING (claim) GROUP BY 1""",
    "e57_nested_views": f"WITH {_S} SELECT segment, count(*) AS turns, md5(string_agg(turn || ':' || claim || ':' || evidence, ';' ORDER BY turn, claim, evidence)) AS view_md5 FROM s GROUP BY 1",
    "e58_first_usable": "SELECT doc_id, claim_type, min(idx) AS idx FROM evidence WHERE contains(text, excerpt) GROUP BY 1, 2",
    "e59_locator_texts": "SELECT source, CASE WHEN page_start = page_end THEN 'p. ' || page_start WHEN page_end > page_start THEN 'pp. ' || page_start || '-' || page_end ELSE 'unlocated' END AS locator, count(*) AS n FROM evidence GROUP BY ALL",
    "e63_flagged_in_plan": """WITH c AS (SELECT doc_id, claim, min(idx) FILTER (page % 2 = 0) AS f FROM evidence GROUP BY 1, 2 HAVING min(confidence) = 0)
        SELECT doc_id, md5(claim) AS claim_md5, row_number() OVER (PARTITION BY doc_id ORDER BY f)::INT AS place FROM c WHERE f IS NOT NULL""",
    "e64_raised_levers": "SELECT tier, count(*) AS plans, least(1.0::DOUBLE, tier * 0.25 * 1.5)::DOUBLE AS coverage, least(6, ceil(tier * 1.5))::BIGINT AS claims FROM (SELECT o_orderkey % 4 + 1 AS tier FROM orders) GROUP BY 1",
    "e66_required_blocks": f"WITH {_S} SELECT segment % 10 AS bucket, count(DISTINCT (segment, claim)) AS blocks FROM s WHERE segment IN (SELECT segment FROM s WHERE flag = 'R') GROUP BY 1",
    "e67_seed_blocks": f"WITH {_S} SELECT chapter, count(*) AS blocks, sum(words)::BIGINT AS tokens FROM s JOIN cells ON cell = claim AND tier = 1 GROUP BY 1",
    "e68_core_blocks": f"WITH {_S}, f AS (SELECT segment, first(claim ORDER BY turn, claim) AS cell FROM s GROUP BY 1) SELECT chapter, count(*) AS segments, count(*) FILTER (tier <= 2) AS core FROM f JOIN cells USING (cell) GROUP BY 1",
    "e69_query_tokens": f"""WITH w AS (SELECT item_id, unnest({WORDS.format(x="text")}) AS w, generate_subscripts({WORDS.format(x="text")}, 1) AS i FROM benchmark), d AS (SELECT item_id, w, min(i) AS i FROM w WHERE length(w) > 2 GROUP BY 1, 2)
        SELECT item_id, count(*)::INT AS tokens, md5(string_agg(w, ',' ORDER BY i)) AS tokens_md5 FROM d GROUP BY 1""",
    "e70_repaired_excerpts": f"""WITH e AS (SELECT doc_id, strpos(lower({_ONE.format(x="text")}), lower({_ONE.format(x="excerpt")})) AS at_ FROM evidence WHERE length(excerpt) >= 12)
        SELECT doc_id, count(*) FILTER (at_ > 0) AS found, count(*) FILTER (at_ = 0) AS lost, sum(at_)::BIGINT AS at_sum FROM e GROUP BY 1""",
    "e71_numbered_entries": """WITH b AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, max(l_linenumber) AS m, min(l_linenumber) AS low FROM lineitem GROUP BY 1)
        SELECT n, count(*) AS drafts, count(*) FILTER (d <> n OR m <> n OR low <> 1) AS wrong FROM b GROUP BY 1""",
    "e72_claim_caps": "WITH p AS (SELECT doc_id, page, count(*) FILTER (claim_type <> 'example') AS n FROM evidence GROUP BY 1, 2) SELECT doc_id, count(*) FILTER (n > 2) AS over, max(n) AS most FROM p GROUP BY 1".replace("AS over", 'AS "over"'),
    "e75_extracted_coverage": "SELECT doc_id, avg(length(excerpt)::DOUBLE / length(text)) AS coverage, count(*) AS blocks FROM evidence GROUP BY 1",
    "e82_locators_by_block": """SELECT r.doc_id, count(*) AS references_, count(*) FILTER (b.page IS NULL) AS errors, max(b.page) AS last_page FROM blocks r LEFT JOIN blocks b ON b.doc_id = r.doc_id AND b.idx = r.idx + 2 GROUP BY 1""",
    "e85_omitted_claims": f"""WITH {_S}, b AS (SELECT claim, CASE WHEN bool_and(flag = 'N') THEN 'not_selected' WHEN bool_and(flag = 'R') THEN 'returned' END AS reason, count(DISTINCT evidence) AS evidence FROM s GROUP BY 1) SELECT * FROM b WHERE reason IS NOT NULL""",
    "e88_first_sources": "SELECT evidence_id, min(source) AS first_source, count(DISTINCT source) AS sources FROM evidence GROUP BY 1",
    "e90_reason_texts": "SELECT concat_ws(',', CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_totalprice < 50000 THEN 'small' END, CASE WHEN o_orderkey % 5 = 0 THEN 'sampled' END) AS reasons, count(*) AS plans FROM orders GROUP BY 1",
    "e91_unknown_references": f"WITH {_S} SELECT segment, count(*) AS unknown, min(turn) AS first_turn FROM s WHERE claim NOT IN (SELECT cell FROM cells WHERE tier <> 3) GROUP BY 1",
    "c04_token_multipliers": f"""WITH t AS (SELECT source, {_TOK.format(t=_ONE.format(x="coalesce(text, '')"))} AS n FROM documents) SELECT source, sum(n)::BIGINT AS map_tokens, round_even(sum(n) * 1.1::DOUBLE, 0)::BIGINT AS cell_tokens FROM t GROUP BY 1""",
    "c06_scope_tokens": f"WITH {_S}, o AS (SELECT chapter, segment, turn, max(words) AS words FROM s JOIN cells ON cell = claim GROUP BY 1, 2, 3) SELECT chapter, count(*) AS blocks, sum(words)::BIGINT AS tokens FROM o GROUP BY 1",
    "c07_calibration_points": "SELECT o_custkey % 50 AS project, o_orderkey % 6 * 10 AS minutes, max(o_orderkey) AS point, arg_max(o_totalprice, o_orderkey) AS tokens, count(*) AS recorded FROM orders GROUP BY 1, 2",
    "c10_reextractions": f"WITH {_P} SELECT again, count(*) AS plans FROM pa GROUP BY 1",
    "c11_chapter_tokens": f"WITH {_S} SELECT chapter, sum(CASE WHEN tier <= 2 THEN words ELSE 0 END)::BIGINT AS scoped, sum(words)::BIGINT AS whole FROM s JOIN cells ON cell = claim GROUP BY 1",
    "c12_projects_to_redo": f"WITH {_P} SELECT o_custkey % 50 AS project, bool_or(again = 'changed') AS redo, count(*) FILTER (again = 'changed') AS changed FROM pa JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "q07_fragmentation": "SELECT doc_id, count(*)::DOUBLE / max(page) AS blocks_per_page, avg(length(text)) AS mean_characters FROM blocks GROUP BY 1 HAVING max(page) > 1",
    "q08_located_pages": "WITH p AS (SELECT doc_id, unnest(generate_series(page_start, greatest(page_start, page_end))) AS page FROM evidence) SELECT doc_id, count(DISTINCT page) AS pages, max(page) AS last_page FROM p GROUP BY 1",
    "q15_language_sanity": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / nullif(length(t), 0)::DOUBLE AS latin, len(regexp_extract_all(t, 'Ã|â€|�'))::INT AS broken FROM t)
        SELECT doc_id, latin, broken, coalesce(latin, 0) >= 0.5 AS plausible FROM l""",
    "q17_locator_viability": """WITH e AS (SELECT doc_id, avg((page_end >= page_start)::INT) AS located, count(DISTINCT page) AS pages FROM evidence GROUP BY 1), b AS (SELECT doc_id, max(page) AS last_page FROM blocks GROUP BY 1)
        SELECT doc_id, located >= 0.95 AND pages >= 0.8 * last_page AS viable FROM e JOIN b USING (doc_id)""",
    "q19_diverging_captures": """WITH p AS (SELECT page_id, length(coalesce(html, ''))::INT AS raw, length(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'))::INT AS text FROM pages) SELECT *, abs(raw - text) > 0.2 * greatest(raw, text) AS diverges FROM p""",
    "q21_hosts": "SELECT lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "q28_word_distances": f"""WITH i AS (SELECT item_id, array_to_string(({WORDS.format(x="regexp_replace(text, '[^ -~]', '', 'g')")})[1:12], ' ') AS t FROM benchmark) SELECT a.item_id, levenshtein(a.t, b.t) AS distance FROM i a JOIN i b ON b.item_id = a.item_id + 1""",
    "q30_systems": "SELECT provider, count(*) AS samples, avg(latency_ms) AS latency, avg((status = 'succeeded')::INT) AS accuracy FROM model_calls GROUP BY 1",
    "q34_bound_gates": """WITH o AS (SELECT o_orderkey, md5(o_orderpriority || '|' || o_orderstatus) AS plan, lag(md5(o_orderpriority || '|' || o_orderstatus)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM orders)
        SELECT CASE WHEN was IS NULL THEN 'no_plan' WHEN was = plan THEN 'current' ELSE 'stale' END AS state, count(*) AS scripts FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1""",
    "q38_code_points": "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[À-ɏ]'))::INT AS marked, len(regexp_extract_all(coalesce(text, ''), '[‐-‟]'))::INT AS typographic FROM documents",
    "q39_plan_hashes": """WITH h AS (SELECT l_orderkey, sha256(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey)) AS h FROM lineitem GROUP BY 1) SELECT substring(h, 1, 2) AS prefix, count(*) AS plans, max(h) AS greatest FROM h GROUP BY 1""",
    "q41_valid_captures": "SELECT page_id, length(regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g')) >= 400 AND contains(coalesce(html, ''), '<p') AS valid FROM pages",
    "q42_source_counts": "SELECT run_id, count(DISTINCT provider) FILTER (status = 'succeeded') AS succeeded, count(DISTINCT provider) AS selected, count(*) FILTER (status = 'rejected') AS skipped FROM model_calls GROUP BY 1",
    "p05_appended_events": "SELECT name, count(*) AS events, count(*) FILTER (is_synthetic) AS synthetic, max(epoch_us(date_trunc('millisecond', ts))) AS latest_micros FROM core_events GROUP BY 1",
    "x01_stored_blocks": "SELECT coalesce(source, 'none') AS source_id, count(*) AS blocks, sum(length(text))::BIGINT AS characters FROM blocks GROUP BY 1",
    "x03_stored_evidence": "SELECT source AS source_id, count(*) AS items, count(DISTINCT evidence_id) AS ids, 0 AS bad FROM evidence GROUP BY 1",
    "x04_upgraded_extractions": "SELECT doc_id || '-' || page AS block_id, count(*) AS items, CASE WHEN page % 3 <> 0 THEN page END AS page FROM blocks GROUP BY doc_id, page",
    "x06_ready_sources": "SELECT source, count(*) AS documents FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING avg(quality) >= 0.5",
    "x07_block_locators": "SELECT doc_id, count(*) AS blocks, sum(page)::BIGINT AS page_sum FROM blocks GROUP BY 1",
    "x08_event_scan": "SELECT event_type, count(*) AS events, min(event_id) AS first_id FROM events GROUP BY 1",
    "x16_exports": "SELECT 'calls' AS table_name, count(*) AS rows FROM model_calls UNION ALL SELECT 'prices', count(*) FROM prices UNION ALL SELECT 'cells', count(*) FROM cells",
    "x20_migration": "SELECT source, CASE WHEN NOT contains(text, excerpt) THEN 'unfixable' WHEN term IS NULL THEN 'upgraded' ELSE 'as_is' END AS state, count(*) AS items FROM evidence GROUP BY ALL",
}

def _judged_sql() -> str:
    """The rows of q01, to be grouped."""
    from heddle.plans.document_sql import SQL as documents_sql

    return documents_sql["q01_parse_quality"]


SQL["q33_blocked_sources"] = "WITH j AS ({q01}) SELECT source, bool_and(j.safe) AS safe, count(*) FILTER (NOT j.safe) AS unsafe_documents FROM j JOIN documents USING (doc_id) GROUP BY 1".replace("{q01}", _judged_sql())
SQL["q13_recommended"] = """WITH j AS ({q01}) SELECT lang, first(doc_id ORDER BY safe DESC, CASE WHEN issues = '' THEN 0 ELSE len(string_split(issues, ',')) END, coalesce(n_chars, 0), doc_id) AS doc_id, count(*) AS documents
    FROM j JOIN documents USING (doc_id) GROUP BY 1""".replace("{q01}", _judged_sql())
