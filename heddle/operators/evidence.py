"""Evidence, claims and retrieval: matching, coverage, selection under budgets, relational division, BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import collapse, token_estimate
from heddle.sources.views import blocks, model_calls, product_events, real, table


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _grams(df: DataFrame, size: int) -> DataFrame:
    """One row for each run of ``size`` words: the other columns, at (from 0), n (words), gram."""
    keep = [c for c in df.columns if c != "text"]
    worded = df.select(*keep, word_list(F.col("text")).alias("w")).where(F.size("w") >= size)
    at = F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at")
    return worded.select(*keep, "w", at).select(*keep, "at", F.size("w").alias("n"), F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("gram"))


def evidence_hits(spark, sf_dir, size: int = 5) -> DataFrame:
    """Where documents hold a run of five words of a benchmark item: an equi-join, no nested loop."""
    items = _grams(table(spark, sf_dir, "benchmark").select("item_id", "text"), size).select("item_id", F.col("at").alias("item_at"), F.col("n").alias("item_words"), "gram")
    docs = _grams(table(spark, sf_dir, "documents").select("doc_id", "text"), size).select("doc_id", F.col("at").alias("doc_at"), "gram")
    return docs.join(items, "gram")


def e04_excerpt_coverage(spark, sf_dir, size: int = 5):
    """Share of an item's words covered by the union of the spans that a document has of it.

    Interval union: spans in order, an island starts beyond the largest end so far."""
    spans = evidence_hits(spark, sf_dir, size).select("item_id", "doc_id", "item_words", "item_at").distinct()
    w = Window.partitionBy("item_id", "doc_id").orderBy("item_at")
    before = F.max(F.col("item_at") + size).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.col("item_at") + size - F.greatest(F.col("item_at"), F.coalesce(before, F.lit(0))))
    return fresh.groupBy("item_id", "doc_id").agg(F.sum("fresh").alias("covered_words"), (F.sum("fresh") / F.first("item_words")).alias("coverage"))


def e02_first_spans(spark, sf_dir):
    """Where each item first begins in each document, with the text of the first matching run."""
    return evidence_hits(spark, sf_dir).groupBy("item_id", "doc_id").agg(F.min(F.struct("doc_at", "item_at", "gram")).alias("m")).select("item_id", "doc_id", F.col("m.doc_at").alias("word_at"), "m.gram")


def e22_budgeted_selection(spark, sf_dir, share_of_total: float = 0.4):
    """Best blocks first until a document's token target is reached; the block that reaches it is still taken."""
    tokens = token_estimate(F.col("text"))
    b = blocks(spark, sf_dir).select("doc_id", "idx", tokens.alias("tokens"), (F.length("text") % 97 + F.when(F.col("is_heading"), 100).otherwise(0)).alias("score"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "idx")
    taken = b.withColumns({"before": F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("tokens").over(Window.partitionBy("doc_id"))})
    chosen = taken.where(F.col("before") < F.ceil(F.col("total") * share_of_total))
    return chosen.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"), F.sum("idx").alias("idx_sum"))


def e34_claims_fully_supported(spark, sf_dir, largest: int = 40):
    """Relational division: orders whose every line's part is selected, by customer group."""
    selected = table(spark, sf_dir, "part").where(F.col("p_size") <= largest).select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("in"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(selected, "l_partkey", "left")
    claims = lines.groupBy("l_orderkey").agg(F.count("*").alias("evidence"), F.count("in").alias("held"))
    return claims.groupBy((F.col("l_orderkey") % 20).alias("bucket")).agg(F.count("*").alias("claims"), F.count_if(F.col("evidence") == F.col("held")).alias("kept"), F.count_if(F.col("held") == 0).alias("unsupported"))


def e35_scoped_blocks(spark, sf_dir):
    """Blocks of documents that are labelled good, and those of documents without a label."""
    labels = table(spark, sf_dir, "labels")
    b = blocks(spark, sf_dir)
    good = b.join(labels.where("quality = 1"), "doc_id", "left_semi").withColumn("scope", F.lit("good"))
    other = b.join(labels, "doc_id", "left_anti").withColumn("scope", F.lit("unlabelled"))
    return good.unionByName(other).groupBy("scope", "source").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"))


def e32_support_status(spark, sf_dir):
    c = model_calls(spark, sf_dir)
    confidence = F.col("latency_ms") % 100 / 100
    status = F.when(F.col("stage") == "N", "moderate").when(confidence >= 0.75, "strong").when(confidence >= 0.4, "moderate").otherwise("uncertain")
    return c.groupBy("project_id", status.alias("support")).agg(F.count("*").alias("claims"))


def e37_disagreements(spark, sf_dir):
    """Claims (parts) that some orders support and others dispute; a dispute of a source wins over its support."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("dispute"))
    by_source = lines.groupBy("l_partkey", "l_suppkey").agg(F.bool_or("dispute").alias("dispute"))
    claims = by_source.groupBy(F.col("l_partkey").alias("claim")).agg(F.count_if(~F.col("dispute")).alias("supports"), F.count_if(F.col("dispute")).alias("disputes"))
    return claims.where("supports > 0 and disputes > 0")


def e40_priorities(spark, sf_dir, must: int = 3, supporting: int = 5, optional: int = 8):
    """Ranked by score, then id, and cut into tiers by quotas."""
    c = model_calls(spark, sf_dir).where("status = 'succeeded'")
    value = F.least(F.lit(100), F.greatest(F.lit(0), F.col("input_tokens") % 90 + F.when(F.col("stage") == "A", 15).otherwise(0)))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "call_id", "latency_ms"))
    ranked = c.select("run_id", "call_id", "latency_ms", value.alias("score")).withColumn("place", rank)
    tier = F.when(F.col("place") <= must, "must").when(F.col("place") <= must + supporting, "supporting").when(F.col("place") <= must + supporting + optional, "optional").otherwise("deferred")
    return ranked.groupBy("run_id", tier.alias("tier")).agg(F.count("*").alias("claims"), F.sum("score").alias("score"), F.min("score").alias("least"))


def e60_latest_judgements(spark, sf_dir):
    """The last event of each (user, name); of equal times the larger id."""
    e = real(product_events(spark, sf_dir))
    latest = e.groupBy("user_id", "name").agg(F.max(F.struct("ts", "event_id", "project_id", "value")).alias("m"))
    return latest.select("user_id", "name", "m.event_id", "m.project_id", "m.value")


def e27_conservation(spark, sf_dir):
    """What becomes of each evidence id (supplier) of an order's lines: lines are claims of two types (A, R) or leave their id unresolved (N).
    An id must be used or unresolved, never both, and by claims of one type without a repeated text."""
    lines = table(spark, sf_dir, "lineitem")
    used = F.col("l_returnflag") != "N"
    # Dealt once by id for both steps: distinct counts in one would first make three rows of each.
    dealt = lines.select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity").repartition("l_orderkey", "l_suppkey")
    texts = dealt.groupBy("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    count = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    by = texts.groupBy("l_orderkey", "l_suppkey").agg(
        count(used).alias("used"), count(~used).alias("unresolved"), F.size(F.collect_set(F.when(used, F.col("l_returnflag")))).alias("types"), F.count_if(used).alias("texts")
    )
    state = F.when((F.col("used") > 0) & (F.col("unresolved") > 0), "both").when(F.col("types") > 1, "several_types").when(F.col("used") > F.col("texts"), "repeated").when(F.col("used") > 0, "used").otherwise("unresolved")
    planned = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    missing = planned.join(lines.select("l_orderkey").distinct(), "l_orderkey", "left_anti").agg(F.count("*").alias("ids")).select(F.lit("no_evidence").alias("state"), "ids").where("ids > 0")
    return by.groupBy(state.alias("state")).agg(F.count("*").alias("ids")).unionByName(missing)


def e20_block_scores(spark, sf_dir):
    """Overlap of a block's words with its document's most frequent source words, at most 30 points."""
    b = blocks(spark, sf_dir).select("doc_id", "idx", "source", F.array_distinct(word_list(F.col("text"))).alias("w"), "is_heading")
    words = b.select("source", F.explode("w").alias("word")).where(F.length("word") > 4).groupBy("source", "word").agg(F.count("*").alias("n"))
    top = words.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word"))).where("place <= 20")
    terms = top.groupBy("source").agg(F.collect_list("word").alias("terms"))
    points = F.least(F.lit(30), F.size(F.array_intersect("w", "terms")) * 5) + F.when(F.col("is_heading"), 35).otherwise(0)
    return b.join(terms, "source").groupBy("doc_id").agg(F.sum(points).cast("long").alias("points"), F.max(points).cast("long").alias("best"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "e" and name[1:3].isdigit()}
