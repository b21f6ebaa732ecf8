"""Ledger and trace analytics over model calls and spans, and effective-dated pricing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.columns import half_even, share
from heddle.sources.store import materialise
from heddle.sources.views import model_calls, prices, product_events, spans, table



def _ok() -> Column:
    return F.col("status") == "succeeded"


def _priced() -> Column:
    return F.col("cost_micros").isNotNull()


def real_calls(spark: SparkSession, sf_dir: str, include_synthetic: bool = False) -> DataFrame:
    calls = model_calls(spark, sf_dir)
    return calls if include_synthetic else calls.where(~F.col("is_synthetic"))


def o01_project_summary(spark, sf_dir):
    cost = F.col("cost_micros")
    return real_calls(spark, sf_dir).groupBy("project_id").agg(
        F.count("*").alias("calls"),
        F.count_if(_ok()).alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("latency_ms").alias("latency_ms"),
        F.max("latency_ms").alias("latency_max_ms"),
        F.count("cost_micros").alias("priced_count"),
        F.count_if(~_priced()).alias("unpriced_count"),
        F.sum("cost_micros").alias("cost_micros"),
        F.sum(F.when(~_ok(), cost)).alias("wasted_micros"),
    )


def o02_stage_self_time(spark, sf_dir):
    """Own duration less that of direct children, not below 0 for a span; by project and name."""
    s = spans(spark, sf_dir)
    inside = s.where("parent_id is not null").groupBy(F.col("parent_id").alias("span_id")).agg(F.sum("duration_ms").alias("inside"))
    own = F.greatest(F.lit(0), F.col("duration_ms") - F.coalesce("inside", F.lit(0)))
    joined = s.join(inside, "span_id", "left")
    return joined.groupBy("project_id", "name").agg(F.count("*").alias("spans"), F.sum("duration_ms").alias("total_ms"), F.sum(own).alias("self_ms"))


def o03_cost_breakdown(spark, sf_dir):
    cost = F.col("cost_micros")
    return real_calls(spark, sf_dir).groupBy("project_id", "stage", "provider", "model").agg(
        F.count("*").alias("calls"),
        F.sum(F.when(_ok(), cost)).alias("delivered_micros"),
        F.sum(F.when(~_ok(), cost)).alias("wasted_micros"),
        F.count_if(~_priced()).alias("unpriced_count"),
    )


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at index round((n - 1) p), half to even, for each group.

    Values are counted first, so that what a window holds is at most one row for each distinct value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    upto = counted.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = {name: half_even((F.col("_all") - 1) * F.lit(p)) for name, p in shares.items()}
    hit = lambda index: F.max(F.when((index >= F.col("_upto") - F.col("_n")) & (index < F.col("_upto")), F.col(value)))
    return upto.groupBy(*keys).agg(*[hit(index).alias(name) for name, index in at.items()])


def o05_latency_percentiles(spark, sf_dir):
    return nearest_rank(real_calls(spark, sf_dir), ["project_id", "stage"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})


def o06_cache_hit_rates(spark, sf_dir):
    e = product_events(spark, sf_dir).where(~F.col("is_synthetic"))
    by = e.groupBy("project_id", F.concat(F.lit("cache"), F.col("k") % 3).alias("cache")).agg(F.count_if(F.col("k") % 2 == 0).alias("hits"), F.count_if(F.col("k") % 2 == 1).alias("misses"))
    return by.withColumn("hit_rate", F.coalesce(share(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)))


def trace_nodes(spark, sf_dir) -> DataFrame:
    """Spans and model calls as one relation."""
    calls = model_calls(spark, sf_dir)
    return (
        spans(spark, sf_dir)
        .select(F.lit("span").alias("kind"), F.col("span_id").alias("node_id"), "parent_id", "trace_id", "project_id", "name", "status", "duration_ms", "started_at")
        .unionByName(
            calls.select(
                F.lit("call").alias("kind"), F.concat(F.lit("c"), "call_id").alias("node_id"), F.concat(F.lit("l"), "call_id").alias("parent_id"), "trace_id", "project_id", F.col("stage").alias("name"), "status",
                F.col("latency_ms").alias("duration_ms"), "started_at",
            )
        )
    )


def o08_trace_nodes(spark, sf_dir):
    return trace_nodes(spark, sf_dir).groupBy("trace_id").agg(
        F.count_if(F.col("kind") == "span").alias("spans"), F.count_if(F.col("kind") == "call").alias("calls"), F.max("duration_ms").alias("longest_ms")
    )


def root_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is missing; those that name none aren't shuffled, since a join would put them all into one task."""
    known = nodes.select(F.col("node_id").alias("parent_id"))
    columns = ["node_id", "parent_id", "trace_id"]
    return nodes.where("parent_id is null").select(*columns).unionByName(nodes.where("parent_id is not null").join(known, "parent_id", "left_anti").select(*columns))


def tree_depths(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """node_id, trace_id, depth of each node; a node whose parent is missing is a root.

    One equi-join a level with what is left of the nodes; each level is written once, so that the next doesn't make it
    again.  Nodes deeper than ``limit`` are left out here and counted by ``truncated_children``."""
    nodes = materialise(nodes.select("node_id", "parent_id", "trace_id"))
    level = materialise(root_nodes(nodes).select("node_id", "trace_id", F.lit(0).alias("depth")))
    levels = [level]
    for depth in range(1, limit + 1):
        above = level.select(F.col("node_id").alias("parent_id"))
        level = materialise(nodes.join(above, "parent_id").select("node_id", "trace_id", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def truncated_children(nodes: DataFrame, limit: int = 8) -> DataFrame:
    """node_id, truncated: how many children of a node at the depth limit the tree doesn't show."""
    deepest = tree_depths(nodes, limit).where(F.col("depth") == limit).select(F.col("node_id").alias("parent_id"))
    return nodes.join(deepest, "parent_id").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("truncated"))


def o10_trace_tree(spark, sf_dir):
    return tree_depths(trace_nodes(spark, sf_dir)).groupBy("trace_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("deepest"), F.count_if(F.col("depth") == 1).alias("first_level"))


def o11_waterfall(spark, sf_dir, least_width: float = 0.8):
    """Offset and width of each span as shares of its trace's time, in percent."""
    s = spans(spark, sf_dir).where("status <> 'running'")
    start = F.unix_millis("started_at")
    w = Window.partitionBy("trace_id")
    placed = s.withColumns({"a": start, "b": start + F.col("duration_ms")}).withColumns({"from": F.min("a").over(w), "to": F.max("b").over(w)})
    whole = F.nullif(F.col("to") - F.col("from"), F.lit(0)).cast("double")
    return placed.select(
        "span_id",
        F.coalesce(100.0 * (F.col("a") - F.col("from")) / whole, F.lit(0.0)).alias("offset_pct"),
        F.greatest(F.lit(least_width), F.coalesce(100.0 * F.col("duration_ms") / whole, F.lit(0.0))).alias("width_pct"),
    )


def o12_first_spans(spark, sf_dir):
    """The first span of each trace: roots first, then by start and id."""
    first = F.min(F.struct(F.col("parent_id").isNotNull().alias("child"), "started_at", "span_id", "name", "status")).alias("f")
    return spans(spark, sf_dir).groupBy("trace_id").agg(first).select("trace_id", "f.span_id", "f.name", "f.status")


def o13_open_spans(spark, sf_dir):
    running = spans(spark, sf_dir).where("status = 'running'")
    return running.groupBy("project_id").agg(F.max(F.struct("started_at", "span_id", "name")).alias("m")).select("project_id", "m.span_id", "m.name")


def o14_live_status(spark, sf_dir):
    """Latest root, latest failed span and latest running span of each project, in one pass."""
    s = spans(spark, sf_dir)
    latest = lambda when: F.max(F.when(when, F.struct("started_at", "span_id")))["span_id"]
    return s.groupBy("project_id").agg(
        latest(F.col("parent_id").isNull()).alias("latest_root"), latest(F.col("status") == "failed").alias("latest_error"), latest(F.col("status") == "running").alias("current")
    )


def o15_run_statistics(spark, sf_dir):
    """Cost is null where no call of the run has a price."""
    return model_calls(spark, sf_dir).groupBy("run_id", "stage").agg(
        F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("latency_ms").alias("stage_ms"), F.sum("cost_micros").alias("cost_micros"), F.count_if(~_priced()).alias("unpriced_count"),
        F.count_if(F.col("status") == "rejected").alias("retries"),
    )


def o16_distribution(spark, sf_dir):
    return model_calls(spark, sf_dir).groupBy("stage").agg(
        F.avg("latency_ms").alias("mean"), F.median("latency_ms").alias("median"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").cast("double").alias("p95"),
        F.count_if(_ok()).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "rejected").alias("rejected"),
    )


def o17_compare_runs(spark, sf_dir, run_a: str = "r1", run_b: str = "r2"):
    """Deltas of two runs over the union of their (stage, model) keys; a missing side counts 0, and a
    percentage over 0 is null.  Both arms come from one aggregate."""
    calls = model_calls(spark, sf_dir).where(F.col("run_id").isin(run_a, run_b))
    arm = lambda run: F.coalesce(F.sum(F.when(F.col("run_id") == run, F.col("latency_ms"))), F.lit(0))
    by = calls.groupBy("stage", "model").agg(arm(run_a).alias("before"), arm(run_b).alias("after"))
    change = F.col("after") - F.col("before")
    return by.select("stage", "model", "before", "after", change.alias("absolute"), (100.0 * share(change, F.col("before"))).alias("percent"))


def o22_run_rollup(spark, sf_dir):
    """A run has failed if any of its calls has."""
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return model_calls(spark, sf_dir).groupBy("run_id").agg(
        F.count("*").alias("calls"), F.bool_or(F.col("status") == "failed").alias("failed"), F.sum("input_tokens").alias("input_tokens"), F.sum("cost_micros").alias("cost_micros"),
        F.count("cost_micros").alias("priced_count"), F.count_if(~_priced()).alias("unpriced_count"), listed("model").alias("models"), F.countDistinct("trace_id").alias("traces"),
    )


def o24_recent_traces(spark, sf_dir, limit: int = 5):
    w = Window.partitionBy("project_id").orderBy(F.col("started_at").desc(), F.col("trace_id"))
    roots = spans(spark, sf_dir).where("parent_id is null")
    return roots.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("project_id", "trace_id", "place")


def o25_list_calls(spark, sf_dir, stage: str = "R", status: str = "failed", limit: int = 50):
    calls = real_calls(spark, sf_dir).where((F.col("stage") == stage) & (F.col("status") == status))
    return calls.orderBy(F.col("started_at").desc(), "call_id").limit(limit).select("call_id", "project_id", "model", "latency_ms")


def o27_linkage_issues(spark, sf_dir):
    """One row for each field that may be null, with how many rows lack it."""
    missing = lambda df, names: df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).unpivot([], names, "field", "missing")
    of_spans = missing(spans(spark, sf_dir), ["parent_id", "trace_id", "project_id"]).withColumn("subject", F.lit("span"))
    of_calls = missing(model_calls(spark, sf_dir), ["run_id", "model", "cost_micros"]).withColumn("subject", F.lit("call"))
    return of_spans.unionByName(of_calls).where("missing > 0").select("subject", "field", "missing")


def o28_reaped_spans(spark, sf_dir, as_of: str = "1999-01-01 00:00:00", minutes: int = 1440):
    """Running spans that started longer ago become interrupted; their traces with such a root fail."""
    old = (F.col("status") == "running") & (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("started_at") > minutes * 60_000_000)
    s = spans(spark, sf_dir).withColumn("now", F.when(old, "interrupted").otherwise(F.col("status")))
    return s.groupBy("project_id").agg(F.count_if(F.col("now") == "interrupted").alias("interrupted"), F.count_if(F.col("now") == "running").alias("running"), F.count_if((F.col("now") == "interrupted") & F.col("parent_id").isNull()).alias("failed_traces"))


def priced_calls(calls: DataFrame, price: DataFrame) -> DataFrame:
    """Adds price_micros: the price row in force at the call's start; null, never 0, where there is none.

    Each price row becomes an interval up to the next one of its model, so that a call meets at most
    one and nothing has to be grouped afterwards."""
    until = F.lead("effective_from").over(Window.partitionBy("model").orderBy("effective_from"))
    spans_ = price.withColumn("until", until).withColumnRenamed("model", "price_model")
    held = (F.col("model") == F.col("price_model")) & (F.col("started_at") >= F.col("effective_from")) & (F.col("until").isNull() | (F.col("started_at") < F.col("until")))
    scaled = lambda tokens, rate: F.coalesce(half_even(F.col(tokens) * F.col(rate) / 1_000_000), F.lit(0)).cast("long")
    total = F.col("per_call") + scaled("input_tokens", "input_per_million") + scaled("output_tokens", "output_per_million")
    return calls.join(spans_, held, "left").withColumn("price_micros", F.when(F.col("price_model").isNotNull(), total))


def c02_priced_calls(spark, sf_dir):
    priced = priced_calls(model_calls(spark, sf_dir), prices(spark, sf_dir))
    return priced.groupBy("project_id", "stage").agg(F.sum("price_micros").alias("price_micros"), F.count_if(F.col("price_micros").isNull()).alias("unpriced_count"), F.max("price_micros").alias("dearest"))


def c14_totals_if_priced(spark, sf_dir):
    """A total only where every call has a price."""
    priced = priced_calls(model_calls(spark, sf_dir), prices(spark, sf_dir))
    return priced.groupBy("run_id").agg(F.when(F.count("price_micros") == F.count("*"), F.sum("price_micros")).alias("total_micros"), F.count("*").alias("calls"))


def o29_reprice(spark, sf_dir):
    priced = priced_calls(model_calls(spark, sf_dir).where("status <> 'rejected'"), prices(spark, sf_dir))
    changed = ~F.col("cost_micros").eqNullSafe(F.col("price_micros"))
    return priced.groupBy("project_id").agg(F.count_if(changed).alias("changed"), F.sum("cost_micros").alias("before"), F.sum("price_micros").alias("after"))


def tier_verdicts(calls: DataFrame, least_fall: float = 0.15, most_ratio: float = 1.2) -> DataFrame:
    """Switch if the failure rate falls by more than ``least_fall`` at a cost ratio of ``most_ratio`` at most; undecidable if
    any call of either arm is unpriced, an arm is empty or the base costs nothing; else keep."""
    arm = lambda stage, c: F.when(F.col("stage") == stage, c)
    bad = F.when(F.col("status") == "failed", 1.0).otherwise(0.0)
    by = calls.groupBy("project_id").agg(
        (F.avg(arm("A", bad)) - F.avg(arm("R", bad))).alias("fall"), share(F.sum(arm("R", F.col("cost_micros"))), F.sum(arm("A", F.col("cost_micros")))).alias("ratio"),
        F.count_if(F.col("stage").isin("A", "R") & ~_priced()).alias("unpriced"),
    )
    unknown = (F.col("unpriced") > 0) | F.col("fall").isNull() | F.col("ratio").isNull()
    verdict = F.when(unknown, "undecidable").when((F.col("fall") > least_fall) & (F.col("ratio") <= most_ratio), "switch").otherwise("keep")
    return by.select("project_id", verdict.alias("verdict"), "unpriced")


def o30_priced_verdict(spark, sf_dir):
    """Arms: calls of stage A against stage R, by project."""
    return tier_verdicts(model_calls(spark, sf_dir))


def c08_calibration(spark, sf_dir):
    """Median tokens per minute over passing samples, ready from three samples on."""
    calls = model_calls(spark, sf_dir).where(_ok() & (F.col("latency_ms") > 0))
    rate = F.col("input_tokens") / (F.col("latency_ms") / 60000.0)
    return calls.groupBy("project_id", "stage").agg(F.median(rate).alias("tokens_per_minute"), F.count("*").alias("samples"), (F.count("*") >= 3).alias("ready"))


#: Secrets and paths that are masked, with their masks, in the order of use.
REDACTIONS = [
    (r"\bsk-[A-Za-z0-9_-]{8,}", "[SECRET]"),
    (r"(?i)(api[_-]?key|password|token|secret)\s*[:=]\s*[^\s,;]+", "$1=[REDACTED]"),
    (r"\+[0-9][0-9 ()-]{7,}[0-9]", "[PHONE]"),
    (r"/(home|Users)/[A-Za-z0-9._-]+", "/$1/[USER]"),
]


def redact(text: Column) -> Column:
    for pattern, mask in REDACTIONS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def o32_redact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = docs.select("doc_id", (F.length("text") - F.length(redact(F.col("text")))).cast("long").alias("shorter_by"), F.md5(redact(F.col("text")).cast("binary")).alias("text_md5"))
    return out


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] in "oc" and name[1:3].isdigit()}
