"""Reviews of scripts and traces: grounding of turns, repair, outcomes and revisions; details of traces, runs and caches.

A segment is an order, a turn one of its lines; the turn's claim is its part and its evidence the supplier.  ``SQL`` holds
the same rules for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import collapse, share
from heddle.operators.drafts import kinds, violations
from heddle.operators.evidence import word_list
from heddle.sources.views import model_calls, product_events, real, spans, table, turns


def script_turns(spark, sf_dir) -> DataFrame:
    """segment, turn, claim, evidence, substantive, flag: what a script's turns cite."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("segment"), F.col("l_linenumber").alias("turn"), F.col("l_partkey").alias("claim"), F.col("l_suppkey").alias("evidence"),
        (F.col("l_linestatus") == "O").alias("substantive"), F.col("l_returnflag").alias("flag"), F.floor("l_quantity").alias("words"),
    )


def packs(spark, sf_dir) -> DataFrame:
    """(claim, evidence) pairs that evidence packs hold: those of accepted lines."""
    return script_turns(spark, sf_dir).where("flag = 'A'").select("claim", "evidence").distinct()


def grounded(spark, sf_dir) -> DataFrame:
    """Turns with whether their claim has a pack at all and whether the pack holds their evidence."""
    p = packs(spark, sf_dir)
    s = script_turns(spark, sf_dir).join(p.select("claim").distinct().withColumn("known", F.lit(True)), "claim", "left")
    s = s.join(p.withColumn("linked", F.lit(True)), ["claim", "evidence"], "left")
    return s.withColumns({"known": F.coalesce("known", F.lit(False)), "linked": F.coalesce("linked", F.lit(False))})


def t01_turn_checks(spark, sf_dir):
    """All simple checks of turns: one row for each segment and kind of issue, beside the totals of t14."""
    w = Window.partitionBy("segment_id").orderBy("position")
    t = turns(spark, sf_dir).withColumns({"words": F.size(word_list(F.col("text"))), "before": F.lag("speaker").over(w)})
    return violations(t, {"empty": F.col("words") == 0, "short": (F.col("words") > 0) & (F.col("words") < 5), "long": F.col("words") > 60, "same_speaker": F.col("speaker") == F.col("before")}, "segment_id")


def t04_trigrams(spark, sf_dir):
    t = turns(spark, sf_dir).select("segment_id", "position", word_list(F.col("text")).alias("w"))
    grams = F.when(F.size("w") >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(3)), " "))))
    return t.select("segment_id", "position", F.coalesce(F.size(grams), F.lit(0)).alias("trigrams"))


def t07_unsupported_specifics(spark, sf_dir):
    """Words of six letters and more of a turn that no other turn of its segment has."""
    t = turns(spark, sf_dir).select("segment_id", "position", F.explode(F.array_distinct(F.filter(word_list(F.col("text")), lambda w: F.length(w) >= 6))).alias("word"))
    alone = t.groupBy("segment_id", "word").agg(F.count("*").alias("n"), F.min("position").alias("position")).where("n = 1")
    return alone.groupBy("segment_id", "position").agg(F.count("*").alias("unsupported"))


def t08_haystacks(spark, sf_dir):
    """The folded text of each segment, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", F.lower(collapse(F.col("text"))).alias("t")))), lambda x: x["t"])
    return turns(spark, sf_dir).groupBy("segment_id").agg(F.md5(F.array_join(listed, "\n").cast("binary")).alias("text_md5"))


def t10_dropped_content(spark, sf_dir):
    """Claims of a chapter that must be kept (size over 25) and never spoken (no accepted turn); high above a quarter."""
    spoken = script_turns(spark, sf_dir).where("flag = 'A'").select(F.col("claim").alias("p_partkey")).distinct().withColumn("spoken", F.lit(1))
    must = table(spark, sf_dir, "part").where("p_size > 25").join(spoken, "p_partkey", "left")
    by = must.groupBy(F.col("p_brand").alias("chapter")).agg(F.count("*").alias("planned"), F.count_if(F.col("spoken").isNull()).alias("dropped"))
    return by.withColumn("severity", F.when(F.col("dropped") == 0, "none").when(F.col("dropped") > 0.25 * F.col("planned"), "high").otherwise("medium"))


FILLERS = ["the", "of", "der", "que", "de"]


def t11_filler_openings(spark, sf_dir):
    """Turns whose first sentence holds one of the given words."""
    words = word_list(F.substring_index(F.regexp_replace("text", "[.!?]", "."), ".", 1))
    return turns(spark, sf_dir).groupBy("speaker").agg(F.count("*").alias("turns"), F.count_if(F.arrays_overlap(words, F.array(*[F.lit(f) for f in FILLERS]))).alias("with_filler"))


def t12_spoken_texts(spark, sf_dir):
    return turns(spark, sf_dir).select("segment_id", "position", F.md5(F.lower(collapse(F.replace(F.col("text"), F.lit("\u200c"), F.lit("")))).cast("binary")).alias("text_md5"))


def t15_grounding(spark, sf_dir):
    """Turns by fault: their claim has no pack, their evidence is outside it, or they have substance and no link."""
    g = grounded(spark, sf_dir)
    return violations(g, {"unknown_claim": ~F.col("known"), "outside_pack": F.col("known") & ~F.col("linked"), "unlinked": F.col("substantive") & ~F.col("linked")}, "segment")


def repaired(spark, sf_dir) -> DataFrame:
    """Adds the action on each turn: kept, repaired (evidence taken from its claim), excised (substance without any)."""
    return grounded(spark, sf_dir).withColumn("action", F.when(F.col("linked") | ~F.col("substantive"), "keep").when(F.col("known"), "repair").otherwise("excise"))


def t16_remediation(spark, sf_dir):
    """What repair leaves of each segment; emptied ones go, a shortfall in words is told."""
    by = repaired(spark, sf_dir).groupBy("segment").agg(
        F.count("*").alias("turns"), F.count_if(F.col("action") == "repair").alias("repaired"), F.count_if(F.col("action") == "excise").alias("excised"), F.sum(F.when(F.col("action") == "excise", F.col("words")).otherwise(0)).alias("lost_words"), F.sum("words").alias("words")
    )
    return by.select("segment", "turns", "repaired", "excised", (F.col("turns") == F.col("excised")).alias("emptied"), (F.col("lost_words") > 0.2 * F.col("words")).alias("short"))


def t17_provenance(spark, sf_dir):
    """Distinct evidence of a segment's claims in order of first use."""
    first = script_turns(spark, sf_dir).groupBy("segment", "evidence").agg(F.min("turn").alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence"))), lambda x: x["evidence"].cast("string"))
    return first.groupBy("segment").agg(F.array_join(listed, ",").alias("evidence"))


def noted(spark, sf_dir) -> DataFrame:
    """project, segment, notes and notable ones: a note is a repaired or excised turn, notable if excised."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment"), (F.col("o_custkey") % 50).alias("project"))
    return repaired(spark, sf_dir).join(o, "segment").groupBy("project", "segment").agg(F.count_if(F.col("action") != "keep").alias("notes"), F.count_if(F.col("action") == "excise").alias("notable"), F.count_if("substantive").alias("substantive"))


def t18_degradation_ceiling(spark, sf_dir):
    """Projects with three notable notes or more, or notes in over a quarter of the segments."""
    by = noted(spark, sf_dir).groupBy("project").agg(F.sum("notable").alias("notable"), F.count("*").alias("segments"), F.count_if(F.col("notes") > 0).alias("noted"))
    return by.withColumn("exceeds", (F.col("notable") >= 3) | (F.col("noted") > 0.25 * F.col("segments")))


def t19_degradation_counters(spark, sf_dir):
    return noted(spark, sf_dir).groupBy("project").agg(F.sum("notes").alias("notes"), F.sum("notable").alias("excised"), F.sum("substantive").alias("substantive"), F.count_if(F.col("notable") > 0).alias("segments"))


def quality_keys(spark, sf_dir) -> DataFrame:
    """Candidates (segments) of each project with the parts of their quality key."""
    g = grounded(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("segment"), (F.col("o_custkey") % 50).alias("project"))
    by = g.groupBy("segment").agg(F.count_if(F.col("substantive") & ~F.col("known")).alias("blocking"), F.avg(F.col("linked").cast("double")).alias("support"), F.sum("words").alias("words"), F.count("*").alias("turns"))
    return by.join(o, "segment")


def t21_outcomes(spark, sf_dir):
    """Rejected with over half of the turns unsupported and a blocking issue, review for one alone, else verified."""
    outcome = F.when((F.col("blocking") > 0) & (F.col("support") < 0.5), "rejected").when((F.col("blocking") > 0) | (F.col("support") < 0.5), "review_required").otherwise("verified")
    return quality_keys(spark, sf_dir).groupBy("project", outcome.alias("outcome")).agg(F.count("*").alias("scripts"))


def t22_best_candidates(spark, sf_dir):
    """The candidate of the largest quality key: no blocking issue, support, words, then the smaller segment."""
    key = F.struct((F.col("blocking") == 0).alias("clean"), F.round("support", 9).alias("support"), "words", (-F.col("segment")).alias("s"))
    return quality_keys(spark, sf_dir).groupBy("project").agg(F.max_by("segment", key).alias("segment"), F.count("*").alias("candidates"))


def t23_replaced_incumbents(spark, sf_dir):
    """A candidate replaces the best before it only if its key is strictly greater: how often that happened."""
    w = Window.partitionBy("project").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    q = quality_keys(spark, sf_dir).withColumn("key", F.struct((F.col("blocking") == 0).alias("clean"), F.round("support", 9).alias("support"), "words"))
    return q.withColumn("best", F.max("key").over(w)).groupBy("project").agg(F.count_if(F.col("best").isNull() | (F.col("key") > F.col("best"))).alias("replaced"))


def t24_target_turns(spark, sf_dir):
    """Turns to revise: those hit themselves, all of a segment whose support is under a third."""
    g = grounded(spark, sf_dir)
    weak = g.groupBy("segment").agg(F.avg(F.col("linked").cast("double")).alias("support")).where("support < 0.33").select("segment", F.lit(True).alias("weak"))
    hit = g.join(weak, "segment", "left").where((F.col("substantive") & ~F.col("known")) | F.coalesce("weak", F.lit(False)))
    return hit.groupBy("segment").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


def t25_revisions(spark, sf_dir):
    """A revision (lines R) against its targets (lines N): turns missing, added, and citations that no pack holds."""
    s = script_turns(spark, sf_dir)
    asked, given = s.where("flag = 'N'").select("segment", "claim").distinct().withColumn("asked", F.lit(1)), s.where("flag = 'R'").select("segment", "claim").distinct().withColumn("given", F.lit(1))
    both = asked.join(given, ["segment", "claim"], "full").join(packs(spark, sf_dir).select("claim").distinct().withColumn("held", F.lit(1)), "claim", "left")
    return both.groupBy("segment").agg(F.count_if(F.col("given").isNull()).alias("missing"), F.count_if(F.col("asked").isNull()).alias("added"), F.count_if(F.col("given").isNotNull() & F.col("held").isNull()).alias("invented"))


def t26_verification_rules(spark, sf_dir):
    """Verifications that contradict themselves; a low ratio without an issue behind it is set back to one."""
    q = quality_keys(spark, sf_dir)
    kinds_ = {"issue_but_full": (F.col("blocking") > 0) & (F.col("support") >= 1), "reset": (F.col("blocking") == 0) & (F.col("support") < 1), "empty": F.col("words") == 0}
    return violations(q, kinds_, "project")


def t30_latin_tokens(spark, sf_dir):
    t = turns(spark, sf_dir).select("segment_id", F.explode(word_list(F.col("text"))).alias("word"))
    latin = F.length(F.regexp_replace("word", "[^a-z]", "")) >= 0.75 * F.length("word")
    return t.groupBy("segment_id").agg(F.countDistinct(F.when(latin, F.col("word"))).alias("latin"), F.countDistinct("word").alias("words"))


def t38_duration_outliers(spark, sf_dir):
    """Turns whose duration leaves 35 to 165 percent of what their words need at 130 a minute."""
    c = model_calls(spark, sf_dir).where("output_tokens > 0")
    r = F.col("latency_ms") / (F.col("output_tokens") / F.lit(130.0) * 60000)
    return c.groupBy("project_id").agg(F.count("*").alias("turns"), F.count_if((r < 0.35) | (r > 1.65)).alias("outliers"))


def error_class() -> Column:
    return F.when(F.col("status") == "rejected", "contract").when((F.col("status") == "failed") & (F.col("latency_ms") > 60000), "transport").when((F.col("status") == "failed") & (F.col("output_tokens") < 100), "structural").when(F.col("status") == "failed", "quality")


def t39_error_classes(spark, sf_dir):
    return model_calls(spark, sf_dir).withColumn("class", error_class()).where("class is not null").groupBy("stage", "class").agg(F.count("*").alias("calls"))


def t47_retry_rules(spark, sf_dir):
    """Retries that are still allowed: two after transport errors, one after contract and quality errors, none else."""
    c = model_calls(spark, sf_dir).withColumn("class", error_class()).where("class is not null")
    used = F.row_number().over(Window.partitionBy("trace_id", "class").orderBy("call_id")) - 1
    allowed = F.when(F.col("class") == "transport", 2).when(F.col("class").isin("contract", "quality"), 1).otherwise(0)
    return c.withColumn("again", used < allowed).groupBy("class").agg(F.count("*").alias("errors"), F.count_if("again").alias("retried"))


def t45_sentences(spark, sf_dir):
    words = F.filter(F.transform(F.split("text", "[.!?]"), lambda s: F.size(word_list(s))), lambda n: n >= 4)
    return turns(spark, sf_dir).groupBy("speaker").agg(F.sum(F.size(words)).alias("sentences"), F.count("*").alias("turns"))


def t46_revised_turns(spark, sf_dir):
    """The revised text of a turn (the next turn of its speaker, if longer), else the original."""
    after = F.lead("text").over(Window.partitionBy("segment_id", "speaker").orderBy("position"))
    t = turns(spark, sf_dir).withColumn("after", after)
    final = F.when(F.length("after") > F.length("text"), F.col("after")).otherwise(F.col("text"))
    return t.groupBy("segment_id").agg(F.sum(F.length(final)).alias("characters"), F.count_if(F.length("after") > F.length("text")).alias("revised"))


def t49_idle_fillers(spark, sf_dir):
    idle = (F.size(word_list(F.col("text"))) < 25) & F.array_contains(F.array(*[F.lit(f) for f in FILLERS]), F.get(word_list(F.col("text")), F.lit(0)))
    return turns(spark, sf_dir).groupBy("segment_id").agg(F.count_if(idle).alias("fillers"))


def t50_speaker_turns(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("segment_id", "speaker").agg(F.count("*").alias("turns"))


def t54_durations(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("segment_id").agg((F.sum(F.size(word_list(F.col("text")))) / F.lit(130.0)).alias("minutes"))


def t56_first_sentences(spark, sf_dir):
    first = F.trim(F.substring_index(F.regexp_replace("text", "[.!?]", "."), ".", 1))
    return turns(spark, sf_dir).groupBy("segment_id").agg(F.md5(F.min(first).cast("binary")).alias("least_md5"), F.max(F.length(first)).alias("longest"))


def t57_policies(spark, sf_dir):
    """The policy of each stage, with a default for those that have none."""
    p = spark.createDataFrame([("A", 3, 2.0), ("R", 1, 5.0)], "stage string, attempts int, base double")
    c = model_calls(spark, sf_dir).groupBy("stage").agg(F.count("*").alias("calls"))
    return c.join(F.broadcast(p), "stage", "left").select("stage", "calls", F.coalesce("attempts", F.lit(2)).alias("attempts"), F.coalesce("base", F.lit(1.0)).alias("base"))


def o04_experiment_summary(spark, sf_dir):
    """Calls, tokens, models, unpriced (model, stage) pairs and latencies of each run's extraction stage."""
    c = model_calls(spark, sf_dir).where("stage = 'A'")
    return c.groupBy("run_id").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.countDistinct(F.when(F.col("cost_micros").isNull(), F.struct("model", "provider"))).alias("unpriced"), F.median("latency_ms").alias("p50"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").cast("double").alias("p95"),
    )


def o31_derived_rates(spark, sf_dir):
    """Failures over attempts and tokens over priced calls; null over nothing."""
    c = model_calls(spark, sf_dir).groupBy("run_id", "stage").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "failed").alias("failures"), F.sum("output_tokens").alias("claims"), F.count_if(F.col("status") == "succeeded").alias("kept"))
    return c.select("run_id", "stage", share(F.col("failures"), F.col("attempts")).alias("failure_rate"), share(F.col("claims"), F.col("kept")).alias("claims_per_kept"))


def o09_trace_nodes_in_order(spark, sf_dir):
    """Place of each span and call in its trace, by start and id."""
    from heddle.operators.ledger import trace_nodes

    return trace_nodes(spark, sf_dir).select("trace_id", "node_id", F.row_number().over(Window.partitionBy("trace_id").orderBy("started_at", "node_id")).alias("place"))


def o23_runs_newest_first(spark, sf_dir, most: int = 3):
    runs = model_calls(spark, sf_dir).where("not is_synthetic").groupBy("project_id", "run_id").agg(F.max("started_at").alias("at"), F.count("*").alias("calls"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("at"), "run_id"))
    return runs.withColumn("place", place).where(F.col("place") <= most).select("project_id", "run_id", "calls", "place")


def o26_project_events(spark, sf_dir, most: int = 20):
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return product_events(spark, sf_dir).withColumn("place", place).where(F.col("place") <= most).select("project_id", "event_id", "name", "place")


#: Keys and paths that are masked, with their masks, in the order of use.
MASKS = [
    (r"AIza[0-9A-Za-z_-]{20,}", "[REDACTED_GEMINI_KEY]"),
    (r"sk-[A-Za-z0-9_-]{20,}", "[REDACTED_SECRET]"),
    (r"(?:\+98|0098|0)9[0-9]{9}", "[REDACTED_PHONE]"),
    (r"[A-Za-z]:\\Users\\[^\\/\s]+", "[HOME]"),
    (r"/home/[^/\s]+", "[HOME]"),
]


def masked(text: Column) -> Column:
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def o32_masked_texts(spark, sf_dir):
    """Whole texts with keys, phones and home paths masked; each text is followed by one of each kind made from its id."""
    number = F.lpad((F.col("doc_id") % 1_000_000_000).cast("string"), 9, "0")
    text = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.concat(F.lit("AIza"), number, number, number), F.concat(F.lit("sk-"), number, number, number), F.concat(F.lit("00989"), number), F.concat(F.lit("C:\\Users\\u"), "doc_id"), F.concat(F.lit("/home/u"), "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(masked(text).cast("binary")).alias("text_md5"), F.length(masked(text)).alias("characters"))


#: Words in the names of sensitive keys.
SENSITIVE = ["api_key", "token", "password", "secret", "authorization"]


def sensitive(name: Column) -> Column:
    return F.lower(F.translate(name, "-", "_")).rlike("|".join(SENSITIVE))


def o33_redacted_payloads(spark, sf_dir):
    """Payloads as maps: values of sensitive keys are gone, contents become hash and length, names hash and ending."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("Api-Key"), F.lit("k"), F.lit("content"), F.coalesce("text", F.lit("")), F.lit("filename"), F.concat(F.col("source"), F.lit(".pdf")), F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("m"))
    short = lambda v, n: F.substring(F.sha2(v.cast("binary"), 256), 1, n)
    rule = lambda k, v: F.when(sensitive(k), F.lit("[REDACTED]")).when(k == "content", F.concat(short(v, 64), F.lit(":"), F.length(v))).when(k == "filename", F.concat(short(v, 8), F.lit("."), F.substring_index(v, ".", -1))).otherwise(v)
    out = d.select("doc_id", F.transform_values("m", rule).alias("m"))
    return out.select("doc_id", *[F.col("m")[k].alias(a) for k, a in (("Api-Key", "api_key"), ("content", "content"), ("filename", "filename"), ("lang", "lang"))])


def o34_sensitive_keys(spark, sf_dir):
    """Names that count as sensitive, whatever their case and dashes; names are made of sources and known words."""
    words = F.explode(F.array(*[F.lit(w) for w in ("Api-Key", "X-TOKEN", "Pass-Word", "colour", "client-SECRET")])).alias("w")
    names = table(spark, sf_dir, "documents").select("source", words).distinct().select(F.concat_ws("-", "source", "w").alias("key"))
    return names.select("key", sensitive(F.col("key")).alias("sensitive"))


def o35_cache_lineage(spark, sf_dir):
    """Cache events by result and reason, with the calls and tokens that hits avoided."""
    e = product_events(spark, sf_dir, "flow").where("not is_synthetic")
    result = F.when(F.col("k") % 3 == 0, "hit").when(F.col("k") % 3 == 1, "miss").otherwise("stale")
    reason = F.when(F.col("k") % 3 == 2, F.when(F.col("stage") > 4, "identity_changed").otherwise("expired"))
    return e.groupBy("project_id", result.alias("result"), F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count("*").alias("lookups"), F.sum(F.when(F.col("k") % 3 == 0, F.col("stage")).otherwise(0)).alias("avoided_calls"))


def o36_resolved_ids(spark, sf_dir):
    """Whether an id is a run, a trace or neither: ids of both kinds and numbers that may be neither."""
    ids = table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "o").otherwise("r"), F.col("o_orderkey") + 5).alias("id"))
    c = model_calls(spark, sf_dir)
    run, trace = c.select(F.col("run_id").alias("id")).distinct().withColumn("is_run", F.lit(1)), c.select(F.col("trace_id").alias("id")).distinct().withColumn("is_trace", F.lit(1))
    kind = F.when(F.col("is_run").isNotNull(), "run").when(F.col("is_trace").isNotNull(), "trace").otherwise("unknown")
    return ids.join(run, "id", "left").join(trace, "id", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("ids"))


def o39_spans_in_order(spark, sf_dir):
    return spans(spark, sf_dir).select("trace_id", "span_id", F.row_number().over(Window.partitionBy("trace_id").orderBy("started_at", "span_id")).alias("place"))


def o40_events_in_order(spark, sf_dir):
    """Events of each user's trace in time order, with the seconds since the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return real(product_events(spark, sf_dir)).select("user_id", "event_id", F.row_number().over(w).alias("place"), (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))).alias("micros_since"))


def o41_trace_statistics(spark, sf_dir):
    root = F.min_by(F.struct("span_id", "name"), F.struct(F.col("parent_id").isNotNull().alias("child"), "started_at", "span_id"))
    return spans(spark, sf_dir).groupBy("trace_id").agg(root.alias("r"), F.count("*").alias("spans"), (F.max(F.unix_millis("started_at") + F.col("duration_ms")) - F.min(F.unix_millis("started_at"))).alias("wall_ms")).select("trace_id", "r.span_id", "r.name", "spans", "wall_ms")


def o42_durations(spark, sf_dir):
    """The stored duration, else end less start, else 0."""
    l = table(spark, sf_dir, "lineitem")
    stored = F.when(F.col("l_linenumber") % 3 != 0, F.floor("l_extendedprice"))
    ended = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate").cast("timestamp") + F.expr("interval 90 seconds"))
    spent = F.unix_millis(ended) - F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    return l.groupBy("l_returnflag").agg(F.sum(F.coalesce(stored, spent, F.lit(0))).alias("duration_ms"), F.count_if(stored.isNull() & ended.isNull()).alias("unknown"))


def o43_quarantined_calls(spark, sf_dir):
    """Calls that lack a linkage field, by the first that is missing."""
    c = model_calls(spark, sf_dir).withColumn("cost_ref", F.col("cost_micros"))
    first = F.coalesce(*[F.when(F.col(n).isNull(), F.lit(n)) for n in ("project_id", "trace_id", "model", "cost_ref")])
    return c.groupBy(F.coalesce(first, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("calls"))


def o44_review_decisions(spark, sf_dir):
    e = product_events(spark, sf_dir, "gate").where("not is_synthetic and name in ('gate.resolved', 'gate.blocked', 'workflow.rewound')")
    disposition = F.when(F.col("name") == "gate.resolved", "accepted").when(F.col("name") == "gate.blocked", "rejected").otherwise("regenerated")
    return e.groupBy("gate_name", disposition.alias("disposition")).agg(F.count("*").alias("decisions"), F.countDistinct("user_id").alias("reviewers"))


def o45_quality_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    verdict = F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "pass").otherwise("fail")
    return d.groupBy("source", verdict.alias("verdict")).agg(F.count("*").alias("labels"), F.avg(F.col("toxic").cast("double")).alias("score"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] in "to" and name[1:3].isdigit()}

_WORDS = r"regexp_extract_all(lower({x}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("\\\\x", "\\x")
WORDS, FIRST = _WORDS.format(x="text"), "split_part(regexp_replace(text, '[.!?]', '.', 'g'), '.', 1)"
WS = r"[ \t\n\x0B\f\r]+"
_S = "s AS (SELECT l_orderkey AS segment, l_linenumber AS turn, l_partkey AS claim, l_suppkey AS evidence, l_linestatus = 'O' AS substantive, l_returnflag AS flag, floor(l_quantity)::BIGINT AS words FROM lineitem)"
_G = _S + """, pk AS (SELECT DISTINCT claim, evidence FROM s WHERE flag = 'A'), g AS (SELECT *, claim IN (SELECT claim FROM pk) AS known, (claim, evidence) IN (SELECT claim, evidence FROM pk) AS linked FROM s)"""
_R = _G + ", r AS (SELECT *, CASE WHEN linked OR NOT substantive THEN 'keep' WHEN known THEN 'repair' ELSE 'excise' END AS action FROM g)"
_N = _R + """, n AS (SELECT o_custkey % 50 AS project, segment, count(*) FILTER (action <> 'keep') AS notes, count(*) FILTER (action = 'excise') AS notable, count(*) FILTER (substantive) AS substantive
    FROM r JOIN orders ON o_orderkey = segment GROUP BY 1, 2)"""
_K = _G + """, k AS (SELECT segment, any_value(o_custkey % 50) AS project, count(*) FILTER (substantive AND NOT known) AS blocking, avg(linked::INT) AS support, sum(words)::BIGINT AS words, count(*) AS turns
    FROM g JOIN orders ON o_orderkey = segment GROUP BY 1)"""
_FILL = ", ".join(f"'{f}'" for f in FILLERS)
_CLASS = "CASE WHEN status = 'rejected' THEN 'contract' WHEN status = 'failed' AND latency_ms > 60000 THEN 'transport' WHEN status = 'failed' AND output_tokens < 100 THEN 'structural' WHEN status = 'failed' THEN 'quality' END"

SQL = {
    "t01_turn_checks": kinds(f"SELECT *, len({WORDS}) AS words, lag(speaker) OVER (PARTITION BY segment_id ORDER BY position) AS before FROM turns", {"empty": "words = 0", "short": "words > 0 AND words < 5", "long": "words > 60", "same_speaker": "speaker = before"}, "segment_id"),
    "t04_trigrams": f"SELECT segment_id, position, len(list_distinct(list_transform(generate_series(1, len({WORDS}) - 2), lambda i: array_to_string(({WORDS})[i : i + 2], ' '))))::INT AS trigrams FROM turns",
    "t07_unsupported_specifics": f"""WITH w AS (SELECT DISTINCT segment_id, position, unnest({WORDS}) AS word FROM turns), a AS (SELECT segment_id, word, min(position) AS position FROM w WHERE length(word) >= 6 GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT segment_id, position, count(*) AS unsupported FROM a GROUP BY 1, 2""",
    "t08_haystacks": f"SELECT segment_id, md5(string_agg(lower(trim(regexp_replace(text, '{WS}', ' ', 'g'))), chr(10) ORDER BY position)) AS text_md5 FROM turns GROUP BY 1",
    "t10_dropped_content": """WITH b AS (SELECT p_brand AS chapter, count(*) AS planned, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')) AS dropped FROM part WHERE p_size > 25 GROUP BY 1)
        SELECT *, CASE WHEN dropped = 0 THEN 'none' WHEN dropped > 0.25 * planned THEN 'high' ELSE 'medium' END AS severity FROM b""",
    "t11_filler_openings": f"SELECT speaker, count(*) AS turns, count(*) FILTER (list_has_any({_WORDS.format(x=FIRST)}, [{_FILL}])) AS with_filler FROM turns GROUP BY 1",
    "t12_spoken_texts": f"SELECT segment_id, position, md5(lower(trim(regexp_replace(replace(text, chr(8204), ''), '{WS}', ' ', 'g')))) AS text_md5 FROM turns",
    "t15_grounding": f"WITH {_G} " + kinds("SELECT * FROM g", {"unknown_claim": "NOT known", "outside_pack": "known AND NOT linked", "unlinked": "substantive AND NOT linked"}, "segment"),
    "t16_remediation": f"""WITH {_R} SELECT segment, count(*) AS turns, count(*) FILTER (action = 'repair') AS repaired, count(*) FILTER (action = 'excise') AS excised, bool_and(action = 'excise') AS emptied,
        coalesce(sum(words) FILTER (action = 'excise'), 0) > 0.2 * sum(words) AS short FROM r GROUP BY 1""",
    "t17_provenance": f"WITH {_S}, f AS (SELECT segment, evidence, min(turn) AS a FROM s GROUP BY 1, 2) SELECT segment, string_agg(evidence::VARCHAR, ',' ORDER BY a, evidence) AS evidence FROM f GROUP BY 1",
    "t18_degradation_ceiling": f"""WITH {_N} SELECT project, sum(notable)::BIGINT AS notable, count(*) AS segments, count(*) FILTER (notes > 0) AS noted,
        sum(notable) >= 3 OR count(*) FILTER (notes > 0) > 0.25 * count(*) AS exceeds FROM n GROUP BY 1""",
    "t19_degradation_counters": f"WITH {_N} SELECT project, sum(notes)::BIGINT AS notes, sum(notable)::BIGINT AS excised, sum(substantive)::BIGINT AS substantive, count(*) FILTER (notable > 0) AS segments FROM n GROUP BY 1",
    "t21_outcomes": f"WITH {_K} SELECT project, CASE WHEN blocking > 0 AND support < 0.5 THEN 'rejected' WHEN blocking > 0 OR support < 0.5 THEN 'review_required' ELSE 'verified' END AS outcome, count(*) AS scripts FROM k GROUP BY ALL",
    "t22_best_candidates": f"WITH {_K} SELECT project, first(segment ORDER BY blocking = 0 DESC, round(support, 9) DESC, words DESC, segment) AS segment, count(*) AS candidates FROM k GROUP BY 1",
    "t23_replaced_incumbents": f"""WITH {_K}, o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY segment) AS p, dense_rank() OVER (PARTITION BY project ORDER BY blocking = 0, round(support, 9), words) AS d FROM k),
        b AS (SELECT *, max(d) OVER (PARTITION BY project ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM o) SELECT project, count(*) FILTER (best IS NULL OR d > best) AS replaced FROM b GROUP BY 1""",
    "t24_target_turns": f"""WITH {_G}, w AS (SELECT segment FROM g GROUP BY 1 HAVING avg(linked::INT) < 0.33)
        SELECT segment, count(*) AS turns, min(turn) AS first_turn FROM g WHERE (substantive AND NOT known) OR segment IN (SELECT segment FROM w) GROUP BY 1""",
    "t25_revisions": f"""WITH {_S}, a AS (SELECT DISTINCT segment, claim, 1 AS asked FROM s WHERE flag = 'N'), v AS (SELECT DISTINCT segment, claim, 1 AS given FROM s WHERE flag = 'R'), b AS (SELECT * FROM a FULL JOIN v USING (segment, claim))
        SELECT segment, count(*) FILTER (given IS NULL) AS missing, count(*) FILTER (asked IS NULL) AS added, count(*) FILTER (given IS NOT NULL AND claim NOT IN (SELECT claim FROM s WHERE flag = 'A')) AS invented FROM b GROUP BY 1""",
    "t26_verification_rules": f"WITH {_K} " + kinds("SELECT * FROM k", {"issue_but_full": "blocking > 0 AND support >= 1", "reset": "blocking = 0 AND support < 1", "empty": "words = 0"}, "project"),
    "t30_latin_tokens": f"""WITH w AS (SELECT segment_id, unnest({WORDS}) AS word FROM turns)
        SELECT segment_id, count(DISTINCT word) FILTER (length(regexp_replace(word, '[^a-z]', '', 'g')) >= 0.75 * length(word)) AS latin, count(DISTINCT word) AS words FROM w GROUP BY 1""",
    "t38_duration_outliers": "SELECT project_id, count(*) AS turns, count(*) FILTER (latency_ms / (output_tokens / 130.0 * 60000) < 0.35 OR latency_ms / (output_tokens / 130.0 * 60000) > 1.65) AS outliers FROM model_calls WHERE output_tokens > 0 GROUP BY 1",
    "t39_error_classes": f"SELECT stage, {_CLASS} AS class, count(*) AS calls FROM model_calls WHERE status <> 'succeeded' GROUP BY ALL",
    "t47_retry_rules": f"""WITH c AS (SELECT *, {_CLASS} AS class FROM model_calls WHERE status <> 'succeeded'), u AS (SELECT class, row_number() OVER (PARTITION BY trace_id, class ORDER BY call_id) - 1 AS used FROM c)
        SELECT class, count(*) AS errors, count(*) FILTER (used < CASE class WHEN 'transport' THEN 2 WHEN 'structural' THEN 0 ELSE 1 END) AS retried FROM u GROUP BY 1""",
    "t45_sentences": f"SELECT speaker, sum(len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: len({_WORDS.format(x='s')}) >= 4)))::BIGINT AS sentences, count(*) AS turns FROM turns GROUP BY 1",
    "t46_revised_turns": """WITH t AS (SELECT *, lead(text) OVER (PARTITION BY segment_id, speaker ORDER BY position) AS after FROM turns)
        SELECT segment_id, sum(greatest(length(text), coalesce(length(after), 0)))::BIGINT AS characters, count(*) FILTER (length(after) > length(text)) AS revised FROM t GROUP BY 1""",
    "t49_idle_fillers": f"SELECT segment_id, count(*) FILTER (len({WORDS}) < 25 AND coalesce(({WORDS})[1], '') IN ({_FILL})) AS fillers FROM turns GROUP BY 1",
    "t50_speaker_turns": "SELECT segment_id, speaker, count(*) AS turns FROM turns GROUP BY 1, 2",
    "t54_durations": f"SELECT segment_id, sum(len({WORDS})) / 130.0::DOUBLE AS minutes FROM turns GROUP BY 1",
    "t56_first_sentences": f"SELECT segment_id, md5(min(trim({FIRST}))) AS least_md5, max(length(trim({FIRST})))::INT AS longest FROM turns GROUP BY 1",
    "t57_policies": "SELECT stage, count(*) AS calls, CASE stage WHEN 'A' THEN 3 WHEN 'R' THEN 1 ELSE 2 END AS attempts, CASE stage WHEN 'A' THEN 2.0 WHEN 'R' THEN 5.0 ELSE 1.0 END::DOUBLE AS base FROM model_calls GROUP BY 1",
    "o04_experiment_summary": """SELECT run_id, count(*) AS calls, sum(input_tokens)::BIGINT AS tokens, string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(DISTINCT (model, provider)) FILTER (cost_micros IS NULL) AS unpriced,
        median(latency_ms)::DOUBLE AS p50, quantile_disc(latency_ms, 0.95)::DOUBLE AS p95 FROM model_calls WHERE stage = 'A' GROUP BY 1""",
    "o31_derived_rates": """SELECT run_id, stage, count(*) FILTER (status = 'failed') / count(*)::DOUBLE AS failure_rate, sum(output_tokens)::DOUBLE / nullif(count(*) FILTER (status = 'succeeded'), 0) AS claims_per_kept FROM model_calls GROUP BY 1, 2""",
    "o09_trace_nodes_in_order": """WITH n AS (SELECT trace_id, span_id AS node_id, started_at FROM spans UNION ALL SELECT trace_id, 'c' || call_id, started_at FROM model_calls)
        SELECT trace_id, node_id, row_number() OVER (PARTITION BY trace_id ORDER BY started_at, node_id)::INT AS place FROM n""",
    "o23_runs_newest_first": """WITH r AS (SELECT project_id, run_id, max(started_at) AS latest, count(*) AS calls FROM model_calls WHERE NOT is_synthetic GROUP BY 1, 2)
        SELECT project_id, run_id, calls, row_number() OVER (PARTITION BY project_id ORDER BY latest DESC, run_id)::INT AS place FROM r QUALIFY place <= 3""",
    "o26_project_events": "SELECT project_id, event_id, name, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC)::INT AS place FROM core_events QUALIFY place <= 20",
    "o32_masked_texts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lpad((doc_id % 1000000000)::VARCHAR, 9, '0') AS n FROM documents), m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        t || ' AIza' || n || n || n || ' sk-' || n || n || n || ' 00989' || n || ' C:\Users\u' || doc_id || ' /home/u' || doc_id, 'AIza[A-Za-z0-9_\-]{20,}', '[REDACTED_GEMINI_KEY]', 'g'), 'sk-[A-Za-z0-9_\-]{20,}', '[REDACTED_SECRET]', 'g'),
        '(0098|[+]98|0)9\d{9}', '[REDACTED_PHONE]', 'g'), '[a-zA-Z]:[\\]Users[\\][^\\/\s]+', '[HOME]', 'g'), '/home/[^/\s]+', '[HOME]', 'g') AS t FROM d) SELECT doc_id, md5(t) AS text_md5, length(t)::INT AS characters FROM m""",
    "o33_redacted_payloads": """SELECT doc_id, '[REDACTED]' AS api_key, sha256(coalesce(text, '')) || ':' || length(coalesce(text, '')) AS content, substring(sha256(source || '.pdf'), 1, 8) || '.pdf' AS filename, coalesce(lang, '') AS lang FROM documents""",
    "o34_sensitive_keys": """SELECT key, contains(k, 'api_key') OR contains(k, 'token') OR contains(k, 'password') OR contains(k, 'secret') OR contains(k, 'authorization') AS sensitive FROM (SELECT DISTINCT source || '-' || w AS key,
        lower(replace(source || '-' || w, '-', '_')) AS k FROM documents, (VALUES ('Api-Key'), ('X-TOKEN'), ('Pass-Word'), ('colour'), ('client-SECRET')) AS v(w) WHERE source IS NOT NULL)""",
    "o35_cache_lineage": """SELECT project_id, CASE k % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'miss' ELSE 'stale' END AS result, CASE WHEN k % 3 = 2 THEN CASE WHEN stage > 4 THEN 'identity_changed' ELSE 'expired' END ELSE 'none' END AS reason,
        count(*) AS lookups, sum(CASE WHEN k % 3 = 0 THEN stage ELSE 0 END)::BIGINT AS avoided_calls FROM flow_events WHERE NOT is_synthetic GROUP BY ALL""",
    "o36_resolved_ids": """WITH i AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'o' ELSE 'r' END || (o_orderkey + 5) AS id FROM orders)
        SELECT CASE WHEN id IN (SELECT run_id FROM model_calls) THEN 'run' WHEN id IN (SELECT trace_id FROM model_calls) THEN 'trace' ELSE 'unknown' END AS kind, count(*) AS ids FROM i GROUP BY 1""",
    "o39_spans_in_order": "SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY started_at, span_id)::INT AS place FROM spans",
    "o40_events_in_order": "SELECT user_id, event_id, row_number() OVER w::INT AS place, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS micros_since FROM core WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "o41_trace_statistics": """SELECT trace_id, first(span_id ORDER BY parent_id IS NOT NULL, started_at, span_id) AS span_id, first(name ORDER BY parent_id IS NOT NULL, started_at, span_id) AS name, count(*) AS spans,
        max(epoch_ms(started_at) + duration_ms) - min(epoch_ms(started_at)) AS wall_ms FROM spans GROUP BY 1""",
    "o42_durations": """SELECT l_returnflag, sum(CASE WHEN l_linenumber % 3 <> 0 THEN floor(l_extendedprice) WHEN l_linenumber % 2 = 0 THEN 90000 ELSE 0 END)::BIGINT AS duration_ms, count(*) FILTER (l_linenumber % 3 = 0 AND l_linenumber % 2 <> 0) AS unknown
        FROM lineitem GROUP BY 1""",
    "o43_quarantined_calls": "SELECT CASE WHEN project_id IS NULL THEN 'project_id' WHEN trace_id IS NULL THEN 'trace_id' WHEN model IS NULL THEN 'model' WHEN cost_micros IS NULL THEN 'cost_ref' ELSE 'accepted' END AS reason, count(*) AS calls FROM model_calls GROUP BY 1",
    "o44_review_decisions": """SELECT gate_name, CASE name WHEN 'gate.resolved' THEN 'accepted' WHEN 'gate.blocked' THEN 'rejected' ELSE 'regenerated' END AS disposition, count(*) AS decisions, count(DISTINCT user_id) AS reviewers
        FROM gate_events WHERE NOT is_synthetic AND name IN ('gate.resolved', 'gate.blocked', 'workflow.rewound') GROUP BY ALL""",
    "o45_quality_labels": "SELECT source, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS labels, avg(toxic)::DOUBLE AS score FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
}
