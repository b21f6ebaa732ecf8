"""Documents as tables of blocks: identity, packing, heading runs, parse quality and parser scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import as_symbols, collapse, fold_for_match, share, token_estimate
from heddle.sources.views import blocks, table



def by_doc():
    return Window.partitionBy("doc_id").orderBy("idx")


def b03_html_blocks(spark, sf_dir):
    """Paragraphs, headings and list items of pages, scripts and styles dropped, tags stripped."""
    bare = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<nav.*?</nav>", " ")
    found = F.concat(*[F.regexp_extract_all(F.col("bare"), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)) for tag in ("p", "h1", "h2", "h3", "li")])
    clean = F.filter(F.transform(found, lambda x: collapse(F.regexp_replace(x, "(?s)<[^>]*>", " "))), lambda x: x != "")
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce(bare, F.lit("")).alias("bare")).select("page_id", clean.alias("b"))
    return pages.select("page_id", F.size("b").cast("long").alias("blocks"), F.md5(F.array_join("b", "\n").cast("binary")).alias("text_md5"))


def b07_repeated_margins(spark, sf_dir, repetitions: int = 3, characters: int = 160):
    """Short texts that repeat on three or more pages of a document go, headings never."""
    b = blocks(spark, sf_dir).withColumn("norm", F.lower(collapse(F.col("text"))))
    margin = b.where(~F.col("is_heading") & (F.length("norm") <= characters)).groupBy("doc_id", "norm").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))
    margin = margin.where((F.col("n") >= repetitions) & (F.col("pages") >= repetitions)).select("doc_id", "norm", F.lit(True).alias("margin"))
    marked = b.join(margin, ["doc_id", "norm"], "left")
    gone = F.coalesce("margin", F.lit(False)) & ~F.col("is_heading")
    return marked.groupBy("doc_id").agg(F.count_if(gone).alias("dropped"), F.count_if(~gone).alias("kept"))


def b15_block_identity(spark, sf_dir):
    """Ids by content and place, token estimates, and the neighbours' ids."""
    b = blocks(spark, sf_dir)
    key = F.concat(F.lit("blk-"), F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), F.lit("-"), F.lpad(F.col("idx").cast("string"), 5, "0"), F.lit("-"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12))
    named = b.select("doc_id", "idx", key.alias("block_id"), token_estimate(F.col("text")).alias("tokens"))
    return named.select("doc_id", "idx", "block_id", "tokens", F.lag("block_id").over(by_doc()).alias("previous_id"), F.lead("block_id").over(by_doc()).alias("next_id"))


def pack_in_order(items: Column, target: int, most: int) -> Column:
    """Greedy bins over an ordered array of structs (tokens, alone): an array of bin numbers.

    A bin is closed before an item that would pass ``most`` or stands alone, after one that stands alone,
    and once it has ``target``."""
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("held"), F.lit(False).alias("shut"), F.array().cast("array<int>").alias("bins"))

    def step(state, item):
        anew = (state["held"] > 0) & (state["shut"] | item["alone"] | (state["held"] + item["tokens"] > most) | (state["held"] >= target))
        number = F.when(anew, state["bin"] + 1).otherwise(state["bin"])
        held = F.when(anew, F.lit(0).cast("long")).otherwise(state["held"]) + item["tokens"]
        return F.struct(number.alias("bin"), held.alias("held"), item["alone"].alias("shut"), F.concat(state["bins"], F.array(number)).alias("bins"))

    return F.aggregate(items, start, step, lambda s: s["bins"])


def b09_packed_blocks(spark, sf_dir, target: int = 120, most: int = 180):
    """Consecutive blocks packed under a token budget; only numbers travel, the text stays in its table.

    The production budgets are 1200 and 1800; smaller ones here give several bins to a document."""
    b = blocks(spark, sf_dir).select("doc_id", "idx", token_estimate(F.col("text")).alias("tokens"), F.col("is_heading").alias("alone"))
    docs = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "tokens", "alone"))).alias("items"))
    binned = docs.select("doc_id", "items", pack_in_order(F.col("items"), target, most).alias("bins"))
    flat = binned.select("doc_id", F.explode(F.arrays_zip("items", "bins")).alias("x")).select("doc_id", "x.items.idx", "x.items.tokens", F.col("x.bins").alias("bin"))
    return flat.groupBy("doc_id", "bin").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"), F.min("idx").alias("first_idx"))


def b19_equal_documents(spark, sf_dir):
    """Documents with the same folded lines in the same order."""
    lines = blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", fold_for_match(F.col("text")).alias("t")))).alias("l"))
    keys = lines.select("doc_id", F.sha2(F.array_join(F.transform("l", lambda x: x["t"]), "\x1f").cast("binary"), 256).alias("content_key"))
    return keys.groupBy("content_key").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def heading_runs(spark, sf_dir) -> DataFrame:
    """Islands: a heading starts a run; blocks before the first heading are run 0."""
    return blocks(spark, sf_dir).withColumn("run", F.sum(F.col("is_heading").cast("int")).over(by_doc()))


def b27_heading_runs(spark, sf_dir):
    r = heading_runs(spark, sf_dir)
    return r.groupBy("doc_id", "run").agg(F.count("*").alias("blocks"), F.min("idx").alias("first_idx"), F.sum(token_estimate(F.col("text"))).alias("tokens"), F.min(F.when(F.col("is_heading"), F.col("text"))).alias("heading"))


def b29_heading_heuristic(spark, sf_dir):
    runs = heading_runs(spark, sf_dir).groupBy("doc_id", "run").agg(F.count("*").alias("n"))
    by = runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.median("n").alias("median_size"), (F.max("n") / F.sum("n")).alias("max_share"))
    return by.withColumn("passes", (F.col("runs") >= 2) & (F.col("median_size") >= 8) & (F.col("max_share") <= 0.6))


def b53_script_kind(spark, sf_dir):
    """Latin or Arabic if it has three quarters of the letters of both, else mixed; unknown without any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[A-Za-zÀ-ɏ]")).alias("latin"), F.regexp_count("text", F.lit(r"[؀-ۿ]")).alias("arabic"))
    whole = F.col("latin") + F.col("arabic")
    kind = F.when(F.coalesce(whole, F.lit(0)) == 0, "unknown").when(F.col("latin") >= 0.75 * whole, "latin").when(F.col("arabic") >= 0.75 * whole, "arabic").otherwise("mixed")
    return docs.select("doc_id", F.coalesce("latin", F.lit(0)).cast("long").alias("latin"), F.coalesce("arabic", F.lit(0)).cast("long").alias("arabic"), kind.alias("script"))


#: Patterns of damaged text, mathematics and tables.
DAMAGED = r"\x{FFFD}|\x00|[|Il1]{8,}|[^\p{L}\p{N}_\s]{12,}"
LATEX = r"\\(?:frac|sum|prod|int|mathrm|mathbf|left|right|begin|end|alpha|beta|gamma|delta|theta|lambda|sigma|omega|partial|infty|cdot|times|leq|geq|neq)\b"
DISPLAY = r"\$\$[^$]+\$\$|\\\[[^\]]+\\\]|\\\([^)]+\\\)"
INLINE = r"(?<!\$)\$(?!\$)[^$\n]{1,120}\$(?!\$)"
SYMBOLS = "[∑∏∫∂∇∞≈≠≤≥±×·√∈∉⊂⊃∀∃→←⇒⇔αβγδθλμσφω]"
PIPE_ROW = r"(?m)^[ \t]*\|.+\|[ \t]*$"
TAB_ROW = r"(?m)^[^\t\n]+\t+[^\t\n]+(?:\t+[^\t\n]+)+$"


def math_strength(latex: Column, inline: Column, display: Column, symbols: Column) -> Column:
    """0 to 3."""
    return (
        F.when((latex >= 4) | ((latex >= 2) & (inline >= 2)) | (symbols >= 10), 3)
        .when((latex >= 2) | (display >= 1) | ((latex >= 1) & (inline >= 1)), 2)
        .when((latex >= 1) | (inline >= 2) | (symbols >= 4), 1)
        .otherwise(0)
    )


def table_strength(pipes: Column, tabs: Column) -> Column:
    most = F.greatest(pipes, tabs)
    return F.when(most >= 4, 3).when(most >= 2, 2).when(most >= 1, 1).otherwise(0)


def quality_features(spark, sf_dir) -> DataFrame:
    """One row for each document with blocks or without: what the rules read."""
    b = blocks(spark, sf_dir)
    flat = b.select("doc_id", collapse(F.col("text")).alias("flat")).where(F.length("flat") >= 80)
    long_texts = flat.groupBy("doc_id", F.lower("flat").alias("norm")).agg(F.count("*").alias("n"))
    repeated = long_texts.groupBy("doc_id").agg(share(F.sum((F.col("n") - 1) * F.length("norm")), F.sum(F.col("n") * F.length("norm"))).alias("duplicate_ratio"))
    back = F.when(F.col("page") < F.lag("page").over(by_doc()), 1.0).otherwise(0.0)
    per_doc = b.withColumn("back", back).groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"), F.avg(F.col("text").rlike(DAMAGED).cast("double")).alias("corruption_ratio"),
        F.bool_or("is_heading").alias("has_heading"), F.count_if("is_heading").alias("headings"), F.sum("back").alias("backs"), F.countDistinct("page").alias("pages"), F.max("page").alias("last_page"),
    )
    t = F.coalesce("text", F.lit(""))
    found = {name: F.regexp_count(t, F.lit(p)) for name, p in (("latex", LATEX), ("inline", INLINE), ("display", DISPLAY), ("pipes", PIPE_ROW), ("tabs", TAB_ROW))}
    found["symbols"] = F.length(t) - F.length(F.translate(t, SYMBOLS.strip("[]"), ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", *[c.alias(name) for name, c in found.items()])  # counted once, read often
    strengths = math_strength(*[F.col(c) for c in ("latex", "inline", "display", "symbols")]).alias("math"), table_strength(F.col("pipes"), F.col("tabs")).alias("table")
    docs = docs.select("doc_id", "source", *strengths)
    joined = docs.join(per_doc, "doc_id", "left").join(repeated, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("blocks", "characters", "headings", "pages", "last_page")}
    joined = joined.withColumns(zero | {"duplicate_ratio": F.coalesce("duplicate_ratio", F.lit(0.0)), "corruption_ratio": F.coalesce("corruption_ratio", F.lit(0.0)), "has_heading": F.coalesce("has_heading", F.lit(False))})
    return joined.withColumn("order_ratio", F.when(F.col("blocks") >= 8, F.col("backs") / (F.col("blocks") - 1)).otherwise(0.0))


def judged(features: DataFrame) -> DataFrame:
    """Adds issues (kind:severity), their number and the verdict."""
    issue = lambda when, kind, severity: F.when(when, F.concat(F.lit(kind + ":"), severity if isinstance(severity, Column) else F.lit(severity)))
    grade = lambda c, high: F.when(F.col(c) >= high, "high").otherwise("medium")
    some = F.col("blocks") > 0
    issues = F.array_compact(
        F.array(
            issue(~some, "missing_text", "blocking"),
            issue(some & (F.col("characters") < 200), "missing_text", "medium"),
            issue(some & (F.col("duplicate_ratio") >= 0.25), "repetition", grade("duplicate_ratio", 0.5)),
            issue(some & (F.col("corruption_ratio") >= 0.02), "ocr_corruption", grade("corruption_ratio", 0.08)),
            issue((F.col("blocks") >= 12) & ~F.col("has_heading"), "lost_headings", "medium"),
            issue(some & (F.col("math") >= 1), "formula_damage", grade("math", 2)),
            issue(some & (F.col("table") >= 2) & (F.col("last_page") >= 2), "table_damage", grade("table", 3)),
            issue(some & (F.col("order_ratio") >= 0.15), "wrong_reading_order", grade("order_ratio", 0.3)),
        )
    )
    has = lambda s: F.exists("issues", lambda x: x.endswith(":" + s))
    verdict = F.when(has("blocking"), "manual_review").when(has("high"), "retry").when(has("medium"), "warning").otherwise("pass")
    return features.withColumn("issues", issues).withColumns({"issue_count": F.size("issues"), "verdict": verdict})


def q01_parse_quality(spark, sf_dir):
    j = judged(quality_features(spark, sf_dir))
    return j.select("doc_id", "blocks", "duplicate_ratio", "corruption_ratio", F.array_join("issues", ",").alias("issues"), "verdict", F.col("verdict").isin("pass", "warning").alias("safe"))


def score(j: DataFrame) -> Column:
    """0 to 100 from the verdict, coverages and penalties."""
    safe = F.col("verdict").isin("pass", "warning")
    base = F.when(F.col("verdict") == "pass", 60.0).when(F.col("verdict") == "warning", 48.0).when(F.col("verdict") == "retry", 20.0).otherwise(5.0)
    located = F.when(F.col("blocks") > 0, 1.0).otherwise(0.0)
    pages = F.coalesce(share(F.col("pages"), F.col("last_page")), F.lit(0.0))
    headings = F.coalesce(share(F.col("headings"), F.col("blocks")), F.lit(0.0))
    s = base + 12 * located + 12 * pages + 8 * F.least(headings * 4, F.lit(1.0)) + F.when(safe, 8.0).otherwise(0.0) - 12 * F.col("duplicate_ratio") - F.least(F.col("issue_count") * 2.0, F.lit(10.0))
    s = s - F.when(F.col("math") >= 2, 8.0).when(F.col("math") >= 1, 4.0).otherwise(0.0) - F.when(F.col("table") >= 2, 6.0).when(F.col("table") >= 1, 3.0).otherwise(0.0) - F.least(F.col("order_ratio") * 20, F.lit(10.0))
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(100.0))


def q11_document_scores(spark, sf_dir):
    j = judged(quality_features(spark, sf_dir))
    return j.select("doc_id", score(j).alias("score"))


def q14_source_scores(spark, sf_dir):
    """Documents, safe ones, mean score and the best document of each source."""
    j = judged(quality_features(spark, sf_dir))
    s = j.withColumn("score", score(j)).withColumn("safe", F.col("verdict").isin("pass", "warning"))
    return s.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("safe").alias("safe_documents"), F.avg("score").alias("mean_score"), F.max_by("doc_id", F.struct("safe", F.round("score", 6), -F.col("doc_id"))).alias("best_doc"))


def q20_first_results(spark, sf_dir, most: int = 12):
    """First page of each URL, at most 12 for a host, by page number."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))).alias("host")).where("url is not null")
    first = p.groupBy("host", "url").agg(F.min("page_id").alias("page_id"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where(F.col("place") <= most).select("host", "url", "page_id", "place")


def q22_gates(spark, sf_dir):
    """Rates over the labelled documents against thresholds; a gate without a value is skipped."""
    joined = table(spark, sf_dir, "labels").join(judged(quality_features(spark, sf_dir)), "doc_id")
    rates = joined.agg(F.avg(F.col("quality").cast("double")).alias("quality"), F.avg((F.col("verdict") == "retry").cast("double")).alias("retried"), F.avg((F.col("blocks") == 0).cast("double")).alias("empty"))
    long_form = rates.unpivot([], ["quality", "retried", "empty"], "gate", "value")
    at_least, limit = F.col("gate") == "quality", F.when(F.col("gate") == "quality", 0.8).when(F.col("gate") == "retried", 0.05).otherwise(0.0)
    held = F.when(at_least, F.col("value") >= limit).otherwise(F.col("value") <= limit)
    return long_form.select("gate", "value", limit.alias("threshold"), F.when(F.col("value").isNull(), "skipped").when(held, "passed").otherwise("failed").alias("status"))


def q29_text_metrics(spark, sf_dir):
    """Each benchmark item against the next, whole texts: edit distances and error rates in characters and in words."""
    items = table(spark, sf_dir, "benchmark").select("item_id", collapse(F.coalesce("text", F.lit(""))).alias("t"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    pairs = items.join(after, "item_id").withColumns({"v": words(F.col("t")), "w": words(F.col("u"))}).withColumn("known", F.array_distinct(F.concat("v", "w")))
    d, dw = F.levenshtein("t", "u"), F.levenshtein(as_symbols(F.col("v"), F.col("known")), as_symbols(F.col("w"), F.col("known")))
    return pairs.select(
        "item_id", d.cast("long").alias("distance"), (d / F.greatest(F.length("t"), F.lit(1))).alias("error_rate"), dw.cast("long").alias("word_distance"),
        (dw / F.greatest(F.size("v"), F.lit(1))).alias("word_error_rate"), (F.col("t") == F.col("u")).alias("exact"),
    )


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] in "bq" and name[1:3].isdigit()}
