"""Script turns and text pairs: runs, repetition, balance, segmentation, retries and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import edit_similarity, fold_for_sound, jaccard, share
from heddle.operators.documents import pack_in_order
from heddle.operators.evidence import word_list
from heddle.sources.views import lines_of, model_calls, product_events, real, table, turns


def in_order(key: str = "segment_id", *order: str):
    return Window.partitionBy(key).orderBy(*(order or ("position",)))


def t02_speaker_runs(spark, sf_dir, most: int = 1):
    """Islands: runs of one speaker longer than ``most`` turns (3 in production), short turns left out."""
    t = turns(spark, sf_dir).where(F.length("text") >= 400)
    new = F.when(F.col("speaker") == F.lag("speaker").over(in_order()), 0).otherwise(1)
    runs = t.withColumn("new", new).withColumn("run", F.sum("new").over(in_order()))
    by = runs.groupBy("segment_id", "run", "speaker").agg(F.count("*").alias("turns"), F.min("position").alias("first_position"))
    return by.where(F.col("turns") > most).select("segment_id", "speaker", "turns", "first_position")


def shingles(df: DataFrame, size: int = 3) -> DataFrame:
    """Adds ``grams``: the distinct runs of three words of ``text``."""
    worded = df.withColumn("w", word_list(F.col("text"))).where(F.size("w") >= size)
    return worded.withColumn("grams", F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))))


def lines_with_likes(docs: DataFrame, least: float, size: int = 3) -> DataFrame:
    """(doc_id, idx, text) of the lines of ``docs`` (doc_id, text) that may be as similar as ``least`` to another of their document: at least that
    part of a line's runs of words is in another line too, which a document's own row tells.  All lines of a doc_id with several rows."""
    grams = lambda w: F.when(F.size(w) >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))))).otherwise(F.array().cast("array<bigint>"))
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.lit(True).alias("several"))
    rows = docs.withColumn("several", F.lit(False)) if several.isEmpty() else docs.join(several, docs["doc_id"].eqNullSafe(F.col("_id")), "left").drop("_id")
    rows = rows.select("doc_id", F.coalesce("several", F.lit(False)).alias("several"), lines_of("text").alias("lines"))
    rows = rows.withColumn("sets", F.transform(F.transform("lines", lambda x: word_list(x)), grams))
    rows = rows.withColumn("all", F.array_sort(F.flatten("sets")))
    rows = rows.withColumn("met", F.array_distinct(F.filter("all", lambda h, i: h == F.get(F.col("all"), i + 1))))
    likely = lambda s: F.col("several") | ((F.size(s) > 0) & (F.size(F.array_intersect(s, F.col("met"))) >= F.size(s) * least - 1e-6))
    kept = F.zip_with("lines", "sets", lambda x, s: F.when(likely(s), x))
    return rows.select("doc_id", F.posexplode_outer(kept).alias("idx", "text")).where("text is not null").withColumn("idx", F.col("idx").cast("long"))


def t03_near_repeats(spark, sf_dir, least: float = 0.6):
    """Pairs of different places of a document whose texts have a trigram similarity of 0.6 or more.

    Only lines that share enough of their grams with others go on.  Equal texts are one row with all their places first.  Prefix filter: two sets can only be that similar
    if they share one of their rarest grams, so candidates meet on those alone and are then compared
    exactly."""
    same = lines_with_likes(table(spark, sf_dir, "documents").select("doc_id", "text"), least).groupBy("doc_id", "text").agg(F.min("idx").alias("position"), F.count("*").alias("times"))
    t = shingles(same).select("doc_id", "position", "times", "grams")
    each = t.select("doc_id", "position", F.size("grams").alias("size"), F.explode_outer("grams").alias("gram"))  # outer: else a filter on the grams moves below the words
    rarity = each.groupBy("doc_id", "gram").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("doc_id", "position").orderBy("df", "gram"))
    prefix = each.join(rarity.where("df > 1"), ["doc_id", "gram"], "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("place", place)
    prefix = prefix.where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1) & (F.col("df") > 1)).select("doc_id", "position", "gram")
    pairs = prefix.join(prefix.withColumnRenamed("position", "later"), ["doc_id", "gram"]).where("position < later").select("doc_id", "position", "later").distinct()
    sets = t.select("doc_id", "position", "grams")
    both = pairs.join(sets, ["doc_id", "position"]).join(sets.select("doc_id", F.col("position").alias("later"), F.col("grams").alias("others")), ["doc_id", "later"])
    near = both.select("doc_id", "position", "later", jaccard(F.col("grams"), F.col("others")).alias("similarity")).where(F.col("similarity") >= least)
    exact = t.where("times > 1").select("doc_id", "position", F.col("position").alias("later"), F.lit(1.0).alias("similarity"))
    return near.unionByName(exact)


def t05_opening_repeats(spark, sf_dir):
    """Openings of four words that several turns share, all conversations together."""
    opening = F.array_join(F.slice(word_list(F.col("text")), 1, 4), " ")
    t = turns(spark, sf_dir).select("segment_id", opening.alias("opening"), F.size(word_list(F.col("text"))).alias("n")).where("n >= 4")
    return t.groupBy("opening").agg(F.count("*").alias("turns"), F.countDistinct("segment_id").alias("segments")).where("turns > 1")


def t13_durations(spark, sf_dir, rate: int = 130, target: float = 2.0):
    """Minutes at 130 words, and whether they are within 80 to 120 percent of the target."""
    by = turns(spark, sf_dir).groupBy("segment_id").agg(F.sum(F.size(word_list(F.col("text")))).alias("words"))
    minutes = F.col("words") / rate
    return by.select("segment_id", "words", minutes.alias("minutes"), minutes.between(0.8 * target, 1.2 * target).alias("in_range"))


def t14_balance(spark, sf_dir):
    n = lambda s: F.count_if(F.col("speaker") == s)
    return turns(spark, sf_dir).groupBy("segment_id").agg(
        F.count("*").alias("turns"), n("editorial").alias("editorial"), share(n("editorial"), F.count("*")).alias("editorial_share"), share(F.abs(n("A") - n("B")), n("A") + n("B")).alias("skew"),
        share(F.count_if(F.length("text") >= 200), F.count("*")).alias("substantive_share"),
    )


def t06_specifics(spark, sf_dir):
    """Numbers of two digits or more and quoted spans of a turn that the turn before does not hold."""
    found = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"([0-9]{2,})")), F.regexp_extract_all("text", F.lit(r"([A-ZÉÈ][a-zà-ÿ]{7,})"))))
    t = turns(spark, sf_dir).withColumns({"found": found, "before": F.coalesce(F.lag("text").over(in_order()), F.lit(""))})
    alone = F.filter("found", lambda x: ~F.contains(F.col("before"), x))
    return t.groupBy("segment_id").agg(F.sum(F.size("found")).alias("specifics"), F.sum(F.size(alone)).alias("unsupported"))


def t20_rolling_rules(spark, sf_dir):
    """Runs whose last two or five finished calls mostly failed, by rolling windows over the run's calls."""
    w = lambda n: in_order("run_id", "started_at", "call_id", "latency_ms").rowsBetween(1 - n, 0)
    bad = (F.col("status") == "failed").cast("int")
    c = model_calls(spark, sf_dir).withColumns({"two": F.sum(bad).over(w(2)), "five": F.sum(bad).over(w(5)), "ten": F.sum(bad).over(w(10))})
    return c.groupBy("run_id").agg(F.count_if(F.col("two") >= 2).alias("two_in_a_row"), F.count_if(F.col("five") >= 3).alias("three_of_five"), F.count_if(F.col("ten") >= 5).alias("five_of_ten"))


def t27_arms(spark, sf_dir):
    """Metrics of the speakers side by side: a pivot with its values given, so that no job looks for them."""
    words = F.size(word_list(F.col("text")))
    arms = turns(spark, sf_dir).groupBy("segment_id").pivot("speaker", ["A", "B"]).agg(F.count(F.lit(1)).alias("turns"), F.sum(words).alias("words"))
    return arms.select("segment_id", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("A_turns", "A_words", "B_turns", "B_words")])


def t31_segments(spark, sf_dir, most: int = 300):
    """Sentences of each turn packed in order into chunks of at most 300 characters (900 in production)."""
    sentences = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")
    t = turns(spark, sf_dir).select("segment_id", "position", F.transform(sentences, lambda s: F.struct(F.length(s).cast("long").alias("tokens"), F.lit(False).alias("alone"))).alias("items")).where(F.size("items") > 0)
    packed = t.select("segment_id", "position", "items", pack_in_order(F.col("items"), most, most).alias("bins"))
    return packed.groupBy("segment_id").agg(F.sum(F.size("items")).alias("sentences"), F.sum(F.array_max("bins") + 1).alias("chunks"))


def t35_repeated_phrases(spark, sf_dir, size: int = 6):
    """Runs of six words that a turn holds twice or more."""
    worded = turns(spark, sf_dir).select("segment_id", "position", word_list(F.col("text")).alias("w")).where(F.size("w") >= 12)
    grams = worded.select("segment_id", "position", "w", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i")).select("segment_id", "position", F.array_join(F.slice("w", F.col("i"), size), " ").alias("phrase"))
    return grams.groupBy("segment_id", "position", "phrase").agg(F.count("*").alias("times")).where("times >= 2")


def cut_tail(expected: Column, actual: Column) -> Column:
    """Whether the last six words of one array aren't like the last ten of another; false where there are none."""
    tail = lambda words, n: F.array_join(F.slice(words, -F.least(F.lit(n), F.greatest(F.size(words), F.lit(1))), n), " ")
    return (F.size(expected) > 0) & (edit_similarity(tail(expected, 6), tail(actual, 10)) < 0.55)


def next_turns(spark, sf_dir) -> DataFrame:
    """Each turn with the next one of its segment: their folded texts a, b and words v, w."""
    t = turns(spark, sf_dir).select("segment_id", "position", fold_for_sound(F.col("text")).alias("a")).withColumn("b", F.lead("a").over(in_order())).where("b is not null")
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    return t.withColumns({"v": words(F.col("a")), "w": words(F.col("b"))})


def t36_cut_tails(spark, sf_dir):
    """Turns whose last six words aren't like the last ten of the next turn."""
    return next_turns(spark, sf_dir).select("segment_id", "position", cut_tail(F.col("v"), F.col("w")).alias("cut"))


def t40_identical_retries(spark, sf_dir):
    """Consecutive calls of a run with the same stage, model and status: a retry that would repeat itself."""
    mark = F.concat_ws("|", "stage", "model", "status")
    order = in_order("run_id", "started_at", "call_id", "latency_ms")
    c = model_calls(spark, sf_dir).withColumn("mark", mark)
    return c.withColumn("before", F.lag("mark").over(order)).where("mark = before").groupBy("run_id").agg(F.count("*").alias("repeats"), F.countDistinct("mark").alias("marks"))


def t41_backoff(spark, sf_dir, base: float = 2.0, most: int = 3):
    """Delay before each further attempt, and why the last one stops."""
    place = F.row_number().over(in_order("run_id", "started_at", "call_id", "latency_ms"))
    c = model_calls(spark, sf_dir).where("status <> 'succeeded'").withColumn("attempt", place)
    stop = F.when(F.col("status") == "rejected", "not_retryable").when(F.col("attempt") >= most, "attempts_used").otherwise("retry")
    delay = F.when(stop == "retry", F.lit(base) * F.pow(F.lit(2.0), F.col("attempt") - 1))
    return c.groupBy("run_id").agg(F.sum(delay).alias("delay"), F.count_if(stop == "retry").alias("retried"), F.count_if(stop == "not_retryable").alias("refused"))


#: Stages a project may enter next are the same or the next one.
def t43_transitions(spark, sf_dir):
    """Moves between stages that skip ahead or go back, by pair."""
    e = real(product_events(spark, sf_dir)).where("name = 'project.stage_entered'")
    moved = e.withColumn("from_stage", F.lag("stage").over(in_order("project_id", "ts", "event_id"))).where("from_stage is not null")
    return moved.where("stage <> from_stage and stage <> from_stage + 1").groupBy("from_stage", "stage").agg(F.count("*").alias("moves"), F.countDistinct("project_id").alias("projects"))


def t51_start_times(spark, sf_dir, rate: float = 14.0, gap: float = 0.5):
    """Start of each turn: what all earlier ones take at 14 characters a second, and the gaps."""
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    seconds = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) / rate + gap * F.count("*").over(before)
    return turns(spark, sf_dir).select("segment_id", "position", seconds.alias("starts_at"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "t" and name[1:3].isdigit()}
