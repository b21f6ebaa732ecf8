"""What several earlier operators meet in: metrics of parsers side by side, texts normalised for comparison, spoken chunks, chapters by two
detectors, neighbours of a block, and judgements with all that they rest on."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import collapse, share
from heddle.operators.documents import pack_in_order
from heddle.operators.graphs import g01_selected_cells
from heddle.operators.splitting import with_paths
from heddle.operators.structure import KIND, block_kind
from heddle.sources.views import blocks, evidence, product_events, table, turns

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that executors need no copy of this package


# Parsers


def parser_metrics(b: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each parse (``keys``) of blocks (idx, page, text, kind, is_heading, path): coverage of headings and pages, repeated characters
    among texts of 80 and more, order of pages, size and number of blocks.

    Texts are counted before they are compared, so that one that a parse repeats is a row with a number."""
    norm = F.lower(collapse(F.col("text")))
    long = b.withColumn("norm", norm).where(F.length("norm") >= 80).groupBy(*keys, "norm").agg(F.count("*").alias("n"))
    repeated = long.groupBy(*keys).agg(F.sum(F.length("norm") * F.col("n")).alias("_all"), F.sum(F.length("norm") * (F.col("n") - 1)).alias("_again"))
    back = F.col("page") < F.lag("page").over(Window.partitionBy(*keys).orderBy("idx"))
    by = b.withColumns({"back": back.cast("int"), "headed": F.col("is_heading") | (F.size("path") > 0)}).groupBy(*keys).agg(
        F.count("*").alias("block_count"), F.sum(F.length("text")).alias("text_characters"), F.avg(F.col("headed").cast("double")).alias("heading_coverage"), F.count_distinct("page").alias("pages"), F.max("page").alias("page_count"),
        F.count_if(F.col("kind") == "formula").alias("formula_blocks"), F.count_if(F.col("kind") == "table").alias("table_blocks"), F.sum("back").alias("_back"), F.count("back").alias("_steps"), F.avg(F.length("text")).alias("mean_block_chars"),
    )
    out = by.join(repeated, keys, "left")
    return out.select(
        *keys, "block_count", "text_characters", "heading_coverage", share(F.col("pages"), F.col("page_count")).alias("page_coverage"), F.coalesce(share(F.col("_again"), F.col("_all")), F.lit(0.0)).alias("duplicate_ratio"),
        F.when(F.col("_steps") >= 8, F.col("_back") / F.col("_steps")).alias("regression_ratio"), (F.col("block_count") / F.col("page_count")).alias("blocks_per_page"), "mean_block_chars", "formula_blocks", "table_blocks",
    )


def q10_parser_metrics(spark, sf_dir):
    """Two parses of each document side by side: its lines, and its lines with the short ones left out and every seventh page in reverse."""
    lines = with_paths(blocks(spark, sf_dir)).withColumn("kind", block_kind()).withColumn("parser", F.lit("lines"))
    other = lines.where(F.length("text") > 30).withColumns({"parser": F.lit("long"), "page": F.when(F.col("idx") % 35 < 5, F.col("page") - F.col("idx") % 5).otherwise(F.col("page"))}).where("page > 0")
    columns = ["doc_id", "parser", "idx", "page", "text", "kind", "is_heading", "path"]
    return parser_metrics(lines.select(*columns).unionByName(other.select(*columns)), ["doc_id", "parser"])


# Normalised texts

#: Letters and digits with their folded forms, in order, and the marks that go.
LETTERS_FROM, LETTERS_TO = "يىكة", "ییکه"
DIGITS_FROM, DIGITS_TO = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"
MARKS = "[ً-ٰٟۖ-ۭ]"


def compatible(text: Column) -> Column:
    """Unicode's compatibility form (NFKC), which no built-in function makes: texts beyond Latin-1 letters go to Python by the batch."""

    def body(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    body.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(body, "string")(text)


def normalised(text: Column, keep_joiner: bool = True) -> Column:
    """For scoring a reading: NFKC, letters and digits folded, diacritics and direction marks dropped, spaces as they should be around punctuation."""
    t = F.translate(F.translate(compatible(F.coalesce(text, F.lit(""))), LETTERS_FROM, LETTERS_TO), DIGITS_FROM, DIGITS_TO)
    t = F.regexp_replace(F.regexp_replace(t, MARKS, ""), "[‎‏]", "")
    t = t if keep_joiner else F.replace(t, F.lit("‌"), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+", " "), "^ | $", "")
    return F.regexp_replace(F.regexp_replace(t, r" ([،؛؟!,.:%)\]}])", "$1"), r"([(\[{]) ", "$1")


def q27_normalised_texts(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", normalised(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("characters"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


# Spoken chunks


def spoken_chunks(rows: DataFrame, text: str, keys: list[str], most: int) -> DataFrame:
    """(``keys``, chunk, text): sentences packed in order into chunks of at most ``most`` characters; a longer sentence by itself, packed by words; a word
    over it is a chunk of its own."""
    flat = rows.withColumn("_t", collapse(F.regexp_replace(F.col(text), r"\s+", " ")))
    parts = flat.select(*keys, F.posexplode(F.filter(F.transform(F.split("_t", r"(?<=[.!?؟؛])\s+"), lambda x: F.trim(x)), lambda s: s != "")).alias("_at", "_s"))
    item = lambda s, alone: F.struct((F.length(s) + 1).cast("long").alias("tokens"), alone.alias("alone"), s.alias("s"))  # noqa: E731  a space behind each
    words = F.filter(F.split("_s", " "), lambda w: w != "")
    long = parts.where(F.length("_s") > most).select(*keys, "_at", F.transform(words, lambda w: item(w, F.lit(False))).alias("_i"))
    # words of a sentence come back in order by their place
    by_words = long.select(*keys, "_at", F.posexplode(F.arrays_zip("_i", pack_in_order(F.col("_i"), 1 << 40, most + 1).alias("_b"))).alias("p", "x"))
    pieces = by_words.groupBy(*keys, "_at", F.col("x._b").alias("_b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col("x._i.s").alias("s")))), lambda y: y["s"]), " ").alias("_s")).withColumn("alone", F.lit(True))
    units = pieces.unionByName(parts.where(F.length("_s") <= most).select(*keys, "_at", F.lit(0).alias("_b"), "_s", F.lit(False).alias("alone")))
    listed = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_b", "_s", "alone"))).alias("u"))
    listed = listed.withColumn("i", F.transform("u", lambda x: item(x["_s"], x["alone"])))
    binned = listed.select(*keys, F.posexplode(F.arrays_zip("i", pack_in_order(F.col("i"), 1 << 40, most + 1).alias("b"))).alias("p", "x"))
    return binned.groupBy(*keys, F.col("x.b").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col("x.i.s").alias("s")))), lambda y: y["s"]), " ").alias("text"))


def t32_spoken_chunks(spark, sf_dir, most: int = 120):
    """Each turn in chunks of at most 120 characters (900 in production)."""
    t = turns(spark, sf_dir).select("segment_id", "position", "text")
    c = spoken_chunks(t, "text", ["segment_id", "position"], most)
    return c.select("segment_id", "position", "chunk", F.length("text").alias("characters"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


# Neighbours and chapters


def e13_neighbor_context(spark, sf_dir, radius: int = 2, most: int = 2000):
    """The context of each long block: the blocks up to two places away that are no front matter, each up to 2000 characters."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(-radius, radius)
    b = blocks(spark, sf_dir).withColumn("kind", block_kind())
    near = F.collect_list(F.when(F.col("kind") != "front_matter", F.struct("idx", F.substring("text", 1, most).alias("text")))).over(w)
    long = b.withColumn("near", near).where(F.length("text") >= 200)
    long = long.withColumn("near", F.filter("near", lambda x: x["idx"] != F.col("idx")))
    return long.select("doc_id", "idx", F.size("near").alias("near"), F.aggregate("near", F.lit(0), lambda s, x: s + F.length(x["text"])).alias("characters"), F.md5(F.array_join(F.transform("near", lambda x: x["text"]), "\n").cast("binary")).alias("near_md5"))


SHORT, LEAST_BLOCKS, MOST_SHARE = 60, 8, 0.6


def chapters(b: DataFrame) -> DataFrame:
    """(doc_id, idx, h, t, verdict): the chapter of each block by two detectors, and which of them a document takes.

    A chapter begins where the heading at a depth changes; blocks without one belong to the chapter before, or the first.  Headings
    count at depth 0, else 1, if they make two chapters or more, of eight blocks in the median and six tenths of the document at most; the table of
    contents is depth 0, two chapters or more.  They agree if a fifth of the blocks at most have another ordinal and no chapter of the first has
    under 2 % or over 40 % of the blocks."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    running, doc = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("doc_id")
    for d in (0, 1):
        at = F.get("path", F.lit(d))
        # a stretch without a heading goes to the chapter before it; the next one begins anew, even under the same heading
        begins = at.isNotNull() & (F.lag(at).over(w).isNull() | (F.lag(at).over(w) != at))
        b = b.withColumn(f"begin{d}", begins.cast("int"))
        b = b.withColumn(f"c{d}", F.greatest(F.lit(1), F.sum(f"begin{d}").over(running)))
        b = b.withColumn(f"n{d}", F.count("*").over(Window.partitionBy("doc_id", f"c{d}")))
    first = lambda d: F.row_number().over(Window.partitionBy("doc_id", f"c{d}").orderBy("idx")) == 1
    for d in (0, 1):
        b = b.withColumn(f"first{d}", F.when(first(d), F.col(f"n{d}")))
    by = b.groupBy("doc_id").agg(F.count("*").alias("n"), *(x for d in (0, 1) for x in (F.count(f"first{d}").alias(f"chapters{d}"), F.median(f"first{d}").alias(f"median{d}"), F.max(f"first{d}").alias(f"max{d}"), F.min(f"first{d}").alias(f"min{d}"))))
    fits = lambda d: (F.col(f"chapters{d}") >= 2) & (F.col(f"median{d}") >= LEAST_BLOCKS) & (F.col(f"max{d}") <= MOST_SHARE * F.col("n"))
    by = by.withColumns({"depth": F.when(fits(0), 0).when(fits(1), 1), "toc": F.col("chapters0") >= 2})
    pick = lambda k: F.when(F.col("depth") == 0, F.col(f"{k}0")).otherwise(F.col(f"{k}1"))
    b = b.join(by, "doc_id")
    other = F.avg((pick("c") != F.col("c0")).cast("double")).over(doc)
    agreed = (F.col("other") <= 0.2) & (pick("max") <= 0.4 * F.col("n")) & (pick("min") >= 0.02 * F.col("n"))
    b = b.withColumn("other", other)
    verdict = F.when(F.col("depth").isNotNull() & F.col("toc"), F.when(agreed, "agreed").otherwise("disagreed")).when(F.col("depth").isNotNull(), "heading_only").when(F.col("toc"), "toc_only").otherwise("single")
    chapter = F.when(F.col("verdict").isin("agreed", "heading_only"), pick("c")).when(F.col("verdict").isin("disagreed", "toc_only"), F.col("c0")).otherwise(1)
    return b.withColumn("verdict", verdict).withColumn("chapter", chapter.cast("int")).select("doc_id", "idx", "chapter", "verdict", "depth")


def b26_detected_chapters(spark, sf_dir):
    """How each document is cut into chapters; short lines head what follows them."""
    c = chapters(with_paths(blocks(spark, sf_dir).withColumn("is_heading", F.length("text") <= SHORT)))
    return c.groupBy("doc_id", "verdict").agg(F.max("chapter").alias("chapters"), F.max("depth").alias("depth"), F.count("*").alias("blocks"))


# Judgements


def e89_judgement_snapshots(spark, sf_dir):
    """Users' judgements (events) of evidence with all that they rest on: block, locator, excerpt, claim, source and the identities of what made
    them; null where the evidence isn't known."""
    e = evidence(spark, sf_dir)
    one = e.groupBy("evidence_id").agg(F.min(F.struct("doc_id", "idx", "page_start", "page_end", "excerpt", "claim", "claim_type", "source")).alias("m")).select("evidence_id", "m.*")
    ids = F.concat(F.lit("e"), F.col("user_id").cast("long") % 5000, F.lit("-"), F.col("k") % 50)
    judged = product_events(spark, sf_dir).where(F.col("name").isNotNull()).select("event_id", "project_id", "user_id", ids.alias("evidence_id"))
    made = with_paths(blocks(spark, sf_dir)).select("doc_id", "idx", F.get("path", F.lit(0)).alias("chapter"), F.element_at(F.when(F.size("path") > 0, F.col("path")), -1).alias("section"), F.sha2(F.concat_ws("|", "doc_id", "idx", "text").cast("binary"), 256).alias("extraction_identity"))
    titles = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("lang").alias("lang"), F.sha2(F.max(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("reconciler_identity"))
    out = judged.join(one, "evidence_id", "left").join(made, ["doc_id", "idx"], "left").join(titles, "doc_id", "left")
    label = F.when(F.col("page_start").isNotNull(), F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("p. "), "page_start")).otherwise(F.concat(F.lit("pp. "), "page_start", F.lit("-"), "page_end")))
    return out.select("event_id", "project_id", "evidence_id", "doc_id", "idx", "page_start", "page_end", "chapter", "section", F.col("claim").alias("claim_text"), F.coalesce("source", F.lit("untitled")).alias("source_title"), label.alias("locator_label"), "extraction_identity", "reconciler_identity")


# Plans, gates and samples


def e83_skeleton_deviations(spark, sf_dir, tolerance: float = 2.0):
    """Plans (an order's lines as they are shipped) against their skeletons (the lines as they are numbered), place by place: the first deviation of
    each, in the number of segments, ids, dynamic or minutes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_shipdate")
    numbered = lambda *by: F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*by))
    cells_of = lambda rows, x: rows.select("l_orderkey", "place", *(F.col(c).alias(f"{x}_{n}") for c, n in (("l_partkey", "id"), ("l_returnflag", "dynamic"), ("l_quantity", "minutes"))))
    skeleton = cells_of(lines.withColumn("place", numbered("l_linenumber", "l_partkey", "l_suppkey")), "s")
    shipped = lines.where("l_returnflag <> 'R' OR l_quantity > 5")  # short segments that are disputed aren't planned
    plan = cells_of(shipped.withColumn("place", numbered("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")), "p")
    both = skeleton.join(plan, ["l_orderkey", "place"], "full")
    counted = F.count("s_id").over(Window.partitionBy("l_orderkey")) != F.count("p_id").over(Window.partitionBy("l_orderkey"))
    fault = F.when(~F.col("s_id").eqNullSafe(F.col("p_id")), "ids").when(~F.col("s_dynamic").eqNullSafe(F.col("p_dynamic")), "dynamic").when(F.abs(F.col("s_minutes") - F.col("p_minutes")) > tolerance, "minutes")
    marked = both.withColumn("number", counted).withColumn("fault", F.when(F.col("number"), "number").otherwise(fault))
    first = marked.groupBy("l_orderkey").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct(F.when(F.col("fault") == "number", 0).otherwise(F.col("place")).alias("place"), "fault"))).alias("f"))
    return first.groupBy(F.coalesce("f.fault", F.lit("none")).alias("deviation"), F.coalesce("f.place", F.lit(0)).alias("place")).agg(F.count("*").alias("plans"))


def q35_bound_audio(spark, sf_dir):
    """Audio gates: audio is made from the turns that the two speakers have; it is bound if the script holds no others by now, and verified if no spoken
    turn is blank."""
    t = turns(spark, sf_dir)
    key = lambda kept: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("position", "speaker", "text")))), lambda x: F.concat_ws(":", x["position"], x["speaker"], x["text"])), "\n").cast("binary"), 256)
    spoken = F.col("speaker") != "editorial"
    by = t.groupBy("segment_id").agg(key(F.lit(True)).alias("script"), key(spoken).alias("made_from"), F.count_if(spoken).alias("spoken"), F.count_if(spoken & (F.trim("text") == "")).alias("blank"))
    gate = F.when(F.col("spoken") == 0, "not_reached").when((F.col("script") == F.col("made_from")) & (F.col("blank") == 0), "pass").otherwise("blocked")
    return by.select("segment_id", (F.col("script") == F.col("made_from")).alias("bound"), gate.alias("audio_qa"))


def b60_sample_pages(spark, sf_dir):
    """The first, middle and last page of each document and how much they hold."""
    b = blocks(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"))
    last = b.groupBy("doc_id").agg(F.max("page").alias("n"))
    wanted = last.select("doc_id", F.explode(F.array_distinct(F.array(F.lit(1).cast("long"), 1 + F.floor(F.col("n") / 2), F.col("n")))).alias("page"))
    return wanted.join(b, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("characters", F.lit(0)).alias("characters"))


def e65_extraction_seeds(spark, sf_dir, core_share: float = 0.35):
    """Where a chapter is meant as a whole - a third of its cells and more are of tier 1 - extraction starts from the cells in scope and what they need, which may
    extend it; else from all its cells."""
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), F.col("p_brand").alias("chapter"), (1 + F.col("p_size") % 3).alias("tier"))
    chosen = g01_selected_cells(spark, sf_dir).select("cell", "hop")
    by = c.join(chosen, "cell", "left").groupBy("chapter").agg(F.count("*").alias("cells"), F.avg((F.col("tier") == 1).cast("double")).alias("core"), F.count("hop").alias("chosen"), F.count_if(F.col("hop") > 0).alias("needed"))
    whole = F.col("core") >= core_share
    return by.select("chapter", F.when(whole, F.col("chosen")).otherwise(F.col("cells")).alias("seeds"), whole.alias("whole"), (whole & (F.col("needed") > 0)).alias("extended"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] in "beqt" and name[1:3].isdigit()}


def _sql() -> dict[str, str]:
    from heddle.operators.splitting import SQL as SPLIT
    from heddle.operators.splitting import SHORT as LINE
    from heddle.operators.splitting import _packed
    from heddle.plans.document_sql import collapse as squeezed

    paths = SPLIT["b02_heading_paths"].split(" SELECT doc_id, count(DISTINCT")[0].removeprefix("WITH ")
    short = paths.replace("CASE WHEN is_heading THEN", f"CASE WHEN length(text) <= {LINE} THEN")
    kinds = f"kb AS (SELECT b.*, path, {KIND} AS kind FROM blocks b JOIN (SELECT doc_id, idx, path FROM paths) USING (doc_id, idx))"
    runs = ", ".join(
        f"""r{d} AS (SELECT *, greatest(1, sum(b{d}) OVER (PARTITION BY doc_id ORDER BY idx))::INT AS c{d} FROM (SELECT *, (path[{d + 1}] IS NOT NULL AND lag(path[{d + 1}]) OVER (PARTITION BY doc_id ORDER BY idx) IS DISTINCT FROM path[{d + 1}])::INT AS b{d} FROM {source})),
        z{d} AS (SELECT doc_id, count(*) AS chapters{d}, median(n) AS median{d}, max(n) AS max{d}, min(n) AS min{d} FROM (SELECT doc_id, c{d}, count(*) AS n FROM r{d} GROUP BY ALL) GROUP BY 1)"""
        for d, source in ((0, "paths"), (1, "r0"))
    )
    fits = lambda d: f"chapters{d} >= 2 AND median{d} >= {LEAST_BLOCKS} AND max{d} <= {MOST_SHARE} * n"
    pick = lambda k: f"CASE WHEN depth = 0 THEN {k}0 ELSE {k}1 END"
    from heddle.plans.graph_script_sql import SQL as GRAPHS

    chosen = GRAPHS["g01_selected_cells"].strip().removeprefix("WITH RECURSIVE ").rsplit("SELECT cell, hop, origin FROM o", 1)[0].rstrip()
    return {
        "q10_parser_metrics": f"""WITH {paths}, {kinds}, o AS (SELECT doc_id, 'lines' AS parser, idx, page, text, kind, is_heading, path FROM kb UNION ALL SELECT doc_id, 'long', idx, CASE WHEN idx % 35 < 5 THEN page - idx % 5 ELSE page END AS page, text, kind, is_heading, path FROM kb WHERE length(text) > 30),
            p AS (SELECT *, lower({squeezed("text")}) AS norm, (page < lag(page) OVER (PARTITION BY doc_id, parser ORDER BY idx))::INT AS back FROM o WHERE page > 0),
            d AS (SELECT doc_id, parser, sum(length(norm) * n) AS everything, sum(length(norm) * (n - 1)) AS again FROM (SELECT doc_id, parser, norm, count(*) AS n FROM p WHERE length(text) >= 80 GROUP BY ALL) GROUP BY ALL)
            SELECT doc_id, parser, count(*) AS block_count, sum(length(text))::BIGINT AS text_characters, avg((is_heading OR len(path) > 0)::INT::DOUBLE) AS heading_coverage, count(DISTINCT page)::DOUBLE / max(page) AS page_coverage, coalesce(any_value(again)::DOUBLE / any_value(everything), 0) AS duplicate_ratio,
                CASE WHEN count(back) >= 8 THEN sum(back)::DOUBLE / count(back) END AS regression_ratio, count(*)::DOUBLE / max(page) AS blocks_per_page, avg(length(text)) AS mean_block_chars, count(*) FILTER (kind = 'formula') AS formula_blocks, count(*) FILTER (kind = 'table') AS table_blocks
            FROM p LEFT JOIN d USING (doc_id, parser) GROUP BY ALL""",
        "e13_neighbor_context": f"""WITH k AS (SELECT *, {KIND} AS kind FROM blocks), w AS (SELECT doc_id, idx, text, coalesce(list({{'idx': idx, 'text': substring(text, 1, 2000)}}) FILTER (kind <> 'front_matter') OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), []) AS l FROM k),
            n AS (SELECT doc_id, idx, list_filter(l, lambda x: x.idx <> idx) AS l FROM w WHERE length(text) >= 200)
            SELECT doc_id, idx, len(l)::INT AS near, coalesce(list_sum(list_transform(l, lambda x: length(x.text))), 0)::INT AS characters, md5(coalesce(array_to_string(list_transform(l, lambda x: x.text), chr(10)), '')) AS near_md5 FROM n""",
        "b26_detected_chapters": f"""WITH {short}, {runs}, s AS (SELECT *, CASE WHEN {fits(0)} THEN 0 WHEN {fits(1)} THEN 1 END AS depth, chapters0 >= 2 AS toc FROM (SELECT doc_id, count(*) AS n FROM paths GROUP BY 1) JOIN z0 USING (doc_id) JOIN z1 USING (doc_id)),
            b AS (SELECT doc_id, idx, c0, c1, depth, toc, n, {pick("c")} AS h, {pick("max")} AS most, {pick("min")} AS least FROM r1 JOIN s USING (doc_id)), x AS (SELECT *, avg((h <> c0)::INT) OVER (PARTITION BY doc_id) AS other FROM b),
            v AS (SELECT *, CASE WHEN depth IS NOT NULL AND toc THEN CASE WHEN other <= 0.2 AND most <= 0.4 * n AND least >= 0.02 * n THEN 'agreed' ELSE 'disagreed' END WHEN depth IS NOT NULL THEN 'heading_only' WHEN toc THEN 'toc_only' ELSE 'single' END AS verdict FROM x)
            SELECT doc_id, verdict, max(CASE WHEN verdict IN ('agreed', 'heading_only') THEN h WHEN verdict = 'single' THEN 1 ELSE c0 END)::INT AS chapters, max(depth)::INT AS depth, count(*) AS blocks FROM v GROUP BY ALL""",
        "t32_spoken_chunks": rf"""WITH RECURSIVE t AS (SELECT segment_id || ':' || position AS key, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM turns), l AS (SELECT key, list_filter(list_transform(string_split(regexp_replace(t, '([.!?؟؛])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS ss FROM t),
            f AS (SELECT key, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS pos FROM l), w AS (SELECT key, pos, unnest(string_split(s, ' ')) AS s, unnest(range(1, len(string_split(s, ' ')) + 1)) AS r FROM f WHERE length(s) > 120),
            ws AS (SELECT key || '/' || pos AS k, r, length(s) + 1 AS tokens, false AS alone, s FROM w), {_packed("pw", "ws", 121, 1 << 40)},
            u AS (SELECT split_part(k, '/', 1) AS key, split_part(k, '/', 2)::INT AS pos, bin AS b, string_agg(s, ' ' ORDER BY r) AS s, true AS alone FROM ws JOIN pw USING (k, r) GROUP BY ALL UNION ALL SELECT key, pos, 0, s, false FROM f WHERE length(s) <= 120),
            us AS (SELECT key AS k, row_number() OVER (PARTITION BY key ORDER BY pos, b) AS r, length(s) + 1 AS tokens, alone, s FROM u), {_packed("pu", "us", 121, 1 << 40)},
            c AS (SELECT k, bin, string_agg(s, ' ' ORDER BY r) AS t FROM us JOIN pu USING (k, r) GROUP BY ALL)
            SELECT split_part(k, ':', 1)::BIGINT AS segment_id, split_part(k, ':', 2)::BIGINT AS position, bin::INT AS chunk, length(t)::INT AS characters, md5(t) AS text_md5 FROM c""",
        "e83_skeleton_deviations": """WITH s AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_partkey AS id, l_returnflag AS dynamic, l_quantity AS minutes FROM lineitem),
            p AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS place, l_partkey AS id, l_returnflag AS dynamic, l_quantity AS minutes FROM lineitem WHERE l_returnflag <> 'R' OR l_quantity > 5),
            b AS (SELECT k, place, s.id AS a, p.id AS b, s.dynamic IS DISTINCT FROM p.dynamic AS d, abs(s.minutes - p.minutes) > 2 AS m FROM s FULL JOIN p USING (k, place)), c AS (SELECT *, count(a) OVER (PARTITION BY k) <> count(b) OVER (PARTITION BY k) AS number FROM b),
            f AS (SELECT k, CASE WHEN number THEN 0 ELSE place END AS place, CASE WHEN number THEN 'number' WHEN a IS DISTINCT FROM b THEN 'ids' WHEN d THEN 'dynamic' WHEN m THEN 'minutes' END AS fault FROM c),
            g AS (SELECT k, min({'place': place, 'fault': fault}) FILTER (fault IS NOT NULL) AS f FROM f GROUP BY 1) SELECT coalesce(f.fault, 'none') AS deviation, coalesce(f.place, 0)::INT AS place, count(*) AS plans FROM g GROUP BY ALL""",
        "q35_bound_audio": """WITH b AS (SELECT segment_id, coalesce(string_agg(position || ':' || speaker || ':' || text, chr(10) ORDER BY position, speaker, text), '') AS script, coalesce(string_agg(position || ':' || speaker || ':' || text, chr(10) ORDER BY position, speaker, text) FILTER (speaker <> 'editorial'), '') AS made,
                count(*) FILTER (speaker <> 'editorial') AS spoken, count(*) FILTER (speaker <> 'editorial' AND trim(text) = '') AS blank FROM turns GROUP BY 1)
            SELECT segment_id, script = made AS bound, CASE WHEN spoken = 0 THEN 'not_reached' WHEN script = made AND blank = 0 THEN 'pass' ELSE 'blocked' END AS audio_qa FROM b""",
        "b60_sample_pages": """WITH b AS (SELECT doc_id, page, count(*) AS blocks, sum(length(text))::BIGINT AS characters FROM blocks GROUP BY ALL), w AS (SELECT doc_id, unnest(list_distinct([1, 1 + max(page) // 2, max(page)])) AS page FROM b GROUP BY doc_id)
            SELECT doc_id, page, coalesce(blocks, 0) AS blocks, coalesce(characters, 0) AS characters FROM w LEFT JOIN b USING (doc_id, page)""",
        "e65_extraction_seeds": f"""WITH RECURSIVE {chosen}, y AS (SELECT chapter, count(*) AS cells, avg((tier = 1)::INT::DOUBLE) AS core, count(o.hop) AS chosen, count(*) FILTER (o.hop > 0) AS needed FROM cells LEFT JOIN o USING (cell) GROUP BY 1)
            SELECT chapter, CASE WHEN core >= 0.35 THEN chosen ELSE cells END AS seeds, core >= 0.35 AS whole, core >= 0.35 AND needed > 0 AS extended FROM y""",
        "e89_judgement_snapshots": f"""WITH {paths}, o AS (SELECT evidence_id, min({{'doc_id': doc_id, 'idx': idx, 'page_start': page_start, 'page_end': page_end, 'excerpt': excerpt, 'claim': claim, 'claim_type': claim_type, 'source': source}}) AS m FROM evidence GROUP BY 1),
            j AS (SELECT event_id, project_id, 'e' || (user_id::BIGINT % 5000) || '-' || (k % 50) AS evidence_id FROM core_events WHERE name IS NOT NULL),
            d AS (SELECT doc_id, sha256(max(coalesce(text, ''))) AS reconciler_identity FROM documents GROUP BY 1)
            SELECT event_id, project_id, evidence_id, m.doc_id AS doc_id, m.idx AS idx, m.page_start AS page_start, m.page_end AS page_end, path[1] AS chapter, path[len(path)] AS section, m.claim AS claim_text, coalesce(m.source, 'untitled') AS source_title,
                CASE WHEN m.page_start = m.page_end THEN 'p. ' || m.page_start WHEN m.page_start IS NOT NULL THEN 'pp. ' || m.page_start || '-' || m.page_end END AS locator_label, CASE WHEN p.doc_id IS NOT NULL THEN sha256(p.doc_id || '|' || p.idx || '|' || p.text) END AS extraction_identity, reconciler_identity
            FROM j LEFT JOIN o USING (evidence_id) LEFT JOIN paths p ON p.doc_id = m.doc_id AND p.idx = m.idx LEFT JOIN d ON d.doc_id = m.doc_id""",
    }


SQL = _sql()
