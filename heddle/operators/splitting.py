"""Documents cut to size along their own structure: headings of six levels, groups that only go deeper where they are still too large,
and oversized blocks split into paragraphs, sentences or slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import token_estimate
from heddle.operators.documents import pack_in_order
from heddle.sources.views import blocks, table

LEVELS = 6


def heading_level(text: Column) -> Column:
    """Level of a heading by its length: ten characters a level, six at most."""
    return F.least(F.lit(LEVELS), 1 + F.floor((F.length(text) - 1) / 10)).cast("int")


def with_paths(b: DataFrame) -> DataFrame:
    """Blocks (doc_id, idx, text, is_heading) with ``path``, the headings that they stand under: a heading ends those of its own
    level and deeper ones."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("is_heading"), heading_level(F.col("text")))
    b = b.withColumn("level", level)
    b = b.withColumns({f"_h{k}": F.last(F.when(F.col("level") == k, F.struct("idx", "text")), ignorenulls=True).over(w) for k in range(1, LEVELS + 1)})
    above, path = F.lit(-1).cast("long"), []
    for k in range(1, LEVELS + 1):
        at = F.coalesce(F.col(f"_h{k}.idx"), F.lit(-1))
        path.append(F.when(at > above, F.col(f"_h{k}.text")))
        above = F.greatest(above, at)
    return b.withColumn("path", F.filter(F.array(*path), lambda h: h.isNotNull())).drop(*(f"_h{k}" for k in range(1, LEVELS + 1)))


def b02_heading_paths(spark, sf_dir):
    """Each document's blocks by the heading path that they stand under."""
    path = F.array_join("path", " > ")
    return with_paths(blocks(spark, sf_dir)).groupBy("doc_id").agg(F.countDistinct(path).alias("paths"), F.count_if(F.size("path") == 0).alias("outside"), F.md5(F.max(path).cast("binary")).alias("last_md5"))


def b04_heading_stack(spark, sf_dir):
    """Depth of the stack of headings at each block."""
    return with_paths(blocks(spark, sf_dir)).groupBy("doc_id", F.size("path").alias("depth")).agg(F.count("*").alias("blocks"))


def semantic_groups(b: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Blocks (``keys``, idx, size, path) with ``grp``, the number of their group, and its size ``held``: consecutive blocks under one
    heading of the first level; a group over ``most`` is cut again by its next level, as long as it has one."""
    order = Window.partitionBy(*keys).orderBy("idx")
    running, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys, "grp")
    b = b.withColumns({"grp": F.lit(0).cast("long"), "open": F.lit(True)})
    for depth in range(LEVELS):
        at = F.get("path", F.lit(depth))
        begins = F.lag("grp").over(order).isNull() | (F.lag("grp").over(order) != F.col("grp")) | (F.col("open") & ~at.eqNullSafe(F.lag(at).over(order)))
        b = b.withColumn("begins", begins.cast("long")).withColumn("grp", F.sum("begins").over(running))
        b = b.withColumns({"held": F.sum("size").over(whole), "deeper": F.max(F.size("path")).over(whole) > depth + 1})
        b = b.withColumn("open", (F.col("held") > most) & F.col("deeper"))
    return b.drop("begins", "deeper", "open")


def partitions(b: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(``keys``, part, blocks, characters, first_idx, oversize) of blocks in order: groups under their headings stay whole where they fit, larger
    ones without deeper headings are cut at block edges, and neighbours fill a part up to ``most`` characters.  A block over it is an
    oversize part of its own."""
    g = semantic_groups(b, keys, most)
    item = F.struct("idx", F.col("size").alias("tokens"), F.lit(False).alias("alone"))
    large = g.where(F.col("held") > most).groupBy(*keys, "grp").agg(F.array_sort(F.collect_list(item)).alias("items"))
    cut = large.select(*keys, "grp", F.explode(F.arrays_zip("items", pack_in_order(F.col("items"), most, most).alias("bins"))).alias("x"))
    cut = cut.select(*keys, "grp", F.col("x.items.idx").alias("idx"), F.col("x.items.tokens").alias("size"), F.col("x.bins").alias("sub"))
    units = g.where(F.col("held") <= most).select(*keys, "grp", "idx", "size", F.lit(0).alias("sub")).unionByName(cut)
    units = units.groupBy(*keys, "grp", "sub").agg(F.min("idx").alias("idx"), F.sum("size").alias("tokens"), F.count("*").alias("blocks"))
    docs = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "tokens", F.lit(False).alias("alone"), "blocks"))).alias("items"))
    flat = docs.select(*keys, F.explode(F.arrays_zip("items", pack_in_order(F.col("items"), most, most).alias("bins"))).alias("x"))
    parts = flat.groupBy(*keys, F.col("x.bins").alias("part")).agg(F.sum("x.items.blocks").alias("blocks"), F.sum("x.items.tokens").alias("characters"), F.min("x.items.idx").alias("first_idx"))
    return parts.withColumn("oversize", F.col("characters") > most)


SHORT = 60  # characters of a line that heads what follows it, in the tables given, whose lines hardly ever lack a full stop


def _sized(spark, sf_dir) -> DataFrame:
    return with_paths(blocks(spark, sf_dir).withColumn("is_heading", F.length("text") <= SHORT)).select("doc_id", "idx", F.length("text").cast("long").alias("size"), "path")


def b32_semantic_groups(spark, sf_dir, most: int = 600):
    """Each document's groups under headings as deep as their size asks for."""
    g = semantic_groups(_sized(spark, sf_dir), ["doc_id"], most)
    return g.groupBy("doc_id", F.col("grp").alias("group")).agg(F.count("*").alias("blocks"), F.sum("size").alias("characters"), F.min("idx").alias("first_idx"))


def b46_chapter_partitions(spark, sf_dir, most: int = 600):
    """Parts of each chapter - blocks under one heading of the first level - under a budget of characters, in the order of the document."""
    first = F.get("path", F.lit(0))
    w = Window.partitionBy("doc_id").orderBy("idx")
    b = _sized(spark, sf_dir).withColumn("new", (F.lag("idx").over(w).isNull() | ~first.eqNullSafe(F.lag(first).over(w))).cast("long"))
    b = b.withColumn("chapter", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    parts = partitions(b, ["doc_id", "chapter"], most)
    # the audit: each part begins where the one before it ends
    in_doc = Window.partitionBy("doc_id").orderBy("chapter", "part")
    before = F.coalesce(F.sum("blocks").over(in_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("in_order", before == F.col("first_idx"))


def split_pieces(texts: DataFrame, text: str, most: int) -> DataFrame:
    """``texts`` (any columns but text) as pieces of at most ``most`` tokens, numbered from 0: whole texts that fit; else paragraphs, or where there is
    one only, sentences, packed in order and joined by empty lines; a paragraph or sentence over the limit, or a text that can't be cut,
    in slices.  But for white space at the cuts nothing is lost."""
    others = [c for c in texts.columns if c != text]
    strip = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    pieces = lambda cut: F.filter(F.transform(cut, strip), lambda p: p != "")
    rows = texts.withColumn("_all", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({"_paragraphs": pieces(F.split("_all", r"\n\s*\n")), "_sentences": pieces(F.split("_all", r"(?<=[.!?؟؛])\s+"))})
    units = F.when(token_estimate(F.col("_all")) <= most, F.array("_all")).when(F.size("_paragraphs") != 1, F.col("_paragraphs")).otherwise(F.col("_sentences"))
    rows = rows.select(*others, units.alias("_units")).withColumn("_sizes", F.transform("_units", lambda u: F.struct(token_estimate(u).alias("tokens"), (token_estimate(u) > most).alias("alone"))))
    rows = rows.withColumn("_bins", pack_in_order(F.col("_sizes"), 1 << 40, most))
    size = max(200, int(most * 3.5))
    slices = lambda t: pieces(F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / size).cast("int")), lambda i: F.substr(t, i * size + 1, F.lit(size))))
    flat = rows.select(*others, F.posexplode(F.arrays_zip("_units", "_sizes", "_bins")).alias("_at", "_x"))
    bins = flat.groupBy(*others, F.col("_x._bins").alias("_bin")).agg(F.array_sort(F.collect_list(F.struct("_at", F.col("_x._units").alias("u"), F.col("_x._sizes.alone").alias("alone")))).alias("_u"))
    text_of = F.array_join(F.transform("_u", lambda x: x["u"]), "\n\n")
    bins = bins.select(*others, "_bin", F.get("_u.alone", F.lit(0)).alias("_alone"), text_of.alias("_text"))
    cut = bins.select(*others, "_bin", F.posexplode(F.when(F.col("_alone"), slices(F.col("_text"))).otherwise(F.array("_text"))).alias("_slice", text))
    number = F.row_number().over(Window.partitionBy(*others).orderBy("_bin", "_slice")) - 1
    return cut.select(*others, number.alias("piece"), text)


def b10_split_blocks(spark, sf_dir, most: int = 120):
    """Documents as single blocks, split to at most 120 tokens (1800 in production)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = split_pieces(docs, "text", most)
    return out.select("doc_id", "piece", F.length("text").alias("characters"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "b" and name[1:3].isdigit()}


def _packed(name: str, source: str, most: int, target: int | None = None) -> str:
    """Recursive greedy packing of ``source`` (k, r from 1 in each k, tokens, alone): ``name`` (k, r, bin)."""
    full = most if target is None else target
    return f"""{name} AS (SELECT k, r, 0 AS bin, tokens AS held, alone AS shut FROM {source} WHERE r = 1
        UNION ALL SELECT n.k, n.r, p.bin + x.anew::INT, CASE WHEN x.anew THEN 0 ELSE p.held END + n.tokens, n.alone
            FROM {name} p JOIN {source} n ON n.k = p.k AND n.r = p.r + 1, LATERAL (SELECT p.held > 0 AND (p.shut OR n.alone OR p.held + n.tokens > {most} OR p.held >= {full}) AS anew) x)"""


def _sql() -> dict[str, str]:
    from heddle.plans.document_sql import tokens

    levels = range(1, LEVELS + 1)
    last = ", ".join(f"last_value(CASE WHEN level = {k} THEN {{'idx': idx, 'text': text}} END IGNORE NULLS) OVER w AS h{k}" for k in levels)
    above = lambda k: "greatest(-1, " + ", ".join(f"coalesce(h{j}.idx, -1)" for j in range(1, k)) + ")" if k > 1 else "-1"
    path = ", ".join(f"CASE WHEN coalesce(h{k}.idx, -1) > {above(k)} THEN h{k}.text END" for k in levels)
    paths_by = lambda heads: f"""l AS (SELECT *, CASE WHEN {heads} THEN least({LEVELS}, 1 + (length(text) - 1) // 10) END AS level FROM blocks),
        hs AS (SELECT *, {last} FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
        paths AS (SELECT doc_id, idx, text, length(text)::BIGINT AS size, list_filter([{path}], lambda h: h IS NOT NULL) AS path FROM hs)"""  # noqa: E731
    paths, short = paths_by("is_heading"), paths_by(f"length(text) <= {SHORT}")

    def grouped(source: str, key: str, most: int) -> str:
        out = [f"g0 AS (SELECT {key} AS k, *, 0::BIGINT AS grp, true AS open FROM {source})"]
        for d in range(LEVELS):
            out.append(f"""n{d} AS (SELECT *, (lag(grp) OVER w IS DISTINCT FROM grp OR open AND path[{d + 1}] IS DISTINCT FROM lag(path[{d + 1}]) OVER w)::INT AS begins FROM g{d} WINDOW w AS (PARTITION BY k ORDER BY idx)),
                s{d} AS (SELECT * REPLACE (sum(begins) OVER (PARTITION BY k ORDER BY idx)::BIGINT AS grp) FROM n{d}),
                g{d + 1} AS (SELECT * EXCLUDE (begins, held, open), sum(size) OVER w AS held, sum(size) OVER w > {most} AND max(len(path)) OVER w > {d + 1} AS open FROM (SELECT *{", NULL AS held" if d == 0 else ""} FROM s{d}) WINDOW w AS (PARTITION BY k, grp))""")
        return ", ".join(out)

    groups = grouped("paths", "doc_id", 600)
    chapters = """c0 AS (SELECT *, (lag(idx) OVER w IS NULL OR path[1] IS DISTINCT FROM lag(path[1]) OVER w)::INT AS new FROM paths WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
        ch AS (SELECT * EXCLUDE (new), sum(new) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS chapter FROM c0)"""
    parts = f"""{grouped("ch", "doc_id || ':' || chapter", 600)},
        big AS (SELECT k || ':' || grp AS k, row_number() OVER (PARTITION BY k, grp ORDER BY idx) AS r, size AS tokens, false AS alone, idx, k AS whole, grp FROM g{LEVELS} WHERE held > 600),
        {_packed("pb", "big", 600)},
        units AS (SELECT whole AS k, grp, bin AS sub, min(idx) AS idx, sum(tokens) AS tokens, count(*) AS blocks FROM big JOIN pb USING (k, r) GROUP BY ALL UNION ALL SELECT k, grp, 0, min(idx), sum(size), count(*) FROM g{LEVELS} WHERE held <= 600 GROUP BY k, grp),
        seq AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY idx) AS r, false AS alone FROM units),
        {_packed("pu", "seq", 600)},
        parts AS (SELECT k, bin AS part, sum(blocks)::BIGINT AS blocks, sum(tokens)::BIGINT AS characters, min(idx) AS first_idx FROM seq JOIN pu USING (k, r) GROUP BY ALL)"""
    white = r"'^\s+|\s+$', '', 'g'"
    cut = lambda x: f"list_filter(list_transform({x}, lambda p: regexp_replace(p, {white})), lambda p: p <> '')"
    size = max(200, int(120 * 3.5))
    return {
        "b02_heading_paths": f"WITH {paths} SELECT doc_id, count(DISTINCT array_to_string(path, ' > ')) AS paths, count(*) FILTER (len(path) = 0) AS outside, md5(max(array_to_string(path, ' > '))) AS last_md5 FROM paths GROUP BY 1",
        "b04_heading_stack": f"WITH {paths} SELECT doc_id, len(path)::INT AS depth, count(*) AS blocks FROM paths GROUP BY ALL",
        "b32_semantic_groups": f'WITH {short}, {groups} SELECT doc_id, grp AS "group", count(*) AS blocks, sum(size)::BIGINT AS characters, min(idx) AS first_idx FROM g{LEVELS} GROUP BY ALL',
        "b46_chapter_partitions": f"""WITH RECURSIVE {short}, {chapters}, {parts}, named AS (SELECT split_part(k, ':', 1)::BIGINT AS doc_id, split_part(k, ':', 2)::BIGINT AS chapter, * EXCLUDE (k) FROM parts)
            SELECT *, characters > 600 AS oversize, coalesce(sum(blocks) OVER (PARTITION BY doc_id ORDER BY chapter, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = first_idx AS in_order FROM named""",
        "b10_split_blocks": rf"""WITH RECURSIVE d AS (SELECT doc_id AS k, coalesce(text, '') AS t FROM documents), c AS (SELECT k, t, {cut("regexp_split_to_array(t, '\\n\\s*\\n')".replace(chr(92) * 2, chr(92)))} AS ps,
                {cut(r"string_split(regexp_replace(t, '([.!?؟؛])\s+', '\1' || chr(1), 'g'), chr(1))")} AS ss FROM d),
            u AS (SELECT k, CASE WHEN {tokens("t")} <= 120 THEN [t] WHEN len(ps) <> 1 THEN ps ELSE ss END AS us FROM c), f AS (SELECT k, unnest(us) AS unit, unnest(range(1, len(us) + 1)) AS r FROM u),
            s AS (SELECT k, r, unit, {tokens("unit")} AS tokens, {tokens("unit")} > 120 AS alone FROM f), {_packed("p", "s", 120, 1 << 40)},
            b AS (SELECT k, bin, bool_or(alone) AS alone, string_agg(unit, chr(10) || chr(10) ORDER BY r) AS t FROM s JOIN p USING (k, r) GROUP BY ALL),
            z AS (SELECT k, bin, i, CASE WHEN alone THEN regexp_replace(substring(t, i * {size} + 1, {size}), {white}) ELSE t END AS t, alone FROM b, unnest(range(CASE WHEN alone THEN (length(t) - 1) // {size} + 1 ELSE 1 END)) AS x(i))
            SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY bin, i) - 1)::INT AS piece, length(t)::INT AS characters, md5(t) AS text_md5 FROM z WHERE NOT alone OR t <> ''""",
    }


SQL = _sql()
