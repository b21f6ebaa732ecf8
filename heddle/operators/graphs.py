"""The concept graph: closures, cycles, tiers, integrity and edge selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.sources.store import materialise
from heddle.sources.views import cells, edges, table

MOST_HOPS = 25


def reach(seeds: DataFrame, steps: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """(cell, hop): what ``steps`` (from_cell, to_cell) lead to from ``seeds`` (cell), with the fewest hops.

    Breadth first: each pass joins only the newest cells and takes away those seen before, so that cycles
    end and nothing is expanded twice.  At most ``hops`` passes run;
    fewer when nothing is new."""
    seen, steps = materialise(seeds.select("cell", F.lit(0).alias("hop")).distinct()), materialise(steps)
    front = seen
    for hop in range(1, hops + 1):
        found = front.join(steps, F.col("cell") == F.col("from_cell")).select(F.col("to_cell").alias("cell")).distinct()
        front = materialise(found.join(seen, "cell", "left_anti").select("cell", F.lit(hop).alias("hop")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def g02_prerequisite_closure(spark, sf_dir):
    """The cells of tier 1 and all that they need, directly or through others, in 25 hops at most."""
    steps = edges(spark, sf_dir).where("type = 'prerequisite'").select(F.col("target").alias("from_cell"), F.col("source").alias("to_cell")).distinct()
    return reach(cells(spark, sf_dir).where("tier = 1").select("cell"), steps)


def selected_closure(seeds: DataFrame, steps: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """(cell, hop, origin): as ``reach``, with the seed that each cell is there for: of those that lead to it in the
    fewest hops the smallest; a seed is its own."""
    seen = seeds.select("cell", F.lit(0).alias("hop"), F.col("cell").alias("origin")).distinct()
    seen, steps = materialise(seen), materialise(steps)
    front = seen
    for hop in range(1, hops + 1):
        found = front.join(steps, F.col("cell") == F.col("from_cell")).groupBy(F.col("to_cell").alias("cell")).agg(F.min("origin").alias("origin"))
        front = materialise(found.join(seen, "cell", "left_anti").select("cell", F.lit(hop).alias("hop"), "origin"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def g01_selected_cells(spark, sf_dir, deepest: int = 2):
    """Cells up to tier ``deepest`` (the standard compression) and all their prerequisites within 25 hops."""
    c = cells(spark, sf_dir)
    needs = edges(spark, sf_dir).where("type = 'prerequisite'").select(F.col("target").alias("from_cell"), F.col("source").alias("to_cell")).distinct()
    known = needs.join(c.select(F.col("cell").alias("to_cell")), "to_cell", "left_semi")
    return selected_closure(c.where(F.col("tier") <= deepest).select("cell"), known)


def strongest_edges(spark, sf_dir) -> DataFrame:
    """One edge for each (source, target, type): the heaviest, then the most confident."""
    best = F.max(F.struct("weight", "confidence")).alias("m")
    return edges(spark, sf_dir).groupBy("source", "target", "type").agg(best, F.count("*").alias("drafts")).select("source", "target", "type", "m.weight", "m.confidence", "drafts")


def g09_strongest_edges(spark, sf_dir):
    return strongest_edges(spark, sf_dir)


def g03_promoted_tiers(spark, sf_dir):
    """One tier up for cells that three others need, two for those that six need; tier 1 is the top."""
    needed = strongest_edges(spark, sf_dir).where("type = 'prerequisite'").groupBy(F.col("source").alias("cell")).agg(F.count("*").alias("out"))
    out = F.coalesce("out", F.lit(0))
    tier = F.greatest(F.lit(1), F.col("tier") - F.when(out >= 6, 2).when(out >= 3, 1).otherwise(0))
    return cells(spark, sf_dir).join(needed, "cell", "left").select("cell", "tier", out.alias("prerequisite_out"), tier.alias("promoted"))


def g05_statistics(spark, sf_dir):
    """Cells by chapter and tier, with how many have no edge at all."""
    e = edges(spark, sf_dir)
    linked = e.select(F.col("source").alias("cell")).unionByName(e.select(F.col("target").alias("cell"))).distinct().withColumn("linked", F.lit(1))
    return cells(spark, sf_dir).join(linked, "cell", "left").groupBy("chapter", "tier").agg(F.count("*").alias("cells"), F.count_if(F.col("linked").isNull()).alias("orphans"), F.sum("minutes").alias("minutes"))


def g35_cross_chapter(spark, sf_dir):
    c = cells(spark, sf_dir).select("cell", "chapter")
    a, b = c.select(F.col("cell").alias("source"), F.col("chapter").alias("c0")), c.select(F.col("cell").alias("target"), F.col("chapter").alias("c1"))
    return edges(spark, sf_dir).join(a, "source").join(b, "target").groupBy("type").agg(F.count("*").alias("edges"), F.count_if(F.col("c0") != F.col("c1")).alias("crossing"))


def g06_integrity(spark, sf_dir):
    """Violations: edges to cells outside the scope (tier 1 and 2), by which end is missing."""
    scope = cells(spark, sf_dir).where("tier <= 2").select("cell")
    e = edges(spark, sf_dir)
    no_source = e.join(scope, e["source"] == scope["cell"], "left_anti").groupBy("type").agg(F.count("*").alias("edges")).withColumn("problem", F.lit("source"))
    no_target = e.join(scope, e["target"] == scope["cell"], "left_anti").groupBy("type").agg(F.count("*").alias("edges")).withColumn("problem", F.lit("target"))
    return no_source.unionByName(no_target).select("problem", "type", "edges")


def g10_capped_edges(spark, sf_dir, most: int = 60):
    """Heaviest edges inside a chapter, at most min(2 n, 60) of them for its n cells."""
    c = cells(spark, sf_dir).select("cell", "chapter")
    budget = c.groupBy("chapter").agg(F.least(F.count("*") * 2, F.lit(most)).alias("cap"))
    a, b = c.select(F.col("cell").alias("source"), "chapter"), c.select(F.col("cell").alias("target"), F.col("chapter").alias("other"))
    inside = strongest_edges(spark, sf_dir).join(a, "source").join(b, "target").where("chapter = other").join(budget, "chapter")
    place = F.row_number().over(Window.partitionBy("chapter").orderBy(F.desc("weight"), F.desc("confidence"), "source", "target", "type"))
    return inside.withColumn("place", place).where("place <= cap").groupBy("chapter").agg(F.count("*").alias("edges"), F.sum("confidence").alias("confidence"), F.max("cap").alias("cap"))


def g11_two_cycles(spark, sf_dir):
    """Pairs of cells that need each other, and the edge to drop: lightest, then least confident, then by keys."""
    e = strongest_edges(spark, sf_dir).where(F.col("type").isin("prerequisite", "depends_on", "extends"))
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    cyclic = e.join(back, ["source", "target"], "left_semi").withColumns({"low": F.least("source", "target"), "high": F.greatest("source", "target")})
    drop = F.min(F.struct("weight", "confidence", "source", "target", "type")).alias("m")
    return cyclic.groupBy("low", "high").agg(F.count("*").alias("edges"), drop).select("low", "high", "edges", F.col("m.source").alias("drop_source"), F.col("m.type").alias("drop_type"))


def g19_cell_keys(spark, sf_dir):
    """Cells numbered inside their chapter by first use."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("cell")).agg(F.min("l_orderkey").alias("first"))
    place = F.row_number().over(Window.partitionBy("chapter").orderBy("first", "cell"))
    return cells(spark, sf_dir).join(first, "cell").select("cell", F.format_string("%s-%03d", F.col("chapter"), place).alias("cell_key"))


def g22_chapter_pairs(spark, sf_dir, window: int = 2):
    """Ordered pairs of chapters at most two places apart: a band join through shifted keys, not a product."""
    order = cells(spark, sf_dir).groupBy("chapter").agg(F.min("cell").alias("first"), F.count("*").alias("cells"))
    numbered = order.withColumn("no", F.row_number().over(Window.orderBy("first")))
    near = numbered.withColumn("to", F.explode(F.sequence(F.col("no") + 1, F.col("no") + window)))
    other = numbered.select(F.col("no").alias("to"), F.col("chapter").alias("other"), F.col("cells").alias("other_cells"))
    return near.join(other, "to").select("chapter", "other", (F.col("to") - F.col("no")).alias("distance"), (F.col("cells") + F.col("other_cells")).alias("cells"))


def g23_tier_distribution(spark, sf_dir):
    by = cells(spark, sf_dir).groupBy("chapter").agg(F.count("*").alias("n"), F.avg((F.col("tier") == 1).cast("double")).alias("first_share"), F.avg((F.col("tier") == 3).cast("double")).alias("third_share"))
    bad = F.when((F.col("first_share") < 0.15) | (F.col("first_share") > 0.45), "first").when((F.col("n") >= 6) & (F.col("third_share") < 0.10), "third")
    return by.select("chapter", "n", "first_share", "third_share", F.coalesce(bad, F.lit("none")).alias("failure"))


def g25_overlay(spark, sf_dir):
    """Base map with an overlay: cells removed, tiers overridden, edges that lose an end dropped."""
    base = cells(spark, sf_dir).where("cell % 50 <> 0")
    override = base.where("cell % 7 = 0").select("cell", F.lit(1).alias("new_tier"))
    kept = base.join(override, "cell", "left").withColumn("tier", F.coalesce("new_tier", "tier"))
    e = edges(spark, sf_dir)
    ends = base.select("cell")
    left = e.join(ends, e["source"] == ends["cell"], "left_semi").join(ends.withColumnRenamed("cell", "t"), F.col("target") == F.col("t"), "left_semi")
    degree = left.groupBy(F.col("source").alias("cell")).agg(F.count("*").alias("out"))
    return kept.join(degree, "cell", "left").groupBy("chapter", "tier").agg(F.count("*").alias("cells"), F.sum(F.coalesce("out", F.lit(0))).alias("edges"))


def g26_minutes(spark, sf_dir):
    """A cell's own minutes, else its chapter's median of the known ones."""
    c = cells(spark, sf_dir).withColumn("known", F.when(F.col("minutes") % 3 != 0, F.col("minutes").cast("double")))
    middle = c.groupBy("chapter").agg(F.median("known").alias("middle"))
    return c.join(middle, "chapter").groupBy("chapter").agg(F.sum(F.coalesce("known", "middle")).alias("minutes"), F.count_if(F.col("known").isNull()).alias("filled"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "g" and name[1:3].isdigit()}
