"""Cycles of any length in a typed graph: its strong components, and the edges that break all cycles.

The rule: while there is a cycle, the lightest edge of one goes, and the cycle taken is the one whose lightest edge is lightest of
all.  So an edge goes if and only if it is the lightest edge of some cycle, that is if its ends are strongly connected by
edges that aren't lighter; which edges those are doesn't depend on the order of the work."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.graphs import strongest_edges
from heddle.plans.graph_script_sql import BEST
from heddle.sources.store import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that executors need no copy of this package

#: The types of edges that must not form a cycle.
CYCLE_TYPES = ["prerequisite", "depends_on", "extends"]
IN_ONE_TASK = 1_000_000  # edges that one task holds; what is larger is split first


def _nodes(edges: DataFrame, end: str) -> DataFrame:
    return edges.select("part", F.col(end).alias("node")).distinct()


def _both_in(edges: DataFrame, nodes: DataFrame, how: str = "left_semi") -> DataFrame:
    """Edges both of whose ends are (or, anti, aren't) among ``nodes`` (part, node)."""
    for end in ("source", "target"):
        edges = edges.join(nodes.withColumnRenamed("node", end), ["part", end], how)
    return edges


def _spread_greatest(edges: DataFrame) -> DataFrame:
    """(part, node, colour): the greatest node from which each one can be reached.  Nodes send their colour on only when it has changed."""
    colours = materialise(_nodes(edges, "source").union(_nodes(edges, "target")).distinct().withColumn("colour", F.col("node")))
    changed = colours
    while True:
        sent = edges.join(changed.withColumnRenamed("node", "source"), ["part", "source"]).groupBy("part", F.col("target").alias("node")).agg(F.max("colour").alias("sent"))
        now = materialise(colours.join(sent, ["part", "node"], "left").select("part", "node", "colour", F.greatest("colour", F.coalesce("sent", "colour")).alias("now")))
        colours = now.select("part", "node", F.col("now").alias("colour"))
        changed = now.where("now <> colour").select("part", "node", F.col("now").alias("colour"))
        if changed.isEmpty():
            return colours


def _small_components(group: pd.DataFrame) -> pd.DataFrame:
    held = pd.Series(components_of(list(zip(group["source"].tolist(), group["target"].tolist()))))
    held = held[held.duplicated(keep=False)]
    return pd.DataFrame({"part": group["part"].iloc[0], "node": held.index, "root": held.to_numpy()})


def strong_components(edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(part, node, root) of the strong components of two nodes or more of ``edges`` (part, source, target); parts don't touch.

    Nodes without an edge in or out go.  Each colour then holds the whole component of its greatest node - what reaches that node
    inside the colour - and no other component lies in two colours.  Once no more than ``in_one_task`` edges are left, the rest is searched part by part."""
    left = materialise(edges.select("part", "source", "target").where("source <> target").distinct())
    size, found = left.count(), []
    while True:
        before = size
        left = materialise(_both_in(left, _nodes(left, "source").intersect(_nodes(left, "target"))))
        size = left.count()
        if size <= in_one_task:
            if size:
                kind = left.schema["source"].dataType.simpleString()
                found.append(materialise(left.groupBy("part").applyInPandas(_small_components, f"part string, node {kind}, root {kind}")))
            break
        if size < 0.9 * before:
            continue
        colours = _spread_greatest(left)
        ends = [colours.select("part", F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("source", "target")]
        inside = materialise(left.join(ends[0], ["part", "source"]).join(ends[1], ["part", "target"]).where("source_colour = target_colour").select("part", "source", "target", F.col("source_colour").alias("root")))
        front = reached = materialise(inside.where("target = root").select("part", F.col("root").alias("node"), "root").distinct())
        while True:
            new = inside.join(front.select("part", F.col("node").alias("target")), ["part", "target"]).select("part", F.col("source").alias("node"), "root").distinct()
            front = materialise(new.join(reached.select("part", "node"), ["part", "node"], "left_anti"))
            if front.isEmpty():
                break
            reached = materialise(reached.unionByName(front))
        found.append(reached)
        left = materialise(_both_in(inside.select("part", "source", "target"), reached.select("part", "node"), "left_anti"))
    if not found:
        return edges.select("part", F.col("source").alias("node"), F.col("source").alias("root")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components_of(edges: list[tuple[int, int]]) -> dict[int, int]:
    """(node: component) of a bounded group of edges, by one search in depth without recursion."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    component: dict[int, int] = {}
    open_nodes: list[int] = []
    for start in out:
        if start in order:
            continue
        order[start] = low[start] = len(order)
        open_nodes.append(start)
        path = [(start, iter(out[start]))]
        while path:
            node, targets = path[-1]
            for target in targets:
                if target not in order:
                    order[target] = low[target] = len(order)
                    open_nodes.append(target)
                    path.append((target, iter(out[target])))
                    break
                if target not in component:
                    low[node] = min(low[node], order[target])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == order[node]:
                    while True:
                        member = open_nodes.pop()
                        component[member] = node
                        if member == node:
                            break
    return component


def lightest_of_cycles(edges: list[tuple[int, int, int]], begin: int, end: int) -> set[int]:
    """Places of the edges (place, source, target; the heaviest first) whose ends are strongly connected by edges up to their own,
    those being connected between places ``begin`` and ``end``: halving, and contracting what the first half connects."""
    out, work = set(), [(edges, begin, end)]
    while work:
        part, low, high = work.pop()
        part = [e for e in part if e[1] != e[2]]
        if not part or not any(e[0] >= low for e in part):
            continue
        if high - low <= 1:
            held = components_of([e[1:] for e in part if e[0] <= low])
            out |= {p for p, a, b in part if p >= low and a in held and b in held and held[a] == held[b]}
            continue
        middle = (low + high) // 2
        held = components_of([e[1:] for e in part if e[0] < middle])
        root = lambda n: held.get(n, n)  # noqa: B023, E731
        joined = [e for e in part if root(e[1]) == root(e[2])]
        out |= {e[0] for e in joined if e[0] >= middle}
        work.append(([e for e in joined if e[0] < middle], low, middle))
        work.append(([(p, root(a), root(b)) for p, a, b in part if root(a) != root(b)], middle, high))
    return out


def _broken(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("place")
    own = int((group["place"] < group["low"]).sum())  # places inside the group, so that halves are halves
    rows = list(zip(range(len(group)), group["a"].tolist(), group["b"].tolist()))
    return group.iloc[sorted(lightest_of_cycles(rows, own, len(rows)))][["place"]]


def _bounded(parts: DataFrame) -> DataFrame:
    """``parts`` (part, a, b, place, low) with the bounds of the places that are still open; parts where none is open go."""
    bounds = parts.where("place >= low").groupBy("part").agg(F.min("place").alias("low"), (F.max("place") + 1).alias("high"))
    return parts.drop("low").join(bounds, "part")


def cycle_breakers(edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """The ``edges`` (place, source, target; places from 0, the heaviest first, each once) that are the lightest of some cycle.

    Groups of edges that more than one task should hold are halved by place until they are small: the components of the heavier
    half connect some ends, whose edges stay together, and are contracted for the rest."""
    marked = materialise(edges.select(F.lit("").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"), "place"))
    roots = strong_components(marked.select("part", F.col("a").alias("source"), F.col("b").alias("target")), in_one_task)
    a, b = (roots.select(F.col("node").alias(n), F.col("root").alias(f"r{n}")) for n in ("a", "b"))
    left = marked.join(a, "a").join(b, "b").where("ra = rb").select(F.col("ra").cast("string").alias("part"), "a", "b", "place", F.lit(0).cast("long").alias("low"))
    left, small, gone = materialise(_bounded(left)), [], []
    while True:
        large = materialise(left.groupBy("part").agg(F.count("*").alias("edges")).where(F.col("edges") > in_one_task).select("part"))
        small.append(left.join(large, "part", "left_anti"))
        if large.isEmpty():
            break
        big = materialise(left.join(large, "part", "left_semi"))
        last = F.col("high") - F.col("low") <= 1
        middle = F.when(last, F.col("high")).otherwise(F.floor((F.col("low") + F.col("high")) / 2))
        roots = strong_components(big.where(F.col("place") < middle).select("part", F.col("a").alias("source"), F.col("b").alias("target")), in_one_task)
        a, b = (roots.select("part", F.col("node").alias(n), F.col("root").alias(f"r{n}")) for n in ("a", "b"))
        held = materialise(big.join(a, ["part", "a"], "left").join(b, ["part", "b"], "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b"), "middle": middle, "last": last}))
        joined = F.col("ra") == F.col("rb")
        gone.append(held.where(joined & (F.col("place") >= F.when(F.col("last"), F.col("low")).otherwise(F.col("middle")))).select("place"))
        held = held.where("not last")
        first = held.where(joined & (F.col("place") < F.col("middle"))).select(F.concat("part", F.lit("<"), "ra").alias("part"), "a", "b", "place", "low")
        second = held.where(~joined).select(F.concat("part", F.lit(">")).alias("part"), F.col("ra").alias("a"), F.col("rb").alias("b"), "place", F.col("middle").alias("low"))
        left = materialise(_bounded(first.unionByName(second)))
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small groups with long work aren't put into few tasks
    out = out.repartition(tasks, "part").groupBy("part").applyInPandas(_broken, "place long")
    for more in gone:
        out = out.unionByName(more)
    return out


def ordered_edges(spark, sf_dir) -> DataFrame:
    """(place, source, target, type, weight, confidence): strongest edges of the types that must not form a cycle, the heaviest first."""
    e = strongest_edges(spark, sf_dir).where(F.col("type").isin(CYCLE_TYPES))
    # ranks by range: a part's own place behind the number of those in the parts before it
    keys = [F.desc("weight"), F.desc("confidence"), F.desc("source"), F.desc("target"), F.desc("type")]
    ranged = materialise(materialise(e).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()))
    counts = ranged.groupBy(F.shiftright("id", 33).alias("at")).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("at")) - F.col("n")).select("at", "before")  # one row a partition
    return ranged.withColumn("at", F.shiftright("id", 33)).join(F.broadcast(before), "at").select((F.col("before") + F.col("id") - F.shiftleft("at", 33)).alias("place"), "source", "target", "type", "weight", "confidence")


def g11_cycles(spark, sf_dir):
    """Cells on a cycle of prerequisite, depends_on or extends edges, of any length, with the least cell that shares one with them."""
    e = strongest_edges(spark, sf_dir).where(F.col("type").isin(CYCLE_TYPES))
    found = strong_components(e.select(F.lit("").alias("part"), "source", "target"))
    least = found.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("cells"))
    return found.join(least, "root").select(F.col("node").alias("cell"), "component", "cells")


def g12_broken_cycles(spark, sf_dir):
    """The edges to drop so that no cycle is left: each the lightest (weight, confidence, keys) of a cycle.  All edges, whatever their chapter."""
    e = materialise(ordered_edges(spark, sf_dir))
    return e.join(cycle_breakers(e), "place", "left_semi").select("source", "target", "type", "weight", "confidence")


QUERIES = {"g11_cycles": g11_cycles, "g12_broken_cycles": g12_broken_cycles}

SQL = {
    "g11_cycles": f"""WITH RECURSIVE {BEST}, e AS (SELECT DISTINCT source, target FROM best WHERE type IN ('prerequisite', 'depends_on', 'extends')),
        r AS (SELECT source AS a, target AS b FROM e UNION SELECT r.a, e.target FROM r JOIN e ON e.source = r.b),
        c AS (SELECT a AS cell, min(b) AS component, count(*) AS cells FROM r WHERE EXISTS (SELECT 1 FROM r x WHERE x.a = r.b AND x.b = r.a) GROUP BY 1)
        SELECT cell, component, cells FROM c WHERE cells > 1""",
}
