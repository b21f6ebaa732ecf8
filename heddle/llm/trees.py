"""Fitted Spark ML trees as Spark columns: paths of a tree, and boosted trees as one expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _node(node, names: list[str]) -> dict:
    if node.subtreeDepth() == 0:
        return {"value": float(node.prediction())}
    split = node.split()
    return {
        "name": names[split.featureIndex()],
        "at": float(split.threshold()),
        "low": _node(node.leftChild(), names),
        "high": _node(node.rightChild(), names),
    }


def trees_of(model, names: list[str]) -> list[dict]:
    """The trees of a fitted ensemble as nested dicts: name, at, low (<= at), high; or value."""
    return [_node(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") else tree.rootNode(), names) for tree in model.trees]


def paths(tree: dict, before: tuple = ()) -> list[tuple]:
    """Every path from the root to any node: a tuple of (name, '<=' or '>', threshold)."""
    if "value" in tree:
        return []
    out = []
    for side, sign in (("low", "<="), ("high", ">")):
        here = (*before, (tree["name"], sign, tree["at"]))
        out += [here, *paths(tree[side], here)]
    return out


def condition(path: tuple) -> Column:
    tests = [F.col(name) <= F.lit(at) if sign == "<=" else F.col(name) > F.lit(at) for name, sign, at in path]
    return reduce(lambda a, b: a & b, tests)


def value(tree: dict) -> Column:
    if "value" in tree:
        return F.lit(tree["value"])
    return F.when(F.col(tree["name"]) <= F.lit(tree["at"]), value(tree["low"])).otherwise(value(tree["high"]))
