import random

import pytest

from heddle.operators import cycles


def reaches(edges, a, b):
    seen, front = {a}, [a]
    while front:
        x = front.pop()
        for s, t in edges:
            if s == x and t not in seen:
                seen.add(t)
                front.append(t)
    return b in seen


def graph(seed, nodes=14, edges=34):
    r = random.Random(seed)
    pairs = sorted({(r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)})
    r.shuffle(pairs)
    return [(place, a, b) for place, (a, b) in enumerate(p for p in pairs if p[0] != p[1])]


def lightest(edges):
    """Takes the lightest edge that lies on a cycle out, until there is none."""
    left, gone = list(edges), set()
    while True:
        on_cycle = [e for e in left if reaches([x[1:] for x in left], e[2], e[1])]
        if not on_cycle:
            return gone
        worst = max(on_cycle)
        left.remove(worst)
        gone.add(worst[0])


@pytest.mark.parametrize("seed", range(25))
def test_small_groups(seed):
    edges = graph(seed)
    assert cycles.lightest_of_cycles(edges, 0, len(edges)) == lightest(edges)


@pytest.mark.parametrize("in_one_task", [1000, 7])
def test_all_groups_and_one_task_agree(spark, in_one_task):
    edges = graph(1, 8, 16) + [(place + 100, a + 50, b + 50) for place, a, b in graph(2, 7, 11)] + [(300, 900, 901), (301, 901, 902), (302, 902, 900), (303, 902, 903)]
    frame = spark.createDataFrame(edges, "place long, source long, target long")
    got = {r["place"] for r in cycles.cycle_breakers(frame, in_one_task).collect()}
    assert got == lightest(edges) and 302 in got


def test_strong_components(spark):
    edges = graph(3, 30, 45) + [(0, 100 + i, 101 + i) for i in range(12)] + [(0, 105, 102)]
    frame = spark.createDataFrame([("", a, b) for _, a, b in edges], "part string, source long, target long")
    got = {}
    for r in cycles.strong_components(frame).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    pairs = [e[1:] for e in edges]
    nodes = sorted({n for p in pairs for n in p})
    expected = {frozenset(m for m in nodes if m == n or reaches(pairs, n, m) and reaches(pairs, m, n)) for n in nodes}
    assert {frozenset(v) for v in got.values()} == {c for c in expected if len(c) > 1}


def test_without_cycles(spark):
    frame = spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "place long, source long, target long")
    assert cycles.cycle_breakers(frame).collect() == []
    assert cycles.cycle_breakers(frame.limit(0)).collect() == []


@pytest.mark.parametrize("in_one_task", [1000, 5])
def test_strong_components_in_one_task_or_many(spark, in_one_task):
    pairs = [e[1:] for e in graph(4, 24, 40)] + [(200 + i, 201 + i) for i in range(15)] + [(209, 203), (214, 211)]
    frame = spark.createDataFrame([(part, a, b) for part in ("x", "y") for a, b in pairs], "part string, source long, target long")
    got = {}
    for r in cycles.strong_components(frame, in_one_task).collect():
        got.setdefault((r["part"], r["root"]), set()).add(r["node"])
    nodes = sorted({n for p in pairs for n in p})
    expected = {frozenset(m for m in nodes if m == n or reaches(pairs, n, m) and reaches(pairs, m, n)) for n in nodes}
    for part in ("x", "y"):
        assert {frozenset(v) for (p, _), v in got.items() if p == part} == {c for c in expected if len(c) > 1}
