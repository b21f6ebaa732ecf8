import re
from collections import defaultdict

import numpy as np
import pytest

from heddle.llm.jaccard_join import jaccard_join, keep_one_of_each

DDL = "doc_id long, text string, size int, class_id string"


def brute(rows):
    """Class ids and numbers of links from all pairs of texts."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append(d)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return sorted(((d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, bases, copies, common=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(2000)] + ["é", "Ünï", "Word"]
    passage = rng.choice(vocabulary, 40).tolist()
    rows, doc = [], 0
    for _ in range(bases):
        base = rng.choice(vocabulary, rng.integers(30, 200)).tolist()
        if rng.random() < common:
            base = base + passage
        for c in range(rng.integers(1, copies + 1)):
            text = list(base)
            for _ in range(rng.integers(0, 4) if c else 0):
                text[rng.integers(len(text))] = "new" + str(rng.integers(10**6))
            rows.append((doc, " ".join(text)))
            doc += 1
    return rows


EDGE = [(9000, None), (9001, ""), (9002, " .,! "), (9003, "one"), (9004, "One!"), (9005, "one two three four"), (None, "one, two three FOUR"), (9005, "one two three four"), (9006, "é " * 9), (None, None), (9007, "long text " * 20000)]


@pytest.mark.parametrize("limit, common", [(8192, 0.3), (6, 0.6)])
def test_same_as_brute_force(spark, limit, common):
    rows = corpus(3, 60, 9, common) + EDGE
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DDL).repartition(5)
    got = jaccard_join(docs, limit=limit).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], DDL)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "completely other words in this text here"), (None, "a b c d e f g")]
    left = keep_one_of_each(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DDL)).collect()
    assert sorted((r["doc_id"] for r in left), key=str) == [1, 3, None]
    assert left[0].asDict().keys() == {"doc_id", "text", "size", "class_id"}
