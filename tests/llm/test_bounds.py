"""Bounds that lose nothing: sketches of links at 0.8, groups of long texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from heddle.llm import jaccard_join
from tests.llm.test_jaccard_join import DDL, brute, corpus


def test_a_link_with_unlike_sketches_is_likely():
    rng = np.random.default_rng(0)
    for _ in range(60_000):
        values = rng.integers(0, 2**64, 500, dtype=np.uint64)
        sets = [np.sort(values[:450]), np.sort(values[50:])]  # 400 of 500 in common
        s = np.array([jaccard_join.sketch(v) for v in sets])
        if (s[0] == s[1])[s[0] != 0].sum() < 0.6 * ((s[0] != 0) | (s[1] != 0)).sum():
            break
    else:
        raise AssertionError("no such pair")
    left, _ = jaccard_join.likely_pairs(np.array([450, 450]), s, np.zeros(2, np.int32), False)
    assert len(left) == 1


def test_groups_of_long_texts_are_compared_in_blocks(spark):
    bucket = spark.createDataFrame([(1, [], r, 3, 40_000_000) for r in range(3)], "bucket long, path array<long>, rep long, m long, hashes long")
    assert jaccard_join._in_blocks(bucket, 8192).agg(F.max("two")).first()[0] > 0
    rows = corpus(5, 20, 9, 0.3)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DDL).repartition(5)
    got = jaccard_join.jaccard_join(docs, hashes=300).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute(rows)


def test_a_group_of_near_copies_takes_bounded_memory(monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRS", 1 << 16, raising=False)
    rows, common = 1200, np.arange(1, 41, dtype=np.uint64) * np.uint64(10**17)
    sets = [np.sort(np.append(common, np.uint64(r + 1))) for r in range(rows)]  # 40 of 42 in common
    columns = {
        "bucket": pa.array([7] * rows), "path": pa.array([[]] * rows, pa.list_(pa.int64())), "one": pa.array([0] * rows), "two": pa.array([0] * rows), "block": pa.array([0] * rows), "rep": pa.array(range(rows)),
        "n": pa.array([41] * rows), "sketch": pa.array([jaccard_join.sketch(common).tobytes()] * rows), "tokens": pa.array([[7, 3] if r < 2 else [7] for r in range(rows)]), "size": pa.array([1 + r % 2 for r in range(rows)]), "set": pa.array([s.tobytes() for s in sets]),
    }
    group = pa.RecordBatch.from_pydict(columns)
    tracemalloc.start()
    (marked,) = jaccard_join._mark(iter([group]))
    (found,) = jaccard_join._verify(iter([group]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6  # all 720 thousand pairs at once took several times as much
    assert marked.num_rows == rows and set(found.column("root").to_pylist()) == {0}
    # the pair of the first two belongs to bucket 3
    assert found.column("links").to_pylist() == [rows * 3 // 2 - (1 + r % 2) - (2 - r if r < 2 else 0) for r in range(rows)]
