import zlib

import pytest

from heddle.llm.shard_ring import overflow_plan, ring_shards


def frame(spark, n, extra=()):
    rows = [(i, "text é " * (i % 7), "x", 5) for i in range(n)] + list(extra)
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, n int")


def test_rows_law(spark):
    extra = [(None, None, "x", 1)] * 40 + [(7, "same", "x", 1)] * 900 + [(None, "", "y", 2)]
    out = ring_shards(frame(spark, 1800, extra)).toPandas()
    assert len(out) == 1800 + len(extra) and out["grown_shard"].isna().all() and set(out["law"]) == {"rows"}
    counts = out["shard"].value_counts()
    assert sorted(counts.index) == list(range(24)) and counts.max() - counts.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    row = out[out.doc_id == 8].iloc[0]
    assert row["size"] == len(("text é " * 1).encode()) + 8 and row["text_crc32"] == zlib.crc32(b"text \xc3\xa9 ")
    assert set(out[out.doc_id.isna()]["size"]) == {8} and set(out[out.doc_id.isna()]["text_crc32"]) == {0}


def test_few_rows_and_none(spark):
    assert ring_shards(frame(spark, 0)).count() == 0
    assert ring_shards(frame(spark, 5)).toPandas()["shard"].nunique() == 5


def test_same_again_and_limited_movement(spark):
    docs = frame(spark, 6000)
    a, b = (ring_shards(docs).toPandas().set_index("doc_id")["shard"] for _ in range(2))
    assert (a == b.loc[a.index]).all()
    more = ring_shards(docs, shards=25, slack=0.25).toPandas().set_index("doc_id")["shard"]
    fewer = ring_shards(docs, slack=0.25).toPandas().set_index("doc_id")["shard"]
    assert (more != fewer.loc[more.index]).mean() < 0.25
    assert more.value_counts().max() <= 1.25 * 6000 / 25 + 1


@pytest.mark.parametrize("loads", [[0, 0, 0], [9, 0, 0], [1, 5, 3], [2, 2, 5]])
def test_overflow_goes_clockwise(loads):
    plan = overflow_plan(loads, [0, 1, 2], [3, 3, 3])
    held = {}
    for arc, first, n, shard, slot in plan:
        for k in range(n):
            held[(arc, first + k)] = shard
    assert len(held) == sum(loads)
    for arc, n in enumerate(loads):
        for rank in range(min(n, 3) if loads[arc] else 0):
            assert held[(arc, rank)] == arc
