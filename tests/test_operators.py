"""Every query against its SQL on the smallest tables, and the traps on literal rows."""

import datetime
import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from heddle.functions.columns import fold_for_match, fold_label, half_even, jaccard, ref_week, token_estimate
from heddle.operators import documents, graphs, ledger, metrics
from heddle.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(f"{float(value):.6g}")
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cursor.fetchall()), key=str)
    assert mine == theirs


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_a_monday_belongs_to_the_week_before(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(d) for d in range(21)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", ref_week(F.col("d")).alias("w")).collect()
    for r in rows:
        expected = r["d"] - datetime.timedelta(7 if r["d"].weekday() == 0 else r["d"].weekday())
        assert r["w"] == expected


def test_half_even_and_tokens(spark):
    assert [one(spark, half_even(F.col("v")), v=v) for v in (0.5, 1.5, 2.5, 3.5)] == [0.0, 2.0, 2.0, 4.0]
    assert [one(spark, token_estimate(F.col("v")), v=v) for v in ("", "  ", "abc", "abcd", "a  b\n c")] == [0, 0, 1, 2, 2]


def test_the_two_foldings_differ_in_the_non_joiner(spark):
    text = "می‌خواهم «متن» ٣"
    assert "‌" not in one(spark, fold_for_match(F.col("v")), v=text)
    assert one(spark, fold_for_match(F.col("v")), v=text).startswith("میخواهم") and one(spark, fold_label(F.col("v")), v=text).startswith("می خواهم")


def test_jaccard_of_empty_sets_is_zero(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r["x"] for r in df.select(jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [0.0, 0.0, 1 / 3]


def test_prices_are_effective_dated_and_never_zero(spark):
    ts = lambda s: datetime.datetime.fromisoformat(s)
    calls = spark.createDataFrame([("m", ts(t), 1_000_000, 0) for t in ("2023-12-31", "2024-01-01", "2024-05-31", "2024-06-01")] + [("n", ts("2024-06-01"), 1, 1)], "model string, started_at timestamp, input_tokens long, output_tokens long")
    price = spark.createDataFrame([("m", ts("2024-01-01"), 10, 1, 2), ("m", ts("2024-06-01"), 20, 1, 2)], "model string, effective_from timestamp, input_per_million long, output_per_million long, per_call long")
    got = [r["price_micros"] for r in ledger.priced_calls(calls, price).orderBy("model", "started_at").collect()]
    assert got == [None, 12, 12, 22, None]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20])
def test_nearest_rank(spark, n):
    df = spark.createDataFrame([("g", v) for v in range(n)], "g string, v long")
    row = ledger.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (row["p50"], row["p95"]) == (round((n - 1) * 0.5), round((n - 1) * 0.95))


def test_packing_loses_nothing_and_keeps_order(spark):
    tokens = [10, 170, 5, 200, 60, 70, 1, 30, 90]
    items = spark.createDataFrame([([(t, i == 3) for i, t in enumerate(tokens)],)], "items array<struct<tokens: long, alone: boolean>>")
    bins = items.select(documents.pack_in_order(F.col("items"), 120, 180).alias("b")).first()["b"]
    assert len(bins) == len(tokens) and bins == sorted(bins)
    for b in set(bins):
        members = [t for t, x in zip(tokens, bins) if x == b]
        assert sum(members) <= 180 or len(members) == 1


def test_closure_ends_on_a_cycle_and_at_the_hop_limit(spark):
    steps = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "from_cell long, to_cell long")
    seeds = spark.createDataFrame([(1,)], "cell long")
    assert {r["cell"]: r["hop"] for r in graphs.reach(seeds, steps).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    assert {r["cell"] for r in graphs.reach(seeds, steps, 2).collect()} == {1, 2, 3}


def test_tree_depths_treats_a_missing_parent_as_root(spark):
    nodes = spark.createDataFrame([("a", None, "t"), ("b", "a", "t"), ("c", "b", "t"), ("d", "gone", "t")], "node_id string, parent_id string, trace_id string")
    assert {r["node_id"]: r["depth"] for r in ledger.tree_depths(nodes).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_deep_trees_and_their_cut_children(spark):
    nodes = spark.createDataFrame([(str(i), str(i - 1), "t") for i in range(1, 12)] + [("0", None, "t"), ("x", "8", "t")], "node_id string, parent_id string, trace_id string")
    depths = {r["node_id"]: r["depth"] for r in ledger.tree_depths(nodes, 20).collect()}
    assert depths == {str(i): i for i in range(12)} | {"x": 9}
    assert {r["node_id"]: r["truncated"] for r in ledger.truncated_children(nodes).collect()} == {"8": 2}


def test_secrets_are_masked(spark):
    text = "call sk-abcdefgh1234 or +49 151 2345678 api_key = hunter2, see /home/someone/file"
    out = one(spark, ledger.redact(F.col("v")), v=text)
    assert all(x not in out for x in ("abcdefgh1234", "2345678", "hunter2", "someone"))


def test_rollup_overwrites_only_its_own_partitions(spark, tmp_path):
    schema = "metric_key string, day string, dimension_json string, value double, numerator double, denominator double"
    row = lambda key, day, v: (key, day, "{}", v, None, None)
    for rows in ([row("a", "2024-01-01", 1.0), row("a", "2024-01-02", 2.0), row("b", "2024-01-01", 3.0)], [row("a", "2024-01-02", 9.0)], [row("a", "2024-01-02", 9.0)]):
        metrics.write_rollup(spark.createDataFrame(rows, schema), f"{tmp_path}/rollup")
    got = {(r["metric_key"], str(r["day"])): r["value"] for r in spark.read.parquet(f"{tmp_path}/rollup").collect()}
    assert got == {("a", "2024-01-01"): 1.0, ("a", "2024-01-02"): 9.0, ("b", "2024-01-01"): 3.0}


def test_nodes_without_a_parent_are_not_put_into_one_task(spark):
    from pyspark.sql import functions as F

    nodes = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("n"), "id").alias("node_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("n"), F.col("id") + 1)).alias("parent_id"), F.lit("t").alias("trace_id"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = ledger.root_nodes(nodes).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(sizes) == 3000 and max(sizes) <= 375


def test_conservation_deals_each_line_once(spark, tmp_path):
    from heddle.operators import evidence

    lines = [(1, 7, "A", 5.0), (1, 7, "A", 5.0), (1, 8, "A", 5.0), (1, 8, "R", 5.0), (2, 7, "N", 1.0), (2, 7, "A", 1.0), (2, 8, "N", 1.0), (2, 8, "N", 1.0), (3, 7, "R", None), (3, 7, "R", 2.0), (3, 8, None, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = evidence.e27_conservation(spark, str(tmp_path))
    assert {r["state"]: r["ids"] for r in got.collect()} == {"repeated": 1, "several_types": 1, "both": 1, "unresolved": 2, "used": 1, "no_evidence": 1}
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
