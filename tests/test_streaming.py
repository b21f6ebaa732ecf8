import pytest

from heddle.streaming import jobs

DATA = "/root/testdata/sf0.001"


def test_trailing_actives_are_close_to_the_exact_count(spark):
    import duckdb

    exact = dict(duckdb.sql(f"WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM '{DATA}/events.parquet') SELECT strftime(d - i::INT, '%Y-%m-%d'), count(DISTINCT user_id) FROM d, generate_series(0, 6) AS g(i) GROUP BY 1").fetchall())
    got = {r["day"]: r["users"] for r in jobs.QUERIES["s09_actives_stream"](spark, DATA).collect()}
    assert got.keys() == exact.keys() and all(abs(got[d] - exact[d]) <= max(2, 0.05 * exact[d]) for d in exact)


def test_repeated_ids_are_dropped_within_the_watermark(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "view", 1.0, '{"k": 1}'), (1, "2024-01-01 00:30:00", 1, "view", 1.0, '{"k": 1}'), (2, "2024-01-01 00:40:00", 1, "view", 1.0, None)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["to_timestamp"]).to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    out = jobs.collected(jobs.s04_distinct(jobs.event_stream(spark, str(tmp_path))), "append")
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2]


@pytest.mark.parametrize("name", ["s10_cache_stream", "s12_alert_stream"])
def test_state_gives_rows(spark, name):
    assert jobs.QUERIES[name](spark, DATA).count() > 0


def shuffled_events(spark, folder, n=40_000):
    import datetime
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, str(start + datetime.timedelta(seconds=40 * i)), 1, rng.choice(["error", "view", "purchase", "click"]), 1.0, '{"k": 1}') for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.to_timestamp("ts")).repartitionByRange(4, "ts").sortWithinPartitions(F.rand(1)).write.parquet(f"{folder}/events.parquet")
    return sorted(rows)


def in_time(spark, folder):
    """A stream of the files in the order of their times, one a micro-batch."""
    import os
    import pathlib

    for k, path in enumerate(sorted(pathlib.Path(f"{folder}/events.parquet").glob("part-*"))):
        os.utime(path, (1_700_000_000 + 10 * k,) * 2)
    return jobs.event_stream(spark, folder, files=1)


def test_one_key_with_many_events(spark, tmp_path):
    rows = shuffled_events(spark, str(tmp_path))
    breaker, alerts, lookups, run, last, stored = set(), {}, {}, 0, [], None
    for i, at, _, kind, _, _ in rows:
        run = run + 1 if kind == "error" else 0
        if run == 3:
            breaker.add(i)
            run = 0
        last = [*last[-9:], int(kind == "error")]
        if sum(last) >= 4:
            alerts[i] = sum(last)
        if kind == "purchase":
            stored = i
        elif kind == "click":
            lookups[i] = "absent" if stored is None else "hit" if 40 * (i - stored) <= 24 * 3600 else "expired"
    stream = lambda: in_time(spark, str(tmp_path))
    assert {r["event_id"] for r in jobs.s11_breaker(stream()).collect()} == breaker
    assert {r["event_id"]: r["errors"] for r in jobs.s12_alerts(stream()).collect()} == alerts
    assert {r["event_id"]: r["result"] for r in jobs.s10_cache(stream()).collect()} == lookups


def test_sessions_go_on_over_batches(spark, tmp_path):
    import datetime

    from pyspark.sql import functions as F

    start, at, times = datetime.datetime(2024, 1, 1), 0, []
    for i in range(60):
        at += 600 if i % 7 else 4 * 3600
        times.append((i, str(start + datetime.timedelta(seconds=at)), 1, "view", 1.0, '{"k": 1}'))
    df = spark.createDataFrame(times, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.repartitionByRange(5, "ts").write.parquet(f"{tmp_path}/events.parquet")
    sizes = sorted(r["events"] for r in jobs.s05_sessions(in_time(spark, str(tmp_path))).collect())
    assert sizes == sorted([7] * 8 + [4])
    last = jobs.collected(jobs.s08_latest(in_time(spark, str(tmp_path))), "update", ["project_id"]).collect()
    assert [r["event_id"] for r in last] == [59]


def test_days_of_late_rows_are_recomputed(spark, tmp_path):
    import datetime

    from pyspark.sql import functions as F

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, str(start + datetime.timedelta(hours=i)), 1, "view", 1.0, '{"k": %d}' % (i % 5)) for i in range(0, 24 * 9)]
    rows = [r for r in rows if r[0] // 24 != 4 or r[0] % 50]  # no late row of the fifth day
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {str(r["day"]): (r["events"], r["k_sum"], r["recomputed"]) for r in jobs.s03_rollup(jobs.arrivals(spark, str(tmp_path))).collect()}
    for d in range(9):
        mine = [r[0] for r in rows if r[0] // 24 == d]
        day = str((start + datetime.timedelta(days=d)).date())
        assert got[day][:2] == (len(mine), sum(i % 5 for i in mine))
        assert got[day][2] == (d in (0, 2)), day  # rows 0, 50: their days are closed when they come with the last batch
    stream = jobs.collected(jobs.s01_daily(jobs.arrivals(spark, str(tmp_path))), "update", ["w", "event_type"])
    assert stream.agg(F.sum("events")).head()[0] < len(rows)  # the watermark alone drops them


def test_open_spans_time_out(spark, tmp_path, monkeypatch):
    import datetime

    from pyspark.sql import functions as F

    from heddle.streaming import timeouts

    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    parts = [
        [("a", "a1", "p", True, "started", t(0)), ("a", "a2", "p", False, "started", t(1)), ("b", "b1", "p", True, "started", t(2))],
        [("a", "a2", "p", False, "ended", t(5)), ("c", "c1", "q", True, "started", t(6)), ("c", "c1", "q", True, "ended", t(7)), ("h", *(f"h{0}",), "q", False, "started", t(8))] + [("h", f"h{i}", "q", False, "started", t(8)) for i in range(1, 400)],
        [("b", "b1", "p", True, "ended", t(20)), ("d", "d1", "q", True, "started", t(21))],
        [("", "", "", False, "now", t(40))],
    ]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "trace_id string, span_id string, project_id string, is_root boolean, kind string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/part={k:03d}")
    stream = spark.readStream.schema("trace_id string, span_id string, project_id string, is_root boolean, kind string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part=*")
    got = timeouts.run(stream, 24 * 60)
    assert sorted(r["span_id"] for r in got.where("trace_id <> 'h'").collect()) == ["a1"]
    assert got.where("trace_id = 'h'").agg(F.countDistinct("span_id")).head()[0] == 400


def test_spans_are_told_right_however_files_are_dealt(spark, tmp_path):
    import datetime

    from heddle.streaming import timeouts

    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    files = [  # two parts, since none and since hour 50; each in files that aren't in the order of time
        [("a", "a1", "p", True, "started", t(1), None), ("a", "a2", "p", False, "ended", t(49), None)],
        [("b", "b1", "p", True, "started", t(2), None), ("b", "b1", "p", True, "ended", t(3), None)],
        [("a", "a1", "p", True, "ended", t(2), None), ("a", "a2", "p", False, "started", t(48), None), ("c", "c1", "q", True, "started", t(0), None)],
        [("d", "d1", "q", True, "started", t(90), t(50))],
        [("d", "d2", "q", False, "started", t(51), t(50)), ("e", "e1", "q", True, "started", t(99), t(50))],
        [("d", "d2", "q", False, "ended", t(52), t(50))],
        [("", "", "", False, "now", t(120), t(120))],
    ]
    schema = "trace_id string, span_id string, project_id string, is_root boolean, kind string, at timestamp, since timestamp"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/part={k:03d}")
    got = timeouts.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part=*"), 24 * 60)
    assert sorted(r["span_id"] for r in got.collect()) == ["c1", "d1"]
