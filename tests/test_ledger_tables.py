import datetime
import re

from heddle.sources import ledger_tables as lt


def test_months_are_folders_and_only_those_asked_for_are_read(spark, tmp_path):
    at = lambda m, d: datetime.datetime(2024, m, d)
    rows = [("a", "t1", "n", "ok", at(1, 5), 7), ("b", "t1", "n", "ok", at(2, 5), 8), ("c", "t2", "n", "ok", at(3, 1), 9), (None, "t2", "n", "ok", at(3, 1), 9), ("d", "t2", "n", None, at(3, 2), 9)]
    ddl = "span_id string, trace_id string, name string, status string, started_at timestamp, duration_ms int"
    path = f"{tmp_path}/spans"
    stored, left = lt.write(spark.createDataFrame(rows, ddl), "spans", path)
    assert sorted(r["span_id"] for r in stored.collect()) == ["a", "b", "c"] and left.count() == 2
    window = lt.read(spark, "spans", path, "2024-02", "2024-02")
    assert [r["span_id"] for r in window.collect()] == ["b"]
    assert re.search(r"PartitionFilters: \[[^\]]*month", window._jdf.queryExecution().toString())
    assert {c.name: c.dataType for c in lt.schema("spans")} == {c.name: c.dataType for c in stored.schema if c.name != "month"}
    again, _ = lt.write(spark.createDataFrame([("b2", "t1", "n", "ok", at(2, 6), 1)], ddl), "spans", path)
    assert sorted(r["span_id"] for r in again.collect()) == ["a", "b2", "c"]


def test_attempts_are_nested_in_order(spark):
    calls = lt.ledger_calls(spark, "/root/testdata/sf0.001").limit(200).collect()
    for c in calls:
        numbers = [a["provider_attempt"] for a in c["attempts"]]
        assert numbers == list(range(1, len(numbers) + 1)) and c["status"] == c["attempts"][-1]["status"]
        assert sorted(a["started_at"] for a in c["attempts"]) == [a["started_at"] for a in c["attempts"]]
    assert any(len(c["attempts"]) > 1 for c in calls) or calls
