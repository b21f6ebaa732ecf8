"""The ledger as stored tables: written schemas, calls with their attempts nested, folders by month of start, written again a month at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heddle.sources.store import fresh_path
from heddle.sources.views import model_calls, product_events, spans

_ATTEMPT = "struct<provider_attempt: int, status: string, started_at: timestamp, ended_at: timestamp, latency_ms: bigint, retryable: boolean>"

#: The tables: name -> (columns, columns that must not be null, time of start).
TABLES: dict[str, tuple[str, list[str], str]] = {
    "calls": (
        "call_id string, trace_id string, project_id string, run_id string, stage string, provider string, requested_model string, resolved_model string, status string, started_at timestamp, ended_at timestamp, "
        f"latency_ms bigint, input_tokens bigint, output_tokens bigint, cost_micros bigint, is_synthetic boolean, attempts array<{_ATTEMPT}>",
        ["call_id", "stage", "provider", "requested_model", "status", "started_at"],
        "started_at",
    ),
    "spans": (
        "span_id string, trace_id string, parent_span_id string, project_id string, run_id string, name string, component string, kind string, status string, started_at timestamp, ended_at timestamp, duration_ms bigint, error_type string, error_message string, attributes map<string, string>",
        ["span_id", "trace_id", "name", "status", "started_at"],
        "started_at",
    ),
    "events": ("event_id string, trace_id string, span_id string, project_id string, occurred_at timestamp, name string, component string, level string, attributes map<string, string>", ["event_id", "occurred_at", "name"], "occurred_at"),
    "runs": (
        "run_id string, project_id string, trace_id string, kind string, status string, started_at timestamp, finished_at timestamp, duration_ms bigint, call_count bigint, failed_call_count bigint, input_tokens bigint, output_tokens bigint, models array<string>, error_message string",
        ["run_id", "status", "started_at"],
        "started_at",
    ),
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name][0])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table's schema in its order and types; those that ``df`` lacks are null, others go."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)))


def write(df: DataFrame, name: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Writes the rows of a table; (what is stored, what is not: rows that lack a required column).

    Months that ``df`` has rows of are replaced, others stay, so that a write that is done again changes nothing."""
    rows = conform(df, name)
    lacks = F.lit(False)
    for column in TABLES[name][1]:
        lacks = lacks | F.col(column).isNull()
    good = rows.where(~lacks).withColumn("month", F.date_format(TABLES[name][2], "yyyy-MM"))
    good.repartition("month", F.pmod(F.xxhash64(TABLES[name][1][0]), F.lit(4))).sortWithinPartitions("month", TABLES[name][2]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("month").parquet(path)
    return read(df.sparkSession, name, path), rows.where(lacks)


def read(spark: SparkSession, name: str, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """A stored table from the month ``since`` up to ``until`` (yyyy-MM, inclusive); other months' folders aren't read."""
    df = spark.read.schema(f"{TABLES[name][0]}, month string").parquet(path)
    df = df.where(F.col("month") >= since) if since else df
    return df.where(F.col("month") <= until) if until else df


def _later(start, millis):
    return F.timestamp_micros(F.unix_micros(start) + (F.col(millis) if isinstance(millis, str) else millis) * 1000)


def ledger_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls - the rows of a trace and model - with their attempts in order; the last one decides."""
    c = model_calls(spark, sf_dir)
    one = F.struct("started_at", "call_id", "latency_ms", "status", "stage", "provider", "project_id", "run_id", "is_synthetic", "input_tokens", "output_tokens", "cost_micros")
    by = c.groupBy("trace_id", "model").agg(F.array_sort(F.collect_list(one)).alias("a"))
    attempts = F.transform("a", lambda x, i: F.struct((i + 1).alias("provider_attempt"), x["status"].alias("status"), x["started_at"].alias("started_at"), _later(x["started_at"], x["latency_ms"]).alias("ended_at"), x["latency_ms"].alias("latency_ms"), (x["status"] != "succeeded").alias("retryable")))
    last = F.element_at("a", -1)
    total = lambda k: F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x[k], F.lit(0)))
    return by.select(
        F.concat_ws("/", "trace_id", "model").alias("call_id"), "trace_id", last["project_id"].alias("project_id"), last["run_id"].alias("run_id"), last["stage"].alias("stage"), last["provider"].alias("provider"),
        F.col("model").alias("requested_model"), F.col("model").alias("resolved_model"), last["status"].alias("status"), F.element_at("a", 1)["started_at"].alias("started_at"), _later(last["started_at"], last["latency_ms"]).alias("ended_at"),
        total("latency_ms").alias("latency_ms"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("cost_micros").alias("cost_micros"), last["is_synthetic"].alias("is_synthetic"), attempts.alias("attempts"),
    )


def x09_call_tables(spark, sf_dir, since: str = "1995-01", until: str = "1996-06"):
    """Calls and attempts written by month, and a window of them read back: by month and status."""
    path = fresh_path(spark)
    write(ledger_calls(spark, sf_dir), "calls", path)
    c = read(spark, "calls", path, since, until)
    retries = F.size(F.filter("attempts", lambda a: a["retryable"]))
    return c.groupBy("month", "status").agg(F.count("*").alias("calls"), F.sum(F.size("attempts")).alias("attempts"), F.sum(retries).alias("retryable"), F.sum("input_tokens").alias("input_tokens"), F.sum("latency_ms").alias("latency_ms"))


def x10_span_tables(spark, sf_dir, since: str = "1995-01", until: str = "1996-06"):
    """Spans and events written by month; the spans of a window, and events of a window, by month and name."""
    s = spans(spark, sf_dir).select("span_id", "trace_id", F.col("parent_id").alias("parent_span_id"), "project_id", "name", "status", "started_at", _later("started_at", "duration_ms").alias("ended_at"), "duration_ms")
    e = product_events(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), "project_id", F.col("ts").alias("occurred_at"), "name")
    at, events_at = fresh_path(spark), fresh_path(spark)
    write(s, "spans", at)
    write(e, "events", events_at)
    kept = read(spark, "spans", at, since, until).groupBy("month", "name").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms")).withColumn("source", F.lit("span"))
    told = read(spark, "events", events_at, "2024-01", "2024-01").groupBy("month", "name").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("duration_ms")).withColumn("source", F.lit("event"))
    return kept.unionByName(told)


def ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of each run's calls."""
    c = model_calls(spark, sf_dir).withColumn("ended_at", _later("started_at", "latency_ms"))
    failed = F.count_if(F.col("status") != "succeeded")
    by = c.groupBy("run_id").agg(
        F.min("project_id").alias("project_id"), F.min("trace_id").alias("trace_id"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("finished_at"), F.count("*").alias("call_count"), failed.alias("failed_call_count"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.array_sort(F.collect_set("model")).alias("models"),
    )
    return by.withColumns({"kind": F.lit("episode"), "status": F.when(F.col("failed_call_count") == 0, "succeeded").otherwise("failed"), "duration_ms": F.floor((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000)})


def x11_run_table(spark, sf_dir, until: str = "1995-01"):
    """Runs written by month of their start, and those of the first months read back."""
    path = fresh_path(spark)
    write(ledger_runs(spark, sf_dir), "runs", path)
    r = read(spark, "runs", path, None, until)
    return r.select("run_id", "month", "status", "duration_ms", "call_count", "failed_call_count", "input_tokens", "output_tokens", F.size("models").alias("models"), F.md5(F.array_join("models", ",").cast("binary")).alias("models_md5"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "x" and name[1:3].isdigit()}

SQL = {
    "x09_call_tables": """WITH a AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY trace_id, model) AS n FROM model_calls WINDOW w AS (PARTITION BY trace_id, model ORDER BY started_at, call_id, latency_ms)),
        c AS (SELECT trace_id, model, strftime(min(started_at), '%Y-%m') AS month, any_value(status) FILTER (r = n) AS status, count(*) AS attempts, count(*) FILTER (status <> 'succeeded') AS retryable, sum(input_tokens) AS input_tokens, sum(latency_ms) AS latency_ms FROM a GROUP BY ALL)
        SELECT month, status, count(*) AS calls, sum(attempts)::BIGINT AS attempts, sum(retryable)::BIGINT AS retryable, sum(input_tokens)::BIGINT AS input_tokens, sum(latency_ms)::BIGINT AS latency_ms FROM c WHERE month BETWEEN '1995-01' AND '1996-06' GROUP BY ALL""",
    "x10_span_tables": """SELECT strftime(started_at, '%Y-%m') AS month, name, count(*) AS n, sum(duration_ms)::BIGINT AS duration_ms, 'span' AS source FROM spans WHERE strftime(started_at, '%Y-%m') BETWEEN '1995-01' AND '1996-06' GROUP BY ALL
        UNION ALL SELECT strftime(ts, '%Y-%m'), name, count(*), 0::BIGINT, 'event' FROM core_events WHERE strftime(ts, '%Y-%m') = '2024-01' AND name IS NOT NULL GROUP BY ALL""",
    "x11_run_table": """WITH r AS (SELECT run_id, strftime(min(started_at), '%Y-%m') AS month, count(*) AS call_count, count(*) FILTER (status <> 'succeeded') AS failed_call_count, max(epoch_ms(started_at) + latency_ms) - min(epoch_ms(started_at)) AS duration_ms,
            sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, list_sort(list(DISTINCT model) FILTER (model IS NOT NULL)) AS models FROM model_calls GROUP BY 1)
        SELECT run_id, month, CASE WHEN failed_call_count = 0 THEN 'succeeded' ELSE 'failed' END AS status, duration_ms, call_count, failed_call_count, input_tokens, output_tokens, len(models)::INT AS models, md5(array_to_string(models, ',')) AS models_md5 FROM r WHERE month <= '1995-01'""",
}
