"""Open spans that time out: a stream of starts and ends whose open spans are carried from one micro-batch to the next.

A micro-batch and the spans carried are grouped by span, which Spark shuffles and spills: what has both its start and its end goes, what
started too long before the watermark is told as interrupted, the rest is carried.  The watermark is what the rows themselves say to be complete (``since``: nothing
earlier comes later), so that it doesn't matter how a part's rows are dealt to micro-batches; a stream without it takes its latest time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.sources.store import fresh_path, materialise
from heddle.sources.views import spans

OUT = "trace_id string, span_id string, project_id string, is_root boolean, started_at timestamp"
OPEN = f"{OUT}, ended_at timestamp"
FILES = 64  # of a micro-batch


def step(batch: DataFrame, carried: DataFrame, minutes: int, watermark) -> DataFrame:
    """Spans that aren't over: those of a micro-batch (trace_id, span_id, project_id, is_root, kind, at) and those carried, with ``told`` and ``kept``."""
    started, ended = F.col("kind") == "started", F.col("kind") == "ended"
    rows = batch.where(started | ended).select("trace_id", "span_id", "project_id", "is_root", F.when(started, F.col("at")).alias("started_at"), F.when(ended, F.col("at")).alias("ended_at"))
    by = rows.unionByName(carried).groupBy("trace_id", "span_id").agg(F.max("project_id").alias("project_id"), F.bool_or("is_root").alias("is_root"), F.max("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))
    limit = F.lit(watermark).cast("timestamp")
    started, ended = F.col("started_at").isNotNull(), F.col("ended_at").isNotNull()
    told = started & ~ended & (F.unix_micros("started_at") + minutes * 60_000_000 < F.unix_micros(limit))
    kept = F.when(started, ~ended & ~told).otherwise(F.col("ended_at") >= limit)  # an end whose start may still come
    return by.withColumns({"told": F.coalesce(told, F.lit(False)), "kept": F.coalesce(kept, F.lit(True))}).where("told or kept")


def run(events: DataFrame, minutes: int) -> DataFrame:
    """All that times out in what is there of a stream."""
    spark = events.sparkSession
    path, state = fresh_path(spark), fresh_path(spark)
    spark.createDataFrame([], OUT).write.parquet(f"{path}/batch_no=-1")
    spark.createDataFrame([], OPEN).write.parquet(f"{state}/batch_no=-1")
    marks = {-1: None}

    def write(batch: DataFrame, number: int) -> None:
        read = batch.sparkSession.read
        seen = batch.agg(F.max("since" if "since" in batch.columns else "at")).head()[0]
        marks[number] = max((m for m in (seen, marks.get(number - 1)) if m is not None), default=None)
        rows = materialise(step(batch, read.schema(OPEN).parquet(f"{state}/batch_no={number - 1}"), minutes, marks[number]))
        rows.where("told").drop("told", "kept", "ended_at").write.mode("overwrite").parquet(f"{path}/batch_no={number}")
        rows.where("kept").drop("told", "kept").write.mode("overwrite").parquet(f"{state}/batch_no={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", fresh_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(f"{path}/batch_no=*").drop("batch_no")


def span_events(spark: SparkSession, sf_dir: str, as_of: str, parts: int = 3) -> DataFrame:
    """Starts and ends of spans, written part by part in the order of their time and read as a stream; each row names the time at which its part begins
    (``since``).  Then one row at ``as_of``, which moves the watermark there."""
    s = spans(spark, sf_dir).where(F.col("started_at") < F.lit(as_of).cast("timestamp"))
    named = F.concat_ws("/", "span_id", F.unix_micros("started_at"), "duration_ms")  # ids of the tables given repeat
    base = s.select("trace_id", named.alias("span_id"), "project_id", F.col("parent_id").isNull().alias("is_root"), "started_at", "duration_ms", "status")
    ended = F.when(F.col("status") != "running", F.struct(F.lit("ended").alias("kind"), F.timestamp_micros(F.unix_micros("started_at") + F.col("duration_ms") * 1000).alias("at")))
    both = base.select("trace_id", "span_id", "project_id", "is_root", F.explode(F.array(F.struct(F.lit("started").alias("kind"), F.col("started_at").alias("at")), ended)).alias("e")).where("e is not null")
    rows = both.select("trace_id", "span_id", "project_id", "is_root", "e.kind", "e.at").where(F.col("at") < F.lit(as_of).cast("timestamp"))
    path, rows = fresh_path(spark), materialise(rows)
    cuts = sorted(set(rows.agg(F.percentile_approx("at", [k / parts for k in range(1, parts)], 100)).head()[0] or []))
    bounds = [None, *cuts, None]
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = rows.where(F.col("at") >= low) if low is not None else rows
        part = part.where(F.col("at") < high) if high is not None else part
        part.withColumn("since", F.lit(low).cast("timestamp")).write.mode("append").parquet(f"{path}/part={k:03d}")
    now = spark.range(1).select(F.lit("").alias("trace_id"), F.lit("").alias("span_id"), F.lit("").alias("project_id"), F.lit(False).alias("is_root"), F.lit("now").alias("kind"), F.lit(as_of).cast("timestamp").alias("at"), F.lit(as_of).cast("timestamp").alias("since"))
    now.write.mode("append").parquet(f"{path}/part={parts:03d}")
    return spark.readStream.schema(now.schema).option("maxFilesPerTrigger", FILES).parquet(f"{path}/part=*")


def s07_open_spans(spark: SparkSession, sf_dir: str, as_of: str = "1999-01-01 00:00:00", minutes: int = 1440) -> DataFrame:
    """Spans still running a day after they started, by project, and how many traces fail with them."""
    gone = run(span_events(spark, sf_dir, as_of), minutes)
    return gone.groupBy("project_id").agg(F.count("*").alias("interrupted"), F.count_if("is_root").alias("failed_traces"))


QUERIES = {"s07_open_spans": s07_open_spans}

SQL = {
    "s07_open_spans": """SELECT project_id, count(DISTINCT (span_id, started_at, duration_ms)) AS interrupted, count(DISTINCT (span_id, started_at, duration_ms)) FILTER (parent_id IS NULL) AS failed_traces FROM spans
        WHERE status = 'running' AND epoch_us(TIMESTAMP '1999-01-01 00:00:00') - epoch_us(started_at) > 1440 * 60000000::BIGINT GROUP BY 1"""
}
