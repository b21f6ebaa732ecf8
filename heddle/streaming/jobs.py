"""Structured Streaming versions of the rollups: each reads the events as a stream.

The registered queries run a stream over all files that are there (``availableNow``) into Parquet files in the shared
folder, with a checkpoint location, and return what was written: no row passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.columns import iso, ref_week
from heddle.sources.store import fresh_path, materialise
from heddle.sources.views import table
from heddle.streaming.carried import alert_step, breaker_step, cache_step, carried, session_step

LATE = "2 hours"
FILES = 32  # of a micro-batch


def as_events(raw: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("user_id"), "event_type", "value", k.alias("k"), F.concat(F.lit("p"), (F.col("user_id") * 7 + k % 5) % 60).alias("project_id"))


def event_stream(spark: SparkSession, sf_dir: str, files: int = FILES) -> DataFrame:
    """The events table as a stream with event time ``at``, so many files to a micro-batch; an event may come late by two hours."""
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", files)
    return as_events(raw.parquet(f"{sf_dir}/events.parquet*"))


def collected(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its result table.

    Each micro-batch is written to a folder of its number, so that one that is run again replaces itself; in the mode ``update`` the last row
    that was written for each of ``keys`` is the result."""
    spark = stream.sparkSession
    path, state = fresh_path(spark), fresh_path(spark)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch_no=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch_no=*")
    if keys:
        others = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_no").alias("last")).select(*keys, "last.*")
    return rows.select(*stream.columns)


def s01_daily(events: DataFrame) -> DataFrame:
    """Daily tumbling rollup by event type."""
    return events.withWatermark("at", LATE).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.col("k")).alias("k_sum"))


def s02_weekly(events: DataFrame) -> DataFrame:
    """Weekly rollup with the reporting-week rule."""
    return events.groupBy(iso(ref_week(F.to_date("at"))).alias("week")).agg(F.count("*").alias("events"), F.sum("k").alias("k_sum"))


def s04_distinct(events: DataFrame) -> DataFrame:
    """Events without repeated ids, as far back as the watermark reaches."""
    return events.withWatermark("at", LATE).dropDuplicatesWithinWatermark(["event_id"])


def s05_sessions(events: DataFrame, gap_seconds: int = 3 * 3600) -> DataFrame:
    """Sessions of a project and their events: a gap ends one (24 hours in production).  Those that may go on are the carried rows."""
    done, going = carried(slim(events, "project_id", F.lit(1)), SLIM.format("project_id"), SLIM.format("project_id"), session_step(gap_seconds))
    return done.unionByName(going).select("project_id", F.col("flag").cast("long").alias("events"))


def s06_conversions(events: DataFrame, days: int = 7) -> DataFrame:
    """Registrations with the purchases of the same user within seven days after: an interval join of two streams."""
    left = events.where("event_type = 'signup'").select("event_id", "user_id", F.col("at").alias("registered_at")).withWatermark("registered_at", LATE)
    right = events.where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("at").alias("bought_at")).withWatermark("bought_at", LATE)
    within = F.expr(f"user_id = buyer AND bought_at >= registered_at AND bought_at <= registered_at + interval {days} days")
    return left.join(right, within, "inner").select("event_id", "user_id", "bought_at")


def s08_latest(events: DataFrame) -> DataFrame:
    """Latest event of each project, updated as events come."""
    return events.groupBy("project_id").agg(F.max(F.struct("at", "event_id", "event_type")).alias("m")).select("project_id", "m.event_id", "m.event_type")


def s09_trailing_actives(events: DataFrame) -> DataFrame:
    """Users of the last seven days, moved on day by day."""
    return events.withWatermark("at", LATE).groupBy(F.window("at", "7 days", "1 day").alias("w")).agg(F.approx_count_distinct("user_id", 0.01).alias("users"))


def slim(events: DataFrame, key: str, what: Column) -> DataFrame:
    return events.select(key, "at", "event_id", what.cast("int").alias("flag"))


SLIM = "{} string, at timestamp, event_id long, flag int"
BREAKER_OUT = "project_id string, event_id long, errors int"
CACHE_OUT = "user_id string, event_id long, result string"


def s11_breaker(events: DataFrame) -> DataFrame:
    """Three errors in a row of a project."""
    return carried(slim(events, "project_id", F.col("event_type") == "error"), SLIM.format("project_id"), BREAKER_OUT, breaker_step)[0]


def s10_cache(events: DataFrame) -> DataFrame:
    """Cache lookups with a time to live: purchases store, clicks look up."""
    kinds = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 2)
    return carried(slim(events.where(F.col("event_type").isin("purchase", "click")), "user_id", kinds), SLIM.format("user_id"), CACHE_OUT, cache_step)[0]


def s12_alerts(events: DataFrame) -> DataFrame:
    """Rolling alerts: four errors or more among a project's last ten events."""
    return carried(slim(events, "project_id", F.col("event_type") == "error"), SLIM.format("project_id"), BREAKER_OUT, alert_step)[0]


def s03_rollup(raw: DataFrame, late_seconds: int = 2 * 3600) -> DataFrame:
    """The daily rollup of a stream of events that may come late by any time: (day, event_type, events, k_sum, recomputed).

    What has come is kept by day.  A batch's rows of days that aren't behind the watermark - the latest time of the batches before, less two hours - are
    added up; a day of which a row is behind it is recomputed from all that has come of it and written as a whole.  All
    folders have the batch's number, so that a batch that is run again replaces what it wrote."""
    spark = raw.sparkSession
    path = fresh_path(spark)
    landed, sums, marks = f"{path}/landed", f"{path}/sums", f"{path}/marks"
    counts = [F.count("*").alias("events"), F.sum("k").cast("long").alias("k_sum")]
    e = raw.select("event_id", "at", "event_type", "k", F.to_date("at").alias("day"))
    spark.createDataFrame([], "event_type string, events long, k_sum long, whole boolean, day date").write.parquet(f"{sums}/batch_no=-1")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").partitionBy("day").parquet(f"{landed}/batch_no={number}")
        mine = session.read.schema(batch.schema).parquet(f"{landed}/batch_no={number}")
        known = session.read.schema("batch_no int, latest timestamp").parquet(marks).where(F.col("batch_no") < number).agg(F.max("latest")).head()[0] if number else None
        mine.agg(F.lit(number).alias("batch_no"), F.max("at").alias("latest")).write.mode("overwrite").parquet(f"{marks}/n={number}")
        closed = F.lit(False) if known is None else F.unix_micros(F.date_add("day", 1).cast("timestamp")) <= F.unix_micros(F.lit(known)) - late_seconds * 1_000_000
        late_days = materialise(mine.where(closed).select("day").distinct())
        fresh = mine.join(late_days, "day", "left_anti").groupBy("day", "event_type").agg(*counts).withColumn("whole", F.lit(False))
        wanted = [r["day"] for r in late_days.collect()] if late_days.count() <= 1000 else None  # so that only their folders are read
        come = session.read.option("basePath", landed).schema(f"{LANDED}, batch_no int, day date").parquet(landed).where(F.col("batch_no") <= number)
        come = come.where(F.col("day").isin(wanted)) if wanted else come
        whole = come.join(late_days, "day", "left_semi").groupBy("day", "event_type").agg(*counts).withColumn("whole", F.lit(True))
        columns = ["event_type", "events", "k_sum", "whole", "day"]
        fresh.select(*columns).unionByName(whole.select(*columns)).write.mode("overwrite").parquet(f"{sums}/batch_no={number}")

    e.writeStream.foreachBatch(write).option("checkpointLocation", fresh_path(spark)).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", sums).parquet(f"{sums}/batch_no=*")
    last = rows.where("whole").groupBy("day").agg(F.max("batch_no").alias("last"))
    held = rows.join(last, "day", "left").where(F.col("last").isNull() | (F.col("batch_no") > F.col("last")) | F.col("whole") & (F.col("batch_no") == F.col("last")))
    return held.groupBy("day", "event_type").agg(F.sum("events").alias("events"), F.sum("k_sum").alias("k_sum"), F.max(F.col("last").isNotNull()).alias("recomputed"))


LANDED = "event_id long, at timestamp, event_type string, k int"


def arrivals(spark: SparkSession, sf_dir: str, batches: int = 3, late: int = 50) -> DataFrame:
    """The events as they might come: by time, in so many batches, but every fiftieth only with the last one; written once, and read
    as a stream."""
    e = table(spark, sf_dir, "events")
    cuts = e.agg(F.percentile_approx("ts", [k / batches for k in range(1, batches)], 100)).head()[0] or []
    path, bounds = fresh_path(spark), [None, *cuts, None]
    slow = F.col("event_id") % late == 0
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        here = (F.col("ts") >= F.lit(low) if low is not None else F.lit(True)) & (F.col("ts") < F.lit(high) if high is not None else F.lit(True))
        part = e.where(here & ~slow if k + 1 < batches else here | slow)
        part.write.mode("append").parquet(f"{path}/part={k:03d}")  # one after the other: a stream reads files by their age
    return as_events(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*"))


def s03_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily rollup, whatever comes late."""
    return s03_rollup(arrivals(spark, sf_dir)).select(iso(F.col("day")).alias("day"), "event_type", "events", "k_sum")


def s09_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact users of the trailing 7 and 30 days of each day: the stream keeps one row of state for each user and day."""
    seen = collected(event_stream(spark, sf_dir).groupBy("user_id", F.to_date("at").alias("d")).agg(F.count("*").alias("n")), "update", ["user_id", "d"])
    days = seen.select("d").distinct()
    spread = seen.select("user_id", "d", F.explode(F.sequence("d", F.date_add("d", 29))).alias("day"))
    met = spread.join(F.broadcast(days.withColumnRenamed("d", "day")), "day")  # one row for each day
    last = met.groupBy("day", "user_id").agg(F.max("d").alias("d"))
    return last.groupBy(iso(F.col("day")).alias("day")).agg(F.count_if(F.date_diff("day", "d") < 7).alias("users_7"), F.count("*").alias("users_30"))


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", iso(F.to_date("w.start"))).drop("w")


QUERIES = {
    "s01_daily_stream": lambda spark, sf_dir: _day(collected(s01_daily(event_stream(spark, sf_dir)), "update", ["w", "event_type"])),
    "s02_weekly_stream": lambda spark, sf_dir: collected(s02_weekly(event_stream(spark, sf_dir)), "update", ["week"]),
    "s04_distinct_stream": lambda spark, sf_dir: collected(s04_distinct(event_stream(spark, sf_dir)), "append").groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("ids")),
    "s05_session_stream": lambda spark, sf_dir: s05_sessions(event_stream(spark, sf_dir)).groupBy("project_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("largest")),
    "s06_conversion_stream": lambda spark, sf_dir: collected(s06_conversions(event_stream(spark, sf_dir)), "append").groupBy("user_id").agg(F.countDistinct("event_id").alias("signups"), F.count("*").alias("purchases")),
    "s08_latest_stream": lambda spark, sf_dir: collected(s08_latest(event_stream(spark, sf_dir)), "update", ["project_id"]),
    "s09_actives_stream": lambda spark, sf_dir: _day(collected(s09_trailing_actives(event_stream(spark, sf_dir)), "update", ["w"])),
    "s03_recomputed_days": s03_recomputed,
    "s09_exact_actives": s09_exact,
    "s10_cache_stream": lambda spark, sf_dir: s10_cache(event_stream(spark, sf_dir)).groupBy("user_id", "result").agg(F.count("*").alias("lookups")),
    "s12_alert_stream": lambda spark, sf_dir: s12_alerts(event_stream(spark, sf_dir)),
    "s11_breaker_stream": lambda spark, sf_dir: s11_breaker(event_stream(spark, sf_dir)),
}

_WEEK = "strftime(CASE WHEN isodow(ts) = 1 THEN ts::DATE - 7 ELSE date_trunc('week', ts)::DATE END, '%Y-%m-%d')"
_E = "e AS (SELECT event_id, ts, user_id::VARCHAR AS user_id, event_type, json_extract_string(props, '$.k')::INT AS k, 'p' || ((user_id * 7 + json_extract_string(props, '$.k')::INT % 5) % 60) AS project_id FROM events)"
SQL = {
    "s01_daily_stream": f"WITH {_E} SELECT event_type, count(*) AS events, sum(k)::BIGINT AS k_sum, strftime(ts, '%Y-%m-%d') AS day FROM e GROUP BY ALL",
    "s03_recomputed_days": f"WITH {_E} SELECT event_type, count(*) AS events, sum(k)::BIGINT AS k_sum, strftime(ts, '%Y-%m-%d') AS day FROM e GROUP BY ALL",
    "s09_exact_actives": """WITH u AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), days AS (SELECT DISTINCT d AS day FROM u)
        SELECT strftime(day, '%Y-%m-%d') AS day, count(DISTINCT CASE WHEN d > day - 7 THEN user_id END) AS users_7, count(DISTINCT user_id) AS users_30
        FROM days JOIN u ON d <= day AND d > day - 30 GROUP BY 1""",
    "s02_weekly_stream": f"WITH {_E} SELECT {_WEEK} AS week, count(*) AS events, sum(k)::BIGINT AS k_sum FROM e GROUP BY 1",
    "s04_distinct_stream": "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
    "s05_session_stream": f"""WITH {_E}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY project_id ORDER BY ts)),
        s AS (SELECT project_id, sum(new) OVER (PARTITION BY project_id ORDER BY ts) AS n FROM g), c AS (SELECT project_id, n, count(*) AS events FROM s GROUP BY ALL) SELECT project_id, count(*) AS sessions, sum(events)::BIGINT AS events, max(events) AS largest FROM c GROUP BY 1""",
    "s06_conversion_stream": "SELECT a.user_id::VARCHAR AS user_id, count(DISTINCT a.event_id) AS signups, count(*) AS purchases FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 7 DAY GROUP BY 1",
    "s08_latest_stream": f"WITH {_E} SELECT project_id, event_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, event_id DESC) = 1",
    "s10_cache_stream": f"""WITH {_E}, l AS (SELECT user_id, event_type, ts, last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stored FROM e)
        SELECT user_id, CASE WHEN stored IS NULL THEN 'absent' WHEN ts - stored <= INTERVAL 24 HOUR THEN 'hit' ELSE 'expired' END AS result, count(*) AS lookups FROM l WHERE event_type = 'click' GROUP BY ALL""",
    "s12_alert_stream": f"""WITH {_E}, r AS (SELECT project_id, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY project_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)::INT AS errors FROM e)
        SELECT project_id, event_id, errors FROM r WHERE errors >= 4""",
    "s11_breaker_stream": f"""WITH {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts, event_id) AS r, sum((event_type <> 'error')::INT) OVER (PARTITION BY project_id ORDER BY ts, event_id) AS run FROM e),
        c AS (SELECT project_id, event_id, row_number() OVER (PARTITION BY project_id, run ORDER BY ts, event_id) AS n FROM o WHERE event_type = 'error') SELECT project_id, event_id, 3 AS errors FROM c WHERE n % 3 = 0""",
}
