"""Micro-batches whose result needs a few rows of those before them: these rows are a table of their own, written once a batch.

A batch is sorted and windowed by Spark, which spills: a key that all rows have is neither concatenated nor held.  Output and
carried rows go to folders of the batch's number, so that a batch that is run again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.sources.store import fresh_path, materialise


def carried(stream: DataFrame, keep: str, out: str, step: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(output, carried rows) of a stream once all that is there is read.

    ``step`` gets a batch's rows and the carried ones, both with ``old`` (was it carried?), and returns rows with ``told`` (goes out) and
    ``kept`` (is carried on) and the columns of ``keep`` and ``out``, two DDL schemas; what is carried has the stream's columns."""
    spark = stream.sparkSession
    path, state = fresh_path(spark), fresh_path(spark)
    empty = spark.createDataFrame([], keep)
    told = spark.createDataFrame([], out)
    told.write.parquet(f"{path}/batch_no=-1")
    empty.write.parquet(f"{state}/batch_no=-1")
    last = [-1]

    def write(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(empty.schema).parquet(f"{state}/batch_no={number - 1}")
        rows = materialise(step(batch.select(*empty.columns).withColumn("old", F.lit(False)).unionByName(before.withColumn("old", F.lit(True)))))
        rows.where("told").select(*told.columns).write.mode("overwrite").parquet(f"{path}/batch_no={number}")
        rows.where("kept").select(*empty.columns).write.mode("overwrite").parquet(f"{state}/batch_no={number}")
        last[0] = number

    stream.writeStream.foreachBatch(write).option("checkpointLocation", fresh_path(spark)).trigger(availableNow=True).start().awaitTermination()
    read = spark.read
    return read.schema(told.schema).parquet(f"{path}/batch_no=*").select(*told.columns), read.schema(empty.schema).parquet(f"{state}/batch_no={last[0]}").select(*empty.columns)


def ordered(key: str, *more: str) -> Window:
    return Window.partitionBy(key, *more).orderBy("at", "event_id")


def breaker_step(rows: DataFrame) -> DataFrame:
    """Errors in a row of a project; every third of a run is told.  The last run's errors after its last third are carried."""
    error = F.col("flag") == 1
    run = F.sum((~error).cast("int")).over(ordered("project_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run).withColumn("n", F.sum(error.cast("int")).over(ordered("project_id", "run").rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("n").over(Window.partitionBy("project_id", "run"))
    final = F.col("run") == F.max("run").over(Window.partitionBy("project_id"))
    rows = rows.withColumns({"total": total, "final": final})
    kept = error & F.col("final") & (F.col("n") > F.col("total") - F.col("total") % 3)
    return rows.withColumns({"told": error & ~F.col("old") & (F.col("n") % 3 == 0), "kept": kept, "errors": F.lit(3)})


def alert_step(rows: DataFrame) -> DataFrame:
    """Four errors or more among a project's last ten events are told; its last nine events are carried."""
    w = ordered("project_id")
    back = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("at"), F.desc("event_id")))
    rows = rows.withColumns({"errors": F.sum("flag").over(w.rowsBetween(-9, 0)).cast("int"), "back": back})
    return rows.withColumns({"told": ~F.col("old") & (F.col("errors") >= 4), "kept": F.col("back") <= 9})


def cache_step(rows: DataFrame) -> DataFrame:
    """Lookups (flag 2) of a user's entry, which lives for 24 hours after it was last stored (flag 1); the last time it was stored is carried."""
    w = ordered("user_id")
    stored = F.last(F.when(F.col("flag") == 1, F.col("at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("stored", stored)
    fresh = F.unix_micros("at") - F.unix_micros("stored") <= 24 * 3600 * 1_000_000
    result = F.when(F.col("stored").isNull(), "absent").when(fresh, "hit").otherwise("expired")
    newest = F.row_number().over(Window.partitionBy("user_id", "flag").orderBy(F.desc("at"), F.desc("event_id"))) == 1
    return rows.withColumns({"result": result, "told": ~F.col("old") & (F.col("flag") == 2), "kept": (F.col("flag") == 1) & newest})


def session_step(gap_seconds: int) -> Callable[[DataFrame], DataFrame]:
    """Sessions of a project, as rows (at: their last event, flag: their events); the last one of each project may go on and is carried."""

    def step(rows: DataFrame) -> DataFrame:
        w = ordered("project_id")
        begins = F.coalesce(F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) >= gap_seconds * 1_000_000, F.lit(True))
        rows = rows.withColumn("begins", begins.cast("int")).withColumn("session", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        each = rows.groupBy("project_id", "session").agg(F.max("at").alias("at"), F.max("event_id").alias("event_id"), F.sum("flag").cast("int").alias("flag"))
        newest = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("session"))) == 1
        return each.withColumn("kept", newest).withColumn("told", ~F.col("kept"))

    return step
