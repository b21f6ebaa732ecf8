"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a temporary one if the
    master is local (tests); on a cluster, where no such folder would be shared, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='heddle-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes with ``forget`` or at the driver's end."""
    path = f"{shared_folder(spark)}/heddle-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors.

    What is written stays until ``forget`` or the driver's end, since results are read when the caller asks for them."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``forget``."""
    return len(_written)


def forget(mark: int = 0, but: int = 0) -> None:
    """Deletes what ``materialise`` wrote since ``mark``, except for the last ``but`` of them."""
    end = len(_written) - but
    for spark, path in _written[mark:end]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _written[mark:end]


@atexit.register
def _forget_at_the_end() -> None:
    try:
        forget()
    except Exception:  # noqa: BLE001 - the session has ended already: its folder is the cluster's to clean
        _written.clear()
