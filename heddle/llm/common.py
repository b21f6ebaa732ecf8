"""What the operators of this package share: reading, materialising, grouping Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.sources import store
from heddle.sources.store import forget, written  # noqa: F401 - for the modules of this package


def give_back() -> None:
    """Returns to the system what the driver has freed but keeps, its Python's allocators and its JVM's heap: a session runs on after a fit."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()  # shrinks the heap, and lets Spark drop broadcasts and shuffles of plans that are gone
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps less
        pass


def materialise(df: DataFrame) -> DataFrame:
    """As ``store.materialise``; what the driver needed for it is given back."""
    out = store.materialise(df)
    give_back()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a text above which it is not taken into a sample for fitting (it is scored like any other).
SAMPLE_TEXT = 64 << 10


def held_out(remainder: int, modulus: int, id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample_texts(docs: DataFrame, chosen: DataFrame, most_bytes: int):
    """(doc_id, label, text) on the driver, in the order of doc_id's hash: texts of the ``chosen`` (doc_id, label), which must
    be of bounded number.  No text over ``SAMPLE_TEXT`` bytes, of a repeated doc_id the smallest, and of each label
    only as many as have ``most_bytes`` together."""
    texts = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_TEXT).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    held = F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = one.withColumn("_held", held).where(F.col("_held") <= most_bytes).select("doc_id", "label", "text", F.xxhash64("doc_id").alias("_h"))
    return rows.toPandas().sort_values(["_h", "doc_id"])


def tasks_for(df: DataFrame) -> int:
    """Shuffle partitions to ask for where a keyed repartition feeds Python."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys; batches must come sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        values = list(zip(*columns))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                part = batch.slice(start, i - start)
                if held and values[start] != held_key:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(part)
                held_key = values[start]
                start = i
    if held:
        yield pa.Table.from_batches(held)


def bitmap(df: DataFrame, column: str, bits: int = 24) -> bytes:
    """A bitmap of 2^bits positions with the low ``bits`` bits of a long column set.

    Its size (2 MB at 24 bits) does not depend on the data; built by a partial and a
    final aggregate, so at most 2^(bits-6) longs reach the driver.  A filter on it
    lets some others through and never drops a value that is there."""
    mask = (1 << bits) - 1
    slot = F.col(column).bitwiseAND(F.lit(mask))
    rows = (
        df.where(F.col(column).isNotNull())
        .select(F.shiftright(slot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    import numpy as np

    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    got = rows.toPandas()
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    del got
    give_back()
    return out.tobytes()


def in_bitmap(bits_of: bytes, values) -> "object":
    """Which of a uint64 or int64 numpy array may be in the bitmap."""
    import numpy as np

    words = np.frombuffer(bits_of, dtype=np.uint64)
    v = values.view(np.uint64) & np.uint64(len(words) * 64 - 1)
    return (words[(v >> np.uint64(6)).astype(np.int64)] >> (v & np.uint64(63))) & np.uint64(1) == 1


def marked(column: str, bits: int = 24) -> tuple:
    """(slot, bit) of a column's hash in a bitmap held as a table."""
    return F.shiftright(F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int"), F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int))")


def marks(df: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """The bitmap (_slot, _word) of a column's values: at most 2^(bits-6) rows whatever the input, so that it may be broadcast."""
    slot, bit = marked(column, bits)
    return df.select(slot.alias("_slot"), bit.alias("_b")).groupBy("_slot").agg(F.bit_or("_b").alias("_word"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, or where a column has one of them (in any case) longer ones that none has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(docs: DataFrame) -> list:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def told_apart(docs: DataFrame, ids: DataFrame, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """(rows whose doc_id is surely not in ``ids``, the others): a bitmap of the ids' hashes decides.

    The bitmap is a broadcast table of at most 2^(bits-6) longs whatever the input, so that the first part
    needs no shuffle; only the second, which holds all of ``ids`` and a few more, has to be joined."""
    at, place, word = fresh(docs, "_at", "_slot", "_word")
    slot, bit = marked("doc_id", bits)
    held = marks(ids, "doc_id", bits).select(F.col("_slot").alias(place), F.col("_word").alias(word))
    flagged = docs.withColumn(at, slot).join(F.broadcast(held), F.col(at) == F.col(place), "left")
    some = F.coalesce(F.col(word).bitwiseAND(bit) != 0, F.lit(False))
    return flagged.where(~some).select(*own_columns(docs)), flagged.where(some).select(*own_columns(docs))


def without_rows(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows in ``gone`` (doc_id, text_sha256; materialised, each once); of equal rows in ``once``
    (the same columns) one stays.  A null doc_id is a value like others."""
    sha, one, key = fresh(docs, "_sha", "_id", "_key")
    rest, maybe = told_apart(docs, gone.select("doc_id") if once is None else gone.select("doc_id").unionByName(once.select("doc_id")))
    keyed = maybe.withColumn(sha, F.sha2(F.col("text").cast("binary"), 256))

    def among(rows: DataFrame, how: str) -> DataFrame:
        rows = rows.select(F.col("doc_id").alias(one), F.col("text_sha256").alias(key))
        return keyed.join(rows, keyed["doc_id"].eqNullSafe(rows[one]) & (keyed[sha] == rows[key]), how)

    if once is None:
        return rest.unionByName(among(gone, "left_anti").drop(sha))
    left = rest.unionByName(among(gone.unionByName(once), "left_anti").drop(sha))
    return left.unionByName(among(once, "left_semi").dropDuplicates(["doc_id", sha]).drop(sha))
