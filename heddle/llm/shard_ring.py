"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells; the high bits of a document's hash choose its cell, and the hashes of
(shard, k) choose the cells of each shard's virtual nodes.  A document belongs to the first virtual
node at or after its cell.  Once a shard is full, what it can't hold goes on clockwise,
node by node.  With ``slack`` 0 the capacities add up to the number of rows, so that
counts are at most one apart (the law ``rows``).

Rows that are equal in doc_id, size and checksum are told apart by nothing, so they are first combined into one row with
their number (with map-side combine) and made rows again at the end, in parts of at most ``PART``.
Only numbers of rows by (cell, salt) reach the driver, at most ``CELLS`` x ``SALTS`` of them whatever
the input.  There the overflow is followed node by node, for ranges of rows and not for rows; each
part then finds its ranges by its rank in its arc.  Ranks are counted within (cell, salt), and the salt is a hash of the
row and its part, so that neither one doc_id nor one text, however common, is one task's work, and the same table gives the
same placement however its files are cut.  All of it is DataFrame
operations; the text is read once, for its size and checksum, and never shuffled.

Defined results: null text has the size 8 and the checksum 0; a row with a null doc_id is placed by
size and checksum; repeated rows are rows like any others; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialise

CELLS = 4096
SALTS = 16
VIRTUAL = 64
PART = 1 << 16  # equal rows that are ranked as one


def ring(spark, shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; hashed by Spark like the rows."""
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("k"))
    hashed = nodes.select("shard", F.xxhash64(F.lit("node"), "shard", "k").alias("h"))
    rows = hashed.select(F.pmod("h", F.lit(CELLS)).cast("int").alias("cell"), "shard", "h").collect()
    return [(r["cell"], r["shard"]) for r in sorted(rows, key=lambda r: (r["cell"], r["h"]))]


def overflow_plan(loads: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rows, shard, first slot): what each arc's rows come to, by rank.

    In round t every arc offers what it has left to the t-th node after its own, in ring order."""
    left, taken, filled = list(loads), [0] * len(loads), [0] * len(capacity)
    rows, waiting = [], [a for a, n in enumerate(loads) if n]
    for step in range(len(owners)):
        still = []
        for arc in waiting:
            shard = owners[(arc + step) % len(owners)]
            n = min(left[arc], capacity[shard] - filled[shard])
            if n > 0:
                rows.append((arc, taken[arc], n, shard, filled[shard]))
                taken[arc] += n
                left[arc] -= n
                filled[shard] += n
            if left[arc]:
                still.append(arc)
        waiting = still
        if not waiting:
            break
    return rows


def ring_shards(docs: DataFrame, shards: int = 24, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.xxhash64(F.lit("key"), "doc_id"), F.lit(0))
    placed = F.when(F.col("doc_id").isNull(), F.xxhash64("size", "text_crc32")).otherwise(key)
    equal = light.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("all"))
    parted = equal.select("*", placed.alias("h"), F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / PART))).alias("part"))
    rows = materialise(
        parted.select(
            "doc_id", "size", "text_crc32", "h", "part", F.least(F.lit(PART), F.col("all") - F.col("part") * PART).alias("m"),
            F.pmod(F.shiftrightunsigned("h", 20), F.lit(CELLS)).cast("int").alias("cell"),
            F.pmod(F.xxhash64(F.lit("salt"), "doc_id", "size", "text_crc32", "part"), F.lit(SALTS)).cast("int").alias("salt"),
        )
    )
    counted = {(r["cell"], r["salt"]): r["n"] for r in rows.groupBy("cell", "salt").agg(F.sum("m").alias("n")).collect()}
    nodes = ring(spark, shards, virtual)
    arcs, loads, before = [], [0] * len(nodes), []
    at = 0
    for cell in range(CELLS):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        arcs.append(at % len(nodes))
    # A ring wraps: cells after the last node belong to the first, ranked after its own.
    for cell in range(CELLS):
        for salt in range(SALTS):
            n = counted.get((cell, salt), 0)
            if n:
                before.append((cell, salt, arcs[cell], loads[arcs[cell]]))
                loads[arcs[cell]] += n
    total = sum(loads)
    even = [total // shards + (s < total % shards) for s in range(shards)]
    capacity = even if not slack else [int((1 + slack) * total / shards) + 1] * shards
    plan = overflow_plan(loads, [s for _, s in nodes], capacity)
    # Both tables have bounded sizes: CELLS x SALTS rows, and a few ranges for each virtual node.
    starts = F.broadcast(spark.createDataFrame(before, "cell int, salt int, arc int, before long"))
    ranges = F.broadcast(spark.createDataFrame(plan, "arc int, from_rank long, n long, shard int, first_slot long"))
    order = Window.partitionBy("cell", "salt").orderBy("h", "doc_id", "text_crc32", "size", "part")
    ranked = rows.withColumn("rank", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).join(starts, ["cell", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    met = ranked.join(ranges, (ranked["arc"] == ranges["arc"]) & (F.col("rank") < F.col("from_rank") + F.col("n")) & (F.col("rank") + F.col("m") > F.col("from_rank")))
    low, high = F.greatest("rank", "from_rank"), F.least(F.col("rank") + F.col("m"), F.col("from_rank") + F.col("n"))
    found = met.select("doc_id", "size", "text_crc32", "shard", "first_slot", "from_rank", F.explode(F.sequence(low, high - 1)).alias("rank"))
    law = F.lit("rows" if not slack else None).cast("string").alias("law")
    slot = (F.col("first_slot") + F.col("rank") - F.col("from_rank")).cast("long").alias("slot")
    return found.select("doc_id", "size", "text_crc32", law, "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
