"""Benchmark decontamination by winnowing.

A window is ten consecutive words of a benchmark item; an item of one to nine words is
one window.  Of any ten words, winnowing keeps the place of the smallest of the six hashes of five
consecutive words (the last of equal ones), so every span of ten words that a document shares with an item has
a kept fingerprint in common with it.

1. Items give windows and fingerprints.  Two bitmaps of bounded size hold the
   fingerprints' and the windows' hashes.
2. A pass over the documents keeps each text's fingerprints - about two of seven places - and joins them with the
   items' through the bitmap.  A hit is extended: the windows around its place, and no others, whose hash is known go on,
   as text.
3. Those windows are joined with the items' windows on the text itself, so that no
   hash decides.  The items' side is broadcast only if its measured size is within
   ``broadcast_bytes``; else Spark shuffles both sides, a window's rows in ``SALTS`` parts.
4. Windows that the same items hold share one set of items; rows carry the set's key, and each document's sets
   become one list of items at the end.

Items of one to nine words have no fingerprint of their own; each of their lengths is
probed at every position by the hash of that many words.

Defined results: null and empty texts have no words and no hits; rows with a null item_id mark
words as hit but are not counted among the items; repeated documents each get their row;
repeated items count once; an empty benchmark hits nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import bitmap, in_bitmap, materialise, without_rows
from heddle.llm.wordgrams import Words, chunks, gram_hashes, words_of

WINDOW = 10
GRAM = 5
SALTS = 16

_ITEM = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("body", pa.string()), ("hash", pa.int64()), ("print", pa.int64())])


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each kept fingerprint, its hash): in every run of ``WINDOW`` words of a text the smallest hash of
    ``GRAM`` words, the last of equal ones."""
    grams, _ = gram_hashes(words, GRAM)
    _, whole = gram_hashes(words, WINDOW)
    least, place = grams.copy(), np.arange(len(grams))
    for j in range(1, WINDOW - GRAM + 1):
        if len(grams) > j:
            later = grams[j:] <= least[:-j]
            least[:-j][later] = grams[j:][later]
            place[:-j][later] = np.arange(j, len(grams))[later]
    kept = np.unique(place[whole])
    return kept, grams[kept]


def around(words: Words, places: np.ndarray) -> np.ndarray:
    """First words of the windows that hold the fingerprints at ``places``."""
    _, whole = gram_hashes(words, WINDOW)
    starts = np.unique(places[:, None] - np.arange(WINDOW - GRAM + 1)[None, :])
    starts = starts[starts >= 0]
    return starts[whole[starts]]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, j in chunks(batch.column(1)):
            w = words_of(batch.column(1).slice(i, j - i))
            own, _ = gram_hashes(w, WINDOW)
            _, hashes = winnow(w)
            short = {n: gram_hashes(w, n)[0] for n in range(1, WINDOW) if (w.count() == n).any()}
            rows = []
            for row in range(j - i):
                a, b = int(w.first[row]), int(w.first[row + 1])
                if 0 < b - a < WINDOW:
                    rows.append((ids[i + row], b - a, w.text(a, b), int(short[b - a][a].view(np.int64)), None))
                for at in range(a, b - WINDOW + 1):
                    rows.append((ids[i + row], WINDOW, w.text(at, at + WINDOW), int(own[at].view(np.int64)), None))
            rows += [(None, None, None, None, h) for h in hashes.view(np.int64).tolist()]  # fingerprints stand in rows of their own
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ITEM)], schema=_ITEM)


_CANDIDATE = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("body", pa.string())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("n_words", pa.int64()), ("windows", pa.list_(_CANDIDATE)), ("text_sha256", pa.string())])


def _document_windows(prints_of: bytes, windows_of: bytes, lengths: list[int], keyed: bool):
    schema = _FOUND if keyed else _FOUND.remove(4)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                w = words_of(batch.column(1).slice(i, j - i))
                n = w.count()
                kept, hashes = winnow(w)
                at = around(w, kept[in_bitmap(prints_of, hashes)])
                own, _ = gram_hashes(w, WINDOW)
                at = at[in_bitmap(windows_of, own[at])]
                spans = [at, np.full(len(at), WINDOW)]
                for length in lengths:
                    grams, whole = gram_hashes(w, length)
                    at = np.flatnonzero(whole)
                    at = at[in_bitmap(windows_of, grams[at])]
                    spans[0] = np.concatenate([spans[0], at])
                    spans[1] = np.concatenate([spans[1], np.full(len(at), length)])
                rows: list[list] = [[] for _ in range(j - i)]
                owner = np.searchsorted(w.first, spans[0], side="right") - 1
                for a, length, row in zip(spans[0].tolist(), spans[1].tolist(), owner.tolist()):
                    rows[row].append({"at": a - int(w.first[row]), "n": length, "body": w.text(a, a + length)})
                columns = [batch.column(0).slice(i, j - i), pa.array(np.arange(uid, uid + j - i)), pa.array(n.astype(np.int64)), pa.array(rows, type=_FOUND.field("windows").type)]
                if keyed:
                    columns.append(pa.array([hashlib.sha256(batch.column(1)[i + k].as_buffer()).hexdigest() if found else None for k, found in enumerate(rows)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                uid += j - i

    return body


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = 32 << 20, keyed: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with ``keyed``
    text_sha256, which is null where no window may be an item's."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    known = materialise(items.mapInArrow(_item_windows, "item_id long, n int, body string, hash long, print long"))
    size = known.agg(F.count("*").alias("n"), F.sum(F.length("body") + 100).alias("bytes"), F.collect_set(F.when(F.col("n") < WINDOW, F.col("n"))).alias("short")).first()
    bits = min(max(20, (16 * (size["n"] or 1)).bit_length()), 27)
    probe = _document_windows(bitmap(known, "print", bits), bitmap(known, "hash", bits), sorted(size["short"]), keyed)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        probe, "doc_id long, uid long, n_words long, windows array<struct<at: int, n: int, body: string>>" + (", text_sha256 string" if keyed else "")
    )
    listed = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    by_body = known.where("body is not null").groupBy("body").agg(listed.alias("ids"))
    by_body = materialise(by_body.select("body", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("set_key"), "ids"))
    sets = by_body.groupBy("set_key").agg(F.first("ids").alias("ids"))
    bodies = by_body.select("body", "set_key")
    small = (size["bytes"] or 0) <= broadcast_bytes
    bodies = F.broadcast(bodies) if small else bodies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = ["text_sha256"] if keyed else []
    each = found.select("doc_id", "uid", "n_words", *key, F.explode_outer("windows").alias("w")).select(
        "doc_id", "uid", "n_words", *key, "w.at", "w.n", F.coalesce("w.body", F.concat(F.lit(" "), F.col("uid"))).alias("body")
    )  # a body that no window has, another for each document, where there is none: no key is hot
    joined = each.join(bodies, "body", "left") if small else each.withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int")).join(bodies, ["body", "salt"], "left")
    hit = F.when(F.col("set_key").isNotNull(), F.struct("at", (F.col("at") + F.col("n")).alias("to")))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("to")),
        lambda x, s: F.struct(
            (x["sum"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["at"], x["to"]))).alias("sum"),
            F.greatest(s["to"], x["to"]).alias("to"),
        ),
        lambda x: x["sum"],
    )
    grouped = joined.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *[F.first(c).alias(c) for c in key], F.collect_set(hit).alias("spans"), F.collect_set("set_key").alias("sets"))
    counted = materialise(grouped.select("uid", "doc_id", "n_words", covered.alias("n_hit"), "sets", *key))
    held = counted.where(F.size("sets") > 0).select("uid", F.explode("sets").alias("set_key"))
    # ids of sets are fewer than the windows' rows, whose bytes are measured; beyond that a set that many documents hold is dealt in parts
    parts = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = held.join(F.broadcast(sets), "set_key") if small else held.withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int")).join(parts, ["set_key", "salt"])
    of_sets = held.groupBy("uid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    items = F.coalesce("ids", F.array().cast("array<string>"))
    return counted.join(of_sets, "uid", "left").select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.size("sets") > 0).alias("contaminated"), *key
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that share a window with the benchmark, all columns; a row is told by doc_id and text,
    so that others with its doc_id, or with none, stay."""
    return without_rows(docs, materialise(decontaminate(docs, benchmark, keyed=True).where("contaminated").select("doc_id", "text_sha256").distinct()))
