"""Alignment of two tokenizers' tokens by the bytes that they cover.

1. Each task encodes its texts with both tokenizers and lays the tokens of a batch out by byte offset, documents end
   to end.  ``pandas.merge_asof``, keyed by document, finds for each token's start the token of the other side that
   covers it; both directions together are all overlaps, since of two tokens that overlap the later start lies in the other.
2. Overlapping tokens that end together cut a document into groups; the links of a group are all its pairs of tokens.
   Distinct pairs of ids and their number go to the shared folder with the document, as compact arrays.
3. An id pair's count - in how many documents it is linked - is summed within each task before it is shuffled.
4. The counts come back to the documents in parts of at most ``PART`` pairs, each broadcast; there are as many parts as
   the pairs need, and a document's sums over the parts are added.  No row for a token or a link is ever
   shuffled, so that a pair that all documents hold is no hot key.

Defined results: a null or empty text has no tokens, nor has one whose bytes a tokenizer doesn't give back: zeros and an
empty digest.  Rows with equal or null doc_id are documents of their own; other columns are not read; an empty table
gives an empty result.  A text is encoded whole, in one task; a group of many tokens is counted by distinct ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.pack import TokenIds

CHUNK = 1 << 20  # bytes of text that are laid out together; a longer text is by itself
PART = 1 << 22  # id pairs whose counts a task holds at once
SHIFT = 1 << 15  # a pair is its A id times this plus its B id: both vocabularies are below 2^16 and 2^15
LARGE = 1 << 10  # links of a group above which they are counted by distinct ids


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.ids_a = TokenIds(a_path, plain=True)
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.bytes_a = self.ids_a.tokens()
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.bytes_b) > SHIFT or len(self.bytes_a) > 2 * SHIFT:
            raise ValueError("vocabularies are too large for a pair of ids in 31 bits")
        self.len_a, self.len_b = (np.array([len(t) for t in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        ends = [(self.bytes_a, b",", b"|"), (self.bytes_b, b",", b";")]
        words = [b"%d%s" % (i, end) for table, *both in ends for end in both for i in range(len(table))]
        self.decimal = np.array(words, dtype="S6").view(np.uint8).reshape(-1, 6)  # each padded with zero bytes
        self.digits = np.array([len(w) for w in words])

    def encode(self, texts: list[str | None]) -> list[tuple]:
        """Ids of both sides; none where the bytes of either aren't those of the text behind a space."""
        firsts = {t: k for k, t in reversed(list(enumerate(texts))) if t}
        mine = dict(zip(firsts, self.model.encode(list(firsts), num_threads=1))) if firsts else {}
        out: dict = {None: ([], []), "": ([], [])}
        for text, b in mine.items():
            whole = " " + text
            a, data = self.ids_a(whole), whole.encode()
            # byte-level ids are of pieces of the text in order: what they leave out shows in their length
            same = self.len_a[a].sum() == len(data) and b"".join(map(self.bytes_b.__getitem__, b)) == data
            out[text] = (a, b) if same else ([], [])
        return [out[t] for t in texts]


@dataclass
class Layout:
    """Tokens of several documents, end to end; group numbers run through all documents."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    doc_a: np.ndarray  # the document of each token
    doc_b: np.ndarray
    end_a: np.ndarray  # byte offset behind each token
    group_a: np.ndarray
    group_b: np.ndarray
    size_a: np.ndarray  # tokens of each group
    size_b: np.ndarray
    doc_of: np.ndarray  # the document of each group


def lay_out(pair: Pair, encoded: list[tuple]) -> Layout:
    ids_a, ids_b = (np.concatenate([np.asarray(e[side], dtype=np.int64) for e in encoded] or [np.empty(0, np.int64)]) for side in (0, 1))
    doc_a, doc_b = (np.repeat(np.arange(len(encoded)), [len(e[side]) for e in encoded]) for side in (0, 1))
    end_a, end_b = np.cumsum(pair.len_a[ids_a]), np.cumsum(pair.len_b[ids_b])
    a = pd.DataFrame({"doc": doc_a, "start": end_a - pair.len_a[ids_a], "a": np.arange(len(ids_a))})
    b = pd.DataFrame({"doc": doc_b, "start": end_b - pair.len_b[ids_b], "b": np.arange(len(ids_b))})
    over_b = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy()  # the token of B that covers the start of each of A
    over_a = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy()
    cut_a, cut_b = np.zeros(len(ids_a), dtype=bool), np.zeros(len(ids_b), dtype=bool)
    for i, j in ((a["a"].to_numpy(), over_b), (over_a, b["b"].to_numpy())):
        equal = end_a[i] == end_b[j]
        cut_a[i[equal]], cut_b[j[equal]] = True, True
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    n = int(cut_a.sum())
    return Layout(ids_a, ids_b, doc_a, doc_b, end_a, group_a, group_b, np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n), doc_a[cut_a])


def links(at: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(document << 31 | pair, number of links), sorted, each once."""
    first_b = np.cumsum(at.size_b) - at.size_b
    large = at.size_a * at.size_b > LARGE
    times = np.where(large, 0, at.size_b)[at.group_a]
    begin = np.repeat(np.cumsum(times) - times, times)
    j = np.repeat(first_b[at.group_a], times) + np.arange(len(begin)) - begin
    key = np.repeat(at.doc_a << 31 | at.ids_a * SHIFT, times) + at.ids_b[j]
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    keys, counts = [key[new]], [np.diff(np.append(new, len(key)))]
    if large.any():
        first_a = np.cumsum(at.size_a) - at.size_a
        for g in np.flatnonzero(large):
            a, n_a = np.unique(at.ids_a[first_a[g] : first_a[g] + at.size_a[g]], return_counts=True)
            b, n_b = np.unique(at.ids_b[first_b[g] : first_b[g] + at.size_b[g]], return_counts=True)
            keys.append((at.doc_of[g] << 31 | a[:, None] * SHIFT + b).ravel())
            counts.append((n_a[:, None] * n_b).ravel())
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(where, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
    return keys[0], counts[0]


def digests(pair: Pair, at: Layout, docs: int) -> list[str]:
    """Of each document the sha256 of its groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    last_a, last_b = np.cumsum(at.size_a), np.cumsum(at.size_b)
    code = np.empty(len(at.ids_a) + len(at.ids_b), dtype=np.int64)
    a, b = np.arange(len(at.ids_a)), np.arange(len(at.ids_b))
    n_a, n_b = len(pair.bytes_a), len(pair.bytes_b)
    code[a + (last_b - at.size_b)[at.group_a]] = at.ids_a + n_a * (a + 1 == last_a[at.group_a])
    code[b + last_a[at.group_b]] = at.ids_b + 2 * n_a + n_b * (b + 1 == last_b[at.group_b])
    ends = np.cumsum(np.bincount(at.doc_a, minlength=docs) + np.bincount(at.doc_b, minlength=docs))
    written = np.concatenate([[0], np.cumsum(pair.digits[code])])[ends].tolist()
    words = pair.decimal[code].ravel()
    whole, start, out = memoryview(words[words != 0].tobytes()), 0, []
    for end in written:
        out.append(hashlib.sha256(whole[start : end - 1]).hexdigest() if end > start else "")
        start = end
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of about ``CHUNK`` bytes."""
    for batch in batches:
        ids, texts, held, start = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, 0
        for k, text in enumerate(texts):
            held += len(text or "") + 64
            if held >= CHUNK or k + 1 == len(texts):
                yield ids[start : k + 1], texts[start : k + 1]
                held, start = 0, k + 1


def _align(a_path: str, b_path: str):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = Pair(a_path, b_path), TaskContext.get().partitionId() << 40
        for ids, texts in _chunks(batches):
            encoded, n = pair.encode(texts), len(texts)
            at = lay_out(pair, encoded)
            key, count = links(at)
            cuts = np.searchsorted(key, np.arange(1, n) << 31)
            packed = [p.astype("<i4").tobytes() + c.astype("<i8").tobytes() for p, c in zip(np.split(key & (1 << 31) - 1, cuts), np.split(count, cuts))]
            n_links = np.bincount(at.doc_of, weights=at.size_a * at.size_b, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "row": np.arange(row, row + n), "doc_id": pa.array(ids, type=pa.int64()),
                "n_a": np.bincount(at.doc_a, minlength=n), "n_b": np.bincount(at.doc_b, minlength=n), "n_groups": np.bincount(at.doc_of, minlength=n),
                "n_links": n_links, "groups_sha256": digests(pair, at, n), "links": pa.array(packed, type=pa.binary()),
            })
            row += n

    return body


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, pair, number of links) of a batch's links."""
    values = column.to_pylist()
    sizes = [len(v) // 12 for v in values]
    pairs = np.concatenate([np.frombuffer(v, "<i4", n) for v, n in zip(values, sizes)] or [np.empty(0, "<i4")])
    counts = np.concatenate([np.frombuffer(v, "<i8", n, 4 * n) for v, n in zip(values, sizes)] or [np.empty(0, "<i8")])
    return np.repeat(np.arange(len(values)), sizes), pairs, counts


def _in_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, documents of this task that hold it); what is held is bounded by ``PART`` pairs and one batch."""

    def merged(parts):
        pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return pairs, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(pairs)).astype(np.int64)

    def out(pairs, docs):
        for k in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_pydict({"pair": pairs[k : k + (1 << 16)], "docs": docs[k : k + (1 << 16)]})

    held, n = [], 0
    for batch in batches:
        _, pairs, _ = _unpacked(batch.column(0))
        held.append(np.unique(pairs, return_counts=True))
        n += len(held[-1][0])
        if n > PART // 2:
            held = [merged(held)]
            n = len(held[0][0])
            if n > PART // 2:
                yield from out(*held.pop())
                n = 0
    if held:
        yield from out(*merged(held))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): in how many documents each id pair is linked, and whether no pair of its A id has more."""
    counts = aligned.select("links").mapInArrow(_in_documents, "pair int, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    of_a = Window.partitionBy(F.shiftright("pair", 15))  # at most as many rows as B has ids
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(of_a))


def _scored(table, first: bool):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = table.value
        for batch in batches:
            row, pairs, counts = _unpacked(batch.column("links"))
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
            row, at, counts = row[found], at[found], counts[found]
            sums = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2)]
            np.add.at(sums[0], row, counts * best[at])
            np.add.at(sums[1], row, counts * docs[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums[0]), pa.array(sums[1])], names=[*batch.schema.names[:-1], "n_best", "count_sum"])

    return body


def align(docs: DataFrame, a_path: str, b_path: str, part: int = PART) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    aligned = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_align(a_path, b_path), _ALIGNED))
    counts = materialise(pair_counts(aligned))
    parts = -(-counts.count() // part) or 1
    results = []
    for p in range(parts):
        held = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == p).orderBy("pair").toArrow()
        table = spark.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("pair", "docs", "best")))
        results.append(aligned.mapInArrow(_scored(table, p == 0), _ALIGNED.replace("links binary", "n_best long, count_sum long")))
    out = results[0]
    if parts > 1:
        light = [c for c in out.columns if c not in ("row", "n_best", "count_sum")]
        for other in results[1:]:
            out = out.unionByName(other)
        out = out.groupBy("row").agg(*(F.first(c).alias(c) for c in light), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _groups(a_path: str, b_path: str):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(a_path, b_path)
        for ids, texts in _chunks(batches):
            at = lay_out(pair, pair.encode(texts))
            last_a, last_b = np.cumsum(at.size_a), np.cumsum(at.size_b)
            ends = at.end_a[last_a - 1] if len(last_a) else last_a
            first = np.flatnonzero(np.concatenate([[True], at.doc_of[1:] != at.doc_of[:-1]])) if len(last_a) else last_a
            begin = np.repeat(np.concatenate([[0], ends[first[1:] - 1]]), np.diff(np.append(first, len(ends)))) if len(last_a) else last_a
            number = np.arange(len(ends)) - np.repeat(first, np.diff(np.append(first, len(ends))))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], last]).astype(np.int32), pa.array(v)) for last, v in ((last_a, at.ids_a), (last_b, at.ids_b))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in at.doc_of.tolist()], type=pa.int64()), pa.array(number), pa.array(starts - begin), pa.array(ends - begin), *lists],
                names=["doc_id", "group", "start", "end", "a_ids", "b_ids"],
            )

    return body


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each group: doc_id, group (from 0), start and end (bytes of the text behind a space), a_ids, b_ids."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_groups(a_path, b_path), "doc_id long, group long, start long, end long, a_ids array<long>, b_ids array<long>")
