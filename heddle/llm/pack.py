"""Best-fit packing of documents into token sequences by the linear grouping scheme.

A document is its token ids and one closing id 0.  A document longer than a sequence is cut
into full pieces after a first, shorter one; nothing else is cut.

1. Each task tokenizes its documents and returns a small row for each piece.
2. Only a histogram of the lengths reaches the driver (at most ``capacity`` counts, then one for each salted part:
   a length has a part for each ``PART`` of its pieces), which plans with it:
   large lengths are rounded up within ``GROUPS`` groups of equal cardinality; the
   configurations of those few sizes come from a linear program by column generation and are
   rounded down; actual lengths then take the places of the rounded ones; what is left and the
   small lengths go best-fit, in falling order, into what the sequences have free.  Sequences
   that look alike are planned as one class with a multiplicity, so that the plan's size
   depends on the number of lengths and not on the number of documents.
3. A full piece is a sequence by itself and needs no rank.  Each other piece gets its rank among the pieces of its
   length - counted within parts of about ``PART`` pieces, so that a length that a third of the documents have
   isn't one task's work, at any size - and finds its sequence and offset in the plan by binary search.

Defined results: null or empty text is one piece, the id 0 alone; repeated rows are packed
as often as they come; a null doc_id stays null; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import json
import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialise

CAPACITY = 2048
GROUPS = 64
SMALL = (1 / 32, 1 / 8, 1 / 4, 1 / 2, 1)  # of the capacity, each tried: lengths up to it are not grouped; with 1 it is best fit alone
PART = 1 << 18  # pieces of one length that one task ranks
END_ID = 0

#: The published splitting pattern of this byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenIds:
    """Ids as ``tokenizers`` gives them with add_special_tokens=False.

    Texts of Latin letters and common punctuation go through tiktoken with the same
    vocabulary, which is three times faster and has the same ids (tests compare them);
    others, and those that hold a special token's string, go through ``tokenizers``."""

    def __init__(self, path: str, plain: bool = False) -> None:
        """``plain``: special tokens' strings in a text are ordinary text."""
        import tiktoken

        self.path, self.exact, self.plain = path, None, plain
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the public rule of byte-level vocabularies
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.ranks = ranks
        self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("|".join([r"[^\x00-ɏ‐-‧€]", *map(re.escape, special)]))

    def __call__(self, text: str) -> np.ndarray:
        if self.other.search(text):
            if self.exact is None:  # few tasks need it
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
                self.exact.encode_special_tokens = self.plain
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def tokens(self) -> list[bytes]:
        """The bytes of each id; of ids that no text has, none."""
        out = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            out[i] = token
        return out


_PIECE = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = TokenIds(path)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.append(ids_of(text.as_py() or ""), np.uint32(END_ID)).astype("<u4", copy=False)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc_id.as_py(), uid, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    uid += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _PIECE)], schema=_PIECE)

    return body


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, how many sequences), from the linear program rounded down."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = counts / np.diag(basis)
    for _ in range(100 * k):
        inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ counts, 0)
        price = inverse.sum(axis=0)
        best = np.zeros(capacity + 1)
        took = np.full(capacity + 1, -1)
        for i in np.flatnonzero(price > 1e-12):  # unbounded knapsack, in spans as long as the size
            s = int(sizes[i])
            for a in range(s, capacity + 1, s):
                b = min(a + s, capacity + 1)
                better = best[a - s : b - s] + price[i] > best[a:b] + 1e-12
                best[a:b][better] = (best[a - s : b - s] + price[i])[better]
                took[a:b][better] = i
        if best[capacity] <= 1 + 1e-7:
            break  # no configuration is worth more than it takes: the program is solved
        column, left = np.zeros(k), capacity
        while left > 0:
            if took[left] < 0:
                left -= 1
                continue
            column[took[left]] += 1
            left -= int(sizes[took[left]])
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    else:
        warnings.warn("column generation ended before the program was solved: sequences may be somewhat more than needed", stacklevel=2)
    x = np.maximum(np.linalg.inv(basis) @ counts, 0)
    return [(basis[:, j].astype(int), int(x[j] + 1e-9)) for j in range(k) if x[j] + 1e-9 >= 1]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """The plan of fewest sequences among those with each of ``SMALL``; it never takes more than best fit in falling order."""
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    best = None
    for small in SMALL:
        plan = plan_with(counts, small, capacity, groups)
        if best is None or plan[1] < best[1]:
            best = plan
        if best[1] == least:
            break
    return best


def plan_with(counts: dict[int, int], small: float, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, pieces, first sequence, offset) by length and rank, and the number of sequences."""
    left = dict(counts)
    used = dict.fromkeys(counts, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: (first sequence, how many)
    some, made = 0, 0  # some: bit g is set where free[g] has classes

    def put(length: int, n: int, first: int, offset: int) -> None:
        rows.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    def give(gap: int, first: int, n: int) -> None:
        nonlocal some
        if n and gap:
            free[gap].append((first, n))
            some |= 1 << gap

    if left.get(capacity):
        made = left[capacity]
        put(capacity, made, 0, 0)
    large = [s for s in sorted(left, reverse=True) if small * capacity < s < capacity and left[s]]
    total = sum(left[s] for s in large)
    groups = min(groups, total // 4)  # four pieces at least to a group
    if groups:
        members: list[list[list[int]]] = [[]]  # of each group: [length, how many], falling
        room = [total // groups + (i < total % groups) for i in range(groups)]
        at = 0
        for s in large:
            n = left[s]
            while n:
                take = min(n, room[at])
                members[at].append([s, take])
                room[at] -= take
                n -= take
                if not room[at] and at + 1 < groups:
                    at += 1
                    members.append([])
        merged: dict[int, list[list[int]]] = {}
        for m in members:
            if m:
                merged.setdefault(m[0][0], []).extend(m)  # groups that round up to the same length are one
        sizes = np.array(list(merged))
        queue = [merged[s] for s in merged]
        for column, n in configurations(sizes, np.array([sum(c for _, c in q) for q in queue], dtype=float), capacity):
            classes = [(made, n, 0)]
            made += n
            for g in np.repeat(np.arange(len(sizes)), column):
                after = []
                for first, m, fill in classes:
                    while m:
                        run = queue[g][0]
                        take = min(m, run[1])
                        put(run[0], take, first, fill)
                        after.append((first, take, fill + run[0]))
                        first, m, run[1] = first + take, m - take, run[1] - take
                        if not run[1]:
                            queue[g].pop(0)
                classes = after
            for first, m, fill in classes:
                give(capacity - fill, first, m)
    for s in sorted((s for s in left if 0 < s < capacity), reverse=True):
        while left[s]:
            fits = some >> s
            if not fits:
                each = capacity // s
                full, rest = divmod(left[s], each)
                for n, per in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        for k in range(per):
                            put(s, n, made, k * s)
                        give(capacity - per * s, made, n)
                        made += n
                break
            gap = s + (fits & -fits).bit_length() - 1
            first, n = free[gap].pop()
            if not free[gap]:
                some &= ~(1 << gap)
            take = min(n, left[s])
            put(s, take, first, capacity - gap)
            give(gap - s, first, take)
            give(gap, first + take, n - take)
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), made


_PLACED = pa.schema([*[f for f in _PIECE if f.name != "uid"], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _placed(plan: np.ndarray):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            found = [pa.array(plan[at, 3] + rank - plan[at, 1]), pa.array(plan[at, 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in _PLACED if f.name in batch.schema.names), *found], schema=_PLACED)

    return body


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialise(rows.mapInArrow(_pieces(tokenizer_path, capacity), _PIECE_DDL))
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*out, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    spark = docs.sparkSession
    lengths = {int(r["length"]): int(r["n"]) for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame([(n, -(-count // PART)) for n, count in lengths.items()], "length long, parts long")
    rest = rest.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("long"))
    counted = rest.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas().sort_values(["length", "salt"])
    counted["before"] = counted.groupby("length")["n"].cumsum() - counted["n"]
    plan, _ = plan_sequences(lengths, capacity)
    offsets = F.broadcast(spark.createDataFrame(counted[["length", "salt", "before"]], "length long, salt long, before long"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    ranked = rest.withColumn("rank", rank.cast("long")).join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    return full.unionByName(ranked.select(*out, "rank").mapInArrow(_placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
