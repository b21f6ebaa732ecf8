"""Exact dedup by Patricia tries.

Two texts are equal when they are identical after deleting space and U+0009-U+000D.

1. Each task inserts the full normalised bytes of its rows into compressed radix
   tries, one for each length.  A terminal node stores the row that stays among its
   own (most code points in the original text, then smallest doc_id) and how many
   rows it has seen.  Past ``trie_bytes`` the largest length's subtree is handed on
   and forgotten; a later copy then starts a new terminal, which step 2 joins.
2. Only terminals are shuffled, by length and content hash, so that a text held by a
   third of all rows arrives as one row for each task.  The owners' tries
   hold all keys of a length that their hashes bring them and again compare full bytes; Spark's sort (which
   spills) brings keys in the order of length and hash, so that past ``trie_bytes``, at the next hash, everything
   in the trie is finished and leaves the memory.
3. Rows find their terminal's owner by the terminal's number; no number has more
   rows than one task has read.

Defined results: null text counts as empty, and all empty texts are one group; a null
doc_id sorts after all others; of repeated rows (same doc_id and text) one is
kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import fresh, materialise, tasks_for, told_apart

WHITE = b" \t\n\v\f\r"

_LAST = 1 << 63  # sorts a null doc_id after all others


class Trie:
    """A compressed radix trie over byte strings of one length.

    An inner node is a dict from the next byte to (label, node); a node at the full
    length is terminal and holds [best, count, payload of the caller]."""

    __slots__ = ("root", "held")

    def __init__(self) -> None:
        self.root: list = [b"", None, None]  # label, children by first byte, terminal
        self.held = 0

    def terminal(self, key: bytes) -> list:
        """The terminal node's record for ``key``, a new empty list if there is none yet."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node[2] is None:
                    node[2] = []
                return node[2]
            children = node[1]
            if children is None:
                children = node[1] = {}
            child = children.get(key[at])
            if child is None:
                leaf: list = [key[at:], None, []]
                children[key[at]] = leaf
                self.held += len(key) - at + 200
                return leaf[2]
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            low, high = 1, min(len(label), len(key) - at)  # the first byte is equal
            while low < high:  # the longest common prefix
                mid = (low + high + 1) // 2
                if label[:mid] == key[at : at + mid]:
                    low = mid
                else:
                    high = mid - 1
            upper: list = [label[:low], {label[low]: child}, None]
            child[0] = label[low:]
            children[key[at]] = upper
            self.held += 200
            node, at = upper, at + low

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """All keys with their records."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            here = before + node[0]
            if node[2] is not None:
                yield here, node[2]
            for child in (node[1] or {}).values():
                stack.append((child, here))


_LOCAL = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("uid", pa.int64()),
        ("rep", pa.int64()),
        ("text_sha256", pa.string()),
        ("norm_len", pa.int64()),
        ("payload", pa.large_binary()),
        ("n", pa.int64()),
        ("best_chars", pa.int64()),
        ("best_id", pa.int64()),
        ("best_uid", pa.int64()),
    ]
)
_LOCAL_DDL = "doc_id long, uid long, rep long, text_sha256 string, norm_len long, payload binary, n long, best_chars long, best_id long, best_uid long"
_OUT_ROWS = 2000


def _local_tries(trie_bytes: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        tries: dict[int, Trie] = {}
        held, uid, reps = 0, base, base

        def flush(length: int) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            size = 0
            for key, (rep, sha, n, best) in tries.pop(length).walk():
                rows.append((None, None, rep, sha, length, key, n, -best[0], None if best[1] == _LAST else best[1], best[2]))
                size += len(key)
                if len(rows) == _OUT_ROWS or size > 1 << 22:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

        for batch in batches:
            for start in range(0, batch.num_rows, _OUT_ROWS):
                part = batch.slice(start, _OUT_ROWS)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    text = text or ""
                    key = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
                    trie = tries.get(len(key))
                    if trie is None:
                        trie = tries[len(key)] = Trie()
                    before = trie.held
                    record = trie.terminal(key)
                    held += trie.held - before
                    rank = (-len(text), _LAST if doc_id is None else doc_id, uid)
                    if record:
                        record[2] += 1
                        if rank < record[3]:
                            record[3] = rank
                    else:
                        record += [reps, hashlib.sha256(key).hexdigest(), 1, rank]
                        reps += 1
                    rows.append((doc_id, uid, record[0], record[1], None, None, None, None, None, None))
                    uid += 1
                yield _batch(rows)
                while held > trie_bytes:
                    largest = max(tries, key=lambda k: tries[k].held)
                    held -= tries[largest].held
                    yield from flush(largest)
        for length in list(tries):
            yield from flush(length)

    return body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _LOCAL)], schema=_LOCAL)


_OWNER = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_uid", pa.int64()), ("group_size", pa.int64())])


def _owners(trie_bytes: int):
    def finished(trie: Trie) -> pa.RecordBatch:
        out = [(rep, None if best[1] == _LAST else best[1], best[2], n) for _, (reps, n, best) in trie.walk() for rep in reps]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _OWNER)], schema=_OWNER)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Terminals sorted by length and hash: equal texts come one after the other."""
        trie, length, sha = Trie(), None, None
        for batch in batches:
            for start in range(0, batch.num_rows, _OUT_ROWS):
                part = batch.slice(start, _OUT_ROWS)
                columns = [part.column(c).to_pylist() for c in ("norm_len", "text_sha256", "rep", "payload", "n", "best_chars", "best_id", "best_uid")]
                for key_length, key_sha, rep, key, n, chars, best_id, uid in zip(*columns):
                    if length is not None and (key_length != length or (key_sha != sha and trie.held > trie_bytes)):
                        yield finished(trie)
                        trie = Trie()
                    length, sha = key_length, key_sha
                    record = trie.terminal(key)
                    rank = (-chars, _LAST if best_id is None else best_id, uid)
                    if record:
                        record[0].append(rep)
                        record[1] += n
                        record[2] = min(record[2], rank)
                    else:
                        record += [[rep], n, rank]
        if length is not None:
            yield finished(trie)

    return body


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 96 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    local = materialise(rows.mapInArrow(_local_tries(trie_bytes), _LOCAL_DDL))
    terminals = local.where("payload is not null").select("rep", "norm_len", "text_sha256", "payload", "n", "best_chars", "best_id", "best_uid")
    owners = (
        terminals.repartition(tasks_for(docs), "norm_len", "text_sha256")
        .sortWithinPartitions("norm_len", "text_sha256")
        .mapInArrow(_owners(trie_bytes), "rep long, keep_id long, keep_uid long, group_size long")
    )
    return (
        local.where("payload is null")
        .select("doc_id", "uid", "rep", "text_sha256")
        .join(owners, "rep")
        .select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns.

    Only rows that share their doc_id's place in a bitmap with a dropped row are shuffled with their text;
    among them the kept row is found by doc_id and text, and of repeated rows one stays."""
    decided = materialise(exact_dedup(docs).select("doc_id", "kept", "text_sha256"))
    rest, maybe = told_apart(docs, decided.where("not kept").select("doc_id"))
    one, key, sha = fresh(docs, "_id", "_key", "_text_sha")
    kept = decided.where("kept").select(F.col("doc_id").alias(one), F.col("text_sha256").alias(key))
    white = "translate(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')"
    named = maybe.withColumn(sha, F.sha2(F.expr(white).cast("binary"), 256))
    found = named.join(kept, named["doc_id"].eqNullSafe(kept[one]) & (named[sha] == kept[key]), "left_semi")
    return rest.unionByName(found.dropDuplicates(["doc_id", sha]).drop(sha))
