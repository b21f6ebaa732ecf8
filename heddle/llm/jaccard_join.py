"""N-gram Jaccard self-join by the chosen-path method.

Sets are the distinct five-word shingles of a text (see ``wordgrams``); two sets are linked
when their Jaccard similarity is at least 0.8.

1. One pass makes each text's set and keeps its digest, size, a sketch of 64 minima and the
   shingles that it *chooses*: in each run every shingle is taken with
   probability 1 / (0.8 x set size), by a hash that is the same for all texts; where a run
   takes none, it takes the one of the smallest hash.  Two sets of equal size and similarity
   0.8 share a chosen shingle in a run with probability 0.67 by the first rule and about
   0.87 with the second.  Runs are repeated until the first rule alone reaches ``RECALL``: nine times.
2. Texts with equal sets become one class (a hash aggregate with map-side combine, so
   that a third of all rows with one text is a row a task).
3. A chosen shingle is a bucket.  Buckets of one class vanish.  A bucket over ``LIMIT`` is split
   again on chosen sketch positions, in as many runs, and so are its buckets, down to ``LEVELS``; those
   still over the limit afterwards are near copies of each other and are compared in blocks, each a task's work, as are
   buckets whose sets hold more than ``HASHES`` hashes together.  (The number of links of each text
   is asked for, so all pairs of a group of different near copies have to be looked at.)
4. In a bucket, sizes and sketches pick likely pairs; each pair belongs, on each level, to the smallest bucket
   that both have chosen and is looked at only there.  Only classes of likely pairs get
   their sets (made anew in a second pass, behind a bitmap of bounded size) and are
   compared exactly.
5. What leaves a bucket is one row for each class: its number of links and its local
   root; pairs are never written.  Connected components follow from the roots.

A pair whose similarity is 0.8 or more is left out only if its sketches agree in under 0.5
(about 2 in 100 million at 0.8) or no run joins it; the target recall is 0.9999 for each link.

Defined results: null, empty and wordless texts have no set, no links and a class of their
own; texts of one to four words have one shingle; repeated rows are copies of each other;
a class whose rows all have a null doc_id has a null class_id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import bitmap, in_bitmap, marked, marks, materialise, runs, tasks_for, without_rows
from heddle.llm.components import connected_components
from heddle.llm.wordgrams import mix, shingle_sets

SHINGLE = 5
SIMILAR = 0.8
RECALL = 0.9999
LEVELS = 3
BINS = 64
LIKELY = 0.5
LIMIT = 8192
HASHES = 2_000_000  # of a block: two of them are compared at once, 32 MB a copy
PAIRS = 1 << 20  # that a task holds at once

HOT = 256  # rows of a bucket from which its join is dealt in ``SALTS`` parts
SALTS = 16


def runs_for(recall: float, similar: float = SIMILAR) -> int:
    """Runs after which two sets of equal size and this similarity share a chosen shingle with probability ``recall``."""
    common = 2 * similar / (1 + similar) / similar  # expected number of shared shingles that a run takes
    return math.ceil(math.log(1 - recall) / -common)


RUNS = runs_for(RECALL)
_SEEDS = np.array([mix(np.zeros(1, np.uint64), 1000 + r)[0] for r in range(RUNS)], dtype=np.uint64)
_BIN_EDGES = np.array([i << 58 for i in range(BINS)], dtype=np.uint64)
_LAST = np.uint64(2**64 - 1)


def _bound(n: float) -> np.uint64:
    share = 1 / (SIMILAR * n)
    return _LAST if share >= 1 else np.uint64(int(share * 2**64))


def chosen(values: np.ndarray) -> np.ndarray:
    """The buckets of a set, over all runs, sorted."""
    h = mix(values[None, :] ^ _SEEDS[:, None], 7)
    least = h.min(axis=1)
    bound = _bound(len(values))
    return np.unique(np.concatenate([h[h <= bound], least[least > bound]]))


def sketch(values: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value in each 64th of the hash range; 0 where there is none."""
    first = np.searchsorted(values, _BIN_EDGES)
    next_ = np.append(first[1:], len(values))
    some = next_ > first
    out = np.zeros(BINS, np.uint16)
    out[some] = (mix(values[first[some]], 11) & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 40
    for batch in batches:
        n, cls, sk, toks = [], [], [], []
        for row, values in shingle_sets(batch.column(1), SHINGLE):
            n.append(len(values))
            if len(values):
                cls.append(digest(values))
                sk.append(sketch(values).tobytes())
                toks.append(chosen(values).view(np.int64))
            else:
                cls.append((uid + row).to_bytes(17, "big"))
                sk.append(b"")
                toks.append(np.zeros(0, np.int64))
        names = ["doc_id", "uid", "n", "cls", "sketch", "tokens"]
        columns = [batch.column(0), pa.array(np.arange(uid, uid + len(n))), pa.array(n, pa.int32()), pa.array(cls, pa.binary()), pa.array(sk, pa.binary()), pa.array(toks, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns + batch.columns[2:], names=names + batch.schema.names[2:])
        uid += len(n)


def sub_buckets(parent: int, sketches: np.ndarray) -> np.ndarray:
    """(row, run x position): the buckets below ``parent`` of each sketch, 0 where none is chosen."""
    key = sketches.astype(np.uint64) + (np.arange(BINS, dtype=np.uint64) << np.uint64(16))
    h = mix((mix(key ^ np.uint64(parent), 13))[:, None, :] ^ _SEEDS[None, :, None], 17)
    h = np.where((sketches != 0)[:, None, :], h, _LAST)
    take = (h <= np.maximum(_bound(BINS), h.min(axis=2, keepdims=True))) & (h != _LAST)
    h = np.where(take, h, np.uint64(0))
    return h.reshape(len(sketches), -1)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, parents = batch.column("path").to_pylist(), batch.column("bucket").to_numpy().view(np.uint64)
        sketches = _sketches(batch.column("sketch"))
        reps, sizes = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
        for i in range(batch.num_rows):
            subs = sub_buckets(int(parents[i]), sketches[i : i + 1])[0]
            subs = np.unique(subs[subs != 0])
            path = pa.array([[*paths[i], int(parents[i].view(np.int64))]] * len(subs), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(subs.view(np.int64)), path, pa.array(np.full(len(subs), reps[i])), pa.array(np.full(len(subs), sizes[i], np.int32))], names=["bucket", "path", "rep", "n"])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BINS)


def likely_pairs(n: np.ndarray, sketches: np.ndarray, block: np.ndarray, across: bool, part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sizes and sketches allow the similarity, of each row with larger ones; ``part``: only those of
    these rows in the order of size."""
    order = np.argsort(n, kind="stable")
    n, s, block = n[order], sketches[order], block[order]
    filled = s != 0
    to = np.searchsorted(n, n / SIMILAR + 1e-9, side="right")
    left, right = [], []
    for i in range(len(n) - 1)[part]:
        a, b = i + 1, int(to[i])
        if b <= a:
            continue
        same = ((s[a:b] == s[i]) & filled[i]).sum(axis=1)
        some = (filled[a:b] | filled[i]).sum(axis=1)
        ok = same >= LIKELY * some
        if across:
            ok &= block[a:b] != block[i]
        j = np.flatnonzero(ok)
        if len(j):
            left.append(np.full(len(j), order[i]))
            right.append(order[a + j])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


class Shared:
    """How many values the rows of a group have in common with one of them: an inverted index over all rows' values.

    ``values``: those of the rows one after another, of each row ``sizes`` many and each once."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        new = np.ones(len(values), dtype=bool)
        new[1:] = np.diff(values[order]) != 0
        self.number = np.empty(len(values), np.int32)
        self.number[order] = np.cumsum(new, dtype=np.int32) - 1
        self.holders = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.start = np.append(np.flatnonzero(new), len(values))
        self.first = np.append(0, np.cumsum(sizes))

    def with_row(self, i: int) -> np.ndarray:
        """For each row; a bounded number of holders is looked at at once."""
        mine = self.number[self.first[i] : self.first[i + 1]]
        start, count = self.start[mine], self.start[mine + 1] - self.start[mine]
        common = np.zeros(len(self.first) - 1, np.int64)
        for part in np.array_split(np.arange(len(mine)), 1 + int(count.sum()) // PAIRS):
            c = count[part]
            at = np.repeat(start[part] - np.cumsum(c) + c, c) + np.arange(c.sum())
            common += np.bincount(self.holders[at], minlength=len(common))
        return common


def _smaller(group: pa.Table, sketches: np.ndarray) -> list[Shared]:
    """On each level, the chosen buckets of each row that are smaller than the group's."""
    path = np.array([*group.column("path")[0].as_py(), group.column("bucket")[0].as_py()], np.int64).view(np.uint64)
    tokens = group.column("tokens").combine_chunks()
    values, row = tokens.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy())
    under = values < path[0]
    levels = [Shared(values[under], np.bincount(row[under], minlength=len(tokens)))]
    for parent, bucket in zip(path, path[1:]):
        parts, sizes = [], []
        for first in range(0, len(sketches), 512):
            subs = sub_buckets(int(parent), sketches[first : first + 512])
            under = (subs != 0) & (subs < bucket)
            parts.append(subs[under])
            sizes.append(under.sum(axis=1))
        levels.append(Shared(np.concatenate(parts), np.concatenate(sizes)))
    return levels


_KEYS = ["bucket", "one", "two"]


def _pairs(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """A row of the group and those that make likely pairs with it, again and again: a group of near copies has as many pairs as
    the square of its rows, and only a bounded number is held at once.  A pair belongs to the smallest bucket that both have
    chosen, on each level, and is left out elsewhere."""
    n, sketches = group.column("n").to_numpy(), _sketches(group.column("sketch"))
    block, across = group.column("block").to_numpy(), group.column("one")[0] != group.column("two")[0]
    smaller = None
    step = max(1, PAIRS // len(n))
    for first in range(0, len(n) - 1, step):
        left, right = likely_pairs(n, sketches, block, across, slice(first, first + step))
        edges = np.flatnonzero(np.diff(left, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(left))):
            smaller = smaller or _smaller(group, sketches)
            i, js = int(left[a]), right[a:b]
            for level in smaller:
                js = js[level.with_row(i)[js] == 0]
            if len(js):
                yield i, js


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, _KEYS):
        some = np.zeros(len(group), dtype=bool)
        for i, js in _pairs(group):
            some[i] = some[js] = True
        if some.any():
            for batch in group.select(["bucket", "path", "one", "two", "block", "rep"]).filter(pa.array(some)).combine_chunks().to_batches():
                yield batch


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, _KEYS):
        sets, size, rep = None, group.column("size").to_numpy(), group.column("rep").to_numpy()
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i, js in _pairs(group):
            if sets is None:
                lengths = pc.binary_length(group.column("set")).to_numpy() // 8
                sets = Shared(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]), lengths)
            common = sets.with_row(i)[js]
            js = js[common / (lengths[i] + lengths[js] - common) >= SIMILAR - 1e-12]
            if not len(js):
                continue
            links[i] += size[js].sum()
            links[js] += size[i]
            met = np.unique(root[np.append(js, i)])
            if len(met) > 1:
                root[np.isin(root, met)] = met[rep[met].argmin()]
        rows = np.flatnonzero(links > 0)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rep[rows]), pa.array(links[rows]), pa.array(rep[root[rows]])], names=["rep", "links", "root"])


def _sets_of(wanted: bytes):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).filter(pa.array(in_bitmap(wanted, batch.column(0).to_numpy())))
            rows: list[tuple[bytes, bytes]] = []
            for _, values in shingle_sets(texts, SHINGLE):
                if len(values):
                    rows.append((digest(values), values.tobytes()))
                if len(rows) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["cls", "set"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["cls", "set"])

    return body


def _shared(rows: DataFrame) -> DataFrame:
    """(bucket, path, rep, n) rows in buckets of two or more, with the bucket's size and the sum of its sets' sizes n.

    Sizes are joined back by bucket; rows of buckets that share a place in a bitmap with one over ``HOT`` are dealt in
    parts, with their size row in each, so that no bucket is one task's work."""
    sizes = materialise(rows.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("hashes")).where("m >= 2"))
    hot = F.broadcast(marks(sizes.where(F.col("m") >= HOT), "bucket"))

    def salted(df: DataFrame, salts) -> DataFrame:
        flagged = df.join(hot, marked("bucket")[0] == F.col("_slot"), "left")
        return flagged.withColumn("salt", F.when(F.coalesce(F.col("_word").bitwiseAND(marked("bucket")[1]) != 0, F.lit(False)), salts[0]).otherwise(salts[1])).drop("_slot", "_word")

    mine = salted(rows, (F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"), F.lit(0)))
    each = salted(sizes, (F.sequence(F.lit(0), F.lit(SALTS - 1)), F.array(F.lit(0)))).withColumn("salt", F.explode("salt"))
    return mine.join(each, ["bucket", "salt"]).drop("salt")


def _in_blocks(rows: DataFrame, limit: int, hashes: int = HASHES) -> DataFrame:
    """Adds the block pairs that each row takes part in; one pair (0, 0) for a small bucket."""
    parts = F.least(F.col("m"), F.greatest(F.ceil(F.col("m") / F.lit(limit)), F.ceil(F.col("hashes") / F.lit(hashes)))).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("rep", "bucket"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("one"), F.greatest(o, F.col("block")).alias("two")))
    return rows.withColumn("p", F.explode(pairs)).select("bucket", "path", "rep", "block", "p.one", "p.two")


def jaccard_join(docs: DataFrame, limit: int = LIMIT, keyed: bool = False, hashes: int = HASHES) -> DataFrame:
    """One row for each document: doc_id, class_id (smallest doc_id that links lead to), n_links
    (other documents with a similarity of at least 0.8), copies_id (smallest doc_id with
    the same shingles); with ``keyed`` text_sha256 and elected: whether its (doc_id, text_sha256) is the smallest of
    its class, among the rows with a doc_id and among those without one."""
    tasks = tasks_for(docs)
    key = ["text_sha256"] if keyed else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.sha2(F.col("text").cast("binary"), 256).alias(c) for c in key])
    sketched = materialise(texts.mapInArrow(_sketched, "doc_id long, uid long, n int, cls binary, sketch binary, tokens array<long>" + "".join(f", {c} string" for c in key)))
    row = F.struct("doc_id", *key)
    firsts = {"first": F.min(F.when(F.col("doc_id").isNotNull(), row)), "nameless": F.min(F.when(F.col("doc_id").isNull(), row))} if keyed else {}
    classes = materialise(
        sketched.groupBy("cls").agg(
            F.min("uid").alias("rep"), F.count("*").alias("size"), F.min("doc_id").alias("copies_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("tokens").alias("tokens"), *[c.alias(name) for name, c in firsts.items()]
        )
    )
    whole = materialise(_shared(classes.select("rep", "n", F.explode("tokens").alias("bucket")).select("bucket", F.array().cast("array<long>").alias("path"), "rep", "n")))
    buckets = whole.where(F.col("m") <= limit)
    for level in range(1, LEVELS + 1):
        over = whole.where(F.col("m") > limit)
        if over.isEmpty():
            break
        if level == LEVELS:
            buckets = buckets.unionByName(over)
            break
        large = over.select("bucket", "path", "rep").join(classes.select("rep", "n", "sketch"), "rep")
        whole = materialise(_shared(large.mapInArrow(_split, "bucket long, path array<long>, rep long, n int")))
        buckets = buckets.unionByName(whole.where(F.col("m") <= limit))
    light = classes.select("rep", "n", "sketch", "tokens", "size", "cls")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, *_KEYS).sortWithinPartitions(*_KEYS)

    told = _in_blocks(buckets, limit, hashes).join(light.drop("cls", "size"), "rep")
    marked = materialise(grouped(told).mapInArrow(_mark, "bucket long, path array<long>, one int, two int, block int, rep long"))
    wanted = marked.select("rep").distinct().join(classes.select("rep", "copies_id"), "rep").select(F.xxhash64("copies_id").alias("h"))
    sets = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text").mapInArrow(_sets_of(bitmap(wanted, "h", 24)), "cls binary, set binary")
    full = marked.join(light, "rep").join(sets.dropDuplicates(["cls"]), "cls")
    found = materialise(grouped(full).mapInArrow(_verify, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = classes.select("cls", "rep", "size", "copies_id", *firsts).join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    # a class without links is a component by itself; a component of many classes is named in parts
    linked = joined.where(F.col("root").isNotNull())
    of_root = linked.groupBy("root").agg(F.min("copies_id").alias("class_id"), *[F.min(name).alias(name) for name in firsts])
    of_root = of_root.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.drop(*firsts).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(of_root, ["root", "salt"]).drop("salt")
    named = named.unionByName(joined.where(F.col("root").isNull()).withColumn("class_id", F.col("copies_id")).select(*named.columns))
    members = named.select("cls", "class_id", "copies_id", *firsts, (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    elected = [row.eqNullSafe(F.when(F.col("doc_id").isNotNull(), F.col("first")).otherwise(F.col("nameless"))).alias("elected")] if keyed else []
    return sketched.select("doc_id", "cls", *key).join(members, "cls").select("doc_id", "class_id", "n_links", "copies_id", *key, *elected)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class that has a doc_id, and one of those that have none, all columns: that of the
    smallest doc_id and text hash.  A row is told by both."""
    linked = jaccard_join(docs, keyed=True).where("n_links > 0")
    known = materialise(linked.groupBy("doc_id", "text_sha256").agg(F.first("elected").alias("elected"), F.count("*").alias("n")))
    gone, once = (known.where(which).select("doc_id", "text_sha256") for which in ("not elected", "elected and n > 1"))
    return without_rows(docs, gone, None if once.isEmpty() else once)
