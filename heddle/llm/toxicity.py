"""Toxicity by compression distance.

Two zstandard dictionaries of at most ``DICTIONARY`` bytes are made, each of text of its own class: the
ordinary one by zstandard's trainer from ordinary texts, the toxic one of the passages of toxic
texts that are over-represented there (strings of ``GRAMS`` bytes held by far more toxic texts than the
ordinary ones let expect; where they overlap, each text names the strongest; rarest first, so that the
commonest have the cheapest offsets).  A window of a text is compressed once with each; the bytes by which
the toxic dictionary does better are its distance.  Each window stands behind a short lead that
both dictionaries end with: without it zstandard would store most windows raw, and their lengths would say nothing.
The largest distances of a text, how many of its windows reach each threshold (each distinct window once: a phrase
repeated a hundred times tells no more than once), and its length go through a logistic calibration, weighted back to the classes' shares among all
labels and, if more than ``MOST_FALSE`` of the ordinary texts would be predicted toxic, shifted until no more are.
The calibration sees each sample text only with a toxic dictionary made without its fold; the ordinary one, of which it
takes little, is the same for all folds.

Fitting reads a bounded sample of labelled documents on the driver: the smallest hashes of doc_id, at most
``TOXIC_DOCS`` and ``ORDINARY_DOCS`` of them, none over ``common.SAMPLE_TEXT`` bytes, ``SAMPLE_BYTES`` of each class
together.  Of sample texts that repeat each other's shingles one goes into the dictionaries.  Scoring is one pass over
the documents without a shuffle: texts are cut into overlapping windows in numpy and whole batches of
windows go to zstandard in one call.

Defined results: null and empty texts have one empty window and so the score of a text with
no distance; without labels of both classes every score is the share of label 1 (0 without any);
repeated documents each get their row, repeated labels count as toxic if any row does;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import give_back, held_out, sample_texts
from heddle.llm.wordgrams import chunks, shingle_sets

WINDOW, STRIDE = 20, 10
GRAMS = 6, 8  # bytes
PARTS = 4  # in which grams are counted, a power of two
TOXIC_DOCS, ORDINARY_DOCS, SAMPLE_BYTES = 2000, 4000, 12 << 20
DICTIONARY = 1 << 10  # bytes of each
LEAST_Z, LEAST_RATIO, LEAST_TEXTS, LEAST_SHARE = 6.0, 12.0, 4, 0.02
STRONG = 0.8  # of the strongest gram of a passage: what its neighbours must have to belong to it
FOLDS = 4
MOST_FALSE = 0.01  # of the ordinary texts, by folds, that the calibration lets be predicted toxic
LARGEST, REACHED = 5, (1, 2, 3, 4, 5, 6)  # distances told one by one; thresholds whose windows are counted
LEAD = bytes(range(1, 9)) + bytes(range(14, 22))

_FRAME = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=1, min_match=4, target_length=0, strategy=zstandard.STRATEGY_DFAST, **_FRAME
    )
    trained = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=parameters)


def _folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def _spans(n: int) -> np.ndarray:
    """(start, length) of a text's windows."""
    start = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE, dtype=np.int64)
    return np.stack([start, np.clip(n - start, 0, WINDOW)], axis=1)


def _again(rows: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which windows repeat one before them of the same text."""
    key = owner.astype(np.uint64)
    for j in range(rows.shape[1]):
        key = (key ^ np.where(j < lengths, rows[:, j] + np.uint64(1), np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def _grams(raw: bytes, size: int) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = max(0, len(data) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = (out << np.uint64(8)) | data[j : j + n]
    return out


def _held_by(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams that ``LEAST_TEXTS`` texts hold, with the number of texts; only one of ``PARTS`` of all grams is in memory at a time."""
    found = []
    for part in range(PARTS):
        each = [np.zeros(0, np.uint64)]
        for text in texts:
            grams = _grams(text, size)
            each.append(np.unique(grams[(grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) & np.uint64(PARTS - 1) == part]))
        grams, n = np.unique(np.concatenate(each), return_counts=True)
        found.append((grams[n >= LEAST_TEXTS], n[n >= LEAST_TEXTS]))
    grams, n = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(grams)
    return grams[order], n[order]


def _counts(texts: list[bytes], grams: np.ndarray, size: int) -> np.ndarray:
    """How many of the texts hold each of the (sorted) grams."""
    out = np.zeros(len(grams), np.int64)
    if len(grams):
        for text in texts:
            here = np.unique(_grams(text, size))
            at = np.minimum(np.searchsorted(grams, here), len(grams) - 1)
            out[at[grams[at] == here]] += 1
    return out


def distinct_texts(texts: list[str]) -> np.ndarray:
    """Which texts mostly hold shingles that no text before them has."""
    rows = list(shingle_sets(pa.array(texts, pa.string())))
    sizes = np.array([len(values) for _, values in rows])
    if not sizes.sum():
        return np.ones(len(texts), bool)
    _, first = np.unique(np.concatenate([values for _, values in rows]), return_index=True)
    own = np.bincount(np.repeat(np.arange(len(rows)), sizes)[first], minlength=len(rows))
    return own >= 0.7 * sizes


def ordinary_dictionary(texts: list[bytes]) -> bytes:
    """What zstandard trains on ordinary texts; texts too few to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, [t for t in texts if len(t) > GRAMS[0]]).as_bytes()[-DICTIONARY:]
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:].ljust(8, b"\n")


def _marked(grams: np.ndarray, n: np.ndarray, ordinary: np.ndarray, toxic_texts: int, ordinary_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The over-represented grams and how much each tells: the texts that hold it, by the logarithm of how many times more they are than expected."""
    expected = (ordinary + 0.5) * toxic_texts / max(1, ordinary_texts)
    some = ((n - expected) / np.sqrt(expected) >= LEAST_Z) & (n >= LEAST_RATIO * expected) & (n >= max(LEAST_TEXTS, LEAST_SHARE * toxic_texts))
    return grams[some], n[some] * np.log(n[some] / expected[some])


def _passages(text: bytes, marked: dict[int, tuple[np.ndarray, np.ndarray]]) -> set[bytes]:
    """The strongest passage wherever marked grams overlap by more than a byte."""
    starts, ends, weights = [], [], []
    for size, (grams, weight) in marked.items():
        here = _grams(text, size)
        if len(here) and len(grams):
            at = np.minimum(np.searchsorted(grams, here), len(grams) - 1)
            found = np.flatnonzero(grams[at] == here)
            starts.append(found)
            ends.append(found + size)
            weights.append(weight[at[found]])
    out: set[bytes] = set()
    if not starts or not sum(map(len, starts)):
        return out
    start, end, weight = np.concatenate(starts), np.concatenate(ends), np.concatenate(weights)
    order = np.argsort(start, kind="stable")
    start, end, weight = start[order], end[order], weight[order]
    for run in np.split(np.arange(len(start)), np.flatnonzero(start[1:] >= np.maximum.accumulate(end)[:-1] - 1) + 1):
        most = weight[run].max()
        i = run[np.argmax(weight[run])]
        last, a, b = start[i], start[i], end[i]
        for j in run[(weight[run] >= STRONG * most) & (run > i)]:
            if start[j] > last + 1:
                break
            last, b = start[j], max(b, end[j])
        out.add(text[a:b])
    return out


def toxic_dictionary(texts: list[bytes], marked: dict[int, tuple[np.ndarray, np.ndarray]]) -> bytes:
    """The over-represented passages of toxic texts, by the marked grams of each size."""
    found: Counter[bytes] = Counter()
    for text in texts:
        found.update(_passages(text, marked))
    kept: list[bytes] = []
    for passage, texts_of in sorted(found.items(), key=lambda x: (-x[1], len(x[0]), x[0])):
        if texts_of >= max(3, LEAST_SHARE / 2 * len(texts)) and sum(map(len, kept)) + len(passage) <= DICTIONARY and not any(passage in k for k in kept):
            kept.append(passage)
    return b"".join(reversed(kept)).ljust(8, b"\n")


class Distance:
    """Features of texts; ``ordinary`` and ``toxic`` are the dictionaries' contents."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.compressors = _compressor(ordinary), _compressor(toxic)

    def of_windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(distance of every window, number of windows of each text)."""
        return self._compared(texts)[:2]

    def _compared(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``of_windows``, with the windows themselves and their lengths."""
        spans = [_spans(len(t)) for t in texts]
        counts = np.array([len(s) for s in spans])
        cuts = np.concatenate(spans)
        cuts[:, 0] += np.repeat(np.cumsum([0, *(len(t) for t in texts[:-1])]), counts)
        whole = np.frombuffer(b"".join(texts) + b"\0" * WINDOW, np.uint8)
        led = np.empty((len(cuts), len(LEAD) + WINDOW), np.uint8)
        led[:, : len(LEAD)] = np.frombuffer(LEAD, np.uint8)
        led[:, len(LEAD) :] = whole[cuts[:, :1] + np.arange(WINDOW)]
        segments = np.stack([np.arange(len(cuts)) * led.shape[1], cuts[:, 1] + len(LEAD)], axis=1).astype(np.uint64)
        buffer = zstandard.BufferWithSegments(led.tobytes(), segments.tobytes())
        a, b = (np.fromiter(map(len, out), np.int64, len(out)) for out in (c.multi_compress_to_buffer(buffer) for c in self.compressors))
        return a - b, counts, led[:, len(LEAD) :], cuts[:, 1]

    def features(self, texts: list[bytes]) -> np.ndarray:
        saved, counts, windows, lengths = self._compared(texts)
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(texts)), counts)
        some = np.flatnonzero(saved >= REACHED[0])
        saved[some[_again(windows[some], lengths[some], owner[some])]] = 0
        order = np.lexsort((-saved, owner))
        out = np.zeros((len(texts), LARGEST + len(REACHED) + 1))
        for k in range(LARGEST):
            some = counts > k
            out[some, k] = saved[order[first[some] + k]]
        for k, least in enumerate(REACHED):
            out[:, LARGEST + k] = np.log1p(np.bincount(owner, saved >= least, len(texts)))
        out[:, -1] = np.log(counts)
        return out


class Model:
    """Dictionaries and calibration; plain arrays, so that it goes to the tasks with the function."""

    def __init__(self, toxic: list[str], ordinary: list[str], share: float) -> None:
        self.share = share
        self.weights = None
        if not toxic or not ordinary:
            return
        t, o = [_folded(x) for x in toxic], [_folded(x) for x in ordinary]
        new_t, new_o = distinct_texts(toxic), distinct_texts(ordinary)
        fold_t, fold_o = np.arange(len(t)) % FOLDS, np.arange(len(o)) % FOLDS
        learned_t = [[x for x, new, f in zip(t, new_t, fold_t) if new and f == k] for k in range(FOLDS)]
        learned_o = [[x for x, new, f in zip(o, new_o, fold_o) if new and f == k] for k in range(FOLDS)]
        self.ordinary = ordinary_dictionary([x for part in learned_o for x in part])
        every = {}
        for size in GRAMS:
            grams, _ = _held_by([x for part in learned_t for x in part], size)  # the others can't be marked
            every[size] = grams, [[_counts(part, grams, size) for part in learned] for learned in (learned_t, learned_o)]

        def toxic_without(fold: int) -> bytes:
            rest = [k for k in range(FOLDS) if k != fold]
            texts, ordinary_texts = [x for k in rest for x in learned_t[k]], sum(len(learned_o[k]) for k in rest)
            sums = {size: (grams, *(sum(counts[k] for k in rest) for counts in by_fold)) for size, (grams, by_fold) in every.items()}
            return toxic_dictionary(texts, {size: _marked(*x, len(texts), ordinary_texts) for size, x in sums.items()})

        self.toxic = toxic_without(FOLDS)
        x, y = [], []
        for k in range(FOLDS):
            distance = Distance(self.ordinary, toxic_without(k))
            for label, texts, fold in ((1.0, t, fold_t), (0.0, o, fold_o)):
                part = [a for a, f in zip(texts, fold) if f == k]
                for i in range(0, len(part), 200):
                    x.append(distance.features(part[i : i + 200]))
                y += [label] * len(part)
        self._calibrate(np.concatenate(x), np.array(y), share)

    def _calibrate(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        for _ in range(50):  # Newton steps of ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
            step = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - 0.1 * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        w[-1] -= max(0.0, np.quantile((z @ w)[y == 0], 1 - MOST_FALSE))  # at 0.5 no more ordinary texts than that may pass
        self.weights = w

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.column_stack([(features - self.mean) / self.spread, np.ones(len(features))])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(0, 5)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    totals = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 1").orderBy(*order).limit(TOXIC_DOCS).unionByName(known.where("label = 0").orderBy(*order).limit(ORDINARY_DOCS))
    rows = sample_texts(docs, chosen, SAMPLE_BYTES)
    texts = {v: rows.loc[rows["label"] == v, "text"].tolist() for v in (0, 1)}
    del rows
    model = Model(texts[1], texts[0], totals.get(1, 0) / max(1, totals.get(1, 0) + totals.get(0, 0)))
    del texts
    give_back()
    return model


def _scored(model: Model):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic) if model.weights is not None else None
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                if distance is None:
                    score = np.full(j - i, model.share)
                else:
                    score = model.score(distance.features([_folded(t) for t in batch.column(1).slice(i, j - i).to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], names=["doc_id", "score"])

    return body


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those predicted toxic, all columns; nothing is shuffled."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic) if model.weights is not None else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for i, j in chunks(texts):
                part = batch.slice(i, j - i)
                if distance is not None:
                    score = model.score(distance.features([_folded(t) for t in texts.slice(i, j - i).to_pylist()]))
                    part = part.filter(pa.array(score < 0.5))
                elif model.share >= 0.5:
                    part = part.slice(0, 0)
                yield part

    return docs.mapInArrow(body, docs.schema)
