"""Language identification by a byte convolutional network.

Filters of two, three and four bytes run over windows of ``WINDOW`` bytes, each filter's maximum over
the window goes through a rectifier into a softmax over the learned languages; a text's log
probabilities are the mean over all its windows, weighted by their bytes.  The network
is trained in numpy on at most ``TRAIN_DOCS`` labelled documents and ``TRAIN_BYTES`` bytes of each language (the smallest
hashes of doc_id, none over ``common.SAMPLE_TEXT`` bytes; a documented bound), so that every labelled language is learned, and applied to whole texts in one pass without a shuffle.

For inference the filters become tables over pairs of bytes, so that a window costs three
table look-ups a byte for all filters at once.

Defined results: ``und`` with the score 0 for null texts, texts without a letter, and for all
texts if there is no labelled document; with one learned language its score is 1;
repeated rows each get theirs; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import held_out, sample_texts
from heddle.llm.wordgrams import chunks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
TRAIN_DOCS, TRAIN_BYTES = 1000, 8 << 20  # of each language
TRAIN_WINDOWS = 4  # of each document
EPOCHS, BATCH, RATE = 6, 64, 0.01

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48


def has_letter(text: str) -> bool:
    """A character of one of Unicode's letter categories: no digit, fraction, superscript or mark."""
    return any(map(str.isalpha, text))


def windows(raw: bytes) -> np.ndarray:
    """(window, byte) of a text, the last one filled with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = _FOLD[np.frombuffer(raw, np.uint8)]
    return out.reshape(n, WINDOW)


class Network:
    """``languages``, a bank of filters for each width, and the softmax layer."""

    def __init__(self, texts: list[str], langs: list[str]) -> None:
        self.languages = sorted(set(langs))
        if len(self.languages) < 2:
            return
        rng = np.random.default_rng(0)
        x, y = [], []
        for text, lang in zip(texts, langs):
            w = windows((text or "").encode("utf-8", "surrogatepass"))
            for i in rng.permutation(len(w))[:TRAIN_WINDOWS]:
                x.append(w[i])
                y.append(self.languages.index(lang))
        self._train(np.array(x), np.array(y), rng)

    def _train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        places = WINDOW - max(WIDTHS) + 1
        bank = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS + 1, len(self.languages))).astype(np.float32)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (*bank, dense)]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for begin in range(0, len(x), BATCH):
                rows = order[begin : begin + BATCH]
                b = x[rows]
                at, peaks = [], []
                for filters in bank:
                    out = sum(filters[k][b[:, k : k + places]] for k in range(len(filters)))
                    where = out.argmax(axis=1)
                    at.append(where)
                    peaks.append(np.take_along_axis(out, where[:, None, :], axis=1)[:, 0, :])
                hidden = np.concatenate(peaks, axis=1)
                active = np.concatenate([np.maximum(hidden, 0), np.ones((len(rows), 1), np.float32)], axis=1)
                logits = active @ dense
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                grads = []
                back = (p @ dense[:-1].T) * (hidden > 0)
                for j, filters in enumerate(bank):
                    g = np.zeros_like(filters)
                    part = back[:, j * FILTERS : (j + 1) * FILTERS]
                    for k in range(len(filters)):
                        symbols = np.take_along_axis(b, at[j] + k, axis=1)
                        np.add.at(g[k], (symbols, np.arange(FILTERS)[None, :].repeat(len(rows), 0)), part)
                    grads.append(g)
                grads.append(active.T @ p)
                step += 1
                for p_, g, m in zip((*bank, dense), grads, moments):  # Adam
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.99 * m[1] + 0.01 * g * g
                    p_ -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
        self.bank, self.dense = bank, dense

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the filters over the first two bytes (all widths), the third byte, and the third and fourth."""
        two = [b[0][:, None, :] + b[1][None, :, :] for b in self.bank]
        four = self.bank[2][2][:, None, :] + self.bank[2][3][None, :, :]
        return np.concatenate(two, axis=2).reshape(65536, -1), self.bank[1][2], four.reshape(65536, -1)

    def log_probabilities(self, w: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        pairs, third, fourth = tables
        places = WINDOW - max(WIDTHS) + 1
        out = np.empty((len(w), len(self.languages)), np.float32)
        for i in range(0, len(w), 64):
            b = w[i : i + 64]
            code = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            sums = pairs[code[:, :places]]
            sums[:, :, FILTERS : 2 * FILTERS] += third[b[:, 2 : 2 + places]]
            sums[:, :, 2 * FILTERS :] += fourth[code[:, 2 : 2 + places]]
            hidden = np.maximum(sums.max(axis=1), 0)
            logits = hidden @ self.dense[:-1] + self.dense[-1]
            logits -= logits.max(axis=1, keepdims=True)
            out[i : i + 64] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out


def fit(docs: DataFrame) -> Network:
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(0, 5))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("_place", place).where(F.col("_place") <= TRAIN_DOCS).select("doc_id", F.col("lang").alias("label"))
    rows = sample_texts(known.select("doc_id", "text"), chosen, TRAIN_BYTES)
    return Network(rows["text"].tolist(), rows["label"].tolist())


def _predicted(network: Network):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = len(network.languages) > 1
        tables = network.tables() if trained else None
        for batch in batches:
            for i, j in chunks(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                cut = [windows(r) for r in raw]
                first = np.cumsum([0, *map(len, cut)])
                logs = network.log_probabilities(np.concatenate(cut), tables) if trained else None
                for k, text in enumerate(texts):
                    if not network.languages or not has_letter(text):
                        continue
                    if not trained:
                        lang[k], score[k] = network.languages[0], 1.0
                        continue
                    weight = np.full(len(cut[k]), WINDOW)
                    weight[-1] = len(raw[k]) - WINDOW * (len(cut[k]) - 1)
                    mean = weight @ logs[first[k] : first[k + 1]] / weight.sum()
                    p = np.exp(mean - mean.max())
                    best = int(p.argmax())
                    lang[k], score[k] = network.languages[best], float(p[best] / p.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return body


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predicted(network), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(0, 5).alias("held_out"), "lang_pred", "score")
