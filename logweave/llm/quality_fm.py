"""Operator 1: quality classifier, a factorisation machine.

A document is a sparse vector x of hashed words (dampened counts, unit
length), structure statistics of its bytes (binned) and metadata (the stated
length, binned).  The score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

so all pairwise interactions cost one pass over the non-zero entries.  The
model is fitted on the driver on a bounded sample of labelled rows
(``train_rows``); scoring is one map over the documents, without a shuffle.

Edge cases: a null or empty text has structure and metadata features only and
gets a score like any other; a null ``n_chars`` is a bin of its own; labels
that are null are ignored, a document labelled twice takes the lower label;
without any label, or with one class only, the score is the smoothed share of
label 1 for every document.  Repeated rows get one result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import text_bytes, text_chunks

WORD_BITS = 17
BINS = 12
CHUNK_BYTES = 2 << 20
# Byte classes of the structure statistics.
CLASSES = ("lower", "upper", "digit", "blank", "line_end", "stop", "bar", "symbol", "other", "high")
STATISTICS = (*CLASSES, "length", "words", "word_length", "line_length", "distinct", "repeated", "top_word", "stated", "stated_ratio")
N_FEATURES = (1 << WORD_BITS) + BINS * len(STATISTICS)
# Upper edges of the bins of a share (0..1).
SHARE_EDGES = np.array([1e-9, .002, .005, .01, .02, .04, .08, .15, .3, .5, .75])


def _byte_classes() -> np.ndarray:
    kind = np.full(256, CLASSES.index("other"), np.int64)
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)),
                        ("blank", b" \t\r\x0b\x0c"), ("line_end", b"\n"), ("stop", b".,;:!?'\"-()"), ("bar", b"|<>{}[]=/\\_"),
                        ("symbol", b"#$%&*@^~+`"), ("high", range(128, 256))):
        kind[list(chars)] = CLASSES.index(name)
    return kind


KIND = _byte_classes()
IN_WORD = ~np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
# Weight of a byte in a word's hash: letters without case, white space nothing.
WEIGHT = np.where(IN_WORD, np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)) + 1,
                  0).astype(np.uint64)
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64))


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash bucket of every word of consecutive texts; a text's end ends a word."""
    inside = IN_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = inside[begins]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.arange(at[0], len(data)) - np.repeat(at, np.diff(np.append(at, len(data))))
    hashed = np.add.reduceat(WEIGHT[data[at[0]:]] * POWERS[place & 4095], at - at[0])
    hashed ^= hashed >> np.uint64(31)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    return np.searchsorted(bounds, at, "right") - 1, (hashed >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _word_counts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys row << WORD_BITS | bucket, sorted, with their counts, and by row the words that equal the one
    before.  A long text is taken piece by piece."""
    keys, counts, start = [], [], 0
    repeats = np.zeros(len(bounds) - 1)
    while start < len(data):
        end = min(start + CHUNK_BYTES, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~IN_WORD[data[end - 65536:end]])
            end = end - 65536 + int(gaps[-1]) + 1 if len(gaps) else end
        row, bucket = _words(data[start:end], np.clip(bounds - start, 0, end - start))
        key = row << WORD_BITS | bucket
        repeats += np.bincount(row[1:][key[1:] == key[:-1]], minlength=len(repeats))
        k, n = np.unique(key, return_counts=True)
        keys.append(k)
        counts.append(n)
        start = end
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), repeats
    if len(keys) == 1:
        return keys[0], counts[0], repeats
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(counts)).astype(np.int64), repeats


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(x, 0) + 1) * 0.7, BINS - 1).astype(np.int64)


def features(data: np.ndarray, bounds: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value), by row, of consecutive texts; ``stated`` holds n_chars, NaN where null."""
    rows = len(bounds) - 1
    length = np.diff(bounds)
    keys, counts, repeats = _word_counts(data, bounds)
    row, bucket = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)
    damped = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(row, damped * damped, rows))
    words = np.bincount(row, counts, rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, counts)
    kinds = np.bincount(np.repeat(np.arange(rows), length) * len(CLASSES) + KIND[data],
                        minlength=rows * len(CLASSES)).reshape(rows, len(CLASSES))
    chars = np.maximum(length, 1)
    lines = kinds[:, CLASSES.index("line_end")] + 1
    share = lambda x: np.searchsorted(SHARE_EDGES, x, "left")
    known = ~np.isnan(stated)
    bins = [share(kinds[:, i] / chars) for i in range(len(CLASSES))]
    bins += [_log_bin(length), _log_bin(words), _log_bin(8 * length / np.maximum(words, 1)), _log_bin(length / lines),
             share(np.bincount(row, minlength=rows) / np.maximum(words, 1)),
             share(repeats / np.maximum(words, 1)), share(top / np.maximum(words, 1)),
             np.where(known, np.minimum(_log_bin(np.nan_to_num(stated)), BINS - 2), BINS - 1),
             np.where(known, share(np.clip(np.nan_to_num(stated) / chars, 0, 1)), BINS - 1)]
    fixed = (1 << WORD_BITS) + np.arange(len(STATISTICS)) * BINS + np.stack(bins, 1)
    all_rows = np.concatenate([row, np.repeat(np.arange(rows), len(STATISTICS))])
    order = np.argsort(all_rows, kind="stable")
    return (all_rows[order], np.concatenate([bucket, fixed.ravel()])[order],
            np.concatenate([damped / norm[row], np.full(fixed.size, .3)])[order].astype(np.float32))


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Of each row; every row has entries."""
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        vx = self.factors[feature] * value[:, None]
        summed = np.add.reduceat(vx, starts).astype(np.float64)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.bias + np.add.reduceat(self.linear[feature] * value, starts) + .5 * ((summed * summed).sum(1) - squares)

    def probability(self, row, feature, value) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(row, feature, value), -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_factors: int = 8, epochs: int = 6,
          rate: float = .3, decay: float = 2e-5, batch: int = 32, seed: int = 7) -> FactorisationMachine:
    """Logistic loss, AdaGrad steps on small batches.  ``rows``: (feature, value) of each labelled document."""
    rng = np.random.default_rng(seed)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    fm = FactorisationMachine(float(np.log(prior / (1 - prior))), np.zeros(N_FEATURES, np.float32),
                              rng.normal(0, .05, (N_FEATURES, n_factors)).astype(np.float32))
    if len(np.unique(labels)) < 2:
        fm.factors[:] = 0
        return fm
    g_linear = np.full(N_FEATURES, 1e-2, np.float32)
    g_factors = np.full((N_FEATURES, n_factors), 1e-2, np.float32)
    g_bias = 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), batch):
            own = order[begin:begin + batch]
            sizes = [len(rows[i][0]) for i in own]
            row = np.repeat(np.arange(len(own)), sizes)
            feature = np.concatenate([rows[i][0] for i in own])
            value = np.concatenate([rows[i][1] for i in own])
            error = (fm.probability(row, feature, value) - labels[own]).astype(np.float32) / len(own)
            starts = np.append(0, np.cumsum(sizes)[:-1])
            v = fm.factors[feature]
            summed = np.add.reduceat(v * value[:, None], starts)
            step = error[row] * value
            d_factor = step[:, None] * (summed[row] - v * value[:, None])
            at = np.argsort(feature, kind="stable")
            used, cut = np.unique(feature[at], return_index=True)
            d_linear = np.add.reduceat(step[at], cut) + decay * fm.linear[used]
            d_factor = np.add.reduceat(d_factor[at], cut) + decay * fm.factors[used]
            g_linear[used] += d_linear ** 2
            g_factors[used] += d_factor ** 2
            fm.linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            fm.factors[used] -= .3 * rate * d_factor / np.sqrt(g_factors[used])
            g_bias += float(error.sum()) ** 2
            fm.bias -= rate * float(error.sum()) / g_bias ** .5
    return fm


def _stated(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stated").cast(pa.float64()).to_numpy(zero_copy_only=False)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    raw, at = text_bytes(batch.column("text"))
    stated = _stated(batch)
    for first, end in text_chunks(raw, at, CHUNK_BYTES):
        yield first, end, features(raw[at[first]:at[end]], at[first:end + 1] - at[first], stated[first:end])


def _columns(docs: DataFrame, *more: Column) -> DataFrame:
    stated = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), stated.alias("stated"), *more)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality",
        train_rows: int = 4000) -> FactorisationMachine:
    """Fit on at most ``train_rows`` labelled documents, taken in the order of a hash of their ids.

    ``learn`` is a predicate on ``doc_id`` that says which rows may be learned from."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
              .groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    # At most train_rows rows of two numbers are broadcast.
    rows = _columns(docs).join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, (row, feature, value) in _chunks(batch):
                cuts = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                yield pa.record_batch([
                    batch.column("doc_id").slice(first, end - first), batch.column("label").slice(first, end - first),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(value))], ["doc_id", "label", "feature", "value"])

    got = rows.mapInArrow(extract, f"doc_id {dict(docs.dtypes)['doc_id']}, label double, feature array<int>, value array<float>").toArrow()
    got = got.sort_by("doc_id")
    entries = [(np.asarray(f), np.asarray(v)) for f, v in zip(
        (x.values.to_numpy() for x in got.column("feature")), (x.values.to_numpy() for x in got.column("value")), strict=True)]
    return train(entries, got.column("label").to_numpy())


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = .3) -> DataFrame:
    """doc_id, score, predicted of every row, in one map."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in batches:
            out = [fm.probability(*entries) for _, _, entries in _chunks(batch)]
            p = np.round(np.concatenate(out) if out else np.empty(0), 9)
            yield pa.record_batch([batch.column("doc_id"), pa.array(p, pa.float64()),
                                   pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _columns(docs).mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int")


def accepted(docs: DataFrame, model: FactorisationMachine, threshold: float = .3) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold; the texts are never shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if "text" not in docs.columns:
        raise ValueError("documents need a text column")
    has_length = "n_chars" in docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        for batch in batches:
            n = batch.num_rows
            stated = batch.column("n_chars").cast(pa.float64()) if has_length else pa.nulls(n, pa.float64())
            own = pa.record_batch([batch.column("text"), stated], ["text", "stated"])
            out = [fm.probability(*entries) for _, _, entries in _chunks(own)]
            p = np.round(np.concatenate(out) if out else np.empty(0), 9)
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(apply, docs.schema)
