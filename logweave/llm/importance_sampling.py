"""Operator 11: target-distribution importance resampling.

A text's features are its runs of 1 to ``longest`` consecutive words (A-Z
lower-cased, a word is a run of digits, a-z and whatever is not ASCII, words
joined by one space); a feature's bucket is the CRC-32 of its UTF-8 bytes
modulo ``buckets``.  The buckets' counts over all source and all target texts
give each bucket a gain, a text's weight is the floored mean of its features'
gains, and Gumbel noise that is fixed by the id turns the highest scores into
a draw without replacement.

CRCs by length-bucketed matrices: the distinct features of a piece of a batch
are grouped by their equal number of bytes into uint8 matrices of two
dimensions, all CRCs of a matrix are updated column by column, and the buckets
are scattered back to the features' places.

Plan: one map over the texts gives partial counts by bucket (at most
``buckets`` rows a task), a second one the weights; the gains that the second
map carries have ``buckets`` rows whatever the input.  The draw needs a count
of documents by score, which are integers in a narrow range, and then sorts
only the documents at or above the last drawn score, by ranges of (score,
doc_id), so that no window or task holds a hot score.

Edge cases: a null or empty text has no features, weight 0 and is never drawn
(unless ``least_words`` is 0); a null doc_id takes the noise of an empty id
and loses ties; repeated rows are separate documents, equal ones in any order;
an empty source or target table counts 0 features; extra columns are not read.
A text is processed whole; it is the largest unit a task holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import stored, text_bytes, text_chunks

CHUNK_BYTES = 2 << 20
MATRIX_BYTES = 1 << 20
LONG = 4096  # bytes from which a feature is too long for a matrix of many rows: its CRC is taken by itself

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()


def crc32_by_length(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32 of every feature ``data[offsets[i]:offsets[i + 1]]``, matrix by matrix of features of one length."""
    lengths = np.diff(offsets)
    found = np.zeros(len(lengths), np.uint32)
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        length = int(lengths[rows[0]]) if len(rows) else 0
        if length > LONG:
            found[rows] = [zlib.crc32(data[offsets[i]:offsets[i] + length]) for i in rows]
            continue
        step = MATRIX_BYTES // max(length, 1)
        for begin in range(0, len(rows), step):
            part = rows[begin:begin + step]
            matrix = data[offsets[part] + np.arange(length)[:, None]]  # one row per byte place
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in matrix:
                crc = CRC_TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
            found[part] = crc ^ np.uint32(0xFFFFFFFF)
    return found


def _pieces(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces one after the other, and their offsets."""
    offsets = np.concatenate([[0], np.cumsum(length)])
    return data[np.repeat(begin - offsets[:-1], length) + np.arange(offsets[-1])], offsets


def hashed_features(data: np.ndarray, bounds: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive texts: row and bucket of every feature, and the words of every row."""
    rows = len(bounds) - 1
    data = LOWER[data]
    inside = IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts, ends = bounds[:-1][bounds[:-1] < len(data)], bounds[1:][bounds[1:] > 0] - 1
    first[starts] = inside[starts]  # a text's edge is a word's edge
    last[ends] = inside[ends]
    begin = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - begin
    row = np.searchsorted(bounds, begin, "right") - 1
    n_words = np.bincount(row, minlength=rows)
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.int64), n_words
    # the words joined by one space each: a run of words is one piece of it
    joined = np.full(int(length.sum()) + len(begin), 32, np.uint8)
    joined[np.flatnonzero(inside) - np.repeat(begin, length) + np.repeat(np.cumsum(length + 1) - length - 1, length)] = data[inside]
    begin = np.cumsum(length + 1) - length - 1
    end = begin + length
    all_rows, all_buckets = [], []
    for n in range(1, longest + 1):
        heads = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:])
        if not len(heads):
            break
        pieces, offsets = _pieces(joined, begin[heads], end[heads + n - 1] - begin[heads])
        features = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [
            None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(pieces)]).dictionary_encode()
        _, at, distinct = features.dictionary.buffers()
        at = np.frombuffer(at, np.int64)[:len(features.dictionary) + 1]
        crc = crc32_by_length(np.frombuffer(distinct, np.uint8), at)
        all_rows.append(row[heads])
        all_buckets.append((crc % np.uint32(buckets)).astype(np.int64)[features.indices.to_numpy()])
    return np.concatenate(all_rows), np.concatenate(all_buckets), n_words


def _batches(column: pa.Array, longest: int, buckets: int):
    """(first row, end row, feature rows, feature buckets, words) of the pieces of a batch."""
    raw, at = text_bytes(column)
    for first, end in text_chunks(raw, at, CHUNK_BYTES):
        yield first, end, *hashed_features(raw[at[first]:at[end]], at[first:end + 1] - at[first], longest, buckets)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = 10000) -> DataFrame:
    """(bucket, n): the features of all texts."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, bucket, _ in _batches(batch.column(0), longest, buckets):
                counts += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], ["bucket", "n"])

    partial = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(apply, "bucket long, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10000) -> DataFrame:
    """(bucket, gain) of all buckets: floored thousandths of the log ratio of the smoothed target and source shares."""
    both = (source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
            .unionAll(target.select("bucket", F.lit(0).cast("long"), "n"))
            .unionAll(source.sparkSession.range(buckets).select("id", F.lit(0).cast("long"), F.lit(0).cast("long"))))
    counts = stored(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "resample-buckets")
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * F.lit(float(all_s + buckets)) / ((s + 1) * F.lit(float(all_t + buckets)))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gains: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    buckets = len(gains)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, end, row, bucket, words in _batches(batch.column("text"), longest, buckets):
                n = np.bincount(row, minlength=end - first)
                total = np.bincount(row, gains[bucket], end - first).astype(np.int64)  # whole numbers, exact in doubles
                n_words[first:end], n_features[first:end], weight[first:end] = words, n, total // np.maximum(n, 1)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight))],
                                  ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        apply, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of the Gumbel noise of an id: its uniform number is the head of a SHA-256."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """``rows`` numbered from 1 in a total order, without a window over all of them: ranges of the order are sorted and
    stored with their rows' places, and a range's rows come after those of the ranges before it."""
    placed = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("__range"),
                F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")), "resample-ranges")
    # A count per range, as many as shuffle partitions; one literal holds the counts before each, however often ranks are read.
    sizes = {r["__range"]: r["n"] for r in placed.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    before, counts = 0, []
    for i in range(max(sizes, default=0) + 1):
        counts.append(before)
        before += sizes.get(i, 0)
    known = F.split(F.lit(",".join(map(str, counts))), ",").cast("array<long>")
    return placed.withColumn(rank, F.get(known, F.col("__range")) + F.col("__place") + 1).drop("__range", "__place")


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """``rank`` of the highest scores of the documents that have ``least_words``; null for those not drawn."""
    eligible = F.col("n_words") >= least_words
    # Scores are integers of a narrow range (floored thousandths of logarithms), so this table is small at any size.
    by_score = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    cut = (by_score.select("score", F.sum("n").over(down).alias("reached"), F.floor(
               F.sum("n").over(everything) * percent / 100).alias("drawn"))
           .where("reached >= drawn and drawn > 0").groupBy("drawn").agg(F.max("score").alias("score")).first())
    none = F.lit(None).cast("long")
    if cut is None:
        return scored.withColumn("rank", none)
    high = eligible & (F.col("score") >= cut["score"])
    first = ranked(scored.where(high), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(),
                                        F.col("weight").asc()], "rank")
    return (first.withColumn("rank", F.when(F.col("rank") <= cut["drawn"], F.col("rank")))
            .unionByName(scored.where(~high).withColumn("rank", none)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1,
             buckets: int = 10000, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document of ``docs``; ``target`` has a ``text``."""
    table = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    gains = np.zeros(buckets, np.int64)
    for row in table.collect():  # as many rows as buckets
        gains[row["bucket"]] = row["gain"]
    scored = weights(docs, gains, longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return draw(stored(scored, "resample-scores"), percent, least_words)
