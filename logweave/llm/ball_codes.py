"""Operator 12: vector code compression by ball k-means.

Every component x becomes the integer floor(``scale`` * x); vectors are cut
into ``parts`` equal consecutive parts, and each part is coded by the index of
the nearest entry of that part's codebook (squared Euclidean distance, ties to
the lower index).  The codebooks start as the parts of the vectors of smallest
id and go through ``rounds`` of assignment and componentwise floored means.

Ball k-means: after the first round every entry is the centre of a ball, the
points that were assigned to it last, whose radius is the largest distance to
the moved centre.  By the triangle inequality

* only entries whose centres are within twice the radius are neighbours of the
  ball (``D_ij <= 2 r_i``; all other entries are farther from every point);
* a point within half the distance to the nearest neighbour is in the stable
  core and keeps its entry without any further work;
* the distances to the sorted neighbours cut the rest into rings: a point at
  distance d has to look at the neighbours with ``D_ij <= 2 d`` and no others.

All comparisons are made on squared integers (``D_ij^2 <= 4 d^2``), inclusive,
so that ties are looked at and the result equals the full search.

Plan: one map over the vectors per round, whose partial sums (at most entries
times components rows a task) are added by Spark; codebooks have a size that
does not depend on the rows and go to the tasks with the code.  Vectors are
stored once a round with their codes, so nothing is shuffled but sums.

Edge cases: rows whose vector is null or holds null or non-finite components
are dropped; a null id sorts last among the first entries, equal ids sort by
their vectors; fewer rows than entries give fewer entries; an entry that no
part uses stays as it is; null labels are one label; repeated rows are coded
each.  Vectors of different lengths, or of a length that ``parts`` does not
divide, and components beyond 2^28 after scaling (squared distances would
leave 64 bits) raise a ValueError that says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import stored

LARGEST = 1 << 28
CELLS = 1 << 20  # distances that are held at once


@dataclass
class Codebooks:
    """``entries``: part x entry x position."""
    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, label and the integer components ``v`` of the rows that are kept; other columns are not read."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(scale) * c.cast("double")))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(
        ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), F.lit(False)))
    small = F.forall("embedding", lambda c: F.abs(F.lit(scale) * c.cast("double")) < float(LARGEST))
    checked = F.when(small, x).otherwise(F.raise_error(F.lit(f"a component exceeds 2^28 after scaling by {scale}")).cast("array<bigint>"))
    return vectors.where(fine).select("vec_id", "label", checked.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if len(column) and pc.any(pc.not_equal(pc.list_value_length(column), dims)).as_py():
        raise ValueError(f"vectors must all have {dims} components")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry, by the full search."""
    index, square = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
    step = max(CELLS // max(entries.size, 1), 1)
    for begin in range(0, len(points), step):
        part = points[begin:begin + step]
        d = ((part[:, None, :] - entries) ** 2).sum(-1)
        index[begin:begin + step] = d.argmin(1)  # the first of equal ones
        square[begin:begin + step] = d[np.arange(len(part)), index[begin:begin + step]]
    return index, square


def nearest_in_balls(points: np.ndarray, entries: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same as ``nearest``, from the points' last entries; and the distances that were computed."""
    k = len(entries)
    square = ((points - entries[ball]) ** 2).sum(1)
    computed = len(points)
    radius = np.zeros(k, np.int64)
    np.maximum.at(radius, ball, square)
    between = ((entries[:, None, :] - entries) ** 2).sum(-1)
    # Neighbours of each ball, nearest first; what is beyond twice the radius is none.
    neighbour = between <= 4 * radius[:, None]
    np.fill_diagonal(neighbour, False)
    far = np.iinfo(np.int64).max
    ranked = np.argsort(np.where(neighbour, between, far), axis=1, kind="stable")
    rings = np.take_along_axis(np.where(neighbour, between, far), ranked, 1)
    index = ball.copy()
    # The ring of a point: how many neighbours may be as near as its own entry.  Core points are in ring 0.
    order = np.argsort(ball, kind="stable")
    members = np.split(order, np.searchsorted(ball[order], np.arange(1, k)))
    ring = np.zeros(len(points), np.int64)
    for i, rows in enumerate(members):
        if len(rows):
            ring[rows] = np.searchsorted(rings[i], 4 * square[rows], "right")
    active = np.flatnonzero(ring)
    step = max(CELLS // max(k * points.shape[1], 1), 1)
    for begin in range(0, len(active), step):
        rows = active[begin:begin + step]
        n = ring[rows]
        at = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(at[-1]) - np.repeat(at[:-1], n)
        tried = ranked[np.repeat(ball[rows], n), place]
        d = ((np.repeat(points[rows], n, axis=0) - entries[tried]) ** 2).sum(1)
        computed += len(d)
        best = np.minimum.reduceat(d, at[:-1])
        # of the entries at the least distance the lowest index, the own entry included
        lowest = np.minimum.reduceat(np.where(d == np.repeat(best, n), tried, k), at[:-1])
        own = square[rows]
        index[rows] = np.where(best < own, lowest, np.where(best == own, np.minimum(lowest, ball[rows]), ball[rows]))
        square[rows] = np.minimum(best, own)
    return index, square, computed


def assign(coded: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, v, codes (one index per part) and error of every row; ``coded`` may carry the last codes."""
    entries = books.entries
    parts, _, width = entries.shape
    again = "codes" in coded.columns
    kind = dict(coded.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("v"), parts * width)
            last = _matrix(batch.column("codes"), parts) if again else None
            codes, error = np.empty((len(points), parts), np.int64), np.zeros(len(points), np.int64)
            for p in range(parts):
                own = points[:, p * width:(p + 1) * width]
                found = nearest_in_balls(own, entries[p], last[:, p])[:2] if again else nearest(own, entries[p])
                codes[:, p] = found[0]
                error += found[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), batch.column("v"), lists, pa.array(error)],
                                  ["vec_id", "label", "v", "codes", "error"])

    return coded.mapInArrow(apply, f"vec_id {kind['vec_id']}, label {kind['label']}, v array<bigint>, codes array<bigint>, error long")


def moved(books: Codebooks, coded: DataFrame) -> Codebooks:
    """The codebooks whose used entries are the floored means of their parts."""
    parts, k, width = books.entries.shape

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        for batch in batches:
            points = _matrix(batch.column("v"), parts * width).reshape(-1, width)
            cell = (_matrix(batch.column("codes"), parts) + np.arange(parts) * k).ravel()
            count += np.bincount(cell, minlength=parts * k)
            for w in range(width):
                # sums in doubles are exact below 2^53; a batch has far fewer rows than 2^24
                total[:, w] += np.bincount(cell, points[:, w], parts * k).astype(np.int64)
        used = np.flatnonzero(count)
        at = np.repeat(used * width, width) + np.tile(np.arange(width), len(used))
        yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at]), pa.array(np.repeat(count[used], width))], ["at", "total", "n"])

    sums = (coded.select("v", "codes").mapInArrow(apply, "at long, total long, n long")
            .groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))
    entries = books.entries.copy().reshape(-1)
    for row in sums.collect():  # at most entries x components
        entries[row["at"]] = row["total"] // row["n"]
    return Codebooks(entries.reshape(parts, k, width))


def first_entries(vectors: DataFrame, parts: int, size: int) -> Codebooks:
    """The codebooks whose entries are the parts of the vectors of smallest id."""
    rows = [r["v"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(size).select("v").collect()]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors must all have the same number of components")
    dims = len(rows[0]) if rows else 0
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    return Codebooks(np.array(rows, np.int64).reshape(len(rows), parts, dims // parts).transpose(1, 0, 2).copy())


def compress(embeddings: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2,
             scale: float = 256.0) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes, error) of every kept row, stored, and the codebooks the codes belong to."""
    if size > 256:
        raise ValueError("a code of two hex digits holds at most 256 entries")
    vectors = whole_vectors(embeddings, scale)
    books = first_entries(vectors, parts, size)
    if not books.entries.size:  # no rows, or vectors without components
        return vectors.select("vec_id", "label", F.array_repeat(F.lit(0).cast("long"), parts).alias("codes"),
                              F.lit(0).cast("long").alias("error")), books
    for _ in range(rounds):
        vectors = stored(assign(vectors.select("vec_id", "label", "v", *(["codes"] if "codes" in vectors.columns else [])), books),
                         "ball-codes")
        books = moved(books, vectors)
    again = vectors.select("vec_id", "label", "v", *(["codes"] if "codes" in vectors.columns else []))
    return stored(assign(again, books).drop("v"), "ball-codes"), books


def digests(coded: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256."""
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
