"""Operator 9: exact top-k search by inner product, with block-at-a-time pruning.

Vectors become integers, floor(scale * x).  Similar vectors (by their largest
components) are put side by side and cut into blocks of at most ``block_rows``
rows: a forward index (the block's matrix in its smallest integer type) and,
per term (component), the block's maximum and minimum.  Queries are packed the
same way.  A query's bound for a block is the sum over the terms of the most
that the block's extremes allow.

Round 1 scores each query's ``seeds`` best blocks by bound and so finds a first
k-th score.  Round 2 sends each pack of queries the blocks whose bound still
reaches it, in descending order of bound, scores them through the forward
index, raises the k-th score as it goes, and leaves out every query whose bound
has fallen below.  A bound equal to the k-th score is left out only if the
block has no smaller vec_id.  Queries against all rows, in blocks; blocks and
packs meet by equality joins on their numbers.

Edge cases: vectors that are null or hold a null or a value that isn't finite
take no part, nor do rows without a vec_id; shorter vectors count as padded
with zeros; a query's own rows (equal vec_id) are no candidates, and a vec_id
with several rows is one query, its smallest vector; repeated candidates are
candidates each; fewer candidates than k are all returned; scores beyond
64 bits are held at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logweave.llm.common import stored

PACK = "no long, ids array<long>, kind string, matrix binary, high binary, low binary, least long"
LIMIT = np.iinfo(np.int64)


def _valid(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)


def _packed(rows: DataFrame, dims: int, scale: float, size: int, place: list[str]) -> DataFrame:
    """Rows side by side by their two largest components, packed ``size`` at a time."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                vectors = part.column("embedding")
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                whole = np.zeros((part.num_rows, dims))
                whole[np.arange(dims) < lengths[:, None]] = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False))
                top = np.abs(whole).max(initial=0)
                kind = next((k for k in ("i1", "i2", "i4") if top <= np.iinfo(k).max), "f8")
                ids = part.column("vec_id")
                yield pa.record_batch([
                    pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([kind]),
                    pa.array([whole.astype(kind).tobytes()], pa.binary()), pa.array([whole.max(0).tobytes()], pa.binary()),
                    pa.array([whole.min(0).tobytes()], pa.binary()), pa.array([pa.compute.min(ids).as_py()], pa.int64())],
                    ["no", "ids", "kind", "matrix", "high", "low", "least"])
                number += 1

    size_of = F.transform("embedding", F.abs)
    first = F.array_position(size_of, F.array_max(size_of))
    rest = F.transform(size_of, lambda x, i: F.when(i + 1 == F.col("top"), F.lit(0.0)).otherwise(x))
    keyed = (rows.withColumn("top", first).withColumn("next", F.array_position(rest, F.array_max(rest)))
             .withColumn("sign", F.get("embedding", F.col("top").cast("int") - 1) > 0)
             .withColumn("sign2", F.get("embedding", F.col("next").cast("int") - 1) > 0))
    order = ["top", "sign", "next", "sign2", "vec_id"]
    near = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "embedding")
    return near.mapInArrow(pack, PACK)


def _matrix(kind: str, raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, dims).astype(np.float64)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as int64."""
    if queries.shape[1] * np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) < 2 ** 53:
        return (queries @ rows.T).astype(np.int64)
    ints = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(ints(queries) @ ints(rows).T, LIMIT.min, LIMIT.max).astype(np.int64)


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each query for each block; a little over the exact sums, which rounding can't pass."""
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return np.where(np.abs(bound) < 2.0 ** 52, bound, bound + np.abs(bound) * 1e-9)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[scores >= cut], ids[scores >= cut]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


FOUND = "query_id long, vec_id long, score long"


def _score(pairs: DataFrame, dims: int, k: int) -> DataFrame:
    """Scores pairs of a pack and a block, which come with the queries' places in the pack, their bounds and the k-th
    score and id known so far (or null); emits what can be among the k best."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, queries, kth = None, None, {}
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {c: batch.column(c)[k_row] for c in batch.schema.names}
                if row["pack"].as_py() != pack:
                    pack, kth = row["pack"].as_py(), {}
                    queries = _matrix(row["q_kind"].as_py(), row["q_matrix"].as_py(), dims)
                    q_ids = row["q_ids"].values.to_numpy()
                ids = row["ids"].values.to_numpy()
                open_at = []
                for at, bound, score, least in zip(row["at"].as_py(), row["bound"].as_py(), row["kth"].as_py(), row["kth_id"].as_py(),
                                                   strict=True):
                    if at not in kth:
                        kth[at] = (np.empty(0, np.int64), np.empty(0, np.int64), score, least)
                    limit, limit_id = kth[at][2:]
                    if limit is None or bound > limit or bound == limit and row["least"].as_py() < limit_id:
                        open_at.append(at)
                if not open_at:
                    continue
                got = products(queries[open_at], _matrix(row["kind"].as_py(), row["matrix"].as_py(), dims))
                out_q, out_v, out_s = [], [], []
                for at, scores in zip(open_at, got, strict=True):
                    old_s, old_v, limit, limit_id = kth[at]
                    may = ids != q_ids[at]
                    if limit is not None:
                        may &= (scores > limit) | (scores == limit) & (ids < limit_id)
                    if not may.any():
                        continue
                    new_s, new_v = _best(scores[may], ids[may], k)
                    all_s, all_v = _best(np.append(old_s, new_s), np.append(old_v, new_v), k)
                    if len(all_s) == k and (limit is None or (all_s[-1], -all_v[-1]) > (limit, -limit_id)):
                        limit, limit_id = int(all_s[-1]), int(all_v[-1])
                    kth[at] = (all_s, all_v, limit, limit_id)
                    out_q.append(np.full(len(new_s), q_ids[at]))
                    out_v.append(new_v)
                    out_s.append(new_s)
                if out_q:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    columns = ["pack", "q_ids", "q_kind", "q_matrix", "ids", "kind", "matrix", "least", "at", "bound", "kth", "kth_id"]
    near = pairs.repartition("pack").sortWithinPartitions(F.col("pack"), F.array_max("bound").desc())
    return near.select(columns).mapInArrow(apply, FOUND)


def _pairs(packs: DataFrame, summaries: DataFrame, dims: int, seeds: int, rest: bool) -> DataFrame:
    """(pack, no, at, bound, kth, kth_id): the queries of a pack that a block is for.  The first round takes each
    query's ``seeds`` blocks of the largest bounds, the other round all others that may reach the k-th score."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks = sorted(row["blocks"], key=lambda b: b["no"])
                extreme = [np.stack([np.frombuffer(b[c]) for b in blocks]) for c in ("high", "low")]
                bound = _bounds(_matrix(row["q_kind"], row["q_matrix"], dims), *extreme)
                seed = np.zeros(bound.shape, bool)
                np.put_along_axis(seed, np.argsort(-bound, 1, kind="stable")[:, :seeds], True, 1)
                if rest:
                    known = np.array([x is not None for x in row["kth"]])
                    score = np.array([x or 0 for x in row["kth"]], np.float64)[:, None]
                    ids = np.array([x or 0 for x in row["kth_id"]], np.int64)[:, None]
                    least = np.array([b["least"] for b in blocks])
                    take = ~seed & (~known[:, None] | (bound > score) | (bound == score) & (least < ids))
                else:
                    take = seed
                for b in np.flatnonzero(take.any(0)):
                    at = np.flatnonzero(take[:, b])
                    yield pa.record_batch([
                        pa.array([row["pack"]], pa.int64()), pa.array([blocks[b]["no"]], pa.int64()), pa.array([at], pa.list_(pa.int32())),
                        pa.array([bound[at, b]], pa.list_(pa.float64())), pa.array([[row["kth"][i] for i in at]], pa.list_(pa.int64())),
                        pa.array([[row["kth_id"][i] for i in at]], pa.list_(pa.int64()))], ["pack", "no", "at", "bound", "kth", "kth_id"])

    met = packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(summaries, "part")
    return met.select("pack", "q_kind", "q_matrix", "kth", "kth_id", "blocks").mapInArrow(
        apply, "pack long, no long, at array<int>, bound array<double>, kth array<long>, kth_id array<long>")


def top_k(vectors: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20, block_rows: int = 256, pack_rows: int = 64,
          seeds: int = 3, summary_rows: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows of every query: the ids divisible by ``every``."""
    rows = _valid(vectors)
    sizes = rows.agg(F.max(F.size("embedding")), F.count("*")).first()
    dims = max(sizes[0] or 0, 1)
    blocks = stored(_packed(rows, dims, scale, block_rows, []), "topk-blocks")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    packs = stored(_packed(queries, dims, scale, pack_rows, []), "topk-queries").select(
        F.col("no").alias("pack"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("matrix").alias("q_matrix"))
    parts = max(-(-sizes[1] // (block_rows * summary_rows)), 1)
    summaries = (blocks.select(F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int").alias("part"), F.struct("no", "high", "low", "least").alias("b"))
                 .groupBy("part").agg(F.collect_list("b").alias("blocks")))  # about summary_rows of them, or a few more
    packs = packs.withColumn("parts", F.lit(int(parts)))
    nothing = F.transform("q_ids", lambda _: F.lit(None).cast("long"))
    whole = lambda pairs: pairs.join(packs.select("pack", "q_ids", "q_kind", "q_matrix"), "pack").join(
        blocks.select("no", "ids", "kind", "matrix", "least"), "no")
    first = stored(_score(whole(_pairs(packs.withColumn("kth", nothing).withColumn("kth_id", nothing), summaries, dims, seeds, False)),
                          dims, k), "topk-first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    limits = (first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
              .select("query_id", F.struct(F.col("score").alias("kth"), F.col("vec_id").alias("kth_id")).alias("limit")))
    by_pack = (packs.select("pack", F.posexplode("q_ids").alias("at", "query_id")).join(limits, "query_id", "left")
               .groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("at", "limit"))).alias("l"))
               .select("pack", F.transform("l", lambda x: x["limit"]["kth"]).alias("kth"), F.transform("l", lambda x: x["limit"]["kth_id"]).alias("kth_id")))
    second = _score(whole(_pairs(packs.join(by_pack, "pack"), summaries, dims, seeds, True)), dims, k)
    both = first.unionAll(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
