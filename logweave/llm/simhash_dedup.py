"""Operator 6: SimHash near-duplicates by deletion-variant signatures.

Fingerprint: every shingle's XXH64 votes on 64 bits; a bit is 1 if over half
the shingles have it.  Two fingerprints link at ``max_distance`` or fewer
differing bits.

Search: the bits are cut into ``max_distance // 2 + 1`` segments, so few that
of two linked fingerprints one segment differs by at most one bit.  Each
fingerprint emits every segment once per bit with that bit taken out; linked
fingerprints share one of these 64 keys.  Within a key nothing is paired with
everything: each member is compared with the key's hub (the fingerprint of
most documents), these links are joined to components, and only members of
other components than their hub's are compared with the other members, once
more cut by the same rule over the remaining bits where a key has over
``split_over`` members.  That is exact for components: a pair that is not
compared is in one component already.

Edge cases: a null text counts as empty; texts without words have fingerprint
zero and link like any other; copies are one fingerprint in all joins; a null
doc_id is never a component's smallest id unless all its members' are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logweave.llm.common import stored
from logweave.llm.components import connected_components

SEED = 42
BLOCK = 1 << 15  # shingles whose bits are summed at once


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    last = max(len(words) - shingle, 0)
    ones = np.zeros(64, np.int64)
    for begin in range(0, last + 1, BLOCK):
        hashes = np.array([digest(b" ".join(words[i:i + shingle]), SEED) for i in range(begin, min(begin + BLOCK, last + 1))],
                          "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last + 1, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text) and fingerprint (signed) of every row, in one map."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))],
                                  ["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long")


def _segments(bits: list[int], max_distance: int) -> list[list[int]]:
    return [list(map(int, s)) for s in np.array_split(bits, max_distance // 2 + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fp: Column, bits: list[int], max_distance: int) -> list[Column]:
    """Keys of ``fp``: each segment of ``bits`` with one bit out, over the numbers of the variants in the low bits."""
    keys = []
    for segment in _segments(bits, max_distance):
        whole = sum(1 << b for b in segment)
        for out in segment:
            bare = fp.bitwiseAND(F.lit(_signed(whole & ~(1 << out))))
            keys.append(F.xxhash64(F.lit(len(keys)), bare) if len(segment) > 56
                        else F.shiftleft(F.shiftrightunsigned(bare, segment[0]), 7).bitwiseOR(F.lit(len(keys)).cast("long")))
    return keys


def fingerprint_links(prints: DataFrame, max_distance: int = 4, split_over: int = 512) -> DataFrame:
    """(a, b): pairs of distinct fingerprints whose components are those of all links.

    ``prints``: distinct ``fp`` (64 bits, signed) and ``n``, its number of documents."""
    bits = list(range(64))
    members = (prints.select("fp", "n", F.explode(F.array(*_variants(F.col("fp"), bits, max_distance))).alias("key"))
               .withColumn("size", F.count("*").over(Window.partitionBy("key")))
               .withColumn("hub", F.max(F.struct("n", "fp")).over(Window.partitionBy("key"))["fp"])
               .where("size > 1"))
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_distance
    members = stored(members.select("key", "fp", "size", "hub", near(F.col("fp"), F.col("hub")).alias("linked")), "simhash-keys")
    to_hub = members.where("linked and fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))

    # Components by hubs alone.  What is left to find links members of other components than their key's hub with any
    # member, so a cloud of near copies, which its hubs hold together, is not compared with itself.
    roots = connected_components(to_hub)
    # Each pair of a member and its hub is looked up once, however many keys it shares; only keys with a member of another
    # component than the hub's go on.
    others = members.where("fp <> hub and size > 2")
    apart = (others.where("not linked").select("fp", "hub").distinct()
             .join(roots.select(F.col("node").alias("fp"), F.col("root").alias("own")), "fp", "left")
             .join(roots.select(F.col("node").alias("hub"), F.col("root").alias("of_hub")), "hub", "left")
             .withColumn("own", F.coalesce("own", "fp")).where(F.col("own") != F.coalesce("of_hub", "hub")).select("fp", "hub", "own"))
    apart = stored(apart, "simhash-apart")
    open_keys = others.where("not linked").join(apart, ["fp", "hub"]).select("key").distinct()
    others = (others.join(open_keys, "key", "left_semi").join(apart, ["fp", "hub"], "left")
              .select("key", "fp", "size", "own", F.col("own").isNull().alias("by_hub")))
    segments = _segments(bits, max_distance)
    place = F.col("key").bitwiseAND(F.lit(127))
    again, below = F.array(F.lit(-1).cast("long")), 0
    for segment in segments:  # a large key is cut again
        rest = [b for b in bits if b not in segment]
        again = F.when((F.col("size") > split_over) & place.between(below, below + len(segment) - 1),
                       F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m))))
                                 for i, m in enumerate(_masks(rest, max_distance))])).otherwise(again)
        below += len(segment)
    others = others.select("key", "fp", "own", "by_hub", F.explode(again).alias("inner"))
    far = others.where("not by_hub").select("key", "inner", F.col("fp").alias("a"), F.col("own").alias("root_a"))
    rest = others.select("key", "inner", F.col("fp").alias("b"), F.col("own").alias("root_b"), "by_hub")
    pairs = far.join(rest, ["key", "inner"]).where(
        near(F.col("a"), F.col("b")) & (F.col("by_hub") | (F.col("root_a") != F.col("root_b")) & (F.col("a") < F.col("b"))))
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(
        pairs.select("a", "b")).distinct()


def _masks(bits: list[int], max_distance: int) -> list[int]:
    return [sum(1 << b for b in segment if b != out) for segment in _segments(bits, max_distance) for out in segment]


def _rooted(rows: DataFrame, least: Column, max_distance: int) -> DataFrame:
    """fp, least (the smallest ``least`` of its rows) and root (the component's smallest fingerprint) of every fingerprint."""
    prints = rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(least).alias("least"))
    roots = connected_components(fingerprint_links(prints, max_distance))
    return (prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """doc_id, text_hash, fp, root (the component's smallest fingerprint) and component_id (smallest doc_id reachable)."""
    rows = stored(fingerprints(docs, shingle), "simhash")
    grouped = _rooted(rows, F.col("doc_id"), max_distance)
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(grouped.select("fp", "root").join(smallest, "root"), "fp").select(
        "doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """The rows, with all their columns, that stay: of each component the one with the smallest (doc_id, text hash);
    a row without an id only where all its component's rows have none."""
    rows = stored(fingerprints(docs, shingle), "simhash")
    # The smallest row of a component is that of its fingerprints' smallest rows.
    grouped = _rooted(rows, F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"), max_distance)
    keep = (grouped.groupBy("root").agg(F.min("least").alias("kept"))
            .select(F.col("kept.doc_id").alias("__id"), F.col("kept.text_hash").alias("__text")))
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    kept = marked.join(keep, marked["doc_id"].eqNullSafe(keep["__id"]) & (marked["__hash"] == keep["__text"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__hash"]).drop("__hash")
