"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logweave.llm.common import stored


def _counted(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The stored links with their number and the sum of their hashes, which are added up as they are written: a job less
    than to read them again."""
    seen = Observation()
    written = stored(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("hashes")), "links")
    return written, (seen.get["n"], seen.get["hashes"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node that can be reached.

    ``edges`` (a, b) need not be distinct or ordered; nodes without an edge are
    not returned.  Each round points every node at the smallest node it knows
    of (large star: its larger neighbours; small star: its smaller ones), so
    the number of rounds grows with the logarithm of the longest chain.  A
    node's neighbours are aggregated, never gathered, and each round is stored
    in the shared folder.  A round that leaves its links as they were is the
    last, so links that are stars already take one.  No edges give no rows.
    """
    links = (edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
             .where("v <> u").distinct())
    links, before = _counted(links)
    for _ in range(max_rounds):
        both = links.select("v", "u").unionAll(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(small_least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .unionAll(small_least.select("v", F.col("m").alias("u"))).where("v <> u").distinct())
        links, now = _counted(small)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(
        links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
