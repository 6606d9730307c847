"""Running values in file order without a window over a whole file.

One file (or one user, or one key) may hold a large share of all rows, so a
window partitioned by file alone would put it in one task.  The helpers here
cut every ordered sequence into fixed-size chunks:

1. inside a chunk, a window partitioned by ``(keys, chunk)`` gives the running
   value (the chunk bounds the window's size);
2. per chunk, one aggregated row is produced straight from the input by a
   partial aggregation (a second, cheap pass: only the key, chunk and value
   columns are computed; the rest of the input is pruned away);
3. a window over those chunk rows (one row per chunk, not per line) gives the
   value carried in from earlier chunks;
4. the carry table is joined back on ``(keys, chunk)``.  It has one row per
   chunk, and AQE turns the join into a broadcast when its runtime size is
   under the broadcast threshold; otherwise it is a shuffle join that reuses
   the ``(keys, chunk)`` partitioning of step 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CARRY = "_carry"
IN_CHUNK = "_in_chunk"


def chunked_running(df: DataFrame, keys: list[str], chunk: str, order: str, value: str,
                    how: str, out: str, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = running ``sum`` or ``max`` of ``value`` over rows of the same
    ``keys`` ordered by ``order`` (rows of lower ``chunk`` come first).

    ``inclusive`` counts the current row (``max`` is always inclusive).
    ``max`` ignores nulls; ``sum`` needs non-negative values (null counts as
    0).  ``chunk`` must be a non-decreasing function of ``order`` inside a key.
    """
    if how not in ("sum", "max"):
        raise ValueError("how must be 'sum' or 'max'")
    if how == "max" and not inclusive:
        raise ValueError("an exclusive running max is not supported")
    agg = F.sum if how == "sum" else F.max
    v = F.col(value) if how == "max" else F.coalesce(F.col(value), F.lit(0))
    w_in = (Window.partitionBy(*keys, chunk).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    with_in = df.withColumn(IN_CHUNK, agg(v).over(w_in))

    totals = df.groupBy(*keys, chunk).agg(agg(v).alias("_chunk_total"))
    w_carry = (Window.partitionBy(*keys).orderBy(chunk)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*keys, chunk, agg("_chunk_total").over(w_carry).alias(CARRY))

    joined = with_in.join(carry, on=[*keys, chunk], how="left")
    if how == "sum":
        res = F.coalesce(F.col(CARRY), F.lit(0)) + F.col(IN_CHUNK)
        if not inclusive:
            res = res - v
    else:
        res = F.greatest(F.col(CARRY), F.col(IN_CHUNK))
    return joined.withColumn(out, res).drop(CARRY, IN_CHUNK)


def running_total(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Add ``out`` = the sum of ``value`` over the rows before this one in ``order`` (a list of columns that orders all rows),
    over the whole table: ranges of the order are sorted, and a range's rows come after the totals of the ranges before it.

    Eager: the sorted ranges are stored first.  The only window over several ranges has one row per range."""
    from logweave.sources.sinks import materialize

    ranges = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = totals.select("_range", F.coalesce(F.sum("_total").over(
        Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranges.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(before, "_range")
            .withColumn(out, F.col("_inside") + F.col("_earlier")).drop("_range", "_inside", "_earlier"))
