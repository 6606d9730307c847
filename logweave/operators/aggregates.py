"""Entry aggregations.

All are ``groupBy`` aggregations with map-side partial aggregation, so a key
holding a third of all entries is pre-aggregated inside every map task and
only one partial row per task reaches the shuffle.  "First"/"last" are taken
in file order with ``min_by``/``max_by`` on ``line_number`` (never a window),
over timestamps packed into numbers (``functions.packed``), so that entries go
through hash aggregates and are never sorted.
Everything is per log file, as in the reference, unless ``per_file=False``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.packed import first_and_last
from logweave.operators.filters import ERROR_LEVELS
from logweave.operators.parse import header_entries, stack_entries

# Accepted group keys.
GROUP_KEYS = ("level", "component", "logger", "tenant", "correlationId")
TOP_COMPONENTS = 20
UNKNOWN = "unknown"


def _nz(c: Column) -> Column:
    """Null for null or empty text (Python truthiness of a str)."""
    return F.when(c != "", c)


def group_key(by: str) -> Column:
    if by == "level":
        return F.col("level")
    if by == "component":
        return F.coalesce(_nz(F.col("logger_short")), _nz(F.col("logger")), F.lit(UNKNOWN))
    if by == "logger":
        return F.coalesce(_nz(F.col("logger")), F.lit(UNKNOWN))
    if by == "tenant":
        return F.coalesce(_nz(F.col("tenant_domain")), F.lit(UNKNOWN))
    if by == "correlationId":
        return F.coalesce(_nz(F.col("correlation_id")), F.lit(UNKNOWN))
    raise ValueError(f"group_by must be one of {set(GROUP_KEYS)}")


def _scope(per_file: bool) -> list[str]:
    return ["file_path"] if per_file else []


def level_counts(entries: DataFrame, per_file: bool = True) -> DataFrame:
    """A1: entries per level."""
    return entries.groupBy(*_scope(per_file), "level").agg(F.count(F.lit(1)).alias("count"))


def component_counts(entries: DataFrame, per_file: bool = True) -> DataFrame:
    """A2: entries per non-empty ``logger_short`` with the first appearance."""
    counts = (entries.where(F.col("logger_short") != "")
              .groupBy("file_path", F.col("logger_short").alias("component"))
              .agg(F.count(F.lit(1)).alias("count"), F.min("line_number").alias("first_seen_at")))
    if per_file:
        return counts
    return counts.groupBy("component").agg(F.sum("count").alias("count"),
                                           F.min(F.struct("file_path", F.col("first_seen_at").alias("line_number"))).alias("first_seen_at"))


def top_components(entries: DataFrame, n: int = TOP_COMPONENTS, per_file: bool = True,
                   buckets: int = 64) -> DataFrame:
    """A2/L3: the ``n`` most frequent components, ties by first appearance.

    Two-stage top-k so no window holds all components of a file: first the
    best ``n`` inside ``(file, hash bucket of component)``, then the best
    ``n`` among those ``buckets * n`` candidates per file.
    """
    counts = component_counts(entries, per_file).withColumn(
        "_b", F.pmod(F.hash("component"), F.lit(buckets)))
    best = [F.col("count").desc(), F.col("first_seen_at")]
    w1 = Window.partitionBy(*_scope(per_file), "_b").orderBy(*best)
    cand = counts.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)
    w2 = Window.partitionBy(*_scope(per_file)).orderBy(*best)
    return (cand.withColumn("rank", F.row_number().over(w2))
            .where(F.col("rank") <= n).drop("first_seen_at", "_b", "_r"))


def summary(entries: DataFrame) -> DataFrame:
    """A3-A5: per file: total entries, first/last non-empty timestamp in file
    order, entries with a stack trace, and the level counts as a map.

    One pass over the entries grouped by (file, level), a hash aggregate over
    packed timestamps (partial aggregation bounds a hot level), then a small
    second aggregation per file."""
    rows = entries.select("file_path", "level", "timestamp", "has_stack_trace",
                          F.when(F.col("timestamp") != "", F.col("line_number")).alias("_ln"))
    per_level = first_and_last(rows, ["file_path", "level"], "timestamp", "_ln", {
        "n": F.count(F.lit(1)), "stacks": F.count_if(F.col("has_stack_trace"))})
    per_level = per_level.groupBy("file_path", "level").agg(
        F.sum("n").alias("n"), F.sum("stacks").alias("stacks"), F.min_by("first_ts", "first_at").alias("first_ts"),
        F.min("first_at").alias("first_at"), F.max_by("last_ts", "last_at").alias("last_ts"), F.max("last_at").alias("last_at"))
    return per_level.groupBy("file_path").agg(
        F.sum("n").alias("total_entries"),
        F.min_by("first_ts", "first_at").alias("first_timestamp"),
        F.max_by("last_ts", "last_at").alias("last_timestamp"),
        F.sum("stacks").alias("has_stack_traces"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("level_counts"),
    )


def summary_of_lines(lines: DataFrame, **parse_kw) -> DataFrame:
    """A3-A5 straight from lines, equal to ``summary(parse_entries(lines))``:
    header lines give all but the stack traces, and those need only which
    entries have one.  No text is shuffled."""
    heads = summary(header_entries(lines, **parse_kw).withColumn("has_stack_trace", F.lit(False)))
    stacks = stack_entries(lines, **parse_kw).groupBy("file_path").agg(F.count(F.lit(1)).alias("_stacks"))
    return (heads.join(stacks, "file_path", "left")
            .withColumn("has_stack_traces", F.coalesce("_stacks", F.lit(0).cast("long"))).drop("_stacks"))


def _grouped(rows: DataFrame, keys: list[str], per_file: bool) -> DataFrame:
    """A6 by ``keys``: a hash aggregate by file and key over all rows, then the files' (and odd timestamps') few rows of
    each key are added up in file order."""
    found = first_and_last(rows, ["file_path", *keys], "timestamp", "line_number", {
        "n": F.count(F.lit(1)), "errors": F.count_if(F.col("level").isin(ERROR_LEVELS))})
    at = (lambda c: F.col(c)) if per_file else (lambda c: F.struct("file_path", F.col(c).alias("line_number")))
    return found.groupBy(*_scope(per_file), *keys).agg(
        F.sum("n").alias("count"),
        F.min_by("first_ts", at("first_at")).alias("first_seen"),
        F.max_by("last_ts", at("last_at")).alias("last_seen"),
        F.sum("errors").alias("error_count"),
        F.min(at("first_at")).alias("first_at"),
    )


def group_entries(entries: DataFrame, by: str, per_file: bool = True) -> DataFrame:
    """Count, first/last timestamp (file order, may be null) and error
    count per group key.  ``first_at`` (the first appearance) is kept so that
    ``ordered_groups`` can sort by count desc, then first appearance."""
    rows = entries.select("file_path", "line_number", "timestamp", "level", group_key(by).alias("key"))
    return _grouped(rows, ["key"], per_file)


def ordered_groups(groups: DataFrame, per_file: bool = True) -> DataFrame:
    """The reference's group order (a range-partitioned global sort)."""
    return groups.orderBy(*_scope(per_file), F.col("count").desc(), F.col("first_at"))


def group_entries_multi(entries: DataFrame, bys=GROUP_KEYS, per_file: bool = True) -> DataFrame:
    """A6 for several group keys in one pass: each entry becomes one row per
    key (``group_by``, ``key``) ahead of a single aggregation (one scan, one
    shuffle, partial aggregation per key), instead of one job per key.  Rows
    equal ``group_entries(entries, by)`` with a ``group_by`` column added."""
    keyed = F.explode(F.array(*[F.struct(F.lit(by).alias("group_by"), group_key(by).alias("key"))
                                for by in bys])).alias("g")
    x = entries.select("file_path", "line_number", "timestamp", "level", keyed).select("*", "g.group_by", "g.key").drop("g")
    return _grouped(x, ["group_by", "key"], per_file)
