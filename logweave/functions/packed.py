"""Timestamp texts as two whole numbers, so that hash aggregates can hold them.

Spark's hash aggregate keeps fixed-width buffers only; a first or last *text*
per group turns it into a sort of all rows.  Timestamps of log lines have a
known shape, ``yyyy-MM-dd`` (blank or ``T``) ``HH:mm:ss`` and up to 17 digits
of a fraction after ``,`` or ``.``: their date and time of day with a code of
the two signs, and their fraction behind a 1 (which keeps leading zeros), are
two longs, and the text can be read back exactly.  A text of any other shape
has no numbers; aggregates keep it as one more grouping key (``odd``), so
it forms a small group of its own and nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import sql_str

# Fixed value: the shape that is packed (ASCII digits only).
PACKED_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]{1,17})?$"


def packable(ts: str) -> Column:
    return F.expr(f"coalesce({ts} RLIKE {sql_str(PACKED_SHAPE)}, false)")


def odd(ts: str) -> Column:
    """The text itself where it cannot be packed, else null."""
    return F.expr(f"CASE WHEN NOT {ts} RLIKE {sql_str(PACKED_SHAPE)} THEN {ts} END")


def pack_time(ts: str) -> Column:
    """Date, time of day and signs; null for null and odd texts."""
    return F.expr(
        f"CASE WHEN {ts} RLIKE {sql_str(PACKED_SHAPE)} THEN CAST(translate(substr({ts}, 1, 19), '-: T', '') AS BIGINT) * 8 "
        f"+ CASE WHEN substr({ts}, 11, 1) = 'T' THEN 4 ELSE 0 END "
        f"+ CASE substr({ts}, 20, 1) WHEN ',' THEN 1 WHEN '.' THEN 2 ELSE 0 END END")


def pack_fraction(ts: str) -> Column:
    """The digits of the fraction behind a 1; 1 without a fraction; null for null and odd texts."""
    return F.expr(f"CASE WHEN {ts} RLIKE {sql_str(PACKED_SHAPE)} THEN CAST(concat('1', substr({ts}, 21)) AS BIGINT) END")


def unpack(time: str, fraction: str) -> Column:
    """The text that ``pack_time`` and ``pack_fraction`` came from."""
    d = f"lpad(CAST({time} DIV 8 AS STRING), 14, '0')"
    part = lambda at, n: f"substr({d}, {at}, {n})"
    return F.expr(
        f"concat({part(1, 4)}, '-', {part(5, 2)}, '-', {part(7, 2)}, CASE WHEN {time} % 8 >= 4 THEN 'T' ELSE ' ' END, "
        f"{part(9, 2)}, ':', {part(11, 2)}, ':', {part(13, 2)}, CASE {time} % 4 WHEN 1 THEN ',' WHEN 2 THEN '.' ELSE '' END, "
        f"substr(CAST({fraction} AS STRING), 2))")


def first_and_last(rows: DataFrame, keys: list[str], ts: str, order: str, counts: dict[str, Column]) -> DataFrame:
    """By ``keys`` and odd texts: ``counts``, ``first_at`` and ``last_at`` (least and greatest non-null ``order``, a long) and the
    texts ``ts`` of these rows, ``first_ts`` and ``last_ts`` (null texts count), in one hash aggregate.

    A key has several rows if it holds odd texts: callers add the few rows up (``min_by`` over ``first_at`` and so on)."""
    packed = rows.withColumn("_odd", odd(ts)).withColumn("_t", pack_time(ts)).withColumn("_f", pack_fraction(ts))
    found = packed.groupBy(*keys, "_odd").agg(
        *(c.alias(name) for name, c in counts.items()), F.min(order).alias("first_at"), F.max(order).alias("last_at"),
        F.min_by("_t", order).alias("_t0"), F.min_by("_f", order).alias("_f0"),
        F.max_by("_t", order).alias("_t1"), F.max_by("_f", order).alias("_f1"))
    return found.select(*keys, *counts, "first_at", "last_at", F.coalesce("_odd", unpack("_t0", "_f0")).alias("first_ts"),
                        F.coalesce("_odd", unpack("_t1", "_f1")).alias("last_ts"))
