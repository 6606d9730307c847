"""Column-level helpers (all JVM-side built-ins, no UDFs).

Log text follows Python ``str`` rules in the reference: ``strip()`` removes
Unicode whitespace, ``\\w``/``\\s``/``\\d`` are Unicode classes.  Spark's
``trim`` removes only spaces and Java regex classes are ASCII unless ``(?U)``
is set, so these helpers restore the Python meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, i.e. what
# str.strip() removes (tab, LF, VT, FF, CR, FS, GS, RS, US, space, NEL, NBSP,
# OGHAM SPACE MARK, U+2000..U+200A, LINE SEP, PARAGRAPH SEP, NNBSP, MMSP,
# IDEOGRAPHIC SPACE).
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


# Fixed value: the shape a timestamp must have for epoch millis to exist
# (date, space, time, 1-6 fraction digits after ',' or '.').
TS_MS_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{1,6}$"


def sql_timestamp_ms(expr: str) -> str:
    """SQL text: epoch milliseconds of a ``yyyy-MM-dd HH:mm:ss,fff`` string,
    else null.  ',' becomes '.'; 1 to 6 fraction digits are accepted; an ISO
    'T', 7+ digits or an impossible date give null.  The wall-clock time is
    read as UTC whatever the session time zone (TIMESTAMP_NTZ arithmetic)."""
    return (f"CASE WHEN {expr} RLIKE {sql_str(TS_MS_SHAPE)} THEN timestampdiff(MILLISECOND, "
            f"TIMESTAMP_NTZ'1970-01-01 00:00:00', try_cast(replace({expr}, ',', '.') AS TIMESTAMP_NTZ)) END")


def timestamp_ms(c) -> Column:
    """Column form of ``sql_timestamp_ms``."""
    c = col_of(c)
    ntz = F.regexp_replace(c, ",", ".").try_cast("timestamp_ntz")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(c.rlike(TS_MS_SHAPE), F.timestamp_diff("MILLISECOND", epoch, ntz))


def sql_str(s: str) -> str:
    """A Spark SQL string literal for ``s`` (backslashes and quotes escaped),
    used when a large expression is built as SQL text: one JVM call instead of
    one per function."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_py_strip(expr: str) -> str:
    """SQL text of ``py_strip``."""
    return f"btrim({expr}, {sql_str(PY_WHITESPACE)})"
