"""Stack frames (T1-T3, T6) and GitHub links (T5).

``frames(file_path, entry_line, frame_pos, package, class_name, method,
file_name, line_no, raw)``: one row per Java frame line, in trace order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import py_strip

# The frame line shape and the default vendor package prefixes.
FRAME_RE = r"(?U)^\s*at\s+([\w$.]+)\.([\w$]+)\.([\w$<>]+)\(([\w$]+\.java):(\d+)\)\s*$"
VENDOR_PREFIXES = (
    "org.wso2",
    "org.apache.synapse",
    "org.apache.axis2",
    "org.apache.axiom",
    "org.apache.http.nio",
    "org.apache.http.impl.nio",
    "org.apache.commons.vfs2",
)
FRAME_COLUMNS = ["package", "class_name", "method", "file_name", "line_no", "raw"]


def normalise_trace(text) -> Column:
    """Literal backslash-n becomes a newline, literal backslash-r is
    dropped, CRLF and CR become LF."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    c = F.replace(c, F.lit("\\r"), F.lit(""))
    c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    return F.replace(c, F.lit("\r"), F.lit("\n"))


def _frame_fields(line: Column) -> list[Column]:
    return [
        F.regexp_extract(line, FRAME_RE, 1).alias("package"),
        F.regexp_extract(line, FRAME_RE, 2).alias("class_name"),
        F.regexp_extract(line, FRAME_RE, 3).alias("method"),
        F.regexp_extract(line, FRAME_RE, 4).alias("file_name"),
        F.regexp_extract(line, FRAME_RE, 5).try_cast("int").alias("line_no"),
        py_strip(line).alias("raw"),
    ]


def _explode_frames(df: DataFrame, keys: list[str], lines: Column) -> DataFrame:
    only = F.filter(lines, lambda s: s.rlike(FRAME_RE))
    x = df.select(*keys, F.posexplode(only).alias("frame_pos", "_line"))
    return x.select(*keys, "frame_pos", *_frame_fields(F.col("_line")))


def extract_frames(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """T1+T2: frames of a pasted trace text column (one row per trace in
    ``df``, identified by ``keys``).  Lines that are not ``at pkg.Cls.m(F.java:n)``
    are dropped (Unknown Source, Native Method, Kotlin, module prefixes)."""
    return _explode_frames(df, keys, F.split(normalise_trace(text), "\n"))


def entry_frames(entries: DataFrame) -> DataFrame:
    """The frames of every entry of every file, in one job."""
    e = entries.where(F.col("has_stack_trace")).select(
        "file_path", F.col("line_number").alias("entry_line"), "stack_trace")
    return _explode_frames(e, ["file_path", "entry_line"], F.col("stack_trace"))


def is_vendor_frame(package, prefixes=VENDOR_PREFIXES) -> Column:
    """The package equals a prefix or lies below it (dot-bounded)."""
    p = F.col(package) if isinstance(package, str) else package
    conds = [(p == F.lit(x)) | p.startswith(F.lit(x + ".")) for x in prefixes]
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def github_url(org, repo, tag, path, line=None) -> Column:
    """T5: ``https://github.com/{org}/{repo}/blob/{v-tag}/{path}[#L{line}]``;
    a ``v`` is prefixed unless the tag starts with one; no anchor for a
    null or zero line."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    t = col(tag)
    vtag = F.when(t.startswith("v"), t).otherwise(F.concat(F.lit("v"), t))
    base = F.concat(F.lit("https://github.com/"), col(org), F.lit("/"), col(repo), F.lit("/blob/"),
                    vtag, F.lit("/"), col(path))
    if line is None:
        return base
    n = col(line)
    return F.when(n.isNull() | (n == 0), base).otherwise(F.concat(base, F.lit("#L"), n.cast("string")))
