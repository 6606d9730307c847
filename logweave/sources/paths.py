"""One written form of file paths for every source.

Spark reports the same file in two ways: ``_metadata.file_path`` is escaped
like a URL (``a%20b``), the ``binaryFile`` listing is not, and local files
come as ``file:/x`` or ``file:///x``.  Joins on paths need one form:
not escaped, local files as ``file:///x``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed_path(path) -> Column:
    """The written form of a path that is not escaped; ``/x`` counts as a local file."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p.startswith("/"), F.concat(F.lit("file://"), p)).otherwise(F.regexp_replace(p, "^file:/+", "file:///"))


def scanned_path(path="_metadata.file_path") -> Column:
    """The written form of an escaped path (a '+' stands for itself)."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p), "^file:/+", "file:///")


def below(path: Column, root: Column) -> Column:
    """The part of ``path`` below ``root`` (schemes and hosts aside); an error if it isn't below it."""
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    prefix = F.concat(F.regexp_replace(bare(root), "/+$", ""), F.lit("/"))
    message = F.concat(F.lit("not below its root "), root, F.lit(": "), path)
    return F.when(bare(path).startswith(prefix), F.substring(bare(path), F.length(prefix) + 1, F.length(path))).otherwise(
        F.raise_error(message).cast("string"))
