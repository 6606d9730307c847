"""Text files -> ``lines(file_path, line_number, value)``.

Line numbers without a window over a whole file (the DataFrame form of
``zipWithIndex``): the text source cuts a file into blocks (splits); inside
one block the rows of a scan partition are consecutive, so
``monotonically_increasing_id() - first id of the block`` is the position in
the block.  A small per-block table (``file, block start, first id, lines``)
gets an exclusive prefix sum of line counts over the blocks of each file
(one row per block), and is joined back: one extra pass over the text for the
counts, no shuffle of the lines themselves (the block table has one row per
split; Spark broadcasts it if its stored size allows).

Lines break at LF, CRLF and CR; a UTF-8 BOM at the start is dropped by the
reader; undecodable bytes become U+FFFD.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.sources.paths import scanned_path


def _scan(spark: SparkSession, paths, recursive: bool = False, glob: str | None = None) -> DataFrame:
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = reader.text(paths)
    return df.select(
        scanned_path().alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.make_valid_utf8("value").alias("value"))


def read_lines(spark: SparkSession, paths, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """Read text files into numbered physical lines (1-based, per file).

    Eager: the per-split table (the count pass) is written below
    ``spark.checkpoint.dir`` first.  Spark knows its stored size, so it
    broadcasts it below the session's threshold (the lines are then never
    shuffled) and joins by shuffle above it.  (``parse_files`` needs no such
    join: it numbers lines inside its own exchange.)
    """
    from logweave.sources.sinks import materialize

    scan = _scan(spark, paths, recursive, glob)
    blocks = scan.groupBy("file_path", "_block").agg(F.min("_id").alias("_first"),
                                                      F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.select("file_path", "_block", "_first",
                                       F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")),
                         "line-blocks")
    return (scan.join(blocks, ["file_path", "_block"])
            .select("file_path",
                    (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_number"),
                    "value"))


def read_files_as_text(spark: SparkSession, paths, recursive: bool = False,
                       glob: str | None = None) -> DataFrame:
    """Whole files as one row each ``(file_path, text)`` (small files only,
    such as source code)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.text(paths, wholetext=True, recursiveFileLookup=recursive or None,
                           pathGlobFilter=glob).select(scanned_path().alias("file_path"), F.col("value").alias("text"))
