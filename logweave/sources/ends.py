"""The first and last lines of files, read from the files' ends.

Format detection looks at the first 30 lines of a file and its metadata at the
first and last 10.  ``file_ends`` reads these lines alone: blocks from the
start until enough lines are complete, blocks from the end backwards until
enough lines are complete.  A line that a block's edge cuts is completed by
the next block, so the lines are those that a whole read gives, and the bytes
read grow with the number of files and not with their size (a file whose
lines are longer than a block takes as many blocks as its ends need).

Lines break at LF, CRLF and CR, a UTF-8 BOM at the start is dropped and
undecodable bytes become U+FFFD, as in ``sources.lines``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.parse import detect_format
from logweave.sources.files import META_HEAD_LINES, META_TAIL_LINES, META_TS_RE, classify_file, file_name
from logweave.sources.listing import file_system

BLOCK = 1 << 14
DETECT_LINES = 30
FILES_A_TASK = 64
BREAK = re.compile(rb"\r\n|\r|\n")
ENDS = "file_path string, from_start long, from_end long, bytes_read long, value binary"


def head_lines(handle, size: int, wanted: int, block: int = BLOCK) -> tuple[list[bytes], int]:
    """The first ``wanted`` lines and the bytes that were read for them."""
    data, at = b"", 0
    while at < size and len(BREAK.findall(data[:-1])) < wanted:  # a CR at the edge may be half a CRLF
        handle.seek(at)
        data += handle.read(min(block, size - at))
        at = len(data)
    lines = BREAK.split(data.removeprefix(b"\xef\xbb\xbf") if data else data)
    if at >= size and lines and lines[-1] == b"":
        lines.pop()
    return lines[:wanted], at


def tail_lines(handle, size: int, wanted: int, block: int = BLOCK) -> tuple[list[bytes], int]:
    """The last ``wanted`` lines, last first, and the bytes that were read for them."""
    data, at = b"", size
    # one break ends the last line, one more must stand before the first one wanted
    while at > 0 and len(BREAK.findall(data)) < wanted + 2:
        step = min(block, at)
        at -= step
        handle.seek(at)
        data = handle.read(step) + data
    lines = BREAK.split(data.removeprefix(b"\xef\xbb\xbf") if at == 0 else data)
    if lines and lines[-1] == b"":
        lines.pop()
    return lines[::-1][:wanted], size - at


def _read(root: str, head: int, tail: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, begin = file_system(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(begin + path[len(root):]) as handle:
                    size = handle.size()
                    first, n = head_lines(handle, size, head)
                    last, m = tail_lines(handle, size, tail)
                rows = [(path, k, None, n + m, x) for k, x in enumerate(first, 1)] + [(path, None, k, n + m, x) for k, x in enumerate(last, 1)]
                rows = rows or [(path, None, None, 0, None)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["file_path", "from_start", "from_end", "bytes_read", "value"])
    return apply


def file_ends(files: DataFrame, head: int = DETECT_LINES, tail: int = META_TAIL_LINES) -> DataFrame:
    """(file_path, from_start, from_end, bytes_read, value): the first ``head`` lines (``from_start`` from 1) and the last
    ``tail`` lines (``from_end`` from 1) of ``files(file_path)``, the written paths of a listing; an empty file has one row
    without a line."""
    from logweave.sources.sinks import materialize

    listed = materialize(files.select("file_path", F.regexp_extract("file_path", "^[^:]*://[^/]*", 0).alias("_root")), "files")
    out = None
    for row in listed.groupBy("_root").count().collect():  # one row per file system
        own = listed.where(F.col("_root") == row["_root"]).select("file_path")
        lines = own.repartition(-(-row["count"] // FILES_A_TASK)).mapInArrow(_read(row["_root"], head, tail), ENDS)
        out = lines if out is None else out.unionAll(lines)
    if out is None:
        return files.sparkSession.createDataFrame([], ENDS).withColumn("value", F.col("value").cast("string"))
    return out.withColumn("value", F.make_valid_utf8(F.col("value").cast("string")))


def detect_file_formats(files: DataFrame, window: int = DETECT_LINES) -> DataFrame:
    """P4 from the files' heads: the rows of ``detect_format`` on the files' lines."""
    heads = file_ends(files, window, 0)
    return detect_format(heads.select("file_path", F.coalesce("from_start", F.lit(1)).alias("line_number"),
                                      F.coalesce("value", F.lit("")).alias("value")), window)


def file_times(files: DataFrame) -> DataFrame:
    """S3 from the files' ends: ``file_metadata`` of ``files(file_path, size_bytes)`` but for the count of lines, which only a
    whole read gives: file_path, filename, file_type, size_bytes, first_timestamp, last_timestamp."""
    ends = file_ends(files, META_HEAD_LINES, META_TAIL_LINES)
    ts = F.when(F.col("value").rlike(META_TS_RE), F.regexp_extract("value", META_TS_RE, 0))
    found = ends.select("file_path", ts.alias("ts"), "from_start", "from_end").groupBy("file_path").agg(
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("from_start"))).alias("first_timestamp"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("from_end"))).alias("last_timestamp"))
    return files.select("file_path", "size_bytes").join(found, "file_path", "left").select(
        "file_path", file_name("file_path").alias("filename"), classify_file(file_name("file_path")).alias("file_type"),
        "size_bytes", "first_timestamp", "last_timestamp")
