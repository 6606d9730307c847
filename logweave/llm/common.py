"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.sinks import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_slice(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for ids whose crc32 (of the id as text) leaves ``remainder``; a null id is False."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: Parquet below ``spark.checkpoint.dir``, read back."""
    return materialize(df, name)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column, without a copy; nulls have no bytes."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, at


def text_chunks(raw: np.ndarray, at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges (first, end) with at most ``limit`` bytes each, or a single longer row."""
    first, rows = 0, len(at) - 1
    while first < rows:
        end = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end
        first = end
