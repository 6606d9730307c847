"""Whole files as one text each, read on the executors from a listing.

Spark's text source lists a tree on the driver, which then holds every file,
and counts a file as ``spark.sql.files.openCostInBytes`` at least (4 MB), so
that a task reads some 30 small files.  Here the list stays in a table and a
task reads up to 4096 files, which it hands on in batches of ``BATCH_BYTES``.
File systems are those that pyarrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.sources.listing import file_system, split_uri, tasks_for

BATCH_BYTES = 1 << 22
TASK_BYTES = 1 << 26


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary()))], ["tree", "file_path", "text"])

    systems, rows, size = {}, [], 0
    for batch in batches:
        for tree, file_path in zip(*(c.to_pylist() for c in batch.columns)):
            root, path = split_uri(file_path)
            if root not in systems:
                systems[root] = file_system(root)
            system, begin = systems[root]
            with system.open_input_file(begin + path) as handle:
                text = handle.read()
            if rows and size + len(text) > BATCH_BYTES:
                yield read()
                rows, size = [], 0
            rows.append((tree, file_path, text))
            size += len(text)
    if rows:
        yield read()


def read_texts(files: DataFrame) -> DataFrame:
    """(tree, file_path, text) of ``files(tree, file_path, size_bytes)``, rows of a listing; bytes are taken as they are.
    Eager: counts the files."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size_bytes"), F.lit(0))).first()
    tasks = max(1, tasks_for(files.sparkSession, n), -(-size // TASK_BYTES))
    read = files.select("tree", "file_path").repartition(tasks).mapInArrow(_read, "tree int, file_path string, text binary")
    return read.withColumn("text", F.col("text").cast("string"))
