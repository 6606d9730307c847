"""Listing of folders on the executors, level by level.

Every round lists the folders that the round before found, spread over tasks;
the files stay in tables below ``spark.checkpoint.dir`` and only the number of
folders of the next level comes to the driver.  So neither the driver nor a
plan ever holds a list of files.  One folder is listed by one task, which
hands its entries on in batches; the more folders there are, the more of them
a task lists, as a task costs far more than a folder.

Names that begin with ``_`` or ``.`` are skipped as Spark's readers do (a
folder ``_x=1`` is a partition and is not).  File systems are those that
pyarrow opens: local, HDFS, S3, GCS, ABFS.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.sinks import materialize

BATCH = 10_000
FOLDERS_A_TASK = 128  # at least
MOST_A_TASK = 4096
TASKS_A_CORE = 8
ENTRIES = "tree int, root string, file_path string, is_folder boolean, size_bytes long, modified timestamp"


def split_uri(folder: str) -> tuple[str, str]:
    """(scheme with authority, path): ``hdfs://host`` and ``/x``; local paths have ``file://``."""
    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return "file://", folder
    if rest.startswith("//"):
        host, slash, path = rest[2:].partition("/")
        return f"{scheme}://{host}", slash + path
    return f"{scheme}://", rest


#: Schemes that pyarrow knows by another name.
ALIASES = {"s3a": "s3", "s3n": "s3"}


def file_system(root: str):
    """The pyarrow file system of a scheme with authority, and what its paths begin with (a bucket, or nothing)."""
    from pyarrow import fs

    if root == "file://":
        return fs.LocalFileSystem(), ""
    scheme, rest = root.split("://", 1)
    system, path = fs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}://{rest}/")
    return system, path.rstrip("/")


def skipped(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _list(skip):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def listed() -> pa.RecordBatch:
            trees, roots, paths, infos = zip(*rows)
            return pa.record_batch([
                pa.array(trees, pa.int32()), pa.array(roots), pa.array(paths), pa.array([i.type == fs.FileType.Directory for i in infos]),
                pa.array([i.size for i in infos], pa.int64()),
                pa.array([None if i.mtime_ns is None else i.mtime_ns // 1_000_000 * 1000 for i in infos], pa.timestamp("us", "UTC"))],
                ["tree", "root", "file_path", "is_folder", "size_bytes", "modified"])

        systems, rows = {}, []
        for batch in batches:
            for tree, root, folder in zip(*(c.to_pylist() for c in batch.columns)):
                if root not in systems:
                    systems[root] = file_system(root)
                system, begin = systems[root]
                for i in system.get_file_info(fs.FileSelector(begin + folder)):
                    if not skip(i.base_name):
                        rows.append((tree, root, root + i.path[len(begin):], i))
                        if len(rows) == BATCH:
                            yield listed()
                            rows = []
        if rows:
            yield listed()
    return apply


def located(spark: SparkSession, folder: str) -> tuple[str, str]:
    """(scheme with authority, path) of a folder; one without a scheme is in the default file system."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if ":" not in folder.split("/")[0] and default.startswith("file:"):
        folder = os.path.abspath(folder)
    root, path = split_uri(folder if ":" in folder.split("/")[0] or default.startswith("file:") else default.rstrip("/") + folder)
    return root, path.rstrip("/") or "/"


def tasks_for(spark: SparkSession, items: int) -> int:
    """Tasks for so many folders or files: some for each core, of no fewer and no more items than a task may have."""
    share = items // (TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return -(-items // min(MOST_A_TASK, max(FOLDERS_A_TASK, share)))


def list_trees(spark: SparkSession, folders: list[str], skip=skipped) -> DataFrame:
    """(tree, file_path, size_bytes, modified) of every file below each of ``folders``, empty files included; ``tree`` is the
    folder's place among them.  ``skip(name)`` says which names are left out, with all that is below them.  Eager."""
    level = spark.createDataFrame([(k, *located(spark, f)) for k, f in enumerate(folders)], "tree int, root string, folder string")
    count, found = len(folders), []
    while count:
        listed = materialize(level.repartition(tasks_for(spark, count)).mapInArrow(_list(skip), ENTRIES), "listing", partition_by=["is_folder"])
        found.append(listed.where("NOT is_folder").select("tree", "file_path", "size_bytes", "modified"))
        level = listed.where("is_folder").selectExpr("tree", "root", "substring(file_path, length(root) + 1) AS folder")
        count = level.count()
    return reduce(DataFrame.unionByName, found)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, size_bytes, modified) of every file below ``folder``, empty files included; eager."""
    return list_trees(spark, [folder]).drop("tree")
