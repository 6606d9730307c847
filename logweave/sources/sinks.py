"""Persist parsed entries, their page directory and class indexes; read them back.

Parse once, query many: ``write_entries`` stores entries as Parquet
partitioned by the entry date, so later time-range queries prune whole
directories and every other query prunes columns.  ``materialize`` writes an
intermediate table below the cluster's shared checkpoint folder to cut a long
lineage (an executor loss then never recomputes the parse).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.ordered import running_total
from logweave.functions.text import sql_str
from logweave.session import scratch_path

# Date partition of an entry without a parsable date.
UNKNOWN_DATE = "unknown"
DATE_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def entry_date(ts="timestamp"):
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.when(c.rlike(DATE_RE), F.substring(c, 1, 10)).otherwise(F.lit(UNKNOWN_DATE))


def write_entries(entries: DataFrame, path: str, mode: str = "overwrite",
                  max_records_per_file: int = 5_000_000, extra_partitions=(),
                  replace_partitions: bool = False) -> None:
    """Write entries partitioned by ``log_date`` (+ ``extra_partitions``).

    ``overwrite`` replaces the whole output; with ``replace_partitions`` only
    the partitions that the new entries fall into (the stream's batches).

    Rows are first rebalanced on the partition columns (the ``rebalance``
    hint: AQE makes evenly sized output partitions and splits a busy day over
    several tasks), so each task writes few, large files instead of one small
    file per date it happens to hold.  Without AQE a range repartition on
    (date, file, line) does the same job.  Rows are sorted by file and line, so that a reader of some lines of a file skips
    the row groups of others.  ``max_records_per_file`` caps files.
    """
    parts = [*extra_partitions, "log_date"]
    df = entries.withColumn("log_date", entry_date("timestamp"))
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled", "true") == "true":
        df = df.hint("rebalance", *parts)
    else:
        df = df.repartitionByRange(*parts, "file_path", "line_number")
    (df.sortWithinPartitions(*parts, "file_path", "line_number").write.mode(mode)
     .option("maxRecordsPerFile", max_records_per_file)
     .option("partitionOverwriteMode", "dynamic" if replace_partitions else "static")
     .partitionBy(*parts)
     .parquet(path))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries written by ``write_entries`` (``log_date`` is a string
    partition column whatever type partition inference picked)."""
    df = spark.read.parquet(path)
    return df.withColumn("log_date", F.col("log_date").cast("string"))


# ----------------------------------------------------------------- pages of stored entries

#: Lines of a file that one row of the page directory stands for.
PAGE_LINES = 1 << 16


def write_directory(entries: DataFrame, path: str, page_lines: int = PAGE_LINES) -> None:
    """The page directory of stored entries: for every stretch of ``page_lines`` lines of a file its number of entries and
    the entries before it in the order (file, line) of all files."""
    counts = (entries.groupBy("file_path", F.floor(F.col("line_number") / page_lines).alias("page"))
              .agg(F.count(F.lit(1)).alias("n")))
    (running_total(counts, ["file_path", "page"], "n", "before").withColumn("page_lines", F.lit(page_lines))
     .repartitionByRange("before").sortWithinPartitions("before").write.mode("overwrite").parquet(path))


def page_at(entries: DataFrame, directory: DataFrame, offset: int, limit: int) -> DataFrame:
    """L1 by the directory: the entries number ``offset`` to ``offset + limit - 1`` in the order (file, line).

    Only the stretches that hold them are read (their files and lines are pushed down to the scan); within a stretch
    entries are numbered from the directory's count on, so nothing before the page is held or sorted.  Eager: looks the
    stretches up (at most ``limit`` rows)."""
    found = directory.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).collect()
    if not found or limit <= 0:
        return entries.limit(0)
    size = found[0]["page_lines"]
    where = None
    for file_path in sorted({r["file_path"] for r in found}):
        pages = [r["page"] for r in found if r["file_path"] == file_path]  # they follow each other
        one = ((F.col("file_path") == file_path) & (F.col("line_number") >= min(pages) * size)
               & (F.col("line_number") < (max(pages) + 1) * size))
        where = one if where is None else where | one
    places = entries.sparkSession.createDataFrame([(r["file_path"], r["page"], r["before"]) for r in found],
                                                  "file_path string, _page long, _before long")
    stretch = Window.partitionBy("file_path", "_page").orderBy("line_number")
    numbered = (entries.where(where).withColumn("_page", F.floor(F.col("line_number") / size))
                .join(places, ["file_path", "_page"])
                .withColumn("_at", F.col("_before") + F.row_number().over(stretch) - 1)
                .where((F.col("_at") >= offset) & (F.col("_at") < offset + limit)))
    return numbered.select(*entries.columns).orderBy("file_path", "line_number")


# ----------------------------------------------------------------- class index

#: Buckets of a stored class index.
INDEX_BUCKETS = 32
INDEX_COLUMNS = "fqcn STRING, repo_path STRING, repo_order INT, source_path STRING, line_count BIGINT, repo_label STRING"


def open_index(spark: SparkSession, table: str, path: str, buckets: int = INDEX_BUCKETS) -> DataFrame:
    """The class index stored at ``path`` as a table of the session's catalog, in buckets by class name; created empty
    if there is none.  A look-up by class name joins it without shuffling it."""
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {table} ({INDEX_COLUMNS}) USING parquet PARTITIONED BY (repo_label) "
                  f"CLUSTERED BY (fqcn) SORTED BY (fqcn) INTO {int(buckets)} BUCKETS LOCATION {sql_str(path)}")
        # an empty write makes the folder where there is none
        spark.createDataFrame([], INDEX_COLUMNS).write.mode("append").partitionBy("repo_label").parquet(path)
        spark.catalog.recoverPartitions(table)
    return spark.table(table)


def write_index(index: DataFrame, table: str, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Store ``class_index`` rows; the repositories in ``index`` replace their stored rows, the files of all others are
    left alone.  ``drop_index`` takes a repository out."""
    stored = open_index(index.sparkSession, table, path, buckets)
    conf, mode = index.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
    old = conf.get(mode)
    conf.set(mode, "dynamic")  # an insert takes the session's mode, not an option
    try:  # one task per bucket, so that a repository has one file a bucket
        index.select(*stored.columns).repartition(buckets, "fqcn").write.mode("overwrite").insertInto(table)
    finally:
        conf.set(mode, old)


def drop_index(spark: SparkSession, table: str, repo_label: str) -> None:
    """Take a repository out of a stored index: its partition is emptied, then forgotten."""
    columns = ", ".join(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in INDEX_COLUMNS.split(", ")[:-1])
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (repo_label = {sql_str(repo_label)}) SELECT {columns} WHERE false")
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (repo_label = {sql_str(repo_label)})")


def materialize(df: DataFrame, name: str | None = None, partition_by=()) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back (lineage cut); its schema is known, so no job looks for it."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name or 'table'}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
