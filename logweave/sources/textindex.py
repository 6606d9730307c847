"""A skipping index for text search on stored entries.

For every stored file the index has a bitmap of the grams of its text: the
text is lower-cased and cut into runs of ASCII letters and digits, and every
four characters of a run set one of ``POSITIONS`` bits.  A text that contains
a literal contains the literal's runs, and so its grams: a file that lacks one
of the bits holds no hit and is not read.  The exact filter runs on all other
files, so hash collisions cost reading and no rows.

Files that the index does not know (written after it) are always read.  A
literal without a run of four characters, and a regular expression, skip
nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.filters import Criteria, filter_entries
from logweave.sources.listing import list_files
from logweave.sources.paths import scanned_path

GRAM = 4
BITMAP = 32768  # bits of a bitmap of Spark's bitmap functions
POSITIONS = 8 * BITMAP
RUNS = "[^a-z0-9]+"


def _grams(run: Column) -> Column:
    return F.when(F.length(run) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(run) - (GRAM - 1)),
                                                     lambda i: F.substring(run, i, GRAM))).otherwise(F.array().cast("array<string>"))


def _position(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(POSITIONS))


def file_bits(stored: DataFrame) -> DataFrame:
    """(file, bucket, bits) of the files that ``stored`` entries are read from; bucket -1, without bits, for each of them.

    Runs are made distinct by entry, then by file before their grams are taken.  Rows name their file by a hash of its path
    (files of one hash would share their bits, which costs reading and no rows).  A file's runs meet in one task before
    bitmaps are made of them, so there is one bitmap per file and bucket, whatever the number of tasks."""
    entries = stored.withColumn("path", F.col("_metadata.file_path")).withColumn("of", F.xxhash64("path"))
    # Below the generators, so that they are computed per entry or run and not per row made of it.
    words = entries.select("of", F.array_distinct(F.split(F.lower(F.concat_ws(" ", "raw", "message")), RUNS)).alias("runs"))
    runs = words.select("of", F.explode("runs").alias("run")).where(F.length("run") >= GRAM).distinct().repartition("of")
    at = runs.select("of", F.explode(F.array_distinct(_grams(F.col("run")))).alias("gram")).select("of", _position(F.col("gram")).alias("at"))
    bits = at.select("of", F.floor(F.col("at") / BITMAP).cast("int").alias("bucket"), (F.col("at") % BITMAP).alias("bit")).groupBy(
        "of", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    files = entries.select("of", "path").distinct().select("of", scanned_path("path").alias("file"))
    bits = files.join(bits, "of").select("file", "bucket", "bits")
    known = files.select("file", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("bits"))
    return bits.unionByName(known)


def write_text_index(spark: SparkSession, entries_path: str, index_path: str) -> None:
    """Index the entries stored at ``entries_path`` (``sinks.write_entries``): (file, bits) by bucket of the positions."""
    file_bits(spark.read.parquet(entries_path)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(index_path)


def literal_grams(query: str) -> list[str]:
    return sorted({run[i:i + GRAM] for run in re.split(RUNS, query.lower()) for i in range(len(run) - GRAM + 1)})


def files_without(spark: SparkSession, index_path: str, query: str) -> DataFrame:
    """(file): the indexed files that cannot hold ``query``."""
    index = spark.read.parquet(index_path)
    known = index.where("bucket = -1").select("file")
    grams = literal_grams(query)
    if not grams:
        return known.limit(0)
    places = spark.createDataFrame([(g,) for g in grams], "gram string").select(_position(F.col("gram")).alias("at")).distinct()
    wanted: dict[int, list[int]] = {}
    for row in places.collect():  # a few per character of the query
        wanted.setdefault(row["at"] // BITMAP, []).append(row["at"] % BITMAP)
    holds = F.lit(False)
    for bucket, bits in wanted.items():
        every = F.col("bucket") == bucket
        for bit in bits:
            byte = F.conv(F.hex(F.substring("bits", bit // 8 + 1, 1)), 16, 10).cast("int")
            every = every & (byte.bitwiseAND(F.lit(1 << bit % 8)) != 0)
        holds = holds | every
    may = (index.where(F.col("bucket").isin(sorted(wanted)) & holds).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") == len(wanted)).select("file"))
    return known.join(may, "file", "left_anti")


@dataclass
class Reading:
    """What a search reads: the stored files and those that the index skips."""
    files: int
    skipped: int


def search_stored(spark: SparkSession, entries_path: str, index_path: str, criteria: Criteria) -> tuple[DataFrame, Reading]:
    """F8 on stored entries, reading only files that may hold the literal; the rows of ``filter_entries`` on all of them.

    Eager: the files to read are looked up first (the reader needs their names)."""
    entries = spark.read.parquet(entries_path)
    stored = list_files(spark, entries_path).where(F.col("file_path").endswith(".parquet")).select(F.col("file_path").alias("file"))
    literal = "" if criteria.regex else criteria.search or ""
    every = stored.count()
    skip = files_without(spark, index_path, literal)
    chosen = [r["file"] for r in stored.join(skip, "file", "left_anti").collect()]
    if len(chosen) < every:
        entries = (spark.read.schema(entries.schema).option("basePath", entries_path).parquet(*chosen) if chosen
                   else entries.limit(0))
    if "log_date" in entries.columns:
        entries = entries.withColumn("log_date", F.col("log_date").cast("string"))
    return filter_entries(entries, criteria), Reading(every, every - len(chosen))
