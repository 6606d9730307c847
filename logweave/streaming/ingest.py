"""Incremental ingestion of new log files (an optional extension; the
reference only parses on request).

A Structured Streaming file source picks up files that appeared since the
last run; ``Trigger.AvailableNow`` processes everything available and stops.
Every micro-batch holds whole files (the file source never splits a file
across batches), so entries never straddle batches.  ``foreachBatch`` runs the
batch parsers on the micro-batch and writes it idempotently: the output is
partitioned by ``batch_id`` (the checkpoint's own id and the batch's number)
with dynamic overwrite, so a replayed batch replaces its own output only.

The checkpoint belongs to one folder and one output.  An output that another
checkpoint has written to is refused: that checkpoint was lost or exchanged,
and going on would write the same files twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.errors import AnalysisException

from logweave.operators.parse import parse_scanned
from logweave.sources.files import LOG_SUFFIX_RE
from logweave.sources.paths import scanned_path
from logweave.sources.sinks import write_entries


def _checkpoint_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The id that the checkpoint's query has for good; null before its first run."""
    try:
        return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _writers(spark: SparkSession, out_path: str) -> set[str]:
    """The ids of the checkpoints that wrote to the output."""
    try:
        stored = spark.read.parquet(out_path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return set()
    ids = stored.select(F.regexp_extract(F.col("batch_id").cast("string"), "^(.*)-[0-9]+$", 1).alias("id")).distinct()
    return {r["id"] for r in ids.collect()}


def ingest_new_files(spark: SparkSession, folder: str, out_path: str, checkpoint: str,
                     layout: str | None = None, max_files_per_trigger: int | None = None,
                     file_formats: DataFrame | None = None, formats=None):
    """Parse every new ``.log``/``.txt`` file below ``folder`` into entries at
    ``out_path``; returns the finished ``StreamingQuery``.  ``file_formats``
    (``file_path``, ``format_id``) chooses formats per file as in
    ``parse_files`` (joined to each micro-batch after its line ids are set).
    ``checkpoint`` is a folder of this folder and output alone."""
    strangers = _writers(spark, out_path) - {_checkpoint_id(spark, checkpoint)}
    if strangers:
        raise ValueError(f"{out_path} holds batches of another checkpoint than {checkpoint}")
    reader = (spark.readStream.format("text").option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(folder).select(
        scanned_path().alias("file_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.make_valid_utf8("value").alias("value"))
    stream = stream.where(F.col("file_path").rlike(LOG_SUFFIX_RE))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        scan = batch.select("file_path", "_block", F.monotonically_increasing_id().alias("_id"), "value")
        entries = parse_scanned(scan, layout, file_formats, formats)
        own = f"{_checkpoint_id(spark, checkpoint)}-{batch_id}"
        write_entries(entries.withColumn("batch_id", F.lit(own)), out_path, mode="overwrite",
                      extra_partitions=("batch_id",), replace_partitions=True)

    q = (stream.writeStream.foreachBatch(run_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return q
