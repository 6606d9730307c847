"""A corpus pipeline: documents through five operators of ``logweave.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.  All stages
but the last return the columns of the documents.

1. quality classifier: documents that it rejects go;
2. line dedup: lines with an earlier equal or nearly equal line go (n_chars
   follows the text), and documents of which no word is left;
3. SimHash near-dedup: of each group of near copies one document stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. mixing: every document that is left, with its posteriors, rate and copies.

Edge cases: documents may have null ids, null or empty texts, repeated rows and
further columns of any names but those with two underscores in front; they keep
their values through all stages but the last.  A null or empty text passes the
stages as any text would (its score, no lines, fingerprint zero, no windows, no
tokens).  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import decontamination, line_dedup, mixing, quality_fm, simhash_dedup
from logweave.llm.common import crc_slice, stored, table
from logweave.llm.queries import MIX

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"), ~crc_slice(F.col("doc_id"), 5, 0))
    return quality_fm.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs, least_bytes=12, grown=True, count_as="__lost")  # a document's column may have any other name
    changed = F.col("__lost") > 0
    kept = kept.where(~changed | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_of_each(docs, shingle=4, max_distance=4)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), whole=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), MIX).drop("text_hash")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("mixing", mixed),
]

#: The classifiers' scores cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
