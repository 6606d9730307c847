"""Log file catalogue operators.

``discover_logs`` lists a folder on the executors; no file is read and the
driver holds no list.  ``file_metadata`` reads the ``lines`` table once
with one aggregation per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.packed import odd, pack_time, unpack
from logweave.sources.listing import list_files

# Log file suffixes, the metadata timestamp shape and the
# window sizes, and the file-type rules (first hit wins).
LOG_SUFFIX_RE = r"(?i)[^/]\.(log|txt)$"
META_TS_RE = r"(?U)\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
META_HEAD_LINES = 10
META_TAIL_LINES = 10
FILE_TYPE_RULES = [
    (["wso2carbon"], "wso2carbon"),
    (["audit"], "audit"),
    (["http_access", "access_log"], "http_access"),
    (["correlation"], "correlation"),
]
GENERIC_TYPE = "generic"


def file_name(path) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.substring_index(p, "/", -1)


def classify_file(name) -> Column:
    """File type from the lower-cased file name; first rule that hits."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    out = None
    for needles, kind in FILE_TYPE_RULES:
        cond = None
        for s in needles:
            c = n.contains(F.lit(s))
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(kind)) if out is None else out.when(cond, F.lit(kind))
    return out.otherwise(F.lit(GENERIC_TYPE))


def discover_logs(spark: SparkSession, folder: str, registered: DataFrame | None = None) -> DataFrame:
    """S2 + J6: every ``.log``/``.txt`` file (case-insensitive suffix) below
    ``folder``, sorted by path, minus the paths already in ``registered``
    (a DataFrame with a ``file_path`` column).

    Returns ``(file_path, filename, file_type, size_bytes, modified)``.  The
    folders are listed by the executors (``sources.listing``, eager); files
    without content are listed, too.
    """
    found = list_files(spark, folder).where(F.col("file_path").rlike(LOG_SUFFIX_RE))
    if registered is not None:
        found = skip_registered(found, registered)
    return (found.select("file_path", file_name("file_path").alias("filename"),
                         classify_file(file_name("file_path")).alias("file_type"),
                         "size_bytes", "modified")
            .orderBy("file_path"))


def skip_registered(found: DataFrame, registered: DataFrame) -> DataFrame:
    """Paths not yet registered (left anti join on the path)."""
    return found.join(registered.select("file_path").distinct(), "file_path", "left_anti")


def file_metadata(lines: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """S3: per file ``line_count``, ``first_timestamp`` (first
    ``yyyy-MM-dd HH:mm:ss`` in the first 10 lines), ``last_timestamp``
    (searching the last 10 lines from the end) and ``size_bytes``.

    One hash aggregation over packed timestamps: the last match of the whole
    file is kept and dropped afterwards when it lies before the last 10 lines.  ``size_bytes`` comes
    from ``sizes`` (``file_path``, ``size_bytes``, e.g. the listing) when given,
    else it is the UTF-8 size of the lines plus one newline each.
    """
    ln = F.col("line_number")
    rows = (lines.select("file_path", ln, F.octet_length("value").alias("_bytes"),
                         F.when(F.col("value").rlike(META_TS_RE), F.regexp_extract("value", META_TS_RE, 0)).alias("_ts"))
            .withColumn("_head", F.when(F.col("_ts").isNotNull() & (ln <= META_HEAD_LINES), ln))
            .withColumn("_hit", F.when(F.col("_ts").isNotNull(), ln))
            .withColumn("_odd", odd("_ts")).withColumn("_t", pack_time("_ts")))
    # A match that cannot be packed (digits of other scripts) is a group of its own; the few rows of a file are added up.
    parts = rows.groupBy("file_path", "_odd").agg(
        F.max("line_number").alias("line_count"), F.min("_head").alias("_first_at"), F.min_by("_t", "_head").alias("_first"),
        F.max("_hit").alias("_last_at"), F.max_by("_t", "_hit").alias("_last"),
        (F.sum("_bytes") + F.count(F.lit(1))).alias("_bytes"))
    text = lambda t: F.coalesce("_odd", unpack(t, "1"))
    agg = parts.groupBy("file_path").agg(
        F.max("line_count").alias("line_count"), F.min_by(text("_first"), "_first_at").alias("first_timestamp"),
        F.max_by(text("_last"), "_last_at").alias("_last"), F.max("_last_at").alias("_last_at"), F.sum("_bytes").alias("_bytes"))
    last = F.when(F.col("_last_at") > F.col("line_count") - META_TAIL_LINES, F.col("_last"))
    out = agg.select("file_path", file_name("file_path").alias("filename"),
                     classify_file(file_name("file_path")).alias("file_type"),
                     "_bytes", "line_count", "first_timestamp", last.alias("last_timestamp"))
    if sizes is not None:
        # driven by the listing, so an empty file (no lines) is still listed
        out = (sizes.select("file_path", "size_bytes")
               .join(out.drop("filename", "file_type"), "file_path", "left")
               .withColumn("line_count", F.coalesce(F.col("line_count"), F.lit(0).cast("long")))
               .withColumn("filename", file_name("file_path"))
               .withColumn("file_type", classify_file(file_name("file_path"))))
    else:
        out = out.withColumn("size_bytes", F.col("_bytes"))
    return out.select("file_path", "filename", "file_type", F.col("size_bytes").cast("long"),
                      "line_count", "first_timestamp", "last_timestamp")


def log_files(lines: DataFrame, formats: DataFrame | None = None, default_format: str | None = None,
              sizes: DataFrame | None = None) -> DataFrame:
    """The catalogue ``log_files`` with the effective format id per file
    (explicit from ``formats(file_path, format_id)``, else ``default_format``)."""
    meta = file_metadata(lines, sizes)
    if formats is not None:
        # a file listed twice takes its smallest format id
        meta = meta.join(formats.groupBy("file_path").agg(F.min("format_id").alias("_fmt")), "file_path", "left")
    else:
        meta = meta.withColumn("_fmt", F.lit(None).cast("string"))
    return meta.withColumn("format_id", F.coalesce(F.col("_fmt"), F.lit(default_format).cast("string"))) \
        .drop("_fmt")
