"""Renderers: the driver's tables turned into log text, Java sources and jar
names (test inputs, not operators).  Every renderer is a Spark job over the
whole table; the oracles compute their expectations from table columns.

R1 ``event_lines``        events -> log lines in the three auto formats
R2 ``event_lines_layout`` events -> log lines in a user-defined layout
R3 ``part_sources``       part   -> Java source files of two repositories
R4 ``part_jars``          part   -> jar file names
R5 ``part_versions``      part   -> versions and release tags
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.ordered import chunked_running

EVENT_CHUNK = 1 << 16

# Fixed values of the renderers (see FIXTURES.md).
SIZE_WORDS = ["economy", "large", "medium", "promo", "small", "standard"]
R2_LAYOUT = "[%d] %5p [%t] [%X{correlationId}] [%X{tenantDomain}] {%c} - %m%ex%n"
R3_PACKAGE_MAP = [
    ("org.example.economy", "r-economy"),
    ("org.example.large", "r-large"),
    ("org.example.me", "r-me"),
    ("org.example.medium", "r-medium"),
    ("org.example.p", "r-promo"),
    ("org.example.small", "r-small"),
]
R3_VENDOR_PREFIXES = ["org.example"]


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# Rendering rules as SQL text (one JVM call per projection).
_WORDS = ", ".join(f"'{w}'" for w in SIZE_WORDS)
_EVENT_COLUMNS = [
    "event_id AS n", "user_id AS u", "event_type AS et",
    # yyyy-MM-dd HH:mm:ss,SSS of the TIMESTAMP_NTZ wall clock (no time zone)
    "concat(substr(CAST(ts AS STRING), 1, 19), ',', "
    "lpad(CAST(CAST(floor(date_part('SECONDS', ts) * 1000) AS BIGINT) % 1000 AS STRING), 3, '0')) AS T",
    f"element_at(array({_WORDS}), CAST(event_id % 6 + 1 AS INT)) AS y",
    "CAST(event_id % 61 AS STRING) AS P",
    "CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR' "
    "WHEN event_type = 'purchase' THEN 'WARN' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS LEVEL",
]
_DERIVED = [
    "n", "u", "et", "T", "y", "P", "LEVEL",
    "concat('org.example.', y, '.P', P) AS logger",
    "concat(et, ' event ', CAST(n AS STRING), ' user ', CAST(u AS STRING)) AS msg",
]
_EXTRA_LINES = """CASE
  WHEN et = 'error' THEN array(
    concat('com.example.ServiceException: event ', CAST(n AS STRING), ' failed'),
    concat('\\tat org.example.', y, '.P', P, CASE WHEN n % 2 = 1 THEN '$Nested' ELSE '' END,
           '.handle(P', P, '.java:', CAST(n % 8 + 1 AS STRING), ')'),
    concat('Caused by: java.lang.IllegalStateException: code ', CAST(n % 5 AS STRING)),
    concat('\\tat net.other.lib.Util$Inner.call(Util.java:', CAST(n % 30 + 1 AS STRING), ')'),
    concat('\\t... ', CAST(n % 9 AS STRING), ' more'),
    '')
  WHEN et = 'purchase' THEN array(concat('  items=', CAST(n % 4 AS STRING)))
  ELSE CAST(array() AS ARRAY<STRING>) END"""
_AUTO_HEADER = """CASE
  WHEN u % 3 = 0 THEN concat('TID: [', CASE WHEN u % 5 = 0 THEN '' ELSE CAST(u % 5 AS STRING) END, '] [', et,
                             '] [', T, ']  ', LEVEL, ' {', logger, '} - ', msg)
  WHEN u % 3 = 1 THEN concat('[', T, ']  ', LEVEL, ' {', logger, '} - ', msg)
  ELSE concat(T, ' ', LEVEL, ' [', logger, '] - ', msg) END"""
_LAYOUT_HEADER = """concat('[', T, ']  ', LEVEL, ' [exec-', CAST(n % 8 AS STRING), '] [c', CAST(n % 97 AS STRING), '] [',
       CASE WHEN u % 5 = 0 THEN '' ELSE concat('t', CAST(u % 5 AS STRING), '.com') END, '] {', logger, '} - ', msg)"""


def _render(events: DataFrame, header_sql: str) -> DataFrame:
    ev = events.selectExpr("event_id", "coalesce(user_id, -1) AS user_id", "event_type", "ts",
                           "CAST(CASE event_type WHEN 'error' THEN 7 WHEN 'purchase' THEN 2 ELSE 1 END AS BIGINT) AS _w",
                           f"coalesce(floor(event_id / {EVENT_CHUNK}), -1) AS _chunk")
    # header line = 2 + lines of the earlier events of the same file; only
    # the small columns go through the exchange, the text is built after it
    ev = chunked_running(ev, ["user_id"], "_chunk", "event_id", "_w", "sum", "_before", inclusive=False)
    ev = ev.selectExpr("_before", *_EVENT_COLUMNS).selectExpr("_before", *_DERIVED)
    body = ev.selectExpr("concat('user-', CAST(u AS STRING), '.log') AS file_path", "_before",
                         f"posexplode(concat(array({header_sql}), {_EXTRA_LINES})) AS (_pos, value)")
    body = body.selectExpr("file_path", "_before + 2 + _pos AS line_number", "value")
    orphans = (events.select(F.col("user_id").alias("u")).distinct()
               .selectExpr("concat('user-', CAST(u AS STRING), '.log') AS file_path",
                           "CAST(1 AS BIGINT) AS line_number",
                           "concat('*** log of user ', CAST(u AS STRING), ' ***') AS value"))
    return body.unionByName(orphans)


def event_lines(events: DataFrame) -> DataFrame:
    """``lines(file_path, line_number, value)`` in tid/bracket/basic formats."""
    return _render(events, _AUTO_HEADER)


def event_lines_layout(events: DataFrame) -> DataFrame:
    """R2: lines in the user-defined layout ``R2_LAYOUT``."""
    return _render(events, _LAYOUT_HEADER)


# ---------------------------------------------------------------- R3 / R4

def part_sources(part: DataFrame, lines: int = 8, keep=()) -> DataFrame:
    """One Java source file of ``lines`` lines per part row, as whole text (and the columns ``keep``).

    ``source_files(repo_label, repo_path, repo_order, source_path, text)``;
    ``source_path`` starts with the repository root; ``target/`` paths are
    produced on purpose (the indexer must skip them).
    """
    k = F.col("p_partkey")
    order = ((k / 50).cast("long") % 2).cast("int")
    label = F.concat(F.lit("repo-"), _s(order))
    cls = F.concat(F.lit("P"), _s(k % 50))
    target = F.when((k / 50).cast("long") % 5 == 4, F.lit("target/")).otherwise(F.lit(""))
    rel = F.concat(F.lit("m"), F.lpad(_s(k), 8, "0"), F.lit("/"), target, F.lit("src/"), cls, F.lit(".java"))
    pkg = F.concat(F.lit("org.example."), F.lower("p_type"))
    body = F.concat_ws("\n", F.transform(F.sequence(F.lit(3), F.lit(lines)),
                                         lambda i: F.concat(F.lit("// part "), _s(k), F.lit(" line "), _s(i))))
    text = F.concat(F.lit("package "), pkg, F.lit(";\n\n"), body, F.lit("\n"))
    return part.select(label.alias("repo_label"), label.alias("repo_path"), order.alias("repo_order"),
                       F.concat(label, F.lit("/"), rel).alias("source_path"), text.alias("text"), *keep)


def _jar_path() -> Column:
    k = F.col("p_partkey")
    name = F.regexp_replace("p_name", " ", "-")
    size = _s("p_size")
    f = (F.when(k % 4 == 0, F.concat(name, F.lit("-"), size, F.lit("."), _s(k % 10), F.lit(".0.jar")))
         .when(k % 4 == 1, F.concat(name, F.lit("_"), size, F.lit(".0.0.jar")))
         .when(k % 4 == 2, F.concat(name, F.lit("_"), size, F.lit(".0.0.rc"), _s(k % 9), F.lit("_"),
                                    _s(k % 3 + 1), F.lit(".jar")))
         .otherwise(F.concat(name, F.lit(".jar"))))
    return F.concat(F.lit("lib/"), F.lpad(_s(k), 8, "0"), F.lit("/"), f)


def part_jar_rows(part: DataFrame) -> DataFrame:
    """R4 with the columns the tag and URL tests use: ``path``, ``k``,
    ``name`` (the jar's base name), ``org``."""
    k = F.col("p_partkey")
    return part.select(_jar_path().alias("path"), k.alias("k"),
                       F.regexp_replace("p_name", " ", "-").alias("name"),
                       F.when(k % 3 == 0, F.lit("org-a")).otherwise(F.lit("org-b")).alias("org"))


def part_versions(part: DataFrame) -> DataFrame:
    """``(k, org, repo, version, tag)``: versions with a patch part (some with a leading ``v``) and, for most, one
    release tag in one of the forms that are tried."""
    k = F.col("p_partkey")
    base = F.concat(_s("p_size"), F.lit("."), _s(k % 10), F.lit(".wso2v"), _s(k % 7))
    dashed = F.concat(_s("p_size"), F.lit("."), _s(k % 10), F.lit("-wso2v"), _s(k % 7))
    tag = (F.when(k % 5 == 0, F.concat(F.lit("v"), base)).when(k % 5 == 1, base)
           .when(k % 5 == 2, F.concat(F.lit("v"), dashed)).when(k % 5 == 3, dashed))
    return part.select(k.alias("k"), F.when(k % 3 == 0, F.lit("org-a")).when(k % 3 == 1, F.lit("org-b")).otherwise(F.lit("org-c")).alias("org"),
                       F.substring_index("p_name", " ", 1).alias("repo"),
                       F.when(k % 2 == 0, F.concat(F.lit("v"), base)).otherwise(base).alias("version"), tag.alias("tag"))


# Fixed values of the R3/R4 look-up tests (dims given by the caller).
R4_OVERRIDES = [
    ("org.example.promo", "blue-gear"),
    ("org.example.large.hot-rod", "no-such-jar"),
    ("org.example.s", "red-ring"),
]
R4_ORGS = ["org-a", "org-b"]
FEATURES = [
    ("economy", ["r-economy"]),
    ("large", ["r-large"]),
    ("medium", ["r-medium", "r-me"]),
    ("promo", ["r-promo"]),
    ("small", ["r-small"]),
]

