"""Log formats: log4j2 layouts compiled to Java regexes (P1), the built-in
layouts (P10), per-file format assignment (S5) and the format report (P5).

A layout is compiled once on the driver into a regex string with positional
groups plus the ordered list of entry fields those groups fill.  The regex
is then used by ``rlike`` / ``regexp_extract`` inside executors; no Python
code runs per line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ----------------------------------------------------------------- fixed values

TS_RE = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}[,\.]\d+"
LEVEL_RE = r"\w+"
LOGGER_RE = r"[^\s\{\}\[\]]+"
THREAD_RE = r"[^\s\[\]|]+"
MESSAGE_RE = r".*"
BRACKETED_RE = r"[^\]]*"
MDC_RE = r"[^\s|,}]*"
UNKNOWN_RE = r"[^\s]*"

# directive name (lower case) -> (entry field, regex)
DIRECTIVES = {
    "d": ("timestamp", TS_RE),
    "date": ("timestamp", TS_RE),
    "p": ("level", LEVEL_RE),
    "level": ("level", LEVEL_RE),
    "le": ("level", LEVEL_RE),
    "c": ("logger", LOGGER_RE),
    "logger": ("logger", LOGGER_RE),
    "lo": ("logger", LOGGER_RE),
    "class": ("logger", LOGGER_RE),
    "t": ("thread", THREAD_RE),
    "thread": ("thread", THREAD_RE),
    "tn": ("thread", THREAD_RE),
    "m": ("message", MESSAGE_RE),
    "msg": ("message", MESSAGE_RE),
    "message": ("message", MESSAGE_RE),
    "tenantid": ("tid", BRACKETED_RE),
    "appname": ("app_name", BRACKETED_RE),
}

# MDC key (lower case) of %X{key} -> entry field
MDC_FIELDS = {
    "correlationid": "correlation_id",
    "correlation_id": "correlation_id",
    "correlation-id": "correlation_id",
    "tenantdomain": "tenant_domain",
    "tenant_domain": "tenant_domain",
    "tenant.domain": "tenant_domain",
    "apiname": "app_name",
}

# Directives (lower case) that produce no text on the header line.
SKIPPED = {"ex", "exception", "throwable", "xex", "n", "newline"}

ENTRY_FIELDS = ["timestamp", "level", "logger", "message", "thread", "tenant_domain",
                "tid", "app_name", "correlation_id"]


@dataclass(frozen=True)
class LogFormat:
    format_id: str
    pattern: str


# The built-in layouts in catalogue order.  Fixed values.
BUILTIN_FORMATS = [
    LogFormat("builtin-tid", "TID: [%tenantId] [%appName] [%d] %5p {%c} - %m%ex%n"),
    LogFormat("builtin-apim-audit", "TID: [%tenantId] [%d] %5p {%c} - %m%ex%n"),
    LogFormat("builtin-apim-api-log", "[%d] %5p {%c} %X{apiName} - %m%ex%n"),
    LogFormat("builtin-apim-trace", "[%d] [%tenantId] %5p {%c} - %m%ex%n"),
    LogFormat("builtin-apim-gov-audit", "ThreadID: [%T] TenantID: [%tenantId] [%d] %5p {%c} - %m%ex%n"),
    LogFormat("builtin-bracket", "[%d] %5p {%c} - %m%ex%n"),
    LogFormat("builtin-correlation", "%d{yyyy-MM-dd HH:mm:ss,SSS}|%X{Correlation-ID}|%t|%m%n"),
    LogFormat("builtin-error-diag", "%d{ISO8601} [%X{ip}-%X{host}] [%t] %5p {%c} %m%n"),
    LogFormat("builtin-basic", "%d %5p [%c] - %m%ex%n"),
]


# ----------------------------------------------------------------- P1 compiler

@dataclass(frozen=True)
class CompiledLayout:
    regex: str            # Java regex, flags included, anchored at the start
    fields: tuple         # entry field filled by group 1, 2, ...


# What a layout is made of: blanks, directives (%, optional width, letters, optional {option}), other characters.
PARTS = re.compile(r"(?P<blanks>[ \t]+)|%(?:-?\d+(?:\.\d+)?)?(?P<name>[a-zA-Z]+)(?:\{(?P<option>[^}]*)\})?|(?P<other>.)", re.S)


def _directive(name: str, option: str) -> tuple[str | None, str]:
    """Entry field (None: nothing to capture) and regex of a directive."""
    if name in SKIPPED:
        return None, ""
    if name == "x":
        return MDC_FIELDS.get(option), MDC_RE
    return DIRECTIVES.get(name, (None, UNKNOWN_RE))


def layout_pattern(pattern: str) -> CompiledLayout:
    """The Java regex of a log4j2 layout with positional groups, valid or not.

    A directive's letters count in lower case; each field is captured once
    (where it is repeated it is matched without capture); ``%X{key}`` captures
    the MDC fields; unknown directives match one non-space token; blanks match
    any white space; other characters are literal.  The regex is anchored at
    the start, not at the end, and '.' matches newlines.
    """
    regex, fields = "(?sU)^", []
    for part in PARTS.finditer(pattern):
        if part["blanks"]:
            regex += r"\s*"
        elif part["other"]:
            # ASCII punctuation is escaped; all other characters stand for themselves in Java regexes
            regex += re.sub(r"([!-/:-@\[-^`{-~\x00-\x1f\x7f])", r"\\\1", part["other"])
        else:
            field, body = _directive(part["name"].lower(), (part["option"] or "").strip().lower())
            captured = field is not None and field not in fields
            fields += [field] if captured else []
            regex += f"({body})" if captured else f"(?:{body})" if body else ""
    return CompiledLayout(regex, tuple(fields))


def layout_error(pattern: str) -> str | None:
    """Why the layout's regex is not valid; null if it is."""
    try:  # the Java and Python dialects agree on every construct emitted above
        re.compile(layout_pattern(pattern).regex.replace("(?sU)", "(?s)"))
    except re.error as error:
        return str(error)
    return None


def layout_to_regex(pattern: str) -> CompiledLayout | None:
    """``layout_pattern``, or None when it is not a valid regex."""
    return None if layout_error(pattern) else layout_pattern(pattern)


# ----------------------------------------------------------------- P10 / S5

def format_catalog(formats: list[LogFormat] | None = None) -> dict[str, LogFormat]:
    """id -> format, built-ins first; a user format may not replace a built-in."""
    cat = {f.format_id: f for f in BUILTIN_FORMATS}
    for f in formats or []:
        cat.setdefault(f.format_id, f)
    return cat


def effective_format(explicit, default: str | None = None):
    """Explicit format id, else the project default, else null (= auto)."""
    c = F.col(explicit) if isinstance(explicit, str) else explicit
    return F.coalesce(c, F.lit(default).cast("string"))


# ----------------------------------------------------------------- P5 report

def format_report(lines: DataFrame, formats: list[LogFormat] | None = None,
                  include_builtins: bool = True) -> DataFrame:
    """Per (file, format): lines tested, lines matched, match ratio, number of
    the first matched line and the fields captured from it (a map, empty
    captures left out), the format's regex, and why it does not compile.

    One pass over the lines with two conditional aggregates per format (no
    join between lines and formats), then an unpivot of the per-file row,
    which is stored (eager).  The texts of the first matched lines are looked
    up afterwards, by their numbers.
    """
    from logweave.sources.sinks import materialize

    fmts = (BUILTIN_FORMATS if include_builtins else []) + list(formats or [])
    compiled = [(f, layout_pattern(f.pattern), layout_error(f.pattern)) for f in fmts]
    aggs = [F.count(F.lit(1)).alias("lines_tested")]
    for idx, (_, c, error) in enumerate(compiled):
        hit = F.col("value").rlike(c.regex) if error is None else F.lit(False)
        aggs.append(F.count_if(hit).alias(f"_m{idx}"))
        aggs.append(F.min(F.when(hit, F.col("line_number"))).alias(f"_f{idx}"))
    per_file = lines.groupBy("file_path").agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(f.format_id).alias("format_id"), F.lit(idx).alias("format_pos"),
                 F.col(f"_m{idx}").alias("lines_matched"),
                 F.col(f"_f{idx}").alias("first_matched_line"),
                 F.lit(c.regex).alias("regex"), F.lit(error).cast("string").alias("error"))
        for idx, (f, c, error) in enumerate(compiled)]))
    out = per_file.select("file_path", "lines_tested", stacked.alias("r")).select(
        "file_path", "r.format_id", "r.format_pos", "lines_tested", "r.lines_matched",
        F.when(F.col("lines_tested") > 0, F.col("r.lines_matched") / F.col("lines_tested"))
        .alias("match_ratio"),
        "r.first_matched_line", "r.regex", "r.error")
    out = materialize(out, "format-report")
    # A few numbers per file, of a size that Spark knows: only the texts of these lines leave the scan.
    winners = out.where("first_matched_line IS NOT NULL").select("file_path", "first_matched_line").distinct()
    first = lines.select("file_path", F.col("line_number").alias("first_matched_line"), "value").join(winners, ["file_path", "first_matched_line"])
    captured = F.lit(None).cast("map<string,string>")
    for f, c, error in compiled:
        if error is None:
            groups = F.array(*[F.struct(F.lit(k).alias("k"), F.regexp_extract("value", c.regex, i + 1).alias("v"))
                               for i, k in enumerate(c.fields)])
            got = F.map_from_entries(F.filter(groups, lambda g: g["v"] != "")) if c.fields else \
                F.create_map().cast("map<string,string>")
            captured = F.when((F.col("format_id") == f.format_id) & F.col("value").isNotNull(), got).otherwise(captured)
    return (out.join(first, ["file_path", "first_matched_line"], "left")
            .withColumn("captured", captured).drop("value"))


def best_format(report: DataFrame) -> DataFrame:
    """Per file, the format with most matched lines (ties: catalogue order)."""
    return (report.where(F.col("lines_matched") > 0)
            .groupBy("file_path")
            .agg(F.min_by("format_id", F.struct(-F.col("lines_matched"), F.col("format_pos")))
                 .alias("best_format_id")))

