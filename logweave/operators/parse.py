"""Lines -> entries.

``lines(file_path, line_number, value)`` is the contract every parser reads.
A line is a *header* when a header regex matches it (the auto regexes, a
layout's regex, or the file's own format), a *stack* line when the stack
regex matches, a *continuation* when it has non-blank text, and is dropped
when blank.  Lines before a file's first header are dropped.

No window ever spans a whole file: ordering work is done per
``(file_path, chunk)`` with ``chunk = line_number div chunk_lines`` (see
``functions.ordered``), so a file holding a third of all lines still spreads
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.ordered import chunked_running
from logweave.functions.text import sql_py_strip, sql_str, sql_timestamp_ms
from logweave.operators.assemble import BLANK, HEADER, MORE, PIECES, STACK, split_pieces, split_table, stitched
from logweave.operators.formats import (ENTRY_FIELDS, LogFormat, format_catalog,
                                        layout_to_regex)
from logweave.sources.paths import listed_path

# ----------------------------------------------------------------- fixed values
# Header regexes of the auto formats, tried in this order on every line, and
# the stack-line regex.  (?s) makes '.' match any character, (?U) gives
# \w \s \d their Unicode meaning.
TID_RE = (r"(?sU)^TID:\s*\[([^\]]*)\]\s*\[([^\]]*)\]\s*"
          r"\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d+)\]\s+(\w+)\s+\{([^}]+)\}\s+-\s+(.*)")
BRACKET_RE = r"(?sU)^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d+)\]\s+(\w+)\s+\{([^}]+)\}\s+-\s+(.*)"
BASIC_RE = r"(?sU)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d+)\s+(\w+)\s+\[([^\]]+)\]\s+-\s+(.*)"
STACK_RE = r"(?U)^\s+at |^Caused by:|^\s+\.\.\.|^java\.|^\s+Suppressed:"
AUTO_KINDS = ["tid", "bracket", "basic"]
DEFAULT_DETECTED = "tid"

# auto format -> (regex, {field: group})
AUTO_PARSERS = {
    "tid": (TID_RE, {"tid": 1, "app_name": 2, "timestamp": 3, "level": 4, "logger": 5, "message": 6}),
    "bracket": (BRACKET_RE, {"timestamp": 1, "level": 2, "logger": 3, "message": 4}),
    "basic": (BASIC_RE, {"timestamp": 1, "level": 2, "logger": 3, "message": 4}),
}

# What a line must begin with before its regex is tried: the regexes' own first character (a digit of any script for
# the last), so that most continuation and stack lines cost no header regex.
AUTO_GUARDS = {
    "tid": "startswith(value, 'TID:') AND ",
    "bracket": "startswith(value, '[') AND ",
    "basic": "value >= '0' AND (value < ':' OR value >= '\u0080') AND ",
}

CHUNK_LINES = 1 << 18

ENTRY_COLUMNS = ["file_path", "line_number", "raw", "timestamp", "timestamp_ms", "level",
                 "logger", "logger_short", "message", "thread", "tenant_domain", "tid",
                 "app_name", "correlation_id", "stack_trace", "has_stack_trace"]

# ----------------------------------------------------------------- header parsers
# The per-line expression is built as SQL text (one JVM call) rather than
# through hundreds of Column calls; it is the same Catalyst expression.

class _Parser:
    """One header regex and how its groups become entry fields."""

    def __init__(self, regex: str, groups: dict, layout: bool, guard: str = ""):
        self.regex, self.groups, self.layout, self.guard = regex, groups, layout, guard

    def matches_sql(self) -> str:
        return f"{self.guard}value RLIKE {sql_str(self.regex)}"

    def groups_sql(self, value: str) -> str:
        """All captured groups of the header regex as one array.  A lambda
        keeps the generated code small (a huge projection method would not
        be JIT-compiled by the JVM)."""
        if not self.groups:  # a layout without a field
            return "CAST(array() AS ARRAY<STRING>)"
        n = max(self.groups.values())
        return f"transform(sequence(1, {n}), i -> regexp_extract({value}, {sql_str(self.regex)}, i))"

    def fields_sql(self, g: str) -> dict:
        """Entry fields from the group array ``g``."""
        raw = {f: f"get({g}, {i - 1})" for f, i in self.groups.items()}
        out = {}
        if self.layout:
            # a captured empty text is null, a blank-only capture is ''
            got = {f: f"CASE WHEN {c} = '' THEN NULL ELSE {sql_py_strip(c)} END" for f, c in raw.items()}
            for f in ENTRY_FIELDS:
                out[f] = got.get(f, "CAST(NULL AS STRING)")
            out["level"] = f"upper(coalesce(nullif({out['level']}, ''), 'INFO'))"
            out["logger"] = f"coalesce({out['logger']}, '')"
            out["message"] = f"coalesce({out['message']}, '')"
        else:
            for f in ENTRY_FIELDS:
                out[f] = sql_py_strip(raw[f]) if f in raw else "CAST(NULL AS STRING)"
            out["level"] = f"upper({out['level']})"
            out["tid"] = f"nullif({out['tid']}, '')"
            out["app_name"] = f"nullif({out['app_name']}, '')"
        return out


def _layout_parser(pattern: str) -> _Parser | None:
    c = layout_to_regex(pattern)
    if c is None:
        return None
    return _Parser(c.regex, {f: i + 1 for i, f in enumerate(c.fields)}, layout=True)


def _auto_parsers() -> list[_Parser]:
    return [_Parser(rx, groups, False, AUTO_GUARDS[kind]) for kind, (rx, groups) in AUTO_PARSERS.items()]


class _HeaderPlan:
    """Which parsers apply, as SQL: ``hk`` (index of the parser that
    recognises a line, else null) and the header struct built from a line's
    text and that index."""

    def __init__(self, layout: str | None, format_col: str | None, formats: list[LogFormat] | None):
        parsers: list[_Parser] = []
        if layout is not None:
            p = _layout_parser(layout)
            choices = [(None, p)] if p is not None else []
            fallback_auto = p is None
        else:
            choices = []
            fallback_auto = True
            if format_col is not None:
                for fid, fmt in format_catalog(formats).items():
                    p = _layout_parser(fmt.pattern)
                    if p is not None:
                        choices.append((fid, p))
        whens = []
        for fid, p in choices:
            parsers.append(p)
            cond = p.matches_sql()
            if fid is not None:
                cond = f"`{format_col}` = {sql_str(fid)} AND {cond}"
            whens.append(f"WHEN {cond} THEN {len(parsers) - 1}")
        if fallback_auto:
            known = ""
            if format_col is not None and choices:
                ids = ", ".join(sql_str(fid) for fid, _ in choices)
                known = f"coalesce(NOT `{format_col}` IN ({ids}), true) AND "
            for p in _auto_parsers():
                parsers.append(p)
                whens.append(f"WHEN {known}{p.matches_sql()} THEN {len(parsers) - 1}")
        self.parsers = parsers
        self.hk = f"CASE {' '.join(whens)} END" if whens else "CAST(NULL AS INT)"

    def groups(self, value: str, hk: str) -> str:
        """SQL of the captured-group array of the parser ``hk`` chose."""
        if not self.parsers:
            return "CAST(NULL AS ARRAY<STRING>)"
        cases = " ".join(f"WHEN {k} THEN {p.groups_sql(value)}" for k, p in enumerate(self.parsers))
        return f"CASE {hk} {cases} END"

    def header(self, g: str, hk: str) -> str:
        """SQL of the header struct from the group array ``g``."""
        per_parser = [p.fields_sql(g) for p in self.parsers]
        members = []
        for f in ENTRY_FIELDS:
            if per_parser:
                cases = " ".join(f"WHEN {k} THEN {fields[f]}" for k, fields in enumerate(per_parser))
                members.append(f"'{f}', CASE {hk} {cases} END")
            else:
                members.append(f"'{f}', CAST(NULL AS STRING)")
        return f"CASE WHEN {hk} IS NOT NULL THEN named_struct({', '.join(members)}) END"

    def add_header(self, df: DataFrame, value: str, hk: str, out: str) -> DataFrame:
        """Two projections: group array first (kept apart: it is used many
        times), then the struct."""
        return (df.selectExpr("*", f"{self.groups(value, hk)} AS _groups")
                .selectExpr("*", f"{self.header('_groups', hk)} AS {out}").drop("_groups"))


KIND_SQL = (f"CASE WHEN _hk IS NOT NULL THEN 'h' WHEN value RLIKE {sql_str(STACK_RE)} THEN 's' "
            f"WHEN {sql_py_strip('value')} <> '' THEN 'c' END")


def _classify(lines: DataFrame, plan: _HeaderPlan) -> DataFrame:
    """``_hk``, ``is_header`` and ``kind`` per line (regexes run once)."""
    return (lines.selectExpr("*", f"{plan.hk} AS _hk")
            .selectExpr("*", "_hk IS NOT NULL AS is_header", f"{KIND_SQL} AS kind"))


def parse_lines(lines: DataFrame, layout: str | None = None, format_col: str | None = None,
                formats: list[LogFormat] | None = None) -> DataFrame:
    """Add ``kind`` ('h' header, 's' stack, 'c' continuation, null
    blank), ``is_header`` and, on header rows, a ``header`` struct of entry
    fields.

    * ``layout`` given: every file is parsed with that log4j2 layout (P2).
    * ``format_col`` given: each row's format id (built-in or from
      ``formats``) selects its layout; a null, unknown or uncompilable id
      falls back to auto parsing (S5).
    * otherwise auto parsing (P3): TID, then bracket, then basic, on every line.
    """
    plan = _HeaderPlan(layout, format_col, formats)
    return plan.add_header(_classify(lines, plan), "value", "_hk", "header").drop("_hk")


# ----------------------------------------------------------------- P7 assembly

def assemble_entries(parsed: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """P7 on the output of ``parse_lines`` (lines with ``kind``, ``is_header``
    and the ``header`` struct)."""
    return _assemble(parsed.withColumnRenamed("header", "_hdr"), chunk_lines,
                     lambda e: e.selectExpr("*", "h.hdr AS hd"))


def _assemble(x: DataFrame, chunk_lines: int, header_of, keep: str | None = None) -> DataFrame:
    """Multi-line entries from classified lines.

    Plan: (1) ``entry_line`` = line number of the last header at or before
    the line, by a running max inside ``(file_path, chunk)`` partitions plus a
    carry from earlier chunks (one row per chunk, from a cheap header-only
    pass); (2) one aggregation by ``(file_path, entry_line)``.  Its map-side
    (partial) step already builds each entry inside the partition of its
    chunk, so the second exchange moves entries, not lines, and an entry cut
    by a chunk edge is merged by the final step.  ``message``/``stack_trace``
    come from ``collect_list``; queries that use neither get it pruned.
    ``header_of(e)`` adds the header struct ``hd`` to the aggregated entries
    (column ``h`` holds the header line ``raw`` and the per-line ``hdr``).

    ``keep`` (SQL over a header row, optional) selects entries before the
    aggregation: header line numbers increase, so the running max of
    ``line_number * 2 + keep`` carries both the entry and whether its header
    passed; lines of other entries never reach the aggregation shuffle.
    """
    # Blank lines stay in until after the window, so no filter on ``kind`` is
    # pushed below it (that would evaluate the regexes twice per line).  The
    # carry pass of ``chunked_running`` only needs ``is_header`` (the header
    # regexes); everything else is pruned from it.
    flag = f"CASE WHEN coalesce({keep}, false) THEN 1 ELSE 0 END" if keep else "1"
    x = x.selectExpr(
        "coalesce(file_path, '') AS file_path", "line_number", "value", "kind", "_hdr",
        f"coalesce(floor(line_number / {int(chunk_lines)}), -1) AS _chunk",
        f"CASE WHEN is_header THEN line_number * 2 + {flag} END AS _hline")
    x = chunked_running(x, ["file_path"], "_chunk", "line_number", "_hline", "max", "_entry_key")
    # orphans, blank lines and (with ``keep``) entries whose header failed
    x = (x.where("_entry_key IS NOT NULL AND kind IS NOT NULL AND _entry_key % 2 = 1")
         .selectExpr("*", "_entry_key DIV 2 AS entry_line").drop("_entry_key"))

    return _entries_from(x, header_of)


def _entries_from(x: DataFrame, header_of) -> DataFrame:
    """Aggregate lines that carry ``entry_line`` into entries."""
    e = x.groupBy("file_path", "entry_line").agg(
        F.expr("max(CASE WHEN kind = 'h' THEN named_struct('raw', value, 'hdr', _hdr) END)").alias("h"),
        F.expr("collect_list(CASE WHEN kind <> 'h' THEN named_struct('line_number', line_number, "
               "'kind', kind, 'value', value) END)").alias("body"),
        F.expr("max(kind = 's')").alias("has_stack"),
    )
    e = header_of(e).selectExpr("file_path", "entry_line", "h.raw AS raw", "hd", "array_sort(body) AS body",
                                "has_stack")
    return e.selectExpr(
        "file_path",
        "entry_line AS line_number",
        "raw",
        "hd.timestamp AS timestamp",
        f"{sql_timestamp_ms('hd.timestamp')} AS timestamp_ms",
        "hd.level AS level",
        "hd.logger AS logger",
        "substring_index(hd.logger, '.', -1) AS logger_short",
        "concat_ws('\\n', hd.message, "
        "transform(filter(body, b -> b.kind = 'c'), b -> b.value)) AS message",
        "hd.thread AS thread",
        "hd.tenant_domain AS tenant_domain",
        "hd.tid AS tid",
        "hd.app_name AS app_name",
        "hd.correlation_id AS correlation_id",
        "CASE WHEN has_stack THEN transform(filter(body, b -> b.kind = 's'), b -> b.value) END "
        "AS stack_trace",
        "has_stack AS has_stack_trace",
    )


HEADER_COLUMNS = ["timestamp", "level", "logger", "logger_short", "thread", "tenant_domain", "tid", "app_name",
                  "correlation_id"]


def parse_entries(lines: DataFrame, layout: str | None = None, format_col: str | None = None,
                  formats: list[LogFormat] | None = None, chunk_lines: int = CHUNK_LINES,
                  header_where=None) -> DataFrame:
    """Lines -> ``entries`` (schema ``ENTRY_COLUMNS``).

    Only the index of the matching header parser travels with a header line
    through the shuffles; the header fields are extracted once per entry
    after the final aggregation (less shuffle volume, same regexes).

    ``header_where``: a Column over header-only entry columns
    (``HEADER_COLUMNS``: level, logger, timestamp, ...) that selects entries
    *before* assembly; only the fields it uses are extracted map-side, and
    the lines of other entries are dropped ahead of the shuffle.
    """
    plan = _HeaderPlan(layout, format_col, formats)
    x = _classify(lines, plan).withColumnRenamed("_hk", "_hdr")
    keep = None
    if header_where is not None:
        x = plan.add_header(x, "value", "_hdr", "_hh")
        x = x.select("*", *[F.col(f"_hh.{c}").alias(c) for c in HEADER_COLUMNS if c != "logger_short"],
                     F.substring_index(F.col("_hh.logger"), ".", -1).alias("logger_short"))
        x = x.withColumn("_keep", header_where).drop("_hh", *HEADER_COLUMNS)
        keep = "_keep"
    return _assemble(x, chunk_lines, lambda e: plan.add_header(e, "h.raw", "h.hdr", "hd"), keep)


def header_entries(lines: DataFrame, layout: str | None = None, format_col: str | None = None,
                   formats: list[LogFormat] | None = None) -> DataFrame:
    """``file_path``, ``line_number`` and ``HEADER_COLUMNS`` of every entry,
    from its header line alone: one pass over the lines, no shuffle.  All that
    grouping and counting by header fields needs; what a line's text is used
    for ends in the scan's own tasks."""
    plan = _HeaderPlan(layout, format_col, formats)
    x = lines.selectExpr("coalesce(file_path, '') AS file_path", "line_number", "value", f"{plan.hk} AS _hk"
                         ) if format_col is None else \
        lines.selectExpr("coalesce(file_path, '') AS file_path", "line_number", "value", f"`{format_col}`", f"{plan.hk} AS _hk")
    x = plan.add_header(x.where("_hk IS NOT NULL"), "value", "_hk", "_hd")
    return x.select("file_path", "line_number", *[
        F.substring_index(F.col("_hd.logger"), ".", -1).alias(c) if c == "logger_short" else F.col(f"_hd.{c}").alias(c)
        for c in HEADER_COLUMNS])


def stack_entries(lines: DataFrame, layout: str | None = None, format_col: str | None = None,
                  formats: list[LogFormat] | None = None, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """(file_path, line_number) of the entries with a stack trace.  Only the
    numbers and kinds of header and stack lines are shuffled, no text."""
    x = _classify(lines, _HeaderPlan(layout, format_col, formats)).selectExpr(
        "coalesce(file_path, '') AS file_path", "line_number", "kind",
        f"coalesce(floor(line_number / {int(chunk_lines)}), -1) AS _chunk",
        "CASE WHEN kind = 'h' THEN line_number END AS _hline")
    x = chunked_running(x, ["file_path"], "_chunk", "line_number", "_hline", "max", "_entry")
    return x.where("kind = 's' AND _entry IS NOT NULL").select("file_path", F.col("_entry").alias("line_number")).distinct()


# ----------------------------------------------------------------- S1 + P7 on files

def one_format_per_file(file_formats: DataFrame) -> DataFrame:
    """(file_path, _format_id): a file that is listed twice takes its smallest format id."""
    return file_formats.groupBy(listed_path("file_path").alias("file_path")).agg(F.min("format_id").alias("_format_id"))


def parse_files(spark, paths, layout: str | None = None, recursive: bool = False,
                glob: str | None = None, file_formats: DataFrame | None = None,
                formats: list[LogFormat] | None = None) -> DataFrame:
    """Text files -> entries, reading the text once.

    Lines are classified and assembled into entries inside the reader's
    splits (``operators.assemble``), stored below ``spark.checkpoint.dir``
    (eager), and numbered by the lines of the splits before theirs; only the
    edges of the splits are shuffled.  Same result as
    ``parse_entries(read_lines(...))``.

    ``file_formats(file_path, format_id)`` chooses a format per file (S5;
    built-ins or ``formats``, unknown or null ids parse automatically); a file
    listed twice takes the smallest id.
    """
    from logweave.sources.lines import _scan

    return parse_scanned(_scan(spark, paths, recursive, glob), layout, file_formats, formats)


def parse_scanned(scan: DataFrame, layout: str | None = None, file_formats: DataFrame | None = None,
                  formats: list[LogFormat] | None = None) -> DataFrame:
    """``parse_files`` on a scan ``(file_path, _block, _id, value)`` taken
    straight from a text source (ids from ``monotonically_increasing_id()``
    before any shuffle)."""
    from logweave.sources.sinks import materialize

    if file_formats is not None:
        scan = _with_formats(scan, file_formats)
    plan = _HeaderPlan(layout, None if file_formats is None else "_format_id", formats)
    kind = (f"CAST(CASE WHEN _hk IS NOT NULL THEN {HEADER} WHEN value RLIKE {sql_str(STACK_RE)} THEN {STACK} "
            f"WHEN {sql_py_strip('value')} <> '' THEN {MORE} ELSE {BLANK} END AS TINYINT)")
    lines = scan.selectExpr("*", f"CAST({plan.hk} AS INT) AS _hk").selectExpr("file_path", "_block", "_id", "_hk", f"{kind} AS _kind", "value")
    pieces = materialize(lines.mapInArrow(split_pieces, PIECES), "entry-pieces", partition_by=["_whole"])
    # Fields are cut out of the stored header lines: they are no further copy of the text, and unused ones cost nothing.
    pieces = plan.add_header(pieces, "raw", "_hk", "hd").drop("_hk")
    edges = pieces.where("NOT _whole")
    splits = materialize(split_table(edges), "splits")
    # One row per split: Spark broadcasts it by its stored size, and the whole entries stay where they are.
    whole = pieces.where("_whole").join(splits, ["file_path", "_block"]).selectExpr(
        "file_path", "_before + _at + 1 AS line_number", "raw", "hd", "more", "stack")
    return whole.unionByName(stitched(edges, splits)).selectExpr(
        "file_path", "line_number", "raw", "hd.timestamp AS timestamp", f"{sql_timestamp_ms('hd.timestamp')} AS timestamp_ms",
        "hd.level AS level", "hd.logger AS logger", "substring_index(hd.logger, '.', -1) AS logger_short",
        "concat_ws('\\n', hd.message, more) AS message", "hd.thread AS thread", "hd.tenant_domain AS tenant_domain",
        "hd.tid AS tid", "hd.app_name AS app_name", "hd.correlation_id AS correlation_id",
        "CASE WHEN size(stack) > 0 THEN stack END AS stack_trace", "size(stack) > 0 AS has_stack_trace")


#: Files whose formats go to every task at most; the rows are paths and format ids.
BROADCAST_FILES = 100_000


def _with_formats(scan: DataFrame, file_formats: DataFrame) -> DataFrame:
    """``_format_id`` beside each line, the lines of a split still together and in order."""
    from logweave.sources.sinks import materialize

    chosen = materialize(one_format_per_file(file_formats), "file-formats")
    if chosen.count() <= BROADCAST_FILES:
        return scan.join(F.broadcast(chosen), "file_path", "left")
    return (scan.join(chosen, "file_path", "left").repartition("file_path", "_block")
            .sortWithinPartitions("file_path", "_block", "_id"))


# ----------------------------------------------------------------- P4 detection

def detect_format(lines: DataFrame, window: int = 30) -> DataFrame:
    """Per file, the auto format of the first header-like line among the
    first ``window`` physical lines (blank lines skipped); 'tid' if none."""
    value = F.col("value")
    kind = (F.when(value.rlike(TID_RE), F.lit(0))
            .when(value.rlike(BRACKET_RE), F.lit(1))
            .when(value.rlike(BASIC_RE), F.lit(2)))
    # (line, kind) packed into one long so the aggregate stays a hash aggregate
    first = (lines.where(F.col("line_number") <= window)
             .groupBy("file_path")
             .agg(F.min(F.when(kind.isNotNull(), F.col("line_number") * 4 + kind)).alias("_first")))
    k = F.col("_first") % 4
    name = None
    for i, kind_name in enumerate(AUTO_KINDS):
        name = F.when(k == i, F.lit(kind_name)) if name is None else name.when(k == i, F.lit(kind_name))
    return first.select("file_path", name.otherwise(F.lit(DEFAULT_DETECTED)).alias("format"))
