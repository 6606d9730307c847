"""Entry predicates (F1-F9) and paging (L1, L2).

Every predicate is a Column; ``filter_entries`` ANDs the given ones into a
single ``where`` (cheap predicates first: Catalyst keeps the written order
inside one Filter and stops at the first false conjunct).  Empty/None
criteria are not applied, as in the reference.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The levels of the "errors only" view.
ERROR_LEVELS = ["ERROR", "FATAL"]


def by_level(levels) -> Column | None:
    """level in the requested set (request is case-insensitive)."""
    if not levels:
        return None
    return F.col("level").isin(sorted({lv.upper() for lv in levels}))


def by_component(names) -> Column | None:
    """exact match on the short or the full logger name."""
    if not names:
        return None
    names = sorted(set(names))
    return F.col("logger_short").isin(names) | F.col("logger").isin(names)


def by_correlation(correlation_id) -> Column | None:
    """correlation id equality."""
    if not correlation_id:
        return None
    return F.col("correlation_id") == F.lit(correlation_id)


def by_stack(has_stack_trace) -> Column | None:
    """tri-state stack-trace filter."""
    if has_stack_trace is None:
        return None
    return F.col("has_stack_trace") == F.lit(bool(has_stack_trace))


def by_time(time_from=None, time_to=None) -> Column | None:
    """inclusive string range on ``timestamp``; entries without a
    timestamp always pass."""
    if not time_from and not time_to:
        return None
    ts = F.col("timestamp")
    cond = F.lit(True)
    if time_from:
        cond = cond & (ts >= F.lit(time_from))
    if time_to:
        cond = cond & (ts <= F.lit(time_to))
    return ts.isNull() | (ts == F.lit("")) | cond


def text_match(cols, query: str, case_sensitive: bool = False) -> Column:
    """Literal substring in any of ``cols`` (never a LIKE pattern)."""
    q = query if case_sensitive else query.lower()
    preds = [(F.col(c) if case_sensitive else F.lower(F.col(c))).contains(F.lit(q)) for c in cols]
    return reduce(lambda a, b: a | b, preds)


def java_regex(pattern: str) -> str | None:
    """A search pattern, written for Python's engine, in Java's dialect; None
    if Python's engine rejects it.  Named groups and references to them are
    rewritten; what only one of the two engines knows otherwise (conditional
    groups, ``\\Z``'s line-end rule) is left as it is, and a pattern that Java
    then rejects fails the query instead of passing for no filter."""
    try:
        names = re.compile(pattern).groupindex
    except re.error:
        return None
    # Java's group names are letters and digits only
    alias = {name: f"g{number}" for name, number in names.items()}

    def rewritten(m: re.Match) -> str:
        if m["skip"]:
            return m["skip"]
        return f"(?<{alias[m['name']]}>" if m["name"] else f"\\k<{alias[m['ref']]}>"

    return re.sub(r"(?P<skip>\\.|\[\^?\]?(?:\\.|[^\]\\])*\])|\(\?P<(?P<name>\w+)>|\(\?P=(?P<ref>\w+)\)", rewritten, pattern, flags=re.S)


def regex_match(cols, pattern: str, case_sensitive: bool = False) -> Column:
    """Regex search (not a full match) in any of ``cols``; ``pattern`` in Java's dialect."""
    flags = "(?U)" if case_sensitive else "(?iU)"
    preds = [F.col(c).rlike(flags + pattern) for c in cols]
    return reduce(lambda a, b: a | b, preds)


def by_text(query, case_sensitive: bool = False) -> Column | None:
    """substring in ``message`` or ``raw`` (not in the stack trace)."""
    if not query:
        return None
    return text_match(["message", "raw"], query, case_sensitive)


def by_regex(query, case_sensitive: bool = False, warnings: list | None = None) -> Column | None:
    """regex search in ``message`` or ``raw``.  A pattern that Python's
    engine rejects drops the filter (reference behaviour) and is reported in
    ``warnings``; no other failure does."""
    if not query:
        return None
    pattern = java_regex(query)
    if pattern is None:
        if warnings is not None:
            warnings.append(f"invalid regex ignored: {query}")
        return None
    return regex_match(["message", "raw"], pattern, case_sensitive)


@dataclass
class Criteria:
    """The filter request (all optional)."""
    levels: list | None = None
    components: list | None = None
    search: str | None = None
    regex: bool = False
    case_sensitive: bool = False
    correlation_id: str | None = None
    has_stack_trace: bool | None = None
    time_from: str | None = None
    time_to: str | None = None
    warnings: list = field(default_factory=list)

    @classmethod
    def from_query(cls, text: str, errors_only: bool = False, **kw) -> "Criteria":
        """the viewer's query syntax: ``/…/`` (longer than 2) is a regex,
        anything else a literal; ``errors_only`` selects ERROR and FATAL."""
        c = cls(**kw)
        if text:
            if len(text) > 2 and text.startswith("/") and text.endswith("/"):
                c.search, c.regex = text[1:-1], True
            else:
                c.search, c.regex = text, False
        if errors_only:
            c.levels = list(ERROR_LEVELS)
        return c


def predicate(c: Criteria) -> Column | None:
    """F8: AND of F1-F7, cheap predicates first."""
    preds = [by_level(c.levels), by_stack(c.has_stack_trace), by_correlation(c.correlation_id),
             by_component(c.components), by_time(c.time_from, c.time_to)]
    if c.search:
        preds.append(by_regex(c.search, c.case_sensitive, c.warnings) if c.regex
                     else by_text(c.search, c.case_sensitive))
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else None


def date_partition_filter(time_from=None, time_to=None, column: str = "log_date") -> Column | None:
    """On stored entries (``sinks.write_entries``): the date-directory
    predicate implied by a time range, so that Spark prunes partitions.  A
    timestamp >= ``time_from`` has a date prefix >= ``time_from[:10]`` (and
    likewise for ``time_to``); entries without a date (``unknown``) are kept
    for the exact predicate, which also lets them pass."""
    if not time_from and not time_to:
        return None
    d = F.col(column)
    cond = F.lit(True)
    if time_from:
        cond = cond & (d >= F.lit(time_from[:10]))
    if time_to:
        cond = cond & (d <= F.lit(time_to[:10]))
    return cond | (d == F.lit("unknown"))


def filter_entries(entries: DataFrame, criteria: Criteria | None = None, **kw) -> DataFrame:
    """F8: entries matching all given criteria (unpaged, file order kept by
    ``page``).  On stored entries a time range also prunes date partitions."""
    c = criteria or Criteria(**kw)
    p = predicate(c)
    if p is not None and "log_date" in entries.columns:
        part = date_partition_filter(c.time_from, c.time_to)
        if part is not None:
            p = part & p
    return entries if p is None else entries.where(p)


def header_predicate(c: Criteria) -> Column | None:
    """The part of F8 that only needs header fields (level, logger,
    correlation id, time range); text and stack criteria need the whole entry."""
    preds = [by_level(c.levels), by_correlation(c.correlation_id), by_component(c.components),
             by_time(c.time_from, c.time_to)]
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else None


def filter_lines(lines: DataFrame, criteria: Criteria | None = None, parse_kw: dict | None = None,
                 **kw) -> DataFrame:
    """F8 straight from ``lines``: the header criteria select entries before
    they are assembled (the lines of other entries never reach the assembly
    shuffle), the rest is applied to the assembled entries.  Same rows as
    ``filter_entries(parse_entries(lines), criteria)``."""
    from logweave.operators.parse import parse_entries
    c = criteria or Criteria(**kw)
    entries = parse_entries(lines, header_where=header_predicate(c), **(parse_kw or {}))
    return filter_entries(entries, c)


def errors_only(entries: DataFrame) -> DataFrame:
    """ERROR and FATAL entries."""
    return entries.where(by_level(ERROR_LEVELS))


def page(entries: DataFrame, offset: int = 0, limit: int = 200,
         order=("file_path", "line_number"), after: tuple | None = None) -> DataFrame:
    """L1/L2: one page in file order.  Spark plans ``orderBy + offset +
    limit`` as a top-k (TakeOrderedAndProject), not a full sort, of
    ``offset + limit`` rows per task.

    ``after``: the ``order`` values of the row before the page (the last one of
    the page before).  The page then costs ``limit`` rows per task however
    deep it is, and the condition reaches the scan."""
    if after is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, value in zip(order, after, strict=True):
            beyond = beyond | (equal & (F.col(name) > F.lit(value)))
            equal = equal & (F.col(name) == F.lit(value))
        # the first condition alone is what a scan can use
        entries = entries.where((F.col(order[0]) >= F.lit(after[0])) & beyond)
    return entries.orderBy(*order).offset(offset).limit(limit) if offset else \
        entries.orderBy(*order).limit(limit)


def page_with_total(entries: DataFrame, offset: int = 0, limit: int = 200):
    """The page and the total number of matching entries (two actions over
    the same plan; cache ``entries`` first when it is reused)."""
    return page(entries, offset, limit), entries.count()
