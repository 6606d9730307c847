"""Cross-file search (L4) and text search over any text column (F6/F7 on
long texts).

The reference loops over files one by one and stops early; here one scan
filters every file in parallel and a top-k (TakeOrderedAndProject) keeps the
first ``limit`` hits in (file order, line) order, which are the same rows.
``total`` is the exact number of hits (deviation D1), computed only on request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.filters import Criteria, filter_entries, java_regex, regex_match, text_match

DEFAULT_SEARCH_LIMIT = 100


def search_entries(entries: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False,
                   file_paths: list | None = None, levels: list | None = None,
                   limit: int = DEFAULT_SEARCH_LIMIT, file_order: DataFrame | None = None) -> DataFrame:
    """L4: the first ``limit`` matching entries across files.

    ``file_paths`` restricts the files (a semi-join by list); pass the same
    list to the reader as well so that other files are never scanned.
    ``file_order(file_path, file_order)`` gives the registration order;
    without it files are ordered by path (discovery order).
    """
    if file_paths:
        entries = entries.where(F.col("file_path").isin(list(file_paths)))
    hits = filter_entries(entries, Criteria(levels=levels, search=query, regex=regex,
                                            case_sensitive=case_sensitive))
    if file_order is not None:
        hits = hits.join(file_order.select("file_path", "file_order"), "file_path")
        order = ["file_order", "line_number"]
    else:
        order = ["file_path", "line_number"]
    out = hits.orderBy(*order).limit(limit)
    return out.drop("file_order") if file_order is not None else out


def search_lines(lines: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False,
                 file_paths: list | None = None, levels: list | None = None,
                 limit: int = DEFAULT_SEARCH_LIMIT, parse_kw: dict | None = None) -> DataFrame:
    """L4 straight from ``lines``: the level criterion selects entries before
    they are assembled (see ``filters.filter_lines``); same rows as
    ``search_entries(parse_entries(lines), ...)``."""
    from logweave.operators.filters import by_level
    from logweave.operators.parse import parse_entries
    if file_paths:
        lines = lines.where(F.col("file_path").isin(list(file_paths)))
    entries = parse_entries(lines, header_where=by_level(levels), **(parse_kw or {}))
    return search_entries(entries, query, regex, case_sensitive, None, levels, limit)


def search_total(entries: DataFrame, query: str, regex: bool = False, case_sensitive: bool = False,
                 file_paths: list | None = None, levels: list | None = None) -> int:
    """The exact number of entries ``search_entries`` draws its page from
    (an action; the reference reported an order-dependent partial count)."""
    if file_paths:
        entries = entries.where(F.col("file_path").isin(list(file_paths)))
    return filter_entries(entries, Criteria(levels=levels, search=query, regex=regex,
                                            case_sensitive=case_sensitive)).count()


def search_text(df: DataFrame, column: str, query: str, regex: bool = False,
                case_sensitive: bool = False, warnings: list | None = None) -> DataFrame:
    """F6/F7 over a whole-text column (documents, pages, ...): rows whose
    text contains ``query`` (literal) or matches it (regex search).  An invalid
    regex drops the filter, as in the reference (F7), and is put into ``warnings``."""
    if not query:
        return df
    if regex:
        pattern = java_regex(query)
        if pattern is None:
            if warnings is not None:
                warnings.append(f"invalid regex ignored: {query}")
            return df
        return df.where(regex_match([column], pattern, case_sensitive))
    return df.where(text_match([column], query, case_sensitive))
