"""Entries that are rendered to lines come back from the parser."""
import random
from datetime import datetime, timezone

import pytest

from logweave.functions.text import timestamp_ms
from logweave.operators.parse import (ENTRY_COLUMNS, HEADER_COLUMNS, assemble_entries, detect_format, header_entries, parse_entries,
                                      parse_lines, stack_entries)
from tests.conftest import lines_df
from tests.logmodel import Entry, some_log


def parse(spark, *lines, **kw):
    return sorted(parse_entries(lines_df(spark, {"quay.log": "\n".join(lines) + "\n"}), **kw).collect(), key=lambda r: r.line_number)


def check(row, entry, shape=None):
    assert (row.timestamp, row.level, row.logger) == (entry.stamp, entry.level, entry.logger)
    assert row.logger_short == entry.logger.split(".")[-1]
    assert row.message == "\n".join([entry.text, *entry.more])
    assert row.has_stack_trace is bool(entry.stack) and row.stack_trace == (entry.stack or None)
    if shape:
        assert row.raw == entry.header(shape)
        assert (row.tid, row.app_name) == ((entry.tenant or None, entry.app or None) if shape == "tid" else (None, None))


@pytest.mark.parametrize("shape", ["tid", "bracket", "basic"])
def test_one_header(spark, shape):
    entry = Entry(3661, "WARN", "tide.gauge.Float", "level {9} at - pier", tenant="7", app="quay")
    (row,) = parse(spark, entry.header(shape))
    check(row, entry, shape)
    assert row.asDict().keys() == set(ENTRY_COLUMNS)
    assert row.timestamp_ms == int(datetime(2031, 7, 4, 1, 1, 1, tzinfo=timezone.utc).timestamp()) * 1000 + 661


@pytest.mark.parametrize("chunk_lines", [3, 1 << 18])
def test_rendered_logs_come_back(spark, chunk_lines):
    rng = random.Random(41)
    logs = {f"log{k}.txt": some_log(rng, size) for k, size in enumerate([0, 1, 9, 30, 30])}
    df = lines_df(spark, {p: "\n".join(lines) + ("\n" if lines else "") for p, (lines, _) in logs.items()})
    rows = {(r.file_path, r.line_number): r for r in assemble_entries(parse_lines(df), chunk_lines=chunk_lines).collect()}
    assert set(rows) == {(p, n) for p, (_, found) in logs.items() for n in found}
    for (p, n), row in rows.items():
        check(row, logs[p][1][n])


def test_headers_alone_and_entries_agree(spark):
    lines, found = some_log(random.Random(4), 40)
    df = lines_df(spark, {"a.log": "\n".join(lines) + "\n"})
    whole = {r.line_number: r for r in parse_entries(df).collect()}
    heads = header_entries(df).collect()
    assert {r.line_number for r in heads} == set(found)
    assert all(r[c] == whole[r.line_number][c] for r in heads for c in HEADER_COLUMNS)
    assert {r.line_number for r in stack_entries(df, chunk_lines=5).collect()} == {n for n, e in found.items() if e.stack}


def test_which_lines_are_stack_lines(spark):
    first = Entry(1, "ERROR", "harbour.Gate", "stuck")
    stack = ["\tat gate.Hinge.turn(Hinge.java:4)", "Caused by: rust", " ... 2 more", "java.io.IOException: wet", "  Suppressed: salt"]
    rest = ["at the pier", " Caused by: wind", "javax.X", "...", "Suppressed: no"]
    (row,) = parse(spark, first.header("basic"), *rest[:2], *stack, "   ", *rest[2:])
    assert row.stack_trace == stack and row.message == "\n".join(["stuck", *rest])


def test_detected_format_is_that_of_the_first_header_in_thirty_lines(spark):
    e = Entry(5, "INFO", "Lamp", "lit")
    files = {s: "\n\nnote\n" + e.header(s) + "\n" + e.header("basic") for s in ("tid", "bracket", "basic")}
    files |= {"none": "nothing here", "late": "\n" * 30 + e.header("bracket"), "last": "\n" * 29 + e.header("bracket")}
    got = {r.file_path: r.format for r in detect_format(lines_df(spark, files)).collect()}
    assert got == {"tid": "tid", "bracket": "bracket", "basic": "basic", "none": "tid", "late": "tid", "last": "bracket"}


def test_timestamp_ms(spark):
    cases = {"1970-01-02 00:00:00,007": 86400007, "1970-01-01 00:00:01.25": 1250, "1970-01-01 00:00:00,123456": 123,
             "1970-01-01T00:00:00,1": None, "1970-02-30 00:00:00,1": None, "1970-01-01 00:00:00,1234567": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.ms for r in df.select("t", timestamp_ms("t").alias("ms")).collect()} == cases
