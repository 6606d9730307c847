"""P1 layout compiler, P10 built-in layouts, P2 parsing with a layout, P5 report."""
import re

import pytest

from logweave.operators.formats import (BUILTIN_FORMATS, DIRECTIVES, MDC_FIELDS, SKIPPED, LogFormat, best_format, format_report,
                                        layout_error, layout_to_regex)
from logweave.operators.parse import parse_entries, parse_files
from tests.conftest import lines_df

# A text for each entry field that its directives accept.
SAMPLE = {"timestamp": "2030-02-03 04:05:06,789", "level": "WARN", "logger": "ferry.deck.Ramp", "thread": "oiler-3", "message": "ramp is up",
          "tid": "42", "app_name": "cargo", "correlation_id": "f-19", "tenant_domain": "isle.example"}


def rendered(layout, values):
    """A line in a layout, with each directive's text from ``values``."""
    def text(m):
        name = m[1].lower()
        if name in SKIPPED:
            return ""
        field = MDC_FIELDS.get((m[2] or "").lower()) if name == "x" else DIRECTIVES.get(name, (None,))[0]
        return values.get(field, "other")
    return re.sub(r"%(?:-?\d+(?:\.\d+)?)?([a-zA-Z]+)(?:\{([^}]*)\})?", text, layout)


@pytest.mark.parametrize("fmt", BUILTIN_FORMATS, ids=lambda f: f.format_id)
def test_builtin_layouts_read_their_own_lines(spark, fmt):
    (row,) = parse_entries(lines_df(spark, {"f.log": rendered(fmt.pattern, SAMPLE) + "\n"}), layout=fmt.pattern).collect()
    fields = layout_to_regex(fmt.pattern).fields
    assert "message" in fields and "timestamp" in fields
    for name in SAMPLE:
        want = SAMPLE[name] if name in fields else {"level": "INFO", "logger": ""}.get(name)
        assert row[name] == want, name


@pytest.mark.parametrize("layout,fields", [
    ("%d %p %c %t %m", ("timestamp", "level", "logger", "thread", "message")),
    ("%DATE{x} %-5Level %20.30Logger %TN %Msg", ("timestamp", "level", "logger", "thread", "message")),
    ("%c %logger %class", ("logger",)),
    ("%X{Tenant.Domain} %X{CORRELATION_ID} %x{apiname} %X{deck} %X", ("tenant_domain", "correlation_id", "app_name")),
    ("%n%ex%throwable%xEx%newline%exception", ()),
    ("%rEx %pid %unheard{of}", ()),
    ("%5 %.3p 100%", ()),
    ("", ()),
])
def test_fields_of_a_layout(layout, fields):
    assert layout_to_regex(layout).fields == fields


def test_unknown_directives_take_a_token_and_skipped_ones_nothing():
    engine = lambda layout: re.compile(layout_to_regex(layout).regex.replace("(?sU)", "(?s)"))
    assert engine("%p|%rEx|%m").match("INFO|t0ken|rest")[2] == "rest"
    assert engine("%p%ex|%m").match("INFO|x") and not engine("%p%ex|%m").match("INFO boom|x")
    assert engine("(%p) [*] %c.").match("(INFO)  [*]\tferry.Deck.") and not engine("(%p).").match("(INFO)x")


def test_empty_and_blank_captures(spark):
    line = "2030-02-03 04:05:06,789 [] [  ] warn:   spaced  "
    (row,) = parse_entries(lines_df(spark, {"x.log": line}), layout="%d [%tenantId] [%appName] %p: %m").collect()
    assert (row.tid, row.app_name, row.level, row.message) == (None, "", "WARN", "spaced")


def test_a_layout_without_fields_gives_defaults(spark):
    (row,) = parse_entries(lines_df(spark, {"x.log": "### opening\n more\n"}), layout="### %n").collect()
    assert (row.level, row.logger, row.message, row.timestamp) == ("INFO", "", "\n more", None)


def files_of(spark, tmp_path):
    (tmp_path / "one.log").write_text("2030-02-03 04:05:06,789|warn|ferry.Deck|up\n|rest\n")
    (tmp_path / "two.log").write_text("2030-02-03 04:05:06,789 INFO [ferry.Hold] - full\n")
    return f"file://{tmp_path}/one.log", f"file://{tmp_path}/two.log"


def test_a_format_per_file(spark, tmp_path):
    one, two = files_of(spark, tmp_path)
    own = [LogFormat("pipes", "%d|%p|%c|%m"), LogFormat("bare", "no field")]
    ff = spark.createDataFrame([(one, "pipes"), (one, "zzz"), (two, "unheard"), (one, "pipes")], "file_path string, format_id string")
    rows = {r.file_path: r for r in parse_files(spark, str(tmp_path), file_formats=ff, formats=own).collect()}
    assert (rows[one].level, rows[one].logger_short, rows[one].message) == ("WARN", "Deck", "up\n|rest")
    assert (rows[two].level, rows[two].message) == ("INFO", "full")


def test_report(spark):
    own = [LogFormat("pipes", "#%d|%p|%c|%m"), LogFormat("never", "@@ %m")]
    df = lines_df(spark, {"a.log": "skip\n#2030-02-03 04:05:06,789|warn|ferry.Deck|up\n#2030-02-03 04:05:07,789|info|x|\n",
                          "b.log": "[2030-02-03 04:05:06,789] INFO {ferry.Hold} - full\n"})
    rep = {(r.file_path, r.format_id): r for r in format_report(df, own).collect()}
    r = rep["a.log", "pipes"]
    assert (r.lines_tested, r.lines_matched, r.first_matched_line, r.error) == (3, 2, 2, None)
    assert r.match_ratio == pytest.approx(2 / 3) and r.regex == layout_to_regex("#%d|%p|%c|%m").regex
    assert r.captured == {"timestamp": "2030-02-03 04:05:06,789", "level": "warn", "logger": "ferry.Deck", "message": "up"}
    assert (rep["a.log", "never"].lines_matched, rep["a.log", "never"].captured) == (0, None)
    assert len(rep) == 2 * (len(BUILTIN_FORMATS) + 2)
    best = {r.file_path: r.best_format_id for r in best_format(format_report(df, own)).collect()}
    assert best["a.log"] == "pipes" and best["b.log"] in ("builtin-bracket", "builtin-apim-api-log")


def test_every_layout_compiles():
    assert all(layout_error(f.pattern) is None for f in BUILTIN_FORMATS)
    assert layout_error("%m" + "(" * 3) is None  # punctuation is literal
