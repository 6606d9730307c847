"""P1/P2 dialect parity: a compiled layout behaves the same in Spark's (Java)
regex engine as in Python's, on random layouts and random lines (the
reference matches with Python's engine)."""
import random
import re

from logweave.operators.formats import layout_to_regex

PIECES = ["%d", "%p", "%5p", "%-5p", "%c", "%C{1}", "%t", "%T", "%m", "%msg", "%X{correlationId}",
          "%X{tenantDomain}", "%X{apiName}", "%X{ip}", "%tenantId", "%appName", "%ex", "%n", "%foo",
          "%.30c", "[", "]", "{", "}", " - ", " ", "\t", "|", ":", "TID: ", "%%"]
VALUES = ["2031-07-04 23:59:00,700", "1999-12-01T00:10:20.25", "INFO", "ERROR", "org.a.B", "é.ß.Ç",
          "exec-1", "", " ", "x|y", "a,b", "[x]", "{y}", "-", "msg with  spaces", "\t", "ü"]


def _line(rnd, layout):
    out = []
    for tok in re.split(r"(%[-.\d]*[a-zA-Z]+(?:\{[^}]*\})?)", layout):
        if tok.startswith("%") and len(tok) > 1:
            out.append(rnd.choice(VALUES))
        else:
            out.append(tok if rnd.random() < 0.9 else tok.replace(" ", "  "))
    return "".join(out)


def test_java_and_python_agree(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(60):
        layout = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 8)))
        c = layout_to_regex(layout)
        if c is None:
            continue
        for _ in range(8):
            rows.append((c.regex, len(c.fields), _line(rnd, layout)))
    df = spark.createDataFrame(rows, "rx string, n int, value string")
    got = df.selectExpr(
        "rx", "n", "value", "value RLIKE rx AS hit",
        "CASE WHEN value RLIKE rx AND n > 0 THEN transform(sequence(1, n), i -> regexp_extract(value, rx, i)) "
        "END AS groups").collect()
    hits = 0
    for r in got:
        m = re.compile(r.rx.replace("(?sU)", "(?s)")).match(r.value)
        assert (m is not None) == r.hit, (r.rx, r.value)
        if m is not None and r.n:
            hits += 1
            assert list(m.groups()) == list(r.groups), (r.rx, r.value)
    assert hits > 20
