"""Operator 7: URL filters, pattern rules indexed by their rarest literal token.

Two kinds of rules, both compiled to a regular expression over host + path:

* a place, host and path ("example.org", "/es/"): fits the host and all its
  subdomains if the path starts with the rule's; the longest that fits decides;
* a pattern, as in public block lists: "||" anchors at a domain label, "*"
  stands for anything, the rest is literal without case.  Patterns decide where
  no place fits: block if a pattern fits, else allow.

A rule's safe tokens are the runs of a-z and 0-9 in it that must be whole runs
in every URL that fits.  Each rule is indexed by the safe token that is rarest
among the URLs' own tokens; a URL's tokens fetch the rules indexed by them, by
an equality join, and only those rules run their regular expression.  A rule
without a safe token is fetched by every URL (token "").

Edge cases: a null URL, or one without "://", has an empty host and path and
gets the patterns' verdict for the empty string, allow; equal URLs are judged
once; of fitting places of equal length the one with the longer host decides,
then block; a null page_id is kept; an empty rule list allows everything.
"""

from __future__ import annotations

import json
import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "array<struct<rule:string,verdict:string,kind:string,length:int,host_length:int,regex:string,tokens:array<string>>>"


@dataclass(frozen=True)
class Place:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class Pattern:
    text: str
    verdict: str = "block"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _quoted(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", literal) if literal.isascii() else "".join(
        c if c.isalnum() else "\\" + c for c in literal)


def compile_rule(rule: Place | Pattern) -> dict:
    if isinstance(rule, Place):
        host = rule.host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        regex = r"\A(?:[^/]*\.)?" + _quoted(host) + _quoted(rule.path)
        literal, closed = "." + host + rule.path, "."
        return {"rule": rule.host + rule.path, "verdict": rule.verdict, "kind": "place", "length": len(rule.host + rule.path),
                "host_length": len(rule.host), "regex": regex, "tokens": _safe_tokens([literal])}
    text = rule.text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    anchored, pieces = text.startswith("||"), text.removeprefix("||").split("*")
    regex = ("(?i)" + (r"\A(?:[^/]*\.)?" if anchored else "") + r"[\s\S]*".join(map(_quoted, pieces)))
    if anchored:
        pieces = ["." + pieces[0], *pieces[1:]]
    return {"rule": rule.text, "verdict": rule.verdict, "kind": "pattern", "length": len(rule.text), "host_length": 0,
            "regex": regex, "tokens": _safe_tokens(pieces)}


def _safe_tokens(pieces: list[str]) -> list[str]:
    """Runs with a literal other character on both sides, so that they are whole runs of a URL, too."""
    found = {m.lower() for p in pieces for m in re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", p)}
    return sorted(found)


def rules_table(spark: SparkSession, rules: list[Place | Pattern]) -> DataFrame:
    """The caller's rules, a list on the driver, as a table."""
    text = json.dumps([compile_rule(r) for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), RULES)))


def _url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(F.concat(host, path)), F.lit("[a-z0-9]+"), F.lit(0)))


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Adds ``token`` to the rules: of their safe tokens the one that the fewest (host, path) have."""
    every = rules.select("rule", "kind", "verdict", F.explode_outer("tokens").alias("token"))
    wanted = every.select("token").where("token is not null").distinct()
    counts = (urls.select(F.explode(_url_tokens(F.col("host"), F.col("path"))).alias("token"))
              .join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")))
    rarest = (every.join(counts, "token", "left").groupBy("rule", "kind", "verdict")
              .agg(F.coalesce(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"], F.lit("")).alias("token")))
    return rules.drop("tokens").join(rarest, ["rule", "kind", "verdict"])


def judge(pages: DataFrame, rules: list[Place | Pattern]) -> DataFrame:
    """page_id, host, path, rule (the place that decides, else null), verdict and pattern (that decides, else null)."""
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path").distinct()
    index = indexed(rules_table(pages.sparkSession, rules).distinct(), urls)
    fetched = (urls.select("host", "path", F.explode(F.array_append(_url_tokens(F.col("host"), F.col("path")), F.lit(""))).alias("token"))
               .join(index, "token").where(F.rlike(F.concat("host", "path"), F.col("regex"))))
    # A URL's rules are aggregated, never gathered.
    place = F.max(F.when(F.col("kind") == "place", F.struct("length", "host_length", "verdict", "rule")))
    pattern = F.max(F.when(F.col("kind") == "pattern", F.struct("verdict", "length", "rule")))
    decided = fetched.groupBy("host", "path").agg(place.alias("place"), pattern.alias("pattern"))
    out = rows.join(decided, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("place.rule").alias("rule"),
                      F.coalesce("place.verdict", "pattern.verdict", F.lit("allow")).alias("verdict"),
                      F.when(F.col("place").isNull(), F.col("pattern.rule")).alias("pattern"))
