r"""Operator 13: quality rules with risk-controlled thresholds, in native expressions.

Base statistics of a whole text (words are ``[^\x20\x09-\x0D]+``): words,
their code points, symbols ``[#*$%&|<>]``, lines with a word that equal an
earlier line, and words in windows of three words that occur twice or more in
the text (every word once, the first occurrence's included).

A rule rejects a document whose ratio of two statistics is above a cutoff.
Its cutoffs are a fixed grid; which one holds is decided for each stratum (a
language, null is one of its own) by the labelled documents of quality 1 that
pass the base rules.  Of n such documents a cutoff rejects k; the cutoff is
certified if the exact binomial tail P(Bin(n, r) <= k) is at most
``error / (strata * rules)``, where r is the rule's share ``risk / rules`` of
the risk.  The strictest certified cutoff is used, a rule without one is off.

Multiple testing: a rule's tail probabilities rise with its strictness, so
testing its grid from the most lenient cutoff on and stopping at the first
failure (fixed-sequence testing) spends the level of one test; the levels of
all strata and rules are added up (Bonferroni), as are the rules' risks (union
bound).  So with probability ``1 - error`` no stratum loses more than ``risk``
of its good documents to these rules.

Plan: one pass computes the statistics inside each row (array functions, no
shuffle, nothing exploded) and stores them without the text; windows are
compared by hash first, and only where hashes repeat the windows themselves
are sorted.  Labelled rows are joined by doc_id and reduced to counts by
stratum before a shuffle.

Edge cases: a null or empty text has no words and fails the base rules;
without labels, or with too few in a stratum, no cutoff is certified and only
the base rules reject; null labels are ignored, a document labelled twice
takes the lower label; repeated rows are judged each (and count each in the
holdout); a null doc_id has no label; extra columns are not read.  The arrays
of a text take some 200 bytes a word while its row is worked on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import stored

BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """Reject where part / whole > cutoff; cutoffs from the strictest to the most lenient."""
    name: str
    part: str
    whole: str
    cutoffs: tuple[float, ...]

    def ratio(self) -> Column:
        return F.try_divide(F.col(self.part), F.col(self.whole))  # null, so not above any cutoff, without words


#: The production rules (parameters).
RULES = (
    Rule("symbols", "n_symbols", "word_chars", (.01, .02, .05, .1, .2, .3)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", (.1, .2, .3, .4, .5, .7)),
    Rule("repeated_words", "n_repeat_words", "n_words", (.02, .05, .1, .15, .2, .3)),
    Rule("long_words", "word_chars", "n_words", (6.0, 6.5, 7.0, 8.0, 10.0, 15.0)),
    Rule("short_words", "n_words", "word_chars", (.22, .25, .28, .31, .35, .4)),
)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and STATISTICS of every row.

    Every step names what the next one uses more than once, so that no expression is put into another one's lambda."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(*keep, text.alias("_text"), F.btrim(text, F.lit(BLANK_CHARS)).alias("_bare"))
    d = d.select(*keep, "_text",
                 F.when(F.col("_bare") != "", F.split("_bare", BLANKS)).otherwise(F.array().cast("array<string>")).alias("_words"),
                 F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, F.lit(BLANK_CHARS)) != "").alias("_lines"))
    words = F.col("_words")
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    d = d.select(*keep, "_words", F.size(words).cast("long").alias("n_words"),
                 F.length(F.regexp_replace("_text", BLANKS, "")).cast("long").alias("word_chars"),
                 F.length(F.regexp_replace("_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                 F.size("_lines").cast("long").alias("n_lines"),
                 F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))).alias("_hashes"))
    counted = [*keep, *(c for c in STATISTICS if c != "n_repeat_words")]
    window = lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"),
                                i.alias("i"))
    d = d.select(*counted, F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
                                  F.sort_array(F.transform(places, window))).alias("_sorted"))
    same = lambda x, j: x["w"].eqNullSafe(F.get("_sorted", j - 1)["w"]) | x["w"].eqNullSafe(F.get("_sorted", j + 1)["w"])
    d = d.select(*counted, F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["i"])).alias("_at"))
    # windows that overlap share words: each adds what lies behind the one before
    covered = F.aggregate("_at", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
                          lambda a: a["n"])
    return d.select(*keep, *(F.coalesce(covered, F.lit(0).cast("long")).alias(c) if c == "n_repeat_words" else F.col(c)
                             for c in STATISTICS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(Bin(n, share) <= k), term by term; 1 where k >= n * share, far above any level in use."""
    ratio = F.log(F.lit(share / (1 - share)))
    first = n * F.log(F.lit(1 - share))
    terms = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("log"), F.exp(first).alias("sum")),
        lambda a, i: F.struct((a["log"] + F.log((n - i + 1) / i) + ratio).alias("log"),
                              (a["sum"] + F.exp(a["log"] + F.log((n - i + 1) / i) + ratio)).alias("sum")),
        lambda a: a["sum"])
    return F.when(k < n * share, terms).otherwise(F.lit(1.0))


def certified_cutoffs(good: DataFrame, stratum: str, rules=RULES, risk: float = .02, error: float = .05) -> DataFrame:
    """``stratum`` and a column by rule name with its strictest certified cutoff, else null, of every stratum of ``good``
    (statistics of good documents that passed the base rules)."""
    # Counts by stratum and cutoff, one row a stratum; then a row for each cutoff.
    tests = [(r, c) for r in rules for c in r.cutoffs]
    counts = stored(good.groupBy(stratum).agg(F.count("*").alias("n"), *(
        F.count_if(r.ratio() > c).alias(f"k{i}") for i, (r, c) in enumerate(tests))), "rule-counts")
    level = error / (max(counts.count(), 1) * len(rules))
    tested = counts.select(stratum, "n", F.explode(F.array(*(
        F.struct(F.lit(r.name).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"k{i}").alias("k"))
        for i, (r, c) in enumerate(tests)))).alias("t")).select(stratum, "n", "t.*")
    passed = binomial_tail(F.col("n"), F.col("k"), risk / len(rules)) <= level
    return tested.groupBy(stratum).agg(*(
        F.min(F.when(passed & (F.col("rule") == r.name), F.col("cutoff"))).alias(r.name) for r in rules))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules=RULES, risk: float = .02,
          error: float = .05) -> DataFrame:
    """doc_id, stratum, STATISTICS, base_failed and kept of every document; ``rejected_by``: the rules that reject it."""
    rows = stored(statistics(docs.select("doc_id", F.col(stratum).alias("stratum"), "text"), "doc_id", "stratum")
                  .withColumn("base_failed", base_failed()), "rule-statistics")
    marked = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
              .where("q = 1").select("doc_id"))
    cutoffs = certified_cutoffs(rows.where("not base_failed").join(marked, "doc_id", "left_semi"), "stratum", rules, risk, error)
    named = cutoffs.select(F.col("stratum").alias("__of"), *(F.col(r.name).alias(f"__{r.name}") for r in rules))
    judged = rows.join(named, F.col("stratum").eqNullSafe(F.col("__of")), "left")
    broken = F.filter(F.array(*(F.when(r.ratio() > F.col(f"__{r.name}"), F.lit(r.name)) for r in rules)),
                      lambda x: x.isNotNull())
    return judged.select("doc_id", "stratum", *STATISTICS, "base_failed", broken.alias("rejected_by")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
