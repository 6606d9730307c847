"""Operator 10: line deduplication by a deletion-neighbourhood join.

Lines are compared after trimming, collapsing blanks and tabs, and lower-casing.
Two lines are duplicates if they are equal or, from ``near_words`` words on,
one word apart (word edit distance 1: one word replaced, added or left out).
A line goes if an earlier line is its duplicate; earlier means smaller
(doc_id, text hash, line number), documents without an id last.

Method.  Every line emits its deletion variants, the line with one word left
out, as hashed keys, and itself.  Lines one word apart share a key: a replaced
word at the same place, or a variant that equals the other line.  An equality
join within the keys gives each line its earliest partners (a minimum per key,
never all pairs), and word edit distance is verified on the texts.

What is kept small:
* equal lines are aggregated first, so a very common line is one row;
* a line can only be one word apart from a line that has the same first or the
  same second half, so lines whose half hashes occur once emit no variants.
  The halves that recur are handed on as a bit table (a fixed number of words);
* a variant's hash is made of running exclusive-ors over word hashes, kept for
  blocks of sqrt(n) words, so a line of n words costs n * sqrt(n), not n * n;
* texts are shuffled once, for the documents that come out.

With ``grown`` (the pipeline) the bound grows with the line: from 40 units on, one
edit per 20 units of the shorter line.  Units are words, or characters in a line
of over 16 characters a word.  Lines within the bound share a run of 13 units, so
both keep the same runs of 7 by least hashes (winnowing); these are the keys.  A line
is compared with the earliest line of each of its keys where the places fit.  Of keys
that three lines or more have, those that are not near it are paired by their rarest
runs of 3 units, of which each line needs a few more than its edits, so lines that
share a common passage and little else never meet.  The edit distance is verified on
40 bits a unit.
Lines of over 2^24 units are not compared by runs behind that place.

Edge cases: a null text stays null; lines of fewer than ``least_words`` words
(blank ones too) always stay, but with ``least_bytes`` (the pipeline) only if
they have fewer bytes as well, so that scripts without blanks and long lines
without one are compared; rows equal in doc_id and text are one document
and lose the same lines; "\\r" counts as a blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from logweave.llm.common import stored

HALF_STEP = 8
BIT_WORDS = 1 << 18  # 64 bits each, two numbers a row: 4 MB to broadcast at most
GRAM = 7
RUN = 3  # units
EDIT_UNITS = 20  # one edit per so many units
PLACE_BITS = 24  # of a run's place in its line
FEW_BLANKS = 16  # characters a word
ORDER = ("no_id", "doc_id", "text_hash", "line")


def normalised(text: Column) -> Column:
    """The text with its lines as they are compared; all lines at once, which costs less than line by line."""
    flat = text
    for white in "\t\r":
        flat = F.replace(flat, F.lit(white), F.lit(" "))
    flat = F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " +", " ")).otherwise(flat)
    for edge in (" \n", "\n "):
        flat = F.replace(flat, F.lit(edge), F.lit("\n"))
    return F.lower(F.trim(flat))


def _lines(docs: DataFrame, least_words: int, least_bytes: int | None = None) -> DataFrame:
    """One row per line that can be a duplicate: its place, its text as compared, its words and two hashes."""
    # Below the generator each text is normalised and hashed once, whatever is done with the lines.
    rows = docs.select(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_hash"),
                       F.split(normalised(F.col("text")), "\n").alias("lines"))
    rows = rows.select("no_id", "doc_id", "text_hash", F.posexplode_outer("lines").alias("line", "norm"))  # outer: no filter on the array's size
    # A line of fewer words is whole before its blank of that number.
    long_enough = F.substring_index("norm", " ", least_words - 1) != F.col("norm") if least_words > 1 else F.lit(True)
    if least_bytes is not None:
        long_enough |= F.octet_length("norm") >= least_bytes
    return (rows.where((F.col("norm") != "") & long_enough)
            .withColumn("n", F.size(F.split("norm", " "))).withColumn("h1", F.xxhash64("norm")).withColumn("h2", F.xxhash64(F.lit(1), "norm")))


def _half_keys(norm: Column, n: Column, near_words: int) -> Column:
    """Hashes of the first and the last half, as long as it is for the shorter line of a pair; rounded down, so that
    lines of neighbouring lengths mostly have the same."""
    keys = []
    for shorter in (n, n - 1):
        half = F.floor(shorter / 2).cast("int")
        half = F.when(half >= HALF_STEP, half - half % HALF_STEP).otherwise(half)
        keys += [F.xxhash64(F.lit(side), half, F.call_function("substring_index", norm, F.lit(" "), half * sign))
                 for side, sign in ((0, 1), (1, -1))]
    return F.when(n >= near_words, F.array_distinct(F.array(*keys)))


def _bit_table(hashes: DataFrame) -> DataFrame:
    """(place, bits): one bit per pmod(h1); at most BIT_WORDS rows however many hashes there are."""
    place = F.pmod("h1", F.lit(BIT_WORDS * 64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.select(F.shiftright(place, 6).alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits"))


def _marked(lines: DataFrame, bits: DataFrame) -> DataFrame:
    """The lines whose bit is set: all that the table was made from, and a few others."""
    place = F.pmod("h1", F.lit(BIT_WORDS * 64))
    hit = F.call_function("getbit", F.col("bits"), place.bitwiseAND(F.lit(63)).cast("int")) == 1
    # At most BIT_WORDS rows of two numbers.
    return lines.withColumn("place", F.shiftright(place, 6)).join(F.broadcast(bits), "place").where(hit).drop("place", "bits")


def _xor(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _keyed(words: Column) -> Column:
    """(key, at) of the line itself (at 0) and of its variants without word ``at``; equal texts have equal keys.

    A text's key is the exclusive-or of hash(word, place).  Without word i it is that of the words before i at their
    places and of the words after i at one place less."""
    n = F.size(words)
    block = F.ceil(F.sqrt(n)).cast("int")
    at_place = F.transform(words, lambda w, j: F.xxhash64(w, j))
    moved = F.transform(words, lambda w, j: F.xxhash64(w, j - 1))
    parts = F.struct(at_place.alias("own"), moved.alias("moved"), block.alias("block"), n.alias("n"))

    def with_parts(p: Column) -> Column:
        change = F.zip_with(p["own"], p["moved"], lambda a, b: a.bitwiseXOR(b))
        q = F.struct(p["own"].alias("own"), p["moved"].alias("moved"), p["block"].alias("block"), p["n"].alias("n"),
                     change.alias("change"), _xor(p["moved"]).alias("all_moved"))
        return F.element_at(F.transform(F.array(q), with_change), 1)

    def with_change(q: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((q["n"] - 1) / q["block"]).cast("int")),
                             lambda k: _xor(F.slice(q["change"], k * q["block"] + 1, q["block"])))
        r = F.struct(q.alias("q"), blocks.alias("blocks"))
        return F.element_at(F.transform(F.array(r), with_blocks), 1)

    def with_blocks(r: Column) -> Column:
        q = r["q"]

        def variant(i: Column) -> Column:  # i counts from 0
            whole = F.floor(i / q["block"]).cast("int")
            before = _xor(F.slice(r["blocks"], 1, whole)).bitwiseXOR(
                _xor(F.slice(q["change"], whole * q["block"] + 1, i - whole * q["block"])))
            return F.struct(before.bitwiseXOR(q["all_moved"]).bitwiseXOR(F.get(q["moved"], i)).alias("key"),
                            (i + 1).alias("at"))

        return F.concat(F.array(F.struct(_xor(q["own"]).alias("key"), F.lit(0).alias("at"))),
                        F.transform(F.sequence(F.lit(0), q["n"] - 1), variant))

    return F.element_at(F.transform(F.array(parts), with_parts), 1)


def one_word_apart(a: Column, b: Column) -> Column:
    """Word edit distance of two word arrays is 1 or less."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    tail = lambda words, k: F.slice(words, k, F.greatest(F.size(words) - k + 1, F.lit(0)))
    return ((first == 0) | (tail(a, first + 1) == tail(b, first + 1)) | (tail(a, first + 1) == tail(b, first))
            | (tail(a, first) == tail(b, first + 1)))


def near_lines(distinct: DataFrame, lines: DataFrame, near_words: int) -> DataFrame:
    """(h1, h2) of the lines that have an earlier line one word apart.

    ``distinct``: a row per different line with its first place and ``halves``; ``lines``: its occurrences with text."""
    halves = distinct.where("halves is not null").select("h1", F.explode("halves").alias("half"))
    shared = halves.withColumn("size", F.count("*").over(Window.partitionBy("half"))).where("size > 1")
    some = _marked(lines.where(F.col("n") >= near_words), _bit_table(shared))
    texts = some.groupBy("h1", "h2").agg(F.min(F.struct(*ORDER)).alias("first"), F.any_value("norm").alias("norm"))
    # Numbers in the order of the first places; stored, so that they stay as they are.
    texts = stored(texts.orderBy("first").withColumn("id", F.monotonically_increasing_id()), "line-texts")
    keys = texts.select("id", F.explode_outer(_keyed(F.split("norm", " "))).alias("v")).select("id", "v.key", "v.at")
    by_key, by_place = Window.partitionBy("key"), Window.partitionBy("key", "at")
    keys = (keys.withColumn("whole", F.min(F.when(F.col("at") == 0, F.col("id"))).over(by_key))
            .withColumn("variant", F.min(F.when(F.col("at") > 0, F.col("id"))).over(by_key))
            .withColumn("replaced", F.min("id").over(by_place)))
    partner = F.array_distinct(F.when(F.col("at") > 0, F.array("whole", "replaced")).otherwise(F.array("variant")))
    pairs = (keys.where("whole < id or variant < id").select("id", F.explode(partner).alias("earlier"))
             .where("earlier < id").distinct())
    words = texts.select("id", "h1", "h2", F.split("norm", " ").alias("words"))
    both = pairs.join(words, "id").join(words.select(F.col("id").alias("earlier"), F.col("words").alias("others")), "earlier")
    return both.where(one_word_apart(F.col("words"), F.col("others"))).select("h1", "h2").distinct()


def _units(norm: Column, n: Column) -> Column:
    """What edits are counted in: words, or characters where a line has few blanks for its length."""
    return F.split(norm, F.when(F.length(norm) > FEW_BLANKS * n, F.lit("")).otherwise(F.lit(" ")))


def _with_next(items: Column, step: int, made) -> Column:
    """Each item with the one ``step`` on; at the end there is none."""
    return F.element_at(F.transform(F.array(items), lambda x: F.zip_with(x, F.slice(x, step + 1, 1 << 30), made)), 1)


def _grams(units: Column) -> Column:
    """The number of units, and the runs of GRAM units whose hash is the least of some GRAM runs in a row, as 40 bits of
    the hash with 24 bits of the place; null for lines of one edit.

    Of 2 * GRAM - 1 equal units in a row both texts keep the same run.  A text of n units with n // EDIT_UNITS edits has
    at least that many equal in a row from 2 * EDIT_UNITS units on."""
    # Seven in a row by twos, fours and two overlapping fours; a few numbers a unit, no slice for each.
    runs = F.transform(units, lambda u: F.xxhash64(u))
    for step in (1, 2, 3):
        runs = _with_next(runs, step, lambda x, y: F.xxhash64(x, y))
    runs = F.transform(runs, lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long")))
    runs = F.slice(runs, 1, F.size(units) - (GRAM - 1))
    for step in (1, 2, 3):
        runs = _with_next(runs, step, lambda x, y: F.least(x, y))
    return F.when(F.size(units) >= 2 * EDIT_UNITS, F.struct(F.array_distinct(runs).alias("grams"), F.size(units).alias("units")))


def _code(units: Column, seed: int) -> Column:
    """A character per unit, by 20 bits of its hash (the planes 1 to 16 of Unicode have so many): equal units have equal
    ones, and of two codes with different seeds different units have different pairs, but for one in 2^40."""
    letter = lambda u: F.lpad(F.hex(F.pmod(F.xxhash64(F.lit(seed), u), F.lit(1 << 20)) + 65536), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(units, letter), "")), "UTF-32")


def _rarest(texts: DataFrame) -> DataFrame:
    """(id, units, run): of each line its rarest runs of RUN units, RUN for each edit of its bound and one more.

    An edit takes away RUN runs at most.  So of two lines within the bound, at most RUN runs an edit of either are not in
    the other, and the rarest run that both have (they have a longer one, see ``_grams``) is among these of both: runs have
    the same order in all lines, those of fewest lines first.  Runs of one line only count, but pair nothing."""
    runs = F.transform(F.split("code", ""), lambda u: F.xxhash64(u))
    for step in [1] * (RUN - 1):
        runs = _with_next(runs, step, lambda x, y: F.xxhash64(x, y))
    rows = texts.select("id", "units", F.array_distinct(F.slice(runs, 1, F.col("units") - (RUN - 1))).alias("runs"))
    rows = rows.select("id", "units", F.explode("runs").alias("run"))
    rows = rows.join(rows.groupBy("run").agg(F.count("*").alias("lines")), "run")
    place = F.row_number().over(Window.partitionBy("id").orderBy("lines", "run"))
    return (rows.withColumn("place", place).where((F.col("place") <= RUN * F.floor(F.col("units") / EDIT_UNITS) + 1) & (F.col("lines") > 1))
            .select("id", "units", "run"))


def rare_pairs(texts: DataFrame, done: DataFrame) -> DataFrame:
    """(id, other): the lines of ``texts(id, units, code)`` but those of ``done(id)``, each with all earlier lines that
    may be within the bound of it."""
    rare = stored(_rarest(texts), "line-runs")
    others = rare.select("run", F.col("id").alias("other"), F.col("units").alias("other_units"))
    bound = F.floor(F.least("units", "other_units") / EDIT_UNITS)
    return (rare.join(done, "id", "left_anti").join(others, "run")
            .where((F.col("id") > F.col("other")) & (F.abs(F.col("units") - F.col("other_units")) <= bound)).select("id", "other"))


def _within(a: str, b: str) -> Column:
    return F.call_function("levenshtein", F.col(a), F.col(b), F.col("bound")) >= 0


def edited_lines(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2) of the lines of 2 * EDIT_UNITS units or more that have an earlier line within a unit edit distance of
    one in EDIT_UNITS units of the shorter of the two.

    Different lines are numbered in the order of their first places, so that what is shuffled by run is two numbers, and
    only rows of runs that two lines have are joined.  A line that is near the earliest line of one of its runs is not
    compared with the others; else it is paired by ``rare_pairs``.  Distances are banded, so a long line costs its units
    times its bound."""
    from logweave.llm.importance_sampling import ranked

    long = F.length("norm") >= 2 * EDIT_UNITS
    at_first = distinct.where(F.col("chars") >= 2 * EDIT_UNITS).select("h1", "h2", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ORDER))
    numbered = ranked(at_first, [F.col(f"first_{c}").asc() for c in ORDER], "id")

    def of(rows: DataFrame, wanted: DataFrame, *columns: Column) -> DataFrame:
        """``columns`` of the lines at the first places of ``wanted``; copies find no partner."""
        rows = rows.select("doc_id", "text_hash", "line", *columns)
        return rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["first_doc_id"]) & (rows["text_hash"] == wanted["first_text_hash"])
                         & (rows["line"] == wanted["first_line"])).drop("doc_id", "text_hash", "line", *(f"first_{c}" for c in ORDER))

    made = of(lines.where(long), numbered.drop("h1", "h2"), _grams(_units(F.col("norm"), F.col("n"))).alias("long"))
    made = stored(made.where("long is not null").select("id", "long.units", "long.grams"), "line-grams")
    low = F.lit((1 << PLACE_BITS) - 1)
    grams = made.select("id", "units", F.explode("grams").alias("g")).select(
        "id", "units", F.shiftright("g", PLACE_BITS).alias("key"), F.col("g").bitwiseAND(low).alias("at"))
    hubs = (grams.groupBy("key").agg(F.min(F.shiftleft("id", PLACE_BITS).bitwiseOR(F.col("at"))).alias("hub"), F.max("id").alias("last"),
                                     F.count("*").alias("rows"))
            .where(F.col("last") > F.shiftright("hub", PLACE_BITS))
            .select("key", F.shiftright("hub", PLACE_BITS).alias("hub"), F.col("hub").bitwiseAND(low).alias("hub_at"), "rows"))
    hubs = stored(hubs, "line-hubs")
    shared = _marked(grams.withColumn("h1", F.col("key")), _bit_table(hubs.select(F.col("key").alias("h1")))).drop("h1")
    members = stored(shared.join(hubs, "key"), "line-members")

    wanted = stored(numbered.join(members.select("id").distinct(), "id", "left_semi"), "line-numbers")
    units = _units(F.col("norm"), F.col("n"))
    texts = of(_marked(lines.where(long), _bit_table(wanted.select("h1"))), wanted.drop("h1", "h2"), units.alias("units"))
    texts = stored(texts.select("id", F.size("units").alias("units"), _code(F.col("units"), 1).alias("code"), _code(F.col("units"), 2).alias("check")),
                   "long-lines")

    def compared(pairs: DataFrame) -> DataFrame:
        """(id) of the pairs (id, other) that are near."""
        others = texts.select(F.col("id").alias("other"), F.col("units").alias("other_units"), F.col("code").alias("other_code"),
                              F.col("check").alias("other_check"))
        both = pairs.distinct().join(texts, "id").join(others, "other")
        both = both.withColumn("bound", F.floor(F.least("units", "other_units") / EDIT_UNITS).cast("int"))
        return both.where((F.abs(F.col("units") - F.col("other_units")) <= F.col("bound")) & _within("code", "other_code")
                          & _within("check", "other_check")).select("id").distinct()

    fit = F.abs(F.col("at") - F.col("hub_at")) <= F.floor(F.col("units") / EDIT_UNITS)
    near = stored(compared(members.where((F.col("id") != F.col("hub")) & fit).select("id", F.col("hub").alias("other"))), "edited-lines")
    crowd = members.where("rows > 2").select("id").distinct()  # of two lines the later one is already compared
    rest = rare_pairs(texts.join(crowd, "id", "left_semi"), near)
    return near.unionAll(compared(rest)).distinct().join(wanted, "id").select("h1", "h2")


def removed_lines(docs: DataFrame, least_words: int = 2, near_words: int = 8, least_bytes: int | None = None,
                  grown: bool = False) -> DataFrame:
    """(doc_id, text_hash, removed): the line numbers (from 0) that go, of every document that loses a line."""
    lines = _lines(docs, least_words, least_bytes)
    distinct = stored(lines.groupBy("h1", "h2").agg(
        F.min(F.struct(*ORDER)).alias("first"), F.count("*").alias("copies"),
        F.any_value(_half_keys(F.col("norm"), F.col("n"), near_words)).alias("halves"),
        *([F.any_value(F.length("norm")).alias("chars")] if grown else [])), "lines")
    near = near_lines(distinct, lines, near_words)
    near = stored(near.unionAll(edited_lines(distinct, lines)).distinct() if grown else near, "near-lines")
    # Lines with copies lose all but the first place, near lines all places.
    doubtful = (distinct.where("copies > 1").select("h1", "h2", "first")
                .unionAll(near.select("h1", "h2", F.lit(None).cast(distinct.schema["first"].dataType).alias("first"))))
    places = _marked(lines.drop("norm", "n"), _bit_table(doubtful)).withColumn("here", F.struct(*ORDER))
    gone = places.join(doubtful, ["h1", "h2"]).where(F.col("first").isNull() | (F.col("here") != F.col("first")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("removed"))


def dedup_lines(docs: DataFrame, least_words: int = 2, near_words: int = 8, least_bytes: int | None = None,
                grown: bool = False, count_as: str = "removed_lines") -> DataFrame:
    """The rows with their text as it is without its removed lines, and their number in ``count_as`` (which takes the place
    of a column of that name)."""
    gone = (removed_lines(docs, least_words, near_words, least_bytes, grown)
            .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), F.col("removed").alias("__removed")))
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    rows = marked.join(gone, marked["doc_id"].eqNullSafe(gone["__id"]) & (marked["__hash"] == gone["__text"]), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("__removed", i)), "\n")
    return (rows.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(kept))
            .withColumn(count_as, F.coalesce(F.size("__removed"), F.lit(0)))
            .drop("__id", "__text", "__hash", "__removed"))
