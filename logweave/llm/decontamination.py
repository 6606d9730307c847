"""Operator 8: benchmark decontamination by template canonicalisation.

Texts become tokens, runs of letters and digits.  A token is typed: one that
begins with a digit is <num>, a unit of measure after it <unit>, another
capitalised word that is not a function word <name>; the rest is literal,
lower-cased.  Windows of five typed tokens are the templates.  Benchmark
windows with at least two literal tokens are joined by hash with the
documents' windows and compared; each match says which document value stands
in which slot.  Along one alignment (document place minus item place) the slot
values must map one to one, else that alignment does not count.  A document is
contaminated by an item if the alignments that count cover ``share`` (0.8) of
the item's windows, so a copied question is found, and also one whose numbers,
names and units were exchanged consistently.

That is the form the SQL in ``oracles`` states.  With ``whole`` (the pipeline):

* a disagreeing slot costs its own windows only: a window counts if its slots
  hold the item's values or each value's most frequent partner along the
  alignment; two item values may have the same partner;
* a second form of each window, lower-cased with numbers and units typed, is
  joined beside the typed one, and a place counts if either form matches, so the
  letter case of a copy is of no account;
* a number with its sign, separators and decimals is one token, and so is a run
  of names in the typed form, so a value is one placeholder whatever its length.
  The share then counts the case-blind windows that a match of either form covers.

With ``whole`` a text is typed only if it holds an item's needed words: one of each of three groups of
its longest literal words, each so many that a text without any of them cannot reach ``share``.  That drops no match.

Scale: documents are read once; only windows that match a benchmark window
leave their task.  The benchmark's window table is broadcast if it has at most
``broadcast_rows`` rows and ``broadcast_bytes`` bytes, both counted first, and
joined by shuffle beyond that.
Typing and cutting are regular expressions over whole texts (a few passes),
which costs a fraction of the same done token by token.

Edge cases: null and empty texts have no windows; a text of fewer than five
tokens is one window of all it has; an item without any window of two literals
takes part with all its windows, and then slots must be equal; repeated items
are each reported; rows equal in doc_id and text give one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.common import stored

WINDOW = 5
ROW_BYTES = 160  # of a window's row, besides its texts
LITERALS = 2
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
UNITS = ("mm cm m km kg mg g lb lbs oz ft inch inches mile miles meter meters metre metres kilometer kilometers kilometre "
         "kilometres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres l ml gallon gallons "
         "second seconds s minute minutes hour hours h day days week weeks month months year years dollar dollars cent cents "
         "euro euros percent degree degrees mph kph hz khz mhz ghz kb mb gb tb volt volts v watt watts w").split()
FUNCTION_WORDS = ("a an the this that these those there here it its he she they we you i what which who whom whose when where "
                  "why how if in on at by to of for from with and or but not no is are was were be do does did has have had "
                  "can could will would shall should may might must as so then than let each every all some any find given "
                  "suppose calculate").split()
ANY_OF = "|".join
CUT = " (?=([^ ]+" + " [^ ]+" * (WINDOW - 1) + ") )"


def plain(text: Column) -> Column:
    """The tokens, with a blank before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}0-9]+", " ")), F.lit(" "))


def typed(words: Column) -> Column:
    """The tokens of ``plain`` with their types in place of numbers, units and names; as many tokens."""
    out = F.regexp_replace(words, " [0-9][^ ]*", f" {NUMBER}")
    out = F.regexp_replace(out, f" {NUMBER} (?i:{ANY_OF(UNITS)})(?= )", f" {NUMBER} {UNIT}")
    return F.lower(F.regexp_replace(out, rf" (?=\p{{Lu}})(?!(?i:{ANY_OF(FUNCTION_WORDS)}) )[^ ]+", f" {NAME}"))


RUN, IN_RUN, AFTER_NUMBER = "\x01", "\x02", "\x03"
DIGITS = " [-+\u2212]?[0-9]"


def values(text: Column) -> Column:
    """As ``plain``, but a number with its sign, separators and decimals is one token."""
    between = r"(?!(?<=[0-9])[.,:/'\u2019\u00a0\u202f](?=[0-9]))"
    sign = r"(?!(?<![\p{L}\p{M}0-9])[-+\u2212](?=[0-9]))"
    gap = rf"(?:{between}{sign}[^\p{{L}}\p{{M}}0-9])+"
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), gap, " ")), F.lit(" "))


def _runs(words: Column) -> Column:
    """The tokens of ``values``; a unit after a number is marked, and a run of names is one marked token."""
    out = F.regexp_replace(words, rf"({DIGITS}[^ ]*) ((?i:{ANY_OF(UNITS)})(?= ))", f"$1 {AFTER_NUMBER}$2")
    out = F.regexp_replace(out, rf" (?=\p{{Lu}})(?!(?i:{ANY_OF(FUNCTION_WORDS)}) )([^ ]+)", f" {RUN}$1{RUN}")
    return F.lower(F.replace(out, F.lit(f"{RUN} {RUN}"), F.lit(IN_RUN)))


def _run_types(runs: Column) -> Column:
    out = F.regexp_replace(runs, f"{DIGITS}[^ ]*", f" {NUMBER}")
    return F.regexp_replace(F.regexp_replace(out, f" {AFTER_NUMBER}[^ ]*", f" {UNIT}"), f" {RUN}[^ ]*", f" {NAME}")


def _blind_types(runs: Column) -> Column:
    out = F.regexp_replace(_apart(runs), f"{DIGITS}[^ ]*", f" {NUMBER}")
    return F.regexp_replace(out, f"(?<= {NUMBER}) (?:{ANY_OF(UNITS)})(?= )", f" {UNIT}")


def _apart(runs: Column) -> Column:
    """The words of ``_runs`` without marks, each its own token."""
    return F.translate(runs, f"{IN_RUN}{RUN}{AFTER_NUMBER}", " ")


def _cut(words: Column) -> Column:
    """The windows of a text in ``plain`` form; all of it if it is shorter than a window, none if it has no token."""
    windows = F.regexp_extract_all(words, F.lit(CUT), F.lit(1))
    whole = F.trim(words)
    return F.when(whole.rlike("^(?:[^ ]+ ){0,%d}[^ ]+$" % (WINDOW - 2)), F.array(whole)).otherwise(windows)


def _windows(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Adds ``place`` (from 0), ``template``, its ``hash`` and the tokens as they are, ``raw``, of every window; with
    ``whole`` for either ``form``."""
    # Below the generator, so that a text is worked out once and doesn't go along with its windows.
    if whole:
        runs = F.col("runs")
        rows = rows.withColumn("runs", _runs(values(F.col("text")))).drop("text").select("*", F.explode(F.array(*[
            F.struct(F.lit(k).alias("form"), types.alias("types"), raw.alias("words")) for k, (types, raw) in enumerate((
                (_run_types(runs), runs), (_blind_types(runs), _apart(runs))))])).alias("f")).drop("runs")
        rows = rows.select("*", "f.form", "f.types", "f.words").drop("f")
    else:
        rows = rows.withColumn("words", plain(F.col("text"))).drop("text").withColumn("types", typed(F.col("words")))
    rows = rows.withColumn("cut", F.arrays_zip(_cut(F.col("types")).alias("template"), _cut(F.lower("words")).alias("raw"))).drop("types")
    # Outer: for the inner form Spark filters on the array's size first, and works it out twice.
    rows = rows.drop("words").select("*", F.posexplode_outer("cut").alias("place", "window")).drop("cut").where("place is not null")
    return rows.select("*", F.col("window.template").alias("template"), F.split("window.raw", " ").alias("raw"),
                       F.xxhash64("window.template").alias("hash")).drop("window")


def _slot(word: Column) -> Column:
    return word.isin(NUMBER, UNIT, NAME)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of each item that are looked for: those with two literals, or all where there is none."""
    # Rows may repeat, so an item is known by its id and text.
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("item_hash")).distinct()
    found = _windows(rows).select(
        "item_id", "item_hash", "hash", F.col("place").alias("item_place"),
        F.col("raw").alias("item_raw"), F.col("template").alias("item_template"))
    found = found.withColumn("literals", F.size(F.filter(F.split("item_template", " "), lambda t: ~_slot(t))))
    per_item = found.groupBy(F.col("item_id").alias("id"), F.col("item_hash").alias("text_key")).agg(
        F.count("*").alias("every"), F.count(F.when(F.col("literals") >= LITERALS, 1)).alias("plain"))
    found = found.join(per_item, F.col("item_id").eqNullSafe(F.col("id")) & (F.col("item_hash") == F.col("text_key"))).select(
        "item_id", "item_hash", "hash", "item_place", "item_raw", "item_template", "literals",
        (F.col("plain") == 0).alias("strict"), F.when(F.col("plain") == 0, F.col("every")).otherwise(F.col("plain")).alias("windows"))
    return found.where(F.col("strict") | (F.col("literals") >= LITERALS)).drop("literals")


def _agreeing(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The hits whose slots hold the item's own values, or each item value's most frequent partner along the alignment."""
    slots = hits.select(*keys, F.explode("slots").alias("s")).select(*keys, "s.at", "s.type", "s.theirs", "s.own").distinct()
    pairs = slots.groupBy(*keys, "type", "theirs", "own").agg(F.count("*").alias("n"))
    best = pairs.groupBy(*keys, "type", "theirs").agg(
        F.max_by("own", F.struct("n", F.col("own") == F.col("theirs"), "own")).alias("own"))
    # An alignment has at most the item's values.
    partners = best.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.collect_set(F.struct("type", "theirs", "own")).alias("partners"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    known = hits.join(partners, same, "left").drop(*[f"_{k}" for k in keys])
    fits = F.forall("slots", lambda s: F.array_contains("partners", F.struct(s["type"], s["theirs"], s["own"])))
    return known.where(F.forall("slots", lambda s: s["theirs"] == s["own"]) | fits)


def item_forms(benchmark: DataFrame) -> DataFrame:
    """The windows of each item that are looked for, in both ``form``s, and the places that each covers.

    Places are those of the case-blind windows.  A typed window covers the places that lie in its words (more than
    one if it holds a run of names); wanted are the places that a typed window with two literals covers, or all."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("item_hash")).distinct()
    rows = rows.withColumn("runs", _runs(values(F.col("text"))))
    # The places of the tokens of _runs, counted in words: a word within a run is not one.
    parts = F.split(F.replace(F.trim("runs"), F.lit(IN_RUN), F.lit(f" {IN_RUN}")), " ")
    begins = F.filter(F.transform(parts, lambda w, i: F.when(~F.startswith(w, F.lit(IN_RUN)), i)), lambda i: i.isNotNull())
    rows = rows.select("item_id", "item_hash", "text", begins.alias("begins"))
    found = _windows(rows, whole=True).select(
        "item_id", "item_hash", "form", "hash", F.col("place").alias("item_place"), F.col("raw").alias("item_raw"),
        F.col("template").alias("item_template"), "begins")
    words = F.aggregate("item_raw", F.lit(0), lambda n, w: n + F.length(w) - F.length(F.replace(w, F.lit(IN_RUN), F.lit(""))) + 1)
    first = F.when(F.col("form") == 1, F.col("item_place")).otherwise(F.get("begins", F.col("item_place")))
    found = found.withColumn("first", first).withColumn(
        "last", F.when(F.col("form") == 1, F.col("first")).otherwise(F.greatest(F.col("first"), F.col("first") + words - WINDOW))).drop("begins")
    found = stored(found, "item-forms")  # read four times below; the plan has the typing once
    enough = F.size(F.filter(F.split("item_template", " "), lambda t: ~_slot(t))) >= LITERALS
    text = ["item_id", "item_hash"]
    same = lambda keys: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    per_item = found.where("form = 0").groupBy(*[F.col(k).alias(f"_{k}") for k in text]).agg((F.count(F.when(enough, 1)) == 0).alias("strict"))
    found = found.join(per_item, same(text)).drop(*[f"_{k}" for k in text])
    wanted = found.where((F.col("form") == 0) & (F.col("strict") | enough))
    places = wanted.select(*text, F.explode(F.sequence("first", "last")).alias("first")).distinct()
    sizes = places.groupBy(*[F.col(k).alias(f"_{k}") for k in text]).agg(F.count("*").alias("windows"))
    other = found.where("form = 1").join(places.select(*[F.col(k).alias(f"_{k}") for k in [*text, "first"]]), same([*text, "first"]))
    found = wanted.unionByName(other.drop(*[f"_{k}" for k in [*text, "first"]]))
    return found.join(sizes, same(text)).drop(*[f"_{k}" for k in text])


def _may_be_sent(wanted: DataFrame, rows: int, octets: int) -> bool:
    """True for a window table of so many rows and bytes at most; tokens and ids have any length."""
    own = F.octet_length("item_template") + F.octet_length(F.array_join("item_raw", " ")) + F.octet_length(F.col("item_id").cast("string"))
    size = wanted.agg(F.count("*").alias("rows"), F.sum(F.coalesce(own, F.lit(0)).cast("long") + ROW_BYTES).alias("octets")).first()
    return size["rows"] <= rows and (size["octets"] or 0) <= octets


#: Needed words of a group that are looked up in a text at most; with more (or with an item that has none) all are typed.
NEEDED_WORDS = 5_000
NEEDED_GROUPS = 3


def _covering(fixed: DataFrame, share: float) -> DataFrame:
    """(item, word): of each item the longest words of ``fixed``, as many as it takes that the places without any of them are
    fewer than ``share`` asks for; items without enough words are left out."""
    per_item = Window.partitionBy("item")
    words = fixed.select("item", "word").distinct().withColumn(
        "rank", F.row_number().over(per_item.orderBy(F.length("word").desc(), "word")))
    least = fixed.join(words, ["item", "word"]).groupBy("item", "windows", "place").agg(F.min("rank").alias("rank"))
    reached = least.groupBy("item", "windows", "rank").agg(F.count("*").alias("n")).withColumn(
        "n", F.sum("n").over(per_item.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = reached.where((F.col("windows") - F.col("n")) / F.col("windows") < share).groupBy("item").agg(F.min("rank").alias("last"))
    return words.join(last, "item").where(F.col("rank") <= F.col("last")).select("item", "word")


def needed_words(wanted: DataFrame, share: float) -> dict[str, list[int]] | None:
    """Word -> codes (an item's number times NEEDED_GROUPS plus a group); a document that an item contaminates holds a word of
    each of the item's groups.  None where an item has no such words.

    A word of letters that is literal wherever it occurs in an item's windows has to stand in whatever covers a place of
    it.  A group has words in so many of the item's places that the others are too few; later groups take other words
    (an item without enough of them has its first ones there, too)."""
    item = F.struct("item_id", "item_hash").alias("item")
    pairs = F.explode(F.arrays_zip(F.col("item_raw").alias("raw"), F.split("item_template", " ").alias("type"))).alias("p")
    blind = wanted.where("form = 1").select(item, "windows", F.col("first").alias("place"), pairs).where(
        (F.col("p.raw") == F.col("p.type")) & F.col("p.raw").rlike(r"^[\p{L}\p{M}]+$")).select("item", "windows", "place", F.col("p.raw").alias("word"))
    # A word of a typed window's slot may be exchanged there (but for items whose slots have to be equal).
    free = wanted.where("form = 0 and not strict").select(item, pairs).where(_slot(F.col("p.type"))).select(
        "item", F.explode(F.split(_apart(F.col("p.raw")), " ")).alias("word")).distinct()
    left = stored(blind.join(free, ["item", "word"], "left_anti").distinct(), "needed-words")
    items = wanted.select(item).distinct().count()
    codes: dict[str, list[int]] = {}
    numbers: dict[tuple, int] = {}
    first: dict[int, list[str]] = {}
    for group in range(NEEDED_GROUPS):
        chosen = stored(_covering(left, share), "needed-words")
        rows = chosen.select("item.item_id", "item.item_hash", "word").limit(NEEDED_WORDS + 1).collect()
        if len(rows) > NEEDED_WORDS:
            return None
        of: dict[int, list[str]] = {}
        for row in rows:
            of.setdefault(numbers.setdefault((row["item_id"], row["item_hash"]), len(numbers)), []).append(row["word"])
        if not group:
            first = of
            if len(first) < items:
                return None
        for number in first:
            for word in of.get(number, first[number]):
                codes.setdefault(word, []).append(number * NEEDED_GROUPS + group)
        left = left.join(chosen, ["item", "word"], "left_anti")
    return codes


def _holding(rows: DataFrame, codes: dict[str, list[int]]) -> DataFrame:
    """The rows whose text has a word of each group of some item."""
    if not codes:
        return rows.where(F.lit(False))
    names = rows.columns
    # Words are letters: two literals hold them all, whatever their number, instead of an expression for each.
    words = F.split(F.lit(" ".join(sorted(codes))), " ")
    known = F.str_to_map(F.lit(" ".join(f"{w}:{','.join(map(str, codes[w]))}" for w in sorted(codes))), F.lit(" "), F.lit(":"))
    # Generators, so that a condition is not put together with what it is about, and that worked out anew for each element.
    once = lambda c, name: rows.select("*", F.explode_outer(F.array(c)).alias(name))
    rows = once(F.array_intersect(F.split(F.lower(plain(F.col("text"))), " "), words), "held").where(F.size("held") > 0)
    rows = once(F.array_distinct(F.flatten(F.transform("held", lambda w: F.split(F.element_at(known, w), ",").cast("array<int>")))), "codes")
    every = lambda c: F.forall(F.array(*map(F.lit, range(NEEDED_GROUPS))), lambda g: F.array_contains("codes", c + g))
    return rows.where(F.exists("codes", lambda c: (c % NEEDED_GROUPS == 0) & every(c))).select(*names)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = .8, broadcast_rows: int = 1_000_000,
                 whole: bool = False, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, windows, share): a row for each document and item that meet."""
    wanted = item_forms(benchmark) if whole else item_windows(benchmark)
    forms, covers = (["form"], ["first", "last"]) if whole else ([], [])
    if whole:
        wanted = stored(wanted, "item-windows")
        needed = needed_words(wanted, share)
    if _may_be_sent(wanted, broadcast_rows, broadcast_bytes):
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    if whole and needed is not None:
        rows = _holding(rows, needed)
    found = _windows(rows, whole)
    if whole:  # the hits are read twice below; texts are typed once
        found = stored(found.join(wanted, ["hash", *forms], "left_semi"), "matched-windows")
    hits = found.join(wanted, ["hash", *forms])
    slots = F.zip_with(F.arrays_zip(F.split("template", " ").alias("type"), F.col("item_raw").alias("theirs")), F.col("raw"),
                       lambda t, own: F.struct(t["type"].alias("type"), t["theirs"].alias("theirs"), own.alias("own")))
    hits = hits.where(F.col("template") == F.col("item_template")).select(
        "doc_id", "text_hash", "item_id", "item_hash", "windows", "strict", "item_place", *forms, *covers,
        (F.col("place") - F.col("item_place")).alias("shift"), slots.alias("slots"))
    hits = hits.where(~F.col("strict") | ~F.exists("slots", lambda s: s["theirs"] != s["own"]))
    item = ["doc_id", "text_hash", "item_id", "item_hash"]
    if whole:
        hits = hits.withColumn("slots", F.filter(F.transform("slots", lambda s, i: F.struct(
            (F.col("item_place") + i).alias("at"), s["type"].alias("type"), s["theirs"].alias("theirs"), s["own"].alias("own"))),
            lambda s: _slot(s["type"])))
        covered = (_agreeing(hits, [*item, "form", "shift"]).select(*item, "windows", F.explode(F.sequence("first", "last")).alias("place")).distinct()
                   .groupBy(*item, "windows").agg(F.count("*").alias("matched")))
        return _over(covered, share)
    hits = hits.withColumn("slots", F.filter("slots", lambda s: _slot(s["type"])))
    # An alignment has at most the item's windows.
    aligned = hits.groupBy("doc_id", "text_hash", "item_id", "item_hash", "windows", "shift").agg(
        F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    count = lambda *names: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(*[s[n] for n in names]))))
    one_to_one = (count("type", "theirs") == F.size("slots")) & (count("type", "own") == F.size("slots"))
    covered = (aligned.where(one_to_one).select("doc_id", "text_hash", "item_id", "item_hash", "windows",
                                                F.explode("places").alias("place")).distinct()
               .groupBy("doc_id", "text_hash", "item_id", "item_hash", "windows").agg(F.count("*").alias("matched")))
    return _over(covered, share)


def _over(covered: DataFrame, share: float) -> DataFrame:
    return (covered.withColumn("share", F.col("matched") / F.col("windows")).where(F.col("share") >= share)
            .select("doc_id", "text_hash", "item_id", "matched", "windows", "share"))


def clean(docs: DataFrame, benchmark: DataFrame, share: float = .8, whole: bool = False) -> DataFrame:
    """The rows, with all their columns, that no benchmark item contaminates."""
    bad = contaminated(docs, benchmark, share, whole=whole).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct()
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad["__id"]) & (marked["__hash"] == bad["__text"]), "left_anti").drop("__hash")
