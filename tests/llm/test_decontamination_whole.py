"""Decontamination with ``whole``: copies that the plain form loses."""
import random

from logweave.llm import decontamination as D

MARIA = ("Maria walks to the market with her basket and buys ten ripe pears while her neighbour counts the coins; then Maria "
         "cooks the pears, and in the evening Maria shares the sweet jam with every child in the village square")


def found(spark, pairs, **options):
    """{number of the text} of (item, text) pairs in which the item is found."""
    items = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(pairs)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "so: " + text + " - and more") for i, (_, text) in enumerate(pairs)], "doc_id long, text string")
    return {r.doc_id for r in D.contaminated(docs, items, **options).collect() if r.doc_id == r.item_id}


def test_a_disagreeing_slot_costs_its_windows_only(spark):
    halves = MARIA.replace("ten", "40").replace("every", "60")
    pairs = [(MARIA, MARIA.replace("then Maria", "then Mary")),
             (halves, halves.replace("40", "50").replace("60", "50")),  # two values, one partner
             (MARIA, MARIA.replace("Maria", "Paula"))]
    assert found(spark, pairs, whole=True) == {0, 1, 2}
    assert found(spark, pairs) == {2}


def test_other_texts_stay(spark):
    pairs = [(MARIA, "Maria walks to the market with her basket and then reads a long book about ships and the sea")]
    assert found(spark, pairs, whole=True) == set()


def test_letter_case_is_of_no_account(spark):
    pairs = [(MARIA, form(MARIA)) for form in (str.upper, str.lower, str.title)]
    pairs.append((MARIA, MARIA.replace("then Maria cooks the pears", "THEN MARIA COOKS THE PEARS")))
    pairs += [("Paris London Rome Berlin Madrid Vienna", "PARIS LONDON ROME BERLIN MADRID VIENNA"),
              ("Paris London Rome Berlin Madrid Vienna", "oslo lima cairo quito delhi tokyo")]
    assert found(spark, pairs, whole=True) == {0, 1, 2, 3, 4}
    assert not found(spark, pairs) & {0, 1, 2}


def test_a_value_is_one_placeholder(spark):
    costs = ("Anna of Paris saves 1,200 dollars at a rate of 3.5 percent while her brother spends half of it on books; how much "
             "money is left for Anna after the first year")
    other = costs.replace("1,200", "800").replace("3.5", "-4").replace("Paris", "New York")
    names = "while Paris sleeps the tram of Rome rolls past old walls and a dog barks at the moon"
    pairs = [(costs, other), (other, costs), (costs, costs.replace("Anna", "Mary Ann Smith")),
             (names, names.replace("Paris", "New York City").replace("Rome", "Rio de Janeiro"))]
    got = found(spark, pairs, whole=True)
    assert {0, 1, 2} <= got
    assert not found(spark, pairs) & {0, 1}


def test_share_and_broadcast(spark):
    pairs = [(MARIA, MARIA), ("New York City Hall", "NEW YORK CITY HALL"), ("12 of 30", "12 of 30"), ("1,200.5", "1,200.5")]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(pairs)], "doc_id long, text string")
    items = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(pairs)], "item_id long, text string")
    got = [{(r.doc_id, r.share) for r in D.contaminated(docs, items, broadcast_rows=n, whole=True).collect() if r.doc_id == r.item_id}
           for n in (1_000_000, 0)]
    assert got[0] == got[1] == {(0, 1.), (1, 1.), (2, 1.), (3, 1.)}


def test_long_tokens_are_not_broadcast(spark):
    long = " ".join(f"{c}{'x' * 5000}" for c in "abcdefgh")
    items = spark.createDataFrame([(1, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    for whole in (False, True):
        plans = []
        for octets in (64 << 20, 100_000):
            got = D.contaminated(docs, items, whole=whole, broadcast_bytes=octets)
            assert [(r.doc_id, r.share) for r in got.collect()] == [(1, 1.)]
            plans.append(got._jdf.queryExecution().optimizedPlan().toString())
        assert "strategy=broadcast" in plans[0] and "strategy=broadcast" not in plans[1]


def test_needed_words_drop_no_match(spark, monkeypatch):
    """With and without the look-up ahead, on the driver's documents and on edited copies of the items."""
    from tests.conftest import SF_SMALL
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    texts = [r.text for r in items.collect()]
    rng = random.Random(2)
    edited = []
    for k, t in enumerate(texts * 4):
        words = t.split()
        for at in rng.sample(range(len(words)), min(len(words), rng.randrange(5))):
            words[at] = rng.choice([words[at].upper(), "Elsewhere", "17", words[at] + "x"])
        edited.append((100_000 + k, " ".join(words)))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame(edited, "doc_id long, text string"))
    assert D.needed_words(D.item_forms(items), .8)
    key = lambda: sorted((r.doc_id, r.item_id, r.matched) for r in D.contaminated(docs, items, whole=True).collect())
    ahead = key()
    monkeypatch.setattr(D, "needed_words", lambda *_: None)
    assert ahead == key() and len(ahead) > 40


def test_items_without_needed_words_are_found(spark):
    """An item of numbers and names alone turns the look-up off."""
    items = spark.createDataFrame([(1, "Paris 4 Rome 5 Oslo 6 Lima 7"), (2, MARIA)], "item_id long, text string")
    assert D.needed_words(D.item_forms(items.where("item_id = 2")), .8)
    docs = spark.createDataFrame([(1, "x Paris 4 Rome 5 Oslo 6 Lima 7 y"), (2, MARIA), (3, None), (4, "")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items, whole=True).collect()} == {(1, 1), (2, 2)}
    assert D.contaminated(docs, items.limit(0), whole=True).count() == 0


def test_windows_are_typed_once(spark):
    """The windows of the items and the matches are stored before they are used again, so no plan types a text twice."""
    items = spark.createDataFrame([(1, "Alice had 12 apples and gave three of them to her brother Bob yesterday")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "so: Alice had 15 apples and gave three of them to her brother Tom yesterday ok"), (8, "nothing at all")],
                                 "doc_id long, text string")
    typing = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")
    assert typing(D.item_forms(items)) == 0
    found = D.contaminated(docs, items, whole=True)
    assert typing(found) == 0
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(7, 1)]
