"""Benchmark decontamination against brute force on a fixture."""
import re

import pytest

from logweave.llm import decontamination as D

ITEMS = [
    (1, "Alice buys 12 apples for 3 dollars each and gives Bob 5 of the apples. How many apples does Alice keep?"),
    (2, "the quick brown fox jumps over the lazy dog while seven small cats sleep near the old barn"),
    (3, None), (4, ""), (5, "Paris London Rome Berlin Madrid Vienna"), (6, "too short"),
    (2, "the quick brown fox jumps over the lazy dog while seven small cats sleep near the old barn"),
]
DOCS = [
    (10, "Some words before. " + ITEMS[0][1] + " Some words after."),                       # copied
    (11, "x " + ITEMS[0][1].replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "30").replace(" 5 ", " 8 ")),
    (12, ITEMS[0][1].replace("Alice keep", "Carol keep")),                                   # slots do not agree
    (13, ITEMS[1][1].upper()), (14, "the quick brown fox jumps over the lazy dog"), (15, None), (16, ""), (17, "too short"),
    (18, "Oslo Lima Cairo Quito Delhi Tokyo"), (19, "see Paris London Rome Berlin Madrid Vienna now"),
    (20, ITEMS[1][1]), (20, ITEMS[1][1]), (None, "so " + ITEMS[1][1]),
]


def plain_tokens(text):
    return re.findall(r"[^\W_]+", text or "")


def plain_types(words):
    out = []
    for i, w in enumerate(words):
        if w[0].isdigit():
            out.append("<num>")
        elif w.lower() in D.UNITS and i and words[i - 1][0].isdigit():
            out.append("<unit>")
        elif w[0].isupper() and w.lower() not in D.FUNCTION_WORDS:
            out.append("<name>")
        else:
            out.append(w.lower())
    return out


def plain_contaminated(docs, items, share=.8):
    found = set()
    for item, text in set(items):
        raw = plain_tokens(text)
        kinds = plain_types(raw)
        n = max(len(raw) - 4, 1) if raw else 0
        literal = [sum(not k.startswith("<") for k in kinds[i:i + 5]) >= 2 for i in range(n)]
        strict = not any(literal)
        wanted = [i for i in range(n) if strict or literal[i]]
        for doc, body in docs:
            own = plain_tokens(body)
            own_kinds = plain_types(own)
            by_shift = {}
            for j in range(max(len(own) - 4, 1) if own else 0):
                for i in wanted:
                    if own_kinds[j:j + 5] == kinds[i:i + 5]:
                        pairs = {(k, a.lower(), b.lower()) for k, a, b in zip(kinds[i:i + 5], raw[i:i + 5], own[j:j + 5], strict=True)
                                 if k.startswith("<")}
                        if not strict or all(a == b for _, a, b in pairs):
                            places, slots = by_shift.setdefault(j - i, (set(), set()))
                            places.add(i)
                            slots |= pairs
            covered = set()
            for places, slots in by_shift.values():
                if len({s[:2] for s in slots}) == len(slots) == len({(s[0], s[2]) for s in slots}):
                    covered |= places
            if wanted and len(covered) / len(wanted) >= share:
                found.add((doc, item, len(covered), len(wanted)))
    return found


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_matches_brute_force(spark, broadcast_rows):
    docs = spark.createDataFrame([(d, t, 0) for d, t in DOCS], "doc_id long, text string, hash int")
    items = spark.createDataFrame([(i, t, "e") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.matched, r.windows) for r in D.contaminated(docs, items, broadcast_rows=broadcast_rows).collect()}
    assert got == plain_contaminated(DOCS, ITEMS)
    pairs = {(d, i) for d, i, *_ in got}
    assert {(10, 1), (11, 1), (20, 2), (None, 2), (19, 5), (17, 6)} <= pairs
    assert not {d for d, _ in pairs} & {12, 14, 15, 16, 18}


def test_clean_keeps_the_rest(spark):
    docs = spark.createDataFrame([(d, t, 0) for d, t in DOCS], "doc_id long, text string, hash int")
    items = spark.createDataFrame([(2, ITEMS[1][1])], "item_id long, text string")
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [10, 11, 12, 13, 14, 15, 16, 17, 18, 19]
    none = items.limit(0)
    assert D.clean(docs, none).count() == len(DOCS) and D.clean(docs.limit(0), items).count() == 0
