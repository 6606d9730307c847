"""Line deduplication beyond equal and one-word-apart lines of blank-separated words."""
import random

from logweave.llm import line_dedup as L
from tests.llm.test_line_dedup import words_apart


def removed(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.removed_lines for r in L.dedup_lines(df, **options).collect()}


def test_lines_without_blanks(spark):
    texts = ["段落没有空格的文字也要去重", "段落没有空格的文字也要去重", "https://example.org/a/long/path?page=1\nok", "https://example.org/a/long/path?page=1\nok"]
    assert removed(spark, texts, least_bytes=12) == {0: 0, 1: 1, 2: 0, 3: 1}
    assert removed(spark, texts) == {0: 0, 1: 0, 2: 0, 3: 0}


def edited(words, edits, rng):
    words = list(words)
    for k in range(edits):
        at, kind = rng.randrange(len(words)), rng.choice("ria")
        if kind == "r":
            words[at] = f"new{k}"
        elif kind == "i":
            words.insert(at, f"new{k}")
        else:
            del words[at]
    return words


def test_the_bound_grows_with_the_line(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    lines = [[rng.choice(vocab) for _ in range(n)] for n in (40, 61, 147, 214, 400)]
    lines += [edited(line, k, rng) for line in lines[:5] for k in (2, 3, len(line) // 20, len(line) // 20 + 2, len(line) // 9)]
    passage = [rng.choice(vocab) for _ in range(80)]
    lines += [[rng.choice(vocab) for _ in range(30)] + passage + [rng.choice(vocab) for _ in range(30)] for _ in range(6)]
    chars = "".join(chr(0x4e00 + rng.randrange(300)) for _ in range(100))
    texts = [" ".join(line) for line in lines] + [chars, chars[:30] + "一二" + chars[32:], chars[:50] + chars[70:]]
    want = {}
    for i, text in enumerate(texts):
        units = lambda t: t.split(" ") if " " in t else list(t)
        want[i] = 0
        for other in texts[:i]:
            short = min(len(units(text)), len(units(other)))
            want[i] |= words_apart(units(text), units(other)) <= max(1, short // 20)
    assert sum(want.values()) >= 12
    assert removed(spark, texts, least_bytes=12, grown=True) == {i: int(x) for i, x in want.items()}
    assert sum(removed(spark, texts, least_bytes=12).values()) == 0
