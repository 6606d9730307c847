"""Chat formatting: exact round trips."""
import hashlib
import random

import pytest

from logweave.llm import chat_format as C


@pytest.mark.parametrize("seed", range(3))
def test_any_content_comes_back(seed):
    rng = random.Random(seed)
    bits = [*C.CONTROL, "\\", "<", "[", ">", "/", "SYS>>", "a", "\n", "é", ""]
    for _ in range(800):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "</s>", "x\\"]), "".join(rng.choice(bits) for _ in range(rng.randrange(6))))
                 for _ in range(rng.randrange(5))]
        text, spans, _ = C.format_conversation(turns)
        assert [t[:2] for t in C.parse(text)] == turns
        assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        for _, _, begin, end in C.parse(text):
            assert not any(c in text[begin:end] for c in C.CONTROL)


def test_plain_content_is_not_escaped():
    assert C.format_conversation([("user", "a < b [x]"), ("assistant", "ok")]) == ("[INST]a < b [x][/INST]<s>ok</s>", [(25, 27)], 0)
    assert C.format_conversation([("user", "a\\b")])[2] == 1


@pytest.mark.parametrize("text", ["x", "<s>open", "[INST]a[/INST]tail", "<s>a<s>b</s></s>", "[ROLE]r[/ROLE]text"])
def test_other_texts_are_no_conversations(text):
    assert C.parse(text) is None


def test_table(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, None, None), (2, None, "user", "first"), (None, 0, "user", "q"),
            (1, 1, "assistant", "two"), (3, 0, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in C.digests(C.format_chats(df)).collect()}
    want = {1: [("user", "one"), ("assistant", "two"), ("assistant", "two")], 2: [("user", "first"), ("", "")], None: [("user", "q")],
            3: [("assistant", "</s>[INST] ok [/INST]")]}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), sha(loss))
        assert got[k].formatted_chars == len(C.format_conversation(turns)[0])
    assert len(got) == 4 and C.format_chats(df.limit(0)).count() == 0
