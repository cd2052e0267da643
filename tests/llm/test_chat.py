import re

from folioscope.llm import chat as c
from hypothesis import given, settings, strategies as st

from . import brute

BITS = st.sampled_from([*c._CONTROL, "\\", "<", ">", "[", "]", "/", "s>", "INST]", " ", "é", "\n", "\x00", "x", "<\\s>"])
TEXT = st.lists(BITS, max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]x"]), TEXT), max_size=5))
def test_round_trip(turns):
    text, spans, loss, rewritten = c.locate(turns, c.instruct)
    assert not rewritten and c.parse(text) == turns and "".join(text[i:j] for i, j in spans) == text
    assert [c.unescape(text[i:j]) for i, j in loss] == [x for r, x in turns if r == "assistant"]
    assert all(x not in c.escape(t) for _, t in turns for x in c._CONTROL)


def test_rewriting_templates_are_found():
    def last_first(turns):
        return "".join(f"<{r}>{x}" for r, x in reversed(turns))

    assert c.locate([("user", "a"), ("assistant", "b")], last_first)[3] and not c.is_local(last_first) and c.is_local(c.instruct)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST]"), (2, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (3, 0, "assistant", ""),
    (None, 1, "assistant", "é𝄞\\"), (None, None, "user", "n"), (4, 0, "tool", "long " * 30000),
] + [(9, i, ("user", "assistant")[i % 2], f"turn {i} \\ [/INST]") for i in range(700)]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 1, "y") for r in ROWS], "conv_id long, turn long, role string, text string, part int, formatted string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.digest(c.format_conversations(df.repartition(7))).collect()}
    assert got == brute.chat(ROWS)
    whole = c.format_conversations(df, template=lambda t: "^" + c.instruct(t)).collect()
    assert {r.conv_id: r.n_turns for r in whole} == {k: v[0] for k, v in brute.chat(ROWS).items()}
    assert c.digest(c.format_conversations(df.limit(0))).count() == 0


def without_thoughts(turns):
    """Strips thoughts from all assistant turns but the last."""
    last = len(turns) - 1
    return "".join(f"<{r}>{re.sub('<think>.*?</think>', '', x) if r == 'assistant' and k < last else x}" for k, (r, x) in enumerate(turns))


def test_undeclared_templates_are_rendered_whole(spark):
    turns = [(("user", "assistant")[i % 2], f"<think>{i}</think>said {i}") for i in range(130)]
    df = spark.createDataFrame([(1, i, r, x) for i, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert c.is_local(without_thoughts)
    got = c.format_conversations(df, template=without_thoughts).collect()
    assert [(r.n_turns, r.formatted, r.rewritten) for r in got] == [(130, without_thoughts(turns), True)]
    assert len(c.format_conversations(df).collect()) > 1
