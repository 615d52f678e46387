"""Spans of turns under black-box templates."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tablewright.llm import chat_spans
from tablewright.llm.chat_spans import escape, formatted_turns, marked_turns, unescape

SCHEMA = "conv_id long, turn long, role string, text string, position int, start int, piece string"


@given(st.text())
def test_escapes_are_reversible_and_hide_control_strings(text):
    hidden = escape(text)
    assert unescape(hidden) == text
    assert not any(mark in hidden for mark in ("<", "[", "|"))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def test_spans_cover_the_formatted_text(spark):
    turns = [("user", "hi <|user|> there"), ("assistant", "</s>[INST] ok [/INST]"), ("user", ""), ("assistant", "\\<")]
    rows = [(1, i, role, text) for i, (role, text) in enumerate(turns)]
    made = formatted_turns(frame(spark, rows)).orderBy("position").collect()
    whole = marked_turns(turns)
    assert "".join(r["piece"] for r in made) == whole
    for r, (role, text) in zip(made, turns, strict=True):
        assert whole[r["start"] : r["end"]] == r["piece"] and r["role"] == role
        assert unescape(whole[r["text_start"] : r["text_end"]]) == text
        assert not r["rewrites_history"]


def test_long_conversations_go_through_the_window(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} [x]") for i in range(500)]
    made = formatted_turns(frame(spark, rows), window=8).orderBy("position").collect()
    whole = marked_turns([(r, t) for _, _, r, t in rows])
    assert [whole[r["start"] : r["end"]] for r in made] == [r["piece"] for r in made]
    assert "".join(r["piece"] for r in made) == whole


def test_a_template_that_rewrites_history_is_noticed(spark):
    def counted(turns):
        return f"{len(turns)} turns:" + "".join(text for _, text in turns)

    rows = [(1, i, "user", f"t{i}") for i in range(4)]
    assert any(r["rewrites_history"] for r in formatted_turns(frame(spark, rows), counted).collect())


@pytest.mark.parametrize("name", ["headed", "forgetful"])
def test_long_conversations_are_rendered_from_their_first_turn(spark, name):
    def headed(turns):
        """The system message first, alternation from the first turn asked for, turns numbered."""
        system = [text for role, text in turns[:1] if role == "system"]
        rest = turns[len(system) :]
        if any(role != ("user", "assistant")[i % 2] for i, (role, _) in enumerate(rest)):
            raise ValueError("roles must alternate")
        return "".join(f"<<{text}>>" for text in system) + "".join(f"[{i}] {text}\n" for i, (_, text) in enumerate(rest))

    def forgetful(turns):
        """The first turn is blotted out once there are a hundred."""
        return "".join("gone\n" if i == 0 and len(turns) >= 100 else f"{text}\n" for i, (_, text) in enumerate(turns))

    template = {"headed": headed, "forgetful": forgetful}[name]
    turns = [("system", "be kind"), *[(("user", "assistant")[i % 2], f"turn {i}") for i in range(149)]]
    made = formatted_turns(frame(spark, [(1, i, *turn) for i, turn in enumerate(turns)]), template).orderBy("position").collect()
    for n, r in enumerate(made):
        before, after = template(turns[:n]), template(turns[: n + 1])
        assert after[r["start"] : r["end"]] == r["piece"] and r["end"] == len(after)
        assert after[r["text_start"] : r["text_end"]] == turns[n][1]
        assert r["rewrites_history"] == (not after.startswith(before)) == (name == "forgetful" and n == 99)


def test_odd_turns(spark):
    rows = [(None, 0, None, None), (2, None, "user", "first"), (2, 1, "user", "b"), (2, 1, "user", "b"), (2, 1, "assistant", "a")]
    made = formatted_turns(frame(spark, rows)).orderBy("conv_id", "position").collect()
    assert [(r["conv_id"], r["role"], unescape(r["piece"])) for r in made[1:3]] == [
        (2, "user", "<|user|>\nfirst</s>\n"),
        (2, "assistant", "<|assistant|>\na</s>\n"),
    ]
    assert len(made) == 5 and made[0]["role"] == ""
    digests = chat_spans.conversation_digests(formatted_turns(frame(spark, rows))).collect()
    assert sorted((r["n_turns"], r["loss_chars"]) for r in digests) == [(1, 0), (4, 1)]
    assert formatted_turns(frame(spark, rows[:0])).collect() == []


def shortened(turns):
    """Older assistant turns are cut to their first character."""
    last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
    return "".join(f"<{role[0]}>{text if role == 'user' or i == last else text[:1]}\n" for i, (role, text) in enumerate(turns))


def blotted(turns):
    return "".join("gone\n" if i == 0 and len(turns) >= 4 else f"{text}\n" for i, (_, text) in enumerate(turns))


def summed(turns):
    return f"{len(turns)} turns:" + "".join(text for _, text in turns)


@pytest.mark.parametrize("template", [marked_turns, shortened, blotted, summed])
def test_every_span_stands_in_the_outputs_it_holds_for(spark, template):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    turns = [("user", "abc"), ("assistant", "long answer"), ("user", "b"), ("assistant", "other answer"), ("user", "c"), ("assistant", "x")]
    rows = [(c, i, *turn) for c, n in ((1, 6), (2, 3), (3, 1)) for i, turn in enumerate(turns[:n])]
    made = formatted_turns(frame(spark, rows), template).collect()
    assert len(made) == 10
    for r in made:
        n = {1: 6, 2: 3, 3: 1}[r["conv_id"]]
        assert r["position"] <= r["holds_to"] < n
        outputs = [template(turns[: k + 1]) for k in range(n)]
        assert all(out[r["start"] : r["end"]] == r["piece"] for out in outputs[r["position"] : r["holds_to"] + 1])
        # beyond it, a later turn has rewritten what stands there
        assert r["holds_to"] == n - 1 or not outputs[r["holds_to"] + 1].startswith(outputs[r["holds_to"]][: r["end"]])
