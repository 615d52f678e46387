"""The chat template against a plain turn-by-turn rendering."""

import random

import pytest
from tablewright.operators import chat

SCHEMA = (
    "conv_id int, turn long, role string, text string, reasoning_content string, "
    "tool_calls array<struct<name: string, arguments: string>>, tools array<string>"
)


def conversations(seed, n=60):
    rng = random.Random(seed)
    texts = ["hi", "", "<tool_response>t</tool_response>", "a\n", "<think>\nwhy\n</think>\n\nyes", "b</think>c</think>\n\nd"]
    rows = []
    for conv in range(n):
        tools = rng.choice([None, [], ['{"name": "f"}', '{"name": "g"}']])
        turn = 0
        for _ in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "tool", "tool", "system", "other"])
            calls = rng.choice([None, [("f", '{"x": 1}')], [("f", "{}"), ("g", "[]")]]) if role == "assistant" else None
            reasoning = rng.choice([None, None, "because\n", ""]) if role == "assistant" else None
            rows.append((conv, turn, role, rng.choice(texts), reasoning, calls, tools))
            turn += rng.choice([1, 1, 3])
    return rows


def plain(turns, generation_prompt, thinking):
    """One conversation, turn by turn."""
    out = []
    roles = [t[2] for t in turns]
    first_text = turns[0][3]
    if turns[0][6]:
        out.append("<|im_start|>system\n" + (first_text + "\n\n" if roles[0] == "system" else ""))
        out.append(chat.TOOLS_BEFORE + "".join("\n" + t for t in turns[0][6]) + chat.TOOLS_AFTER)
    elif roles[0] == "system":
        out.append(f"<|im_start|>system\n{first_text}<|im_end|>\n")
    asked = [
        i for i, t in enumerate(turns)
        if t[2] == "user" and not (t[3].startswith("<tool_response>") and t[3].endswith("</tool_response>"))
    ]
    last_query = asked[-1] if asked else len(turns) - 1
    for i, (_, _, role, text, given, calls, _) in enumerate(turns):
        if role == "user" or (role == "system" and i > 0):
            out.append(f"<|im_start|>{role}\n{text}<|im_end|>\n")
        elif role == "assistant":
            reasoning = given
            if given is None:
                reasoning = ""
                if "</think>" in text:
                    reasoning = text.split("</think>")[0].rstrip("\n").split("<think>")[-1].lstrip("\n")
                    text = text.split("</think>")[-1].lstrip("\n")
            body = text
            if i > last_query and (i == len(turns) - 1 or reasoning):
                stripped = reasoning.strip("\n")
                body = f"<think>\n{stripped}\n</think>\n\n" + text.lstrip("\n")
            for j, (name, arguments) in enumerate(calls or []):
                body += "\n" if j or text else ""
                body += f'<tool_call>\n{{"name": "{name}", "arguments": {arguments}}}\n</tool_call>'
            out.append(f"<|im_start|>assistant\n{body}<|im_end|>\n")
        elif role == "tool":
            if i == 0 or roles[i - 1] != "tool":
                out.append("<|im_start|>user")
            out.append(f"\n<tool_response>\n{text}\n</tool_response>")
            if i == len(turns) - 1 or roles[i + 1] != "tool":
                out.append("<|im_end|>\n")
    if generation_prompt:
        out.append("<|im_start|>assistant\n" + ("" if thinking else "<think>\n\n</think>\n\n"))
    return "".join(out)


def whole(df):
    rows = df.collect()
    texts = {row.conv_id: row.text for row in rows}
    assert len(texts) == len(rows)
    return texts


@pytest.mark.parametrize("part_turns", [1, 3, 1000])
@pytest.mark.parametrize("generation_prompt, thinking", [(False, True), (True, False)])
def test_template(spark, part_turns, generation_prompt, thinking):
    rows = conversations(part_turns)
    df = chat.render_template(spark.createDataFrame(rows, SCHEMA), generation_prompt, thinking, part_turns)
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], []).append(row)
    expected = {c: plain(turns, generation_prompt, thinking) for c, turns in by_conv.items()}
    assert whole(df) == expected


@pytest.mark.parametrize("part_turns", [2, 1000])
def test_simple_rendering_in_parts(spark, part_turns):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(7)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    turns = "".join(f"<|im_start|>{r}\n{m}<|im_end|>\n" for _, _, r, m in rows[:7])
    got = chat.render_turns(df, generation_prompt=True, part_turns=part_turns)
    assert whole(got) == {
        1: turns + "<|im_start|>assistant\n",
        2: "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n",
    }


def test_messages_and_batches(spark):
    schema = "id int, messages array<array<struct<role: string, content: string>>>"
    rows = [(1, [[("user", "a")], [("user", "b"), ("assistant", "c")], []]), (2, []), (3, None)]
    got = chat.render_batches(spark.createDataFrame(rows, schema), "id").collect()
    assert {(r.id, r.item): r.text for r in got} == {
        (1, 0): "<|im_start|>user\na<|im_end|>\n",
        (1, 1): "<|im_start|>user\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n",
    }


@pytest.mark.parametrize("turns", [range(2500), (999, 1000), (0, 5_000_000)])
def test_a_conversation_is_one_row(spark, turns):
    rows = [(1, t, "user", f"m{t}") for t in turns]
    df = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string")
    expected = {1: "".join(f"<|im_start|>user\nm{t}<|im_end|>\n" for t in turns)}
    assert whole(chat.render_turns(df)) == expected == whole(chat.render_template(df))


def test_turns_without_text(spark):
    calls = [("f", "{}")]
    rows = [
        (1, 0, "user", "q", None), (1, 1, "assistant", None, calls), (2, 0, "user", None, None),
        (2, 1, "assistant", "a", None), (3, 0, None, "x", None), (3, 1, "user", None, []),
    ]
    schema = "conv_id int, turn long, role string, text string, tool_calls array<struct<name: string, arguments: string>>"
    df = spark.createDataFrame(rows, schema)
    got = whole(chat.render_template(df))
    call = '<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call>'
    assert set(got) == {1} and f"assistant\n<think>\n\n</think>\n\n{call}<|im_end|>" in got[1]
    assert {(r.reason, r.n_turns, r.n_conversations) for r in chat.bad_turns(df).collect()} == {
        (chat.NO_TEXT, 2, 2), (chat.NO_ROLE, 1, 1),
    }


def test_messages_with_nulls_have_no_text(spark):
    from pyspark.sql import functions as F

    schema = "messages array<struct<role: string, content: string>>"
    df = spark.createDataFrame([([("user", "a"), ("user", None)],), ([("user", "a")],), ([],), (None,)], schema)
    texts = [r.text for r in df.select(chat.render_messages(F.col("messages")).alias("text")).collect()]
    assert [t is None for t in texts] == [True, False, True, True]
