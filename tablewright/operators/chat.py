"""Chat rendering, from message arrays and from turn tables.

A conversation in a turn table may be of any length. Its turns are first put
together in parts of ``PART_TURNS`` turns and then the parts to one text, so that
only the text itself grows with the conversation.

A conversation with a turn that has no role, or neither text nor tool calls, has no
text. It is left out here and counted by :func:`bad_turns`, as are turns that belong to
no conversation. Turns with the same number are in the order of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Turn markers.
START = "<|im_start|>"
END = "<|im_end|>"
ASSISTANT_OPEN = "<|im_start|>assistant\n"
EMPTY_THINK = "<think>\n\n</think>\n\n"

# The text around the list of tools.
TOOLS_BEFORE = (
    "# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_AFTER = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    "within <tool_call></tool_call> XML tags:\n<tool_call>\n"
    '{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call><|im_end|>\n'
)

PART_TURNS = 1000

NO_CONVERSATION = "turn has no conversation"
NO_ROLE = "turn has no role"
NO_TEXT = "turn has neither text nor tool calls"


def render_turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), content, F.lit(f"{END}\n"))


def render_messages(messages: Column, generation_prompt: bool = False) -> Column:
    """Text of a message array; null for a null or empty one, or where a role or content is null."""
    whole = ~F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull())
    text = F.array_join(F.transform(messages, lambda m: render_turn(m["role"], m["content"])), "")
    if generation_prompt:
        text = F.concat(text, F.lit(ASSISTANT_OPEN))
    return F.when((F.size(messages) > 0) & whole, text)


def render_batches(df: DataFrame, key: str, batch: str = "messages") -> DataFrame:
    """One row per conversation of each batch; empty and null batches give none."""
    return (
        df.select(key, F.posexplode(batch).alias("item", "_messages"))
        .where(F.size("_messages") > 0)
        .select(key, "item", render_messages(F.col("_messages")).alias("text"))
    )


def _has_calls(turns: DataFrame) -> Column:
    return F.size("tool_calls") > 0 if "tool_calls" in turns.columns else F.lit(False)


def _turn_problem(turns: DataFrame) -> Column:
    """Why a turn cannot be rendered; null if it can."""
    return (
        F.when(F.col("conv_id").isNull(), NO_CONVERSATION)
        .when(F.col("role").isNull(), NO_ROLE)
        .when(F.col("text").isNull() & ~F.coalesce(_has_calls(turns), F.lit(False)), NO_TEXT)
    )


def bad_turns(turns: DataFrame) -> DataFrame:
    """(reason, n_turns, n_conversations) of the turns for which conversations are left out.

    Turns without conversation count for none.
    """
    found = turns.select("conv_id", _turn_problem(turns).alias("reason")).where("reason is not null")
    per_conversation = found.groupBy("reason", "conv_id").agg(F.count("*").alias("n"))
    return per_conversation.groupBy("reason").agg(
        F.sum("n").alias("n_turns"), F.count("conv_id").alias("n_conversations")
    )


def _prepared(turns: DataFrame, part_turns: int) -> DataFrame:
    """Turns with their part and whether they can be rendered; a turn of tool calls alone has an empty text."""
    return turns.where("conv_id is not null").withColumns(
        {
            "part": F.expr(f"turn div {int(part_turns)}"),
            "_bad": _turn_problem(turns).isNotNull(),
            "text": F.coalesce("text", F.lit("")),
        }
    )


def _join_parts(pieces: DataFrame, closing: str, part_turns: int) -> DataFrame:
    """Pieces of (conv_id, part, turn, piece, _bad) in turn order as one text per conversation.

    A part that repeated turn numbers have made larger is put together in sections.
    """
    in_part = W.partitionBy("conv_id", "part").orderBy("turn", "piece")
    pieces = pieces.withColumn("_row", F.row_number().over(in_part))
    sections = pieces.withColumn("section", F.expr(f"(_row - 1) div {int(part_turns)}"))
    parts = sections.groupBy("conv_id", "part", "section").agg(
        F.count("*").alias("n"),
        F.max("_bad").alias("_bad"),
        F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("_pieces"),
    )
    text = F.array_join(F.transform("_pieces", lambda p: p["piece"]), "")
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.max("_bad").alias("_bad"),
        F.array_sort(F.collect_list(F.struct("part", "section", text.alias("text")))).alias("_parts"),
    )
    joined = F.array_join(F.transform("_parts", lambda p: p["text"]), "")
    return whole.where(~F.col("_bad")).select(
        "conv_id", "n_turns", F.concat(joined, F.lit(closing)).alias("text")
    )


def render_turns(
    turns: DataFrame, generation_prompt: bool = False, part_turns: int = PART_TURNS
) -> DataFrame:
    """(conv_id, n_turns, text) of a (conv_id, turn, role, text) table."""
    piece = render_turn(F.col("role"), F.col("text")).alias("piece")
    pieces = _prepared(turns, part_turns).select("conv_id", "part", "turn", "_bad", piece)
    return _join_parts(pieces, ASSISTANT_OPEN if generation_prompt else "", part_turns)


def _with_neighbours(turns: DataFrame) -> DataFrame:
    """Add whether the turns before and after are tool turns, and the conversation's marks.

    Only one row per part is windowed over a whole conversation; the turns are
    windowed within their part and take the edges from the neighbouring parts.
    """
    text = F.col("text")
    wrapped = text.startswith("<tool_response>") & text.endswith("</tool_response>")
    query = (F.col("role") == "user") & ~wrapped
    turns = turns.withColumn("tool", F.coalesce(F.col("role") == "tool", F.lit(False)))
    parts = turns.groupBy("conv_id", "part").agg(
        F.min_by("tool", "turn").alias("_first_tool"),
        F.max_by("tool", "turn").alias("_last_tool"),
        F.max(F.when(query, F.col("turn"))).alias("_query"),
        F.min("turn").alias("_first"),
        F.max("turn").alias("_last"),
    )
    in_order = W.partitionBy("conv_id").orderBy("part")
    whole = W.partitionBy("conv_id")
    edges = parts.select(
        "conv_id",
        "part",
        F.lag("_last_tool").over(in_order).alias("_before"),
        F.lead("_first_tool").over(in_order).alias("_after"),
        F.min("_first").over(whole).alias("first_turn"),
        F.max("_last").over(whole).alias("last_turn"),
        F.coalesce(F.max("_query").over(whole), F.max("_last").over(whole)).alias("last_query"),
    )
    in_part = W.partitionBy("conv_id", "part").orderBy("turn")
    before = F.coalesce(F.lag("tool").over(in_part), "_before", F.lit(False))
    after = F.coalesce(F.lead("tool").over(in_part), "_after", F.lit(False))
    return turns.join(edges, ["conv_id", "part"]).withColumns({"after_tool": before, "before_tool": after})


def _tool_calls(calls: Column, content: Column) -> Column:
    newline = F.lit("\n")
    texts = F.transform(
        calls,
        lambda call, i: F.concat(
            F.when((i > 0) | (F.length(content) > 0), newline).otherwise(F.lit("")),
            F.lit('<tool_call>\n{"name": "'),
            call["name"],
            F.lit('", "arguments": '),
            call["arguments"],
            F.lit("}\n</tool_call>"),
        ),
    )
    return F.coalesce(F.array_join(texts, ""), F.lit(""))


def _assistant_piece(turns: DataFrame) -> Column:
    text, newline = F.col("text"), F.lit("\n")
    thinks = text.contains("</think>")
    inner = F.rtrim(F.substring_index(text, "</think>", 1), newline)
    inner = F.ltrim(F.substring_index(inner, "<think>", -1), newline)
    reasoning = F.when(thinks, inner).otherwise(F.lit(""))
    content = F.when(thinks, F.ltrim(F.substring_index(text, "</think>", -1), newline)).otherwise(text)
    if "reasoning_content" in turns.columns:
        given = F.col("reasoning_content")
        reasoning = F.coalesce(given, reasoning)
        content = F.when(given.isNotNull(), text).otherwise(content)
    shown = (F.col("turn") > F.col("last_query")) & (
        (F.col("turn") == F.col("last_turn")) | (F.length(reasoning) > 0)
    )
    block = F.concat(
        F.lit("<think>\n"), F.trim(reasoning, newline), F.lit("\n</think>\n\n"), F.ltrim(content, newline)
    )
    body = F.when(shown, block).otherwise(content)
    if "tool_calls" in turns.columns:
        body = F.concat(body, _tool_calls(F.col("tool_calls"), content))
    return render_turn(F.lit("assistant"), body)


def _tool_piece() -> Column:
    opening = F.when(F.col("after_tool"), "").otherwise(f"{START}user")
    closing = F.when(F.col("before_tool"), "").otherwise(f"{END}\n")
    return F.concat(
        opening, F.lit("\n<tool_response>\n"), F.col("text"), F.lit("\n</tool_response>"), closing
    )


def render_template(
    turns: DataFrame,
    generation_prompt: bool = False,
    thinking: bool = True,
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """The full chat template over a turn table: (conv_id, n_turns, text).

    Handles leading and later system turns, runs of ``tool`` turns, reasoning
    before ``</think>`` and, where the columns are there, ``reasoning_content``,
    ``tool_calls`` (array of name and argument text) and ``tools`` (array of
    JSON texts, read from the first turn). Other roles give no text.
    """
    full = _with_neighbours(_prepared(turns, part_turns))
    role, text = F.col("role"), F.col("text")
    leading = F.col("turn") == F.col("first_turn")
    piece = (
        F.when((role == "user") | ((role == "system") & ~leading), render_turn(role, text))
        .when(role == "assistant", _assistant_piece(full))
        .when(role == "tool", _tool_piece())
        .otherwise(F.lit(""))
    )
    head = F.when(leading & (role == "system"), render_turn(role, text)).otherwise(F.lit(""))
    if "tools" in turns.columns:
        listed = F.array_join(F.transform("tools", lambda t: F.concat(F.lit("\n"), t)), "")
        with_tools = F.concat(
            F.lit(f"{START}system\n"),
            F.when(role == "system", F.concat(text, F.lit("\n\n"))).otherwise(F.lit("")),
            F.lit(TOOLS_BEFORE),
            listed,
            F.lit(TOOLS_AFTER),
        )
        head = F.when(leading & (F.size("tools") > 0), with_tools).otherwise(head)
    pieces = full.select("conv_id", "part", "turn", "_bad", F.concat(head, piece).alias("piece"))
    generation = ASSISTANT_OPEN + ("" if thinking else EMPTY_THINK) if generation_prompt else ""
    return _join_parts(pieces, generation, part_turns)
