"""Chat formatting with a black-box template and the span of every turn.

The template is a function from turns to one text and nothing else is known of
it. Successive prefixes of a conversation are rendered; where an output begins
with the one before, the rest is the new turn's span, else the template has
rewritten history. Two renderings with different single characters in place of
the text show where the text lies within the span. A span counts in the outputs from its own
turn on until one that rewrites it; ``holds_to`` names the last such turn.

Every turn is rendered with all turns before it, as a template may depend on the
first turn or on their number. A task streams conversations in turn order and holds
one of them; its time grows with the square of a conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import arrow_schema, full_text, map_batches, record_batch

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

SPANS = (
    "conv_id long, position long, role string, start long, end long, text_start long, text_end long, "
    "piece string, rewrites_history boolean, holds_to long"
)
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)

# Turn marks; an escape and the characters that begin a control string.
OPEN, CLOSE, END = "<|", "|>\n", "</s>\n"
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
_PIECE = re.compile(r"<\|([^|]*)\|>\n(.*)</s>\n", re.DOTALL)
_ESCAPED = re.compile("[" + "".join(map(re.escape, ESCAPES)) + "]")
_PLAIN = {code: plain for plain, code in ESCAPES.items()}


def escape(text: str) -> str:
    """Reversible, and free of any control string such as ``</s>``, ``<|user|>`` or ``[INST]``."""
    return _ESCAPED.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: _PLAIN[m[0]], text, flags=re.DOTALL)


def marked_turns(turns: Sequence[Turn]) -> str:
    """The template of the package: every turn marked by its role and ended by ``</s>``."""
    return "".join(f"{OPEN}{escape(role)}{CLOSE}{escape(text)}{END}" for role, text in turns)


def _common(a: str, b: str) -> int:
    """Length of the common beginning; the usual case, that one continues the other, is seen at once."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def span_of_next(history: list[Turn], before: str, turn: Turn, template: Template) -> tuple[str, str, int, int, bool]:
    """(output, new piece, start and end of the text in the piece, rewritten).

    For a template that rewrites history the piece begins where the outputs part.
    """
    after = template([*history, turn])
    shared = _common(before, after)
    one, other = (template([*history, (turn[0], c)]) for c in "\x01\x02")
    head = _common(one, other)
    tail = _common(one[::-1], other[::-1])
    return after, after[shared:], max(0, head - shared), len(after) - tail - shared, shared < len(before)


def _spans(template: Template, window: int | None):
    schema = arrow_schema(SPANS)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, current = False, None
        history: list[Turn] = []
        held: list[list] = []  # rows of the current conversation; the last field is set where a rewrite ends them
        position = 0

        def ended() -> list[tuple]:
            return [(*row[:-1], position - 1 if row[-1] is None else row[-1]) for row in held]

        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not started or conv != current:
                    rows += ended()
                    started, current = True, conv
                    history, output, length, position, held = [], template([]), 0, 0, []
                    length = len(output)
                elif len(history) == window:
                    history = history[window // 2 :]
                    output = template(history)
                was = len(output)
                output, piece, a, b, rewritten = span_of_next(history, output, (role, text), template)
                start = length - (was - (len(output) - len(piece)))
                length = start + len(piece)
                if rewritten:
                    for row in held:
                        if row[-1] is None and row[4] > start:  # it reaches beyond what the outputs share
                            row[-1] = position - 1
                held.append([conv, position, role, start, length, start + a, start + b, piece, rewritten, None])
                history.append((role, text))
                position += 1
            yield record_batch(schema, rows)
        yield record_batch(schema, ended())

    return spans


def formatted_turns(conversations: DataFrame, template: Template = marked_turns, window: int | None = None) -> DataFrame:
    """One row per turn, in order: its place in the formatted text, and the piece of it that the turn made.

    ``holds_to`` is the position of the last turn in whose output, with all turns before it, the piece stands at that
    place; it is the conversation's last turn unless a later one rewrites history.

    Turns are ordered by ``turn``, nulls first, then role and text; repeated turns
    all stay. Null roles and texts are empty, and rows without conv_id are one
    conversation. An empty table gives an empty result. Partitions are in
    conversation and turn order, and whole conversations lie in one.

    ``window`` is the caller's word that no turn's piece depends on turns further back
    than half of it; long conversations are then continued on their latest turns.
    Without it the results are those of the real outputs for any template.
    """
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        full_text(conversations["role"]).alias("role"),
        full_text(conversations["text"]).alias("text"),
        conversations["turn"].alias("turn"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return map_batches(ordered, _spans(template, window), SPANS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(DIGESTS)
    state: list | None = None

    def ended() -> tuple:
        conv, n, turns, chars, loss, length = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), length

    for batch in batches:
        rows = []
        names = ("conv_id", "piece", "start", "text_start", "text_end")
        for conv, piece, start, low, high in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if state is None or conv != state[0]:
                if state is not None:
                    rows.append(ended())
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = map(unescape, _PIECE.fullmatch(piece).groups())
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                masked = unescape(piece[low - start : high - start])
                state[3] += len(masked)
                state[4].update(masked.encode())
            state[5] += len(piece)
        if rows:
            yield record_batch(schema, rows)
    if state is not None:
        yield record_batch(schema, [ended()])


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Read formatted turns back and digest each conversation; the loss mask is on assistant texts.

    ``turns`` come from :func:`formatted_turns` with the package's own template.
    """
    return map_batches(turns, _digests, DIGESTS)
