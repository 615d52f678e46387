"""Places of regular expression matches as column expressions, in code points.

Spark gives the matches of a pattern and the text between them; running sums over
their lengths give the places. No Python runs on the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"
_FOUND = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, value) of the leftmost non-overlapping matches; ``value`` is the group's text.

    The pattern must not match an empty text.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the last piece stands after the last match
    between = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    zipped = F.zip_with(
        between, whole, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len"), m.alias("value"))
    )
    if group:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        zipped = F.zip_with(
            zipped, values, lambda z, v: F.struct(z["gap"].alias("gap"), z["len"].alias("len"), v.alias("value"))
        )

    def step(state: Column, z: Column) -> Column:
        start = state["at"] + z["gap"]
        end = start + z["len"]
        found = F.struct(start.alias("start"), end.alias("end"), z["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found"))
    return F.aggregate(zipped, empty, step, lambda state: state["found"])


def spans(
    text: Column,
    kind: str,
    place: int,
    pattern: str,
    keep: Callable[[Column], Column] | None = None,
    group: int = 0,
    only: Column | None = None,
) -> Column:
    """Matches of one kind as (start, place, end, kind), ``place`` being the kind's rank among equal starts.

    ``keep`` says which matches stay, by their value. ``only`` is a cheap condition
    without which there is no match.
    """
    found = matches(text, pattern, group)
    if keep:
        found = F.filter(found, lambda m: keep(m["value"]))
    made = F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(place).alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    ).cast(SPANS)
    return made if only is None else F.when(only, made).otherwise(F.array().cast(SPANS))


def written(found: Column) -> Column:
    """``kind:start:end`` by start and then rank, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
