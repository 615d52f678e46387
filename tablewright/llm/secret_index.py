"""Secret scans with an inverted index of trigrams.

Every rule's regular expression is read into a Boolean query over trigrams: each
stretch of it that can only be one of a few strings asks for all trigrams of one of
them. The index holds the postings of the trigrams that some rule asks for,
over lower-cased texts. Intersecting postings gives the documents that may match,
and the rule itself is run on those. A rule without a mandatory trigram, such as a
run of hexadecimal digits, is run on every document.

Only DataFrame functions touch the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import full_text, stored
from tablewright.llm.native_spans import SPANS, count_of, spans, written

# Strings of one stretch; beyond that the stretch asks for nothing.
MOST_STRINGS = 64

# A stretch is the sets of trigrams of its possible strings; a query, all stretches of a rule.
Query = list[list[frozenset[str]]]


@dataclass(frozen=True)
class Rule:
    """``group`` is the part of the match that must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def keep(self) -> Callable[[Column], Column] | None:
        return (lambda value: F.char_length(value) >= self.least) if self.least > 1 else None


# The patterns of the contract, then well-known forms of further keys.
RULES = [
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    # runs of 32 and more are the runs that stay
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(parsed) -> list[set[str] | None]:
    """The parts of a parsed expression in order: the strings each can be, or None where there are too many."""
    from re import _constants as op

    parts: list[set[str] | None] = []
    for code, value in parsed:
        if code is op.LITERAL:
            parts.append({chr(value).lower()})
        elif code is op.IN and all(kind is op.LITERAL for kind, _ in value):
            parts.append({chr(v).lower() for _, v in value})
        elif code is op.SUBPATTERN:
            parts += _strings(value[3])
        elif code is op.BRANCH:
            whole = [_joined(_strings(branch)) for branch in value[1]]
            parts.append(None if None in whole else set().union(*whole))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = _joined(_strings(inner))
            if once is None or high > 3:
                parts += [*([once] * min(low, 3) if once else []), None]
            else:
                parts.append({"".join(x) for n in range(low, high + 1) for x in product(once, repeat=n)})
        elif code is not op.AT:
            parts.append(None)
    return parts


def _joined(parts: list[set[str] | None]) -> set[str] | None:
    """All strings of a sequence, or None where one of its parts is open or there are too many."""
    made = {""}
    for part in parts:
        if part is None or len(made) * len(part) > MOST_STRINGS:
            return None
        made = {a + b for a, b in product(made, part)}
    return made


def trigram_query(pattern: str) -> Query:
    """The trigrams that a match must have, lower-cased; empty where none is mandatory."""
    from re import _parser

    query: Query = []
    stretch: set[str] = {""}
    for part in [*_strings(_parser.parse(pattern)), None]:
        if part is not None and len(stretch) * len(part) <= MOST_STRINGS:
            stretch = {a + b for a, b in product(stretch, part)}
            continue
        if min(map(len, stretch)) >= 3:
            sets = {trigrams(s) for s in stretch}
            least = [s for s in sets if not any(other < s for other in sets)]
            query.append(sorted(least, key=sorted))
        stretch = part if part is not None and len(part) <= MOST_STRINGS else {""}
    return query


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, n_<kind> of the base rules, base_sha256, spans), one row per row of ``docs``.

    Places are code points of the whole text. A null text counts as empty and has
    no span; repeated rows give repeated results; an empty table gives an empty one.
    """
    place = {rule.kind: i for i, rule in enumerate(rules)}
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    asked = sorted({t for q in queries.values() for stretch in q for s in stretch for t in s})
    number = {t: i for i, t in enumerate(asked)}

    def run(text: Column, rule: Rule, only: Column | None = None) -> Column:
        return spans(text, rule.kind, place[rule.kind], rule.pattern, rule.keep, rule.group, only)

    text = full_text(docs["text"])
    lower = F.lower(text)
    # A row is known by its id and text, so rows that share an id stay apart.
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))

    open_rules = [rule for rule in rules if not queries[rule.kind]]
    scanned_all = F.concat(
        F.array().cast(SPANS), *[run(F.col("text"), r, F.col("text").rlike(r.pattern)) for r in open_rules]
    )
    hits = [F.when(F.contains(F.col("lower"), F.lit(t)), F.lit(i)) for t, i in number.items()]
    index = stored(
        rows.withColumn("lower", F.lower("text")).select(
            "doc_id", "hash", F.array_compact(F.array(*hits)).alias("trigrams"), scanned_all.alias("spans")
        ),
        "trigram-index",
    )
    postings = index.select("doc_id", "hash", F.explode("trigrams").alias("trigram"))
    counted = {r["trigram"]: r["count"] for r in postings.groupBy("trigram").count().collect()}  # one row per trigram asked for

    # The postings of a document meet in bit masks of 63 trigrams each.
    n_words = max(1, -(-len(asked) // 63))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % 63)
    masks = [
        F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"mask{w}")
        for w in range(n_words)
    ]

    def holds(needed: frozenset[str]) -> Column:
        bits = [0] * n_words
        for t in needed:
            bits[number[t] // 63] |= 1 << (number[t] % 63)
        return _every([F.col(f"mask{w}").bitwiseAND(F.lit(b)) == F.lit(b) for w, b in enumerate(bits) if b])

    indexed = [rule for rule in rules if queries[rule.kind]]
    candidate = {
        rule.kind: _every([_any([holds(s) for s in stretch]) for stretch in queries[rule.kind]]) for rule in indexed
    }
    met = postings.groupBy("doc_id", "hash").agg(*masks)
    possible = met.select("doc_id", "hash", *[c.alias(f"may_{k}") for k, c in candidate.items()]).where(
        _any([F.col(f"may_{k}") for k in candidate])
    )

    # A candidate holds the rarest trigram of some string of a rule's rarest stretch;
    # other texts need not travel to the candidates.
    def rarest(s: frozenset[str]) -> str:
        return min(sorted(s), key=lambda t: counted.get(t, 0))

    entry = set()
    for rule in indexed:
        choices = [[rarest(s) for s in stretch] for stretch in queries[rule.kind]]
        entry |= set(min(choices, key=lambda ts: sum(counted.get(t, 0) for t in ts)))
    fetched = rows.where(_any([F.contains(lower_of("text"), F.lit(t)) for t in sorted(entry)]))
    same = (F.col("d.hash") == F.col("p.hash")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))
    joined = fetched.alias("d").join(possible.alias("p"), same)
    verified = joined.select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("d.hash").alias("hash"),
        F.concat(*[run(F.col("d.text"), r, F.col(f"p.may_{r.kind}")) for r in indexed]).alias("found"),
    )
    verified = verified.where(F.size("found") > 0).groupBy("doc_id", "hash").agg(F.first("found").alias("found"))

    same = (F.col("i.hash") == F.col("v.hash")) & F.col("i.doc_id").eqNullSafe(F.col("v.doc_id"))
    every = F.concat(F.col("i.spans"), F.coalesce(F.col("v.found"), F.array().cast(SPANS)))
    complete = index.alias("i").join(verified.alias("v"), same, "left").select(
        F.col("i.doc_id").alias("doc_id"), every.alias("spans")
    )
    base = [rule.kind for rule in rules if rule.base]
    base_spans = F.filter("spans", lambda s: s["kind"].isin(base))
    return complete.select(
        "doc_id",
        *[count_of(F.col("spans"), kind).alias(f"n_{kind}") for kind in base],
        F.sha2(written(base_spans), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def lower_of(column: str) -> Column:
    return F.lower(F.col(column))
