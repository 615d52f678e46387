"""Personal data by patterns and by bootstrapped context.

Addresses, IP numbers, card numbers and phone numbers are found by their form and
are the seeds. Every place where something like an identifier stands, a seed or not, is a
mention, and the words around it are its patterns: the one, two or three words before it, the
two after it, and the word on each side, with the signs between them, so that ``phone: ``,
``call me at `` and ``"phone": "`` are patterns alike. Patterns and the instances they occur
with form a graph. In every round a pattern is trusted by the share of its instances that are
known, over all documents, and an instance becomes known through the most trusted pattern it
occurs with, so that patterns that never meet a seed can be learned too. What a
trusted pattern stands around is personal data, whatever its form.

Only DataFrame functions touch the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import full_text, stored
from tablewright.llm.native_spans import SPANS, count_of, matches, spans, written

# The forms of the contract. Runs are entered at their first character
# or where the last match ended, and are not given back, which changes no match and
# keeps long runs linear. A card number is a whole run of digits, so 14 to 19 are asked for at once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = ["email", "ip", "card", "phone"]
CONTEXT = "context"

# Something like an identifier: a run of letters, digits and joining signs, or of groups of digits
# with single blanks between them, in which four digits stand close together.
_DIGITS_NEAR = r"(?=[^\s0-9]{0,30}+[0-9](?:[^0-9\n]{0,3}+[0-9]){3})"
IDENTIFIER = (
    r"(?<![\p{L}\p{N}+(._/-])" + _DIGITS_NEAR + r"[\p{L}\p{N}+(](?:[\p{L}\p{N}()._/+-]|(?<=[0-9)])\x20(?=[0-9(]))*+"
)
MENTION = f"(?:{EMAIL}|{IDENTIFIER})"
# Characters looked at on each side of a mention for the words next to it.
BEFORE, AFTER = 80, 60
WORDS_BEFORE, WORDS_AFTER = 3, 2

ROUNDS = 3
SEEDS_ASKED = 3  # known instances that a pattern must have
TRUSTED = 0.7  # share of known instances of a trusted pattern
KNOWN_AT = 0.5
DIGITS_ASKED = 4  # digits of an unseen identifier

_MENTION = "array<struct<start:int,end:int,instance:string,seed:boolean,contexts:array<string>>>"


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, r"[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(match: Column) -> Column:
    return F.char_length(F.regexp_replace(match, r"[^0-9]", ""))


def base_spans(text: Column) -> Column:
    """All spans of the four forms."""
    return F.concat(
        spans(text, "email", 0, EMAIL, only=F.contains(text, F.lit("@"))),
        spans(text, "ip", 1, IP, lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), only=text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
        spans(text, "card", 2, CARD, _luhn, only=text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
        spans(text, "phone", 3, PHONE, lambda m: _digits(m).between(10, 15), only=F.contains(text, F.lit("+"))),
    )


def contexts(before: Column, after: Column) -> Column:
    """The contexts of a mention from the text on each side; blanks are made one, digits 0, letters small."""

    def plain(text: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[0-9]+", "0"))

    left, right = plain(before), plain(after)
    word = r"[\p{L}\p{N}_]++[^\p{L}\p{N}_]*+"
    lefts = [F.regexp_extract(left, f"(?<![\\p{{L}}\\p{{N}}_])((?:{word}){{{n}}})$", 1) for n in range(1, WORDS_BEFORE + 1)]
    one, more = (
        F.regexp_extract(right, f"^((?:[^\\p{{L}}\\p{{N}}_]*+[\\p{{L}}\\p{{N}}_]++){{{n}}})", 1) for n in (1, WORDS_AFTER)
    )
    made = [F.when(c != "", F.concat(c, F.lit("\t"))) for c in lefts]
    # a single word after it says little by itself
    made.append(F.when(more != "", F.concat(F.lit("\t"), more)))
    made.append(F.when((lefts[0] != "") & (one != ""), F.concat(lefts[0], F.lit("\t"), one)))
    return F.array_compact(F.array(*made))


def _mentions(text: Column, base: Column) -> Column:
    """Everything like an identifier with its contexts, and whether a span of a known form overlaps it."""
    found = matches(text, MENTION)
    between = F.split(text, MENTION, -1)
    sides = F.transform(
        found,
        lambda m, i: F.struct(
            F.right(F.get(between, i), F.lit(BEFORE)).alias("before"), F.left(F.get(between, i + 1), F.lit(AFTER)).alias("after")
        ),
    )

    def mention(m: Column, side: Column) -> Column:
        instance = F.regexp_replace(m["value"], r"[^\p{L}\p{N}]+$", "")
        end = m["start"] + F.char_length(instance)
        return F.struct(
            m["start"].alias("start"),
            end.alias("end"),
            F.lower(instance).alias("instance"),
            F.exists(base, lambda s: (s["start"] < end) & (s["end"] > m["start"])).alias("seed"),
            contexts(side["before"], F.concat(F.substring(m["value"], F.char_length(instance) + 1, F.lit(AFTER)), side["after"])).alias("contexts"),
        )

    made = F.zip_with(found, sides, mention).cast(_MENTION)
    return F.when(text.rlike(r"[0-9@]"), made).otherwise(F.array().cast(_MENTION))


def trusted_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, trust) of the patterns trusted after ``rounds``; ``edges`` are distinct (pattern, instance, seed).

    A pattern's trust is the mean of what is known of its instances: 1 of a seed, else the trust of
    the most trusted pattern it occurs with, 0 without one. A pattern is trusted from ``TRUSTED`` on
    if at least ``SEEDS_ASKED`` instances are known. Equal trust needs no order.
    """
    known = edges.where("seed").select("instance", F.lit(1.0).alias("known")).distinct()
    patterns = None
    for _ in range(rounds):
        met = edges.join(known, "instance", "left")
        scored = met.groupBy("pattern").agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce("known", F.lit(0.0))).alias("mass"),
            F.count_if(F.col("known") >= KNOWN_AT).alias("n_known"),
        )
        trust = F.col("mass") / F.col("n")
        patterns = scored.where((F.col("n_known") >= SEEDS_ASKED) & (trust >= TRUSTED)).select("pattern", trust.alias("trust"))
        patterns = stored(patterns, "trusted-patterns")
        found = edges.join(patterns, "pattern").groupBy("instance").agg(
            F.greatest(F.max(F.col("seed").cast("double")), F.max("trust")).alias("known")
        )
        seeds = edges.where("seed").select("instance", F.lit(1.0).alias("known"))
        known = stored(seeds.unionByName(found).groupBy("instance").agg(F.max("known").alias("known")), "known-instances")
    return patterns


def context_graph(mentions: DataFrame) -> DataFrame:
    """Distinct (pattern, instance, seed) of the mentions' contexts; ``mentions`` has one row each.

    Contexts are collapsed before they travel. Those with too few instances can never be trusted and go at once.
    """
    edges = mentions.select(F.explode("contexts").alias("pattern"), "instance", "seed")
    edges = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    enough = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SEEDS_ASKED)
    return edges.join(enough.select("pattern"), "pattern", "left_semi")


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_<kind> of the four forms, base_sha256, spans), one row per row of ``docs``.

    Spans of kind ``context`` are identifiers found by the words around them; they come after
    the four forms. Places are code points of the whole text. A null text counts as
    empty and has no span; repeated rows give repeated results; an empty table
    gives an empty one.
    """
    text = full_text(docs["text"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("hash"), text.alias("text"))
    scanned = rows.withColumn("spans", base_spans(F.col("text")))
    scanned = stored(
        scanned.select("doc_id", "hash", "spans", _mentions(F.col("text"), F.col("spans")).alias("mentions")), "pii-scan"
    )
    mentions = scanned.where(F.size("mentions") > 0).select("doc_id", "hash", F.explode("mentions").alias("m"))
    mentions = mentions.select("doc_id", "hash", "m.*")
    patterns = trusted_patterns(stored(context_graph(mentions), "pii-graph"), rounds)
    unseen = mentions.where(~F.col("seed") & (_digits(F.col("instance")) >= DIGITS_ASKED))
    unseen = unseen.withColumn("pattern", F.explode("contexts")).join(patterns, "pattern", "left_semi")
    span = F.struct("start", F.lit(len(KINDS)).alias("place"), "end", F.lit(CONTEXT).alias("kind"))
    # mentions of one row, so no longer than its text
    found = unseen.groupBy("doc_id", "hash").agg(F.collect_set(span).cast(SPANS).alias("found"))
    same = (F.col("s.hash") == F.col("f.hash")) & F.col("s.doc_id").eqNullSafe(F.col("f.doc_id"))
    every = F.concat(F.col("s.spans"), F.coalesce(F.col("f.found"), F.array().cast(SPANS)))
    complete = scanned.alias("s").join(found.alias("f"), same, "left").select(
        F.col("s.doc_id").alias("doc_id"), F.col("s.spans").alias("base"), every.alias("spans")
    )
    return complete.select(
        "doc_id",
        *[count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
