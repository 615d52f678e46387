"""Byte-pair encoding in numpy rounds over many words at once, and decoding.

The symbols of all words of a batch lie in one flat array. A round looks up every
pair of neighbours by binary search over the sorted keys of the merges, takes the
lowest rank in each word, and merges that pair wherever it stands in the word. Words
without a pair left leave the array. A word takes at most as many rounds as it has
different merges.

Text is handled as the tokenizer file says: added tokens are cut out first, the rest
is put into composed form and lower case, cut into letters, single digits and other
signs, and read as bytes; a word's last symbol carries the end mark. Only words not
yet met by the worker are merged: a batch is cut at white space, its distinct
stretches are looked up in a table of bounded size, and ids are taken by index.

Null texts count as empty and have no ids. Rows are never joined or grouped, so
repeated rows and ties need no rule. Characters are classed, lower-cased and composed
by Python's own Unicode tables; a library built with other versions can differ on
characters that came into Unicode after 13.0.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame

from tablewright.llm.common import full_text, map_batches, slices

TOKENIZER_FILE = "/opt/tokenizers/word_bpe_49k.json"

# The kinds of text handling of a file that are understood here.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# White space as Unicode has it, as ranges.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Ids a worker remembers at most before it starts anew.
REMEMBERED = 4_000_000
_NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file says; a few megabytes, whatever the table."""

    tokens: list[str]  # by id
    merges: list[tuple[int, int, int]]  # left, right and merged id, in order of rank
    inner: list[int]  # id of each byte within a word
    last: list[int]  # id of each byte at the end of a word
    added: dict[str, int]  # tokens cut out of the text as they stand


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def read_vocabulary(tokenizer_file: str = TOKENIZER_FILE) -> Vocabulary:
    """The vocabulary of a file of lower-case byte-level pairs with word ends; other kinds are an error."""
    with open(tokenizer_file, encoding="utf-8") as file:
        said = json.load(file)
    model, splits = said["model"], said["pre_tokenizer"]["pretokenizers"]
    understood = (
        model["type"] == "BPE"
        and [n["type"] for n in said["normalizer"]["normalizers"]] == NORMALIZERS
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": WORDS}
        and not splits[1]["add_prefix_space"]
        and said["decoder"] is None
        and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
        and not any(a[k] for a in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not understood:
        raise ValueError(f"{tokenizer_file} handles text in another way")
    ids, end = model["vocab"], model["end_of_word_suffix"] or ""
    added = {a["content"]: a["id"] for a in said["added_tokens"]}
    tokens = [""] * (1 + max([*ids.values(), *added.values()]))
    for token, i in [*ids.items(), *added.items()]:
        tokens[i] = token
    letters = byte_letters()
    return Vocabulary(
        tokens,
        [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]],
        [ids[x] for x in letters],
        [ids[x + end] for x in letters],
        added,
    )


def _classes() -> tuple[str, str]:
    """Letters and digits of all scripts, each as the inside of a character set."""
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    for code in range(sys.maxunicode + 1):
        ranges = found.get(unicodedata.category(chr(code))[0])
        if ranges is not None:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    letters, digits = ("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in found[k]) for k in "LN")
    return letters, digits


def taken(starts: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of all elements of the lists ``which``, one after the other."""
    sizes = counts[which]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts[which] - (ends - sizes), sizes)


class Rounds:
    """The merges of a vocabulary, applied to many words at once."""

    def __init__(self, merges: list[tuple[int, int, int]], n_tokens: int) -> None:
        table = np.array(merges, np.int64).reshape(-1, 3)
        self.n_tokens = n_tokens
        keys = table[:, 0] * n_tokens + table[:, 1]
        order = np.lexsort((-np.arange(len(keys)), keys))  # of the same pair the last counts
        order = order[np.unique(keys[order], return_index=True)[1]]
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int32), table[order, 2].astype(np.int32)
        # Where every part of a merge is made by earlier ones only, a merge gives no
        # pair of a lower rank, so all places of a pair can be merged at once.
        made = np.full(n_tokens, -1)
        made[table[:, 2]] = np.arange(len(table))
        self.at_once = bool((np.maximum(made[table[:, 0]], made[table[:, 1]]) < np.arange(len(table))).all())

    def _look_up(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each symbol's pair with the next one, and the place of its key."""
        keys = symbols[:-1].astype(np.int64) * self.n_tokens + symbols[1:]
        places = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        ranks = np.full(len(symbols), _NONE, np.int32)
        if len(self.keys):
            hit = self.keys[places] == keys
            ranks[:-1][hit] = self.ranks[places[hit]]
        return ranks, places

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their number per word after all merges; ``counts`` says how many each word has now."""
        words = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            sizes = np.diff(np.append(first, len(words)))
            ranks, places = self._look_up(symbols)
            ranks[first[1:] - 1] = _NONE  # not across words
            lowest = np.minimum.reduceat(ranks, first)
            spread = np.repeat(lowest, sizes)
            at = np.flatnonzero((ranks == spread) & (ranks != _NONE))
            if self.at_once:
                # of a run of the same symbol every other pair, from the left
                new_run = np.concatenate([[True], at[1:] != at[:-1] + 1])[: len(at)]
                starts = at[new_run][np.cumsum(new_run) - 1]
                at = at[(at - starts) % 2 == 0]
            else:
                at = at[np.concatenate([[True], words[at][1:] != words[at][:-1]])[: len(at)]]
            symbols[at] = self.merged[places[at]]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            ended = spread == _NONE
            if ended.any():
                done.append((words[ended], symbols[ended]))
                kept &= ~ended
            words, symbols = words[kept], symbols[kept]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(counts), np.int64)
        words, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words, kind="stable")
        return symbols[order], np.bincount(words, minlength=len(counts))


class Encoder:
    """Texts to ids, with the stretches between white space remembered up to ``REMEMBERED`` ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.rounds = Rounds(vocabulary.merges, len(vocabulary.tokens))
        self.inner, self.last = (np.array(x, np.int32) for x in (vocabulary.inner, vocabulary.last))
        letters, digits = _classes()
        self.words = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{SPACES}{letters}{digits}]+"
        )
        longest_first = sorted(vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.tokens = pa.array(vocabulary.tokens, pa.large_string())
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = self.counts = np.zeros(0, np.int64)

    def pieces_of(self, stretch: str) -> list[str | int]:
        """Words of a stretch in order; an added token as its id."""
        parts = self.added.split(stretch) if self.added else [stretch]
        found: list[str | int] = []
        for i, part in enumerate(parts):
            if i % 2:
                found.append(self.vocabulary.added[part])
            elif part:
                # a capital sigma is lower-cased the same at the end of a word
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += self.words.findall(plain)
        return found

    def _encode_new(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches, one after the other, and how many each has."""
        numbers: dict[str | int, int] = {}
        order, n_words = [], []
        for stretch in stretches:
            pieces = self.pieces_of(stretch)
            order += [numbers.setdefault(p, len(numbers)) for p in pieces]
            n_words.append(len(pieces))
        spelled = [w.encode() if isinstance(w, str) else b"" for w in numbers]
        sizes = np.array([len(s) for s in spelled], np.int64)
        codes = np.frombuffer(b"".join(spelled), np.uint8)
        symbols = self.inner[codes]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.last[codes[ends]]
        ids, counts = self.rounds.merge(symbols, sizes)
        added = [(n, w) for w, n in numbers.items() if isinstance(w, int)]
        if added:  # they have no symbols; put each id at its word's place
            places = np.cumsum(counts)[[n for n, _ in added]]
            ids = np.insert(ids, places, [w for _, w in added])
            counts[[n for n, _ in added]] = 1
        which = np.array(order, np.int64)
        flat = ids[taken(np.cumsum(counts) - counts, counts, which)]
        owner = np.repeat(np.arange(len(stretches)), n_words)
        totals = np.bincount(owner, counts[which], len(stretches)).astype(np.int64)
        return flat, totals

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.ids) > REMEMBERED:
            self.forget()
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(cut).dictionary_encode()
        stretches = coded.dictionary.to_pylist()
        new = [s for s in stretches if s not in self.slots]
        if new:
            ids, counts = self._encode_new(new)
            self.slots.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
        slot = np.array([self.slots[s] for s in stretches], np.int64)
        which = slot[coded.indices.to_numpy(zero_copy_only=False)]
        flat = self.ids[taken(self.starts, self.counts, which)]
        owner = np.repeat(np.arange(len(texts)), sizes)
        totals = np.bincount(owner, self.counts[which], len(texts)).astype(np.int64)
        return flat, totals

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The tokens of each list of ids joined by a blank; ids without a token are left out."""
        known = (ids >= 0) & (ids < len(self.tokens))
        if not known.all():
            owner = np.repeat(np.arange(len(counts)), counts)
            counts, ids = np.bincount(owner[known], minlength=len(counts)), ids[known]
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(ends), self.tokens.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, shared: Broadcast) -> Encoder:
    """One per worker process and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def _shared(docs: DataFrame, vocabulary: Vocabulary) -> tuple[str, Broadcast]:
    key = hashlib.md5(repr(vocabulary).encode()).hexdigest()
    return key, docs.sparkSession.sparkContext.broadcast(vocabulary)


def encode_column(docs: DataFrame, key: str, text: Column, vocabulary: Vocabulary) -> DataFrame:
    """(key, ids) of every row; a null text has no ids."""
    name, shared = _shared(docs, vocabulary)
    kind = docs.schema[key].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared)
        for batch in slices(batches):
            ids, counts = encoder.encode(batch.column(1))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    rows = docs.select(docs[key].alias("key"), full_text(text).alias("text"))
    return map_batches(rows, encoded, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_column(encoded: DataFrame, key: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, decoded) of (key, ids) rows; null ids count as none and give an empty text."""
    name, shared = _shared(encoded, vocabulary)
    kind = encoded.schema[key].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared)
        for batch in slices(batches):
            lists = batch.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(pc.list_flatten(lists), -1).to_numpy(zero_copy_only=False)
            texts = encoder.decode(ids, counts).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["key", "decoded"])

    rows = encoded.select(encoded[key].alias("key"), encoded["ids"].alias("ids"))
    return map_batches(rows, decoded, f"key {kind}, decoded string").withColumnRenamed("key", key)


def token_digests(docs: DataFrame, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of ``docs``.

    Encoding, decoding of those ids and both digests are one pass, so that no ids
    travel between Spark and its Python workers.
    """
    name, shared = _shared(docs, read_vocabulary(tokenizer_file))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared)
        for batch in slices(batches):
            ids, counts = encoder.encode(batch.column(1))
            ends = np.cumsum(counts)
            plain = ids.astype("<u4")
            ids_sha = [hashlib.sha256(plain[e - n : e]).hexdigest() for e, n in zip(ends, counts, strict=True)]
            texts = encoder.decode(ids, counts)
            sha = [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(ids_sha, pa.string()), pa.array(sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(docs["doc_id"].alias("doc_id"), full_text(docs["text"]).alias("text"))
    return map_batches(
        rows, digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
