"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

The automaton holds all pieces of a model file. It runs over the text once; at
every position it follows the output links to all pieces that end there, and each
relaxes the best score of the position. The segmentation with the highest sum of
the file's scores wins, and of equal sums the one with the longer last piece.
Characters without a piece become the byte pieces of their UTF-8 form.

A text is worked on in segments that no piece can cross: before a run of blanks,
and around line feeds where no piece has one. The different new segments of a batch take
their steps through the automaton together, one character at a time, in flat arrays;
a long one takes them alone. Segmentations are remembered in a table of bounded size per worker,
and texts take their ids from it by index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import full_text, map_batches, slices

# The mark for a blank, the penalty of an unknown character, the public model file.
BLANK_MARK = "▁"
UNKNOWN_PENALTY = 10.0
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"

# Ids a worker remembers at most before it starts anew, and segments that are stepped alone.
REMEMBERED = 4_000_000
ALONE_LENGTH = 256


@dataclass(frozen=True)
class Vocabulary:
    """What the model file says; a few megabytes at most, whatever the table."""

    pieces: list[str]
    scores: list[float]
    bytes_from: dict[int, int]  # byte value to id
    unknown: int
    skipped: frozenset[int]  # control pieces and unused ones


def read_vocabulary(model_file: str = MODEL_FILE) -> Vocabulary:
    """The vocabulary of a model file without normalisation rules, with a leading blank added to texts."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids]
    return Vocabulary(
        pieces,
        [model.get_score(i) for i in ids],
        {int(pieces[i][3:5], 16): i for i in ids if model.is_byte(i)},
        model.unk_id(),
        frozenset(i for i in ids if model.is_control(i) or model.is_unused(i) or model.is_unknown(i)),
    )


class Automaton:
    """The pieces' automaton as arrays, for many segments at once.

    States are numbered from the root on in order of depth. ``output`` is the first state on the way along the
    failure links, the state itself included, at which a piece ends; ``link`` is the next one after it. 0 is none.
    """

    _ASCII = 128

    def __init__(self, pieces: dict[str, int], unknown_score: float, scores: list[float]) -> None:
        children: list[dict[str, int]] = [{}]
        ends = [-1]
        depth = [0]
        for piece, number in pieces.items():
            at = 0
            for letter in piece:
                following = children[at].get(letter)
                if following is None:
                    following = children[at][letter] = len(children)
                    children.append({})
                    ends.append(-1)
                    depth.append(depth[at] + 1)
                at = following
            ends[at] = number
        n = len(children)
        fail, output, link = [0] * n, [0] * n, [0] * n
        queue = list(children[0].values())
        for at in queue:  # grows while it is walked
            below = fail[at]
            link[at] = output[below]
            output[at] = at if ends[at] >= 0 else output[below]
            for letter, following in children[at].items():
                back = below
                while back and letter not in children[back]:
                    back = fail[back]
                fail[following] = children[back].get(letter, 0)
                queue.append(following)
        self.fail, self.output, self.link, self.ends, self.depth = (
            np.array(x, np.int32) for x in (fail, output, link, ends, depth)
        )
        # Whole transitions for the first characters, in order of depth so that failures are known; the rest by search.
        self.ascii = np.zeros((n, self._ASCII), np.int32)
        keys = []
        for at in [0, *queue]:
            if at:
                self.ascii[at] = self.ascii[fail[at]]
            for letter, following in children[at].items():
                if ord(letter) < self._ASCII:
                    self.ascii[at, ord(letter)] = following
                else:
                    keys.append((at << 21 | ord(letter), following))
        keys.sort()
        self.keys, self.targets = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
        self.single = np.array(sorted(ord(p) for p in pieces if len(p) == 1), np.int64)
        self.scores, self.unknown_score = np.array(scores, np.float64), unknown_score

    def _next(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        following = np.zeros(len(state), np.int32)
        plain = letter < self._ASCII
        following[plain] = self.ascii[state[plain], letter[plain]]
        left = np.flatnonzero(~plain)
        at = state[left].astype(np.int64)
        while len(left) and len(self.keys):
            asked = at << 21 | letter[left]
            place = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            found = self.keys[place] == asked
            following[left[found]] = self.targets[place[found]]
            more = ~found & (at > 0)
            left, at = left[more], self.fail[at[more]].astype(np.int64)
        return following

    def best(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of the best segmentations, one after the other, and how many each segment has.

        Where a character has no piece, the number is that of the character, less one, below zero.
        """
        sizes = np.array([len(s) for s in segments], np.int64)
        order = np.argsort(-sizes, kind="stable")
        letters = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first = (np.cumsum(sizes) - sizes)[order]
        node = first + order  # every segment has a node more than characters
        sizes = sizes[order]
        score = np.full(len(letters) + len(segments), -np.inf)
        start = np.zeros(len(score), np.int64)
        piece = np.zeros(len(score), np.int64)
        score[node] = 0.0
        state = np.zeros(len(order), np.int32)
        known = np.isin(letters, self.single)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -step, "left"))  # segments longer than the steps so far
            letter = letters[first[:n] + step]
            state = self._next(state[:n], letter)
            here = node[:n] + step + 1
            # follow the output links, longest piece first; of equal sums the first stays
            who, at = np.arange(n), self.output[state]
            while True:
                open_ = at > 0
                if not open_.any():
                    break
                who, at = who[open_], at[open_]
                begin = here[who] - self.depth[at]
                reached = score[begin] + self.scores[self.ends[at]]
                better = reached > score[here[who]]
                to = here[who[better]]
                score[to], start[to], piece[to] = reached[better], begin[better], self.ends[at[better]]
                at = self.link[at]
            lone = np.flatnonzero(~known[first[:n] + step])
            reached = score[here[lone] - 1] + self.unknown_score
            better = reached > score[here[lone]]
            to = here[lone[better]]
            score[to], start[to], piece[to] = reached[better], to - 1, -1 - letter[lone[better]]
        taken, owners = [], []
        who, at = np.arange(len(order)), node + sizes
        while True:
            left = at > node[who]
            if not left.any():
                break
            who, at = who[left], at[left]
            taken.append(piece[at])
            owners.append(who)
            at = start[at]
        if not taken:
            return np.zeros(0, np.int64), np.zeros(len(segments), np.int64)
        found, who = np.concatenate(taken[::-1]), order[np.concatenate(owners[::-1])]
        return found[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(segments))


class Segmenter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        bytes_ = set(vocabulary.bytes_from.values())
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        usable = [i for i in range(len(vocabulary.pieces)) if i not in vocabulary.skipped and i not in bytes_]
        for i in usable:
            piece = vocabulary.pieces[i]
            self.automaton.add_word(piece, (len(piece), vocabulary.scores[i], i))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown_score = min((vocabulary.scores[i] for i in usable), default=0.0) - UNKNOWN_PENALTY
        by_text = {vocabulary.pieces[i]: i for i in usable}
        self.steps = Automaton(by_text, self.unknown_score, vocabulary.scores)
        self.forget()
        letters = set("".join(vocabulary.pieces[i] for i in usable))
        crossing = any(BLANK_MARK in vocabulary.pieces[i].lstrip(BLANK_MARK) for i in usable)
        cut = "" if "\n" in letters else r"\n"
        if crossing:
            self.segments = re.compile(r"[^\n]+|\n" if cut else r"[\s\S]+")
        else:
            self.segments = re.compile(f"{BLANK_MARK}*[^{BLANK_MARK}{cut}]+|{BLANK_MARK}+|\n")
        surface = [p.replace(BLANK_MARK, " ") for p in vocabulary.pieces]
        self.surface = ["" if i in vocabulary.skipped else s for i, s in enumerate(surface)]
        self.byte_of = {i: b for b, i in vocabulary.bytes_from.items()}
        self.surfaces = pa.array(self.surface, pa.large_string())

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = self.counts = np.zeros(0, np.int64)

    def viterbi(self, segment: str) -> list[int]:
        """Piece ids of the best segmentation."""
        n = len(segment)
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        single, unknown = self.single, self.unknown_score
        done = 0

        def pass_unknown(to: int, done: int) -> int:
            while done < to:
                if segment[done] not in single and best[done] + unknown > best[done + 1]:
                    best[done + 1] = best[done] + unknown
                    back[done + 1] = (done, -1)
                done += 1
            return done

        for end, (length, score, piece) in self.automaton.iter(segment):
            if done < end:
                done = pass_unknown(end, done)
            start = end + 1 - length
            reached = best[start] + score
            if reached > best[end + 1]:
                best[end + 1] = reached
                back[end + 1] = (start, piece)
        pass_unknown(n, done)
        ids: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += self.fallback(segment[start:at])
            at = start
        return ids[::-1]

    def fallback(self, character: str) -> list[int]:
        """Byte pieces of a character, last byte first; the unknown piece where the file has none."""
        codes = character.encode("utf-8", "surrogatepass")[::-1]
        table = self.vocabulary.bytes_from
        return [table[b] for b in codes] if table else [self.vocabulary.unknown]

    def _encode_new(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, one after the other, and how many each has."""
        short = [i for i, s in enumerate(segments) if len(s) <= ALONE_LENGTH]
        found, counts = self.steps.best([segments[i] for i in short])
        lone = np.flatnonzero(found < 0)
        if len(lone):  # characters without a piece, in their bytes
            spelled = [self.fallback(chr(-1 - c))[::-1] for c in found[lone].tolist()]
            sizes = np.ones(len(found), np.int64)
            sizes[lone] = [len(x) for x in spelled]
            owner = np.repeat(np.arange(len(short)), counts)
            counts = np.bincount(owner, sizes, len(short)).astype(np.int64)
            bytes_ = np.concatenate(spelled)
            found = np.repeat(found, sizes)
            found[found < 0] = bytes_
        if len(short) == len(segments):
            return found.astype(np.int32), counts
        ends = np.cumsum(counts)
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(segments)
        for k, i in enumerate(short):
            ids[i] = found[ends[k] - counts[k] : ends[k]].astype(np.int32)
        for i, segment in enumerate(segments):
            if len(segment) > ALONE_LENGTH:
                ids[i] = np.array(self.viterbi(segment), np.int32)
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; none for an empty one."""
        if len(self.ids) > REMEMBERED:
            self.forget()
        cut = [self.segments.findall(BLANK_MARK + t.replace(" ", BLANK_MARK)) if t else [] for t in texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        coded = pa.array([s for c in cut for s in c], pa.large_string()).dictionary_encode()
        segments = coded.dictionary.to_pylist()
        new = [s for s in segments if s not in self.slots]
        if new:
            ids, counts = self._encode_new(new)
            self.slots.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
        slot = np.array([self.slots[s] for s in segments], np.int64)
        which = slot[coded.indices.to_numpy(zero_copy_only=False)]
        each = self.counts[which]
        ends = np.cumsum(each)
        places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[which] - (ends - each), each)
        owner = np.repeat(np.arange(len(texts)), sizes)
        return self.ids[places], np.bincount(owner, each, len(texts)).astype(np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; none for an empty one."""
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of lists of ids, one after the other."""
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(ends), self.surfaces.take(pa.array(ids)))
        texts = pc.binary_join(lists, pa.scalar("", pa.large_string())).to_pylist()
        texts = [t[1:] if t.startswith(" ") else t for t in texts]
        spelled = np.isin(ids, list(self.byte_of)) if self.byte_of else np.zeros(len(ids), bool)
        for i in np.unique(np.repeat(np.arange(len(counts)), counts)[spelled]).tolist():
            texts[i] = self.decode(ids[ends[i] : ends[i + 1]])
        return texts

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; byte pieces that are no UTF-8 give replacement characters."""
        parts, held = [], bytearray()
        surface, byte_of = self.surface, self.byte_of
        if byte_of:
            low, high = min(byte_of), max(byte_of)
            contiguous = high - low + 1 == len(byte_of)
            is_byte = (ids >= low) & (ids <= high) if contiguous else np.isin(ids, list(byte_of))
            edges = np.flatnonzero(np.diff(is_byte.astype(np.int8))) + 1
            runs = np.split(ids, edges)
        else:
            is_byte, runs = np.zeros(len(ids), bool), [ids]
        as_bytes = bool(is_byte[0]) if len(ids) else False
        for run in runs:
            if as_bytes:
                held = bytearray(byte_of[i] for i in run.tolist())
                parts.append(held.decode("utf-8", "replace"))
            else:
                parts.append("".join([surface[i] for i in run.tolist()]))
            as_bytes = not as_bytes
        text = "".join(parts)
        return text[1:] if text.startswith(" ") else text


_SEGMENTERS: dict[str, Segmenter] = {}


def _segmenter(key: str, shared: Broadcast) -> Segmenter:
    """One automaton per worker process and vocabulary."""
    if key not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[key] = Segmenter(shared.value)
    return _SEGMENTERS[key]


def _key(vocabulary: Vocabulary) -> str:
    return hashlib.md5(repr(vocabulary).encode()).hexdigest()


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))


def encode_column(docs: DataFrame, key: str, text: Column, vocabulary: Vocabulary) -> DataFrame:
    """(key, ids) of every row; a null text counts as empty and has no ids."""
    shared, key_ = docs.sparkSession.sparkContext.broadcast(vocabulary), _key(vocabulary)
    kind = docs.schema[key].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(key_, shared)
        for batch in slices(batches):
            lists = _lists(*segmenter.encode_all(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    rows = docs.select(docs[key].alias("key"), full_text(text).alias("text"))
    return map_batches(rows, encoded, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_column(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with its ``ids`` read back as ``decoded``; null ids give a null text."""
    shared, key_ = encoded.sparkSession.sparkContext.broadcast(vocabulary), _key(vocabulary)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(key_, shared)
        for batch in slices(batches):
            column = batch.column(batch.schema.get_field_index("ids"))
            values = column.values.to_numpy(zero_copy_only=False)
            ends = column.offsets.to_pylist()
            known = column.is_valid().to_pylist()
            texts = [
                segmenter.decode(values[a:b]) if ok else None
                for a, b, ok in zip(ends, ends[1:], known, strict=False)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_batches(encoded, decoded, f"{schema}, decoded string")


def piece_rows(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """(doc_id, ids, n_ids, decoded_sha256, round_trip), one row per row of ``docs``.

    ``round_trip`` says whether the ids decode to the text itself; a text that holds
    the blank's mark as a character does not. Null texts count as empty and have no ids.

    Encoding, decoding of those ids and the digest are one pass, so that ids travel once.
    """
    vocabulary = read_vocabulary(model_file)
    shared, key_ = docs.sparkSession.sparkContext.broadcast(vocabulary), _key(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(key_, shared)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            ids, counts = segmenter.encode_all(texts)
            decoded = segmenter.decode_all(ids, counts)
            sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]
            same = [a == b for a, b in zip(texts, decoded, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(ids, counts), pa.array(counts), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_ids", "decoded_sha256", "round_trip"],
            )

    given = docs.select(docs["doc_id"].alias("doc_id"), full_text(docs["text"]).alias("text"))
    return map_batches(
        given, rows, f"doc_id {kind}, ids array<int>, n_ids long, decoded_sha256 string, round_trip boolean"
    )
