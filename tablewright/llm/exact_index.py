"""Exact de-duplication with an extendible-hash index on shared files.

Every scan task collapses the equal texts it sees to one entry (hash, text, rows,
best row) and the entries are written to the shared folder. A directory is
grown over them: it starts with one bucket, an overfull bucket is split by its
next hash bit, and the directory doubles where a bucket is already as deep as
the directory. Each bucket, a range of hash values, has one owner task. It reads
its entries in hash order, chains the entries of equal hashes and compares their
bytes, so equality never rests on a hash.

Only entries whose hash occurs more than once travel to an owner. They are
recognised with a bit map of fixed size; a false positive costs a trip and
decides nothing. A text that fills a third of a table has one entry per scan
task, so no task gathers its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import BLANK, arrow_schema, full_text, id_key, map_batches, rows_named_by, slices, stored

ENTRY = (
    "row long, doc_id long, hash long, digest binary, entry long, "
    "n_rows long, best_chars long, best_id long, best_row long, bytes binary"
)
OWNED = "entry long, keep_row long, keep_id long, group_size long"

DIRECTORY_BITS = 16
BUCKET_CAPACITY = 4096
FILTER_BITS = 26
HELD_BYTES = 32 << 20
HIGHEST = 2**63 - 1


@dataclass
class Directory:
    """Slots by hash prefix, each naming a bucket; ``buckets`` are (prefix, local depth)."""

    depth: int
    slots: np.ndarray
    buckets: list[tuple[int, int]]

    @classmethod
    def grown(
        cls, cells: np.ndarray, capacity: int = BUCKET_CAPACITY, bits: int = DIRECTORY_BITS
    ) -> Directory:
        """Split from one bucket until none holds more than ``capacity`` entries.

        ``cells`` counts the entries by their first ``bits`` hash bits. A bucket
        as deep as that is not split any more; it overflows.
        """
        total = np.concatenate([[0], np.cumsum(cells)])
        made = cls(0, np.zeros(1, np.int32), [(0, 0)])
        todo = [0]
        while todo:
            bucket = todo.pop()
            prefix, local = made.buckets[bucket]
            low, high = prefix << (bits - local), (prefix + 1) << (bits - local)
            if total[high] - total[low] <= capacity or local == bits:
                continue
            if local == made.depth:
                made.depth += 1
                made.slots = np.repeat(made.slots, 2)
            new = len(made.buckets)
            made.buckets[bucket] = (2 * prefix, local + 1)
            made.buckets.append((2 * prefix + 1, local + 1))
            width = 1 << (made.depth - local - 1)
            made.slots[(2 * prefix + 1) * width : (2 * prefix + 2) * width] = new
            todo += [bucket, new]
        return made

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        if self.depth == 0:
            return np.zeros(len(hashes), np.int32)
        return self.slots[(hashes.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def without_blanks(text: str | Column = "text") -> Column:
    """The text after deleting blanks; null counts as empty."""
    return F.regexp_replace(full_text(text), f"{BLANK}+", "")


def _collapse(held_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = arrow_schema(ENTRY)

    def entries(held: dict) -> pa.RecordBatch:
        rows = [(h, *e) for (h, _), e in held.items()]
        texts = [text for _, text in held]
        columns = {
            "row": [None] * len(rows),
            "doc_id": [None] * len(rows),
            "hash": [r[0] for r in rows],
            "digest": [None] * len(rows),
            "entry": [r[1] for r in rows],
            "n_rows": [r[2] for r in rows],
            "best_chars": [r[3][0] for r in rows],
            "best_id": [None if r[3][1] == -HIGHEST else -r[3][1] for r in rows],
            "best_row": [-r[3][2] for r in rows],
            "bytes": texts,
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        size = 0
        for batch in slices(batches):
            row, ids, hashes, chars, text = (
                batch.column(c).to_pylist() for c in ("row", "doc_id", "hash", "chars", "bytes")
            )
            entry = []
            for i, key in enumerate(zip(hashes, text, strict=True)):
                rank = (chars[i], -HIGHEST if ids[i] is None else -ids[i], -row[i])
                found = held.get(key)
                if found is None:
                    held[key] = found = [row[i], 0, rank]
                    size += len(key[1]) + 200
                found[1] += 1
                found[2] = max(found[2], rank)
                entry.append(found[0])
            empty = pa.nulls(len(row))
            filled = {
                "row": batch.column("row"),
                "doc_id": batch.column("doc_id"),
                "hash": batch.column("hash"),
                "digest": batch.column("digest"),
                "entry": pa.array(entry, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(
                [filled.get(f.name, empty).cast(f.type) for f in schema], schema=schema
            )
            if size > held_bytes:
                yield entries(held)
                held, size = {}, 0
        if held:
            yield entries(held)

    return collapse


def _route(directory: Directory, repeated, bits: int):
    """Entries that may have a partner, with the bucket that owns them."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = repeated.value
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False)
            place = hashes & ((1 << bits) - 1)
            hit = (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            some = batch.filter(pa.array(hit.astype(bool)))
            bucket = directory.bucket(some.column("hash").to_numpy(zero_copy_only=False))
            yield some.append_column("bucket", pa.array(bucket, pa.int32()))

    return route


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the entries of equal hashes, in hash order, and settle every chain."""
    schema = arrow_schema(OWNED)

    def settled(chain: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        for members, n_rows, best in chain.values():
            keep_id = None if best[1] == -HIGHEST else -best[1]
            n = len(members)
            columns = [members, [-best[2]] * n, [keep_id] * n, [n_rows] * n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts, schema).combine_chunks().to_batches()[0]

    chain: dict[bytes, list] = {}
    current, waiting = None, []
    for batch in slices(batches):
        for hash_, entry, n_rows, chars, id_, row, text in zip(
            *(
                batch.column(c).to_pylist()
                for c in ("hash", "entry", "n_rows", "best_chars", "best_id", "best_row", "bytes")
            ),
            strict=True,
        ):
            if hash_ != current:
                waiting += settled(chain)
                chain, current = {}, hash_
            rank = (chars, -HIGHEST if id_ is None else -id_, -row)
            link = chain.setdefault(text, [[], 0, rank])
            link[0].append(entry)
            link[1] += n_rows
            link[2] = max(link[2], rank)
        if waiting:
            yield joined(waiting)
            waiting = []
    if last := list(settled(chain)):
        yield joined(last)


def exact_groups(
    docs: DataFrame,
    hash_of: Callable[[Column], Column] = F.xxhash64,
    capacity: int = BUCKET_CAPACITY,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when they are identical without blanks; a null text is empty.
    Of equal texts the row with the most characters stays, then the smallest
    doc_id; a null doc_id comes last, and of repeated rows exactly one stays. An
    empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    text = without_blanks(docs["text"])
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        text.alias("plain"),
        F.char_length(full_text(docs["text"])).cast("long").alias("chars"),
    ).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        hash_of(F.col("plain")).alias("hash"),
        "chars",
        F.unhex(F.sha2("plain", 256)).alias("digest"),
        F.col("plain").cast("binary").alias("bytes"),
    )
    index = stored(map_batches(rows, _collapse(held_bytes), ENTRY), "exact-index")
    members = index.where("row is not null").select("row", "doc_id", "digest", "entry")
    entries = index.where("row is null").drop("row", "doc_id", "digest")

    cell = F.shiftrightunsigned("hash", 64 - DIRECTORY_BITS).cast("int")
    counted = entries.groupBy(cell.alias("cell")).count().toArrow()  # at most 2**DIRECTORY_BITS rows
    cells = np.zeros(1 << DIRECTORY_BITS, np.int64)
    cells[counted.column("cell").to_numpy()] = counted.column("count").to_numpy()
    directory = Directory.grown(cells, capacity)

    place = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    several = entries.groupBy("hash").count().where("count > 1")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    marks = several.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    marked = marks.toArrow()  # at most 2**(FILTER_BITS - 6) rows
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    words[marked.column("word").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
    repeated = spark.sparkContext.broadcast(words)

    columns = "hash long, entry long, n_rows long, best_chars long, best_id long, best_row long, bytes binary"
    travelling = map_batches(
        entries.select(*[c.split()[0] for c in columns.split(", ")]),
        _route(directory, repeated, FILTER_BITS),
        f"{columns}, bucket int"
    )
    owned = map_batches(travelling.repartition("bucket").sortWithinPartitions("hash"), _own, OWNED)
    alone = entries.select(
        "entry", F.col("best_row").alias("own_row"), F.col("best_id").alias("own_id"), "n_rows"
    )
    settled = alone.join(owned, "entry", "left").select(
        "entry",
        F.coalesce("keep_row", "own_row").alias("keep_row"),
        F.when(F.col("keep_row").isNull(), F.col("own_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "n_rows").alias("group_size"),
    )
    return members.join(settled, "entry").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text an earlier choice already keeps; columns unchanged.

    Rows are found again by doc_id and digest; of repeated rows one stays.
    """
    kept = exact_groups(docs, **options).where("kept").select(id_key(F.col("doc_id")), "text_sha256")
    return rows_named_by(docs, kept, id_key(docs["doc_id"]), F.sha2(without_blanks(docs["text"]), 256))
