"""Arrow batches of many bytes reach Spark in pieces, and are staged in bounded ones."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tablewright.demo.staging import stage_arrow_files
from tablewright.functions import batches
from tablewright.sources.arrow_files import ArrowFiles


@pytest.mark.parametrize("options", [{}, {"damaged": "report"}])
def test_a_large_batch_is_read_in_pieces(tmp_path, options):
    texts = [f"{i} " + "x" * 40_000 for i in range(1000)]
    with pa.ipc.new_stream(str(tmp_path / "a.arrow"), pa.schema([("t", pa.string())])) as writer:
        for _ in range(2):
            writer.write_batch(pa.record_batch({"t": texts}))
        writer.write_batch(pa.record_batch({"t": pa.array([], pa.string())}))
    source = ArrowFiles({"path": str(tmp_path), "position": "true", **options})
    reader = source.reader(source.schema())
    read = [b for part in reader.partitions() for b in reader.read(part)]
    assert max(b.column(0).nbytes for b in read) <= batches.BYTES + 8 * batches.ROWS
    rows = [r for b in read for r in b.to_pylist()]
    assert [(r["_batch"], r["_row"], r["t"]) for r in rows] == [(n, i, t) for n in range(2) for i, t in enumerate(texts)]


def test_texts_within_structs_count():
    choices = pa.array([{"text": ["a" * 30, "b" * 10], "label": ["A", "B"]}, None, {"text": None, "label": []}])
    batch = pa.record_batch({"choices": choices, "n": [1, 2, 3]})
    assert batches.row_bytes(batch).tolist() == [50, 8, 8]


def test_staged_batches_have_bounded_bytes(spark, tmp_path):
    rows = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("y"), 10_000).alias("t"))
    stage_arrow_files(rows, str(tmp_path / "s"))
    (file,) = (tmp_path / "s").glob("*.arrow")
    with pa.ipc.open_stream(str(file)) as stream:
        sizes = [(b.num_rows, b.nbytes) for b in stream]
    assert sum(n for n, _ in sizes) == 3000 and max(size for _, size in sizes) <= batches.BYTES + 8 * batches.ROWS
