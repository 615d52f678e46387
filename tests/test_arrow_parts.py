"""Into how many parts Arrow files are cut."""

import pyarrow as pa
from tablewright.sources import arrow_files
from tablewright.sources.arrow_files import ArrowFiles


def test_parts_do_not_grow_with_the_files(tmp_path):
    table = pa.table({"n": list(range(4000))})
    for name in ("a", "b"):
        with pa.ipc.new_stream(str(tmp_path / f"{name}.arrow"), table.schema) as writer:
            writer.write_table(table, max_chunksize=100)
    source = ArrowFiles({"path": str(tmp_path), "split_bytes": "8"})
    reader = source.reader(source.schema())
    parts = reader.partitions()
    assert len(parts) <= arrow_files.MOST_PARTS + 2
    got = sorted(n for part in parts for batch in reader.read(part) for n in batch.column(0).to_pylist())
    assert got == sorted(list(range(4000)) * 2)
