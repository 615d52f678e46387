"""Arrow files to read, made from a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tablewright.functions.batches import pieces
from tablewright.sources.arrow_files import locate


def stage_arrow_files(
    df: DataFrame, folder: str, name: str = "part", indexed: bool = False, batch_rows: int | None = None, by: str | None = None
) -> None:
    """One Arrow file per partition, named as a shard of ``name``: a stream, or the framing with an index of batches.

    A file's batches have ``batch_rows`` rows, else bounded rows and bytes, so that a reader holds little at a time.
    With ``by`` every value of that column has a folder of its own, without the column.
    A task writes under a name of its own and renames the file when it is
    complete, so a repeated task leaves one whole file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = locate(folder)
        new = pa.ipc.new_file if indexed else pa.ipc.new_stream
        opened: dict[str, tuple] = {}
        for batch in batches if batch_rows else pieces(batches):
            table = pa.Table.from_batches([batch])
            for value in pc.unique(table.column(by)).to_pylist() if by else [""]:
                rows = table.filter(pc.equal(table.column(by), value)).drop_columns([by]) if by else table
                if value not in opened:
                    place = f"{root}/{value}".rstrip("/")
                    system.create_dir(place, recursive=True)
                    final = f"{place}/{name}-{task.partitionId():05d}-of-00000.arrow"
                    sink = system.open_output_stream(f"{final}.{task.taskAttemptId()}")
                    opened[value] = (final, sink, new(sink, rows.schema))
                opened[value][2].write_table(rows, max_chunksize=batch_rows)
        for final, sink, writer in opened.values():
            writer.close()
            sink.close()
            system.move(f"{final}.{task.taskAttemptId()}", final)
            yield pa.RecordBatch.from_pydict({"path": [final]})

    df.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def damage_first_file(folder: str, kept: float = 0.6) -> None:
    """Cut the first file of a staged folder short, as a broken copy would be."""
    system, root = locate(folder)
    first = min(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.path.endswith(".arrow"))
    with system.open_input_file(first) as source:
        held = source.read(int(source.size() * kept))
    with system.open_output_stream(first) as sink:
        sink.write(held)
