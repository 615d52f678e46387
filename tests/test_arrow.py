"""Arrow files of both framings: messages, splits, the index, filters and damage."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tablewright.sources import arrow_files, cache, readers
from tablewright.sources.arrow_messages import BATCH, DICTIONARY, DamagedFile, batches_of, messages

FRAMINGS = [pa.ipc.new_stream, pa.ipc.new_file]


def some_table(n, seed=0):
    draw = random.Random(seed)
    return pa.table(
        {
            "id": pa.array(range(n), pa.int64()),
            "name": pa.array([None if i % 7 == 0 else f"n{draw.randrange(1000):03d}" for i in range(n)]),
            "texts": pa.array([["x" * draw.randrange(9)] * (i % 3) for i in range(n)]),
        }
    )


def put(path, table, new=pa.ipc.new_stream, rows=10, **options):
    path.parent.mkdir(parents=True, exist_ok=True)
    with new(str(path), table.schema, **options) as writer:
        writer.write_table(table, max_chunksize=rows)
    return path


def walked(path):
    with pa.OSFile(str(path)) as source:
        return list(messages(source))


@pytest.mark.parametrize("new", FRAMINGS)
@pytest.mark.parametrize("options", [{}, {"compression": "zstd"}, {"use_legacy_format": True}])
def test_messages_are_found_without_their_bodies(tmp_path, new, options):
    table = some_table(95)
    path = put(tmp_path / "x.arrow", table, new, options=pa.ipc.IpcWriteOptions(**options))
    found = walked(path)
    batches = [m for m in found if m.kind == BATCH]
    assert [m.rows for m in batches] == [10] * 9 + [5]
    with pa.OSFile(str(path)) as source:
        for k in (0, 4, 9):  # each on its own
            m = batches[k]
            (only,) = batches_of(source, [found[0][1:3]], m.offset, m.offset + m.size)
            assert only.to_pydict() == table.slice(10 * k, 10).to_pydict()


def test_bodies_are_not_read(tmp_path):
    path = put(tmp_path / "x.arrow", pa.table({"x": ["y" * 100_000] * 50}), rows=1)

    class Counted:
        def __init__(self, source):
            self.source, self.read_bytes = source, 0

        def seek(self, at):
            self.source.seek(at)

        def size(self):
            return self.source.size()

        def read(self, n):
            self.read_bytes += n
            return self.source.read(n)

    with pa.OSFile(str(path)) as source:
        counted = Counted(source)
        assert sum(m.kind == BATCH for m in messages(counted)) == 50
    assert counted.read_bytes < 50_000 < path.stat().st_size


@pytest.mark.parametrize("new", FRAMINGS)
def test_files_cut_short_anywhere(tmp_path, new):
    path = put(tmp_path / "x.arrow", some_table(40), new)
    whole = path.read_bytes()
    n = len(walked(path))
    for size in [*range(0, len(whole), 997), len(whole) - 1]:
        path.write_bytes(whole[:size])
        try:
            assert len(walked(path)) <= n
        except DamagedFile:
            pass


def read(spark, path, **options):
    return readers.read_columnar(spark, str(path), format="arrow_files", **options)


@pytest.mark.parametrize("new", FRAMINGS)
@pytest.mark.parametrize("indexed", [False, True])
def test_every_split_size_gives_all_rows(spark, tmp_path, new, indexed):
    table = some_table(230)
    put(tmp_path / "d/a.arrow", table.slice(0, 200), new)
    put(tmp_path / "d/deep/b.arrow", table.slice(200), new)
    put(tmp_path / "d/empty.arrow", table.slice(0, 0), new)
    index = str(tmp_path / "index")
    if indexed:
        arrow_files.index_arrow_files(spark, str(tmp_path / "d"), index)
    for size in (900, 1 << 20):
        df = read(spark, tmp_path / "d", split_bytes=str(size), index=index if indexed else None, position=True)
        rows = df.collect()
        assert sorted(r.id for r in rows) == list(range(230))
        assert {(r.id, r.name, tuple(r.texts)) for r in rows} == {(i, n, tuple(t)) for i, n, t in zip(*(c.to_pylist() for c in table.columns))}
        assert all(r._batch * 10 + r._row == r.id % 200 for r in rows)
    assert read(spark, tmp_path / "d", split_bytes="900", index=index if indexed else None).rdd.getNumPartitions() > 5


def test_dictionaries_reach_every_split(spark, tmp_path):
    words = [f"w{i % 5}" for i in range(60)]
    plain = pa.table({"id": range(60), "w": words})
    coded = pa.table({"id": plain["id"], "w": plain["w"].dictionary_encode()})
    batches = [b for k in range(6) for b in pa.table({"id": plain["id"][k * 10 : k * 10 + 10], "w": pa.chunked_array([pa.array(words[k * 10 : k * 10 + 10] + [f"new{k}"]).dictionary_encode()[:10]])}).to_batches()]
    put(tmp_path / "one/a.arrow", coded)
    with pa.ipc.new_stream(str((tmp_path / "one") / "b.arrow"), coded.schema) as writer:  # a dictionary of its own per batch
        for batch in batches:
            writer.write_batch(batch)
    assert sum(m.kind == DICTIONARY for m in walked(tmp_path / "one/b.arrow")) > 1
    index = str(tmp_path / "index")
    arrow_files.index_arrow_files(spark, str(tmp_path / "one"), index, ["w"])
    for options in ({}, {"index": index}):
        rows = read(spark, tmp_path / "one", split_bytes="300", **options).collect()
        assert sorted((r.id, r.w) for r in rows) == sorted(2 * list(enumerate(words)))


def planned(spark, path, filters, **options):
    """The reader's parts after filters, without a query."""
    source = arrow_files.ArrowFiles({"path": str(path), **options})
    reader = arrow_files.FilteredArrowFilesReader(source._files, source.schema(), options)
    reader.pushFilters(filters)
    return reader.partitions()


def n_batches(parts):
    """Batches in the ranges of indexed parts."""
    total = 0
    for part in parts:
        with pa.OSFile(part.file.inner) as source:
            offsets = [m.offset for m in messages(source) if m.kind == BATCH]
        total += sum(low <= o < high for low, high, _ in part.ranges for o in offsets)
    return total


def test_filters_skip_batches(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    table = some_table(200)
    put(tmp_path / "d/a.arrow", table)
    index = str(tmp_path / "index")
    rows = arrow_files.index_arrow_files(spark, str(tmp_path / "d"), index, ["id", "name", "no such column"])
    assert rows.where(f"kind = {BATCH}").count() == 20
    count = lambda *filters: n_batches(planned(spark, tmp_path / "d", list(filters), index=index))
    assert count() == 20
    assert count(EqualTo(("id",), 57)) == 1 and count(EqualTo(("id",), 570)) == 0
    assert count(GreaterThan(("id",), 179), LessThanOrEqual(("id",), 185)) == 1
    assert count(In(("id",), (3, 177, None))) == 2 and count(EqualTo(("id",), "57")) == 20
    assert count(EqualTo(("texts",), 1)) == 20
    spark.conf.set(arrow_files.PUSHDOWN, "true")
    df = read(spark, tmp_path / "d", index=index).where("id between 60 and 79 or id is null").where("id >= 60 and id < 80")
    assert sorted(r.id for r in df.collect()) == list(range(60, 80))
    assert "id" in df._jdf.queryExecution().executedPlan().toString()
    named = {r.id for r in read(spark, tmp_path / "d", index=index).where("name >= 'n5'").collect()}
    assert named == {i for i, n in enumerate(table["name"].to_pylist()) if n and n >= "n5"}


def test_bounds_of_odd_columns():
    batch = pa.record_batch(
        {
            "nulls": pa.array([None, None], pa.int32()),
            "nan": [1.0, float("nan")],
            "long": ["a" * 99, "z" * 99],
            "flag": [True, False],
            "list": [[1], [2]],
        }
    )
    bounds = arrow_files._bounds_of(batch, batch.schema.names)
    assert set(bounds) == {"nulls", "long", "flag"} and bounds["nulls"] == "[]"
    least, greatest = arrow_files.json.loads(bounds["long"])
    assert least <= "a" * 99 and greatest >= "z" * 99 and max(map(len, (least, greatest))) < 70


def test_index_is_reused_and_renewed(spark, tmp_path):
    import os

    put(tmp_path / "d/a.arrow", some_table(50))
    put(tmp_path / "d/b.arrow", some_table(30))
    index = str(tmp_path / "index")
    first = arrow_files.index_arrow_files(spark, str(tmp_path / "d"), index).collect()
    files = {f: os.stat(f).st_mtime_ns for f in (tmp_path / "index").glob("*.parquet")}
    again = arrow_files.index_arrow_files(spark, str(tmp_path / "d"), index).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert files == {f: os.stat(f).st_mtime_ns for f in (tmp_path / "index").glob("*.parquet")}
    put(tmp_path / "d/b.arrow", some_table(90))
    # a file that has changed since is read without the index
    assert read(spark, tmp_path / "d", index=index).count() == 140
    renewed = arrow_files.index_arrow_files(spark, str(tmp_path / "d"), index)
    assert renewed.where(f"kind = {BATCH}").agg(F.sum("rows")).head()[0] == 140
    assert read(spark, tmp_path / "d", index=index).count() == 140


def test_driver_opens_one_file(spark, tmp_path, monkeypatch):
    for k in range(5):
        put(tmp_path / f"d/{k}.arrow", some_table(50))
    opened = []
    real = arrow_files._open
    monkeypatch.setattr(arrow_files, "_open", lambda path: opened.append(path) or real(path))
    source = arrow_files.ArrowFiles({"path": str(tmp_path / "d")})
    parts = source.reader(source.schema()).partitions()
    assert len(opened) == 1 and len(parts) == 5


def test_filters_on_the_folder_skip_files(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo

    for subject in ("history", "logic"):
        put(tmp_path / f"d/{subject}/0.0.0/x.arrow", some_table(20))
    options = {"folder": "subject", "root": str(tmp_path / "d")}
    assert len(planned(spark, tmp_path / "d", [EqualTo(("subject",), "logic")], **options)) == 1
    spark.conf.set(arrow_files.PUSHDOWN, "true")
    df = read(spark, tmp_path / "d", **options)
    assert {r.subject: r["count"] for r in df.groupBy("subject").count().collect()} == {"history": 20, "logic": 20}
    one = df.where("subject = 'logic'")
    assert one.count() == 20 and one.rdd.getNumPartitions() == 1 and df.where("subject = 'none'").count() == 0


@pytest.mark.parametrize("indexed", [False, True])
def test_damage_is_reported(spark, tmp_path, indexed):
    table = some_table(100)
    for name in ("good", "cut", "noise", "empty"):
        put(tmp_path / f"d/{name}.arrow", table)
    whole = (tmp_path / "d/cut.arrow").read_bytes()
    (tmp_path / "d/cut.arrow").write_bytes(whole[: len(whole) * 7 // 10])
    (tmp_path / "d/noise.arrow").write_bytes(b"no arrow file at all" * 10)
    (tmp_path / "d/empty.arrow").write_bytes(b"")
    index = str(tmp_path / "index")
    if indexed:
        arrow_files.index_arrow_files(spark, str(tmp_path / "d"), index)
    for size in ("2000", "1000000"):
        df = read(spark, tmp_path / "d", damaged="report", position=True, split_bytes=size, index=index if indexed else None)
        rows = df.collect()
        bad = {r._file.rsplit("/", 1)[1]: r._damage for r in rows if r._damage}
        assert set(bad) == {"cut.arrow", "noise.arrow", "empty.arrow"} and sum(bool(r._damage) for r in rows) == 3
        assert all(r.id is None for r in rows if r._damage)
        good = [r.id for r in rows if not r._damage]
        assert len(good) > 150 and set(good) == set(range(100))
    with pytest.raises(Exception, match="cut.arrow|noise|Damaged|no schema|empty"):
        read(spark, tmp_path / "d").count()


def test_a_damaged_batch_does_not_hide_the_others(spark, tmp_path):
    path = put(tmp_path / "d/a.arrow", pa.table({"w": [f"word {i}" for i in range(50)]}))
    third = [m for m in walked(path) if m.kind == BATCH][2]
    whole = bytearray(path.read_bytes())
    whole[third.offset + third.size - 128 : third.offset + third.size - 88] = b"\xff" * 40  # no text in UTF-8
    path.write_bytes(whole)
    rows = read(spark, tmp_path / "d", damaged="report", position=True).collect()
    assert sum(r._damage is None for r in rows) == 40 and [r._batch for r in rows if r._damage] == [2]


def test_damaged_parquet_files_are_reported(spark, tmp_path):
    folder = tmp_path / "baber___piqa"
    folder.mkdir()
    rows = spark.createDataFrame([("g", "a", "b", 1)], "goal string, sol1 string, sol2 string, label int").coalesce(1)
    import pyarrow.parquet as pq

    pq.write_table(rows.toArrow(), folder / "p-test-00000-of-00002.parquet")
    (folder / "p-test-00001-of-00002.parquet").write_text("broken")
    tables, failed = cache.load_tasks_reporting(spark, str(tmp_path))
    assert not failed and tables["PIQA"].where("_damage is not null").count() == 1 and tables["PIQA"].count() == 2
    (folder / "p-test-00000-of-00002.parquet").write_text("broken too")
    tables, failed = cache.load_tasks_reporting(spark, str(tmp_path))
    assert not tables and set(failed) == {"PIQA"}
