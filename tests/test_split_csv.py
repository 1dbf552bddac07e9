"""CSV files that are cut at any byte, against the reader that takes a file whole."""

import random
from contextlib import contextmanager

import pytest
from conftest import rows_of
from pyspark.sql import types as T

from corpuslab.plans import catalog
from corpuslab.sources import readers, split_csv, writers

def texts(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SCHEMA = texts("id", "a", "b")


@contextmanager
def splits_of(spark, size):
    """Scans with at most ``size`` bytes per split."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def cells(draw, k):
    pieces = ["x", '"', "\n", ",", " ", "é", "\U0001f600", "word", '""', "\n\n", ",\n\""]
    return "".join(draw.choice(pieces) for _ in range(draw.randrange(0, k)))


@pytest.mark.parametrize("size", [57, 64, 211, 1 << 20])
def test_records_are_cut_alike_at_every_border(spark, frame, tmp_path, size):
    draw = random.Random(size)
    rows = [(str(i), cells(draw, 12), cells(draw, 40)) for i in range(24)]
    path = str(tmp_path / "one")
    writers.write_csv(frame(rows, SCHEMA).coalesce(1), path)
    expected = rows_of(readers.read_csv(spark, path, SCHEMA))
    assert len(expected) == 24
    with splits_of(spark, size):
        found = split_csv.read_csv_splits(spark, path, SCHEMA)
        assert rows_of(found) == expected
        splits = split_csv.read_records(spark, path).select("block").distinct().count()
    assert splits > 1


def test_one_record_over_many_splits(spark, frame, tmp_path):
    """A cell of many lines whose first and last lines lie in different splits, between short records."""
    long = "\n".join(f'line {i}, "quoted"' for i in range(100))
    rows = [("1", "a", "b"), ("2", long, "\n" + long), ("3", None, "c"), ("4", '"', '\n"\n')]
    path = str(tmp_path / "long")
    writers.write_csv(frame(rows, SCHEMA).coalesce(1), path)
    with splits_of(spark, 512):
        assert rows_of(split_csv.read_csv_splits(spark, path, SCHEMA)) == rows_of(frame(rows, SCHEMA))


def test_files_with_headers_of_their_own(spark, frame, tmp_path):
    rows = [(str(i), f"a\n{i}", None if i % 3 else "") for i in range(40)]
    path = str(tmp_path / "many")
    writers.write_csv(frame(rows, SCHEMA).repartition(4), path)
    narrow = T.StructType.fromDDL("b string, id int")
    with splits_of(spark, 100):
        found = split_csv.read_csv_splits(spark, path, narrow)
        assert found.columns == ["b", "id"] and found.dtypes[1] == ("id", "int")
        assert rows_of(found) == rows_of(readers.read_csv(spark, path, narrow))
        assert split_csv.read_csv_splits(spark, path, narrow, all_columns=True).columns == ["b", "id", "a"]
        with pytest.raises(ValueError, match="missing columns"):
            split_csv.read_csv_splits(spark, path, T.StructType.fromDDL("other string"))


def test_foreign_line_ends_and_empty_lines(spark, tmp_path):
    file = tmp_path / "crlf.csv"
    file.write_bytes(b'id,a,b\r\n1,x,"p\nq"\r\n\r\n2,,"r ""s"""\r\n3,y,z')
    for size in (9, 1 << 20):
        with splits_of(spark, size):
            found = rows_of(split_csv.read_csv_splits(spark, str(file), SCHEMA))
        assert found == [("1", "x", "p\nq"), ("2", None, 'r "s"'), ("3", "y", "z")]


def test_many_splits_without_a_broadcast(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(split_csv, "BROADCAST_SPLITS", 0)
    rows = [(str(i), f'a "{i}"\n,b', "c\n" * (i % 5)) for i in range(30)]
    path = str(tmp_path / "shuffled")
    writers.write_csv(frame(rows, SCHEMA).coalesce(1), path)
    with splits_of(spark, 90):
        assert rows_of(split_csv.read_csv_splits(spark, path, SCHEMA)) == rows_of(readers.read_csv(spark, path, SCHEMA))


def test_empty_files(spark, frame, tmp_path):
    path = str(tmp_path / "empty")
    writers.write_csv(frame([], SCHEMA).coalesce(1), path)
    assert split_csv.read_csv_splits(spark, path, SCHEMA).count() == 0


@pytest.mark.parametrize("file_bytes, files", [(2**29, 1), (100_000, 2)])
def test_the_large_file_is_not_joined_by_its_writing_task(spark, monkeypatch, file_bytes, files):
    """The join of the articles stays with its own tasks, and a file has a bounded size."""
    written = []
    monkeypatch.setattr(catalog, "CSV_FILE_BYTES", file_bytes)
    monkeypatch.setattr(writers, "write_csv", lambda df, path, made=writers.write_csv: written.append(df) or made(df, path))
    found = catalog.scan_csv_split(spark, "/root/testdata/sf0.001")
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("RepartitionByExpression")
    assert written[0].rdd.getNumPartitions() >= files
    assert rows_of(found) == rows_of(catalog.scan_csv_roundtrip(spark, "/root/testdata/sf0.001"))
