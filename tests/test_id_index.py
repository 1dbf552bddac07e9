"""The id index of the incremental update: what it reads, and that it never loses or repeats a row."""

import random

from conftest import rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.sources import writers
from corpuslab.streaming.id_index import IdIndex
from corpuslab.streaming.incremental import update_articles

SCHEMA = "article_id string, o int, t string"


def ids_of(frame, values):
    return frame([(v,) for v in values], "article_id string")


def files_read(df):
    """Files that a scan opens after pruning, from its metrics."""
    if df is None:
        return 0
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_few_buckets_are_read(spark, frame, tmp_path):
    index = IdIndex(str(tmp_path / "index"), "article_id", buckets=32, bits=1 << 14)
    for batch in range(3):
        index.add(ids_of(frame, [f"{batch}-{i}" for i in range(2000)]), batch)
    files = files_read
    every = files(spark.read.parquet(index.path + "/ids"))
    assert every >= 96
    # New ids: nearly all are told to be new, and their buckets are not read.
    new = index.suspects(ids_of(frame, [f"new-{i}" for i in range(10)]), 3)
    assert new.count() <= 2 and files(index.stored(new, 3)) <= every * 2 / 32
    # One known id: its bucket in each batch.
    one = index.suspects(ids_of(frame, ["1-77"]), 3)
    assert rows_of(one) == [("1-77",)] and 0 < files(index.stored(one, 3)) <= every / 32 + 1
    # A batch does not see itself or later ones.
    assert index.suspects(ids_of(frame, ["1-77"]), 1).count() == 0
    assert index.suspects(ids_of(frame, ["1-77"]), 0) is None


def test_full_filters_cost_reads_but_no_rows(spark, frame, tmp_path):
    index = IdIndex(str(tmp_path / "index"), "article_id", buckets=2, bits=64)
    index.add(ids_of(frame, [f"a{i}" for i in range(500)]), 0)
    fresh = ids_of(frame, [f"a{i}" for i in range(490, 510)])
    assert index.suspects(fresh, 1).count() == 20
    assert rows_of(index.drop_known(fresh, 1)) == [(f"a{i}",) for i in range(500, 510)]


def test_batches_of_random_ids_equal_one_table(spark, frame, tmp_path):
    """Several batches, repeated ids, a repeated batch and a table that had no index before."""
    draw = random.Random(2)
    schema = T.StructType.fromDDL(SCHEMA)
    cache, table, progress = (str(tmp_path / n) for n in ("cache", "table", "progress"))
    seen = {}
    for batch in range(3):
        rows = [(f"id{draw.randrange(120)}", i, f"{batch}.{i}") for i in range(60)]
        for row in sorted(rows, key=lambda r: r[1]):
            seen.setdefault(row[0], row)
        writers.append_json_lines(frame(rows, SCHEMA).coalesce(1), cache)
        found = update_articles(spark, cache, schema, table, progress, [F.asc("o")])
        assert rows_of(found) == sorted(seen.values(), key=lambda r: tuple(str(v) for v in r))
    index = IdIndex(f"{table}_index", "article_id")
    again = IdIndex(str(tmp_path / "other"), "article_id")
    stored = found.select("article_id")
    again.add(stored, -1)
    assert again.drop_known(stored, 0).count() == 0
    index.add(ids_of(frame, ["id1"]), 2)
    index.add(ids_of(frame, ["id1"]), 2)
    assert spark.read.parquet(index.path + "/ids").filter("batch_id = 2").count() == 1


def test_a_table_without_an_index_gets_one(spark, frame, tmp_path):
    schema = T.StructType.fromDDL(SCHEMA)
    cache, table, progress = (str(tmp_path / n) for n in ("cache", "table", "progress"))
    old = [("a", 1, "x"), ("b", 1, "y")]
    frame(old, SCHEMA).write.parquet(f"{table}/batch_id=-1")
    writers.append_json_lines(frame([("a", 0, "new"), ("c", 1, "z")], SCHEMA).coalesce(1), cache)
    found = update_articles(spark, cache, schema, table, progress, [F.asc("o")])
    assert rows_of(found) == [*old, ("c", 1, "z")]
