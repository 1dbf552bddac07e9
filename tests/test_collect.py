import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab import schemas, staging
from corpuslab.operators import collect
from corpuslab.sources import readers, writers
from corpuslab.streaming.incremental import update_articles

RESPONSE = "article_id string, status int, error string, text string, title string"


def test_every_outcome(frame):
    base = frame([(c, f"u{c}") for c in "abcdefghij"], "article_id string, article_url string")
    primary = frame(
        [
            ("a", 200, None, "text", "T"), ("b", 404, None, None, None), ("c", 200, None, "", None),
            ("d", 200, "e", None, None), ("e", 200, None, "", None), ("f", 200, None, "", None),
            ("g", 200, None, None, None), ("h", 200, None, "", None), ("j", 200, "e", None, None),
        ],
        RESPONSE,
    )
    oldest = frame([(f"u{c}", f"archive/u{c}") for c in "defhj"], "article_url string, archive_url string")
    archive = frame(
        [
            ("d", 200, "again", None, None), ("e", 200, None, "copy", "C"), ("f", 500, None, None, None),
            ("j", 500, None, None, None),
        ],
        RESPONSE,
    )
    located = collect.locate_archive(base, primary, oldest)
    resolved = collect.resolve(base, primary, located, archive)
    found = {r["article_id"]: r for r in resolved.collect()}
    assert {k: r["outcome"] for k, r in found.items()} == {
        "a": "ok", "b": "http_skip", "c": "failed_no_archive", "d": "failed_error", "e": "ok_archive",
        "f": "ok_empty", "g": "exception", "h": "exception", "i": "exception", "j": "failed_error",
    }
    assert (found["a"]["article_text"], found["a"]["article_title"]) == ("text", "T")
    assert (found["e"]["article_text"], found["e"]["article_title"]) == ("copy", "C")
    assert found["f"]["article_text"] == "" and found["c"]["article_text"] is None
    assert [r[0] for r in rows_of(collect.new_cache_rows(resolved), "article_id")] == ["a", "e", "f"]
    cache = frame([("x", 1), ("x", 2)], "article_id string, n int")
    counts = rows_of(collect.outcome_counts(base, cache, resolved))
    assert sum(n for _, n, _ in counts) == 10 and sum(f for _, _, f in counts) == 3


def test_many_rows_of_one_address(frame, spark):
    base = spark.range(900).select(
        F.col("id").cast("string").alias("article_id"),
        F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("article_url"),
    )
    primary = base.select(
        "article_id", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"),
        F.lit("").alias("text"), F.lit(None).cast("string").alias("title"),
    )
    archive = primary.withColumn("text", F.lit("copy"))
    oldest = frame([("hot", "archive/hot")], "article_url string, archive_url string")
    located = collect.locate_archive(base, primary, oldest)
    found = collect.resolve(base, primary, located, archive).groupBy("outcome").count()
    assert rows_of(found) == [("failed_no_archive", 300), ("ok_archive", 600)]


def test_pending_rows_ignore_repeats(frame):
    base = frame([("a",), ("b",)], "id string")
    done = frame([("a",), ("a",), ("c",)], "id string")
    assert rows_of(collect.pending_rows(base, done, "id")) == [("b",)]


def test_fetch_and_parse(frame):
    bodies = {
        "u1": (200, json.dumps({"objects": [{"text": "x", "title": "T"}, {"text": "no"}]})),
        "u2": (200, json.dumps({"error": "bad"})),
        "u3": (404, None),
        "u4": (200, json.dumps({"objects": [{"text": ""}]})),
        "u5": (200, "not json"),
    }

    def make():
        return lambda batch: [bodies[u] for u in batch["article_url"]]

    base = frame([(u[1], u) for u in bodies], "article_id string, article_url string")
    fetched = collect.fetch(base, make, partitions=2)
    found = rows_of(collect.parse_responses(fetched, "article_id"))
    assert found == [
        ("1", 200, None, "x", "T"), ("2", 200, "bad", None, None), ("3", 404, None, None, None),
        ("4", 200, None, "", None), ("5", 200, None, None, None),
    ]


def test_one_failing_request_does_not_fail_the_batch(frame):
    def make_ask():
        def ask(address):
            if address == "u2":
                raise OSError("no answer")
            return 200, json.dumps({"objects": [{"text": address}]})

        return ask

    base = frame([("1", "u1"), ("2", "u2"), ("3", "u3")], "article_id string, request string")
    fetched = collect.fetch(base.coalesce(1), collect.per_request(make_ask))
    found = rows_of(collect.parse_responses(fetched, "article_id"), "article_id", "status", "text")
    assert found == [("1", 200, "u1"), ("2", None, None), ("3", 200, "u3")]


def test_csv_columns_are_found_by_name(spark, frame, tmp_path):
    writers.write_csv(frame([("1", 2, "x")], "a string, b int, c string"), str(tmp_path / "c"))
    schema = T.StructType.fromDDL("c string, b int")
    assert rows_of(readers.read_csv(spark, str(tmp_path / "c"), schema)) == [("x", 2)]
    with pytest.raises(ValueError, match="missing columns: d"):
        readers.read_csv(spark, str(tmp_path / "c"), T.StructType.fromDDL("d string"))


def test_request_url(frame):
    df = frame([("http://a.b/?q=1",)], "u string")
    url = df.select(collect.request_url("https://service/article", F.col("u"), "key")).first()[0]
    assert url == "https://service/article?token=key&url=http%3A%2F%2Fa.b%2F%3Fq%3D1&timeout=60000"


def test_oldest_snapshot(frame):
    df = frame([("u", 3, "c"), ("u", 1, "b"), ("u", 1, "a"), ("v", 2, "d")], "url string, ts int, at string")
    assert rows_of(collect.oldest_snapshots(df, "url", "ts", "at")) == [("u", "a"), ("v", "d")]


def test_finalize_keeps_the_first(frame):
    df = frame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z")], "article_id string, o int, t string")
    assert rows_of(collect.finalize(df, [F.col("o")])) == [("a", 1, "x"), ("b", 5, "z")]


def test_csv_keeps_newlines_quotes_and_blanks(spark, frame, tmp_path):
    rows = [("1", 'a "b"\nc, d', " x "), ("2", None, "back\\slash"), ("3", "", "é")]
    df = frame(rows, "i string, t string, u string")
    writers.write_csv(df, str(tmp_path / "c"))
    found = readers.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert rows_of(found) == [("1", 'a "b"\nc, d', " x "), ("2", None, "back\\slash"), ("3", None, "é")]


def test_missing_tokens_become_null(frame):
    df = readers.blank_missing_tokens(frame([("NA", 1), ("x", 2), ("nan", 3)], "a string, b int"))
    assert rows_of(df) == [(None, 1), (None, 3), ("x", 2)]


def test_broken_cache_lines_are_reported(spark, tmp_path):
    path = tmp_path / "cache.json"
    path.write_text('{"article_id": "1", "article_text": "a"}\n{"article_id": "2", "artic\n\n{"article_id": "3"}\n')
    good, broken = readers.read_cache(spark, str(path), schemas.CACHE)
    assert [r[0] for r in rows_of(good, "article_id")] == ["1", "3"]
    assert sorted(r[0] for r in broken.collect()) == ["", '{"article_id": "2", "artic']
    assert broken.count() == 2
    good, broken = readers.read_cache(spark, str(tmp_path / "none"), schemas.CACHE)
    assert good.count() == 0 and broken.count() == 0


def test_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run the split first"):
        readers.require_path(spark, str(tmp_path / "x"), "run the split first")
    assert readers.require_path(spark, str(tmp_path)) == str(tmp_path)


def test_metrics_are_appended(spark, frame, tmp_path):
    path = str(tmp_path / "m")
    for run in ("r1", "r2"):
        writers.log_metrics(spark, path, run, frame([(0.5, 2)], "f1 double, n int"))
    assert rows_of(spark.read.parquet(path)) == [
        ("r1", "f1", 0.5), ("r1", "n", 2.0), ("r2", "f1", 0.5), ("r2", "n", 2.0)
    ]


def test_incremental_update_equals_the_batch_result(spark, frame, tmp_path):
    schema = T.StructType.fromDDL("article_id string, o int, t string")
    cache, table, progress = (str(tmp_path / n) for n in ("cache", "table", "progress"))
    first = frame([("a", 2, "late"), ("a", 1, "x"), ("b", 1, "y")], schema)
    second = frame([("a", 0, "new"), ("c", 1, "z")] + [("c", i, "rep") for i in range(2, 50)], schema)
    order = [F.asc("o")]
    writers.append_json_lines(first.coalesce(1), cache)
    assert update_articles(spark, cache, schema, table, progress, order).count() == 2
    writers.append_json_lines(second.coalesce(1), cache)
    found = update_articles(spark, cache, schema, table, progress, order)
    assert rows_of(found) == [("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")]
    again = update_articles(spark, cache, schema, table, progress, order)
    assert again.count() == 3


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = staging.shared_dir(spark)
    assert folder == named if named else folder
    staged = staging.stage(spark.range(3), "numbers")
    assert staged.count() == 3 and staged.dtypes == [("id", "bigint")]


def test_a_client_gets_few_bytes_at_a_time(frame):
    """Batches of the client are bounded by bytes, not by rows; no row is lost."""

    def make_client():
        return lambda batch: [(int(batch["body_in"].str.len().sum()), None if i == 7 else str(i)) for i in batch["id"]]

    df = frame([(i, "x" * 1_000_000) for i in range(20)] + [(20, None)], "id long, body_in string").coalesce(1)
    found = sorted(collect.fetch(df, make_client).select("id", "status", "body").collect())
    assert [r["id"] for r in found] == list(range(21))
    assert [r["body"] for r in found] == [None if i == 7 else str(i) for i in range(21)]
    assert max(r["status"] for r in found) <= 2 * collect.CLIENT_BYTES
