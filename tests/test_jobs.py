"""The whole path from a list of addresses to result tables, on files."""

import json
from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.fixed_values import HOLDOUT_TOPICS, TOPICS
from corpuslab.operators.prepare import with_stable_ids
from corpuslab.operators.splits import rows_with_topic
from corpuslab.plans import jobs
from corpuslab.schemas import ARTICLES
from corpuslab.sources import readers, writers
from corpuslab.staging import detached, owned_staging, shared_dir, stage


def clients():
    """Every third address has no text of its own, every seventh is missing."""

    def make_client():
        def answer(batch):
            out = []
            for request in batch["request"]:
                n = int(request.rsplit("/", 1)[1])
                if n % 7 == 0:
                    out.append((404, None))
                elif n % 3 == 0 and not request.startswith("archive"):
                    out.append((200, json.dumps({"objects": [{"text": ""}]})))
                else:
                    item = {"text": f"text {n}", "title": f"t{n}"}
                    out.append((200, json.dumps({"objects": [item]})))
            return out

        return answer

    return make_client


def test_collection_is_resumable(spark, tmp_path):
    base = spark.range(1, 41).select(
        F.col("id").cast("string").alias("article_id"),
        F.concat(F.lit("http://a/"), "id").alias("article_url"),
        F.when(F.col("id") % 2 == 0, "support").otherwise("disinformation").alias("class"),
    )
    snapshots = base.filter("int(article_id) % 2 = 0").select(
        "article_url", F.lit(1).alias("ts"), F.concat(F.lit("archive/"), "article_id").alias("archive_url")
    )
    cache, output = str(tmp_path / "cache"), str(tmp_path / "articles")
    first = dict(
        (r["outcome"], r["n"])
        for r in jobs.collect_articles(base.filter("int(article_id) <= 20"), snapshots, clients(), cache, output, 2).collect()
    )
    assert first == {"http_skip": 2, "ok": 12, "ok_archive": 3, "failed_no_archive": 3}
    second = dict(
        (r["outcome"], r["n"])
        for r in jobs.collect_articles(base, snapshots, clients(), cache, output).collect()
    )
    assert second["cached"] == 15 and sum(second.values()) == 40
    schema = "article_title string, article_text string, article_id string"
    table = readers.read_csv(spark, output, T.StructType.fromDDL(schema), all_columns=True)
    assert table.columns == ["article_title", "article_text", "article_id", "article_url", "class", "collected_at"]
    assert table.filter("class is null").count() == 0
    stored = {r["article_id"]: r["article_text"] for r in table.collect()}
    assert len(stored) == table.count() == second["cached"] + second["ok"] + second["ok_archive"]
    assert stored["6"] == "text 6"


@pytest.fixture(scope="module")
def articles_path(spark, tmp_path_factory):
    n = F.col("id")
    bad = n % 3 == 0
    rows = spark.range(240).select(
        n.cast("string").alias("article_id"),
        F.when(bad, "disinformation").otherwise("support").alias("class"),
        F.when(n % 2 == 0, "English").otherwise("Russian").alias("article_language"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("title "), n)).alias("article_title"),
        F.concat(F.when(bad, "false claim\n").otherwise("true report "), F.concat(F.lit("word"), n % 11)).alias("article_text"),
        F.when(n % 4 == 0, "ria.ru").otherwise("news.org").alias("article_publisher"),
        F.when(n % 6 != 5, F.when(n % 2 == 0, "NATO, Crimea").otherwise("Coronavirus, Ukraine , USSR")).alias("keywords"),
        F.date_format(F.date_add(F.lit("2019-01-15").cast("date"), (n * 7).cast("int")), "dd-MM-yyyy").alias("published_date"),
        F.floor(n / 3).cast("string").alias("debunk_id"),
        F.date_format(F.date_add(F.lit("2019-01-15").cast("date"), (n * 7).cast("int")), "dd-MM-yyyy").alias("debunk_date"),
    )
    path = str(tmp_path_factory.mktemp("articles") / "articles.csv")
    writers.write_csv(rows.to(ARTICLES), path)
    return path


def test_experiments_from_files(spark, articles_path, tmp_path):
    path = {n: str(tmp_path / n) for n in ("train", "dev", "main", "best", "topics", "time", "grid")}
    with pytest.raises(FileNotFoundError):
        jobs.read_experiment(spark, path["train"])
    jobs.prepare_dataset(spark, articles_path, path["train"], path["dev"])
    train, dev = (jobs.read_experiment(spark, path[n]) for n in ("train", "dev"))
    assert (train.count(), dev.count()) == (216, 24)
    assert train.filter("text like '%\n%'").count() > 0

    jobs.run_main_experiment(
        spark, path["train"], path["dev"], path["main"], path["best"], k=4, languages=["Russian", "English"]
    )
    schema = T.StructType.fromDDL("language string, f1_mean double, f1_std double")
    assert rows_of(readers.read_csv(spark, path["main"], schema), "language", "f1_mean") == [
        ("Average", 1.0), ("English", 1.0), ("Russian", 1.0)
    ]
    best = readers.read_json_lines(spark, path["best"], T.StructType.fromDDL("alpha double"))
    assert best.first()["alpha"] == 0.01

    jobs.run_cross_topics(spark, path["train"], path["topics"])
    schema = T.StructType.fromDDL(
        "train_topics string, test_topics string, f1_avg double, f1_weighted double, f1_overall double"
    )
    tests = [r["test_topics"] for r in readers.read_csv(spark, path["topics"], schema).collect()]
    assert sorted(tests) == ["covid-19", "covid-19, west, russia, ukraine", "russia", "ukraine", "west"]

    jobs.run_temporal_splits(spark, path["train"], path["time"])
    schema = T.StructType.fromDDL(
        "event string, train_period string, test_period string, f1_avg double, f1_weighted double, f1_overall double"
    )
    assert rows_of(readers.read_csv(spark, path["time"], schema), "event", "train_period", "test_period") == [
        ("Covid-19", "<01-10-2019", ">=01-10-2019"), ("Invasion of Ukraine", "<24-02-2022", ">=24-02-2022")
    ]

    jobs.run_cross_datasets(spark, {"a": path["train"], "b": path["dev"]}, path["grid"])
    schema = T.StructType.fromDDL(
        "train_dataset string, test_dataset string, f1_avg double, f1_weighted double, f1_overall double"
    )
    grid = rows_of(readers.read_csv(spark, path["grid"], schema), "train_dataset", "test_dataset")
    assert grid == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]


def test_all_reports_from_files(spark, articles_path, tmp_path):
    names = jobs.analyse(spark, articles_path, str(tmp_path))
    assert len(names) == 25
    schema = T.StructType.fromDDL("article_language string, total long, disinformation long, support long")
    table = readers.read_csv(spark, f"{tmp_path}/languages", schema)
    assert rows_of(table) == [("English", 120, 40, 80), ("Russian", 120, 40, 80)]
    assert all(readers.path_exists(spark, f"{tmp_path}/{name}") for name in names)


def test_hold_out_lists_are_not_those_of_the_reports(frame):
    words = ["Ukraine", "Illegal annexation", "virus / bacteria threat", "Crimea", None]
    df = frame(list(enumerate(words)), "id int, keywords string")
    assert rows_of(rows_with_topic(df, "keywords", HOLDOUT_TOPICS), "id") == [(3,)]
    shown = {topic: list(names) for topic, names in TOPICS.items()}
    assert rows_of(rows_with_topic(df, "keywords", shown), "id") == [(0,), (1,), (2,), (3,)]


def test_ids_follow_from_the_content(spark, frame):
    """The same rows in other files, orders and partitions have the same ids; copies are numbered."""
    rows = [("a", 1), ("a", 1), ("b", None), (None, None), ("a", 2), ("", 1), ("a|", 1)] + [("copy", 0)] * 300
    layouts = [frame(rows, "t string, k int").repartition(n) for n in (1, 3, 7)]
    layouts.append(frame(rows[::-1], "t string, k int").repartition(5, "t"))
    found = [rows_of(with_stable_ids(df, ["t", "k"], "id")) for df in layouts]
    assert found[0] == found[1] == found[2] == found[3]
    assert len({r[0] for r in found[0]}) == len(rows)
    numbers = sorted(int(r[0].split("-")[1]) for r in found[0] if r[1] == "copy")
    assert numbers == list(range(1, 301))


@pytest.fixture(scope="module")
def other_collections(spark, tmp_path_factory):
    """A nested collection in JSON lines and a flat one in CSV, without ids."""
    folder = tmp_path_factory.mktemp("collections")
    n = F.col("id")
    text = F.concat(F.lit("one two three four five six seven\neight nine ten "), F.when(n % 3 == 0, "hoax ").otherwise("fact "), (n % 50).cast("string"))
    rows = spark.range(160).select(
        text.alias("t"), (n % 3 == 0).cast("int").alias("y"), F.when(n % 2 == 0, "en").otherwise("es").alias("lang")
    )
    nested = rows.select(
        F.struct(F.col("t").alias("text")).alias("ref_source"), F.when(F.col("y") == 0, "real").otherwise("fake").alias("label"), "lang"
    )
    nested.write.json(str(folder / "nested"))
    flat = rows.select(F.col("t").alias("article_text"), F.col("y").alias("class"), F.col("lang").alias("article_language"))
    writers.write_csv(flat, str(folder / "flat"))
    return folder


def test_other_collections_from_their_files(spark, other_collections, tmp_path):
    path = {n: str(tmp_path / n) for n in ("nt", "nd", "ft", "fd", "again", "againd", "grid")}
    jobs.prepare_nested_dataset(spark, str(other_collections / "nested"), path["nt"], path["nd"])
    jobs.prepare_flat_dataset(spark, str(other_collections / "flat"), path["ft"], path["fd"])
    for train, dev, names in (("nt", "nd", {"English", "Spanish"}), ("ft", "fd", {"en", "es"})):
        parts = [jobs.read_experiment(spark, path[p]) for p in (train, dev)]
        assert [p.count() for p in parts] == [144, 16]
        assert {r["language"] for r in parts[0].collect()} == names
        assert len({r["article_id"] for p in parts for r in p.collect()}) == 160
    # Another layout of the same file gives the same parts.
    one = str(tmp_path / "one")
    spark.read.json(str(other_collections / "nested")).coalesce(1).write.json(one)
    jobs.prepare_nested_dataset(spark, one, path["again"], path["againd"])
    ids = lambda p: sorted(r["article_id"] for r in jobs.read_experiment(spark, path[p]).collect())
    assert ids("againd") == ids("nd")
    jobs.run_cross_datasets(spark, {"nested": path["nt"], "flat": path["ft"]}, path["grid"])
    with pytest.raises(FileNotFoundError):
        jobs.prepare_flat_dataset(spark, str(tmp_path / "absent"), path["ft"], path["fd"])


def test_classifiers_reports_and_metrics_from_files(spark, other_collections, tmp_path):
    """Both classifiers, the report of one parameter, its metrics; nothing staged is left behind."""
    train, dev, out, report, metrics = (str(tmp_path / n) for n in ("train", "dev", "out", "report", "metrics"))
    jobs.prepare_nested_dataset(spark, str(other_collections / "nested"), train, dev)
    left = Path(shared_dir(spark).removeprefix("file:"))
    before = set(left.iterdir())
    jobs.run_classifiers(spark, train, dev, out, k=3, alphas=[0.1, 1.0], costs=[0.01, 0.1])
    schema = T.StructType.fromDDL("language string, f1_mean double, f1_std double")
    for name, key in (("naive_bayes", "alpha"), ("linear_svm", "cost")):
        table = readers.read_csv(spark, f"{out}/results_{name}", schema)
        assert [r[0] for r in rows_of(table)] == ["Average", "English", "Spanish"]
        best = readers.read_json_lines(spark, f"{out}/params_{name}", T.StructType.fromDDL(f"{key} double"))
        assert best.first()[key] is not None
    for classifier, parameter in (("naive_bayes", 0.1), ("linear_svm", 0.1)):
        jobs.run_cv_report(
            spark, train, report, parameter, classifier, languages=["Spanish", "English"], k=3, metrics_path=metrics
        )
        schema = T.StructType.fromDDL("row string, f1_mean double, f1_std double, weight double")
        rows = {r["row"]: r for r in readers.read_csv(spark, report, schema).collect()}
        assert len(rows) == 8 and rows["Weighted F1"]["f1_mean"] == pytest.approx(1.0)
    logged = {(r["run"], r["metric"]): r["value"] for r in spark.read.parquet(metrics).collect()}
    assert logged["naive_bayes-0.1", "parameter"] == 0.1 and logged["linear_svm-0.1", "folds"] == 3.0
    assert len(logged) == 16
    with pytest.raises(FileNotFoundError):
        jobs.run_cv_report(spark, str(tmp_path / "absent"), report, 0.1)
    assert set(left.iterdir()) == before


def test_scopes_of_staged_tables(spark):
    """An inner scope ends first, a failure deletes too, and what is detached stays readable."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    with owned_staging(spark):
        outer = stage(spark.range(5), "outer")
        with pytest.raises(RuntimeError), owned_staging(spark):
            stage(spark.range(3), "inner")
            raise RuntimeError
        assert outer.count() == 5 and len(set(folder.iterdir()) - before) == 1
        kept = detached(outer)
    assert set(folder.iterdir()) == before and kept.count() == 5
