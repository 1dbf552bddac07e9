"""File-to-file jobs: collect, prepare, analyse and run the experiments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.fixed_values import (
    ALPHAS,
    COSTS,
    EVENTS,
    FOLDS,
    HOLDOUT_TOPICS,
    REPORT_LANGUAGES,
    TOPICS,
)
from corpuslab.functions.dates import parse_day_first
from corpuslab.functions.text import capitalize
from corpuslab.operators import aggregate, collect, evaluate, topk
from corpuslab.operators.prepare import with_stable_ids
from corpuslab.plans import experiments
from corpuslab.schemas import ARTICLES, COLLECTED, EXPERIMENT, FLAT_NEWS, NESTED_NEWS
from corpuslab.sources.readers import (
    blank_missing_tokens,
    read_cache,
    read_json_lines,
    require_path,
)
from corpuslab.sources.split_csv import read_csv_splits
from corpuslab.sources.writers import (
    append_json_lines,
    log_metrics,
    write_best_parameters,
    write_csv,
)
from corpuslab.staging import detached, owned_staging, owns_staging, stage

CLASSES = ["disinformation", "support"]
CLASSIFIERS = ("naive_bayes", "linear_svm")


def collect_articles(
    base: DataFrame,
    snapshots: DataFrame,
    make_client: Callable[[], collect.Client],
    cache_path: str,
    output_path: str,
    partitions: int | None = None,
) -> DataFrame:
    """Fetch what the cache lacks, append it, write the article table; returns outcome counts.

    The client gets rows of (article_id, request) and answers (status, body) for each. Fetched
    responses are staged, so a failure in a later step requests nothing again. Further columns of
    ``base`` are carried into the cache and the article table.
    """
    with owned_staging(base.sparkSession):
        return detached(_collect(base, snapshots, make_client, cache_path, output_path, partitions))


def _collect(
    base: DataFrame,
    snapshots: DataFrame,
    make_client: Callable[[], collect.Client],
    cache_path: str,
    output_path: str,
    partitions: int | None = None,
) -> DataFrame:
    spark = base.sparkSession
    schema = T.StructType([*base.schema.fields, *COLLECTED.fields])
    cached, _ = read_cache(spark, cache_path, schema)
    cached = stage(cached.select("article_id"), "cached")
    pending = stage(collect.pending_rows(base, cached, "article_id"), "pending")

    def ask(requests: DataFrame) -> DataFrame:
        fetched = collect.fetch(requests, make_client, partitions)
        return stage(collect.parse_responses(fetched, "article_id"), "responses")

    primary = ask(pending.select("article_id", F.col("article_url").alias("request")))
    oldest = collect.oldest_snapshots(snapshots, "article_url", "ts", "archive_url")
    located = stage(collect.locate_archive(pending, primary, oldest), "in-archive")
    archive = ask(located.select("article_id", F.col("archive_url").alias("request")))
    resolved = stage(collect.resolve(pending, primary, located, archive), "resolved")

    rows = collect.new_cache_rows(resolved)
    rows = rows.withColumn("collected_at", F.current_timestamp().cast("string"))
    append_json_lines(rows, cache_path)
    stored, _ = read_cache(spark, cache_path, schema)
    order = [F.asc("collected_at"), F.asc("article_text")]
    write_csv(collect.finalize(stored, order), output_path)
    return collect.outcome_counts(base, cached, resolved)


def _read(spark: SparkSession, path: str, schema: T.StructType, hint: str) -> DataFrame:
    """A CSV table in which texts such as ``NA`` count as missing."""
    return blank_missing_tokens(read_csv_splits(spark, require_path(spark, path, hint), schema))


@owns_staging
def prepare_dataset(
    spark: SparkSession, articles_path: str, train_path: str, dev_path: str, **balance
) -> None:
    """Write the train and dev part of the article table as CSV."""
    # A CSV scan reads whole lines for every column; the split needs several narrow passes.
    articles = stage(_read(spark, articles_path, ARTICLES, "Collect the articles first."), "articles")
    _write_parts(experiments.prepare_articles(articles, **balance), train_path, dev_path)


def _write_parts(rows: DataFrame, train_path: str, dev_path: str) -> None:
    """Both parts with the columns of an experiment; a collection may lack some, which are empty."""
    columns = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EXPERIMENT]
    for name, path in (("train", train_path), ("test", dev_path)):
        write_csv(rows.filter(F.col("split") == name).select(*columns), path)


@owns_staging
def prepare_nested_dataset(
    spark: SparkSession, news_path: str, train_path: str, dev_path: str, **balance
) -> None:
    """Train and dev part of the nested collection, from its JSON lines.

    The collection has no ids: they follow from label, language and text, so the split is the same
    however the file is read.
    """
    news = read_json_lines(spark, require_path(spark, news_path, "The nested collection."), NESTED_NEWS)
    rows = news.withColumn("_text", F.col("ref_source.text"))
    named = with_stable_ids(rows, ["label", "lang", "_text"]).drop("_text")
    rows = experiments.prepare_nested_news(stage(named, "nested"), "article_id", **balance)
    _write_parts(rows, train_path, dev_path)


@owns_staging
def prepare_flat_dataset(
    spark: SparkSession, news_path: str, train_path: str, dev_path: str, **balance
) -> None:
    """Train and dev part of the flat collection, from its CSV; ids as for the nested one."""
    news = _read(spark, news_path, FLAT_NEWS, "The flat collection.")
    named = with_stable_ids(news, FLAT_NEWS.fieldNames())
    rows = experiments.prepare_flat_news(stage(named, "flat"), "article_id", **balance)
    _write_parts(rows, train_path, dev_path)


def read_experiment(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, EXPERIMENT, "Prepare the dataset first.")


@owns_staging
def run_main_experiment(
    spark: SparkSession,
    train_path: str,
    dev_path: str,
    result_path: str,
    parameter_path: str,
    alphas: list[float] = ALPHAS,
    k: int = FOLDS,
    languages: list[str] | None = None,
    classifier: str = "naive_bayes",
    costs: list[float] = COSTS,
) -> None:
    """Search on the dev part, validate on folds of the train part, write table and parameters.

    ``languages`` selects and orders the rows of the table, which ends with their average.
    ``classifier`` and its grid are as in ``experiments.main_experiment``.
    """
    train = read_experiment(spark, train_path).withColumn("split", F.lit("train"))
    dev = read_experiment(spark, dev_path).withColumn("split", F.lit("test"))
    rows = stage(train.unionByName(dev), "experiment")
    table, best = experiments.main_experiment(
        rows, "article_id", alphas=alphas, k=k, classifier=classifier, costs=costs
    )
    if languages:
        table = evaluate.in_given_order(table, [*languages, "Average"], "language", "f1_mean").drop("position")
    write_csv(table, result_path)
    write_best_parameters(best.drop("position", "score"), parameter_path)


def run_classifiers(
    spark: SparkSession, train_path: str, dev_path: str, folder: str, classifiers: tuple[str, ...] = CLASSIFIERS, **options
) -> None:
    """The main experiment of every classifier: ``results_<name>`` and ``params_<name>`` in a folder."""
    for name in classifiers:
        paths = f"{folder}/results_{name}", f"{folder}/params_{name}"
        run_main_experiment(spark, train_path, dev_path, *paths, classifier=name, **options)


@owns_staging
def run_cv_report(
    spark: SparkSession,
    train_path: str,
    result_path: str,
    parameter: float,
    classifier: str = "naive_bayes",
    languages: list[str] = REPORT_LANGUAGES,
    k: int = FOLDS,
    metrics_path: str | None = None,
) -> None:
    """The cross-validation report of one parameter: languages in order, then summary rows.

    With ``metrics_path``, the parameter, the folds and the summary rows are added to the metrics
    table as a run named after the classifier and the parameter.
    """
    rows = stage(read_experiment(spark, train_path), "train")
    validate = experiments.cross_validate if classifier == "naive_bayes" else experiments.cross_validate_svm
    found = stage(validate(rows, "article_id", "text", "label", "language", parameter, k), "predictions")
    report = stage(evaluate.cv_report(found, languages), "cv-report")
    write_csv(report.orderBy("position").drop("position"), result_path)
    if metrics_path:
        # The summary has six rows, which become columns beside the parameters of the run.
        summary = report.filter(F.col("position") >= len(languages)).select("row", "f1_mean").collect()
        cells = [F.lit(float(parameter)).alias("parameter"), F.lit(float(k)).alias("folds")]
        cells += [F.lit(r["f1_mean"]).cast("double").alias(r["row"].replace(".", "")) for r in summary]
        log_metrics(spark, metrics_path, f"{classifier}-{parameter}", spark.range(1).select(*cells))


@owns_staging
def run_cross_topics(
    spark: SparkSession,
    train_path: str,
    result_path: str,
    topics: dict[str, list[str]] | None = None,
) -> None:
    """Leave-one-topic-out table; ``topics`` defaults to the hold-out lists."""
    rows = read_experiment(spark, train_path)
    write_csv(experiments.cross_topics(rows, topics or HOLDOUT_TOPICS, "article_id"), result_path)


@owns_staging
def run_temporal_splits(
    spark: SparkSession,
    train_path: str,
    result_path: str,
    events: list[tuple[str, str]] = EVENTS,
) -> None:
    rows = read_experiment(spark, train_path)
    write_csv(experiments.temporal_splits(rows, "article_id", events=events), result_path)


@owns_staging
def run_cross_datasets(spark: SparkSession, paths: dict[str, str], result_path: str) -> None:
    """``paths`` names the train file of every dataset; ids only need to be unique per dataset."""
    union = None
    for name, path in paths.items():
        rows = read_experiment(spark, path).withColumn("dataset", F.lit(name))
        union = rows if union is None else union.unionByName(rows)
    rows = union.withColumn("article_id", F.concat_ws("/", "dataset", "article_id"))
    report = experiments.cross_datasets(stage(rows, "datasets"), list(paths), "article_id")
    write_csv(report, result_path)


@owns_staging
def analyse(spark: SparkSession, articles_path: str, result_path: str) -> list[str]:
    """Write every descriptive report as CSV below ``result_path``; returns their names."""
    raw = _read(spark, articles_path, ARTICLES, "Collect the articles first.")
    rows = raw.withColumn("debunk_date", parse_day_first(F.col("debunk_date")))
    # All reports read the same rows; CSV would be parsed once per report.
    rows = stage(rows, "articles")
    negative = rows.filter(F.col("class") == CLASSES[0])
    language, publisher, date = "article_language", "article_publisher", "debunk_date"
    columns = ["debunk_id", publisher, language]
    reports = {
        "classes": aggregate.value_counts(rows, "class"),
        "distinct": aggregate.distinct_counts(rows, columns),
        "cases": aggregate.cases_per_group(rows, "debunk_id", "class"),
        "lengths": aggregate.mean_lengths(rows, "article_text", "keywords"),
        "languages": aggregate.language_distribution(rows, language, "class", CLASSES),
        "language_quartiles": aggregate.language_quartiles(rows, language, "class", CLASSES),
        "support_share": aggregate.class_share(rows, language, "class", CLASSES[1]),
        "dates": aggregate.date_span(rows, date),
        "quarters": aggregate.fill_quarters(
            aggregate.quarter_class_pivot(rows, date, "class", CLASSES),
            aggregate.quarter_spine(rows, date),
        ),
        "publishers": aggregate.group_class_counts(rows, publisher, "class"),
        "top_publishers": topk.top_publishers(rows, publisher, "class"),
        "state_media": aggregate.publisher_share(rows, publisher, "class", CLASSES[0], "ria"),
        "top_keywords": topk.top_values(topk.explode_keywords(negative, "keywords"), "keyword", 50),
        "topic_languages": topk.topic_language_share(negative, "keywords", language),
        "language_keywords": topk.top_language_keywords(negative, "keywords", language),
        "leading_keywords": topk.leading_keywords_by_language(rows, "keywords", language),
    }
    for name in CLASSES:
        own = rows.filter(F.col("class") == name)
        reports[f"distinct_{name}"] = aggregate.distinct_counts(own, [publisher])
    dated = negative.filter(F.col(date).isNotNull())
    shown = topk.explode_keywords(dated, "keywords").select(capitalize(F.col("keyword")).alias("keyword"))
    shown = stage(shown, "keywords")
    reports["keywords"] = aggregate.value_counts(shown, "keyword")
    reports["distinct_keywords"] = aggregate.distinct_counts(shown, ["keyword"])
    reports["quarter_languages"] = aggregate.quarter_value_counts(negative, date, language)
    quarters = stage(aggregate.seen_quarters(rows, date), "quarters")
    for topic, words in TOPICS.items():
        shown = {word.capitalize(): name for word, name in words.items()}
        reports[f"quarters_{topic}"] = aggregate.quarter_keyword_pivot(
            negative, date, "keywords", shown, quarters
        )
    for name, report in reports.items():
        flat = [F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.DateType) else F.col(f"`{f.name}`") for f in report.schema]
        write_csv(report.select(*flat), f"{result_path}/{name}")
    return list(reports)
