"""Dataset preparation and the experiments, from cleaned articles to result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.fixed_values import ALPHAS, COSTS, EVENTS, FOLDS, LANGUAGE_NAMES, MIN_WORDS, SEED
from corpuslab.functions.dates import parse_day_first
from corpuslab.operators import svm
from corpuslab.operators.evaluate import (
    experiment_report,
    fold_mean_std,
    fold_scores,
    with_average_row,
)
from corpuslab.operators.naive_bayes import (
    Model,
    best_parameters,
    fold_models,
    grid_search,
    predict,
)
from corpuslab.operators.prepare import (
    binarize,
    combine_title_text,
    drop_nulls,
    fill_nulls,
    has_min_words,
    keep_balanced_languages,
    map_codes,
)
from corpuslab.operators.splits import (
    rows_with_topic,
    stratified_folds,
    topics_of,
    train_test_split,
)
from corpuslab.session import literal_table
from corpuslab.staging import stage

COLUMNS = ["text", "label", "language", "keywords", "published_date"]


def prepare_articles(
    articles: DataFrame, row_id: str = "article_id", missing_as_negative: bool = False, **balance
) -> DataFrame:
    """Cleaned articles with ``split``; nulls are emptied first, then languages are balanced."""
    rows = articles if missing_as_negative else drop_nulls(articles, "class")
    strings = [c for c, t in rows.dtypes if t == "string"]
    filled = fill_nulls(rows, strings)
    text = combine_title_text(F.col("article_title"), F.col("article_text"))
    named = filled.select(
        row_id,
        text.alias("text"),
        binarize(F.col("class"), positive="disinformation").alias("label"),
        F.col("article_language").alias("language"),
        "keywords",
        "published_date",
    )
    # Only labels and languages are read to find the split; the texts are read with the result.
    clean = keep_balanced_languages(named, "language", "label", [1, 0], **balance)
    return train_test_split(clean, row_id, ["label", "language"])


def prepare_nested_news(
    news: DataFrame, row_id: str, names: dict[str, str] = LANGUAGE_NAMES, **balance
) -> DataFrame:
    """The nested collection as (id, text, label, language, split); ``real`` is label 0."""
    rows = drop_nulls(news, "ref_source", "label", "lang").filter(F.col("lang").isin(list(names)))
    flat = rows.withColumn("text", F.col("ref_source.text")).filter(
        has_min_words(F.col("text"), MIN_WORDS)
    )
    mapped = map_codes(flat, "lang", names, "language")
    named = mapped.select(
        row_id, "text", binarize(F.col("label"), negative="real").alias("label"), "language"
    )
    # The word count needs the texts, so the rows that pass are written before they are counted.
    long = stage(named, "long-enough")
    clean = keep_balanced_languages(long, "language", "label", [1, 0], **balance)
    return train_test_split(clean, row_id, ["label", "language"])


def prepare_flat_news(news: DataFrame, row_id: str, **balance) -> DataFrame:
    """The flat collection; its columns are renamed and its labels are 0/1 already."""
    named = news.withColumnsRenamed(
        {"article_text": "text", "class": "label", "article_language": "language"}
    ).select(row_id, "text", "label", "language")
    clean = keep_balanced_languages(named, "language", "label", [1, 0], **balance)
    return train_test_split(clean, row_id, ["label", "language"])


def cross_validate(
    df: DataFrame,
    row_id: str,
    text: str,
    label: str,
    language: str,
    alpha: float,
    k: int = FOLDS,
    strata: list[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Naive-Bayes predictions of every row by a model that has not seen its fold."""
    folds = stratified_folds(df, row_id, strata or [language], k, seed)
    rows = predict(folds, fold_models(k), row_id, text, label, language, [alpha])
    return rows.withColumn("fold", F.col("model").cast("int"))


def cross_validate_svm(
    df: DataFrame,
    row_id: str,
    text: str,
    label: str,
    language: str,
    cost: float,
    k: int = FOLDS,
    strata: list[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """SVM predictions of every row by a model that has not seen its fold; one fit for all folds."""
    folds = stratified_folds(df, row_id, strata or [language], k, seed)
    rows = svm.train_and_predict(folds, fold_models(k), row_id, text, label, language, [cost])
    return rows.withColumn("fold", F.col("model").cast("int"))


def main_experiment(
    df: DataFrame,
    row_id: str,
    text: str = "text",
    label: str = "label",
    language: str = "language",
    alphas: list[float] = ALPHAS,
    k: int = FOLDS,
    classifier: str = "naive_bayes",
    costs: list[float] = COSTS,
) -> tuple[DataFrame, DataFrame]:
    """(result table, best parameters): search on train/test, then k folds of the train part.

    ``classifier`` is ``naive_bayes`` with a search over ``alphas``, or ``linear_svm`` over ``costs``.
    """
    bayes = classifier == "naive_bayes"
    if not bayes and classifier != "linear_svm":
        raise ValueError(f"no classifier {classifier}")
    if bayes:
        searched = grid_search(df, row_id, text, label, language, "split", alphas)
    else:
        searched = svm.grid_search(df, row_id, text, label, language, "split", costs)
    best = stage(best_parameters(searched), "best")
    found = best.first()
    if found is None:
        raise ValueError("no parameter scored above 0")
    train = df.filter(F.col("split") == "train")
    validate = cross_validate if bayes else cross_validate_svm
    predictions = validate(train, row_id, text, label, language, found["alpha" if bayes else "cost"], k)
    scores = fold_scores(predictions, "fold", "language")
    return fold_mean_std(with_average_row(scores)), best


def _report(
    predictions: DataFrame, descriptions: dict[str, tuple[str, ...]], names: list[str]
) -> DataFrame:
    """One row per model with its description."""
    rows = [(model, *described) for model, described in descriptions.items()]
    dimension = literal_table(predictions.sparkSession, ["model", *names], rows)
    report = experiment_report(predictions, ["model"])
    return report.join(F.broadcast(dimension), "model").select(
        *names, "f1_avg", "f1_weighted", "f1_overall"
    )


def cross_topics(
    df: DataFrame,
    topics: dict[str, list[str]],
    row_id: str,
    text: str = "text",
    label: str = "label",
    language: str = "language",
    keywords: str = "keywords",
    alpha: float = 0.1,
) -> DataFrame:
    """Leave-one-topic-out results, and a random split of all rows with a topic."""
    rows = stage(rows_with_topic(df, keywords, topics), "with-topic")
    split = train_test_split(rows, row_id).withColumn("_topics", topics_of(F.col(keywords), topics))
    models, described = [], {}
    for topic in topics:
        others = [t for t in topics if t != topic]
        held = F.array_contains("_topics", topic)
        models.append(Model(topic, ~held, held))
        described[topic] = (", ".join(others), topic)
    models.append(Model("all", F.col("split") == "train", F.col("split") == "test"))
    described["all"] = (", ".join(topics), ", ".join(topics))
    predictions = predict(split, models, row_id, text, label, language, [alpha])
    return _report(predictions, described, ["train_topics", "test_topics"])


def temporal_splits(
    df: DataFrame,
    row_id: str,
    text: str = "text",
    label: str = "label",
    language: str = "language",
    date_text: str = "published_date",
    events: list[tuple[str, str]] = EVENTS,
    alpha: float = 0.1,
) -> DataFrame:
    """Results of training before and testing from the cut-off of every event."""
    dated = df.withColumn("_date", parse_day_first(F.col(date_text)))
    models, described = [], {}
    for event, cutoff in events:
        day = parse_day_first(F.lit(cutoff))
        models.append(Model(event, F.col("_date") < day, F.col("_date") >= day))
        described[event] = (event, f"<{cutoff}", f">={cutoff}")
    predictions = predict(dated, models, row_id, text, label, language, [alpha])
    return _report(predictions, described, ["event", "train_period", "test_period"])


def cross_datasets(
    df: DataFrame,
    datasets: list[str],
    row_id: str,
    text: str = "text",
    label: str = "label",
    language: str = "language",
    dataset: str = "dataset",
    alpha: float = 0.1,
) -> DataFrame:
    """Train on 90 % of every dataset and test on the remaining 10 % of each."""
    rows = df.filter(F.col(dataset).isin(datasets))
    parts = train_test_split(rows, row_id, [language, label], within=dataset)
    tests = F.col("split") == "test"
    models = [
        Model(name, (F.col(dataset) == name) & ~tests, tests) for name in datasets
    ]
    scored = predict(
        parts, models, row_id, text, label, language, [alpha], keep=[dataset], few_scored=True
    )
    rows = scored.withColumnsRenamed({"model": "train_dataset", dataset: "test_dataset"})
    return experiment_report(rows, ["train_dataset", "test_dataset"])
