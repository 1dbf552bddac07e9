"""Metrics of predictions, always from counts per (label, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import ratio
from corpuslab.session import literal_table
from corpuslab.staging import stage


COUNT = "_pairs"


def pair_counts(
    predictions: DataFrame, keys: list[str], label: str = "label", pred: str = "pred"
) -> DataFrame:
    """Predictions merged to one row per (keys, label, prediction) with a count.

    Every metric accepts the result in place of the predictions. It is staged, because a report
    reads it several times and the predictions behind it should be made once.
    """
    return stage(predictions.groupBy(*keys, label, pred).agg(_rows(predictions).alias(COUNT)), "pairs")


def _rows(predictions: DataFrame) -> Column:
    """Number of predictions in a group, for single and for merged rows."""
    return F.sum(COUNT) if COUNT in predictions.columns else F.count("*")


def _rows_if(predictions: DataFrame, condition: Column) -> Column:
    if COUNT in predictions.columns:
        return F.sum(F.when(condition, F.col(COUNT)).otherwise(0))
    return F.count_if(condition)


def confusion_counts(
    predictions: DataFrame, keys: list[str], label: str = "label", pred: str = "pred"
) -> DataFrame:
    """(keys, class, tp, support, predicted) for classes that occur as label or prediction."""
    pairs = predictions.groupBy(*keys, label, pred).agg(_rows(predictions).alias("_n"))
    n, none = F.col("_n"), F.lit(0).cast("long")
    hit = F.when(F.col(label) == F.col(pred), n).otherwise(none)
    sides = F.array(
        F.struct(F.col(label).alias("class"), hit.alias("tp"), n.alias("support"), none.alias("predicted")),
        F.struct(F.col(pred).alias("class"), none.alias("tp"), none.alias("support"), n.alias("predicted")),
    )
    rows = pairs.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    return rows.groupBy(*keys, "class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )


def macro_f1(
    predictions: DataFrame, keys: list[str], label: str = "label", pred: str = "pred"
) -> DataFrame:
    """(keys, f1, n): unweighted mean of F1 over the classes present in a group."""
    counts = confusion_counts(predictions, keys, label, pred)
    f1 = 2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))
    return counts.groupBy(*keys).agg(F.avg(f1).alias("f1"), F.sum("support").alias("n"))


def language_average(by_language: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f1_avg, f1_weighted): plain and support-weighted mean over languages."""
    weighted = ratio(F.sum(F.col("f1") * F.col("n")), F.sum("n"))
    return by_language.groupBy(*keys).agg(
        F.avg("f1").alias("f1_avg"), weighted.alias("f1_weighted")
    )


def precision_recall(
    predictions: DataFrame,
    keys: list[str],
    classes: tuple[int, ...] = (0, 1),
    label: str = "label",
    pred: str = "pred",
) -> DataFrame:
    """Precision and recall of every class as columns; 0 where undefined."""

    def share(side: Column, value: int) -> Column:
        hits = _rows_if(predictions, (F.col(label) == value) & (F.col(pred) == value))
        return F.coalesce(ratio(hits, _rows_if(predictions, side == value)), F.lit(0.0))

    return predictions.groupBy(*keys).agg(
        *[share(F.col(pred), c).alias(f"precision_{c}") for c in classes],
        *[share(F.col(label), c).alias(f"recall_{c}") for c in classes],
    )


def experiment_report(
    predictions: DataFrame, keys: list[str], language: str = "language"
) -> DataFrame:
    """(keys, f1_avg, f1_weighted, f1_overall): one row per experiment."""
    pairs = pair_counts(predictions, [*keys, language])
    averages = language_average(macro_f1(pairs, [*keys, language]), keys)
    overall = macro_f1(pairs, keys).select(*keys, F.col("f1").alias("f1_overall"))
    return averages.join(overall, keys)


def fold_scores(predictions: DataFrame, fold: str = "fold", language: str = "language") -> DataFrame:
    """(fold, language, f1, weight): one row per fold and language, staged."""
    scores = stage(macro_f1(predictions, [fold, language]), "fold-scores")
    sizes = scores.groupBy(fold).agg(F.sum("n").alias("_all"))
    return scores.join(sizes, fold).select(
        fold, language, "f1", ratio(F.col("n"), F.col("_all")).alias("weight")
    )


def with_average_row(scores: DataFrame, fold: str = "fold", language: str = "language") -> DataFrame:
    """Add the plain mean over languages of every fold as the language ``Average``."""
    mean = scores.groupBy(fold).agg(F.avg("f1").alias("f1"))
    return scores.select(fold, language, "f1").unionByName(
        mean.select(fold, F.lit("Average").alias(language), "f1")
    )


def folds_as_columns(scores: DataFrame, folds: list, fold: str = "fold", language: str = "language") -> DataFrame:
    """One row per language, one column per fold."""
    return scores.groupBy(language).agg(
        *[F.max(F.when(F.col(fold) == f, F.col("f1"))).alias(f"fold_{f}") for f in folds]
    )


def stack_folds(wide: DataFrame, language: str = "language") -> DataFrame:
    """The reverse of :func:`folds_as_columns`; empty cells are dropped."""
    columns = [c for c in wide.columns if c != language]
    return wide.unpivot(language, columns, "fold", "f1").filter(F.col("f1").isNotNull())


def fold_mean_std(scores: DataFrame, language: str = "language") -> DataFrame:
    """(language, f1_mean, f1_std) across folds, with the sample deviation."""
    return scores.groupBy(language).agg(
        F.avg("f1").alias("f1_mean"), F.stddev_samp("f1").alias("f1_std")
    )


def in_given_order(table: DataFrame, names: list[str], column: str, value: str) -> DataFrame:
    """(position, column, ...): the named rows of a report in the given order.

    A name without a row is an error, raised when the report is read.
    """
    order = literal_table(table.sparkSession, ["position", column], list(enumerate(names)))
    message = F.concat(F.lit(f"no row for {column} "), F.col(column))
    checked = F.when(F.col(value).isNotNull(), F.col(value)).otherwise(
        F.raise_error(message).cast("double")
    )
    return order.join(table, column, "left").withColumn(value, checked).orderBy("position")


def cv_report(
    predictions: DataFrame,
    languages: list[str],
    fold: str = "fold",
    language: str = "language",
) -> DataFrame:
    """(position, row, f1_mean, f1_std, weight): languages in the given order, then summary rows.

    A language without predictions is an error.
    """
    pairs = pair_counts(predictions, [fold, language])
    means = (
        fold_scores(pairs, fold, language)
        .groupBy(language)
        .agg(
            F.avg("f1").alias("f1_mean"),
            F.stddev_samp("f1").alias("f1_std"),
            F.avg("weight").alias("weight"),
        )
    )
    rows = in_given_order(means, languages, language, "f1_mean").select(
        "position", F.col(language).alias("row"), "f1_mean", "f1_std", "weight"
    )
    # Read by the summary and by the report itself.
    rows = stage(rows, "language-rows")
    base = len(languages)
    summary = rows.agg(
        F.sum(F.col("f1_mean") * F.col("weight")).alias("Weighted F1"),
        F.avg("f1_mean").alias("Avg. F1"),
    )
    quality = precision_recall(pairs, []).select(
        F.col("precision_0").alias("Precision Negative"),
        F.col("precision_1").alias("Precision Positive"),
        F.col("recall_0").alias("Recall Negative"),
        F.col("recall_1").alias("Recall Positive"),
    )

    def as_rows(one_row: DataFrame, start: int) -> DataFrame:
        cells = [
            F.struct(F.lit(start + i).alias("position"), F.lit(c).alias("row"), F.col(f"`{c}`").alias("f1_mean"))
            for i, c in enumerate(one_row.columns)
        ]
        return one_row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")

    tail = as_rows(summary, base).unionByName(as_rows(quality, base + 2))
    return rows.unionByName(tail, allowMissingColumns=True).orderBy("position")


def relative_drop(
    grid: DataFrame, train: str = "train", test: str = "test", score: str = "f1"
) -> DataFrame:
    """Percent by which a score falls short of training on the test set's own data."""
    own = grid.filter(F.col(train) == F.col(test)).select(test, F.col(score).alias("baseline"))
    pairs = grid.filter(F.col(train) != F.col(test)).join(own, test)
    drop = F.try_divide((F.col("baseline") - F.col(score)) * 100, F.col("baseline"))
    return pairs.select(train, test, score, "baseline", drop.alias("drop_percent"))
