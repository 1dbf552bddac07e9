"""Cleaning: nulls, text assembly, labels, code maps and language balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.fixed_values import MIN_ARTICLES, MIN_WORDS, SHARE_THRESHOLD
from corpuslab.functions.text import space_tokens
from corpuslab.operators.aggregate import language_distribution
from corpuslab.session import literal_table
from corpuslab.staging import stage


def fill_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Empty strings instead of nulls in string columns."""
    return df.na.fill("", subset=columns)


def drop_nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def combine_title_text(title: Column, text: Column) -> Column:
    """Title, blank and text; the text alone if the title is empty."""
    return F.when(title != "", F.concat(title, F.lit(" "), text)).otherwise(text)


def binarize(
    value: Column,
    positive: str | None = None,
    negative: str | None = None,
    missing: int | None = None,
) -> Column:
    """1 for ``positive`` and 0 for the rest, or 0 for ``negative`` and 1 for the rest.

    A null value becomes ``missing``, which is null unless given.
    """
    if (positive is None) == (negative is None):
        raise ValueError("give either the positive or the negative value")
    hit = value == positive if positive is not None else value != negative
    return F.coalesce(hit.cast("int"), F.lit(missing).cast("int"))


def has_min_words(text: Column, more_than: int = MIN_WORDS) -> Column:
    return F.size(space_tokens(text)) > more_than


def map_codes(df: DataFrame, column: str, names: dict[str, str], to: str) -> DataFrame:
    """Add the name of a code from a literal table; null for an unknown code.

    The table is a literal of the caller, so the broadcast side has as many rows as were typed.
    """
    dimension = literal_table(df.sparkSession, ["_code", to], list(names.items()))
    return df.join(F.broadcast(dimension), df[column] == dimension["_code"], "left").drop("_code")


def balanced_language_table(
    df: DataFrame,
    language: str,
    label: str,
    classes: list,
    threshold: float = SHARE_THRESHOLD,
    min_articles: int = MIN_ARTICLES,
) -> DataFrame:
    """Languages whose share of ``classes[0]`` lies strictly inside the bounds, with their counts."""
    table = language_distribution(df, language, label, classes)
    share = F.try_divide(F.col(str(classes[0])).cast("double"), F.col("total"))
    return table.filter(
        (share < threshold) & (share > 1 - threshold) & (F.col("total") > min_articles)
    )


def keep_balanced_languages(
    df: DataFrame,
    language: str,
    label: str,
    classes: list,
    threshold: float = SHARE_THRESHOLD,
    min_articles: int = MIN_ARTICLES,
) -> DataFrame:
    """Rows of the balanced languages.

    The selected languages are staged first: a list below the broadcast threshold filters the
    articles without shuffling them, and a longer one falls back to a shuffled semi join.
    """
    selected = balanced_language_table(df, language, label, classes, threshold, min_articles)
    kept = df.join(stage(selected.select(language), "languages"), language, "left_semi")
    return kept.select(df.columns)


def with_stable_ids(df: DataFrame, columns: list[str], name: str = "article_id") -> DataFrame:
    """Add ids that follow from the content: a hash of the columns and the number of the occurrence.

    Rows that agree in the columns are numbered from 1. How the rows are dealt over files and
    partitions does not change the set of ids of a content. Occurrences are counted per partition
    first, so that copies which are a large part of the table do not meet in one task.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    sizes = [F.length(c).cast("string") for c in cells]
    content = F.md5(F.concat_ws("|", *sizes, *cells))
    rows = stage(df.withColumns({"_content": content, "_part": F.spark_partition_id()}), "contents")
    counts = rows.groupBy("_content", "_part").agg(F.count("*").alias("_n"))
    # One row per partition for every content.
    earlier = Window.partitionBy("_content").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_content", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_content", "_part").orderBy("_content")
    numbered = rows.withColumn("_number", F.row_number().over(inside)).join(before, ["_content", "_part"])
    number = (F.col("_number") + F.col("_before")).cast("string")
    return numbered.select(F.concat("_content", F.lit("-"), number).alias(name), *df.columns)
