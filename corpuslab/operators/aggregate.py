"""Counts, shares and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.dates import quarter_starts, whole_months, year_quarter
from corpuslab.functions.text import capitalize, keyword_list, ratio


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value without nulls, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def quarter_value_counts(df: DataFrame, date: str, column: str) -> DataFrame:
    """(quarter, value, n): rows per quarter and value, without nulls, most frequent first."""
    rows = df.filter(F.col(date).isNotNull() & F.col(column).isNotNull())
    counts = rows.groupBy(year_quarter(F.col(date)).alias("quarter"), column).agg(F.count("*").alias("n"))
    return counts.orderBy("quarter", F.desc("n"), column)


def distinct_counts(df: DataFrame, columns: list[str], count_null: bool = False) -> DataFrame:
    """(column, n): the exact number of different values per column, from one pass.

    Values are de-duplicated in every partition before they are shuffled. With ``count_null`` null
    counts as one value.
    """
    values = [F.count_distinct(c) for c in columns]
    if count_null:
        values = [v + F.max(F.col(c).isNull().cast("long")) for v, c in zip(values, columns)]
    counts = df.agg(*[v.alias(c) for v, c in zip(values, columns)])
    return counts.unpivot([], columns, "column", "n")


def cases_per_group(df: DataFrame, group: str, label: str) -> DataFrame:
    """Smallest, largest and mean number of rows per (group, class), by class."""
    pairs = df.na.drop(subset=[group, label]).groupBy(group, label).agg(F.count("*").alias("n"))
    return pairs.groupBy(label).agg(
        F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n")
    )


def mean_lengths(df: DataFrame, text: str, keywords: str) -> DataFrame:
    """Mean number of characters and of listed keywords; nulls are left out."""
    return df.agg(
        F.avg(F.length(text)).alias("mean_chars"),
        F.avg(F.when(F.col(keywords).isNotNull(), F.size(F.split(keywords, ",")))).alias(
            "mean_keywords"
        ),
    )


def _class_counts(label: str, classes: list) -> list[Column]:
    return [F.count_if(F.col(label) == c).alias(str(c)) for c in classes]


def language_distribution(df: DataFrame, language: str, label: str, classes: list) -> DataFrame:
    """Rows per language, in total and per class; columns are named by class value."""
    table = df.groupBy(language).agg(F.count(label).alias("total"), *_class_counts(label, classes))
    return table.orderBy(F.desc("total"), language)


def dense_language_class(df: DataFrame, language: str, label: str, classes: list) -> DataFrame:
    """One row per language and class, 0 where the pair does not occur.

    The zeros come from counting every class in the same aggregate, so no grid is joined.
    """
    wide = df.filter(F.col(language).isNotNull()).groupBy(language).agg(*_class_counts(label, classes))
    return wide.unpivot(language, [str(c) for c in classes], label, "n")


def language_quartiles(df: DataFrame, language: str, label: str, classes: list) -> DataFrame:
    """Quartiles of the number of rows per language, with linear interpolation."""
    totals = df.groupBy(language).agg(F.count(label).alias("total"))
    # Equal totals are merged, so the percentile buffer holds different totals only.
    frequencies = totals.groupBy("total").agg(F.count("*").alias("times"))
    quartiles = F.percentile("total", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("times"))
    return frequencies.agg(quartiles.alias("q")).select(
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")
    )


def class_share(df: DataFrame, language: str, label: str, value) -> DataFrame:
    """Share of one class per language; null where the class does not occur."""
    hits = F.count_if(F.col(label) == value)
    shares = df.filter(F.col(language).isNotNull()).groupBy(language).agg(
        F.when(hits > 0, ratio(hits, F.count("*"))).alias("share")
    )
    return shares.orderBy(F.desc_nulls_last("share"), language)


def date_span(df: DataFrame, date: str) -> DataFrame:
    """First and last date and the calendar period between them."""
    ends = df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    months = whole_months(F.col("first_date"), F.col("last_date"))
    return ends.withColumn("_m", months).select(
        "first_date",
        "last_date",
        F.expr("_m div 12").cast("int").alias("years"),
        (F.col("_m") % 12).alias("months"),
        F.datediff("last_date", F.add_months("first_date", F.col("_m"))).alias("days"),
    )


def quarter_class_pivot(df: DataFrame, date: str, label: str, classes: list[str]) -> DataFrame:
    """Rows per quarter, one column per class, 0 where a class is absent."""
    rows = df.filter(F.col(date).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(year_quarter(F.col(date)).alias("year_quarter")).agg(
        *_class_counts(label, classes)
    )


def quarter_spine(df: DataFrame, date: str, include_partial: bool = False) -> DataFrame:
    """Every quarter between the first and the last date as a label."""
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = ends.select(
        F.explode(quarter_starts(F.col("a"), F.col("b"), include_partial)).alias("day")
    )
    return days.select(year_quarter(F.col("day")).alias("year_quarter"))


def seen_quarters(df: DataFrame, date: str) -> DataFrame:
    """Quarters that occur, without the last one, which is taken to be unfinished.

    The window runs over the different quarters, of which a calendar has four a year.
    """
    quarters = (
        df.filter(F.col(date).isNotNull())
        .select(year_quarter(F.col(date)).alias("year_quarter"))
        .distinct()
    )
    last = F.max("year_quarter").over(Window.partitionBy())
    return quarters.withColumn("_last", last).filter("year_quarter < _last").drop("_last")


def fill_quarters(counts: DataFrame, spine: DataFrame) -> DataFrame:
    """Counts on every quarter of the spine, 0 where a quarter has no row."""
    columns = [c for c in counts.columns if c != "year_quarter"]
    return spine.join(counts, "year_quarter", "left").na.fill(0, subset=columns)


def quarter_keyword_pivot(
    df: DataFrame, date: str, keywords: str, shown: dict[str, str], spine: DataFrame
) -> DataFrame:
    """Rows per quarter and keyword of a topic, dense over the quarters of ``spine``.

    ``shown`` maps a capitalised keyword to its column name; several keywords may share a column.
    """
    words = df.na.drop(subset=[keywords, date]).select(
        year_quarter(F.col(date)).alias("year_quarter"),
        F.explode(F.transform(keyword_list(F.col(keywords)), capitalize)).alias("keyword"),
    )
    columns: dict[str, list[str]] = {}
    for keyword, name in shown.items():
        columns.setdefault(name, []).append(keyword)
    counts = words.filter(F.col("keyword").isin(list(shown))).groupBy("year_quarter").agg(
        *[F.count_if(F.col("keyword").isin(ks)).alias(name) for name, ks in columns.items()]
    )
    return fill_quarters(counts, spine)


def group_class_counts(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows per (group, class) without nulls."""
    return df.na.drop(subset=[group, label]).groupBy(group, label).agg(F.count("*").alias("n"))


def publisher_share(
    df: DataFrame, publisher: str, label: str, value: str, pattern: str
) -> DataFrame:
    """Rows of one class, those whose publisher matches a pattern, and their share."""
    rows = df.filter((F.col(label) == value) & F.col(publisher).isNotNull())
    hits = F.count_if(F.col(publisher).rlike(pattern))
    return rows.agg(
        hits.alias("matching"), F.count("*").alias("total"), ratio(hits, F.count("*")).alias("share")
    )


def group_support_share(df: DataFrame, group: str) -> DataFrame:
    """Rows per group and their share of all rows."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n"))
    return counts.withColumn("weight", ratio(F.col("n"), whole.scalar()))
