"""Frequency rankings: global, per group, and with a remainder bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import keyword_list, ratio
from corpuslab.staging import stage


def explode_keywords(df: DataFrame, keywords: str, *keep: str) -> DataFrame:
    """One row per listed keyword; rows without a list are dropped."""
    rows = df.filter(F.col(keywords).isNotNull())
    return rows.select(*keep, F.explode(keyword_list(F.col(keywords))).alias("keyword"))


def _keyword_counts(df: DataFrame, keywords: str, language: str) -> DataFrame:
    """(keyword, language, n) over all listed keywords."""
    pairs = explode_keywords(df, keywords, language).groupBy("keyword", language)
    return pairs.agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; ties go to the smaller value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def top_per_group(counts: DataFrame, group: str, value: str, n: str, k: int) -> DataFrame:
    """The ``k`` largest rows of every group with their rank.

    ``counts`` is already aggregated, and the rank filter is applied to each partition before the
    shuffle, so at most ``k`` rows per group and partition are moved.
    """
    order = Window.partitionBy(group).orderBy(F.desc(n), value)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_publishers(df: DataFrame, publisher: str, label: str, k: int = 25) -> DataFrame:
    """Most frequent publishers of every class."""
    counts = df.na.drop(subset=[publisher, label]).groupBy(label, publisher).agg(
        F.count("*").alias("n")
    )
    return top_per_group(counts, label, publisher, "n", k)


def topic_language_share(
    df: DataFrame, keywords: str, language: str, topics: int = 15, languages: int = 5
) -> DataFrame:
    """Share of languages within the most frequent topics; later languages become ``Others``."""
    # Written once: the ranking of topics, their totals and the shares all read these counts.
    pairs = stage(_keyword_counts(df, keywords, language), "keyword-counts")
    leading = (
        pairs.groupBy("keyword")
        .agg(F.sum("n").alias("_n"))
        .orderBy(F.desc("_n"), "keyword")
        .limit(topics)
        .select("keyword")
    )
    # The broadcast side has at most ``topics`` rows.
    kept = pairs.filter(F.col(language).isNotNull()).join(
        F.broadcast(leading), "keyword", "left_semi"
    )
    totals = kept.groupBy("keyword").agg(F.sum("n").alias("total"))
    ranked = top_per_group(kept, "keyword", language, "n", languages).drop("rank")
    named = ranked.select("keyword", language, "n")
    rest = (
        totals.join(ranked.groupBy("keyword").agg(F.sum("n").alias("_top")), "keyword")
        .filter(F.col("total") > F.col("_top"))
        .select("keyword", F.lit("Others").alias(language), (F.col("total") - F.col("_top")).alias("n"))
    )
    return named.unionByName(rest).join(totals, "keyword").select(
        "keyword", language, "n", ratio(F.col("n"), F.col("total")).alias("share")
    )


def top_language_keywords(
    df: DataFrame, keywords: str, language: str, n_keywords: int = 8, n_languages: int = 9
) -> DataFrame:
    """Counts of the leading keywords in the leading languages and their percentage per language."""
    pairs = stage(_keyword_counts(df, keywords, language), "keyword-counts")
    leading_keywords = (
        pairs.groupBy("keyword")
        .agg(F.sum("n").alias("_n"))
        .orderBy(F.desc("_n"), "keyword")
        .limit(n_keywords)
        .select("keyword")
    )
    leading_languages = top_values(df, language, n_languages).select(language)
    # Both broadcast sides are as long as the requested lists.
    counts = pairs.join(F.broadcast(leading_keywords), "keyword", "left_semi").join(
        F.broadcast(leading_languages), language, "left_semi"
    )
    # At most n_keywords rows per language reach this join.
    whole = counts.groupBy(language).agg(F.sum("n").alias("_all"))
    return counts.join(whole, language).select(
        language, "keyword", "n", (ratio(F.col("n"), F.col("_all")) * 100).alias("percent")
    )


def leading_keywords_by_language(
    df: DataFrame, keywords: str, language: str, n_languages: int = 15, k: int = 3
) -> DataFrame:
    """The first ``k`` keywords of the leading languages as columns ``top1`` and so on."""
    leading = top_values(df, language, n_languages).select(language)
    counts = _keyword_counts(df, keywords, language).join(
        F.broadcast(leading), language, "left_semi"
    )
    ranked = top_per_group(counts, language, "keyword", "n", k)
    return ranked.groupBy(language).agg(
        *[
            F.max(F.when(F.col("rank") == i, F.col("keyword"))).alias(f"top{i}")
            for i in range(1, k + 1)
        ]
    )
