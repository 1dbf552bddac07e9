"""Joins on keys of which a few may cover most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import casefold, keyword_list
from corpuslab.session import literal_table
from corpuslab.staging import stage

# A key is hot if it covers more than one part in SLICES of the rows, so there are fewer than
# SLICES hot keys whatever the data looks like.
SLICES = 1000


def weighted_lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    how: str = "inner",
    slices: int = SLICES,
) -> DataFrame:
    """Join ``left`` to a table with one row per key.

    ``right[weight]`` is the number of left rows of a key, or an upper bound of it. Rows of hot
    keys meet a broadcast of fewer than ``slices`` table rows and are not shuffled; no other key
    holds more than one part in ``slices`` of the rows, so the shuffled join is even. Both inputs
    are read twice and should be scans or staged tables.
    """
    whole = right.agg(F.sum(weight)).first()[0] or 0
    limit = whole / slices
    payload = [c for c in right.columns if c not in (key, weight)]
    hot = right.filter(F.col(weight) > limit).select(key, *payload)
    cold = right.filter(F.col(weight) <= limit).select(key, *payload)
    on_hot = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return on_hot.unionByName(rest.join(cold, key, how))


def pending_rows(base: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` whose key is not in ``done``; repeated keys are merged before the join."""
    return base.join(done.select(key).distinct(), key, "left_anti")


def topic_matches(
    df: DataFrame, key: str, keywords: str, topics: dict[str, list[str]]
) -> DataFrame:
    """(key, keyword, topic) for every listed keyword that belongs to a topic.

    The topic lists are literals of the caller, so the broadcast side is as long as was typed.
    """
    pairs = [(k, t) for t, ks in topics.items() for k in ks]
    dimension = literal_table(df.sparkSession, ["keyword", "topic"], pairs)
    words = df.filter(F.col(keywords).isNotNull()).select(
        key, F.explode(keyword_list(casefold(F.col(keywords)))).alias("keyword")
    )
    return words.join(F.broadcast(dimension), "keyword").select(key, "keyword", "topic")


def hot_key_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to a table with one row per key, where a key may cover any part of ``left``.

    The rows per key are counted first, with map-side merging, and stored with the looked-up
    columns, so every key of ``left`` is in the table and hot ones are known. Rows whose key is
    null are left out.
    """
    weights = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_weight"))
    table = stage(weights.join(right, key, "left"), "lookup")
    return weighted_lookup(left, table, key, "_weight")
