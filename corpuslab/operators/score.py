"""Batch scoring with a pluggable classifier or with fitted term weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.scores import predicted_class
from corpuslab.functions.text import term_counts, word_tokens
from corpuslab.operators.joins import hot_key_lookup
from corpuslab.staging import stage

# Takes the texts of a batch and returns one row of class scores per text.
Scorer = Callable[[pd.Series], np.ndarray]


def batch_score(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    row_id: str,
    text: str,
    classes: tuple[int, ...] = (0, 1),
) -> DataFrame:
    """(id, scores, pred). The scorer is made once per partition and sees Arrow batches."""
    id_type = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            scores = np.asarray(scorer(batch[text]), dtype="float64")
            yield pd.DataFrame({row_id: batch[row_id], "scores": list(scores)})

    scored = df.select(row_id, text).mapInPandas(run, f"{row_id} {id_type}, scores array<double>")
    return scored.withColumn("pred", predicted_class(F.col("scores"), sorted(classes)))


def term_weights(
    df: DataFrame, text: str, label: str, classes: tuple[int, ...] = (0, 1)
) -> DataFrame:
    """(term, s0, s1, ...): smoothed log share of every term in each class of the labelled rows.

    The result is an ordinary table: it can be written, read and applied to other articles.
    """
    words = df.select(label, F.explode(word_tokens(F.col(text))).alias("term"))
    counts = stage(
        words.groupBy("term").agg(*[F.count_if(F.col(label) == c).alias(f"n{c}") for c in classes]),
        "term-counts",
    )
    # One row of totals.
    sums = counts.agg(F.count("*").alias("terms"), *[F.sum(f"n{c}").alias(f"n{c}") for c in classes])
    mass = sums.first()
    shares = [
        F.ln((F.col(f"n{c}") + 1) / F.lit(float((mass[f"n{c}"] or 0) + mass["terms"]))).alias(f"s{c}")
        for c in classes
    ]
    return counts.select("term", *shares)


def score_terms(
    df: DataFrame, weights: DataFrame, row_id: str, text: str, classes: tuple[int, ...] = (0, 1)
) -> DataFrame:
    """(id, scores, pred) by the summed weights of the words of each text.

    Unknown words weigh nothing, and a text without known words scores 0 for every class. Rows with
    a frequent word meet a broadcast of bounded length, see ``weighted_lookup``.
    """
    # Counted inside the row: no task holds the terms of many texts, and none are shuffled.
    words = df.select(row_id, F.explode(term_counts(F.col(text))).alias("t"))
    counted = stage(words.select(row_id, "t.term", "t.tf"), "term-counts")
    known = hot_key_lookup(counted, weights, "term")
    totals = known.groupBy(row_id).agg(
        *[F.sum(F.col("tf") * F.col(f"s{c}")).alias(f"s{c}") for c in classes]
    )
    scores = F.array(*[F.coalesce(f"s{c}", F.lit(0.0)) for c in classes]).alias("scores")
    scored = df.select(row_id).join(totals, row_id, "left").select(row_id, scores)
    return scored.withColumn("pred", predicted_class(F.col("scores"), sorted(classes)))
