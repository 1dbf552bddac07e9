"""Bag of words in long form, vocabularies and fixed-length encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.fixed_values import MAX_LENGTH
from corpuslab.functions.text import word_tokens
from corpuslab.operators.joins import weighted_lookup
from corpuslab.operators.ranking import global_rank
from corpuslab.staging import stage

PAD, UNKNOWN = 0, 1
FIRST_TERM = 2
# Numbers of terms are below 2 to the power of this, and places below 2 to that of the rest.
TOKEN_BITS = 40


def bow_counts(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, term, tf) of every text."""
    terms = df.select(row_id, F.explode(word_tokens(F.col(text))).alias("term"))
    return terms.groupBy(row_id, "term").agg(F.count("*").alias("tf"))


def counts_in_vocabulary(train: DataFrame, other: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, term, tf) of ``other`` for terms that occur in ``train``."""
    known = train.select(F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("term"))
    rows = stage(bow_counts(other, row_id, text), "term-rows")
    seen = known.groupBy("term").agg(F.lit(1).alias("_known"))
    weights = rows.groupBy("term").agg(F.count("*").alias("weight"))
    table = stage(weights.join(seen, "term", "left_semi"), "vocabulary")
    return weighted_lookup(rows, table, "term", "weight").select(row_id, "term", "tf")


def fit_vocabulary(df: DataFrame, text: str, size: int | None = None) -> DataFrame:
    """(term, n, token_id): terms numbered from 2 by falling frequency.

    ``size`` is the number of terms of a tokenizer with a fixed vocabulary; without it every term
    of the corpus gets a number.
    """
    terms = df.select(F.explode(word_tokens(F.col(text))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.col("term")]
    if size is not None:
        counts = counts.orderBy(*order).limit(size)
    ranked = global_rank(counts, order, "_rank")
    return ranked.select("term", "n", (F.col("_rank") + FIRST_TERM - 1).alias("token_id"))


def encode_fixed(
    df: DataFrame, row_id: str, text: str, vocabulary: DataFrame, length: int = MAX_LENGTH
) -> DataFrame:
    """(id, input_ids, attention_mask): the first ``length`` words as ids, padded to ``length``."""
    first = F.slice(word_tokens(F.col(text)), 1, length)
    documents = stage(df.select(row_id, first.alias("terms")), "first-terms")
    words = documents.select(row_id, F.posexplode("terms").alias("pos", "term"))
    # Frequencies of the whole texts bound the number of rows per term.
    found = weighted_lookup(words, stage(vocabulary, "vocabulary"), "term", "n", how="left")
    # A place and its token in one number, so that an entry of a list has 8 bytes in the shuffle.
    number = F.coalesce(F.col("token_id"), F.lit(UNKNOWN)).cast("long")
    token = F.shiftleft(F.col("pos").cast("long"), TOKEN_BITS).bitwiseOR(number).alias("token")
    # A text without words has one row that stands for no token.
    empty = documents.filter(F.size("terms") == 0).select(row_id, F.lit(None).cast("long").alias("token"))
    rows = found.select(row_id, token).unionByName(empty)
    # At most ``length`` entries per text.
    tokens = rows.groupBy(row_id).agg(F.array_sort(F.collect_list("token")).alias("t"))
    ids = F.transform("t", lambda token: token.bitwiseAND(F.lit(2**TOKEN_BITS - 1)))
    missing = F.lit(length) - F.size("t")
    return tokens.select(
        row_id,
        F.concat(ids, F.array_repeat(F.lit(PAD).cast("long"), missing)).alias("input_ids"),
        F.concat(
            F.array_repeat(F.lit(1), F.size("t")), F.array_repeat(F.lit(0), missing)
        ).alias("attention_mask"),
    )
