"""Exact, seeded train/test splits and folds.

Rows of a stratum are put in the order of ``md5(seed, id)``. A split is a set of cut keys per
stratum, found from bucket counts; applying it compares each row's key with the cuts of its
stratum, so the articles themselves are neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.fixed_values import FOLDS, SEED
from corpuslab.functions.dates import parse_day_first
from corpuslab.functions.text import casefold, keyword_list
from corpuslab.operators.ranking import bucket_counts, keys_at, order_key
from corpuslab.staging import stage


# Unit separator, so that no two different combinations of values give the same text.
SEPARATOR = "\x1f"


def stratum_key(strata: list[str]) -> Column:
    """The values of the stratum columns as one text; null counts as an empty value."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata]
    return F.concat_ws(SEPARATOR, *values) if values else F.lit("")


def _assign(
    df: DataFrame,
    row_id: str,
    strata: list[str],
    seed: int,
    slot: str,
    targets: Callable[[DataFrame], DataFrame],
    within: list[str],
) -> DataFrame:
    """Add the slot whose range of positions holds the row."""
    stratum, key = stratum_key([*within, *strata]), order_key(F.col(row_id), seed)
    keys = df.select(
        stratum_key(within).alias("part"), stratum.alias("stratum"), key.alias("key")
    )
    counts = bucket_counts(keys)
    sizes = counts.groupBy("part", "stratum").agg(F.sum("n").alias("c"))
    ends = keys_at(keys, counts, targets(sizes))
    cuts = ends.groupBy("stratum").agg(
        F.array_sort(F.collect_list(F.struct("key", "slot"))).alias("_cuts")
    )
    # One row per stratum, each with at most one cut per slot.
    cuts = stage(cuts.withColumnRenamed("stratum", "_stratum"), "cuts")
    keyed = df.withColumn("_key", key)
    if within or strata:
        cut = keyed.withColumn("_stratum", stratum).join(cuts, "_stratum")
        found = F.get(F.filter("_cuts", lambda c: c["key"] >= F.col("_key")), F.lit(0))["slot"]
    else:
        # Without strata there is one row of cuts, and it becomes a part of the expression.
        cut, one = keyed, cuts.first()
        found = F.lit(None).cast(cuts.schema["_cuts"].dataType.elementType["slot"].dataType)
        for last, name in reversed(one["_cuts"] if one else []):
            found = F.when(F.col("_key") <= last, F.lit(name)).otherwise(found)
    return cut.withColumn(slot, found).drop("_stratum", "_key", "_cuts")


def _train_targets(test_share: float) -> Callable[[DataFrame], DataFrame]:
    """Last train and last test position per stratum, by largest remainder."""

    def targets(sizes: DataFrame) -> DataFrame:
        # These windows run over one row per stratum.
        everything = Window.partitionBy("part")
        n = F.sum("c").over(everything)
        n_train = n - F.ceil(n * F.lit(test_share)).cast("long")
        counted = sizes.select("part", "stratum", "c", n.alias("n"), n_train.alias("n_train"))
        quota = counted.select(
            "part",
            "stratum",
            "c",
            "n_train",
            # The product of two row counts does not fit a long on a large corpus.
            F.expr("cast(c as decimal(19, 0)) * n_train div n").alias("base"),
            F.expr("cast(c as decimal(19, 0)) * n_train % n").alias("remainder"),
        )
        extra = F.col("n_train") - F.sum("base").over(everything)
        order = F.row_number().over(everything.orderBy(F.desc("remainder"), "stratum"))
        filled = quota.select(
            "stratum", "c", (F.col("base") + (order <= extra).cast("int")).alias("train")
        )
        slots = F.array(
            F.struct(F.lit("train").alias("slot"), F.col("train").alias("position")),
            F.struct(F.lit("test").alias("slot"), F.col("c").alias("position")),
        )
        rows = filled.select("stratum", "c", "train", F.explode(slots).alias("s"))
        wanted = rows.select("stratum", "c", "train", "s.slot", "s.position")
        used = (F.col("slot") == "train") & (F.col("train") > 0)
        used = used | ((F.col("slot") == "test") & (F.col("train") < F.col("c")))
        return wanted.filter(used).select("stratum", "slot", "position")

    return targets


def train_test_split(
    df: DataFrame,
    row_id: str,
    strata: list[str] | None = None,
    test_share: float = 0.1,
    seed: int = SEED,
    within: str | None = None,
) -> DataFrame:
    """Add ``split`` with exactly ``ceil(n * test_share)`` test rows.

    With ``strata`` every stratum gets its proportional share by largest remainder. With
    ``within`` every value of that column is split on its own. ``row_id`` must be unique.
    """
    parts = [within] if within else []
    targets = _train_targets(test_share)
    return _assign(df, row_id, strata or [], seed, "split", targets, parts)


def _fold_targets(k: int) -> Callable[[DataFrame], DataFrame]:
    """Last position of every fold per stratum; spare rows go round the folds."""

    def targets(sizes: DataFrame) -> DataFrame:
        # One row per stratum: the running count that decides which fold a stratum starts with.
        before = Window.partitionBy("part").orderBy("stratum")
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        shifted = sizes.withColumn("shift", F.coalesce(F.sum("c").over(before), F.lit(0)) % k)
        folds = shifted.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        spare = F.pmod(F.col("slot") - F.col("shift"), F.lit(k)) < F.col("c") % k
        size = F.expr(f"c div {k}") + spare.cast("int")
        running = Window.partitionBy("stratum").orderBy("slot")
        filled = folds.withColumn("size", size).withColumn("position", F.sum("size").over(running))
        return filled.filter(F.col("size") > 0).select("stratum", "slot", "position")

    return targets


def stratified_folds(
    df: DataFrame, row_id: str, strata: list[str], k: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` from 0 to ``k - 1``; folds differ by at most one row, in total and per stratum."""
    return _assign(df, row_id, strata, seed, "fold", _fold_targets(k), [])


def temporal_split(
    df: DataFrame, date_text: str, events: list[tuple[str, str]]
) -> DataFrame:
    """Rows before and from the cut-off of every event, as (row, event, split).

    A row without a date is on neither side. The events are literals of the caller and are applied
    in one pass.
    """
    published = parse_day_first(F.col(date_text))
    named = F.array(
        *[
            F.struct(
                F.lit(name).alias("event"), parse_day_first(F.lit(cutoff)).alias("cutoff")
            )
            for name, cutoff in events
        ]
    )
    rows = df.withColumn("_date", published).filter(F.col("_date").isNotNull())
    return (
        rows.withColumn("_event", F.explode(named))
        .withColumn("event", F.col("_event.event"))
        .withColumn(
            "split", F.when(F.col("_date") < F.col("_event.cutoff"), "train").otherwise("test")
        )
        .drop("_date", "_event")
    )


def topics_of(keywords: Column, topics: dict[str, list[str]]) -> Column:
    """Topics with at least one of the listed keywords, as an array; found inside the row."""
    words = keyword_list(casefold(keywords))
    hits = [
        F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws])), F.lit(topic))
        for topic, ws in topics.items()
    ]
    return F.array_compact(F.array(*hits))


def topic_holdout(
    df: DataFrame, keywords: str, topics: dict[str, list[str]]
) -> DataFrame:
    """Leave-one-topic-out parts as (row, held_out, split).

    Test rows have the held-out topic. Train rows have another topic and not the held-out one, so a
    row with both is in the test part only.
    """
    rows = df.filter(F.col(keywords).isNotNull()).withColumn(
        "_topics", topics_of(F.col(keywords), topics)
    )
    held = F.explode(F.array(*[F.lit(t) for t in topics]))
    return (
        rows.filter(F.size("_topics") > 0)
        .withColumn("held_out", held)
        .withColumn(
            "split",
            F.when(F.array_contains("_topics", F.col("held_out")), "test").otherwise("train"),
        )
        .drop("_topics")
    )


def rows_with_topic(df: DataFrame, keywords: str, topics: dict[str, list[str]]) -> DataFrame:
    """Rows with a keyword of any topic, each once."""
    hits = F.size(topics_of(F.col(keywords), topics)) > 0
    return df.filter(F.col(keywords).isNotNull() & hits)
