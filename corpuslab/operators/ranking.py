"""Exact positions in a total order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.staging import stage

# Leading hex digits of the order key that name a bucket: 4096 buckets per stratum.
PREFIX = 3


def order_key(row_id: Column, seed: int) -> Column:
    """Seeded pseudo-random order of rows: the md5 of the seed and the row's unique id."""
    return F.md5(F.concat(F.lit(f"{seed}|"), row_id.cast("string")))


def bucket_of(key: Column) -> Column:
    return F.substring(key, 1, PREFIX)


def bucket_counts(keys: DataFrame) -> DataFrame:
    """Rows per stratum and bucket of a (part, stratum, key) table, staged."""
    counts = keys.groupBy("part", "stratum", bucket_of(F.col("key")).alias("bucket")).agg(
        F.count("*").alias("n")
    )
    return stage(counts, "bucket-counts")


def keys_at(keys: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """The key at given positions of every stratum.

    ``targets`` is (stratum, slot, position) with positions from 1; the result is
    (stratum, slot, key). Bucket counts tell in which bucket a position lies, and only the rows of
    those buckets are ranked, so one task ranks about 1/4096 of a stratum.
    """
    running = Window.partitionBy("stratum").orderBy("bucket")
    starts = counts.withColumn("_start", F.sum("n").over(running) - F.col("n"))
    # One row per stratum with its few positions.
    wanted = targets.groupBy("stratum").agg(F.collect_list(F.struct("slot", "position")).alias("_t"))

    def inside(target: Column) -> Column:
        place = target["position"] - F.col("_start")
        return (place >= 1) & (place <= F.col("n"))

    located = (
        starts.join(wanted, "stratum")
        .select("stratum", "bucket", "_start", F.explode(F.filter("_t", inside)).alias("t"))
        .select("stratum", "bucket", "t.slot", (F.col("t.position") - F.col("_start")).alias("rank"))
    )
    located = stage(located, "located")
    bucketed = keys.select("stratum", "key", bucket_of(F.col("key")).alias("bucket"))
    candidates = bucketed.join(
        located.select("stratum", "bucket").distinct(), ["stratum", "bucket"], "left_semi"
    )
    order = Window.partitionBy("stratum", "bucket").orderBy("key")
    ranked = candidates.withColumn("rank", F.row_number().over(order))
    hits = ranked.join(located, ["stratum", "bucket", "rank"])
    return hits.select("stratum", "slot", "key")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the position of every row (from 1) in a total order over the whole table.

    The rows are range-partitioned and sorted, staged with their partition and local position, and
    shifted by the sizes of the earlier partitions, of which there are as many as shuffle
    partitions. No window runs over the whole table.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mono", 33))
        .withColumn("_local", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_mono")
    )
    staged = stage(local, "ranked")
    sizes = staged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")
    )
    # One row per shuffle partition is broadcast.
    return (
        staged.join(F.broadcast(shifts), "_part")
        .withColumn(name, (F.col("_local") + F.col("_shift")).cast("long"))
        .drop("_part", "_local", "_shift")
    )
