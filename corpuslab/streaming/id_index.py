"""The ids of a table that grows by batches, so that a batch reads few of them.

Ids are written once more, dealt by a hash into bucket folders. Every bucket has a Bloom filter,
kept as rows (bucket, word, bits) of its 64-bit words that are not zero; a batch writes the filters
of all ids up to it. An id of which one bit is missing is new for certain. Only the buckets of the
others are read, and only their ids meet a join. A filter that fills up costs reads, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.sources.readers import path_exists
from corpuslab.staging import stage

BATCH = "batch_id"
# Bits that an id sets, each from a hash with a seed of its own.
HASHES = 4
FILTER_SQL = f"bucket int, word int, bits bigint, {BATCH} bigint"


@dataclass(frozen=True)
class IdIndex:
    """Buckets and bits are fixed when an index is begun; some ten bits per id keep reads rare."""

    path: str
    row_id: str
    buckets: int = 64
    bits: int = 1 << 20

    def _bucket(self):
        return F.pmod(F.xxhash64(F.lit(-1), F.col(self.row_id)), F.lit(self.buckets)).cast("int").alias("bucket")

    def _positions(self, ids: DataFrame) -> DataFrame:
        """(id, bucket, word, bit) for every bit that an id sets."""
        places = F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(self.row_id)), F.lit(self.bits)) for k in range(HASHES)])
        rows = ids.select(self.row_id, self._bucket(), F.explode(F.array_distinct(places)).alias("place"))
        bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))").alias("bit")
        return rows.select(self.row_id, "bucket", F.floor(F.col("place") / 64).cast("int").alias("word"), bit)

    def _filters(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """Filters of the last batch before ``batch_id``."""
        if not path_exists(spark, f"{self.path}/filters"):
            return None
        rows = spark.read.schema(FILTER_SQL).parquet(f"{self.path}/filters").filter(F.col(BATCH) < batch_id)
        last = rows.agg(F.max(BATCH)).first()[0]
        return None if last is None else rows.filter(F.col(BATCH) == last).drop(BATCH)

    def suspects(self, ids: DataFrame, batch_id: int) -> DataFrame | None:
        """The ids, unique ones, that the filters cannot tell to be new; None if all are."""
        filters = self._filters(ids.sparkSession, batch_id)
        if filters is None:
            return None
        asked = self._positions(ids).join(filters, ["bucket", "word"], "left")
        missing = F.count_if(F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(F.col("bit")) == 0)
        return asked.groupBy(self.row_id).agg(missing.alias("_missing")).filter("_missing = 0").select(self.row_id)

    def stored(self, suspects: DataFrame, batch_id: int) -> DataFrame | None:
        """Ids of earlier batches in the buckets of the suspects; None if there are none."""
        # At most one row per bucket comes to the driver.
        wanted = sorted(r["bucket"] for r in suspects.select(self._bucket()).distinct().collect())
        if not wanted:
            return None
        spark = suspects.sparkSession
        id_type = suspects.schema[self.row_id].dataType.simpleString()
        rows = spark.read.schema(f"`{self.row_id}` {id_type}, bucket int, {BATCH} bigint").parquet(f"{self.path}/ids")
        return rows.filter(F.col("bucket").isin(wanted) & (F.col(BATCH) < batch_id)).select(self.row_id)

    def drop_known(self, fresh: DataFrame, batch_id: int) -> DataFrame:
        """Rows of ``fresh``, one per id, whose id is in no earlier batch; staged input."""
        suspects = self.suspects(fresh, batch_id)
        if suspects is None:
            return fresh
        suspects = stage(suspects, "suspects")
        stored = self.stored(suspects, batch_id)
        if stored is None:
            return fresh
        known = suspects.join(stored, self.row_id, "left_semi")
        return fresh.join(known, self.row_id, "left_anti")

    def add(self, ids: DataFrame, batch_id: int) -> None:
        """Write ids and filters of a batch; a repeated batch writes the same again."""
        spark = ids.sparkSession
        dealt = ids.select(self.row_id, self._bucket())
        dealt.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/ids/{BATCH}={batch_id}")
        words = self._positions(ids).select("bucket", "word", F.col("bit").alias("bits"))
        before = self._filters(spark, batch_id)
        if before is not None:
            words = words.unionByName(before)
        merged = words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        merged.write.mode("overwrite").parquet(f"{self.path}/filters/{BATCH}={batch_id}")
