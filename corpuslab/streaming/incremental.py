"""Incremental copy of a growing cache into the article table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.operators.collect import finalize
from corpuslab.sources.readers import path_exists
from corpuslab.staging import stage
from corpuslab.streaming.id_index import BATCH, IdIndex


def update_articles(
    spark: SparkSession,
    cache_path: str,
    schema: T.StructType,
    articles_path: str,
    checkpoint_path: str,
    order: list[Column],
    row_id: str = "article_id",
    files_per_batch: int | None = None,
    buckets: int = 64,
) -> DataFrame:
    """Read the cache files that are new since the last call and add ids not stored yet.

    Repeats inside a batch are reduced to the first row before any id meets another partition.
    Known ids are found by the index beside the table, whose filters leave few buckets of ids to be
    read, so neither a hot id nor the number of ids ends up in operator state. A batch owns one
    partition of the table and of the index and only looks at earlier ones, so a repeated batch
    writes the same rows again. A table without an index gets one from its ids; ``buckets`` is its
    number of id folders and has to stay the same.
    """
    index = IdIndex(f"{articles_path.rstrip('/')}_index", row_id, buckets)
    stored_schema = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if path_exists(session, articles_path) and not path_exists(session, f"{index.path}/filters"):
            stored = session.read.schema(stored_schema).parquet(articles_path)
            index.add(stored.filter(F.col(BATCH) < batch_id).select(row_id), -1)
        fresh = stage(finalize(batch, order, row_id), "fresh")
        own = f"{articles_path}/{BATCH}={batch_id}"
        index.drop_known(fresh, batch_id).write.mode("overwrite").parquet(own)
        index.add(session.read.schema(schema).parquet(own).select(row_id), batch_id)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.json(cache_path)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not path_exists(spark, articles_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(stored_schema).parquet(articles_path).drop(BATCH)
