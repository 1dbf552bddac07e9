"""Token ids in ORC files, in ascending document order.

The texts are range-partitioned and sorted by document id, encoded, and written as ORC: integer
columns are run-length encoded, row groups have min/max indexes, and document ids have Bloom
filters, so that a lookup skips stripes and row groups. A file split is a set of stripes, so stripes
are read in parallel. Each row holds the place of its first id in its file part; the sizes of the
parts, one row per write task, turn this into a place in the whole table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import chunk_encoder

FILE_SQL = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
END_ID = 1


def _encode(path: str, end_id: int):
    end = end_id.to_bytes(4, "little")
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()),
            ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        part = TaskContext.get().partitionId()
        start = 0
        for batch in batches:
            # Long texts: pass on slices of a batch, so that no buffer of ids grows with it.
            for low in range(0, batch.num_rows, 2000):
                piece = batch.slice(low, 2000)
                blobs = [encoder(t) + end for t in piece.column(1).to_pylist()]
                sizes = np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))
                ends = np.cumsum(sizes)
                offsets = np.zeros(len(blobs) + 1, np.int32)
                offsets[1:] = ends
                ids = pa.array(np.frombuffer(b"".join(blobs), np.int32))
                yield pa.record_batch(
                    [
                        piece.column(0),
                        pa.array(np.full(len(blobs), part, np.int32)),
                        pa.array(start + ends - sizes),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offsets), ids),
                    ],
                    schema=schema,
                )
                start += int(ends[-1])

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    stripe_bytes: int = 32 << 20,
    index_rows: int = 1000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode whole texts and write them as ORC in ascending order of doc_id.

    A null text is empty and gives the end id alone. Rows with one doc_id are ordered by the hash
    of their text and then in any order; a missing doc_id comes first. An empty table writes no ids.
    """
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    (
        ordered.mapInArrow(_encode(tokenizer, end_id), FILE_SQL)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(index_rows))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; ``doc_ids`` is pushed down to file, stripe and row-group metadata."""
    rows = spark.read.schema(FILE_SQL).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def with_start(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``start``, the number of ids before them in the whole table."""
    rows = read_tokens(spark, path)
    # One row per write task; only narrow columns are read for it.
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    return (
        rows.join(F.broadcast(shifts), "part")
        .withColumn("start", F.col("start_in_part") + F.col("_shift"))
        .drop("_shift")
    )


def crc_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens, ids -> the same with the crc32 of the ids as uint32 bytes."""
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy()).view(np.uint8))
        crc = [
            zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
        ]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of the files."""
    rows = with_start(spark, path).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(crc_of_ids, "doc_id long, start long, n_tokens long, ids_crc32 long")
