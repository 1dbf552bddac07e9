"""CSV files with line ends inside quoted cells, read by many tasks per file.

A scan of such a file cannot start in the middle: whether a line end closes a record depends on
whether a quote is open, so the usual reader gives a file to one task. Here the lines are read by
Spark's splittable text source. One narrow pass counts the quotes of every split; their running
parity over the splits of a file tells which splits start inside a quoted cell. With it, every split
cuts its own lines into records, and only the pieces of records that cross a split border, at most
two per split, meet in a shuffle.

Quotes have to be doubled inside quoted cells and absent from other cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.sources.readers import CELLS, header_names, require_columns
from corpuslab.staging import stage

QUOTE = '"'
PIECE_SQL = "file string, block long, seq long, head boolean, closed boolean, record string"
# Up to this many splits, of 128 MB each by default, their parities are broadcast: some 100 MB.
BROADCAST_SPLITS = 500_000


class _Cutter:
    """Cuts the lines of one split into records; ``inside`` tells whether a quote is open."""

    def __init__(self, file: str, block: int, inside: bool):
        self.key, self.inside, self.head = (file, block), inside, not inside
        self.seq, self.lines = 0, []

    def cut(self, lines: list[str], quotes: np.ndarray) -> Iterator[tuple]:
        after = (np.cumsum(quotes) + self.inside) % 2 == 1
        ends = np.flatnonzero(~after)
        low = 0
        for end in ends.tolist():
            record = "\n".join([*self.lines, *lines[low : end + 1]])
            yield (*self.key, self.seq, self.head, True, record)
            self.seq, self.head, self.lines, low = self.seq + 1, True, [], end + 1
        self.lines += lines[low:]
        if len(lines):
            self.inside = bool(after[-1])

    def rest(self) -> Iterator[tuple]:
        if self.lines:
            yield (*self.key, self.seq, self.head, False, "\n".join(self.lines))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (value, file, block, inside) in the order of the file -> pieces of records."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    names = ["file", "block", "seq", "head", "closed", "record"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    cutter = None
    for batch in batches:
        blocks = batch.column(2).to_numpy()
        files = batch.column(1).dictionary_encode().indices.to_numpy()
        change = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1
        rows: list[tuple] = []
        for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            part = batch.slice(low, high - low)
            if not part.num_rows:
                continue
            key = part.column(1)[0].as_py(), int(blocks[low])
            if cutter is None or cutter.key != key:
                rows += cutter.rest() if cutter else ()
                cutter = _Cutter(*key, part.column(3)[0].as_py())
            quotes = pc.count_substring(part.column(0), QUOTE).to_numpy(zero_copy_only=False)
            rows += cutter.cut(part.column(0).to_pylist(), quotes)
        if rows:
            yield batch_of(rows)
    last = list(cutter.rest()) if cutter else []
    if last:
        yield batch_of(last)


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a split starts inside a quoted cell."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    # One row per split of a file.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, record): the records of all files as text, the headers included.

    ``block`` is the split in which a record starts and ``seq`` its place there.
    """
    # Line ends are "\n"; a "\r" before one belongs to the line and is taken off outside of cells.
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    starts = stage(_starts(lines), "split-starts")
    if starts.count() <= BROADCAST_SPLITS:
        ordered = lines.join(F.broadcast(starts), ["file", "block"])
    else:
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(starts, ["file", "block"])
        ordered = placed.repartition("file", "block").sortWithinPartitions("file", "block", "place")
    pieces = stage(ordered.select("value", "file", "block", "inside").mapInArrow(_pieces, PIECE_SQL), "pieces")
    whole = pieces.filter("head AND closed").select("file", "block", "seq", "record")
    # At most two pieces per split: its first, if it goes on from an earlier one, and its last.
    parts = pieces.filter("NOT (head AND closed)")
    running = Window.partitionBy("file").orderBy("block", "seq")
    chains = parts.withColumn("chain", F.sum(F.col("head").cast("long")).over(running))
    piece = F.struct("block", "seq", "record")
    joined = chains.groupBy("file", "chain").agg(F.array_sort(F.collect_list(piece)).alias("all"))
    text = F.array_join(F.transform("all", lambda p: p["record"]), "\n")
    first = F.col("all")[0]
    crossed = joined.select("file", first["block"].alias("block"), first["seq"].alias("seq"), text.alias("record"))
    return whole.unionByName(crossed).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read_csv_splits(
    spark: SparkSession, path: str, schema: T.StructType, all_columns: bool = False
) -> DataFrame:
    """As ``readers.read_csv``, with as many tasks as a text scan of the files has.

    Every file has a header of its own, all of them the same. Empty lines between records are
    skipped.
    """
    names = header_names(spark, path)
    types = {f.name: f.dataType for f in schema.fields}
    found = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in names])
    records = read_records(spark, path)
    body = records.filter(~((F.col("block") == 0) & (F.col("seq") == 0)) & (F.col("record") != ""))
    parsed = body.select(F.from_csv("record", found.toDDL(), CELLS).alias("r"))
    rows = require_columns(parsed.select("r.*"), *types)
    others = [n for n in names if n not in types] if all_columns else []
    return rows.select(*types, *others)
