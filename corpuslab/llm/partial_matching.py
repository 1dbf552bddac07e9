"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``order`` bytes with the counts of the bytes that
follow them, learned from all training texts. A byte that its longest context has not seen costs an
escape (as likely as one count for each different byte seen there) and is looked for in the next
shorter context, where the bytes already ruled out are excluded; below the empty context all bytes
that are left are equally likely. A text starts after ``order`` start bytes and ends with an end
byte, so the probabilities of all texts add up to one.

Texts are gathered into blocks of some megabytes. A block sends each different window of
``order + 1`` bytes, and each different word, once with its training count. Windows are packed into
integers with the last context byte on top, so sorted windows are a walk through the trie and tasks
get whole subtrees below contexts of three bytes, each of at most 256 ** (order - 2) windows.
Shorter contexts have at most 256 ** 3 counts, whatever the input, and are broadcast. The
probabilities go back to the blocks that asked.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import row_numbers_from, staged

ORDER = 4
BLOCK_BYTES = 16 << 20
# Bytes that no UTF-8 text holds: before a text, and at its end.
START, END = 0xFF, 0xFE
SYMBOLS = 255
# Contexts of up to this many bytes are broadcast.
LOW = 2
# Windows that are sorted or looked up at once.
TOGETHER = 2 << 20
BLOCK_SQL = "block long, place int, gram long, word binary, n long, texts binary"
TEXTS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.large_binary())])


def windows(texts: list[bytes], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Packed windows of lower-case texts in runs: number of the first text, windows, text bounds.

    A run has whole texts and about TOGETHER windows; every text has a window per byte and one for
    its end.
    """
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < TOGETHER):
            size += len(texts[high])
            high += 1
        before, end = bytes([START]) * order, bytes([END])
        joined = b"".join([before + t + end for t in texts[low:high]])
        raw = np.frombuffer(joined, np.uint8)
        packed = raw[order:].astype(np.int64)
        for k in range(1, order + 1):
            packed |= raw[order - k : len(raw) - k].astype(np.int64) << (8 * (order + 1 - k))
        packed = packed[raw[order:] != START]
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[low:high]])
        yield low, packed, bounds
        low = high


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and how often (or with what weight) they occur."""
    if weights is None:
        ordered = np.sort(values)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, int)
        return ordered[first], np.diff(np.r_[first, len(ordered)])
    found, back = np.unique(values, return_inverse=True)
    return found, np.bincount(back, weights, len(found)).astype(np.int64)


def block_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Different windows of all texts, in order, with their counts."""
    parts = [counted(packed) for _, packed, _ in windows(texts, order)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return counted(np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts]))


def _block_rows(block: int, rows: list[tuple], order: int) -> Iterator[pa.RecordBatch]:
    """The questions of a block and its texts. Places number the windows, then the words."""
    trained = [t for _, held, t in rows if not held]
    grams, n = block_grams([t for *_, t in rows], order)
    known, n_known = block_grams(trained, order)
    n[:] = 0
    n[np.searchsorted(grams, known)] = n_known
    words: Counter[bytes] = Counter()
    for text in trained:
        words.update(text.split())
    words.update(dict.fromkeys((w for _, held, t in rows if held for w in t.split()), 0))
    ordered = sorted(words)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), TEXTS)], schema=TEXTS))

    def batch(count: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = dict(block=pa.int64(), place=pa.int32(), gram=pa.int64(), word=pa.binary(), n=pa.int64(), texts=pa.binary())
        columns["block"] = pa.array(np.full(count, block, np.int64))
        return pa.record_batch([columns.get(c, pa.nulls(count, k)) for c, k in kinds.items()], names=list(kinds))

    size = 100_000
    for k in range(0, len(grams), size):
        part = grams[k : k + size]
        yield batch(
            len(part), place=pa.array(np.arange(k, k + len(part)), pa.int32()), gram=pa.array(part), n=pa.array(n[k : k + size])
        )
    for k in range(0, len(ordered), size):
        part = ordered[k : k + size]
        yield batch(
            len(part),
            place=pa.array(np.arange(len(grams) + k, len(grams) + k + len(part)), pa.int32()),
            word=pa.array(part, pa.binary()),
            n=pa.array([words[w] for w in part], pa.int64()),
        )
    yield batch(1, texts=pa.array([sink.getvalue().to_pybytes()], pa.binary()))


def _gather(order: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, size = row_numbers_from(), [], 0
        for batch in batches:
            for doc_id, held, text in zip(*batch.columns):
                text = (text.as_py() or "").encode().lower()
                rows.append((doc_id.as_py(), held.as_py(), text))
                size += len(text) + order + 1
                if size >= block_bytes:
                    yield from _block_rows(block, rows, order)
                    block, rows, size = block + 1, [], 0
        if rows:
            yield from _block_rows(block, rows, order)

    return run


def gather_blocks(
    docs: DataFrame, held_out, order: int = ORDER, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Staged rows of blocks: windows, words with training counts, and the texts of the block."""
    if not LOW < order < 7:
        raise ValueError("order is from 3 to 6")
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text).alias("text"),
    )
    return staged(narrow.mapInArrow(_gather(order, block_bytes), BLOCK_SQL), "text-blocks")


def fit_trie(blocks: DataFrame) -> DataFrame:
    """(gram, n): every window that a block asked for with its count in all training texts.

    A stored table of this kind is the pretrained model.
    """
    asked = blocks.filter(F.col("gram").isNotNull()).select("gram", "n")
    return staged(asked.groupBy("gram").agg(F.sum("n").alias("n")), "trie")


class Level:
    """Contexts of one length: counts of the bytes after them, totals, and what they exclude."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, below: Level | None):
        """``ids`` are sorted (context << 8 | byte) with counts above 0."""
        self.ids, self.n = ids, n
        contexts = ids >> 8
        first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(ids) else np.zeros(0, int)
        self.contexts = contexts[first]
        self.kinds = np.diff(np.r_[first, len(ids)])
        self.total = np.add.reduceat(n, first) if len(ids) else n
        # The count, in the context one byte shorter, of the bytes seen in this one.
        shorter = below.count((ids >> 16 << 8) | (ids & 255)) if below is not None else n
        self.excluded = np.add.reduceat(shorter, first) if len(ids) else n

    def count(self, ids: np.ndarray) -> np.ndarray:
        return _looked_up(self.ids, ids, self.n)[0]

    def context(self, ids: np.ndarray) -> list[np.ndarray]:
        """total, kinds and excluded of the contexts of ids, 0 where a context is unknown."""
        return _looked_up(self.contexts, ids >> 8, self.total, self.kinds, self.excluded)


def _looked_up(keys: np.ndarray, wanted: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    if not len(keys):
        return [np.zeros(len(wanted), np.int64) for _ in columns]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return [np.where(found, c[at], 0) for c in columns]


def low_levels(ids: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of contexts of 0 to LOW bytes from the counts of the longest of them."""
    tables = [counted(ids, n)]
    for _ in range(LOW):
        ids, n = tables[0]
        tables.insert(0, counted((ids >> 16 << 8) | (ids & 255), n))
    levels: list[Level] = []
    for ids, n in tables:
        levels.append(Level(ids, n, levels[-1] if levels else None))
    return levels


def log_probabilities(grams: np.ndarray, n: np.ndarray, low: list[Level], order: int) -> np.ndarray:
    """Natural logarithm of the probability of the last byte of every window.

    ``grams`` are all known windows of some contexts of LOW + 1 bytes, with their counts.
    """
    at = lambda j: (grams >> 8 * (order - j + 1) << 8) | (grams & 255)
    levels = list(low)
    trained = n > 0
    for j in range(LOW + 1, order + 1):
        levels.append(Level(*counted(at(j)[trained], n[trained]), levels[-1]))
    result = np.zeros(len(grams))
    open_ = np.ones(len(grams), bool)
    out_count = np.zeros(len(grams), np.int64)
    out_kinds = np.zeros(len(grams), np.int64)
    for j in range(order, -1, -1):
        ids = at(j)
        seen = levels[j].count(ids)
        total, kinds, excluded = levels[j].context(ids)
        mass = total - out_count + kinds - out_kinds
        hit = open_ & (seen > 0)
        result[hit] += np.log(seen[hit] / mass[hit])
        escape = open_ & (seen == 0) & (total > 0) & (mass > 0)
        result[escape] += np.log((kinds - out_kinds)[escape] / mass[escape])
        open_ &= seen == 0
        out_count, out_kinds = excluded, kinds
    result[open_] -= np.log(SYMBOLS - out_kinds[open_])
    return result


def _evaluate(low, order: int):
    schema = pa.schema([("gram", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = low_levels(*low.value)
        cut = 8 * (order - LOW)

        def scored(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(grams), pa.array(log_probabilities(grams, n, levels, order))], schema=schema)

        held = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            if len(held[0]) >= 50_000:
                # The last subtree may go on in the next batch.
                stop = int(np.searchsorted(held[0], held[0][-1] >> cut << cut))
                if stop:
                    yield scored(held[0][:stop], held[1][:stop])
                    held = [h[stop:].copy() for h in held]
        if len(held[0]):
            yield scored(*held)

    return run


def probabilities(trie: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, value): the log probability of the last byte of every window of the trie."""
    spark = trie.sparkSession
    shift = 8 * (order - LOW)
    short = F.shiftleft(F.shiftright("gram", shift + 8), 8).bitwiseOR(F.col("gram").bitwiseAND(F.lit(255)))
    # At most 256 ** 3 rows: a context of LOW bytes and the byte after it.
    counts = trie.filter(F.col("n") > 0).groupBy(short.alias("id")).agg(F.sum("n").alias("n")).toArrow()
    low = spark.sparkContext.broadcast(tuple(counts.column(c).to_numpy().astype(np.int64) for c in ("id", "n")))
    walks = trie.repartition(F.shiftright("gram", shift)).sortWithinPartitions("gram").select("gram", "n")
    return walks.mapInArrow(_evaluate(low, order), "gram long, value double")


def _sums(order: int, total: int, kinds: int, ends: int):
    """Blocks and their answers -> scores."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
        ]
    )
    mass = math.log10(total + 0.5 * (kinds + 1))
    unseen = math.log10(0.5) - mass
    end = math.log10(ends + 0.5) - mass

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        results = []
        answers = np.zeros(right.num_rows)
        answers[right.column("place").to_numpy()] = right.column("value").to_numpy()
        for blob in left.column("texts").to_pylist():
            rows = pa.ipc.open_stream(blob).read_all().to_pydict()
            texts = rows["text"]
            grams, _ = block_grams(texts, order)
            known_grams = pd.Index(grams)
            values = answers[: len(grams)]
            counts = answers[len(grams) :]
            word_logs = np.where(counts > 0, np.log10(counts + 0.5) - mass, unseen)
            logs = dict(zip(sorted({w for t in texts for w in t.split()}), word_logs.tolist()))
            scores = np.zeros(len(texts))
            for first, packed, bounds in windows(texts, order):
                each = values[known_grams.get_indexer(packed)]
                scores[first : first + len(bounds) - 1] = np.add.reduceat(each, bounds[:-1])
            base, known, sizes = [], [], []
            for text in texts:
                found = [logs[w] for w in text.split()]
                base.append(math.fsum(found) + end)
                known.append(len(found) - found.count(unseen) + (ends > 0))
                sizes.append(len(found) + 1)
            columns = [rows["doc_id"], rows["held_out"], sizes, known, [total] * len(texts), base, scores / math.log(10)]
            results.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(results) if results else schema.empty_table()

    return run


def score_texts(
    docs: DataFrame,
    held_out,
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
    trie: DataFrame | None = None,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per document.

    ``held_out`` is a boolean column of ``docs``; where it is not true, a text is learned from.
    A to Z are lower-cased. ``score`` is the log10 probability of the bytes of a text and its end;
    ``trie`` is a stored model of the same order, whose counts then take the place of those of
    ``docs``. ``base_score`` is that of its words and its end by smoothed word counts. Null texts
    are empty and have the end alone; repeated rows, and rows without a doc_id, are scored and
    learned from on their own; without training texts every byte is equally likely; an empty table
    gives no rows; other columns are left out, whatever their names. A task holds one block: about
    ``block_bytes``, or one text if that is longer.
    """
    blocks = gather_blocks(docs, held_out, order, block_bytes, doc_id, text)
    own = fit_trie(blocks)
    if trie is not None:
        own = staged(
            own.select("gram").join(trie, "gram", "full").select("gram", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "trie"
        )
    grams = blocks.filter(F.col("gram").isNotNull()).select("block", "place", "gram")
    asked = blocks.filter(F.col("word").isNotNull())
    words = staged(asked.groupBy("word").agg(F.sum("n").alias("value")), "words")
    # One row of totals; a block is known by its texts, and a training text has one end.
    seen = words.agg(F.sum("value").alias("n"), F.count_if(F.col("value") > 0).alias("v")).first()
    ends = docs.filter(~F.coalesce(held_out, F.lit(False))).count()
    total, kinds = (seen["n"] or 0) + ends, seen["v"] + (ends > 0)
    answers = (
        grams.join(staged(probabilities(own, order), "probabilities"), "gram")
        .select("block", "place", "value")
        .unionByName(asked.select("block", "place", "word").join(words, "word").select("block", "place", F.col("value").cast("double").alias("value")))
    )
    texts = blocks.filter(F.col("texts").isNotNull()).select(F.col("block").alias("of"), "texts")
    return (
        texts.groupBy("of")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            _sums(order, total, kinds, ends),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def held_out_ids(doc_id: str = "doc_id"):
    """Every fifth document by the crc32 of its decimal id; a missing id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))
