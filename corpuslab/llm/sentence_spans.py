"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences at end marks and line ends. From every sentence a span runs over
several sentences, until it is long enough to be no accident, and another runs back from it. The
spans are hashed and grouped over the corpus; the row with the smallest doc_id, and of these the
first, owns a repeated span. Sentences under a span that another row owns, or that the same row had
before, are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import row_numbers_from, staged

# (sentences, words): a span ends when it reaches both numbers of one entry.
LONG_ENOUGH = ((1, 40), (2, 24), (3, 12))
BREAK = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
NO_ID = (1 << 63) - 1
SPAN_SQL = (
    "doc_id long, id long, row long, text string, n_sentences int, h1 array<long>, h2 array<long>, "
    "first array<int>, last array<int>, again array<boolean>"
)


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence that holds more than white space."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def spans(words: list[int]) -> list[tuple[int, int]]:
    """First and last sentence of the shortest long-enough spans from and up to each sentence.

    Every sentence of a long-enough run lies under a span within the run: it is in the shortest span
    from the run's start, or what comes before it in the run is long enough for a span that ends there.
    """
    out = set()
    for at in range(len(words)):
        for step, stop in ((1, len(words)), (-1, -1)):
            total = 0
            for other in range(at, stop, step):
                total += words[other]
                if any(abs(other - at) + 1 >= s and total >= w for s, w in LONG_ENOUGH):
                    out.add((min(at, other), max(at, other)))
                    break
    return sorted(out)


def hashed_spans(text: str) -> tuple[int, list[tuple[int, int, bytes]]]:
    """Number of sentences, and (first, last, hash) of the spans. White space is not compared."""
    parts = [text[a:b].split() for a, b in sentences(text)]
    digests = [xxhash.xxh3_128_digest(" ".join(p)) for p in parts]
    found = []
    for first, last in spans([len(p) for p in parts]):
        found.append((first, last, xxhash.xxh3_128_digest(b"".join(digests[first : last + 1]))))
    return len(parts), found


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = row_numbers_from()
    lists = [pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())]
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            piece = batch.slice(low, 1000)
            counts, columns = [], [[] for _ in lists]
            for text in piece.column(1).to_pylist():
                n, found = hashed_spans(text)
                counts.append(n)
                halves = np.frombuffer(b"".join(h for _, _, h in found), np.int64).reshape(-1, 2)
                seen: set[bytes] = set()
                again = []
                for _, _, h in found:
                    again.append(h in seen)
                    seen.add(h)
                values = (halves[:, 0], halves[:, 1], [f for f, _, _ in found], [e for _, e, _ in found], again)
                for column, value in zip(columns, values):
                    column.append(value)
            n = piece.num_rows
            ids = piece.column(0).fill_null(NO_ID)
            yield pa.record_batch(
                [piece.column(0), ids, pa.array(np.arange(row, row + n)), piece.column(1).cast(pa.string()),
                 pa.array(counts, pa.int32()), *(pa.array(c, t) for c, t in zip(columns, lists))],
                names=["doc_id", "id", "row", "text", "n_sentences", "h1", "h2", "first", "last", "again"],
            )
            row += n


def cut(text: str, covered: list[tuple[int, int]]) -> tuple[str, int, int, list[tuple[int, int]]]:
    """The text without the sentences under (first, last), their number and words, and the places.

    A removed sentence takes the white space after it along; neighbours are one place.
    """
    bounds = sentences(text)
    gone = sorted({i for first, last in covered for i in range(first, last + 1)})
    places: list[tuple[int, int]] = []
    words = 0
    for i in gone:
        start, end = bounds[i]
        words += len(text[start:end].split())
        end = bounds[i + 1][0] if i + 1 < len(bounds) else len(text)
        if places and places[-1][1] == start:
            places[-1] = (places[-1][0], end)
        else:
            places.append((start, end))
    kept, at = [], 0
    for start, end in places:
        kept.append(text[at:start])
        at = end
    return "".join(kept) + text[at:], len(gone), words, places


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_ids, texts, counts, covered = (batch.column(i) for i in range(4))
        out = []
        for text, ranges in zip(texts.to_pylist(), covered.to_pylist()):
            out.append(cut(text, [(r["first"], r["last"]) for r in ranges or []]))
        yield pa.record_batch(
            [doc_ids, counts.cast(pa.int64()), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.int64()),
             pa.array([",".join(f"{a}:{b}" for a, b in o[3]) for o in out], pa.string()),
             pa.array([o[0] for o in out], pa.string())],
            names=["doc_id", "n_sentences", "n_removed", "removed_words", "removed", "text"],
        )


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, removed_words, removed, text.

    ``removed`` lists the removed places as start:end in code points of the whole text. A null text
    counts as empty, which has no sentences. Rows with one doc_id are told apart by their order in the
    table; a missing doc_id is larger than any other. Exact copies keep what is too short for a
    span. An empty table gives no rows; other columns are left out, whatever their names.
    """
    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    signed = staged(plain.mapInArrow(_sign, SPAN_SQL), "sentence-spans")
    zipped = F.inline(F.arrays_zip("h1", "h2", "first", "last", "again"))
    rows = signed.select("id", "row", zipped)
    # Only numbers, summed in the map tasks; a repeated span leaves one row.
    first = F.min(F.struct("id", "row"))
    owners = rows.groupBy("h1", "h2").agg(first.alias("first_row"), F.count("*").alias("n"))
    owners = owners.filter("n > 1").select("h1", "h2", F.col("first_row.row").alias("owner"))
    gone = rows.select("row", "h1", "h2", "first", "last", "again").join(staged(owners, "repeated-spans"), ["h1", "h2"])
    gone = gone.filter("row <> owner or again")
    # No more ranges than the document has sentences.
    ranges = gone.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("covered"))
    ranges = staged(ranges, "covered")
    whole = signed.select("doc_id", "row", "text", "n_sentences").join(ranges, "row", "left")
    return whole.select("doc_id", "text", "n_sentences", "covered").mapInArrow(
        _cut,
        "doc_id long, n_sentences long, n_removed long, removed_words long, removed string, text string",
    )
