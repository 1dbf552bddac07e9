"""Fill-in-the-middle examples, cut at units that one regular-expression match has kept.

``(unit)*`` is matched against the whole text by the regex library, which retains every repetition
of the group: the ends of the repetitions give the number of units, and the two cut offsets are
entries of that list, so no unit is visited by a loop. Which units are cut, and the form of the
example, follow from a seeded hash of the document id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
SEED = 1
# Of 100 documents, how many become examples, and how many of these put the suffix first.
EXAMPLES, SUFFIX_FIRST = 90, 20
# Texts whose results are passed on together.
TOGETHER = 500


def draws(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four unsigned integers from the sha256 of seed and id; a missing id is hashed as ''."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


class Infiller:
    """Cuts texts into prefix, middle and suffix and puts them together again."""

    def __init__(self, unit: str = CODE_POINT, seed: int = SEED):
        self.pattern, self.seed = regex.compile(f"({unit})*"), seed

    def cut(self, text: str, doc_id: int | None) -> tuple[int, str, int, int]:
        """Number of units, form, and the offsets at which the middle starts and ends."""
        match = self.pattern.fullmatch(text)
        if match is None:
            raise ValueError("a text is not a sequence of units")
        ends = match.ends(1)
        n = len(ends)
        h1, h2, h3, h4 = draws(self.seed, doc_id)
        if not text or h3 % 100 >= EXAMPLES or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", 0, 0
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
        return n, form, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def join_parts(text: str, form: str, start: int, end: int) -> str:
    """The example of a text whose middle is text[start:end]."""
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def restore(output: str, form: str) -> str:
    """The text of an example. Marks do not occur in the parts and cannot overlap one another."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _rows(unit: str, seed: int, digests: bool):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    names += ["output_sha256", "restored_sha256"] if digests else ["output"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    kinds += [pa.string()] * (len(names) - len(kinds))
    schema = pa.schema(list(zip(names, kinds)))

    def row(infiller: Infiller, doc_id: int | None, text: str | None) -> tuple:
        text = text or ""
        n, form, start, end = infiller.cut(text, doc_id)
        output = join_parts(text, form, start, end)
        chars = (None, None) if form == "plain" else (start, end - start)
        made = (_digest(output), _digest(restore(output, form))) if digests else (output,)
        return (doc_id, n, form, *chars, *made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        infiller = Infiller(unit, seed)
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                piece = batch.slice(low, TOGETHER)
                rows = [row(infiller, i.as_py(), t.as_py()) for i, t in zip(piece.column(0), piece.column(1))]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.record_batch(columns, schema=schema)

    return run


def _applied(docs: DataFrame, unit: str, seed: int, doc_id: str, text: str, digests: bool) -> DataFrame:
    made = "output_sha256 string, restored_sha256 string" if digests else "output string"
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(
        _rows(unit, seed, digests),
        f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {made}",
    )


def infill(
    docs: DataFrame, unit: str = CODE_POINT, seed: int = SEED, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output, one row per document.

    ``unit`` is a pattern without groups of which every text is a sequence; another text is an
    error. Rows are independent: repeated rows give equal rows, a missing doc_id is hashed as an
    empty one, null and empty texts are plain with n = 0, an empty table gives no rows, and other
    columns are left out, whatever their names. A match keeps a place per unit, so a task needs
    some 60 bytes per unit of its longest text.
    """
    return _applied(docs, unit, seed, doc_id, text, False)


def infill_digest(
    docs: DataFrame, unit: str = CODE_POINT, seed: int = SEED, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """As ``infill``, with the sha256 of the output and of the text restored from it."""
    return _applied(docs, unit, seed, doc_id, text, True)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), k AS (
  SELECT doc_id, body, n, CAST('0x' || substring(h, 1, 8) AS BIGINT) % (n + 1) AS h1,
         CAST('0x' || substring(h, 9, 8) AS BIGINT) % (n + 1) AS h2,
         CAST('0x' || substring(h, 17, 8) AS BIGINT) % 100 AS h3,
         CAST('0x' || substring(h, 25, 8) AS BIGINT) % 100 AS h4
  FROM d
), f AS (
  SELECT doc_id, body, n, least(h1, h2) AS a, greatest(h1, h2) AS b,
         CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 >= 90
              THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT *, substring(body, 1, a) AS prefix, substring(body, a + 1, b - a) AS middle, substring(body, b + 1) AS suffix
  FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p
"""
