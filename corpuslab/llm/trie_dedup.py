"""Exact deduplication: Patricia tries own the texts of a length-and-hash partition.

Every map task inserts its texts into a trie whose keys are content hash + text bytes. Terminals
keep the smallest (doc_id, row) and the number of rows, so a task passes on one copy of a text
however many rows hold it. When a trie outgrows its byte budget, its largest subtree is passed on
and freed. The terminals are dealt by (length, hash), sorted, and merged by full bytes in a second
trie, which is emptied whenever the key or the budget is passed: rows come in key order, so what it
holds by then is complete. Rows learn their owner through the number of their local terminal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import row_key, row_numbers_from, staged, whole_row

BUDGET = 32 << 20


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common start of two byte strings, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Node:
    __slots__ = ("label", "children", "terminal")

    def __init__(self, label: bytes, terminal=None):
        self.label, self.children, self.terminal = label, {}, terminal


class PatriciaTrie:
    """Compressed radix trie from byte strings to terminals made by ``make``."""

    def __init__(self, make):
        self.root, self.make, self.bytes = Node(b""), make, 0
        self.below: dict[int, int] = {}

    def terminal(self, key: bytes):
        """The terminal of ``key``, inserted if missing."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:], self.make())
                self.grow(key, len(key) - at + 200)
                return child.terminal
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            cut = shared_prefix(child.label, key[at : at + len(child.label)])
            upper = Node(child.label[:cut])
            child.label = child.label[cut:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            node, at = upper, at + cut
        if node.terminal is None:
            node.terminal = self.make()
            self.grow(key, 200)
        return node.terminal

    def grow(self, key: bytes, size: int) -> None:
        """Book ``size`` bytes on the subtree of ``key``."""
        self.bytes += size
        if key:
            self.below[key[0]] = self.below.get(key[0], 0) + size

    def items(self, first: int | None = None) -> Iterator[tuple[bytes, object]]:
        """(key, terminal) of the whole trie, or of the subtree under one first byte."""
        if first is None:
            stack = [(b"", self.root)]
        else:
            stack = [(b"", self.root.children[first])]
        while stack:
            before, node = stack.pop()
            path = before + node.label
            if node.terminal is not None:
                yield path, node.terminal
            stack.extend((path, child) for child in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Give out and free the largest subtree."""
        first = max(self.below, key=self.below.get)
        yield from self.items(first)
        self.bytes -= self.below.pop(first)
        del self.root.children[first]


LOCAL = pa.schema(
    [
        ("doc_id", pa.int64()), ("row", pa.int64()), ("class", pa.int64()), ("sha", pa.string()),
        ("length", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()),
        ("owner_id", pa.int64()), ("owner_row", pa.int64()), ("n", pa.int64()),
    ]
)
LOCAL_SQL = (
    "doc_id long, row long, class long, sha string, length long, hash long, body binary, "
    "owner_id long, owner_row long, n long"
)
OWNER_SQL = "class long, keep_id long, keep_row long, group_size long"


def smaller(a: tuple, b: tuple) -> tuple:
    """The smaller of two (doc_id, row); a missing doc_id comes last."""
    return min(a, b, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _local_classes(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = row_numbers_from()
        trie = PatriciaTrie(list)

        def emit(items) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            size = 0
            for key, members in items:
                owner = members[0][:2]
                for m in members:
                    owner = smaller(owner, m[:2])
                number = members[0][1]
                body = key[8:]
                for k, (doc_id, r, sha) in enumerate(members):
                    if k:
                        out.append((doc_id, r, number, sha, *[None] * 6))
                    else:
                        hashed = int.from_bytes(key[:8], "big", signed=True)
                        out.append(
                            (doc_id, r, number, sha, len(body), hashed, body, *owner, len(members))
                        )
                size += len(body) + 100 * len(members)
                if size > 8 << 20:
                    yield _batch(out, LOCAL)
                    out, size = [], 0
            if out:
                yield _batch(out, LOCAL)

        for batch in batches:
            ids, texts, hashes, shas = (batch.column(i) for i in range(4))
            for doc_id, text, hashed, sha in zip(
                ids.to_pylist(), texts.to_pylist(), hashes.to_pylist(), shas.to_pylist()
            ):
                key = hashed.to_bytes(8, "big", signed=True) + text
                trie.terminal(key).append((doc_id, row, sha))
                trie.grow(key, 150)
                row += 1
                if trie.bytes > budget:
                    while trie.bytes > budget // 2:
                        yield from emit(trie.spill())
        yield from emit(trie.items())

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.record_batch(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _owners(budget: int):
    schema = pa.schema(
        [(n, pa.int64()) for n in ("class", "keep_id", "keep_row", "group_size")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(lambda: {"owner": None, "n": 0, "classes": []})
        at = None
        out: list[tuple] = []

        def empty() -> None:
            nonlocal trie
            for _, t in trie.items():
                out.extend((c, *t["owner"], t["n"]) for c in t["classes"])
            trie = PatriciaTrie(trie.make)

        last = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for number, length, hashed, body, owner_id, owner_row, n in zip(*columns):
                if (length, hashed) != at or trie.bytes > budget and body != last:
                    empty()
                    at = (length, hashed)
                last = body
                found = trie.terminal(body)
                owner = (owner_id, owner_row)
                found["owner"] = smaller(found["owner"], owner) if found["owner"] else owner
                found["n"] += n
                found["classes"].append(number)
            if len(out) > 20_000:
                yield _batch(out, schema)
                out.clear()
        empty()
        if out:
            yield _batch(out, schema)

    return run


def normalised(text) -> F.Column:
    """Null as empty, every run of ASCII white space as one space."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "
    )


def exact_owners(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after ``normalised``. The row with the smallest doc_id of
    a group stays; a missing doc_id is larger than any other, and of rows with one doc_id exactly
    one stays. A null text counts as empty, other columns are not looked at, and an empty table
    gives an empty result. ``budget`` bounds the bytes of a task's trie.
    """
    plain = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("text")
    ).select(
        "doc_id",
        F.col("text").cast("binary").alias("body"),
        F.xxhash64("text").alias("hash"),
        F.sha2("text", 256).alias("sha"),
    )
    rows = staged(plain.mapInArrow(_local_classes(budget), LOCAL_SQL), "trie-rows")
    terminals = (
        rows.filter(F.col("n").isNotNull())
        .select("class", "length", "hash", "body", "owner_id", "owner_row", "n")
        .repartition("length", "hash")
        .sortWithinPartitions("length", "hash", "body")
    )
    owners = terminals.mapInArrow(_owners(budget), OWNER_SQL)
    return (
        rows.select("doc_id", "row", "class", "sha")
        .join(owners, "class")
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("row") == F.col("keep_row")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_owners`` keeps, with all their columns, whatever their names.

    Rows that agree in doc_id and normalised text are one row; null and empty texts are equal; a
    missing doc_id is a doc_id of its own; very long texts are compared whole; an empty table gives
    no rows.
    """
    kept = exact_owners(docs).filter("kept")
    kept = kept.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    content = F.sha2(normalised(F.col("text")), 256)
    keyed = docs.select(row_key(F.col("doc_id"), content).alias("_key"), whole_row(docs))
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
"""
