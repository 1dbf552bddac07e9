"""Merkle manifest of a dataset, with a witness for every row.

Leaves are hashes of rows. Every source has a tree over its leaves in the order of doc_id, and the
roots of the sources, in their order, have a tree of their own. A tree is built by aligned appends:
blocks of ``ARITY ** BLOCK_LEVELS`` neighbouring leaves are streamed through tasks, each of which
keeps the open subtrees of one block. A leaf that enters an open subtree has a partial witness, and
each sibling that completes a node extends the witnesses below it. The roots of the blocks are then
appended in the same way, as leaves of the next round, until every tree is one block; the witness
of a leaf is that in its block followed by that of its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import staged
from corpuslab.operators.joins import weighted_lookup
from corpuslab.operators.ranking import global_rank

ARITY = 3
# 2187 leaves in a block.
BLOCK_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows that are passed on together.
TOGETHER = 2000


def _hash(parts: list[bytes]) -> bytes:
    """sha256 of digests written as lower-case hex."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


class Appender:
    """The open subtrees of one block.

    A node is (digest, members), members being the places of the leaves below it. ``open[level]``
    holds fewer than ARITY nodes. A step of a witness is (level, siblings before, siblings after).
    """

    def __init__(self, arity: int = ARITY):
        self.arity, self.open, self.witnesses = arity, [[]], []

    def append(self, digest: bytes) -> None:
        self.witnesses.append(([], []))
        self._push(0, (digest, [len(self.witnesses) - 1]))

    def _push(self, level: int, node: tuple[bytes, list[int]]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        """Hash the open nodes of a level into one of the next, extending the witnesses below."""
        nodes, self.open[level] = self.open[level], []
        digests = [d for d, _ in nodes]
        for k, (_, members) in enumerate(nodes):
            siblings = b"".join(digests[:k] + digests[k + 1 :])
            # Few bits per step: which of how many nodes of the run this one is.
            step = bytes([k, len(nodes)])
            for m in members:
                self.witnesses[m][0].append(siblings)
                self.witnesses[m][1].append(step)
        self._push(level + 1, (_hash(digests), [m for _, members in nodes for m in members]))

    def finish(self, levels: int | None) -> bytes:
        """The root: at exactly ``levels`` where other blocks stand beside this one, else as soon as
        one node is left."""
        level = 0
        while level < len(self.open):
            if levels is None and len(self.open[level]) == 1 and not any(self.open[level + 1 :]):
                return self.open[level][0][0]
            if levels is not None and level == levels:
                return self.open[level][0][0]
            if self.open[level]:
                self._close(level)
            level += 1
        raise ValueError("a block without leaves")


def fold(leaf: bytes, siblings: bytes, path: bytes) -> bytes:
    """The root that follows from a leaf and its witness."""
    at = 0
    for k in range(0, len(path), 2):
        place, width = path[k], path[k + 1]
        run = [siblings[at + 32 * i : at + 32 * i + 32] for i in range(width - 1)]
        at += 32 * (width - 1)
        leaf = _hash([*run[:place], leaf, *run[place:]])
    return leaf


def _append_blocks(levels: int, arity: int):
    """Rows (tree, block, many, place, digest), in order -> place, witness and root of the block.

    ``many`` tells whether the tree has other blocks.
    """
    schema = pa.schema(
        [
            ("tree", pa.string()), ("block", pa.int64()), ("place", pa.int64()),
            ("siblings", pa.binary()), ("path", pa.binary()), ("root", pa.binary()),
        ]
    )

    def finished(key: tuple, many: bool, places: list[int], appender: Appender) -> list[tuple]:
        root = appender.finish(levels if many else None)
        return [
            (*key, place, b"".join(siblings), b"".join(path), root if k == 0 else None)
            for k, (place, (siblings, path)) in enumerate(zip(places, appender.witnesses))
        ]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, many, places, appender, ready = None, False, [], None, []
        for batch in batches:
            for tree, block, several, place, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, block) != key:
                    if key is not None:
                        ready += finished(key, many, places, appender)
                        if len(ready) >= TOGETHER:
                            yield batch_of(ready)
                            ready = []
                    key, many, places, appender = (tree, block), several, [], Appender(arity)
                places.append(place)
                appender.append(digest)
        if key is not None:
            ready += finished(key, many, places, appender)
        if ready:
            yield batch_of(ready)

    return run


def witnesses(leaves: DataFrame, levels: int = BLOCK_LEVELS, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """Trees over staged rows (tree, place, n, digest), n being the leaves of the tree.

    Places count from 0 in every tree. Returns (tree, place, siblings, path) for every leaf, and
    (tree, root). Every round divides the largest tree by ``arity ** levels``, so a few do.
    """
    size = arity**levels
    rounds, nodes = [], leaves
    while True:
        ordered = (
            nodes.select(
                "tree",
                F.floor(F.col("place") / size).alias("block"),
                (F.col("n") > size).alias("many"),
                "place",
                "digest",
            )
            .repartition("tree", "block")
            .sortWithinPartitions("tree", "block", "place")
        )
        made = ordered.mapInArrow(
            _append_blocks(levels, arity),
            "tree string, block long, place long, siblings binary, path binary, root binary",
        )
        made = staged(made, "witnesses")
        rounds.append(made.select("tree", "block", "place", "siblings", "path"))
        sizes = nodes.filter(F.col("place") == 0).select("tree", F.ceil(F.col("n") / size).alias("n"))
        roots = made.filter(F.col("root").isNotNull()).select("tree", F.col("block").alias("place"), F.col("root").alias("digest"))
        if (nodes.agg(F.max("n")).first()[0] or 0) <= size:
            tops = roots.select("tree", F.col("digest").alias("root"))
            break
        nodes = staged(roots.join(sizes, "tree"), "block-roots")
    whole = rounds[-1].drop("block")
    for made in reversed(rounds[:-1]):
        above = whole.select(
            "tree", F.col("place").alias("block"), F.col("siblings").alias("_s"), F.col("path").alias("_p")
        )
        # A block has at most ``size`` leaves, so no key of this join is large.
        whole = made.join(above, ["tree", "block"]).select(
            "tree", "place", F.concat("siblings", "_s").alias("siblings"), F.concat("path", "_p").alias("path")
        )
    return whole, tops


def _field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def numbered_leaves(docs: DataFrame, *also: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """tree, place, n, doc_id, digest and the columns ``also``, staged.

    ``tree`` names the source: '' for a missing one, else 's' and the source. In a tree, rows
    ascend by doc_id (a missing one first), then by digest.
    """
    doc_id, source = fields[0], fields[1]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("tree"),
        F.col(doc_id).cast("long").alias("doc_id"),
        leaf_digest(*[F.col(f) for f in fields]).alias("digest"),
        *also,
    )
    ranked = staged(global_rank(rows, [F.col("tree"), F.col("doc_id"), F.col("digest")], "_rank"), "leaves")
    trees = staged(ranked.groupBy("tree").agg(F.min("_rank").alias("_first"), F.count("*").alias("n")), "trees")
    # A source may hold a third of the rows: its row of the table is broadcast.
    known = weighted_lookup(ranked, trees.withColumn("_n", F.col("n")), "tree", "_n")
    return staged(known.withColumn("place", F.col("_rank") - F.col("_first")).drop("_rank", "_first"), "places")


def _verify(root: bytes):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
            ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, leaf, checked, subroot, siblings, path in zip(*(c.to_pylist() for c in batch.columns)):
                proof = hashlib.sha256(siblings.hex().encode()).hexdigest()
                folded = fold(checked, siblings, path)
                rows.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root))
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def build_manifest(leaves: DataFrame, levels: int = BLOCK_LEVELS, arity: int = ARITY) -> tuple[DataFrame, bytes | None]:
    """(``leaves`` with subroot, siblings and path up to the root; the root, None without rows).

    ``leaves`` is a staged table (tree, place, n, digest, ...) as ``numbered_leaves`` makes it.
    """
    below, subroots = witnesses(leaves, levels, arity)
    subroots = staged(subroots.withColumnRenamed("root", "digest"), "subroots")
    ranked = staged(global_rank(subroots, [F.col("tree")], "_rank"), "ranked-subroots")
    n = ranked.count()
    tops = ranked.select(F.lit("").alias("tree"), (F.col("_rank") - 1).alias("place"), F.lit(n).cast("long").alias("n"), "digest")
    above, roots = witnesses(staged(tops, "top-leaves"), levels, arity)
    found = roots.first()
    lifted = ranked.select("tree", (F.col("_rank") - 1).alias("place"), F.col("digest").alias("subroot")).join(
        above.select("place", F.col("siblings").alias("_s"), F.col("path").alias("_p")), "place"
    )
    sizes = leaves.filter(F.col("place") == 0).select("tree", F.col("n").alias("_n"))
    lifted = staged(lifted.drop("place").join(sizes, "tree"), "lifted")
    with_own = leaves.join(below, ["tree", "place"])
    whole = weighted_lookup(staged(with_own, "own-witnesses"), lifted, "tree", "_n")
    whole = whole.withColumns(
        {"siblings": F.concat("siblings", "_s"), "path": F.concat("path", "_p")}
    ).drop("_s", "_p")
    return whole, bytes(found["root"]) if found else None


def verify_manifest(docs: DataFrame, levels: int = BLOCK_LEVELS, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, one row per document.

    Where the crc32 of the decimal doc_id is even, the leaf that is checked is that of a tampered
    row, whose text has lost its line ends; a row without a doc_id is not tampered with. Repeated
    rows are leaves of their own, equal rows in any order; null and '' are different values; an
    empty table gives no rows; columns that are no field are left out, whatever their names.
    """
    plain = [F.col(f) for f in FIELDS]
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    changed = leaf_digest(*plain[:-1], F.coalesce(cut, F.col("text")))
    leaves = numbered_leaves(docs, changed.alias("checked"))
    whole, root = build_manifest(leaves, levels, arity)
    return whole.select("doc_id", "digest", "checked", "subroot", "siblings", "path").mapInArrow(
        _verify(root or b""),
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean",
    )


ORACLE_SQL = r"""
WITH RECURSIVE c AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
           lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i)) AS crc_of
), d AS (
  SELECT *, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda a, b: xor(a >> 8, crc_of[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)) % 2 = 1 AS tampered
  FROM documents, c
), e AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
           || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
           || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
         text AS body, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM d
), l AS (
  SELECT doc_id, tree, sha256(head || coalesce(octet_length(encode(body)) || ':' || body, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) AS checked
  FROM e
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS n
  FROM l
), low AS (
  SELECT tree, 0 AS lvl, place, leaf AS digest, n FROM p
  UNION ALL
  SELECT tree, lvl + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3
  FROM low WHERE n > 1 GROUP BY tree, lvl, place // 3, n
), subroots AS (
  SELECT tree, digest AS subroot, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n
  FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, place, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3
  FROM high WHERE n > 1 GROUP BY lvl, place // 3, n
), runs AS (
  SELECT tree, lvl, place // 3 AS run, list(digest ORDER BY place) AS digests FROM low WHERE n > 1 GROUP BY ALL
), high_runs AS (
  SELECT lvl, place // 3 AS run, list(digest ORDER BY place) AS digests FROM high WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT p.doc_id, p.leaf, p.tree, r.lvl, r.digests, CAST(p.place // CAST(pow(3, r.lvl) AS BIGINT) % 3 AS BIGINT) AS k
  FROM p JOIN runs r ON r.tree = p.tree AND r.run = p.place // CAST(pow(3, r.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.tree, s.height + r.lvl, r.digests, CAST(s.place // CAST(pow(3, r.lvl) AS BIGINT) % 3 AS BIGINT)
  FROM p JOIN subroots s ON s.tree = p.tree JOIN high_runs r ON r.run = s.place // CAST(pow(3, r.lvl + 1) AS BIGINT)
), sides AS (
  SELECT doc_id, leaf, lvl, array_to_string(digests[1:k], '') AS before, array_to_string(digests[k + 2:], '') AS after FROM steps
), proofs AS (
  SELECT doc_id, leaf, string_agg(before || after, '' ORDER BY lvl) AS proof FROM sides GROUP BY doc_id, leaf
), folds AS (
  SELECT doc_id, leaf, 0 AS lvl, checked AS digest FROM p
  UNION ALL
  SELECT f.doc_id, f.leaf, f.lvl + 1, sha256(s.before || f.digest || s.after)
  FROM folds f JOIN sides s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.lvl = f.lvl
), ends AS (
  SELECT doc_id, leaf, arg_max(digest, lvl) AS folded_root FROM folds GROUP BY doc_id, leaf
)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(coalesce(o.proof, '')) AS proof_sha256, e.folded_root,
       e.folded_root = r.digest AS verified
FROM p JOIN subroots s ON s.tree = p.tree JOIN (SELECT digest FROM high WHERE n = 1) r ON true
JOIN ends e ON e.doc_id = p.doc_id AND e.leaf = p.leaf
LEFT JOIN proofs o ON o.doc_id = p.doc_id AND o.leaf = p.leaf
"""
