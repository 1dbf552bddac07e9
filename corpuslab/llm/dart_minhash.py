"""Near-duplicates by DartMinHash.

A document is a weighted set of word five-grams, the weight being the number of occurrences. Every
unit of weight of an element is a region into which hashed darts are thrown: a Poisson stream of
ranks seeded by the element, the unit and the number of the dart, so that equal regions get equal
darts in every document. Only darts below a rank limit are made, k ln k + 2k of them for a document
whatever its length, and each falls on one of k coordinates. The earliest dart of every coordinate
is the signature; a document in which a coordinate stays empty throws on under a doubled limit.
Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Signatures are cut into bands. Documents with one band form a bucket; its members are compared with
a leader, and comparisons are exact. Members outside the leader's component are then compared with
all members of the bucket, inside tasks and in blocks, so that no table of pairs arises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import row_key, row_numbers_from, staged, whole_row
from corpuslab.llm.components import components
from corpuslab.operators.joins import weighted_lookup

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash; at ``limit`` entries new ones are not kept."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    words = (text or "").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of a shorter text, of all its words as one run."""
    with np.errstate(over="ignore"):
        n = max(1, len(words) - WORDS + 1) if len(words) else 0
        width = min(WORDS, len(words))
        out = np.full(n, np.uint64(width))
        for k in range(width):
            out = mixed(out ^ words[k : k + n])
        return out


def units(grams: np.ndarray) -> np.ndarray:
    """One hash per unit of weight: the element with the number of its occurrence, ascending.

    The Jaccard similarity of these sets is the weighted one of the counted elements.
    """
    ordered = np.sort(grams)
    if not len(ordered):
        return ordered
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    occurrence = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    with np.errstate(over="ignore"):
        repeated = mixed(ordered ^ mixed(occurrence.astype(np.uint64)))
    return np.sort(np.where(occurrence == 0, ordered, repeated))


def signatures(documents: list[np.ndarray], k: int) -> np.ndarray:
    """Earliest dart on each of ``k`` coordinates, one row per document of unit regions.

    A document without regions has zeros.
    """
    out = np.zeros((len(documents), k), np.uint64)
    sizes = np.array([len(d) for d in documents], np.int64)
    todo = np.flatnonzero(sizes)
    expected = k * math.log(k) + 2 * k
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        alive = np.concatenate([documents[i] for i in todo])
        limit = np.repeat(expected / sizes[todo], sizes[todo])
        rank, dart = np.zeros(len(alive)), np.uint64(1)
        ranks, darts, owners = [], [], []
        with np.errstate(over="ignore"):
            while len(alive):
                seeds = mixed(alive + dart * MIX[1])
                # Gaps of a Poisson stream: minus the logarithm of a uniform number.
                rank = rank - np.log(((seeds >> np.uint64(11)).astype(float) + 0.5) / 2.0**53)
                inside = rank < limit
                alive, rank, limit, owner = alive[inside], rank[inside], limit[inside], owner[inside]
                ranks.append(rank)
                owners.append(owner)
                darts.append(mixed(seeds[inside]))
                dart += np.uint64(1)
        ranks, darts, owners = map(np.concatenate, (ranks, darts, owners))
        place = owners * k + (darts % np.uint64(k)).astype(np.int64)
        earliest = np.full(len(todo) * k, np.inf)
        np.minimum.at(earliest, place, ranks)
        won = ranks == earliest[place]
        found = np.zeros(len(todo) * k, np.uint64)
        found[place[won]] = darts[won]
        full = np.isfinite(earliest).reshape(len(todo), k).all(axis=1)
        out[todo[full]] = found.reshape(len(todo), k)[full]
        todo = todo[~full]
        expected *= 2
    return out


def band_keys(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band, from the coordinates of the band in turn."""
    parts = signed.reshape(len(signed), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mixed(np.arange(bands, dtype=np.uint64)), (len(signed), bands))
        for r in range(rows):
            key = mixed(key ^ parts[:, :, r])
    return key.view(np.int64)


def _sign(bands: int, rows: int, at_once: int = 200_000):
    """doc_id, text, text_key -> the same with row number, hash of the words and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = row_numbers_from()
        known = WordHashes()
        for batch in batches:
            low = 0
            content, regions, size = [], [], 0
            texts = batch.column(1).to_pylist()
            for at, text in enumerate(texts, 1):
                words = word_hashes(text, known)
                content.append(xxhash.xxh3_128_digest(words.tobytes()))
                regions.append(units(shingles(words)))
                size += len(words)
                if size >= at_once or at == len(texts):
                    keys = band_keys(signatures(regions, bands * rows), bands, rows)
                    piece = batch.slice(low, at - low)
                    offsets = pa.array(np.arange(at - low + 1, dtype=np.int32) * bands)
                    yield pa.record_batch(
                        [
                            piece.column(0), pa.array(np.arange(row, row + at - low)),
                            piece.column(1).cast(pa.string()), piece.column(2),
                            pa.array(content, pa.binary()),
                            pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))),
                        ],
                        names=["doc_id", "row", "text", "text_key", "content", "keys"],
                    )
                    row += at - low
                    low = at
                    content, regions, size = [], [], 0

    return run


SIGNED_SQL = (
    "doc_id long, row long, text string, text_key long, content binary, keys array<long>"
)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays without repeats; of two empty ones, 1."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        # The texts of the last pair; a leader stands in many pairs in a row.
        last: list[tuple] = [(None, None), (None, None)]
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            good = []
            for x, y, s, t in zip(*columns):
                for side, (row, text) in enumerate(((x, s), (y, t))):
                    if last[side][0] != row:
                        last[side] = (row, units(shingles(word_hashes(text, known))))
                left, right = last[0][1], last[1][1]
                short, long = sorted((len(left), len(right)))
                if short >= least * long and similarity(left, right) >= least - 1e-12:
                    good.append((x, y))
            yield pa.record_batch(
                [pa.array([g[i] for g in good], pa.int64()) for i in (0, 1)], names=["a", "b"]
            )

    return run


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of which the texts are similar; ``texts`` is (row, text)."""
    with_b = pairs.join(texts.withColumnRenamed("row", "b").withColumnRenamed("text", "tb"), "b")
    both = with_b.join(texts.withColumnRenamed("row", "a").withColumnRenamed("text", "ta"), "a")
    good = both.select("a", "b", "ta", "tb").mapInArrow(_compare(least), "a long, b long")
    return staged(good, "similar")


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the component of each row; a row without links is its own."""
    labelled = rows.join(found.withColumnRenamed("node", "row"), "row", "left")
    return labelled.withColumn("component", F.coalesce("component", "row"))


def _compare_blocks(least: float):
    """Rows (band, key, sb, mb, side, row, text), those of a block together and seekers first.

    Gives the links between the seekers and the members of each block. Shared units are counted
    through a list of the seekers' units; members pass by one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        block, seekers, index = None, [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            left, right = [], []
            for *name, side, row, text in zip(*columns):
                if name != block:
                    block, seekers, index = name, [], None
                own = units(shingles(word_hashes(text, known)))
                if side == 0:
                    seekers.append((row, own))
                    continue
                if index is None:
                    every = np.concatenate([u for _, u in seekers])
                    owner = np.repeat(np.arange(len(seekers)), [len(u) for _, u in seekers])
                    order = np.argsort(every, kind="stable")
                    sizes = np.array([len(u) for _, u in seekers])
                    index = (every[order], owner[order], sizes, np.array([r for r, _ in seekers]))
                every, owner, sizes, rows = index
                low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                n = high - low
                at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(rows))
                near = (both >= (least - 1e-12) * (sizes + len(own) - both)) & (rows != row)
                left += rows[near].tolist()
                right += [row] * int(near.sum())
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def similar_links(
    members: DataFrame, texts: DataFrame, least: float, block: tuple[int, int] = (200, 1000)
) -> DataFrame:
    """node, component of linked rows, from (band, key, row) and (row, text).

    Every bucket is compared with a leader, the row that shares most buckets (the centre of a group
    of near copies). Where a bucket then holds several components, its rows outside the leader's
    component seek links among all its rows. They are compared inside tasks, in blocks of so many
    seekers and rows, which give links and no pairs. So no pair of a bucket is left out but those
    within the leader's component.
    """
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = staged(members.join(sizes, ["band", "key"]), "shared-bands")
    ranks = staged(shared.groupBy("row").agg(F.sum("n").alias("weight")), "sharing")
    texts = staged(texts.join(ranks.select("row"), "row", "left_semi"), "sharing-texts")
    leaders = shared.join(ranks, "row").groupBy("band", "key").agg(
        F.max_by("row", F.struct("weight", -F.col("row"))).alias("leader")
    )
    leaders = staged(leaders, "leaders")
    led = shared.join(leaders, ["band", "key"]).filter("leader <> row")
    pairs = led.select(F.least("leader", "row").alias("a"), F.greatest("leader", "row").alias("b"))
    links = _verified(staged(pairs.distinct(), "pairs"), texts, least)
    found = components(links)

    labelled = staged(_with_component(shared.filter("n > 2"), found), "labelled")
    main = labelled.join(leaders, ["band", "key"]).filter("leader = row")
    main = main.select("band", "key", F.col("component").alias("main"))
    seeking = labelled.join(main, ["band", "key"]).withColumn("seeks", F.col("component") != F.col("main"))
    counted = seeking.groupBy("band", "key").agg(F.sum(F.col("seeks").cast("long")).alias("n_seek"))
    blocks = counted.filter("n_seek > 0").select(
        "band", "key", F.ceil(F.col("n_seek") / block[0]).cast("int").alias("n_sb")
    )
    open_rows = seeking.join(blocks, ["band", "key"]).withColumn(
        "n_mb", F.ceil(F.col("n") / block[1]).cast("int")
    )
    open_rows = staged(open_rows.select("band", "key", "row", "seeks", "n_sb", "n_mb"), "open")
    if open_rows.isEmpty():
        return found
    sb = F.pmod(F.xxhash64("row"), F.col("n_sb")).cast("int").alias("sb")
    mb = F.pmod(F.xxhash64("row", F.lit(1)), F.col("n_mb")).cast("int").alias("mb")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    seekers = open_rows.filter("seeks").select("band", "key", sb, every("n_mb", "mb"), F.lit(0).alias("side"), "row")
    others = open_rows.select("band", "key", every("n_sb", "sb"), mb, F.lit(1).alias("side"), "row")
    dealt = seekers.unionByName(others).join(texts, "row")
    names = ["band", "key", "sb", "mb"]
    dealt = dealt.select(*names, "side", "row", "text").repartition(*names).sortWithinPartitions(*names, "side")
    more = staged(dealt.mapInArrow(_compare_blocks(least), "a long, b long"), "block-links")
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.unionByName(more))


def near_classes(
    docs: DataFrame,
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_texts, kept, text_key.

    Texts are similar when the weighted Jaccard similarity of their lower-cased word five-grams is
    ``least`` or more; a class is a connected component of similar texts and is named by its
    smallest doc_id (null if all are missing), whose row is kept; of rows with one doc_id one is
    kept. ``n_texts`` counts the different texts of a class. Texts with the same words are one class; a null text counts as empty, and empty texts are
    one class. Texts of one to four words are similar only to the same words. Two texts of
    similarity s share a band, and so are compared, with probability 1 - (1 - s^rows)^bands:
    0.99995 at 0.8. An empty table gives no rows.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Texts are needed again for the comparisons, so they are staged with their row.
    signed = plain.withColumn("text_key", F.xxhash64("text")).mapInArrow(_sign(bands, rows), SIGNED_SQL)
    signed = staged(signed, "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    groups = signed.groupBy("content").agg(
        F.min(first).alias("first"), F.count("*").alias("n"), F.min("row").alias("node")
    )
    groups = staged(groups, "contents")
    # One row for each set of equal words takes part.
    nodes = groups.select(F.col("node").alias("row"))
    members = signed.select("row", "keys").join(nodes, "row", "left_semi")
    members = members.select("row", F.posexplode("keys").alias("band", "key"))
    found = similar_links(members, signed.select("row", "text"), least)
    named = groups.join(found, "node", "left").withColumn("class", F.coalesce("component", "node"))
    named = staged(named.drop("component"), "named")
    classes = named.groupBy("class").agg(
        F.min("first").alias("keep"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts")
    )
    table = named.select("content", "n", "class").join(classes, "class")
    table = table.select(
        "content", "n", F.col("keep.doc_id").alias("class_id"), F.col("keep.row").alias("keep_row"),
        "class_size", "n_texts",
    )
    table = staged(table, "classes")
    out = weighted_lookup(signed.select("doc_id", "row", "text_key", "content"), table, "content", "n")
    kept = (F.col("row") == F.col("keep_row")).alias("kept")
    return out.select("doc_id", "class_id", "class_size", "n_texts", kept, "text_key")


def drop_near(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class of near-duplicates, with all columns of ``docs``, whatever their names.

    Rows that agree in doc_id and text are one row; a missing doc_id is a doc_id of its own; null
    and empty texts and texts without a run of words are as in ``near_classes``; very long texts are
    compared whole; an empty table gives no rows.
    """
    kept = near_classes(docs, least).filter("kept")
    kept = kept.select(row_key(F.col("doc_id"), F.col("text_key")).alias("_key"))
    keyed = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("_key"), whole_row(docs))
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
