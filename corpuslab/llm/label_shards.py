"""Sharding by balanced label propagation.

Documents with one link key (by default equal texts) are neighbours. Every row starts in a shard of
its own by hash. In each round the rows of a key are counted per shard, which is one row per key and
shard; the shard that holds most of a key calls the others, and rows move there by joins within a
quota, the room that unlinked rows leave in that shard. Keys are let in by a hash order; a key that
is large against a shard is let in row by row instead, and one that would fill a shard is cut into
parts with neighbouring homes. No round sends a row away from its home. At the end every shard is brought to its exact size: rows are
numbered within their shard, linked ones first, and those beyond the size move to shards that lack
rows, so unlinked rows move first and then at most the end of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import staged
from corpuslab.operators.joins import weighted_lookup
from corpuslab.operators.ranking import global_rank

SHARDS = 8
ROUNDS = 8
# Steps of the hash order in which keys are let into a shard.
STEPS = 1024


def _step(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(STEPS)).cast("int")


def link_counts(rows: DataFrame) -> DataFrame:
    """link, shard and the number of rows; summed in the map tasks first."""
    return rows.groupBy("link", "shard").agg(F.count("*").alias("n"))


def cut_links(rows: DataFrame) -> int:
    """Rows that are not in the shard that holds most of their link key."""
    per_link = link_counts(rows).groupBy("link").agg((F.sum("n") - F.max("n")).alias("cut"))
    return per_link.agg(F.sum("cut")).first()[0] or 0


def propagate(rows: DataFrame, sizes: dict[int, int], rounds: int = ROUNDS) -> DataFrame:
    """Move linked rows (row, link, link_rows, shard) towards their neighbours' shards.

    ``sizes`` is the number of rows that each shard may hold; no shard gets more linked rows.
    Links are shared by two rows or more. Ends early when nothing moves.
    """
    # A key that covers more than 1/16 of a shard is let in by rows. Parts of a key that is too
    # large for a shard call their rows to shards side by side.
    large = F.col("link_rows") * 16 > min(sizes.values())
    first = F.xxhash64(F.substring_index("link", ":", 1))
    aside = F.pmod(first + F.substring_index("link", ":", -1).cast("long"), F.lit(len(sizes)))
    for _ in range(rounds):
        counts = staged(link_counts(rows), "link-counts")
        homes = counts.groupBy("link").agg(
            F.max_by("shard", F.struct("n", F.xxhash64("link", "shard"))).alias("home"),
            F.sum("n").alias("weight"),
        )
        home = F.when(F.col("link").contains(":"), aside.cast("int")).otherwise(F.col("home"))
        homes = staged(homes.withColumn("home", home), "homes")
        step = F.when(large, _step("row", "home")).otherwise(_step("link", "home"))
        seen = weighted_lookup(rows, homes, "link", "weight").withColumn("step", step)
        seen = staged(seen, "called")
        moving = F.col("home") != F.col("shard")
        # At most shards x STEPS rows.
        wanted = seen.filter(moving).groupBy("home", "step").agg(F.count("*").alias("n")).collect()
        if not wanted:
            break
        held = {r["shard"]: r["n"] for r in seen.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        limit = {}
        for shard, size in sizes.items():
            room = size - held.get(shard, 0)
            limit[shard] = 0
            for r in sorted((r for r in wanted if r["home"] == shard), key=lambda r: r["step"]):
                if r["n"] > room:
                    break
                room -= r["n"]
                limit[shard] = r["step"] + 1
        if not any(limit.values()):
            break
        bound = F.element_at(F.create_map(*[F.lit(int(x)) for e in limit.items() for x in e]), F.col("home"))
        rows = seen.withColumn(
            "shard", F.when(moving & (F.col("step") < bound), F.col("home")).otherwise(F.col("shard"))
        ).drop("home", "step")
        rows = staged(rows, "moved")
    return rows


def _ranges(spans: list[tuple[int, int, int, int]], at: Column, value: int) -> Column:
    """Of spans (low, high, shard, base): the shard, or the base plus the place within the span."""
    out = F.lit(None).cast("long")
    for low, high, shard, base in spans:
        inside = (at >= low) & (at < high)
        out = F.when(inside, F.lit(shard).cast("long") if value == 0 else at - low + base).otherwise(out)
    return out


def _even(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Exact sizes: adds slot, and moves the rows beyond a shard's size to shards that lack rows."""
    order = [F.col("shard"), F.col("link_rows") == 1, F.col("link"), F.col("row")]
    ranked = staged(global_rank(rows, order, "rank"), "numbered")
    held = {r["shard"]: r["n"] for r in ranked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    own, over, lack = [], [], []
    start = spare = filled = 0
    for shard, size in sizes.items():
        n = held.get(shard, 0)
        own.append((start, start + min(n, size), shard, 0))
        if n > size:
            over.append((start + size, start + n, shard, spare))
            spare += n - size
        else:
            lack.append((filled, filled + size - n, shard, n))
            filled += size - n
        start += n
    at = F.col("rank") - 1
    spared = _ranges(over, at, 1)
    return ranked.select(
        "row",
        F.coalesce(_ranges(own, at, 0), _ranges(lack, spared, 0)).cast("int").alias("shard"),
        F.coalesce(_ranges(own, at, 1), _ranges(lack, spared, 1)).cast("long").alias("slot"),
    )


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    rounds: int = ROUNDS,
    doc_id: str = "doc_id",
    text: str = "text",
    link: Column | None = None,
) -> DataFrame:
    """Every row with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``rows``: the numbers of rows of two shards differ by one at most, and the first shards hold
    the larger number. ``link`` is the key that neighbours share, by default the text; a null text
    counts as empty, and its size is 1. A null link key links nothing. Repeated and missing doc_ids
    are rows of their own. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.sha2(body if link is None else link.cast("string"), 256)
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        key.alias("link"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = staged(base, "shard-rows")
    total = base.count()
    sizes = {s: total // shards + (s < total % shards) for s in range(shards)}
    groups = base.filter(F.col("link").isNotNull()).groupBy("link").agg(F.count("*").alias("link_rows"))
    groups = staged(groups.filter("link_rows > 1"), "links")
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    narrow = base.select("row", "link", start.alias("shard"))
    # Links of one row need no propagation; hot keys meet a broadcast of fewer than 1000 rows.
    known = weighted_lookup(narrow, groups.withColumn("w", F.col("link_rows")), "link", "w", "left")
    known = staged(
        known.withColumn("link_rows", F.coalesce("link_rows", F.lit(1).cast("long"))), "known"
    )
    # A key that would fill a shard is cut into parts of three quarters of a shard.
    parts = F.ceil(F.col("link_rows") / F.lit(max(0.75 * total / shards, 1.0)))
    part = F.pmod(F.xxhash64("row", F.lit(1)), parts).cast("string")
    split = F.when(parts > 1, F.concat("link", F.lit(":"), part)).otherwise(F.col("link"))
    linked = staged(known.filter("link_rows > 1").withColumn("link", split), "linked")
    if total:
        linked = _within(linked, sizes)
        linked = propagate(linked, sizes, rounds)
    placed = _even(linked.unionByName(known.filter("link_rows = 1")), sizes)
    return base.join(placed, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _within(linked: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Linked rows as dealt, or dealt anew in exact portions if a shard has too many of them."""
    held = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    if all(held.get(s, 0) <= n for s, n in sizes.items()):
        return linked
    ranked = global_rank(linked, [F.xxhash64("row"), F.col("row")], "rank")
    dealt = F.pmod(F.col("rank") - 1, F.lit(len(sizes))).cast("int")
    return staged(ranked.withColumn("shard", dealt).drop("rank"), "dealt")
