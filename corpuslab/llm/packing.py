"""Best-fit packing by a configuration linear program over the length histogram.

There are at most ``capacity`` different piece lengths, so the histogram and the plan stay small
whatever the number of pieces. The covering program (use as few sequences as hold all pieces; a
column is a multiset of lengths that fits) is solved by multiplicative weights: lengths that are
covered less weigh more, and a knapsack dynamic program prices columns, giving for every length the
most valuable column that holds it. The fractional solution is rounded down to whole sequences
within the stock, and what is left goes by best fit, longest first, with equal sequences handled as
one group. The plan lists, per column, how many sequences use it and which ranks of each length they
take. Pieces are ranked within their length by counts per task, so no task sees all pieces.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import chunk_encoder, staged

CAPACITY = 4096
END_ID = 1
ROUNDS = 16
# The cover may be larger than the dual bound by this part; else there are more rounds, up to a limit.
GAP = 0.01
MOST_ROUNDS = 64
# What is left after the rounds is covered in parts of a sequence this small.
PARTS = 64
PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def price(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value and last length taken (0: a unit left free) per capacity.

    ``values[l]`` is the worth of a piece of length ``l``; lengths that do not occur are worth -1.
    """
    capacity = len(values) - 1
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        offers = values[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(offers.argmax())
        if offers[k] > best[c - 1] + 1e-15:
            best[c], last[c] = offers[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, last


def column_with(length: int, last: np.ndarray) -> tuple[tuple[int, int], ...]:
    """The most valuable column that holds ``length``, as (length, number), longest first."""
    taken = Counter([length])
    c = len(last) - 1 - length
    while c > 0:
        if last[c]:
            taken[int(last[c])] += 1
            c -= int(last[c])
        else:
            c -= 1
    return tuple(sorted(taken.items(), reverse=True))


def threshold_worths(counts: dict[int, int], capacity: int) -> tuple[dict[int, float], float]:
    """Worths of lengths that no sequence can hold more than 1 of, and the bound they give.

    For a threshold k up to half the capacity, lengths above capacity - k are worth 1, those below k
    nothing, the others their part of a sequence; the k with the largest sum is taken.
    """
    lengths = np.array(sorted(counts))
    number = np.array([counts[n] for n in lengths.tolist()], float)
    best, chosen = -1.0, None
    for k in {0, *lengths[lengths <= capacity // 2].tolist(), *(capacity - lengths[2 * lengths > capacity] + 1).tolist()}:
        if 2 * k <= capacity + 1:
            worths = np.where(lengths > capacity - k, 1.0, np.where(lengths < k, 0.0, lengths / capacity))
            if worths @ number > best:
                best, chosen = float(worths @ number), worths
    return dict(zip(lengths.tolist(), chosen.tolist())), best


def weighted_rounds(
    counts: dict[int, int], worths: dict[int, float], capacity: int, rounds: int, rate: float
) -> tuple[dict[tuple[tuple[int, int], ...], float], dict[int, float], float]:
    """Column -> amount, the need left over, and the best dual bound of the pricings.

    In every round, each length is brought to its part of the need by the column that is best for
    it; the step of a column is as wide as its scarcest length allows.
    """
    lengths = sorted(counts)
    need = {n: float(counts[n]) for n in lengths}
    covered = dict.fromkeys(lengths, 0.0)
    amounts: dict[tuple[tuple[int, int], ...], float] = {}
    bound = 0.0
    for turn in range(1, rounds + 1):
        share = {n: covered[n] / need[n] for n in lengths}
        least = min(share.values())
        values = np.full(capacity + 1, -1.0)
        for n in lengths:
            if need[n] - covered[n] > 1e-9 * need[n]:
                # Worth less while it is covered more than others.
                values[n] = worths[n] * math.exp(-rate * rounds * (share[n] - least))
        best, last = price(values)
        if best[capacity] <= 0:
            break
        bound = max(bound, sum(need[n] * max(values[n], 0.0) for n in lengths) / best[capacity])
        for n in sorted(lengths, key=share.get):
            missing = need[n] * turn / rounds - covered[n]
            if missing <= 0:
                continue
            column = column_with(n, last)
            # No length is covered beyond its need.
            amount = min((need[m] - covered[m]) / k for m, k in column)
            amount = min(amount, missing / dict(column)[n])
            if amount > 0:
                amounts[column] = amounts.get(column, 0.0) + amount
                for m, k in column:
                    covered[m] += k * amount
    return amounts, {n: need[n] - covered[n] for n in lengths if need[n] - covered[n] > 1e-9}, bound


def fractional_columns(
    counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = 0.2
) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """(column -> amount, a lower bound of any cover); the amounts cover every length.

    The need that the rounds leave over is covered by best fit in parts of a sequence. The rounds
    are doubled until the cover is within ``GAP`` of the bound, up to ``MOST_ROUNDS``; of all covers,
    and of best fit alone, the smallest is taken.
    """

    def add_best_fit(amounts: dict, left: dict[int, float]) -> dict:
        for column, number in best_fit([], {n: math.ceil(k * PARTS) for n, k in left.items()}, capacity):
            merged: Counter[int] = Counter()
            for n, k in column:
                merged[n] += k
            key = tuple(sorted(merged.items(), reverse=True))
            amounts[key] = amounts.get(key, 0.0) + number / PARTS
        return amounts

    size = lambda amounts: sum(amounts.values())
    worths, bound = threshold_worths(counts, capacity)
    worths = {n: max(w, 0.1 * n / capacity) for n, w in worths.items()}
    alone = add_best_fit({}, counts)
    found = None
    while True:
        amounts, left, priced = weighted_rounds(counts, worths, capacity, rounds, rate)
        bound = max(bound, priced)
        amounts = add_best_fit(amounts, left)
        found = amounts if found is None or size(amounts) < size(found) else found
        if size(found) <= bound * (1 + GAP) or rounds >= MOST_ROUNDS:
            return min(found, alone, key=size), bound
        rounds *= 2


def round_columns(
    amounts: dict[tuple[tuple[int, int], ...], float], counts: dict[int, int], capacity: int, most_free: int
) -> tuple[list[tuple[list[tuple[int, int]], int]], dict[int, int]]:
    """Whole sequences (column, number) within the stock, fullest first, and the stock left.

    Columns with more than ``most_free`` units left free are not used.
    """
    left = dict(counts)
    made = []
    free = lambda column: capacity - sum(n * k for n, k in column)
    for column, amount in sorted(amounts.items(), key=lambda x: (free(x[0]), -x[1], x[0])):
        number = min([int(amount), *(left[n] // k for n, k in column)])
        if number > 0 and free(column) <= most_free:
            made.append((list(column), number))
            for n, k in column:
                left[n] -= k * number
    return made, {n: k for n, k in left.items() if k}


def best_fit(
    made: list[tuple[list[tuple[int, int]], int]], left: dict[int, int], capacity: int
) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, of the stock left into the free room of ``made`` and new sequences.

    Equal sequences are one group, which is split when only part of it takes a piece, so the work
    depends on the number of lengths and not on the number of pieces.
    """
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def put(column: list[tuple[int, int]], number: int) -> None:
        room = capacity - sum(n * k for n, k in column)
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((column, number))

    for column, number in made:
        put(column, number)
    for n in sorted(left, reverse=True):
        stock = left[n]
        while stock:
            at = bisect.bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                column, number = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, column = capacity, []
                number = -(-stock // (capacity // n))
            each = min(room // n, stock)
            full = min(number, stock // each)
            put(column + [(n, each)], full)
            stock -= full * each
            if number > full:
                if column:
                    put(column, number - full)
                elif stock:
                    put([(n, stock)], 1)
                    stock = 0
    return [entry for room in sorted(groups) for entry in groups[room]]


def sequences_of(
    counts: dict[int, int], capacity: int, rounds: int
) -> list[tuple[list[tuple[int, int]], int]]:
    """(column, number) of whole sequences: the fewest of the cover, rounded with all its columns or
    with the full ones and best fit for the rest, and of best fit alone."""
    cover, _ = fractional_columns(counts, capacity, rounds)
    starts = [round_columns(cover, counts, capacity, most_free) for most_free in (capacity // 256, capacity)]
    plans = [best_fit(made, left, capacity) for made, left in [*starts, ([], dict(counts))]]
    return min(plans, key=lambda plan: sum(number for _, number in plan))


def packing_plan(
    counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS
) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, first offset).

    Sorted by length and first rank. A piece of this length with rank r >= first rank is the
    ((r - first rank) mod pieces)-th of them in sequence first + (r - first rank) div pieces.
    """
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    if not counts:
        return np.zeros((0, 5), np.int64)
    rank = dict.fromkeys(counts, 0)
    rows = []
    first = 0
    for column, number in sequences_of(counts, capacity, rounds):
        offset = 0
        for n, k in column:
            rows.append((n, rank[n], k, first, offset))
            rank[n] += k * number
            offset += k * n
        first += number
    if rank != counts:
        raise AssertionError("the plan does not place every piece once")
    return np.array(sorted(rows), np.int64)


def _pieces(path: str, end_id: int, capacity: int):
    end = end_id.to_bytes(4, "little")
    fields = [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()),
        ("rank_in_part", pa.int64()),
    ]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        width = 4 * capacity
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            doc_ids, pieces, starts, lengths, crcs, parts, ranks = columns
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blob = encoder(text) + end
                for piece, low in enumerate(range(0, len(blob), width)):
                    bit = blob[low : low + width]
                    n = len(bit) // 4
                    doc_ids.append(doc_id)
                    pieces.append(piece)
                    starts.append(low // 4)
                    lengths.append(n)
                    crcs.append(zlib.crc32(bit))
                    parts.append(part)
                    ranks.append(seen[n])
                    seen[n] += 1
            yield pa.record_batch(
                [pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=schema
            )

    return run


def _place(plan, capacity: int):
    """Sequence and offset of ranked pieces; the plan is a broadcast array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        bits = 48
        keys = (rows[:, 0] << bits) | rows[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            found = np.searchsorted(keys, (length << bits) | rank, side="right") - 1
            turn = rank - rows[found, 1]
            each = rows[found, 2]
            yield pa.record_batch(
                [
                    *(batch.column(i) for i in range(5)),
                    pa.array(rows[found, 3] + turn // each),
                    pa.array(rows[found, 4] + turn % each * length),
                ],
                names=[
                    "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                ],
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    rounds: int = ROUNDS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Place all documents in as few sequences of ``capacity`` ids as it can.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents
    longer than a sequence are cut. A null text is empty and takes one id, the end id. Repeated and
    missing doc_ids are separate documents. Sequences are numbered from 0, and an empty table has
    none. The plan is built on the driver from at most ``capacity`` counts and broadcast; it has at
    most a few rows per length and round, whatever the number of pieces.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = staged(
        plain.mapInArrow(
            _pieces(tokenizer, end_id, capacity), f"{PIECE_SQL}, part int, rank_in_part long"
        ),
        "pieces",
    )
    by_part = staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(packing_plan(counts, capacity, rounds))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select(
        "part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift")
    )
    ranked = pieces.join(shifts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("rank_in_part") + F.col("_shift")).alias("rank"),
    )
    return ranked.mapInArrow(_place(plan, capacity), f"{PIECE_SQL}, sequence_id long, offset long")
