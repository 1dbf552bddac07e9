import hashlib
from collections import Counter
from math import ceil

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from corpuslab.operators import ranking, splits


def key(row_id, seed=42):
    return hashlib.md5(f"{seed}|{row_id}".encode()).hexdigest()


def expected_split(rows, share=0.1):
    """Brute force over (id, stratum) pairs: largest remainder, then md5 order."""
    n = len(rows)
    n_train = n - ceil(n * share)
    sizes = Counter(s for _, s in rows)
    base = {s: c * n_train // n for s, c in sizes.items()}
    order = sorted(sizes, key=lambda s: (-(sizes[s] * n_train % n), s))
    for s in order[: n_train - sum(base.values())]:
        base[s] += 1
    out = {}
    for s in sizes:
        ranked = sorted((r for r, t in rows if t == s), key=key)
        out |= {r: "train" if i < base[s] else "test" for i, r in enumerate(ranked)}
    return out


def skewed(n):
    """A third of the rows and more in one stratum, and strata of one row."""
    return [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(n)] + [(n, "lone"), (n + 1, "single")]


@pytest.mark.parametrize("n", [1, 9, 10, 57, 2003])
def test_stratified_split_equals_brute_force(frame, n):
    rows = skewed(n)
    found = splits.train_test_split(frame(rows, "id long, s string"), "id", ["s"])
    assert dict(rows_of(found, "id", "split")) == expected_split(rows)


def test_plain_split_has_the_exact_size(frame):
    found = splits.train_test_split(frame([(i,) for i in range(101)], "id long"), "id")
    assert Counter(s for _, s in rows_of(found)) == {"train": 90, "test": 11}
    assert dict(rows_of(found)) == expected_split([(i, "") for i in range(101)])


def test_empty_input_gives_empty_parts(frame):
    df = frame([], "id long, s string")
    for found in (splits.train_test_split(df, "id"), splits.train_test_split(df, "id", ["s"])):
        assert found.count() == 0 and dict(found.dtypes)["split"] == "string"


def test_split_within_parts_equals_separate_splits(frame):
    rows = [(i, f"d{i % 2}", f"s{i % 5}") for i in range(233)]
    df = frame(rows, "id long, d string, s string")
    found = dict(rows_of(splits.train_test_split(df, "id", ["s"], within="d"), "id", "split"))
    for d in ("d0", "d1"):
        part = [(i, s) for i, name, s in rows if name == d]
        assert {i: found[i] for i, _ in part} == expected_split(part)


def test_null_stratum_is_a_stratum(frame):
    df = frame([(i, None if i % 2 else "x") for i in range(40)], "id long, s string")
    assert splits.train_test_split(df, "id", ["s"]).count() == 40


def test_split_does_not_depend_on_partitions(frame):
    df = frame(skewed(500), "id long, s string")
    a = rows_of(splits.train_test_split(df.repartition(7), "id", ["s"]), "id", "split")
    b = rows_of(splits.train_test_split(df.coalesce(1), "id", ["s"]), "id", "split")
    assert a == b


@pytest.mark.parametrize("n,k", [(7, 10), (103, 10), (1000, 3)])
def test_folds_are_balanced_in_total_and_per_stratum(frame, n, k):
    rows = skewed(n)
    found = splits.stratified_folds(frame(rows, "id long, s string"), "id", ["s"], k).collect()
    assert sorted(r["id"] for r in found) == sorted(i for i, _ in rows)

    def spread(counts):
        values = [counts.get(f, 0) for f in range(k)]
        return max(values) - min(values)

    assert spread(Counter(r["fold"] for r in found)) <= 1
    for stratum in {s for _, s in rows}:
        assert spread(Counter(r["fold"] for r in found if r["s"] == stratum)) <= 1


def test_global_rank_over_many_partitions(spark, frame):
    df = spark.range(5000).select("id", (F.col("id") % 10).alias("v")).repartition(9)
    ranked = ranking.global_rank(df, [F.desc("v"), F.col("id")]).collect()
    expected = sorted(((r["v"], r["id"]) for r in ranked), key=lambda p: (-p[0], p[1]))
    assert [p for p in sorted(ranked, key=lambda r: r["rank"])] and [
        (r["v"], r["id"]) for r in sorted(ranked, key=lambda r: r["rank"])
    ] == expected
    assert sorted(r["rank"] for r in ranked) == list(range(1, 5001))


def test_temporal_split_has_no_side_for_missing_dates(frame):
    df = frame([(1, "31-12-1998"), (2, "1-1-1999"), (3, None)], "id int, d string")
    found = rows_of(splits.temporal_split(df, "d", [("e", "01-01-1999")]), "id", "event", "split")
    assert found == [(1, "e", "train"), (2, "e", "test")]


def test_topic_holdout(frame):
    topics = {"a": ["x", "eu/nato"], "b": ["y"]}
    df = frame(
        [(1, "X , y"), (2, "EU/NATO"), (3, "unknown"), (4, None), (5, "y, Y")], "id int, k string"
    )
    found = rows_of(splits.topic_holdout(df, "k", topics), "id", "held_out", "split")
    assert found == [
        (1, "a", "test"), (1, "b", "test"), (2, "a", "test"), (2, "b", "train"),
        (5, "a", "train"), (5, "b", "test"),
    ]
    assert [r[0] for r in rows_of(splits.rows_with_topic(df, "k", topics))] == [1, 2, 5]
