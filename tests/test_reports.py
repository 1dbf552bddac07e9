from datetime import date

from conftest import rows_of

from corpuslab.operators import aggregate, topk


def test_value_counts_skip_null_and_sort(frame):
    df = frame([("a",), ("b",), ("b",), (None,)], "v string")
    assert [tuple(r) for r in aggregate.value_counts(df, "v").collect()] == [("b", 2), ("a", 1)]


def test_distinct_counts_with_and_without_null(frame):
    df = frame([("a", 1), ("a", 2), (None, 2)], "v string, w int")
    assert rows_of(aggregate.distinct_counts(df, ["v", "w"])) == [("v", 1), ("w", 2)]
    assert rows_of(aggregate.distinct_counts(df, ["v"], count_null=True)) == [("v", 2)]


def test_cases_per_group_use_present_pairs(frame):
    df = frame([(1, "x"), (1, "x"), (2, "x"), (2, "y"), (None, "x"), (3, None)], "g int, c string")
    assert rows_of(aggregate.cases_per_group(df, "g", "c")) == [("x", 1, 2, 1.5), ("y", 1, 1, 1.0)]


def test_share_is_null_for_an_absent_class(frame):
    df = frame([("a", "s"), ("a", "d"), ("b", "d"), (None, "s")], "l string, c string")
    assert [tuple(r) for r in aggregate.class_share(df, "l", "c", "s").collect()] == [("a", 0.5), ("b", None)]


def test_dense_counts_have_zeros(frame):
    df = frame([("a", "s"), ("b", "d"), ("b", "d")], "l string, c string")
    found = rows_of(aggregate.dense_language_class(df, "l", "c", ["d", "s"]))
    assert found == [("a", "d", 0), ("a", "s", 1), ("b", "d", 2), ("b", "s", 0)]


def test_quartiles_interpolate(frame):
    data = [(name, "d") for name, n in (("a", 1), ("b", 2), ("c", 4), ("d", 10)) for _ in range(n)]
    row = aggregate.language_quartiles(frame(data, "l string, c string"), "l", "c", ["d"]).first()
    assert tuple(row) == (1.75, 3.0, 5.5)


def test_date_span(frame):
    df = frame([(date(2021, 1, 30),), (date(2022, 2, 28),), (None,)], "d date")
    assert tuple(aggregate.date_span(df, "d").first()) == (date(2021, 1, 30), date(2022, 2, 28), 1, 1, 0)


def test_quarters_with_a_gap_and_an_unfinished_end(frame):
    days = [date(2020, 1, 5), date(2020, 8, 1), date(2020, 8, 2), date(2020, 11, 30)]
    df = frame([(d, "x") for d in days], "d date, c string")
    counts = aggregate.quarter_class_pivot(df, "d", "c", ["x", "y"])
    dense = aggregate.fill_quarters(counts, aggregate.quarter_spine(df, "d"))
    assert rows_of(dense) == [("2020-Q1", 1, 0), ("2020-Q2", 0, 0), ("2020-Q3", 2, 0)]
    assert rows_of(aggregate.seen_quarters(df, "d")) == [("2020-Q1",), ("2020-Q3",)]


def test_keyword_pivot_merges_spellings(frame):
    df = frame(
        [(date(2020, 1, 1), "virus / bacteria threat, NATO"), (date(2020, 4, 1), "Virus/bacteria threat"),
         (date(2020, 7, 1), None), (date(2020, 10, 1), "other")],
        "d date, k string",
    )
    shown = {"Virus / bacteria threat": "virus", "Virus/bacteria threat": "virus", "Nato": "NATO"}
    pivot = aggregate.quarter_keyword_pivot(df, "d", "k", shown, aggregate.seen_quarters(df, "d"))
    assert rows_of(pivot, "year_quarter", "virus", "NATO") == [
        ("2020-Q1", 1, 1), ("2020-Q2", 1, 0), ("2020-Q3", 0, 0)
    ]


def test_publisher_share(frame):
    df = frame([("ria.ru", "d"), ("x", "d"), ("ria.ru", "s"), (None, "d")], "p string, c string")
    assert tuple(aggregate.publisher_share(df, "p", "c", "d", "ria").first()) == (1, 2, 0.5)


def test_top_values_break_ties_by_value(frame):
    df = frame([(v,) for v in "ccbbaad"], "v string")
    assert [r["v"] for r in topk.top_values(df, "v", 2).collect()] == ["a", "b"]


def test_top_per_group_with_short_groups(frame):
    counts = frame([("x", "a", 1), ("x", "b", 3), ("x", "c", 3), ("y", "a", 9)], "g string, v string, n int")
    found = rows_of(topk.top_per_group(counts, "g", "v", "n", 2), "g", "v", "rank")
    assert found == [("x", "b", 1), ("x", "c", 2), ("y", "a", 1)]


def test_shares_with_others_add_up(frame):
    data = [("en", "a, b")] * 4 + [("fr", "a")] * 3 + [("de", "a")] * 2 + [("es", "a")] + [(None, "a")] + [("en", None)]
    df = frame(data, "l string, k string")
    found = rows_of(topk.topic_language_share(df, "k", "l", topics=2, languages=2), "keyword", "l", "n", "share")
    assert found == [("a", "Others", 3, 0.3), ("a", "en", 4, 0.4), ("a", "fr", 3, 0.3), ("b", "en", 4, 1.0)]


def test_percent_within_language(frame):
    data = [("en", "a"), ("en", "a, b"), ("en", "c"), ("fr", "b"), ("de", "a")]
    df = frame(data, "l string, k string")
    found = rows_of(topk.top_language_keywords(df, "k", "l", n_keywords=2, n_languages=2), "l", "keyword", "n")
    assert found == [("de", "a", 1), ("en", "a", 2), ("en", "b", 1)]


def test_leading_keywords_per_language(frame):
    data = [("en", "a,b,b"), ("en", "c"), ("fr", "z")]
    df = frame(data, "l string, k string")
    found = rows_of(topk.leading_keywords_by_language(df, "k", "l"), "l", "top1", "top2", "top3")
    assert found == [("en", "b", "a", "c"), ("fr", "z", None, None)]
