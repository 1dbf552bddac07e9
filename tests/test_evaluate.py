import math

import pytest
from conftest import rows_of
from pyspark.errors import PySparkException

from corpuslab.operators import aggregate, evaluate

ROWS = [
    ("en", 1, 1, 0), ("en", 1, 0, 0), ("en", 0, 0, 1), ("en", 0, 0, 1),
    ("fr", 0, 0, 0), ("fr", 0, 0, 1), ("de", 0, 1, 0), ("de", 0, 0, 1),
]


def brute_f1(pairs):
    classes = {v for p in pairs for v in p}
    scores = []
    for c in classes:
        tp = sum(a == b == c for a, b in pairs)
        scores.append(2 * tp / sum((a == c) + (b == c) for a, b in pairs))
    return sum(scores) / len(scores)


@pytest.fixture
def predictions(frame):
    return frame(ROWS, "language string, label int, pred int, fold int")


def test_confusion_counts(predictions):
    assert rows_of(evaluate.confusion_counts(predictions, ["language"])) == [
        ("de", 0, 1, 2, 1), ("de", 1, 0, 0, 1), ("en", 0, 2, 2, 3), ("en", 1, 1, 2, 1), ("fr", 0, 2, 2, 2)
    ]


def test_macro_f1_leaves_out_absent_classes(predictions):
    found = {r["language"]: (r["f1"], r["n"]) for r in evaluate.macro_f1(predictions, ["language"]).collect()}
    for language in ("en", "fr", "de"):
        pairs = [(a, b) for lang, a, b, _ in ROWS if lang == language]
        assert found[language] == (pytest.approx(brute_f1(pairs)), len(pairs))
    assert found["fr"][0] == 1.0
    overall = evaluate.macro_f1(predictions, []).first()
    assert overall["f1"] == pytest.approx(brute_f1([(a, b) for _, a, b, _ in ROWS]))


def test_metrics_do_not_depend_on_partitions(predictions):
    a = rows_of(evaluate.experiment_report(predictions.repartition(5), ["fold"]))
    assert a == rows_of(evaluate.experiment_report(predictions.coalesce(1), ["fold"]))


def test_precision_and_recall_are_zero_when_undefined(predictions):
    rows = {r["language"]: r.asDict() for r in evaluate.precision_recall(predictions, ["language"]).collect()}
    assert rows["en"]["precision_0"] == pytest.approx(2 / 3) and rows["en"]["recall_1"] == 0.5
    assert rows["fr"]["precision_1"] == 0.0 and rows["fr"]["recall_1"] == 0.0


def test_language_averages(predictions):
    by_language = evaluate.macro_f1(predictions, ["language"])
    row = evaluate.language_average(by_language, []).first()
    scores = {r["language"]: (r["f1"], r["n"]) for r in by_language.collect()}
    assert row["f1_avg"] == pytest.approx(sum(f for f, _ in scores.values()) / 3)
    assert row["f1_weighted"] == pytest.approx(sum(f * n for f, n in scores.values()) / len(ROWS))


def test_support_shares_add_up(predictions):
    found = rows_of(aggregate.group_support_share(predictions, "language"))
    assert found == [("de", 2, 0.25), ("en", 4, 0.5), ("fr", 2, 0.25)]


def test_stacking_drops_empty_cells_and_uses_the_sample_deviation(predictions):
    scores = evaluate.fold_scores(predictions)
    wide = evaluate.folds_as_columns(evaluate.with_average_row(scores), [0, 1])
    long = evaluate.stack_folds(wide)
    assert long.count() == 8
    stats = {r["language"]: r for r in evaluate.fold_mean_std(long).collect()}
    values = [r["f1"] for r in long.filter("language = 'de'").collect()]
    mean = sum(values) / 2
    assert stats["de"]["f1_mean"] == pytest.approx(mean)
    assert stats["de"]["f1_std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values)))


def test_cv_report_order_and_missing_language(predictions):
    report = evaluate.cv_report(predictions, ["fr", "en", "de"]).collect()
    assert [r["row"] for r in report] == [
        "fr", "en", "de", "Weighted F1", "Avg. F1", "Precision Negative", "Precision Positive",
        "Recall Negative", "Recall Positive",
    ]
    assert sum(r["weight"] for r in report[:3]) == pytest.approx(1.0)
    assert report[5]["f1_mean"] == pytest.approx(5 / 6) and report[8]["f1_mean"] == 0.5
    with pytest.raises(PySparkException, match="no row for language it"):
        evaluate.cv_report(predictions, ["en", "it"]).collect()


def test_relative_drop_of_the_published_grid(frame):
    grid = [
        ("a", "a", 0.83), ("b", "b", 0.96), ("a", "b", 0.41), ("c", "a", 0.44), ("c", "b", 0.18), ("b", "a", 0.55)
    ]
    found = evaluate.relative_drop(frame(grid, "train string, test string, f1 double"))
    drops = {(r["train"], r["test"]): round(r["drop_percent"], 1) for r in found.collect()}
    assert drops[("a", "b")] == 57.3 and drops[("c", "a")] == 47.0
    assert drops[("b", "a")] == 33.7 and drops[("c", "b")] in (81.2, 81.3)
