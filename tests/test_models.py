import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from corpuslab.functions.text import term_counts
from corpuslab.operators import bow, models, naive_bayes, score, svm
from corpuslab.plans import experiments
from corpuslab.staging import work_path

WORDS = ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]


def documents(n):
    """Texts whose first word leans towards the label; some share no word with any other."""
    rows = []
    for i in range(n):
        label = int(i % 4 == 0)
        words = [WORDS[(i * j + label) % 7] for j in range(1, 2 + i % 6)] + (["zz"] if label else [])
        text = f"only{i}" if i % 19 == 0 else " ".join(words)
        rows.append((i, text, label, "en" if i % 3 else "fr"))
    return rows


def brute_force(train, test, alpha):
    """Scores per document, as a plain multinomial naive Bayes."""
    counts = {0: Counter(), 1: Counter()}
    docs = Counter(r[2] for r in train)
    for _, text, label, _ in train:
        counts[label].update(re.findall(r"\w{2,}", text))
    vocabulary = set(counts[0]) | set(counts[1])
    out = {}
    for i, text, _, _ in test:
        known = [w for w in re.findall(r"\w{2,}", text) if w in vocabulary]
        out[i] = [
            math.log(docs[c] / len(train))
            + sum(
                math.log((counts[c][w] + alpha) / (sum(counts[c].values()) + alpha * len(vocabulary)))
                for w in known
            )
            for c in (0, 1)
        ]
    return out


SCHEMA = "id long, t string, label int, language string"


def test_scores_equal_brute_force(frame):
    rows = documents(200)
    df = frame(rows, SCHEMA).withColumn("split", F.when(F.col("id") % 10 == 3, "test").otherwise("train"))
    model = naive_bayes.Model("m", F.col("split") == "train", F.col("split") == "test")
    found = naive_bayes.predict(df, [model], "id", "t", "label", "language", [0.1, 1.0]).collect()
    train = [r for r in rows if r[0] % 10 != 3]
    test = [r for r in rows if r[0] % 10 == 3]
    assert len(found) == 2 * len(test)
    for alpha in (0.1, 1.0):
        expected = brute_force(train, test, alpha)
        for row in (r for r in found if r["alpha"] == alpha):
            assert row["scores"] == pytest.approx(expected[row["id"]])
            assert row["pred"] == int(np.argmax(expected[row["id"]]))


def test_all_folds_in_one_pass_equal_fold_by_fold(frame):
    rows = documents(120)
    df = frame(rows, SCHEMA).withColumn("fold", (F.col("id") % 5).cast("int"))
    found = naive_bayes.predict(df, naive_bayes.fold_models(5), "id", "t", "label", "language", [0.5])
    scores = {r["id"]: r["scores"] for r in found.collect()}
    assert len(scores) == 120
    for fold in range(5):
        expected = brute_force(
            [r for r in rows if r[0] % 5 != fold], [r for r in rows if r[0] % 5 == fold], 0.5
        )
        for i, values in expected.items():
            assert scores[i] == pytest.approx(values)


def test_document_scored_by_several_models(frame):
    df = frame(documents(30), SCHEMA)
    models = [naive_bayes.Model(n, F.col("id") > b, F.col("id") <= 5) for n, b in (("x", 5), ("y", 15))]
    found = naive_bayes.predict(df, models, "id", "t", "label", "language", [1.0])
    assert found.groupBy("model").count().count() == 2 and found.count() == 12


def test_class_without_training_documents_never_wins(frame):
    df = frame([(1, "aa", 0, "en"), (2, "aa", 1, "en")], SCHEMA)
    model = naive_bayes.Model("m", F.col("id") == 1, F.col("id") == 2)
    assert naive_bayes.predict(df, [model], "id", "t", "label", "language", [1.0]).first()["pred"] == 0


def test_best_parameters(frame):
    scores = frame([(0.1, 2, 0.5), (0.01, 1, 0.5), (1.0, 3, 0.2)], "alpha double, position int, score double")
    assert naive_bayes.best_parameters(scores).first()["alpha"] == 0.01
    assert naive_bayes.best_parameters(scores.withColumn("score", F.lit(0.0))).first() is None


def test_main_experiment_reports_languages_and_average(frame):
    df = frame(documents(150), SCHEMA).withColumnRenamed("t", "text")
    df = df.withColumn("split", F.when(F.col("id") % 10 == 7, "test").otherwise("train"))
    table, best = experiments.main_experiment(df, "id", k=5)
    assert [r[0] for r in rows_of(table, "language")] == ["Average", "en", "fr"]
    assert best.count() == 1


def svm_documents(n):
    """Documents with words in common and a label that some words suggest."""
    rows = []
    for i in range(n):
        words = ["the", "of"] * (1 + i % 3) + [f"w{(i * k) % 23}" for k in range(1, 6)]
        rows.append((i, " ".join(words + (["bad"] if i % 7 < 3 else ["fine"] * (i % 2))), int(i % 7 < 3 or i % 11 == 0), "en" if i % 2 else "fr"))
    return rows


def primal(rows, weights, cost):
    total = sum(w * w for w in weights.values()) / 2
    for _, text, label, _ in rows:
        margin = weights.get("", 0.0) + sum(weights.get(w, 0.0) for w in re.findall(r"\w\w+", text))
        total += cost * max(0.0, 1 - (1 if label else -1) * margin)
    return total


def best_primal(rows, cost, steps=60_000):
    """A long averaged subgradient descent on the same objective."""
    words = sorted({w for _, t, _, _ in rows for w in re.findall(r"\w\w+", t)})
    x = np.array([[1.0, *[len(re.findall(rf"\b{w}\b", t)) for w in words]] for _, t, _, _ in rows])
    y = np.array([1.0 if r[2] else -1.0 for r in rows])
    value = lambda w: w @ w / 2 + cost * np.maximum(0, 1 - y * (x @ w)).sum()
    w, best = np.zeros(x.shape[1]), math.inf
    for step in range(1, steps + 1):
        w = w - (w - cost * ((y * (x @ w) < 1) * y) @ x) / (step + 100)
        if step % 10 == 0:
            best = min(best, value(w))
    return best


@pytest.mark.parametrize("block_rows", [1000, 20])
def test_linear_svm_reaches_the_optimum(frame, block_rows):
    """One block and several blocks: the proven gap, and a long descent on the same objective."""
    rows = svm_documents(90)
    df = frame(rows, SCHEMA)
    every = naive_bayes.Model("all", F.lit(True), F.lit(False))
    costs = [0.01, 0.3]
    fitted = svm.LinearSvm(svm.vectors_of(df, [every], "id", "t", "label"), 1, costs, block_rows=block_rows)
    assert max(fitted.gaps) <= svm.TOLERANCE
    assert fitted.blocks == (1 if block_rows == 1000 else 5)
    table = {r["term"]: r["w"] for r in fitted.weights.collect()}
    for m, cost in enumerate(costs):
        found = primal(rows, {t: w[m] for t, w in table.items()}, cost)
        assert found <= best_primal(rows, cost) * (1 + svm.TOLERANCE) + 1e-9


def test_linear_svm_warns_when_it_stops_early(frame):
    every = naive_bayes.Model("all", F.lit(True), F.lit(False))
    vectors = svm.vectors_of(frame(svm_documents(60), SCHEMA), [every], "id", "t", "label")
    with pytest.warns(UserWarning, match="gap"):
        fitted = svm.LinearSvm(vectors, 1, [1.0], block_rows=10, max_rounds=1)
    assert fitted.gaps[0] > svm.TOLERANCE


def test_linear_svm_predicts_separable_labels(frame):
    rows = [(i, "good news" if i % 2 else "bad lies", i % 2, "en") for i in range(40)]
    df = frame(rows + [(40, None, 1, "en"), (41, "", 0, "en"), (42, "good news", None, "en")], SCHEMA)
    split = df.withColumn("split", F.when(F.col("id") < 30, "train").otherwise("test"))
    model = naive_bayes.Model("split", F.col("split") == "train", F.col("split") == "test")
    found = svm.train_and_predict(split, [model], "id", "t", "label", "language", [0.1, 1.0])
    assert found.count() == 24 and found.filter("pred != label AND id < 40").count() == 0
    known = split.filter("id < 40")
    scores = svm.grid_search(known, "id", "t", "label", "language", costs=[0.1, 1.0])
    assert rows_of(scores) == [(0.1, 1, 1.0), (1.0, 2, 1.0)]


def test_svm_folds_equal_single_fits(frame):
    """All folds in one fit give what every fold gives alone; a fold without training rows is class 0."""
    df = frame(svm_documents(60), SCHEMA).withColumn("fold", (F.col("id") % 3).cast("int"))
    models_ = [*naive_bayes.fold_models(3), naive_bayes.Model("none", F.lit(False), F.col("id") == 5)]
    together = svm.train_and_predict(df, models_, "id", "t", "label", "language", [0.1])
    found = {(r["model"], r["id"]): (r["margin"], r["pred"]) for r in together.collect()}
    assert found.pop(("none", 5)) == (0.0, 0)
    for model in models_[:3]:
        alone = svm.train_and_predict(df, [model], "id", "t", "label", "language", [0.1])
        for r in alone.collect():
            assert found[r["model"], r["id"]] == (pytest.approx(r["margin"], abs=1e-9), r["pred"])


def test_products_of_documents():
    draw = np.random.default_rng(4)
    dense = draw.integers(0, 4, (40, 60)) * (draw.random((40, 60)) < draw.random(60) ** 4)
    documents, terms = np.nonzero(dense)
    assert (svm.products(documents, terms, dense[documents, terms], 40) == dense @ dense.T).all()


def test_descent_without_products_finds_the_optimum():
    """Sparse sweeps come to the same dual objective as greedy ascent on the products, within their tolerance."""
    draw = np.random.default_rng(6)
    dense = np.c_[np.ones(80, int), draw.integers(0, 3, (80, 25)) * (draw.random((80, 25)) < 0.4)]
    y, zeros = np.where(draw.random(80) < 0.3, 1.0, -1.0), np.zeros(80)
    documents, terms = np.nonzero(dense)
    gram = (dense @ dense.T).astype(float)
    for cost in (0.01, 0.3):
        values = []
        for dual in (
            svm.descend(documents, terms, dense[documents, terms], y, zeros, zeros, cost, 1.0, 0.001),
            svm.ascend(gram, y, zeros, zeros, cost, 1.0, 0.001),
        ):
            assert dual.min() >= 0 and dual.max() <= cost
            values.append(dual.sum() - (dual * y) @ gram @ (dual * y) / 2)
        assert values[0] == pytest.approx(values[1], rel=0.002)


def test_many_blocks_need_few_rounds(frame):
    """A working set of several blocks: the rounds do not grow with the number of blocks."""
    every = naive_bayes.Model("all", F.lit(True), F.lit(False))
    vectors = svm.vectors_of(frame(svm_documents(240), SCHEMA), [every], "id", "t", "label")
    fitted = svm.LinearSvm(vectors, 1, [0.05], block_rows=20, max_rounds=5)
    assert fitted.blocks == 12 and max(fitted.gaps) <= svm.TOLERANCE


def test_scaled_weights_prove_what_is_solved_at_a_high_cost():
    """Losses of documents just inside their margin hide a dual solution that is good; a factor of the weights shows it."""
    draw = np.random.default_rng(9)
    dense = np.c_[np.ones(200, int), draw.integers(0, 3, (200, 400)) * (draw.random((200, 400)) < 0.1)]
    y, zeros, cost = np.where(dense[:, 1:20].sum(axis=1) > 2, 1.0, -1.0), np.zeros(200), 10.0
    documents, places = np.nonzero(dense)
    dual = svm.descend(documents, places, dense[documents, places], y, zeros, zeros, cost, 1.0, 0.01)
    w = dense.T @ (dual * y)
    value = lambda w: w @ w / 2 + cost * np.maximum(0, 1 - y * (dense @ w)).sum()
    least, scale = svm._primal(w @ w, svm._hinges(y * (dense @ w), svm.SCALES), cost, svm.SCALES)
    assert least == pytest.approx(value(scale * w)) and least < value(w)
    assert 0 <= least - (dual.sum() - w @ w / 2) <= 0.011 * least


def test_words_of_a_part_are_counted_and_numbered():
    part = pa.table({
        "part": pa.array([3, 3, 3], pa.int32()), "id": [7, 5, 6], "label": pa.array([1, 0, 1], pa.int32()), "trains": [[True]] * 3,
        "scored": [False] * 3, "words": [" bb aa bb", "", " aa"],
    })
    rows = svm._counted(part).to_pylist()
    words = [r for r in rows if r["place"] is not None]
    assert sorted(r["term"] for r in words) == ["", "aa", "bb"] and {r["part"] for r in words} == {3}
    number = {"": 40, "aa": 1 << 40, "bb": 2}
    numbers = pa.table({"place": [r["place"] for r in words], "number": pa.array([number[r["term"]] for r in words], pa.int64())})
    documents = svm._counted(part).filter(pa.array([r["place"] is None for r in rows])).drop_columns(["term", "place"])
    found = svm._numbered(documents, numbers).to_pylist()
    entries = {r["id"]: (np.frombuffer(r["numbers"], np.int64).tolist(), np.frombuffer(r["counts"], np.int32).tolist(), r["entries"]) for r in found}
    assert entries == {7: ([2, 40, 1 << 40], [2, 1, 1], 3), 5: ([40], [1], 1), 6: ([40, 1 << 40], [1, 1], 2)}


def test_a_working_set_is_bounded_in_entries(frame, monkeypatch):
    """A set holds no more words of documents than asked for, whatever the number of documents and models."""
    chosen = []
    monkeypatch.setattr(svm, "WORKING_ENTRIES", 100)
    monkeypatch.setattr(svm, "stage", lambda df, name, made=svm.stage: chosen.append((name, made(df, name))) or chosen[-1][1])
    rows = svm_documents(60)
    every = naive_bayes.Model("all", F.lit(True), F.lit(False))
    vectors = svm.vectors_of(frame(rows, SCHEMA), [every], "id", "t", "label")
    with pytest.warns(UserWarning, match="gap"):
        svm.LinearSvm(vectors, 1, [0.05, 1.0], block_rows=30, max_rounds=1)
    words = {r[0]: 1 + len(set(r[1].split())) for r in rows}
    sets = [rows_of(df, "model", "id") for name, df in chosen if name == "svm-chosen"]
    assert sets and all({m for m, _ in s} == {0, 1} for s in sets)
    assert all(50 < sum(words[i] for k, i in s if k == m) <= 100 for s in sets for m in (0, 1))


def test_a_block_has_one_product_for_all_models(monkeypatch):
    """Costs and folds share the products of a block, and each is solved as it would be alone."""
    draw = np.random.default_rng(5)
    dense = np.c_[np.ones(30, int), draw.integers(0, 3, (30, 12))]
    label, costs = draw.integers(0, 2, 30), [0.05, 0.3, 0.3]
    used = np.stack([np.ones(30, bool), np.ones(30, bool), np.arange(30) % 3 > 0], axis=1)
    block = pa.table({
        "block": pa.array([0] * 30, pa.int32()), "id": list(range(30)), "label": pa.array(label, pa.int32()),
        "trains": used.tolist(), "places": [np.flatnonzero(r).tolist() for r in dense], "counts": [r[r > 0].tolist() for r in dense],
        "duals": [[0.0] * 3] * 30,
    })
    calls = []
    monkeypatch.setattr(svm, "products", lambda *a, made=svm.products: calls.append(1) or made(*a))
    found = svm._round_of(costs, [0, 1, 2], 1.0, [0.001] * 3, True)(block, pa.table({})).to_pylist()
    assert len(calls) == 1
    duals = np.array([r["duals"] for r in found if r["id"] is not None])
    y = np.where(label == 1, 1.0, -1.0)
    for m, cost in enumerate(costs):
        u = used[:, m]
        zeros = np.zeros(u.sum())
        alone = svm.ascend((dense @ dense.T).astype(float)[np.ix_(u, u)], y[u], zeros, zeros, cost, 1.0, 0.001)
        assert (duals[u, m] == alone).all() and (duals[~u, m] == 0).all()
    steps = np.zeros((13, 3))
    for r in found:
        if r["place"] is not None:
            steps[r["place"]] = r["step"]
    assert steps == pytest.approx(dense.T @ (duals * y[:, None]))


def test_term_counts_of_a_row(frame):
    texts = ["b a b a b cc dd cc", "", None, "x y", "Éé éé ÉÉ Zz zz", "same same", "one"]
    df = frame([(i, t.replace("b", "bb").replace("a", "aa") if t else t) for i, t in enumerate(texts)], "id long, t string")
    entries = F.explode(term_counts(F.col("t"))).alias("e")
    assert rows_of(df.select("id", entries).select("id", "e.*")) == rows_of(bow.bow_counts(df, "id", "t"))
    found = df.select("id", term_counts(F.col("t")).alias("c")).orderBy("id").collect()
    assert [r["c"] for r in found][1:4] == [[], None, []]


def test_stored_models_are_applied_elsewhere(spark, frame):
    """Both kinds, read back, score other articles; odd texts; versions and kinds are checked."""
    rows = svm_documents(60)
    df = frame(rows, SCHEMA)
    other = frame([(100, "the bad bad w3"), (101, "fine of"), (102, None), (103, ""), (104, "unheard")], "id long, t string")
    for fitted in (models.fit_naive_bayes(df, "t", "label", 0.5), models.fit_linear_svm(df, "id", "t", "label", 0.1)):
        path = work_path(spark, "test-model")
        models.save_model(fitted, path)
        models.save_model(fitted, path)
        loaded = models.load_model(spark, path)
        assert (loaded.kind, loaded.classes, loaded.parameter) == (fitted.kind, (0, 1), fitted.parameter)
        found = {r["id"]: (r["pred"], r["scores"]) for r in models.apply_model(loaded, other, "id", "t").collect()}
        assert found[100][0] == 1 and found[101][0] == 0 and len(found) == 5
        assert found[102][1] == found[103][1] == found[104][1]
        own = {r["id"]: r["pred"] for r in models.apply_model(loaded, df, "id", "t").collect()}
        assert sum(own[r[0]] == r[2] for r in rows) >= 50
        known = spark.read.schema(models.MODEL_METADATA).json(f"{path}/metadata")
        newer = known.withColumn("version", F.lit(2)).collect()
        spark.createDataFrame(newer, models.MODEL_METADATA).write.mode("overwrite").json(f"{path}/metadata")
        with pytest.raises(ValueError, match="version"):
            models.load_model(spark, path)
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, work_path(spark, "no-model"))
    with pytest.raises(ValueError, match="kind"):
        models.TextModel("tree", (0, 1), 1.0, (), (), 0, df)


def test_main_experiment_of_the_svm(frame):
    df = frame(svm_documents(90), SCHEMA).withColumnRenamed("t", "text")
    df = df.withColumn("split", F.when(F.col("id") % 10 == 7, "test").otherwise("train"))
    table, best = experiments.main_experiment(df, "id", k=3, classifier="linear_svm", costs=[0.01, 0.1])
    assert [r[0] for r in rows_of(table, "language")] == ["Average", "en", "fr"]
    assert best.first()["cost"] in (0.01, 0.1)
    with pytest.raises(ValueError):
        experiments.main_experiment(df, "id", classifier="other")


def test_batch_score_uses_the_given_scorer(frame):
    df = frame([(1, "a"), (2, "bbb"), (3, None)], "id long, t string").repartition(3)

    def make():
        def scorer(texts: pd.Series) -> np.ndarray:
            n = texts.fillna("").str.len().to_numpy()
            return np.stack([np.ones(len(n)), n / 2], axis=1)

        return scorer

    found = rows_of(score.batch_score(df, make, "id", "t"), "id", "pred")
    assert found == [(1, 0), (2, 1), (3, 0)]


def test_term_weights_hold_every_term(spark, frame):
    from corpuslab.operators import score
    from corpuslab.staging import work_path

    train = frame([(1, "aa bb bb", 0), (2, "cc", 1), (3, None, 1)], "id long, t string, y int")
    path = work_path(spark, "weights")
    score.term_weights(train, "t", "y").write.parquet(path)
    weights = spark.read.parquet(path)
    assert sorted(r["term"] for r in weights.collect()) == ["aa", "bb", "cc"]
    texts = [(7, "bb unknown"), (8, "cc cc"), (9, None), (10, "")]
    other = frame(texts, "id long, t string")
    found = {r["id"]: (r["pred"], r["scores"]) for r in score.score_terms(other, weights, "id", "t").collect()}
    assert [found[i][0] for i in (7, 8)] == [0, 1]
    assert found[9][1] == found[10][1] == [0.0, 0.0]


def test_views_do_not_deal_texts_anew(spark):
    from corpuslab.plans import views

    for view in (views.articles, views.labelled, views.debunk_texts, views.crawl_base):
        frame = view(spark, "/root/testdata/sf0.001")
        assert "RoundRobin" not in frame._jdf.queryExecution().executedPlan().toString()


def test_score_terms_counts_inside_the_row(spark, frame, monkeypatch):
    """The words of a text are counted without an aggregate over (id, term)."""
    staged = []
    monkeypatch.setattr(score, "stage", lambda df, name, made=score.stage: staged.append(df) or made(df, name))
    df = frame([(1, "aa bb aa"), (2, None), (3, "zz"), (4, "bb AA")], "id long, t string")
    weights = frame([("aa", 1.0, 0.5), ("bb", 0.0, 2.0)], "term string, s0 double, s1 double")
    found = score.score_terms(df, weights, "id", "t")
    assert [(r["id"], r["scores"]) for r in found.orderBy("id").collect()] == [
        (1, [2.0, 3.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 2.5])
    ]
    assert "Aggregate" not in staged[0]._jdf.queryExecution().optimizedPlan().toString()
