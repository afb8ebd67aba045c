"""Curves against brute force, learners, thresholds, persistence, hard cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelquality.operators import curves as cv, hard_cases as hc, trust as tr
from labelquality.sources.shared import shared_dir

YES = "y = 1"


def scores(spark, n=3000, distinct=700, seed=1):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, distinct, n) / distinct
    y = (rng.random(n) < 0.2 + 0.5 * s).astype(int)
    s[: n // 3] = s[0]  # a third of all rows share one score
    return s, y, spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")


def brute_curve(s, y):
    out = []
    for t in np.unique(s):
        a = s >= t
        out.append((t, y[a].mean(), y[a].sum() / y.sum()))
    return out


@pytest.mark.parametrize("rows_per_range", [1_000_000, 50, 3])
def test_curves(spark, rows_per_range):
    """Any number of score ranges gives the same curve."""
    s, y, df = scores(spark)
    want = brute_curve(s, y)
    got = cv.pr_curve(df, "s", F.expr(YES), rows_per_range).orderBy("threshold").collect()
    assert [r.threshold for r in got] == [w[0] for w in want]
    assert np.allclose([(r.precision, r.recall) for r in got], [w[1:] for w in want])
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert cv.roc_auc(df, "s", F.expr(YES), rows_per_range).first().roc_auc == pytest.approx(auc)
    t, p, r = map(np.array, zip(*want))
    f1 = 2 * p * r / (p + r + 1e-8)
    best = cv.best_f1_threshold(df, "s", F.expr(YES), rows_per_range).first()
    assert best.threshold == t[np.argmax(f1)] and best.f1_score == pytest.approx(f1.max())
    gain = -np.diff(np.append(r, 0.0))
    m = cv.curve_metrics(df, "s", F.expr(YES), rows_per_range).first()
    assert m.pr_auc == pytest.approx((gain * p).sum()) == cv.average_precision(df, "s", F.expr(YES), rows_per_range).first()[0]
    assert m.precision_at_90_recall == pytest.approx(p[r >= 0.9].max()) and m.precision_at_95_recall == pytest.approx(p[r >= 0.95].max())
    assert m.roc_auc == pytest.approx(auc)


def test_best_threshold_prefers_the_lowest(spark):
    df = spark.createDataFrame([(0.2, 1), (0.4, 0), (0.6, 0), (0.8, 1)], "s double, y int")
    # accepting all and accepting only 0.8 have the same F1 of 2/3
    assert cv.best_f1_threshold(df, "s", F.expr(YES)).first().threshold == 0.2


def test_degenerate_curves(spark):
    ones = spark.createDataFrame([(0.2, 1), (0.4, 1)], "s double, y int")
    assert cv.roc_auc(ones, "s", F.expr(YES)).first()[0] is None
    empty = ones.filter("false")
    assert cv.pr_curve(empty, "s", F.expr(YES)).count() == 0 and cv.roc_auc(empty, "s", F.expr(YES)).first()[0] is None
    none = spark.createDataFrame([(0.2, 0), (0.4, 0)], "s double, y int")
    assert [r.recall for r in cv.pr_curve(none, "s", F.expr(YES)).collect()] == [1.0, 1.0]


def test_regions_eval_decision(spark):
    s, y, df = scores(spark)
    got = {r.threshold: r for r in tr.confidence_regions(df, [0.9, 0.1, 0.5], "s", "y").collect()}
    for t, r in got.items():
        a = s >= t
        assert (r.coverage, r.accepted_accuracy, r.review_count) == pytest.approx((a.mean(), y[a].mean(), (~a).sum()))
    e = tr.trust_eval(df, 0.5, "s", "y").first()
    d = s >= 0.5
    assert e.accuracy == pytest.approx((d == (y == 1)).mean()) and e.recall == pytest.approx(d[y == 1].mean())
    edge = spark.createDataFrame([(0.5,), (0.49999,)], "trust_score double")
    assert [r.trust_decision for r in tr.trust_decision(edge).collect()] == [1, 0]


def training(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2)) * [1.0, 4.0]
    right = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 2 - x[:, 1] * 0.3 + 0.5)))
    rows = [(i, 1, int(r), float(a), float(b)) for i, (r, (a, b)) in enumerate(zip(right, x))]
    return spark.createDataFrame(rows, "row_id int, gold_label int, llm_label int, a double, b double")


def test_logistic_matches_its_formula(spark):
    """Coefficients minimise half the squared weights plus the summed log loss."""
    from labelquality.operators import sampling as sp

    df = training(spark)
    trained, metrics = tr.train_trust(df, features=["a", "b"])
    part = sp.split_in_two(tr.trust_label(df), 0.2, "train", "validation", "row_id", "trust_label").filter("split = 'train'").toPandas()
    x, y, w = np.c_[part[["a", "b"]], np.ones(len(part))], part["trust_label"].to_numpy(), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        ridge = np.diag([1.0, 1.0, 0.0])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    model = trained.model.stages[-1]
    assert [*model.coefficients, model.intercept] == pytest.approx(w.tolist(), abs=1e-3)
    assert len(part) == 320 and 0.5 < metrics["val_auc"] <= 1 and metrics["optimal_threshold"] == trained.threshold
    scored = trained.score(df)
    assert scored.filter("trust_score < 0 OR trust_score > 1").count() == 0
    assert scored.columns == [*df.columns, "trust_score"]


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boosting"])
def test_tree_learners(spark, kind, monkeypatch):
    small = {"random_forest": lambda n: tr.RandomForestClassifier(**tr._COLUMNS, numTrees=5, seed=1), "gradient_boosting": lambda n: tr.GBTClassifier(**tr._COLUMNS, maxIter=3, seed=1)}
    monkeypatch.setitem(tr.LEARNERS, kind, small[kind])
    trained, metrics = tr.train_trust(training(spark), kind, features=["a", "b"])
    assert metrics["train_accuracy"] > 0.6 and trained.model_type == kind


def test_errors(spark):
    with pytest.raises(ValueError):
        tr.train_trust(training(spark), "svm")
    with pytest.raises(ValueError):
        tr.score_trust(training(spark), None)


def test_save_and_load(spark):
    df = training(spark)
    trained, _ = tr.train_trust(df, features=["a", "b"])
    path = shared_dir(spark, "model")
    tr.save_trust(spark, trained, path)
    loaded = tr.load_trust(spark, path)
    assert (loaded.model_type, loaded.feature_columns, loaded.threshold) == (trained.model_type, ["a", "b"], trained.threshold)
    assert loaded.score(df).exceptAll(trained.score(df)).count() == 0


# --- hard cases ---

ANN = [
    (1, 1, 1, "high", 0.9, True), (2, 1, 0, "medium", 0.6, True), (3, 0, 1, "low", 0.3, True), (4, 0, 0, "low", 0.3, True),
    (5, 1, -1, "high", 0.9, True), (6, 1, None, "low", None, False),
]
SCHEMA = "row_id int, gold_label int, llm_label int, llm_confidence string, llm_confidence_numeric double, is_valid boolean"


def test_hard_cases(spark):
    ann = spark.createDataFrame(ANN, SCHEMA)
    texts = spark.createDataFrame([(2, "x" * 200), (3, "short")], "id int, text string")
    got = {r.row_id: r for r in hc.hard_cases(ann, texts).collect()}
    assert {i: r.reason for i, r in got.items()} == {2: ["disagreement"], 3: ["disagreement", "low_confidence"], 4: ["low_confidence"]}
    assert got[2].text_preview == "x" * 100 + "..." and got[3].text_preview == "short" and got[4].text_preview is None
    assert tuple(hc.hard_case_rate(ann).first()) == (5, 3, pytest.approx(0.6))
    assert [tuple(r) for r in hc.error_pairs(ann).collect()] == [(0, 1, 1), (1, 0, 1)]


def test_difficulty(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 0.2), (2, 1, 0, 1, 0.9), (3, 0, 0, 1, 0.9), (4, 1, 0, 0, None)], "row_id int, gold_label int, llm_label int, supervised_label int, entropy double")
    got = {r.row_id: r for r in hc.difficulty_score(df).collect()}
    assert got[1].difficulty_score == pytest.approx(0.06) and got[2].difficulty_score == pytest.approx(0.97)
    assert got[3].difficulty_score == pytest.approx(0.57) and got[4].difficulty_score == pytest.approx(0.4)
    assert [got[i].is_hard_case_overall for i in (1, 2, 3, 4)] == [False, True, True, False]
    assert got[2].is_hard_case_agreement and got[2].is_hard_case_entropy and got[2].is_hard_case_disagreement


def test_root_split_of_a_single_tree(spark):
    """The first decision separates the classes as well as one threshold can; a tree without a decision has none."""
    rows = [(k, int(k >= 6), float(k), float(k % 2)) for k in range(10)]
    df = spark.createDataFrame(rows, "row_id long, trust_label int, a double, b double")
    one = {"numTrees": 1, "featureSubsetStrategy": "all", "bootstrap": False, "maxDepth": 1}
    feature, threshold, gain = tr.root_splits(tr.fit_trust(df, "random_forest", ["b", "a"], **one))[0]
    assert (feature, threshold) == ("a", 5.5) and gain == pytest.approx(2 * 0.4 * 0.6)
    assert tr.root_splits(tr.fit_trust(df.withColumn("trust_label", (df.row_id < 0).cast("int")), "random_forest", ["a"], **one)) == [None]
    with pytest.raises(ValueError):
        tr.fit_trust(df, "unknown")
