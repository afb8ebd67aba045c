"""Probabilities, calibration and temperature against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelquality.functions import probability as pr
from labelquality.operators import calibration as cal, uncertainty as un


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr).first()[0]


def test_softmax_and_entropy(spark):
    z = [1.0, 3.0, -2.0, 1000.0, 999.0]
    e = np.exp((np.array(z) - 1000) / 2.0)
    assert one(spark, pr.softmax(F.col("z"), 2.0), z=z) == pytest.approx((e / e.sum()).tolist())
    assert one(spark, pr.categorical_entropy(F.col("p")), p=[0.5, 0.5]) == pytest.approx(np.log(2))
    assert one(spark, pr.categorical_entropy(F.col("p")), p=[1.0, 0.0]) == pytest.approx(0.0, abs=1e-9)
    for p in ([0.5, 0.5], [0.9, 0.1], [0.33, 0.33, 0.34]):
        assert 0 <= one(spark, pr.categorical_entropy(F.col("p")), p=p) <= np.log(len(p)) + 1e-9
    assert one(spark, pr.binary_entropy_mean(F.col("p")), p=[0.5, 0.0, 1.0]) == pytest.approx(np.log(2) / 3, abs=1e-9)
    assert one(spark, pr.argmax_label(F.col("p")), p=[0.2, 0.4, 0.4]) == 1


def test_multilabel(spark):
    p = [0.2, 0.6, 0.7]
    assert one(spark, pr.multilabel_predict(F.col("p")), p=p) == [1, 2]
    assert one(spark, pr.multilabel_predict(F.col("p"), [0.2, 0.7, 0.8]), p=p) == [0]
    chosen = pr.multilabel_predict(F.col("p"))
    assert one(spark, pr.multilabel_confidence(F.col("p"), chosen), p=p) == 0.7
    assert one(spark, pr.multilabel_confidence(F.col("p"), chosen), p=[0.1, 0.4]) == pytest.approx(0.6)


def numpy_bins(p, y, n):
    edges = np.linspace(0, 1, n + 1)
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        m = (p > lo) & (p <= hi)
        out.append((int(m.sum()), p[m].mean() if m.any() else (lo + hi) / 2, y[m].mean() if m.any() else 0.0))
    return out


@pytest.mark.parametrize("bins", [10, 15])
def test_bins_at_the_edges(spark, bins):
    """Every bin limit and its two neighbouring doubles, 0 and 1 included."""
    edges = np.linspace(0, 1, bins + 1)
    p = np.concatenate([edges, np.nextafter(edges, 2), np.nextafter(edges, -1), np.arange(0, 1, 0.037)])
    p = p[(p >= 0) & (p <= 1)]
    y = (np.arange(len(p)) % 3 == 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "p double, y double")
    want = numpy_bins(p, y, bins)
    got = cal.reliability_bins(df, F.col("p"), F.col("y"), bins).orderBy("bin").collect()
    assert [r.n for r in got] == [w[0] for w in want]
    assert [r.confidence for r in got] == pytest.approx([w[1] for w in want])
    assert [r.accuracy for r in got] == pytest.approx([w[2] for w in want])
    m = cal.calibration_metrics(df, "p", "y", bins).first()
    n, base = len(p), y.mean()
    full = [w for w in want if w[0]]
    assert m.ece == pytest.approx(sum(c * abs(a - b) for c, a, b in full) / n)
    assert m.mce == pytest.approx(max(abs(a - b) for c, a, b in full))
    assert m.reliability == pytest.approx(sum(c * (a - b) ** 2 for c, a, b in full) / n)
    assert m.resolution == pytest.approx(sum(c * (b - base) ** 2 for c, a, b in full) / n)
    assert m.brier_score == pytest.approx(((p - y) ** 2).mean())


def test_empty_bins_show_their_middle(spark):
    df = spark.createDataFrame([(0.95, 1)], "p double, y int")
    got = cal.reliability_bins(df, F.col("p"), F.col("y"), 10).orderBy("bin").collect()
    assert [r.n for r in got] == [0] * 9 + [1]
    assert got[0].confidence == pytest.approx(0.05) and got[0].accuracy == 0.0


def test_brier_is_a_mean_over_cells(spark):
    p = np.array([[0.7, 0.2, 0.1], [0.1, 0.1, 0.8]])
    gold = [0, 1]
    onehot = np.eye(3)[gold]
    df = spark.createDataFrame([(p[i].tolist(), gold[i]) for i in range(2)], "p array<double>, g int")
    assert cal.brier(df, "p", "g").first().brier_score == pytest.approx(((p - onehot) ** 2).mean())


def _logits(seed=3, n=400, k=4):
    rng = np.random.default_rng(seed)
    gold = rng.integers(0, k, n)
    z = rng.normal(size=(n, k)) * 3
    z[np.arange(n), gold] += 2
    return z, gold


def test_fit_temperature(spark):
    z, gold = _logits()
    df = spark.createDataFrame([(a.tolist(), int(g)) for a, g in zip(z, gold)], "z array<double>, g int")
    t = cal.fit_temperature(df, "z", "g")

    def loss(temp):
        s = z / temp
        s = s - s.max(1, keepdims=True)
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), gold]).mean()

    grid = np.linspace(t * 0.9, t * 1.1, 201)
    assert loss(t) <= min(loss(x) for x in grid) + 1e-12 and t > 1
    points = cal.temperature_grid(df, "z", "g", [0.5, 1.0, t, 4.0])
    assert cal.best_of_grid(points).first().temperature == pytest.approx(t)
    assert {r.temperature: r.nll for r in points.collect()}[1.0] == pytest.approx(loss(1.0))


def test_fit_temperature_multilabel(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(300, 3)) * 4
    y = rng.random((300, 3)) < 1 / (1 + np.exp(-z / 2.5))
    rows = [(a.tolist(), [int(c) for c in np.flatnonzero(b)]) for a, b in zip(z, y)]
    df = spark.createDataFrame(rows, "z array<double>, y array<int>")
    t = cal.fit_temperature(df, "z", "y", multilabel=True)

    def loss(temp):
        s = z / temp
        return (np.maximum(s, 0) - s * y + np.log1p(np.exp(-abs(s)))).mean()

    assert loss(t) <= min(loss(x) for x in np.linspace(t * 0.8, t * 1.2, 201)) + 1e-12
    assert df.agg(F.avg(cal.bce(F.col("z"), F.col("y"), F.lit(1 / t)))).first()[0] == pytest.approx(loss(t))


def test_separable_logits_stop_at_the_bound(spark):
    df = spark.createDataFrame([([5.0, 0.0], 0), ([0.0, 5.0], 1)], "z array<double>, g int")
    assert cal.fit_temperature(df, "z", "g", bounds=(0.05, 100.0)) == 0.05


def test_verify_predictions(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], 1), (2, [2.0, -1.0], 1)], "id int, logits array<double>, gold int")
    preds = un.predictions(df)
    v = un.verify_predictions(preds).first()
    assert v.n == 2 and v.mean_probability_sum == pytest.approx(1.0) and v.max_entropy_gap == 0.0
    assert [r.correct for r in preds.orderBy("example_id").collect()] == [True, False]
