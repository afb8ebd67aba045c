"""Forests grown in tasks: against Spark's trees, for any size of parts, and with little left on the driver."""

import pickle

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from labelquality.operators import forest as fo, trust as tr
from labelquality.sources.shared import shared_dir

NAMES = ["a", "b", "c", "d"]
ALL = {"numTrees": 1, "featureSubsetStrategy": "all", "bootstrap": False}


def rows(spark, n=3000, seed=3):
    """Two features of many values, one of five, a constant; labels are mostly noise, so that trees are deep. One row in ten comes twice."""
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n), rng.exponential(size=n).round(1), rng.integers(0, 5, n), np.ones(n)]
    y = (rng.random(n) < 0.45 + 0.2 * (x[:, 0] > 0)).astype(int)
    data = [(i, *map(float, r), int(label)) for i, (r, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(data + data[: n // 10], "row_id int, a double, b double, c double, d double, trust_label int")


def vectors(df):
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)


def scores(model, df):
    return {r[0]: r[1] for r in model.transform(df).select("row_id", vector_to_array("probability")[1]).collect()}


@pytest.mark.parametrize("settings", [{}, {"maxDepth": 4, "minInstancesPerNode": 20}, {"maxBins": 300, "minInfoGain": 0.001}])
def test_a_tree_of_all_rows_is_that_of_spark(spark, settings):
    df = vectors(rows(spark)).cache()
    settings = ALL | {"maxDepth": 30, "seed": 1} | settings
    theirs = RandomForestClassifier(featuresCol="features", labelCol="trust_label", **settings).fit(df)
    for keys_per_part in (fo.KEYS_PER_PART, 800):
        ours = fo.Forest("features", "trust_label", keys_per_part, **settings).fit(df)
        assert scores(ours, df) == pytest.approx(scores(theirs, df), abs=1e-15)
        root = theirs.trees[0]._java_obj.rootNode()
        assert ours.roots() == [(root.split().featureIndex(), root.split().threshold(), pytest.approx(root.gain()))]


def test_thresholds_come_from_all_rows(spark):
    """Spark places them by 10,000 rows beyond that number."""
    n = 20_000
    x = np.random.default_rng(5).normal(size=n)
    df = spark.createDataFrame([(float(v), float(k % 7)) for k, v in enumerate(x)], "a double, b double").select(F.array("a", "b").alias("x"))
    got = fo._thresholds(df, fo.Rules(2))
    v = np.sort(x)
    assert got[0] == pytest.approx([(v[k * n // 32 - 1] + v[k * n // 32]) / 2 for k in range(1, 32)])
    assert got[1].tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]


def test_part_size_changes_nothing(spark):
    df = vectors(rows(spark)).cache()
    models = [fo.Forest("features", "trust_label", k, numTrees=7, maxDepth=30, seed=4).fit(df) for k in (fo.KEYS_PER_PART, 400)]
    assert models[1].table.count() > 14 and models[0].table.count() == 7
    assert scores(models[0], df) == scores(models[1], df)
    assert models[0].roots() == models[1].roots()
    other = fo.Forest("features", "trust_label", numTrees=7, maxDepth=30, seed=5).fit(df)
    assert scores(other, df) != scores(models[0], df)


def test_forest_is_as_good_as_that_of_spark(spark):
    train, held = vectors(rows(spark)).cache(), vectors(rows(spark, seed=8)).cache()
    theirs = RandomForestClassifier(featuresCol="features", labelCol="trust_label", numTrees=30, maxDepth=30, seed=1).fit(train)
    ours = fo.Forest("features", "trust_label", numTrees=30, maxDepth=30, seed=1).fit(train)
    for df in (train, held):
        a, b = scores(ours, df), scores(theirs, df)
        assert np.mean([abs(a[i] - b[i]) for i in a]) < 0.09
        assert np.mean(list(a.values())) == pytest.approx(np.mean(list(b.values())), abs=0.02)


def test_the_driver_holds_no_trees(spark):
    """Trees of noise have a node for about every second row; the model kept all of them on the driver before."""
    df = rows(spark, 6000).withColumn("trust_label", (F.xxhash64("row_id") % 2 == 0).cast("int"))
    trained = tr.fit_trust(df, "random_forest", NAMES, numTrees=20)
    model = trained.model.stages[-1]
    assert isinstance(model, fo.ForestModel)
    assert model.table.agg(F.sum("size")).first()[0] > 20 * 1000
    assert len(pickle.dumps((model.rules, model.thresholds, model.tops))) < 20_000
    scored = trained.score(df)
    assert scored.columns == [*df.columns, "trust_score"] and scored.count() == df.count()


def test_poisson_weights_by_key(spark):
    """Draws of a tree add up to about the rows, and differ by tree and chunk but not by call."""
    counts, rules = np.array([[1, 0], [500, 200], [0, 3]] * 1000), fo.Rules(4, seed=9)
    one, again, two, far = (fo._drawn(name, tree, counts, rules) for name, tree in ((b"a" * 16, 0), (b"a" * 16, 0), (b"a" * 16, 1), (b"b" * 16, 0)))
    assert (one == again).all() and (one != two).any() and (one != far).any()
    assert one.sum() == pytest.approx(counts.sum(), rel=0.01) and (one[::3, 0] == 0).mean() == pytest.approx(np.exp(-1), abs=0.06)
    assert (one[counts == 0] == 0).all()


def test_save_load_and_odd_inputs(spark):
    df = rows(spark, 400)
    trained = tr.fit_trust(df, "random_forest", NAMES, numTrees=5)
    path = shared_dir(spark, "forest")
    tr.save_trust(spark, trained, path)
    loaded = tr.load_trust(spark, path)
    assert isinstance(loaded.model, PipelineModel) and tr.root_splits(loaded) == tr.root_splits(trained)
    assert loaded.score(df).exceptAll(trained.score(df)).count() == 0
    assert trained.score(df.limit(0)).count() == 0
    one = tr.fit_trust(df.limit(1), "random_forest", NAMES, numTrees=30)  # about a third of the trees draw no row and have no vote
    assert tr.root_splits(one) == [None] * 30
    assert one.score(df).select("trust_score").distinct().collect() == df.limit(1).select(F.col("trust_label").cast("double")).collect()
    with pytest.raises(ValueError):
        tr.fit_trust(df.limit(0), "random_forest", NAMES)
    with pytest.raises(ValueError):
        tr.fit_trust(df, "random_forest", NAMES, maxDepth=31)
    library = tr.fit_trust(df, "random_forest", NAMES, numTrees=2, maxDepth=3, impurity="entropy")
    assert isinstance(library.model.stages[-1], type(RandomForestClassifier().fit(vectors(df.withColumnRenamed("trust_label", "label")))))
