import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from labelquality.llm import embeddings


def slow(rows, threshold=0.98):
    """(vec_id, vector, label) -> (vec_id, n_links, component_id, kept), all pairs."""

    def good(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v, label) else None for _, v, label in rows]
    n, label = [0] * len(rows), list(range(len(rows)))
    near = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                near[i].append(j)
                near[j].append(i)
    for i in range(len(rows)):
        stack = [i] if label[i] == i else []
        while stack:
            for y in near[stack.pop()]:
                if label[y] > i:
                    label[y] = i
                    stack.append(y)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[label[k]] = min(r[0], least.get(label[k], r[0]))
    return sorted(((r[0], len(near[k]), least.get(label[k]), r[0] is not None and r[0] == least[label[k]]) for k, r in enumerate(rows)), key=str)


def run(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return sorted((tuple(r) for r in embeddings.near_duplicates(df, **options).collect()), key=str)


def clusters(rng, dim=16, groups=6, size=60, spread=0.03):
    rows = []
    for g in range(groups):
        center = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((len(rows), [float(np.float32(x)) for x in center + spread * (1 + g) * rng.standard_normal(dim)], g % 2))
    return rows


def test_query(spark, small):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in entry.queries()["op5_embeddings"](spark, small).collect()), key=str)
    assert got == slow(rows)


@pytest.mark.parametrize("chunk, few", [(2048, 48), (7, 3)])
def test_dense_groups(spark, monkeypatch, chunk, few):
    """Groups of many links, also when band values are split into pairs of small chunks."""
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    monkeypatch.setattr(embeddings, "SMALL", few)
    rows = clusters(np.random.default_rng(0))
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(5)]
    got = run(spark, rows)
    assert got == slow(rows) and sum(r[1] for r in got) > 1000


def test_error_bound_is_certain():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24))
    y = embeddings.unit_rows(x) + 0.4 * rng.random((400, 1)) * embeddings.unit_rows(rng.standard_normal((400, 24)))
    of = embeddings.Coded(np.concatenate([x, y]), 8, 10, 0.98, None)
    pairs = np.arange(400)
    exact = (of.unit[pairs] * of.unit[pairs + 400]).sum(axis=1)
    estimate = (of.estimator[pairs] * of.rotated[pairs + 400]).sum(axis=1)
    assert (estimate[exact >= 0.98] >= of.least[pairs][exact >= 0.98]).all() and 50 < (exact >= 0.98).sum() < 350
    far = embeddings.Coded(rng.standard_normal((200, 24)), 8, 10, 0.98, None)
    maybe = (far.estimator @ far.rotated.T >= far.least[:, None]).sum() - 200
    assert maybe < 0.01 * 200 * 199  # few of the far pairs need the exact cosine


def test_estimate_is_unbiased():
    rng = np.random.default_rng(2)
    x, y = embeddings.unit_rows(rng.standard_normal((2, 32)))
    found = []
    for _ in range(3000):
        q = np.linalg.qr(rng.standard_normal((32, 32)))[0]
        s = np.where(x @ q > 0, 1, -1)
        found.append(s @ (y @ q) / (s @ (x @ q)))
    assert abs(np.mean(found) - x @ y) < 0.02


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None),
        (9, [1.0, 0.0], 2), (10, [2.0, 0.0], 2), (11, [1.0, 0.0], 3), (12, [1.0, 0.0, 0.0], 2), (None, [1.0, 0.0], 2), (9, [1.0, 0.0], 2), (13, [3.0], 4), (14, [-3.0], 4), (15, [5.0], 4),
        (16, [1e-30, 0.0], 2), (17, [3e38, 1e30], 2),
    ]
    assert run(spark, rows) == slow(rows)
    assert run(spark, rows, kind="double") == slow(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x")).withColumn("vector", F.lit("x"))
    assert embeddings.near_duplicates(df).count() == len(rows)
    assert run(spark, []) == []
