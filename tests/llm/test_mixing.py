import numpy as np
import pytest

import __spark_entry__ as entry
from labelquality.llm import mixing


def slow_targets(sizes):
    """Share, stop at twice the size, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(full.values())


def check(rows, want):
    taken, biggest = {}, {}
    for _, source, size, source_size, target, copies, got in rows:
        assert target == pytest.approx(want[source]) and got == copies * size <= 2 * size
        taken[source] = taken.get(source, 0) + got
        biggest[source] = max(biggest.get(source, 0), size)
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in taken)


def test_query(spark, small, texts):
    rows = entry.queries()["op3_mixing"](spark, small).collect()
    sizes = {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode().split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    assert len(rows) == len(texts) and all(r["source_size"] == sizes[r["source"]] for r in rows)
    want = slow_targets(sizes)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(sizes.values()), rel=0.02)
    check([(r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], round(r["taken"] / max(r["size"], 1)), r["taken"]) for r in rows], want)
    again = entry.queries()["op3_mixing"](spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_rounds(spark, make_docs, monkeypatch):
    """Several rounds of small blocks and a source that is full."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 40)), "tiny" if i < 5 else "zz" if i % 3 else None) for i in range(1200)]
    got = [tuple(r) for r in mixing.mix(make_docs(rows)).collect()]
    sizes = {}
    for r in got:
        sizes[r[1]] = sizes.get(r[1], 0) + r[2]
    assert len(got) == 1200
    check(got, slow_targets(sizes))
    assert all(r[5] == 2 for r in got if r[1] == "tiny")


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size, chance = rng.integers(0, 100, 500).astype(float), rng.random(500)
    p = mixing.flight(chance, size, rng)
    assert p.sum() == pytest.approx(chance.sum()) and (p * size).sum() == pytest.approx((chance * size).sum())
    assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
    landed = mixing.flight(chance, size, rng, land=True)
    assert set(np.round(landed, 9)) <= {0.0, 1.0}
    mean = np.mean([mixing.flight(np.full(6, 0.3), np.arange(6.0), rng, land=True) for _ in range(4000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.05


def test_edge_cases(spark, make_docs):
    rows = [(1, None, None), (2, "", "a"), (3, "w " * 30_000, "b"), (None, "x y", "b"), (3, "x y", "b"), (3, "x y", "b"), (4, "z", "")]
    docs = make_docs(rows).withColumn("size", mixing.F.lit("clash")).withColumn("chance", mixing.F.lit("clash"))
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows)
    assert [r[6] for r in got if r[0] in (1, 2)] == [0, 0]
    assert mixing.mix(make_docs([]).limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_equal_rows_are_dealt_over_blocks(make_docs, monkeypatch, doc_id):
    """Rows of one size without an id, or with one id, do not meet in one flight."""
    fly = mixing._fly

    def bounded(land):
        inner = fly(land)

        def run(block):
            assert len(block) <= 64
            return inner(block)

        return run

    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "_fly", bounded)
    rows = [(doc_id, "w w w", "hot")] * 600 + [(k, "w " * (k % 9), "abc"[k % 3]) for k in range(300)]
    got = [tuple(r) for r in mixing.mix(make_docs(rows)).collect()]
    sizes = {}
    for r in got:
        sizes[r[1]] = sizes.get(r[1], 0) + r[2]
    assert len(got) == len(rows)
    check(got, slow_targets(sizes))
