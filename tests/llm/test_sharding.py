import zlib

import numpy as np

import __spark_entry__ as entry
from labelquality.llm import sharding


def slow_capacity(sizes, shards):
    """Dynamic programme over all contiguous partitions."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    best = total[1:].copy()
    for _ in range(shards - 1):
        best = np.array([min(max(best[j - 1] if j else 0, total[i + 1] - total[j]) for j in range(i + 1)) for i in range(len(sizes))])
    return int(best[-1])


def test_least_capacity_and_cuts():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(0, 50, rng.integers(1, 30)) ** rng.integers(1, 3)
        shards = int(rng.integers(1, 7))
        assert sharding.least_capacity(sizes, shards) == slow_capacity(sizes, shards)
        ends = sharding.cuts(sizes, shards)
        assert (np.diff(ends) >= 0).all() and len(ends) == shards - 1
        assert max(int(p.sum()) for p in np.split(sizes, ends)) <= slow_capacity(sizes, shards)


def check(rows, texts, shards):
    slots, where = {}, {}
    for i, size, crc, shard, slot in rows:
        data = (texts[i] or "").encode()
        assert size == len(data) + 8 and crc == zlib.crc32(data) and 0 <= shard < shards
        slots.setdefault(shard, []).append(slot)
        assert where.setdefault(data, shard) == shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark, small, texts):
    rows = entry.queries()["op10_sharding"](spark, small).collect()
    assert len(rows) == len(texts) and {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}
    check([tuple(r)[:3] + (r["shard"], r["slot"]) for r in rows], texts, 24)
    loads = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 24)
    groups = {}
    for r in rows:
        groups[texts[r["doc_id"]]] = groups.get(texts[r["doc_id"]], 0) + r["size"]
    assert loads.max() <= loads.mean() + max(groups.values())


def test_edge_cases(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_PART", 3)
    rows = [(k, "same") for k in range(20)] + [(20, None), (21, ""), (22, "x" * 200_000), (None, "é"), (22, "y")]
    docs = make_docs(rows).withColumn("bucket", sharding.F.lit(1)).withColumn("shard", sharding.F.lit(1))
    got = [tuple(r) for r in sharding.shard(docs, 4).collect()]
    assert len(got) == len(rows)
    slots = {}
    for i, size, crc, shard, slot in got:
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r[3] for r in got if r[1] == 12}) == 1  # the copies stay together
    assert {r[2] for r in got if r[0] in (20, 21)} == {0}
    assert sharding.shard(make_docs([]).limit(0)).count() == 0


def test_equal_rows_of_a_hot_text_are_numbered_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_PART", 10)
    rows = [(None, "same")] * 200 + [(7, "same")] * 200 + [(k, "same") for k in range(100)] + [(k, f"t{k}") for k in range(50)]
    found = sharding.shard(make_docs(rows), 4)
    plain = {}
    for r in found.collect():
        plain.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, plain.values())) == len(rows) and all(sorted(s) == list(range(len(s))) for s in plain.values())
    placed = make_docs(rows).selectExpr("doc_id", "1 AS bucket", "50 AS parts", "monotonically_increasing_id() AS row").filter("doc_id is null or doc_id = 7")
    dealt, key = sharding._dealt(placed)
    assert dealt.groupBy(sharding.F.pmod(key, "parts")).count().agg({"count": "max"}).first()[0] <= 40
