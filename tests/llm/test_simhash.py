import itertools

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry
from labelquality.llm import simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """(doc_id, fp) rows -> smallest doc_id reachable over three bits or fewer."""
    values = sorted({f for _, f in prints})
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 3:
            up[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f"{f:016x}", least.get(root(f))) for i, f in prints), key=str)


def test_query(spark, small, texts):
    got = sorted((tuple(r) for r in entry.queries()["op9_simhash"](spark, small).collect()), key=str)
    assert got == slow_components([(i, slow_print(t)) for i, t in texts.items()])


def test_golay_keys_tolerate_two_bits():
    assert np.bincount(simhash.golay_index().astype(int)).tolist() == [2048] * 4096
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 2000)
    y = x ^ (1 << rng.integers(0, 23, 2000)) ^ (1 << rng.integers(0, 23, 2000))
    (kx, hx), (ky, hy) = simhash.golay_keys(x), simhash.golay_keys(y)
    assert all(set(kx[i][hx[i]]) & set(ky[i][hy[i]]) for i in range(len(x)))
    assert set(hx.sum(axis=1)) == {1, 6}


def test_three_bits_always_share_a_key():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    for bits in range(4):
        y = x.copy()
        for i in range(len(x)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
            if i == 3000:
                break
        (rx, kx), (ry, ky) = simhash.segment_keys(x[:3000]), simhash.segment_keys(y[:3000])
        assert {r for r, _ in set(zip(rx.tolist(), kx.tolist())) & set(zip(ry.tolist(), ky.tolist()))} == set(range(3000))


@pytest.mark.parametrize("direct", [512, 3])
def test_hot_keys(spark, monkeypatch, direct):
    """Chains of close fingerprints, with every key split when few members are compared at once."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = np.random.default_rng(3)
    values = [int(v) for v in rng.integers(0, 1 << 62, 30)]
    for v in list(values[:5]):
        for _ in range(40):
            for b in rng.choice(64, 3, replace=False):
                v ^= 1 << int(b)
            values.append(v)
    values = sorted(set(values))
    prints = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)),) for v in values], "fp long")
    from labelquality.llm.graph import components

    found = components(simhash.links(prints)).collect()
    groups = {}
    for node, comp in found:
        groups.setdefault(comp, set()).add(int(np.array(node, np.int64).view(np.uint64)))
    rows = slow_components(list(enumerate(values)))
    want = {}
    for i, f, c in rows:
        want.setdefault(c, set()).add(int(f, 16))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_edge_cases(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "ONE"), (None, "one"), (6, "a b c d " * 30_000), (7, "é É")]
    docs = make_docs(rows).withColumn("fp", docs_const()).withColumn("component", docs_const())
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(simhash.F.col("fp")), "component_id").collect()), key=str)
    assert got == slow_components([(i, slow_print(t)) for i, t in rows])
    assert simhash.near_duplicates(make_docs([]).limit(0)).count() == 0
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect() if r["doc_id"] is not None)
    assert kept == [1, 4, 4, 6, 7] and simhash.keep_one(docs).columns == docs.columns


def docs_const():
    from pyspark.sql import functions as F

    return F.lit(0)


def test_one_row_of_each_group_stays(spark, make_docs):
    """Rows without an id, exact repeats, and different texts under one id: by row, as the fingerprints group them."""
    rows = [(1, "one two three four"), (None, "one two three four"), (1, "one two three four"), (2, "ONE two three four"), (3, "something else altogether here"),
            (2, "a clean text of its own"), (None, "no id at all"), (None, "no id at all"), (None, "another without an id")]
    docs = make_docs(rows)
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(docs).collect()), key=str)
    want = [(1, "one two three four"), (2, "a clean text of its own"), (3, "something else altogether here"), (None, "no id at all"), (None, "another without an id")]
    assert got == sorted(want, key=str) and simhash.one_of_each(docs).columns == docs.columns
    assert simhash.one_of_each(make_docs([]).limit(0)).count() == 0
