"""Merkle trees against a level-by-level construction over lists."""

import hashlib
import zlib

import numpy as np
import pytest

from labelquality.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    """(siblings, place) level by level."""
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        yield run[: at % 3] + run[at % 3 + 1 :], at % 3
        at //= 3


def brute(rows):
    by_source = {}
    for doc_id, text, source, lang in rows:
        n = None if text is None else len(text)
        leaf = h(*map(field, (doc_id, source, lang, n, text)))
        used = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            used = h(*map(field, (doc_id, source, lang, n, None if text is None else text.replace("\n", ""))))
        by_source.setdefault(source, []).append((doc_id, leaf, used))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in by_source[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, leaf, used) in enumerate(by_source[s]):
            path = [*way(trees[s], i), *way(top, k)]
            folded = used
            for others, place in path:
                folded = h(*others[:place], folded, *others[place:])
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h(*(x for others, _ in path for x in others)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def corpus(seed, n, sources):
    draw = np.random.default_rng(seed)
    names = [None, "", "a", "B", "é", "zz", "z", *(f"s{k}" for k in range(sources))][:sources]
    return [(int(draw.integers(0, 4 * n)), ["x\ny", "plain", "ü\n\n", "", None][draw.integers(5)], names[min(int(draw.geometric(0.4)) - 1, sources - 1)], [None, "en"][draw.integers(2)]) for _ in range(n)]


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 9])
def test_layout(levels):
    """Every node has its own place, and each bottom tree is one stretch."""
    places = [merkle.addresses(levels, d, np.arange(3**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_in(levels)))
    if levels > 1:
        upper = levels // 2
        assert sorted(np.concatenate(places[:upper]).tolist()) == list(range(merkle.nodes_in(upper)))
        size = merkle.nodes_in(levels - upper)
        for j in range(3**upper):
            below = np.concatenate([places[d][j * 3 ** (d - upper) : (j + 1) * 3 ** (d - upper)] for d in range(upper, levels)])
            assert below.max() - below.min() == size - 1


@pytest.mark.parametrize("height,n,sources", [(1, 40, 3), (2, 150, 12), (8, 150, 7), (3, 1, 1), (2, 9, 1), (2, 10, 1), (1, 28, 40)])
def test_equals_lists(make_docs, height, n, sources):
    rows = corpus(height + n, n, sources)
    found = got(merkle.manifest(make_docs(rows), height))
    assert found == brute(rows)


def test_tampering_shows(make_docs):
    rows = [(k, "a\nb" if k % 3 else "ab", "s", "en") for k in range(50)]
    for r in merkle.manifest(make_docs(rows), 2).collect():
        hit = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["doc_id"] % 3 != 0
        assert r["verified"] == (not hit)
        leaf, siblings = bytes.fromhex(r["leaf"]), bytes(r["siblings"])
        assert merkle.fold(leaf, siblings, bytes(r["shape"])).hex() == r["root"]


def test_nulls_ties_and_repeats(make_docs):
    rows = [(None, None, None, None)] * 4 + [(7, "x\n", "a", "en")] * 5 + [(7, "y", "a", None), (None, "q\n", "a", "en"), (7, "", "b", "en")]
    assert got(merkle.manifest(make_docs(rows), 1)) == brute(rows)


def test_empty_and_clashing_columns(make_docs):
    assert got(merkle.manifest(make_docs([]))) == []
    rows = corpus(5, 30, 4)
    clash = make_docs(rows).selectExpr("*", "1 AS key", "2 AS rank", "3 AS block", "4 AS total", "5 AS digest", "6 AS _part")
    assert got(merkle.manifest(clash, 2)) == brute(rows)


def test_one_hot_source_is_many_blocks(make_docs):
    """No task sees more leaves than a block holds, whatever the source."""
    rows = [(k, f"t{k}\n", "hot" if k % 3 else "other", "en") for k in range(400)]
    leaves = merkle.ranked(merkle.leaf_rows(make_docs(rows)), "key", [merkle.F.asc_nulls_first("doc_id"), merkle.F.col("digest")], "leaves")
    sizes = merkle._level(leaves, 2).groupBy("key", "block").count().collect()
    assert max(r["count"] for r in sizes) == 9 and len(sizes) == 30 + 15
    assert got(merkle.manifest(make_docs(rows), 2)) == brute(rows)
