import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from labelquality.llm import phrases, repeats, suffixes


def joined(cover, data):
    left, spans = bytes(b for b, c in zip(data, cover) if not c), sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
    return len(data), sum(cover), spans, hashlib.sha256(left).hexdigest()


def slow_bytes(rows, least):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[k : k + least] for k in range(len(data) - least + 1))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        cover = bytearray(len(data))
        for k in range(len(data) - least + 1):
            if seen[data[k : k + least]] > 1:
                cover[k : k + least] = b"\1" * least
        out.append((i, *joined(cover, data)))
    return sorted(out, key=str)


def slow_words(rows, size):
    first, lists = {}, [(i, (t or "").encode().split()) for i, t in rows]
    last = float("inf")
    for i, words in lists:
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            first[w] = min(first.get(w, last), last if i is None else i)
    out = []
    for i, words in lists:
        cover = bytearray(len(words))
        for k in range(len(words) - size + 1):
            if first[tuple(words[k : k + size])] < (last if i is None else i):
                cover[k : k + size] = b"\1" * size
        kept = [w for w, c in zip(words, cover) if not c]
        out.append((i, len(words), sum(cover), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def fast_bytes(docs, **options):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in suffixes.remove_repeats(docs, **options).select(cols).collect()), key=str)


def fast_words(docs, **options):
    return sorted((tuple(r) for r in phrases.remove_repeats(docs, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_op1_query(spark, small, texts):
    got = sorted((tuple(r) for r in entry.queries()["op1_suffixes"](spark, small).collect()), key=str)
    want = slow_bytes(list(texts.items()), 400)
    assert got == want and sum(r[2] for r in want) > 0


def test_op6_query(spark, small, texts):
    got = sorted((tuple(r) for r in entry.queries()["op6_phrases"](spark, small).collect()), key=str)
    want = slow_words(list(texts.items()), 50)
    assert got == want and sum(r[2] for r in want) > 0


def random_rows(seed, n=60):
    """Texts with shared passages, copies, near copies, periodic parts and very few different characters."""
    rng = random.Random(seed)
    words = ["a", "b", "ab", "é", "cc"]
    text = lambda k: rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(k))
    passages, rows = [text(rng.randint(5, 60)) for _ in range(6)], []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(0, 20)) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.1:
            parts.append("ab " * rng.randint(1, 60))
        rows.append((i, " ".join(parts)))
    rows += [(n + k, rows[k][1]) for k in range(8)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd, busy", [(4096, 2000), (2, 2000), (4, 5)])
def test_random_texts(spark, make_docs, monkeypatch, crowd, busy):
    """Also when almost every anchor is split or busy, in small groups."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BUSY", busy)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 4096 if crowd > 2 else 1 << 20)
    monkeypatch.setattr(phrases, "SHARD", 50)
    rows = random_rows(crowd)
    docs = make_docs(rows)
    assert fast_bytes(docs, least=24) == slow_bytes(rows, 24)
    assert fast_words(docs, size=8) == slow_words(rows, 8)


def test_edge_cases(spark, make_docs):
    long = " ".join(str(k * k) for k in range(3000))
    rows = [(1, None), (2, ""), (3, "x" * 50_000), (4, long), (None, long), (None, long), (4, long), (4, "other " + long), (5, "q " * 3000), (6, " ".join(map(str, range(400))))]
    docs = make_docs(rows).withColumn("k1", repeats.F.lit("clash")).withColumn("h", repeats.F.lit("clash"))
    assert fast_bytes(docs) == slow_bytes(rows, 400)
    assert fast_words(docs) == slow_words(rows, 50)
    empty = make_docs([]).limit(0)
    assert fast_bytes(empty) == fast_words(empty) == []
    kept = {r["doc_id"]: r["kept"] for r in suffixes.remove_repeats(docs, keep_text=True).collect()}
    assert kept[6] == rows[-1][1] and kept[3] == ""


def test_long_texts_go_by_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    windows = repeats.Windows(40, 10)

    def places():
        found = set()
        for text, first, count, anchor in zip(*windows.stretches(codes, np.array([0, 1200, 1210, 5000]))):
            found |= {(int(text), int(first) + k, int(anchor)) for k in range(count)}
        return found

    whole = places()
    monkeypatch.setattr(repeats, "CHUNK", 300)
    assert places() == whole and len(whole) == 1200 - 39 + 3790 - 39


def test_matches_on_the_transform():
    rng = np.random.default_rng(1)
    for _ in range(60):
        parts = [bytes(rng.choice([97, 98], rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        least = int(rng.integers(1, 12))
        symbols = np.concatenate([[*(np.frombuffer(p, np.uint8).astype(int) + len(parts)), k] for k, p in enumerate(parts)])
        order, rank, same = suffixes.long_matches(symbols, len(parts), least)
        lists = [symbols[k:].tolist() for k in range(len(symbols))]
        assert order.tolist() == sorted(range(len(symbols)), key=lists.__getitem__)
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert same.tolist() == [False] + [common(lists[a], lists[b]) >= least for a, b in zip(order, order[1:])]
