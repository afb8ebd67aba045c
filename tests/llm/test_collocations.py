"""Phrases against a plain count over all words."""

import re
from collections import Counter

import numpy as np
import pytest

from labelquality.llm import collocations as co

UPPER = {ord("A") + k: ord("a") + k for k in range(26)}


def brute(rows, least, top):
    f, n = {}, Counter()
    for _, text, _, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, l, x, n[lang], -s) for r, (s, a, p, l, x) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def prose(seed, rows=60):
    draw = np.random.default_rng(seed)
    words = ["the", "cat", "The", "sat", "élan", "on", "mat", "x y", "no"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! "]
    return [(k, "".join(words[min(int(draw.geometric(0.3)) - 1, 8)] + ends[draw.integers(10)] for _ in range(draw.integers(0, 60))), "s", [None, "de", "en"][k % 3]) for k in range(rows)]


EDGES = [(None, None, None, None), (1, "", "s", "en"), (1, "...", "s", None), (2, "a b " * 40, "s", "und"), (2, "a b " * 40, "s", "und"), (3, "one\ttwo  three four five " * 9, "s", "en")]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_plain_count(make_docs, seed):
    rows = prose(seed) + EDGES
    for least, top in ((5, 2000), (3, 7)):
        assert got(co.collocations(make_docs(rows), least=least, top=top)) == brute(rows, least, top)


def test_production_parameters(make_docs):
    rows = prose(2, 400)
    expected = brute(rows, 30, 2000)
    assert expected
    assert got(co.collocations(make_docs(rows))) == expected


def test_shared_fingerprints_part_by_words(make_docs, monkeypatch):
    """With fingerprints of a few bits nearly all collide, also those of words; counts stay exact."""
    monkeypatch.setattr(co, "mix", lambda h: h & np.uint64(3))
    rows = prose(3, 30)
    grams = co.Grams(b"a b a c ", np.array([1], np.uint64), np.array([8]))
    numbers = co._word_numbers(grams).tolist()
    assert numbers[0] == numbers[2] and len(set(numbers)) == 3
    found = list(co._phrases(lambda fp: np.ones(len(fp), bool))(iter(make_docs(rows).select("lang", "text").toArrow().to_batches())))
    counts = Counter()
    for b in found:
        for lang, size, phrase, n in zip(*(b.column(k).to_pylist() for k in range(4))):
            counts[lang, size, phrase.decode()] += n
    plain = Counter()
    for _, text, _, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(UPPER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    plain[lang or "und", size, " ".join(words[i : i + size])] += 1
    assert {k: v for k, v in counts.items() if k[1]} == dict(plain)


def test_crowded_filter_and_small_memory(make_docs, monkeypatch):
    """A bit table that lets nearly everything through, folding and passing on all the time, cutting of long texts."""
    rows = prose(4, 40) + [(9, " ".join(f"{w}{k % 3}." if k % 50 == 0 else w for k, w in enumerate(["ab", "c", "d"] * 2000)), "s", "en")]
    monkeypatch.setattr(co, "SLICE", 64)
    seen = []
    fold = co._Counts.fold
    monkeypatch.setattr(co._Counts, "fold", lambda self, least: (seen.append(least), fold(self, least))[1])
    data = rows[-1][1].encode()
    assert b"".join(co.chunks(data, 64)) == data and max(map(len, co.chunks(data, 64))) < 400
    assert all(c[-1:] in b".\n" for c in list(co.chunks(data, 64))[:-2])
    assert list(co.chunks(b"", 64)) == [b""] and list(co.chunks(b"x" * 200, 64)) == [b"x" * 200, b""]
    batches = lambda: iter(make_docs(rows).selectExpr("coalesce(lang, 'und') lang", "text").toArrow().to_batches())
    whole = Counter()
    for b in co._short(batches()):
        whole.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    monkeypatch.setattr(co, "SLICE", 4 << 20)
    again = Counter()
    for b in co._short(batches()):
        again.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert whole == again and seen


def test_filter_lets_all_through(spark):
    fps = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 5000)
    table = co.bit_table(spark.createDataFrame([(int(x),) for x in fps], "fp long"))
    assert table(fps.view(np.uint64)).all()
    other = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000).view(np.uint64)
    assert table(other).mean() < 0.1


def test_exact_beyond_64_bits(spark, monkeypatch):
    big = 9_000_000_000_000_000_000
    counts = [("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 3)]
    monkeypatch.setattr(co, "phrase_counts", lambda *a: spark.createDataFrame(counts, "lang string, size int, phrase string, n long"))
    row = co.collocations(spark.range(0).selectExpr("string(id) AS text", "string(id) AS lang")).first()
    assert row["score"] == 2000000 * (big - 3) // (2 * big - 1)


def test_empty_and_clashing_columns(spark, make_docs):
    assert got(co.collocations(make_docs([]))) == []
    rows = prose(5)
    clash = make_docs(rows).selectExpr("*", "'x' AS phrase", "'y' AS n", "0 AS fp", "1 AS size", "2 AS rank")
    assert got(co.collocations(clash, least=5)) == brute(rows, 5, 2000)
