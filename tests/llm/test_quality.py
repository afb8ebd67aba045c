import random
import re
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from labelquality.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_query(spark, small, texts):
    rows = entry.queries()["op4_quality"](spark, small).collect()
    assert len(rows) == len(texts)
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    right = 0
    for r in rows:
        want = slow_counts(texts[r["doc_id"]])
        assert [r[c] for c in quality.COUNTS] == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] in good and not r["base_failed"]:
            right += r["kept"] == (good[r["doc_id"]] == 1)
    assert right >= 0.95 * sum(1 for r in rows if r["doc_id"] in good and not r["base_failed"])


def test_held_out_labels(spark, documents, small):
    """Fitted on half of the labels, the verdict agrees with the other half."""
    F = quality.F
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.learn(documents, labels.filter("doc_id % 2 = 0"))
    seen = quality.judge(documents, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter(~F.col("base_failed"))
    n, right = seen.agg(F.count("*"), F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()
    assert right >= 0.93 * n


def test_counts_on_random_texts(monkeypatch):
    rng = random.Random(0)
    for k in range(400):
        text = "".join(rng.choice(["a ", "b ", "c", "é ", "\n", "\t", "#", " a a a a a", "\x1c", "\x85"]) for _ in range(rng.randint(0, 60)))
        assert quality.statistics(text.encode())[0] == slow_counts(text), text
    many = " ".join(str(rng.randint(0, 50_000)) for _ in range(60_000)) + " 1 2 3 4 5 6" * 2  # more kinds of words than five of them fit in 63 bits
    assert quality.statistics(many.encode())[0] == slow_counts(many)


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 1 / (1 + np.exp(-8 * (np.sin(6 * x[:, 0]) - x[:, 1] + 0.3 * np.sin(20 * x[:, 1]))))).astype(float)
    trees = quality.fit(x, y, [0, -1, 0])
    assert ((trees.chance(x) > 0.5) == y).mean() > 0.85
    base = rng.random((200, 3))
    grid = np.linspace(0, 1, 101)
    for row in base:
        line = np.repeat(row[None], 101, axis=0)
        line[:, 1] = grid
        assert (np.diff(trees.margin(line)) <= 1e-12).all()
    assert np.ptp(trees.margin(np.column_stack([grid, np.full(101, 0.5), np.full(101, 0.5)]))) > 1


def test_edge_cases(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "x " * 200_000), (4, "a b c"), (4, "a b c"), (None, "one two three four five six seven eight nine ten"), (5, "\n\n \n")]
    docs = make_docs(rows).withColumn("n_words", quality.F.lit("clash")).withColumn("y", quality.F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (None, 1), (4, None), (9, 7)], "doc_id long, quality int")
    got = quality.judge(docs, quality.learn(docs, labels)).collect()
    assert sorted([r[c] for c in quality.COUNTS] for r in got) == sorted(slow_counts(t) for _, t in rows)
    empty = quality.judge(docs, quality.learn(docs, labels.limit(0))).collect()
    assert {r["chance"] for r in empty} == {0.5} and len(empty) == len(rows)
    assert quality.judge(make_docs([]).limit(0), quality.learn(docs, labels)).count() == 0


def test_sample_is_bounded_by_rows(spark, make_docs, monkeypatch):
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, d: seen.append(len(y)) or fit(x, y, d))
    docs = make_docs([(1, "w " * k) for k in range(60)] + [(2, "a b")] * 50 + [(3, "c")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    quality.learn(docs, labels, limit=10)
    quality.learn(docs.filter("doc_id > 1"), labels, limit=10)
    assert seen == [10, 2]
