import zlib

import numpy as np

import __spark_entry__ as entry
from labelquality.llm import language


def test_query(spark, small, documents):
    rows = entry.queries()["op8_language"](spark, small).collect()
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.95
    again = entry.queries()["op8_language"](spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_families_come_before_pairs(documents):
    model = language.learn(documents)
    assert model.languages == ["de", "en", "es", "fr"] and len(model.families) == 2
    assert len(model.weights) == 2 + len(model.pairs) and sorted(sum(model.families, [])) == [0, 1, 2, 3]


def test_held_out_language_labels_are_not_used(spark, make_docs, documents):
    """Wrong labels on held-out documents change nothing."""
    F = language.F
    wrong = documents.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, language.identify(d).collect())) for d in (documents, wrong))
    assert a == b


def test_machine_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([0, 1 + k % 7]), np.array([0.6, 0.8])) for k in range(50)] + [(np.array([9, 1 + k % 7]), np.array([0.6, 0.8])) for k in range(50)]
    w = language.fit_machine(rows, np.repeat([1.0, -1.0], 50))
    assert w[0] > 0 > w[9]


def test_edge_cases(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "hello there", "s", None), (None, "hello"), (5, "é"), (6, "the " * 100_000), (6, "the "), (6, "the ")] + [(k, "hello") for k in range(10, 20)]
    docs = make_docs(rows).withColumn("score", language.F.lit("x")).withColumn("n", language.F.lit("x"))
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == "en"
    assert language.identify(make_docs([]).limit(0)).count() == 0
    nothing = language.identify(make_docs([(1, "hello", "s", None)])).collect()
    assert nothing[0]["lang_pred"] == "und"


def test_sample_is_bounded_by_rows(make_docs, monkeypatch):
    """One doc_id on many rows, different or equal, counts row by row; exact repeats count once."""
    seen = []
    fit = language.fit
    monkeypatch.setattr(language, "fit", lambda rows: seen.append([r[0] for r in rows]) or fit(rows))
    rows = [(7, f"word {k}") for k in range(300)] + [(8, "the same")] * 300 + [(k, f"mot {k}", "s", "fr") for k in range(100, 103)]
    language.learn(make_docs(rows), per_language=10)
    assert seen[0].count("en") == 10 and seen[0].count("fr") == 3
    language.learn(make_docs([(8, "the same")] * 300), per_language=10)
    assert seen[1] == ["en"]
