"""The stages one after the other against brute force, and run() against the stages."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from labelquality.sources.shared import stored

from test_mixing import slow_targets
from test_simhash import slow_components, slow_print


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def steps(spark, small, documents):
    out, docs = [documents], documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, small), name)
        out.append(docs)
    return out


def test_columns(steps):
    assert all(s.schema == steps[0].schema for s in steps[1:5])
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


def test_language(steps):
    kept = [r for r in steps[0].collect() if any(c.isalpha() for c in r["text"] or "")]
    assert rows_of(steps[1]) == sorted(map(tuple, kept), key=str)


def test_near_copies(steps):
    rows = steps[1].collect()
    stay = {i for i, _, c in slow_components([(r["doc_id"], slow_print(r["text"])) for r in rows]) if i == c}
    assert rows_of(steps[2]) == sorted((tuple(r) for r in rows if r["doc_id"] in stay), key=str) and len(stay) < len(rows)


def test_repeats(steps):
    rows, seen = steps[2].collect(), {}
    for r in rows:
        data = r["text"].encode()
        for k in range(len(data) - 399):
            seen[data[k : k + 400]] = seen.get(data[k : k + 400], 0) + 1
    want = []
    for r in rows:
        data = r["text"].encode()
        cover = bytearray(len(data))
        for k in range(len(data) - 399):
            if seen[data[k : k + 400]] > 1:
                cover[k : k + 400] = b"\1" * 400
        text = bytes(b for b, c in zip(data, cover) if not c).decode("utf-8", "ignore")
        want.append(tuple(r.asDict() | {"text": text, "n_chars": len(text)} for r in [r])[0])
    got = sorted((r.asDict() for r in steps[3].collect()), key=lambda r: r["doc_id"])
    assert got == sorted(want, key=lambda r: r["doc_id"])
    assert sum(r["n_chars"] for r in got) < sum(r["n_chars"] for r in rows)


def test_mixing(steps):
    rows, sizes, taken = steps[3].collect(), {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    times, same = {}, {r["doc_id"]: tuple(r) for r in rows}
    for r in steps[4].collect():
        assert tuple(r) == same[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    assert max(times.values()) <= 2
    want, most = slow_targets(sizes), max(len(r["text"].split()) for r in rows)
    assert all(abs(taken.get(s, 0) - want[s]) <= most for s in sizes)


def test_encoding(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in steps[4].collect():
        ids = np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()
        want.append((r["doc_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest(), ids))
    cols = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted((*r[:4], bytes(r[4])) for r in steps[5].select(cols).collect()) == sorted(want)


def test_run(spark, small, steps):
    assert rows_of(corpus_pipeline.run(spark, small).select("doc_id", "ids_sha256")) == rows_of(steps[5].select("doc_id", "ids_sha256"))


def test_edge_cases(spark, make_docs, small):
    """Null ids and texts, empty and repeated rows, extra columns, an empty table."""
    rows = [(1, None), (2, ""), (3, "12"), (None, "hello world"), (4, "hello world of words"), (4, "hello world of words"), (5, "long " * 50_000, None, None), (6, "été")]
    for docs in (make_docs(rows + [(k, f"hello number {k}") for k in range(10, 20)]), make_docs([]).limit(0)):
        for name in ("k1", "_k1", "_K2", "_row", "_copies", "_turn", "deal", "h"):
            docs = docs.withColumn(name, corpus_pipeline.F.lit(-7))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stored(stage(spark, docs, small), name)
            assert after.columns == docs.columns and after.filter("_row <> -7 or _k1 <> -7 or _copies <> -7 or deal <> -7").count() == 0
            docs = after
        docs = corpus_pipeline.STAGES[-1][1](spark, docs, small)
        assert docs.filter("n_tokens < 0").count() == 0


def test_mixing_counts_rows_without_and_with_shared_ids_one_by_one(spark, make_docs):
    """The words of each source miss its target by less than a document, whatever the ids."""
    for ids in ([None] * 90, [7] * 90):
        rows = [(i, " ".join(["w"] * (3 + k % 5)), "abc"[k % 3]) for k, i in enumerate(ids)]
        sizes, taken = {}, {}
        for _, t, s in rows:
            sizes[s] = sizes.get(s, 0) + len(t.split())
        for r in corpus_pipeline.mixed(spark, make_docs(rows), "").collect():
            taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
        assert all(abs(taken.get(s, 0) - want) <= 7 for s, want in slow_targets(sizes).items())


def test_language_without_labels_keeps_what_has_a_letter(spark, make_docs):
    rows = [(1, "clean text", "s", None), (1, "12 34", "s", None), (None, "more of it", "s", None), (2, None, "s", None)]
    got = corpus_pipeline.known_language(spark, make_docs(rows), "").collect()
    assert sorted(r["text"] for r in got) == ["clean text", "more of it"]


def test_language_drops_what_predict_calls_und(spark, make_docs):
    """The stage's decision is the prediction, row by row, also where ids are null or repeated."""
    judge = corpus_pipeline.language._judge
    docs = make_docs([(k, "the words of a text", "s", "en") for k in range(20)] + [(None, "12 34"), (None, "the word"), (3, "- -"), (3, "a word")])
    model = corpus_pipeline.language.learn(docs)
    assert judge(model, [b"12 34", b"a word"])[0].tolist() == ["und", "en"]
    want = sorted(r["lang_pred"] for r in corpus_pipeline.language.predict(docs, model).collect() if r["lang_pred"] != "und")
    kept = corpus_pipeline.language.keep_known(docs, model)
    assert kept.count() == len(want) == 22 and sorted(r["lang_pred"] for r in corpus_pipeline.language.predict(kept, model).collect()) == want
