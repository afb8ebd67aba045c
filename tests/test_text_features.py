"""Text features against plain Python on whole documents and on awkward strings."""

import re

import pytest
from pyspark.sql import functions as F

from labelquality.functions import fixed, text as tx
from labelquality.operators import text_features as tf

SENTENCES = [
    "", " ", "A.", "None of it was not bad, but it might be good!", "I think it can't be. Perhaps it's unlikely?",
    "Ça été très naïf… über, 日本語。 not", "a b c\x1cd", "x² ý z_1 ...!!", "WOW!!! Terrible, awful; HATE it",
    "no. no no! never", "beautiful universities everywhere", "so very quite\nreally\tpretty",
]


def expected(text):
    low, words = text.lower(), text.split()
    count = lambda ps: sum(len(re.findall(p, low)) for p in ps)
    alt = lambda ws: r"\b(" + "|".join(ws) + r")\b"
    sentences = [s for s in re.split(r"[.!?]+", text) if s.strip()]
    asl = sum(len(s.split()) for s in sentences) / len(sentences) if sentences else 0.0
    neg_words = [alt(fixed.NEGATION_WORDS), alt(fixed.NEGATION_CONTRACTIONS)]
    prefix = [r"\b(" + "|".join(fixed.NEGATION_PREFIXES) + r")\w*"]
    doubled = any(sum(len(re.findall(p, s)) for p in neg_words) >= 2 for s in re.split(r"[.!?]+", low))
    n = max(len(text), 1)
    return {
        "char_count": len(text),
        "word_count": len(words),
        "sentence_count": len(re.split(r"[.!?]+", text)),
        "avg_word_length": sum(map(len, words)) / len(words) if words else 0.0,
        "punctuation_ratio": len(re.findall(r"[^\w\s]", text)) / n,
        "caps_ratio": len(re.findall(r"[A-Z]", text)) / n,
        "negation_count": count(neg_words) + count(prefix),
        "negation_density": (count(neg_words) + count(prefix)) / max(len(words), 1),
        "negation_prefix_count": count(prefix),
        "double_negation": float(doubled),
        "hedge_count": count([alt(fixed.HEDGE_MODALS), alt(fixed.HEDGE_DEGREES), alt(fixed.HEDGE_PHRASES), alt(fixed.HEDGE_LIKELIHOODS)]),
        "uncertainty_markers": count([alt(fixed.HEDGE_PHRASES), alt(fixed.HEDGE_LIKELIHOODS)]),
        "intensifier_count": count([alt(fixed.INTENSIFIERS_STRONG), alt(fixed.INTENSIFIERS_MILD)]),
        "positive_word_count": sum(w in low for w in fixed.POSITIVE_WORDS),
        "negative_word_count": sum(w in low for w in fixed.NEGATIVE_WORDS),
        "avg_sentence_length": asl,
        "flesch_reading_ease": max(0.0, 100 - 2 * asl),
    }


def check(rows):
    for row in rows:
        for name, value in expected(row["text"]).items():
            assert row[name] == pytest.approx(value, abs=1e-9), (name, row["text"][:80])


def test_awkward_strings(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, text string")
    check(tf.text_features(df, keep=("id", "text")).collect())


def test_whole_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(tf.text_features(docs, keep=("doc_id", "text")).collect())


def test_ranges_and_counts(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "id int, text string")
    for r in tf.text_features(df).collect():
        assert 0 <= r.punctuation_ratio <= 1 and 0 <= r.caps_ratio <= 1
        assert -1 <= r.sentiment_compound <= 1 and r.sentiment_pos + r.sentiment_neg + r.sentiment_neu == 1
        assert r.flesch_reading_ease >= 0 and set(tf.FEATURES) <= set(r.asDict())


def test_null_text_stays_null(spark):
    row = tf.text_features(spark.createDataFrame([(1, None)], "id int, text string")).first()
    assert all(row[c] is None for c in ("char_count", "word_count", "negation_density", "sentiment_compound", "avg_sentence_length"))


def test_readability(spark):
    df = spark.createDataFrame([(1, "The cat sat. Universities operate libraries.")], "id int, text string")
    r = tf.text_features(df).first()
    words, sentences, syllables, poly = 6, 2, 1 + 1 + 1 + 5 + 4 + 3, 3
    assert r.flesch_kincaid_grade == pytest.approx(0.39 * words / sentences + 11.8 * syllables / words - 15.59)
    assert r.gunning_fog == pytest.approx(0.4 * (words / sentences + 100 * poly / words))
    assert r.smog_index == pytest.approx(1.043 * (poly * 30 / sentences) ** 0.5 + 3.1291)


def test_hash_and_preview(spark):
    import hashlib

    text = "é" * 101
    row = spark.createDataFrame([(text,)], "t string").select(tx.text_hash(F.col("t")), tx.text_preview(F.col("t")), tx.text_preview(F.lit("abc"))).first()
    assert tuple(row) == (hashlib.sha256(text.encode()).hexdigest()[:16], "é" * 100 + "...", "abc")


def test_unused_features_are_pruned(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = tf.text_features(docs, keep=("doc_id",)).select("doc_id", "caps_ratio")._jdf.queryExecution().executedPlan().toString()
    assert "A-Z" in plan and "might" not in plan and "aeiouy" not in plan
