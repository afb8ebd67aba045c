"""All text features of a column in one narrow pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed, text as tx
from ..functions.scalar import ratio

BASIC = ["char_count", "word_count", "sentence_count", "avg_word_length", "punctuation_ratio", "caps_ratio"]
NEGATION = ["negation_count", "negation_density", "double_negation", "negation_prefix_count"]
HEDGE = ["hedge_count", "hedge_density", "intensifier_count", "uncertainty_markers"]
SENTIMENT = [
    "sentiment_compound", "sentiment_pos", "sentiment_neg", "sentiment_neu", "positive_word_count", "negative_word_count",
]
READABILITY = ["flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "smog_index", "avg_sentence_length"]
FEATURES = BASIC + NEGATION + HEDGE + SENTIMENT + READABILITY


def text_features(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Every feature for ``text_col``; counts come first, ratios are then derived from the counts.

    Unused features are pruned by the optimizer: selecting two columns runs only their patterns.
    """
    t, cues, spaced = F.col(text_col), F.col("_cues"), F.col("_spaced")
    words = df.select(*keep, t, tx.cue_words(t).alias("_cues"), tx.single_spaced(t).alias("_spaced"))
    counted = words.select(
        *keep,
        t,
        tx.spaced_words(spaced).alias("word_count"),
        tx.spaced_letters(spaced).alias("_letters"),
        tx.spoken_sentences(spaced).alias("_sentences"),
        tx.sentence_words(spaced).alias("_sentence_words"),
        tx.polysyllable_count(spaced).alias("_polysyllables"),
        (tx.count_cues(cues, tx.NEGATIONS) + tx.contraction_count(t)).alias("_negations"),
        tx.count_prefixed(cues).alias("negation_prefix_count"),
        tx.count_cues(cues, tx.HEDGES).alias("_hedges"),
        (tx.count_cues(cues, fixed.HEDGE_LIKELIHOODS) + tx.phrase_count(t)).alias("uncertainty_markers"),
        tx.count_cues(cues, tx.INTENSIFIERS).alias("intensifier_count"),
    )
    counts = counted.select(
        *keep,
        "word_count",
        "_letters",
        "negation_prefix_count",
        "uncertainty_markers",
        "intensifier_count",
        (F.col("_negations") + F.col("negation_prefix_count")).alias("negation_count"),
        (F.col("_hedges") + F.col("uncertainty_markers")).alias("hedge_count"),
        F.when(F.col("_negations") >= 2, tx.double_negation(t)).when(t.isNotNull(), 0.0).alias("double_negation"),
        tx.char_count(t).alias("char_count"),
        tx.sentence_count(t).alias("sentence_count"),
        tx.punctuation_count(t).alias("_punct"),
        tx.caps_count(t).alias("_caps"),
        tx.positive_word_count(t).alias("positive_word_count"),
        tx.negative_word_count(t).alias("negative_word_count"),
        tx.syllable_count(t).alias("_syllables"),
        "_sentences",
        "_sentence_words",
        "_polysyllables",
    )
    c = F.col
    present = c("char_count").isNotNull()
    words = F.greatest(c("word_count"), F.lit(1))
    pos, neg = c("positive_word_count"), c("negative_word_count")
    total = counts.withColumn("avg_sentence_length", F.when(present, ratio(c("_sentence_words"), c("_sentences"))))
    return total.select(
        *keep,
        "char_count",
        "word_count",
        "sentence_count",
        F.when(present, ratio(c("_letters"), c("word_count"))).alias("avg_word_length"),
        (c("_punct") / F.greatest(c("char_count"), F.lit(1))).alias("punctuation_ratio"),
        (c("_caps") / F.greatest(c("char_count"), F.lit(1))).alias("caps_ratio"),
        "negation_count",
        (c("negation_count") / words).alias("negation_density"),
        "double_negation",
        "negation_prefix_count",
        "hedge_count",
        (c("hedge_count") / words).alias("hedge_density"),
        "intensifier_count",
        "uncertainty_markers",
        F.when(present, ratio(pos - neg, pos + neg)).alias("sentiment_compound"),
        F.when(present, ratio(pos, pos + neg)).alias("sentiment_pos"),
        F.when(present, ratio(neg, pos + neg)).alias("sentiment_neg"),
        F.when(present, (pos + neg == 0).cast("double")).alias("sentiment_neu"),
        "positive_word_count",
        "negative_word_count",
        tx.flesch_from(c("avg_sentence_length")).alias("flesch_reading_ease"),
        tx.flesch_kincaid_grade(c("word_count"), c("_sentences"), c("_syllables")).alias("flesch_kincaid_grade"),
        tx.gunning_fog(c("word_count"), c("_sentences"), c("_polysyllables")).alias("gunning_fog"),
        tx.smog_index(c("_sentences"), c("_polysyllables")).alias("smog_index"),
        "avg_sentence_length",
    )


def length_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Summary of text lengths in characters; the median (the lower of two) is exact.

    Texts are counted per length first; the running count goes over one row per length.
    """
    counts = df.filter(F.col(text_col).isNotNull()).groupBy(F.length(text_col).alias("len")).agg(F.count("*").alias("rows"))
    everything = Window.partitionBy()  # one row per length
    run = counts.withColumn("upto", F.sum("rows").over(Window.orderBy("len"))).withColumn("total", F.sum("rows").over(everything))
    return run.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        (F.sum(F.col("len") * F.col("rows")) / F.sum("rows")).alias("mean_len"),
        F.sum(F.col("len") * F.col("rows")).alias("total_len"),
        F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("len"))).alias("median_len"),
    )
