"""Calibration queries: binary scores from lineitem, ten-class predictions from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import agreement as ag, calibration as cal
from . import inputs
from .oracle_parts import RANK_AUC, SCORES, bundle_rows, classes, edges
from .registry import query, r6


def _binned(source: str, p: str, y: str, bins: int, by: str = "") -> str:
    """CTEs with bin counts ``bc`` (b NULL = outside every bin)."""
    g = f"{by}, " if by else ""
    return f"""{edges(bins)},
    bc AS (SELECT {g}b, count(*) AS n, sum({p}) AS sp, sum({y})::DOUBLE AS sy FROM {source} LEFT JOIN eb ON {p} > lo AND {p} <= hi GROUP BY {g}b)"""


_BINARY = f"{SCORES}, {_binned('bs', 'p', 'y', 10)}"
_MULTI = f"{classes()}, pc AS (SELECT max_prob AS p, (predicted_label = gold_label)::INT AS y FROM pred), {_binned('pc', 'p', 'y', 15)}"
_SETS = f"{classes()}, cells AS (SELECT c, s AS p, (c = gold OR c = (gold + 1) % 10)::INT AS y FROM prob)"


def _confident(spark, d):
    preds = inputs.class_predictions(spark, d)
    return preds.select("max_prob", "correct")


@query(
    "reliability_bins",
    f"""WITH {_MULTI} SELECT eb.b::INT AS bin, round(lo, 6) AS lower, round(hi, 6) AS upper, coalesce(n, 0) AS n,
      round(CASE WHEN n > 0 THEN sp / n ELSE (lo + hi) / 2 END, 6) AS confidence, round(coalesce(sy / n, 0), 6) AS accuracy
      FROM eb LEFT JOIN bc ON bc.b = eb.b""",
)
def reliability_bins(spark, d):
    bins = cal.reliability_bins(_confident(spark, d), F.col("max_prob"), F.col("correct"))
    return bins.select("bin", r6("lower"), r6("upper"), "n", r6("confidence"), r6("accuracy"))


@query(
    "reliability_bins_binary",
    f"""WITH {_BINARY} SELECT eb.b::INT AS bin, round(lo, 6) AS lower, round(hi, 6) AS upper, coalesce(n, 0) AS n,
      round(CASE WHEN n > 0 THEN sp / n ELSE (lo + hi) / 2 END, 6) AS confidence, round(coalesce(sy / n, 0), 6) AS accuracy
      FROM eb LEFT JOIN bc ON bc.b = eb.b""",
)
def reliability_bins_binary(spark, d):
    bins = cal.reliability_bins(inputs.binary_scores(spark, d), F.col("p"), F.col("y"), 10)
    return bins.select("bin", r6("lower"), r6("upper"), "n", r6("confidence"), r6("accuracy"))


@query("ece", f"WITH {_MULTI} SELECT sum(n)::BIGINT AS n, round(sum(CASE WHEN b IS NOT NULL THEN abs(sp - sy) END) / sum(n), 6) AS ece FROM bc")
def ece(spark, d):
    return cal.ece(inputs.class_predictions(spark, d), "probabilities", "gold_label").select("n", r6("ece"))


@query("ece_binary", f"WITH {_BINARY} SELECT sum(n)::BIGINT AS n, round(sum(CASE WHEN b IS NOT NULL THEN abs(sp - sy) END) / sum(n), 6) AS ece FROM bc")
def ece_binary(spark, d):
    return cal.ece_binary(inputs.binary_scores(spark, d), "p", "y").select("n", r6("ece"))


@query(
    "ece_multilabel",
    f"""WITH {_SETS}, {_binned('cells', 'p', 'y', 15, 'c')},
      per AS (SELECT c, sum(CASE WHEN b IS NOT NULL THEN abs(sp - sy) END) / sum(n) AS e FROM bc GROUP BY c)
      SELECT c::VARCHAR AS label, round(e, 6) AS ece FROM per UNION ALL SELECT 'macro', round(avg(e), 6) FROM per""",
)
def ece_multilabel(spark, d):
    return cal.ece_multilabel(_probability_sets(spark, d), "probabilities", "truth").select("label", r6("ece"))


def _probability_sets(spark, d):
    base = inputs.class_logits(spark, d)
    return base.select(
        pr.sigmoid_probs(F.col("logits"), inputs.CLASS_TEMPERATURE).alias("probabilities"),
        inputs.multilabel_truth(F.col("gold")).alias("truth"),
    )


@query("mce", f"WITH {_BINARY} SELECT sum(n)::BIGINT AS n, round(max(CASE WHEN b IS NOT NULL THEN abs(sp - sy) / n END), 6) AS mce FROM bc")
def mce(spark, d):
    return cal.mce(inputs.binary_scores(spark, d), "p", "y").select("n", r6("mce"))


@query("brier", f"WITH {classes()} SELECT count(*) AS n, round(avg(sq), 6) AS brier_score FROM pred")
def brier(spark, d):
    return cal.brier(inputs.class_predictions(spark, d), "probabilities", "gold_label").select("n", r6("brier_score"))


@query(
    "brier_multilabel",
    f"""WITH {_SETS}, per AS (SELECT c, avg((p - y) ** 2) AS e FROM cells GROUP BY c)
      SELECT c::VARCHAR AS label, round(e, 6) AS brier_score FROM per UNION ALL SELECT 'macro', round(avg(e), 6) FROM per""",
)
def brier_multilabel(spark, d):
    return cal.brier_multilabel(_probability_sets(spark, d), "probabilities", "truth").select("label", r6("brier_score"))


@query("brier_binary", f"WITH {SCORES} SELECT count(*) AS n, round(avg((p - y) ** 2), 6) AS brier_score FROM bs")
def brier_binary(spark, d):
    return cal.brier_binary(inputs.binary_scores(spark, d), "p", "y").select("n", r6("brier_score"))


_MURPHY = """sum(CASE WHEN b IS NOT NULL THEN n * (sp / n - sy / n) ** 2 END) / sum(n) AS rel,
   sum(CASE WHEN b IS NOT NULL THEN n * (sy / n - base) ** 2 END) / sum(n) AS res
   FROM bc, (SELECT sum(sy) / sum(n) AS base FROM bc) t"""


@query(
    "reliability_resolution",
    f"WITH {_BINARY}, m AS (SELECT sum(n)::BIGINT AS n, {_MURPHY}) SELECT n, round(rel, 6) AS reliability, round(res, 6) AS resolution FROM m",
)
def reliability_resolution(spark, d):
    return cal.reliability_resolution(inputs.binary_scores(spark, d), "p", "y").select("n", r6("reliability"), r6("resolution"))


@query(
    "calibration_metrics",
    f"""WITH {_BINARY}, m AS (SELECT sum(n)::BIGINT AS n, sum(CASE WHEN b IS NOT NULL THEN abs(sp - sy) END) / sum(n) AS ece,
        max(CASE WHEN b IS NOT NULL THEN abs(sp - sy) / n END) AS mce, {_MURPHY})
      SELECT n, round(ece, 6) AS ece, round(mce, 6) AS mce, round(rel, 6) AS reliability, round(res, 6) AS resolution,
        (SELECT round(avg((p - y) ** 2), 6) FROM bs) AS brier_score FROM m""",
)
def calibration_metrics(spark, d):
    m = cal.calibration_metrics(inputs.binary_scores(spark, d), "p", "y")
    return m.select("n", *[r6(c) for c in ("ece", "mce", "reliability", "resolution", "brier_score")])


_F1 = "2 * prec * rec / (prec + rec + 1e-8::DOUBLE)"


@query(
    "comprehensive_metrics_scores",
    f"""WITH {_BINARY}, ps AS (SELECT p AS score, y FROM bs), d AS (SELECT y AS gold, (p >= 0.5)::INT AS pred, grp FROM bs),
      cells AS (SELECT gold, pred, count(*) AS n FROM d GROUP BY ALL), gcells AS (SELECT grp, gold, pred, count(*) AS n FROM d GROUP BY ALL),
      cal AS (SELECT sum(CASE WHEN b IS NOT NULL THEN abs(sp - sy) END) / sum(n) AS ece, max(CASE WHEN b IS NOT NULL THEN abs(sp - sy) / n END) AS mce, {_MURPHY}),
      g AS (SELECT score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM ps GROUP BY score),
      cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
      curve AS (SELECT *, tp::DOUBLE / (tp + fp) AS prec, tp::DOUBLE / np AS rec FROM cum),
      {RANK_AUC}, {bundle_rows('cells', 'gcells')}
      SELECT * FROM bundle
      UNION ALL SELECT 'calibration', 'all', u.m, round(u.v, 6) FROM (SELECT unnest(['ece', 'mce', 'reliability', 'resolution']) AS m, unnest([ece, mce, rel, res]) AS v FROM cal) u
      UNION ALL SELECT 'calibration', 'all', 'brier_score', round(avg((p - y) ** 2), 6) FROM bs
      UNION ALL SELECT 'trust_prediction', 'all', 'roc_auc', round(a, 6) FROM auc
      UNION ALL SELECT 'trust_prediction', 'all', 'pr_auc', round(sum(prec * pos / np), 6) FROM curve
      UNION ALL SELECT 'trust_prediction', 'all', 'precision_at_90_recall', round(max(prec) FILTER (WHERE rec >= 0.9), 6) FROM curve
      UNION ALL SELECT 'trust_prediction', 'all', 'precision_at_95_recall', round(max(prec) FILTER (WHERE rec >= 0.95), 6) FROM curve
      UNION ALL SELECT 'trust_prediction', 'all', 'f1_score', round(max({_F1}), 6) FROM curve""",
)
def comprehensive_metrics_scores(spark, d):
    """All metric groups from one table of scores; the score also stands in as the trust score."""
    rows = inputs.binary_scores(spark, d).select(
        "p", "y", (F.col("p") >= 0.5).cast("int").alias("q"), F.array("grp").alias("groups")
    )
    return ag.comprehensive_metrics(rows, "y", "q", "p", "groups", "y", "p").select("section", "group", "metric", r6("value"))
