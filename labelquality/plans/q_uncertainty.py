"""Probabilities, uncertainty and temperature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import calibration as cal, uncertainty as un
from ..sources import readers, sinks
from ..sources.shared import shared_dir
from . import inputs
from .oracle_parts import classes
from .registry import query, r6

GRID = [0.02, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0]
THRESHOLDS = [(0.5, 0.6, 0.7, 0.8, 0.9)[c % 5] for c in range(64)]


@query("softmax", f"WITH {classes(1.0)} SELECT id, c, round(p, 6) AS p FROM prob")
def softmax(spark, d):
    rows = inputs.class_logits(spark, d).select("id", F.posexplode(pr.softmax(F.col("logits"))).alias("c", "p"))
    return rows.select("id", F.col("c").cast("long").alias("c"), r6("p"))


@query("softmax_temperature", f"WITH {classes()} SELECT id, c, round(p, 6) AS p FROM prob")
def softmax_temperature(spark, d):
    p = pr.softmax(F.col("logits"), inputs.CLASS_TEMPERATURE)
    rows = inputs.class_logits(spark, d).select("id", F.posexplode(p).alias("c", "p"))
    return rows.select("id", F.col("c").cast("long").alias("c"), r6("p"))


@query("sigmoid_probs", f"WITH {classes(1.0)} SELECT id, c, round(s, 6) AS p FROM prob")
def sigmoid_probs(spark, d):
    rows = inputs.class_logits(spark, d).select("id", F.posexplode(pr.sigmoid_probs(F.col("logits"))).alias("c", "p"))
    return rows.select("id", F.col("c").cast("long").alias("c"), r6("p"))


@query("categorical_entropy", f"WITH {classes()} SELECT example_id, round(entropy, 6) AS entropy FROM pred")
def categorical_entropy(spark, d):
    return inputs.class_predictions(spark, d).select("example_id", r6("entropy"))


@query(
    "binary_entropy_mean",
    f"""WITH {classes(1.0)} SELECT id, round(avg(-(q*ln(q) + (1-q)*ln(1-q))), 6) AS entropy
      FROM (SELECT id, least(greatest(s, 1e-12), 1 - 1e-12) AS q FROM prob) t GROUP BY id""",
)
def binary_entropy_mean(spark, d):
    h = pr.binary_entropy_mean(pr.sigmoid_probs(F.col("logits")))
    return inputs.class_logits(spark, d).select("id", h.alias("entropy")).select("id", r6("entropy"))


@query("argmax_label", f"WITH {classes()} SELECT example_id, predicted_label::INT AS predicted_label FROM pred")
def argmax_label(spark, d):
    return inputs.class_predictions(spark, d).select("example_id", "predicted_label")


@query("max_prob", f"WITH {classes()} SELECT example_id, round(max_prob, 6) AS max_prob FROM pred")
def max_prob(spark, d):
    return inputs.class_predictions(spark, d).select("example_id", r6("max_prob"))


@query(
    "predictions",
    f"""WITH {classes()} SELECT example_id, gold_label, predicted_label::INT AS predicted_label, round(entropy, 6) AS entropy,
      round(max_prob, 6) AS max_prob, predicted_label = gold_label AS correct FROM pred""",
)
def predictions(spark, d):
    return inputs.class_predictions(spark, d).select(
        "example_id", "gold_label", "predicted_label", r6("entropy"), r6("max_prob"), "correct"
    )


_MULTI = f"""WITH {classes()}, thr AS (SELECT *, s >= (0.5 + 0.1 * (c % 5))::DOUBLE AS yes FROM prob),
  m AS (SELECT id, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE yes), '') AS labels,
    coalesce(max(s) FILTER (WHERE yes), 1 - max(s)) AS confidence FROM thr GROUP BY id)"""


@query("multilabel_predict", _MULTI + " SELECT id AS example_id, labels FROM m")
def multilabel_predict(spark, d):
    out = un.multilabel_predictions(inputs.class_logits(spark, d), thresholds=THRESHOLDS, temperature=inputs.CLASS_TEMPERATURE)
    return out.select("example_id", F.array_join("predicted_labels", ",").alias("labels"))


@query("multilabel_confidence", _MULTI + " SELECT id AS example_id, round(confidence, 6) AS confidence FROM m")
def multilabel_confidence(spark, d):
    out = un.multilabel_predictions(inputs.class_logits(spark, d), thresholds=THRESHOLDS, temperature=inputs.CLASS_TEMPERATURE)
    return out.select("example_id", r6("confidence"))


@query(
    "verify_predictions",
    f"""WITH {classes()}, seen AS (SELECT example_id, entropy AS again, total, entropy + CASE WHEN example_id % 50 = 0 THEN 0.25 ELSE 0 END AS entropy FROM pred)
      SELECT count(*) AS n, round(avg(total), 6) AS mean_probability_sum, round(max(abs(again - entropy)), 6) AS max_entropy_gap FROM seen""",
)
def verify_predictions(spark, d):
    """Predictions are written and read back; some carry a wrong entropy, which the check has to find."""
    wrong = F.col("entropy") + F.when(F.col("example_id") % 50 == 0, 0.25).otherwise(0.0)
    path = shared_dir(spark, "verify")
    sinks.write_predictions(inputs.class_predictions(spark, d).withColumn("entropy", wrong), path)
    fields = ["example_id", "probabilities", "entropy"]
    return un.verify_predictions(readers.load_predictions(spark, path, fields=fields)).select("n", r6("mean_probability_sum"), r6("max_entropy_gap"))


@query(
    "average_entropy_confidence",
    f"""WITH {classes()} SELECT round(avg(entropy), 6) AS average_entropy, round(avg(max_prob), 6) AS average_confidence FROM pred""",
)
def average_entropy_confidence(spark, d):
    return un.average_entropy_confidence(inputs.class_predictions(spark, d)).select(r6("average_entropy"), r6("average_confidence"))


def _losses() -> str:
    return f"""WITH {classes(1.0)}, grid AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in GRID)}]) AS t),
    loss AS (SELECT id, t, ln(sum(exp(z / t))) - max(z) FILTER (WHERE c = gold) / t AS l FROM cell, grid GROUP BY id, t)"""


@query("temperature_grid", _losses() + " SELECT t AS temperature, round(avg(l), 6) AS nll FROM loss GROUP BY t")
def temperature_grid(spark, d):
    return cal.temperature_grid(inputs.class_logits(spark, d), "logits", "gold", GRID).select("temperature", r6("nll"))


@query(
    "temperature_grid_best",
    _losses() + " SELECT arg_min(temperature, nll) AS temperature, round(min(nll), 6) AS nll FROM (SELECT t AS temperature, avg(l) AS nll FROM loss GROUP BY t) q",
)
def temperature_grid_best(spark, d):
    points = cal.temperature_grid(inputs.class_logits(spark, d), "logits", "gold", GRID)
    return cal.best_of_grid(points).select("temperature", r6("nll"))


# The oracle finds the zero of the loss slope by bisection on log(beta), 60 halvings of [1e-3, 1e3].
@query(
    "fit_temperature",
    f"""WITH RECURSIVE {classes(1.0)},
    v AS (SELECT id, list(z ORDER BY c) AS zs, max(z) FILTER (WHERE c = gold) AS zg FROM cell GROUP BY id),
    bis AS (
      SELECT 0 AS i, ln(1e-3) AS lo, ln(1e3) AS hi
      UNION ALL
      SELECT i + 1, CASE WHEN g > 0 THEN lo ELSE mid END, CASE WHEN g > 0 THEN mid ELSE hi END FROM (
        SELECT i, lo, hi, (lo + hi) / 2 AS mid,
          (SELECT avg(list_sum(list_transform(v.zs, lambda x: x * exp(exp((lo + hi) / 2) * (x - list_max(v.zs)))))
                      / list_sum(list_transform(v.zs, lambda x: exp(exp((lo + hi) / 2) * (x - list_max(v.zs))))) - v.zg) FROM v) AS g
        FROM bis WHERE i < 60) s)
    SELECT round(exp(-(lo + hi) / 2), 4) AS temperature FROM bis WHERE i = 60""",
)
def fit_temperature(spark, d):
    t = cal.fit_temperature(inputs.class_logits(spark, d), "logits", "gold")
    return spark.createDataFrame([(t,)], "temperature double").select(F.round("temperature", 4).alias("temperature"))


@query(
    "apply_calibration",
    f"""WITH {classes(0.5)}, l AS (SELECT id AS example_id, sum(z / 0.5) AS logit_sum FROM cell GROUP BY id)
      SELECT example_id, predicted_label::INT AS predicted_label, round(max_prob, 6) AS max_prob,
      round(entropy, 6) AS entropy, round(logit_sum, 6) AS logit_sum FROM pred JOIN l USING (example_id)""",
)
def apply_calibration(spark, d):
    out = un.predictions(inputs.class_logits(spark, d), temperature=0.5)
    return out.select("example_id", "predicted_label", r6("max_prob"), r6("entropy"), r6(pr.array_sum(F.col("logits")), "logit_sum"))
