"""Agreement, classification and fairness queries.

Two inputs: the two codings of the events table (five string classes), and parsed annotations against gold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as ag
from . import inputs
from .oracle_parts import CODERS, LABELLED, SUPERVISED, class_table, classes, parsed
from .registry import query, r6

_CELLS = f"{CODERS}, cells AS (SELECT a AS gold, b AS pred, count(*) AS n FROM coders GROUP BY a, b), {class_table('cells')}"
_LABELS = "labs AS (SELECT label, row_number() OVER (ORDER BY label) AS i, count(*) OVER () AS k FROM cls)"
_BIN_CELLS = f"{parsed()}, cells AS (SELECT gold_label AS gold, llm_label AS pred, count(*) AS n FROM ann WHERE is_valid AND llm_label >= 0 GROUP BY 1, 2), {class_table('cells')}"


def _valid(spark, d):
    return inputs.annotations(spark, d).filter("is_valid AND llm_label >= 0")


@query(
    "confusion_matrix",
    f"""WITH {_CELLS} SELECT g.label AS gold, p.label AS pred, coalesce(c.n, 0) AS n
      FROM cls g, cls p LEFT JOIN cells c ON c.gold = g.label AND c.pred = p.label""",
)
def confusion_matrix(spark, d):
    return ag.confusion_matrix(inputs.coders(spark, d), "a", "b")


@query(
    "confusion_normalized",
    f"""WITH {_CELLS} SELECT g.label AS gold, p.label AS pred, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0)::DOUBLE / g.support, 6) AS share
      FROM cls g, cls p LEFT JOIN cells c ON c.gold = g.label AND c.pred = p.label""",
)
def confusion_normalized(spark, d):
    return ag.confusion_normalized(inputs.coders(spark, d), "a", "b").select("gold", "pred", "n", r6("share"))


@query("accuracy", f"WITH {CODERS} SELECT count(*) AS n, round(avg((a = b)::INT), 6) AS accuracy FROM coders")
def accuracy(spark, d):
    return ag.accuracy(inputs.coders(spark, d), "a", "b").select("n", r6("accuracy"))


@query("percentage_agreement", f"WITH {CODERS} SELECT round(avg((a = b)::INT), 6) AS percentage_agreement FROM coders")
def percentage_agreement(spark, d):
    return ag.accuracy(inputs.coders(spark, d), "a", "b").select(r6("accuracy", "percentage_agreement"))


@query(
    "agreement_rate",
    f"WITH {parsed()} SELECT count(*) AS n, round(avg((gold_label = llm_label)::INT), 6) AS agreement_rate FROM ann WHERE is_valid AND llm_label >= 0",
)
def agreement_rate(spark, d):
    return ag.accuracy(_valid(spark, d), "gold_label", "llm_label").select("n", r6("accuracy", "agreement_rate"))


@query(
    "precision_recall_f1",
    f"WITH {_CELLS} SELECT label, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1_score, support FROM sc",
)
def precision_recall_f1(spark, d):
    m = ag.per_class_metrics(inputs.coders(spark, d), "a", "b")
    return m.select("label", r6("precision"), r6("recall"), r6("f1_score"), "support")


@query(
    "average_binary",
    f"WITH {_BIN_CELLS} SELECT round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1_score FROM sc WHERE label = 1",
)
def average_binary(spark, d):
    m = ag.averaged_metrics(_valid(spark, d), "gold_label", "llm_label", "binary")
    return m.select(r6("precision"), r6("recall"), r6("f1_score"))


@query(
    "average_macro",
    f"WITH {_CELLS} SELECT round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(f1), 6) AS f1_score FROM sc",
)
def average_macro(spark, d):
    m = ag.averaged_metrics(inputs.coders(spark, d), "a", "b", "macro")
    return m.select(r6("precision"), r6("recall"), r6("f1_score"))


@query(
    "average_weighted",
    f"""WITH {_CELLS} SELECT round(sum(pr * support) / sum(support), 6) AS precision, round(sum(rc * support) / sum(support), 6) AS recall,
      round(sum(f1 * support) / sum(support), 6) AS f1_score FROM sc""",
)
def average_weighted(spark, d):
    m = ag.averaged_metrics(inputs.coders(spark, d), "a", "b", "weighted")
    return m.select(r6("precision"), r6("recall"), r6("f1_score"))


@query(
    "classification_report",
    f"""WITH {_CELLS}, t AS (SELECT sum(support)::BIGINT AS n, sum(tp)::DOUBLE / sum(support) AS acc, avg(pr) AS mp, avg(rc) AS mr, avg(f1) AS mf,
        sum(pr * support) / sum(support) AS wp, sum(rc * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM sc)
      SELECT label AS class, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1_score, support FROM sc
      UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM t
      UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), n FROM t
      UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), n FROM t""",
)
def classification_report(spark, d):
    m = ag.classification_report(inputs.coders(spark, d), "a", "b")
    return m.select("class", r6("precision"), r6("recall"), r6("f1_score"), "support")


@query(
    "agreement_metrics",
    f"""WITH {_BIN_CELLS}, tot AS (SELECT sum(support)::DOUBLE AS n, sum(tp) / sum(support)::DOUBLE AS po,
        sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)) AS pe FROM cls),
      base AS (SELECT count(*) AS num_samples, count(*) FILTER (WHERE llm_label >= 0) AS num_valid,
        avg(llm_confidence_numeric) FILTER (WHERE llm_label >= 0) AS conf FROM ann WHERE is_valid)
      SELECT num_samples, num_valid, round(po, 6) AS accuracy, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1_score,
        round((po - pe) / (1 - pe), 6) AS cohen_kappa, round(po, 6) AS agreement_rate, round(conf, 6) AS average_confidence
      FROM base, tot, sc WHERE sc.label = 1""",
)
def agreement_metrics(spark, d):
    m = ag.agreement_metrics(inputs.annotations(spark, d))
    names = ["accuracy", "precision", "recall", "f1_score", "cohen_kappa", "agreement_rate", "average_confidence"]
    return m.select("num_samples", "num_valid", *[r6(c) for c in names])


@query(
    "cohen_kappa",
    f"""WITH {_CELLS}, t AS (SELECT sum(support)::BIGINT AS n, sum(tp)::DOUBLE / sum(support) AS po,
      sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)) AS pe FROM cls)
      SELECT n, round((po - pe) / (1 - pe), 6) AS cohen_kappa FROM t""",
)
def cohen_kappa(spark, d):
    return ag.cohen_kappa(inputs.coders(spark, d), "a", "b").select("n", r6("cohen_kappa"))


# Coincidence-matrix form: every unit contributes its two ordered value pairs.
@query(
    "krippendorff_alpha",
    f"""WITH {CODERS}, pairs AS (SELECT a AS u, b AS v FROM coders UNION ALL SELECT b, a FROM coders),
      o AS (SELECT u, v, count(*)::DOUBLE AS n FROM pairs GROUP BY u, v), m AS (SELECT u, sum(n) AS n FROM o GROUP BY u),
      t AS (SELECT sum(n) AS n FROM m), dis AS (SELECT sum(n) AS d FROM o WHERE u <> v),
      expct AS (SELECT sum(x.n * y.n) AS e FROM m x, m y WHERE x.u <> y.u)
      SELECT (t.n / 2)::BIGINT AS n, round(1 - (t.n - 1) * d / e, 6) AS krippendorff_alpha FROM t, dis, expct""",
)
def krippendorff_alpha(spark, d):
    return ag.krippendorff_alpha(inputs.coders(spark, d), "a", "b").select("n", r6("krippendorff_alpha"))


@query(
    "weighted_agreement",
    f"""WITH {_CELLS}, {_LABELS} SELECT sum(c.n)::BIGINT AS n, round(sum(c.n * (1 - abs(x.i - y.i)::DOUBLE / (x.k - 1))) / sum(c.n), 6) AS weighted_agreement
      FROM cells c JOIN labs x ON x.label = c.gold JOIN labs y ON y.label = c.pred""",
)
def weighted_agreement(spark, d):
    return ag.weighted_agreement(inputs.coders(spark, d), "a", "b").select("n", r6("weighted_agreement"))


def _label_sets(spark, d):
    """True and predicted class sets of the 64-class rows."""
    from ..operators import uncertainty as un

    base = inputs.class_logits(spark, d).withColumn("truth", inputs.multilabel_truth(F.col("gold")))
    return un.multilabel_predictions(base, thresholds=0.8, temperature=inputs.CLASS_TEMPERATURE, keep=["truth"])


_SETS = f"""{classes()}, sets AS (SELECT id, c, s >= 0.8::DOUBLE AS p, (c = gold OR c = (gold + 1) % 10) AS t FROM prob)"""


@query(
    "exact_match",
    f"WITH {_SETS} SELECT count(*) AS n, round(avg(same::INT), 6) AS exact_match FROM (SELECT id, bool_and(p = t) AS same FROM sets GROUP BY id) q",
)
def exact_match(spark, d):
    return ag.exact_match(_label_sets(spark, d), "truth", "predicted_labels").select("n", r6("exact_match"))


@query(
    "multilabel_macro_f1",
    f"""WITH {_SETS} SELECT round(avg(f), 6) AS macro_f1 FROM (SELECT c, coalesce(2.0 * count(*) FILTER (WHERE p AND t) /
      nullif(count(*) FILTER (WHERE p) + count(*) FILTER (WHERE t), 0), 0) AS f FROM sets GROUP BY c) q""",
)
def multilabel_macro_f1(spark, d):
    return ag.multilabel_macro_f1(_label_sets(spark, d), "truth", "predicted_labels", 64).select(r6("macro_f1"))


@query(
    "multilabel_kappa",
    f"""WITH {_SETS} SELECT c::INT AS label, round((po - pe) / nullif(1 - pe, 0), 6) AS cohen_kappa FROM (
      SELECT c, avg((p = t)::INT) AS po, avg(p::INT) * avg(t::INT) + (1 - avg(p::INT)) * (1 - avg(t::INT)) AS pe FROM sets GROUP BY c) q""",
)
def multilabel_kappa(spark, d):
    return ag.multilabel_kappa(_label_sets(spark, d), "truth", "predicted_labels", 64).select("label", r6("cohen_kappa"))


@query(
    "multilabel_kappa_mean",
    f"""WITH {_SETS} SELECT round(avg(coalesce((po - pe) / nullif(1 - pe, 0), 0)), 6) AS cohen_kappa FROM (
      SELECT c, avg((p = t)::INT) AS po, avg(p::INT) * avg(t::INT) + (1 - avg(p::INT)) * (1 - avg(t::INT)) AS pe FROM sets GROUP BY c) q""",
)
def multilabel_kappa_mean(spark, d):
    return ag.multilabel_kappa_mean(_label_sets(spark, d), "truth", "predicted_labels", 64).select(r6("cohen_kappa"))


@query(
    "label_counts",
    f"""WITH {_CELLS} SELECT label, predicted AS llm_count, support AS gold_count, round(predicted::DOUBLE / sum(support) OVER (), 6) AS llm_share,
      round(support::DOUBLE / sum(support) OVER (), 6) AS gold_share FROM cls""",
)
def label_counts(spark, d):
    m = ag.label_counts(inputs.coders(spark, d), "a", "b")
    return m.select("label", "llm_count", "gold_count", r6("llm_share"), r6("gold_share"))


@query(
    "confidence_distribution",
    f"""WITH {parsed()} SELECT llm_confidence, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
      FROM ann WHERE is_valid GROUP BY llm_confidence""",
)
def confidence_distribution(spark, d):
    return ag.confidence_distribution(inputs.annotations(spark, d)).select("llm_confidence", "n", r6("share"))


_GROUPED = f"""{parsed()}, un AS (
   SELECT gold_label AS gold, llm_label AS pred, lang AS grp FROM ann WHERE is_valid AND llm_label >= 0
   UNION ALL SELECT gold_label, llm_label, 'quality-' || quality FROM ann WHERE is_valid AND llm_label >= 0)"""


def _with_groups(spark, d):
    """Annotations with overlapping subgroups: language and quality grade."""
    ann = inputs.annotations(spark, d, keep=("lang", "quality")).filter("is_valid AND llm_label >= 0")
    return ann.withColumn("groups", F.array(F.col("lang"), F.concat(F.lit("quality-"), F.col("quality").cast("string"))))


@query(
    "fairness_by_group",
    f"""WITH {_GROUPED}, cells AS (SELECT grp, gold, pred, count(*) AS n FROM un GROUP BY ALL), {class_table('cells', 'grp')}
      SELECT grp AS "group", round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS precision,
       round(sum(rc * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1_score,
       sum(support)::BIGINT AS sample_size, round(1 - sum(tp)::DOUBLE / sum(support), 6) AS error_rate FROM sc GROUP BY grp""",
)
def fairness_by_group(spark, d):
    m = ag.fairness_by_group(_with_groups(spark, d), "gold_label", "llm_label", "groups")
    names = ["accuracy", "precision", "recall", "f1_score", "error_rate"]
    return m.select("group", "sample_size", *[r6(c) for c in names])


_CROSSED = f"""{parsed()}, ok AS (SELECT lang, source, gold_label AS gold, llm_label AS pred FROM ann WHERE is_valid AND llm_label >= 0),
  parts AS (SELECT 'all' AS grouping, NULL AS lang, NULL AS source, gold, pred FROM ok UNION ALL SELECT 'lang', lang, NULL, gold, pred FROM ok
    UNION ALL SELECT 'source', NULL, source, gold, pred FROM ok UNION ALL SELECT 'lang x source', lang, source, gold, pred FROM ok),
  per AS (SELECT grouping, lang, source, c, count(*) FILTER (WHERE gold = c) AS support, count(*) FILTER (WHERE pred = c) AS said,
      count(*) FILTER (WHERE gold = c AND pred = c) AS hit, count(*) AS n FROM parts, (SELECT unnest([0, 1]) AS c) k GROUP BY ALL),
  sc AS (SELECT *, CASE WHEN said > 0 THEN hit::DOUBLE / said ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0 END AS rc,
      CASE WHEN said + support > 0 THEN 2.0::DOUBLE * hit / (said + support) ELSE 0 END AS f1 FROM per),
  crossed AS (SELECT grouping, lang, source, sum(hit)::DOUBLE / any_value(n) AS accuracy, sum(pr * support) / any_value(n) AS precision, sum(rc * support) / any_value(n) AS recall,
      sum(f1 * support) / any_value(n) AS f1_score, any_value(n) AS sample_size FROM sc GROUP BY grouping, lang, source)"""


def _crossed(spark, d):
    ann = inputs.annotations(spark, d, keep=("lang", "source")).filter("is_valid AND llm_label >= 0")
    return ag.fairness_crossed(ann, "gold_label", "llm_label", ["lang", "source"])


@query(
    "fairness_crossed",
    f"""WITH {_CROSSED} SELECT grouping, lang, source, sample_size, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1_score, 6) AS f1_score, round(1 - accuracy, 6) AS error_rate FROM crossed""",
)
def fairness_crossed(spark, d):
    """In total, per language, per source, and per language and source."""
    return _crossed(spark, d).select("grouping", "lang", "source", "sample_size", *[r6(c) for c in ("accuracy", "precision", "recall", "f1_score", "error_rate")])


@query(
    "fairness_crossed_gaps",
    f"""WITH {_CROSSED} SELECT grouping, count(*) AS num_groups, round(max(accuracy) - min(accuracy), 6) AS accuracy_gap, round(max(f1_score) - min(f1_score), 6) AS f1_score_gap
      FROM crossed GROUP BY grouping""",
)
def fairness_crossed_gaps(spark, d):
    return ag.fairness_crossed_gaps(_crossed(spark, d)).select("grouping", "num_groups", r6("accuracy_gap"), r6("f1_score_gap"))


@query(
    "fairness_gaps",
    f"""WITH {_GROUPED}, r AS (SELECT grp, avg(pred) AS rate, avg(pred) FILTER (WHERE gold = 1) AS tpr, avg(pred) FILTER (WHERE gold = 0) AS fpr
        FROM un GROUP BY grp)
      SELECT count(*) AS num_groups, round(max(rate) - min(rate), 6) AS parity_difference, round(max(tpr) - min(tpr), 6) AS tpr_gap,
       round(max(fpr) - min(fpr), 6) AS fpr_gap, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS equalized_odds_gap FROM r""",
)
def fairness_gaps(spark, d):
    m = ag.fairness_gaps(_with_groups(spark, d), "gold_label", "llm_label", "groups")
    return m.select("num_groups", *[r6(c) for c in ("parity_difference", "tpr_gap", "fpr_gap", "equalized_odds_gap")])


def _reports(spark, d):
    """Annotation reports with each language taken as a data set."""
    ann = inputs.annotations(spark, d, keep=("lang",)).filter("is_valid AND llm_label >= 0")
    return ag.dataset_report(ann, "gold_label", "llm_label", "lang", "llm_confidence_numeric").withColumnRenamed("lang", "dataset")


def _supervised_reports(spark, d):
    from ..operators.uncertainty import predictions

    base = inputs.with_binary_logits(inputs.labelled_text(spark, d))
    preds = predictions(base, keep=["lang"])
    return ag.dataset_report(preds, "gold_label", "predicted_label", "lang", "max_prob").withColumnRenamed("lang", "dataset")


def _report_sql(name: str, source: str, gold: str, pred: str, conf: str) -> str:
    cells = f"{name}_c AS (SELECT lang, {gold} AS gold, {pred} AS pred, count(*) AS n FROM {source} GROUP BY ALL)"
    scored = class_table(f"{name}_c", "lang").replace("cls AS", f"{name}_cls AS").replace("sc AS", f"{name}_sc AS").replace("FROM cls", f"FROM {name}_cls")
    return f"""{cells}, {scored},
    {name}_conf AS (SELECT lang, avg({conf}) AS conf FROM {source} GROUP BY lang),
    {name}_t AS (SELECT lang, sum(support)::BIGINT AS n, sum(tp)::DOUBLE / sum(support) AS po,
       sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)) AS pe,
       CASE WHEN count(*) FILTER (WHERE support > 0) = 2 THEN max(f1) FILTER (WHERE label = 1) ELSE avg(f1) END AS f1 FROM {name}_sc GROUP BY lang),
    {name}_rep AS (SELECT lang AS dataset, n AS num_samples, po AS accuracy, f1 AS f1_score, (po - pe) / nullif(1 - pe, 0) AS cohen_kappa, conf AS average_confidence
       FROM {name}_t JOIN {name}_conf USING (lang))"""


_ANN_REP = f"{parsed()}, okann AS (SELECT * FROM ann WHERE is_valid AND llm_label >= 0), " + _report_sql("l", "okann", "gold_label", "llm_label", "llm_confidence_numeric")
_SUP_REP = SUPERVISED + ", supl AS (SELECT s.*, b.lang FROM sup s JOIN labelled b ON b.id = s.example_id), " + _report_sql("s", "supl", "gold_label", "predicted_label", "max_prob")


@query(
    "dataset_summary",
    f"""WITH {_ANN_REP} SELECT dataset, num_samples, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score,
      round(cohen_kappa, 6) AS cohen_kappa, round(average_confidence, 6) AS average_confidence FROM l_rep""",
)
def dataset_summary(spark, d):
    return _reports(spark, d).select("dataset", "num_samples", *[r6(c) for c in ("accuracy", "f1_score", "cohen_kappa", "average_confidence")])


@query(
    "macro_over_datasets",
    f"""WITH {_ANN_REP} SELECT count(*) AS num_datasets, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std,
      round(avg(f1_score), 6) AS f1_score_mean, round(stddev_pop(f1_score), 6) AS f1_score_std,
      round(avg(cohen_kappa), 6) AS cohen_kappa_mean, round(stddev_pop(cohen_kappa), 6) AS cohen_kappa_std FROM l_rep""",
)
def macro_over_datasets(spark, d):
    m = ag.macro_over_datasets(_reports(spark, d))
    return m.select("num_datasets", *[r6(c) for c in m.columns if c != "num_datasets"])


@query(
    "compare_models",
    f"""WITH {_ANN_REP}, {_SUP_REP} SELECT dataset, round(l.accuracy, 6) AS llm_accuracy, round(l.f1_score, 6) AS llm_f1_score,
      round(s.accuracy, 6) AS supervised_accuracy, round(s.f1_score, 6) AS supervised_f1_score,
      round(s.accuracy - l.accuracy, 6) AS accuracy_gain, round(s.f1_score - l.f1_score, 6) AS f1_score_gain
      FROM l_rep l JOIN s_rep s USING (dataset)""",
)
def compare_models(spark, d):
    m = ag.compare_models(_reports(spark, d), _supervised_reports(spark, d), "dataset")
    return m.select("dataset", *[r6(c) for c in m.columns if c != "dataset"])


def _class_rows_sql() -> str:
    """The classification report of ``sc`` in long form, in the sections of the bundles."""
    per = "".join(
        f" UNION ALL SELECT 'classes', label::VARCHAR, '{m}', round({c}, 6) FROM sc" for m, c in (("precision", "pr"), ("recall", "rc"), ("f1_score", "f1"), ("support", "support::DOUBLE"))
    )
    mean = {"macro avg": "avg({c})", "weighted avg": "sum({c} * support) / sum(support)", "accuracy": "sum(tp)::DOUBLE / sum(support)"}
    for group, f in mean.items():
        for m, c in (("precision", "pr"), ("recall", "rc"), ("f1_score", "f1")):
            per += f" UNION ALL SELECT 'classes', '{group}', '{m}', round({f.format(c=c)}, 6) FROM sc"
        per += f" UNION ALL SELECT 'classes', '{group}', 'support', sum(support)::DOUBLE FROM sc"
    return per


@query(
    "agreement_report",
    f"""WITH {_BIN_CELLS}, s AS (SELECT (SELECT count(*) FROM ann WHERE is_valid)::DOUBLE AS num_samples, sum(support)::DOUBLE AS num_valid, sum(tp)::DOUBLE / sum(support) AS accuracy,
        sum(pr) FILTER (WHERE label = 1) AS "precision", sum(rc) FILTER (WHERE label = 1) AS recall, sum(f1) FILTER (WHERE label = 1) AS f1_score,
        sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)) AS pe,
        (SELECT avg(llm_confidence_numeric) FROM ann WHERE is_valid AND llm_label >= 0) AS average_confidence FROM sc),
      t AS (SELECT *, (accuracy - pe) / (1 - pe) AS cohen_kappa, accuracy AS agreement_rate FROM s),
      u AS (SELECT 'agreement' AS section, 'all' AS "group", metric, round(value, 6) AS value FROM (SELECT num_samples, num_valid, accuracy, "precision", recall, f1_score, cohen_kappa,
        agreement_rate, average_confidence FROM t) UNPIVOT (value FOR metric IN (num_samples, num_valid, accuracy, "precision", recall, f1_score, cohen_kappa, agreement_rate, average_confidence))
      {_class_rows_sql()}
      UNION ALL SELECT 'confusion', g::VARCHAR, p::VARCHAR, coalesce(sum(n), 0)::DOUBLE FROM (SELECT unnest([0, 1]) AS g) a, (SELECT unnest([0, 1]) AS p) b
        LEFT JOIN cells ON cells.gold = g AND cells.pred = p GROUP BY ALL)
      SELECT 'jigsaw' AS dataset, * FROM u""",
)
def agreement_report(spark, d):
    return ag.agreement_report(inputs.annotations(spark, d), "jigsaw").select("dataset", "section", "group", "metric", r6("value"))


@query(
    "supervised_report",
    f"""WITH {LABELLED}, {SUPERVISED}, cells AS (SELECT gold_label AS gold, predicted_label AS pred, count(*) AS n FROM sup GROUP BY 1, 2), {class_table('cells')},
      bins AS (SELECT CASE WHEN max_prob > 0 THEN least(ceil(max_prob * 15), 15) END AS b, count(*) AS n, sum(max_prob) AS sp, sum((predicted_label = gold_label)::INT)::DOUBLE AS sy
        FROM sup GROUP BY 1)
      SELECT 'overall' AS section, 'all' AS "group", 'num_samples' AS metric, count(*)::DOUBLE AS value FROM sup
      UNION ALL SELECT 'overall', 'all', 'num_classes', 2.0
      UNION ALL SELECT 'overall', 'all', 'ece', round(sum(abs(sp - sy)) / sum(n), 6) FROM bins
      UNION ALL SELECT 'overall', 'all', 'brier_score', round(avg(((p0 - (gold_label = 0)::INT) ** 2 + (p1 - (gold_label = 1)::INT) ** 2) / 2), 6) FROM sup
      UNION ALL SELECT 'overall', 'all', 'average_entropy', round(avg(entropy), 6) FROM sup
      UNION ALL SELECT 'overall', 'all', 'average_confidence', round(avg(max_prob), 6) FROM sup {_class_rows_sql()}""",
)
def supervised_report(spark, d):
    return ag.supervised_report(inputs.supervised(spark, d)).select("section", "group", "metric", r6("value"))
