"""Agreement metrics against published confusion matrices and small hand-computed frames."""

import pytest
from pyspark.sql import functions as F

from labelquality.operators import agreement as ag, calibration, curves

# Confusion matrices with their published accuracy, precision, recall, F1 and kappa, and the counts of
# low, medium and high confidence with their mean.
GOLDEN = {
    "imdb": ([[5987, 226], [299, 5807]], (0.9573829044565305, 0.9625393668158462, 0.9510317720275139, 0.9567509679545267, 0.9147506018723042)),
    "fever": (
        [[2020, 1050, 263], [1036, 1692, 605], [284, 1378, 1671]],
        (0.5383538353835383, 0.5578677180296809, 0.5383538353835383, 0.5428706288782147, 0.30753075307530753),
    ),
    "jigsaw": ([[7062, 2047], [245, 546]], (0.7684848484848484, 0.21056691091399923, 0.6902654867256637, 0.32269503546099293, 0.22819027306406914)),
}
CONFIDENCE = {"imdb": ((9, 1094, 11216), 0.8729198798603786), "fever": ((4440, 603, 4956), 0.6154815481548156), "jigsaw": ((321, 1485, 8094), 0.8355454545454547)}
ALPHA = {"imdb": 0.914751, "fever": 0.304304, "jigsaw": 0.183116}
WEIGHTED_F1 = {"imdb": 0.9573792136520944, "fever": 0.5428706288782147, "jigsaw": 0.8174196220636124}


def rows_of(spark, matrix):
    cells = [(i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row)]
    df = spark.createDataFrame(cells, "gold_label int, llm_label int, n int")
    return df.withColumn("k", F.explode(F.sequence(F.lit(1), "n"))).select("gold_label", "llm_label")


@pytest.mark.parametrize("name", GOLDEN)
def test_published_metrics(spark, name):
    matrix, want = GOLDEN[name]
    df = rows_of(spark, matrix)
    ann = df.withColumn("is_valid", F.lit(True)).withColumn("llm_confidence_numeric", F.lit(0.6))
    got = ag.agreement_metrics(ann).first()
    assert (got.accuracy, got.precision, got.recall, got.f1_score, got.cohen_kappa) == pytest.approx(want, abs=1e-12)
    assert got.num_samples == got.num_valid == sum(map(sum, matrix))
    assert got.average_confidence == pytest.approx(0.6)
    assert ag.krippendorff_alpha(df, "gold_label", "llm_label").first()[1] == pytest.approx(ALPHA[name], abs=1e-6)
    assert ag.averaged_metrics(df, "gold_label", "llm_label", "weighted").first().f1_score == pytest.approx(WEIGHTED_F1[name], abs=1e-12)
    cells = {(r.gold, r.pred): r.n for r in ag.confusion_matrix(df, "gold_label", "llm_label").collect()}
    assert cells == {(i, j): n for i, row in enumerate(matrix) for j, n in enumerate(row)}


@pytest.mark.parametrize("name", CONFIDENCE)
def test_published_confidence(spark, name):
    (low, medium, high), mean = CONFIDENCE[name]
    rows = [("low", 0.3, low), ("medium", 0.6, medium), ("high", 0.9, high)]
    df = spark.createDataFrame(rows, "llm_confidence string, llm_confidence_numeric double, n int")
    ann = df.withColumn("k", F.explode(F.sequence(F.lit(1), "n"))).select(
        "llm_confidence", "llm_confidence_numeric", F.lit(True).alias("is_valid"), F.lit(1).alias("gold_label"), F.lit(1).alias("llm_label")
    )
    assert ag.agreement_metrics(ann).first().average_confidence == pytest.approx(mean, abs=1e-9)
    assert {r.llm_confidence: r.n for r in ag.confidence_distribution(ann).collect()} == {"low": low, "medium": medium, "high": high}


def test_macro_over_datasets(spark):
    rows = [(n, m[0], m[3], m[4]) for n, (_, m) in GOLDEN.items()]
    got = ag.macro_over_datasets(spark.createDataFrame(rows, "dataset string, accuracy double, f1_score double, cohen_kappa double")).first()
    assert (round(got.accuracy_mean, 3), round(got.accuracy_std, 3)) == (0.755, 0.171)
    assert (round(got.f1_score_mean, 3), round(got.f1_score_std, 3)) == (0.607, 0.263)
    assert (round(got.cohen_kappa_mean, 3), round(got.cohen_kappa_std, 3)) == (0.483, 0.307)


def test_report_with_names(spark):
    df = rows_of(spark, GOLDEN["jigsaw"][0])
    got = {r["class"]: r for r in ag.classification_report(df, "gold_label", "llm_label", ["non-toxic", "toxic"]).collect()}
    assert got["non-toxic"].f1_score == pytest.approx(0.8603801169590644, abs=1e-12) and got["toxic"].support == 791
    assert got["macro avg"].precision == pytest.approx(0.5885187093231553, abs=1e-12)
    assert got["weighted avg"].recall == pytest.approx(0.7684848484848484, abs=1e-12)
    named = {r.label: r for r in ag.per_class_metrics(df, "gold_label", "llm_label", ["non-toxic", "toxic", "unseen"]).collect()}
    assert tuple(named["unseen"]) == ("unseen", 0.0, 0.0, 0.0, 0)


def test_no_usable_row_gives_zeros(spark):
    schema = "is_valid boolean, gold_label int, llm_label int, llm_confidence_numeric double"
    for rows in ([], [(True, 1, -1, 0.9)], [(False, 1, None, None)]):
        got = ag.agreement_metrics(spark.createDataFrame(rows, schema)).first()
        assert got.num_samples == sum(r[0] for r in rows) and got.num_valid == 0
        assert list(got)[2:] == [0.0] * 7


def test_perfect_and_constant(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 1), (0, 0), (1, 1)], "t int, p int")
    s = ag.summary(ag.class_counts(ag.confusion_counts(df, "t", "p"))).first()
    assert s.accuracy == s.cohen_kappa == s.krippendorff_alpha == s.f1_score_macro == 1.0
    one = spark.createDataFrame([(1, 1), (1, 1)], "t int, p int")
    assert ag.cohen_kappa(one, "t", "p").first().cohen_kappa is None


def test_class_seen_on_one_side_only(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "t string, p string")
    m = {(r.gold, r.pred): (r.n, r.share) for r in ag.confusion_normalized(df, "t", "p").collect()}
    assert len(m) == 9 and m[("a", "c")] == (1, 0.5) and m[("c", "a")] == (0, 0.0)
    assert ag.averaged_metrics(df, "t", "p", "macro").first().recall == pytest.approx((0.5 + 1 + 0) / 3)


def test_weighted_agreement(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 0), (1, 1)], "t int, p int")
    assert ag.weighted_agreement(df, "t", "p").first().weighted_agreement == pytest.approx((1 + 0.5 + 0 + 1) / 4)


def test_overlapping_groups(spark):
    rows = [(1, 1, ["x", "y"]), (0, 1, ["x"]), (1, 1, ["y"]), (0, 0, []), (0, 0, ["y", "y"])]
    df = spark.createDataFrame(rows, "t int, p int, g array<string>")
    got = {r.group: r for r in ag.fairness_by_group(df, "t", "p", "g").collect()}
    assert set(got) == {"x", "y"} and got["x"].sample_size == 2 and got["y"].sample_size == 3
    assert got["x"].accuracy == 0.5 and got["x"].error_rate == 0.5 and got["y"].accuracy == 1.0
    gaps = ag.fairness_gaps(df, "t", "p", "g").first()
    assert gaps.parity_difference == pytest.approx(1 - 2 / 3) and gaps.fpr_gap == 1.0 and gaps.tpr_gap == 0.0


def test_label_sets(spark):
    df = spark.createDataFrame([([0, 1], [1, 0]), ([2], [0]), ([], [])], "t array<int>, p array<int>")
    assert ag.exact_match(df, "t", "p").first().exact_match == pytest.approx(2 / 3)
    assert ag.multilabel_macro_f1(df, "t", "p", 4).first().macro_f1 == pytest.approx((2 / 3 + 1 + 0 + 0) / 4)
    kappa = {r.label: r.cohen_kappa for r in ag.multilabel_kappa(df, "t", "p", 4).collect()}
    assert kappa[1] == 1.0 and kappa[3] is None


def test_comprehensive(spark):
    rows = [(1, 1, 0.9, ["a"], 1, 0.8), (0, 0, 0.2, ["b"], 1, 0.9), (1, 0, 0.4, ["a"], 0, 0.3), (0, 1, 0.6, ["b"], 0, 0.85)]
    df = spark.createDataFrame(rows, "t int, p int, q double, g array<string>, tl int, ts double")
    out = ag.comprehensive_metrics(df, "t", "p", "q", "g", "tl", "ts").collect()
    got = {(r.section, r.group, r.metric): r.value for r in out}
    assert {k[0] for k in got} == {"classification", "agreement", "calibration", "fairness", "trust_prediction"}
    assert got[("classification", "all", "accuracy")] == 0.5 and got[("trust_prediction", "all", "roc_auc")] == pytest.approx(0.75)
    assert all(0 <= got[("calibration", "all", m)] <= 1 for m in ("ece", "mce", "brier_score"))
    assert {r.section for r in ag.comprehensive_metrics(df, "t", "p").collect()} == {"classification", "agreement"}


def test_fairness_in_total_and_crossed(spark):
    rows = [("en", "a", 1, 1), ("en", "a", 0, 1), ("en", "b", 0, 0), ("de", "a", 1, 0), ("de", None, 1, 1), (None, "b", 0, 0)]
    df = spark.createDataFrame(rows, "lang string, source string, gold int, pred int")
    got = {(r.grouping, r.lang, r.source): (r.sample_size, r.accuracy) for r in ag.fairness_crossed(df, "gold", "pred", ["lang", "source"]).collect()}
    assert got["all", None, None] == (6, 4 / 6)
    assert got["lang", "en", None] == (3, 2 / 3) and got["lang", None, None] == (1, 1.0)
    assert got["source", None, "a"] == (3, 1 / 3) and got["source", None, None] == (1, 1.0)
    assert got["lang x source", "en", "a"] == (2, 0.5) and got["lang x source", None, "b"] == (1, 1.0) and got["lang x source", "de", None] == (1, 1.0)
    assert len(got) == 1 + 3 + 3 + 5
    only = ag.fairness_crossed(df, "gold", "pred", ["lang", "source"], crossed=[])
    assert {r.grouping for r in only.collect()} == {"all", "lang", "source"}
    gaps = {r.grouping: (r.num_groups, r.accuracy_gap) for r in ag.fairness_crossed_gaps(only).collect()}
    assert gaps["all"] == (1, 0.0) and gaps["source"] == (3, pytest.approx(2 / 3))
    plan = only._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def counted_reads(spark, df):
    """``df`` read through a counter of rows."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def test_bundles_read_their_rows_once(spark):
    rows = [(k % 2, (k // 3) % 2, (k % 10) / 10, ["a", "b"][: 1 + k % 2] if k % 5 else None, k % 3 == 0, k / 40 if k % 7 else None) for k in range(40)]
    df = spark.createDataFrame([(*r[:4], int(r[4]), r[5]) for r in rows], "t int, p int, q double, g array<string>, tl int, ts double")
    read, seen = counted_reads(spark, df)
    out = ag.comprehensive_metrics(read, "t", "p", "q", "g", "tl", "ts").collect()
    assert seen.value == 40
    got = {(r.section, r.group, r.metric): r.value for r in out}
    cal, fair = ag_calibration(df), {r.group: r for r in ag.fairness_by_group(df, "t", "p", "g").collect()}
    assert all(got["calibration", "all", m] == pytest.approx(cal[m]) for m in ("ece", "mce", "brier_score", "reliability", "resolution"))
    assert all(got["fairness", g, "accuracy"] == pytest.approx(fair[g].accuracy) and got["fairness", g, "sample_size"] == fair[g].sample_size for g in fair) and len(fair) == 2
    curve = curves.curve_metrics(df, "ts", curves.F.col("tl") == 1).first().asDict()
    assert all(got["trust_prediction", "all", m] == pytest.approx(v) for m, v in curve.items())
    assert got["agreement", "all", "cohen_kappa"] == pytest.approx(ag.cohen_kappa(df, "t", "p").first().cohen_kappa)

    notes = df.selectExpr("t AS gold_label", "IF(q = 0.3, -1, p) AS llm_label", "q AS llm_confidence_numeric", "q < 0.9 AS is_valid")
    read, seen = counted_reads(spark, notes)
    got = {(r.section, r.group, r.metric): r.value for r in ag.agreement_report(read, "x").collect()}
    assert seen.value == 40
    want = ag.agreement_metrics(notes).first().asDict()
    assert all(got["agreement", "all", m] == pytest.approx(v) for m, v in want.items())
    matrix = ag.confusion_matrix(notes.filter("is_valid AND llm_label >= 0"), "gold_label", "llm_label").collect()
    assert all(got["confusion", str(r.gold), str(r.pred)] == r.n for r in matrix) and sum(r.n for r in matrix) == 32

    preds = df.selectExpr("t AS gold_label", "array(1 - q, q) AS probabilities", "CAST(q > 0.5 AS INT) AS predicted_label", "q AS entropy", "greatest(q, 1 - q) AS max_prob")
    read, seen = counted_reads(spark, preds)
    got = {(r.section, r.group, r.metric): r.value for r in ag.supervised_report(read).collect()}
    assert seen.value == 40 and got["overall", "all", "num_samples"] == 40 and got["overall", "all", "num_classes"] == 2
    assert got["overall", "all", "ece"] == pytest.approx(calibration.ece(preds, "probabilities", "gold_label").first().ece)
    assert got["overall", "all", "brier_score"] == pytest.approx(calibration.brier(preds, "probabilities", "gold_label").first().brier_score)
    assert got["overall", "all", "average_entropy"] == pytest.approx(0.45)


def ag_calibration(df):
    return calibration.calibration_metrics(df, "q", "t").first()


def test_nan_scores_are_refused(spark):
    df = spark.createDataFrame([(0.5, 1), (float("nan"), 0)], "s double, y int")
    with pytest.raises(Exception, match="NaN"):
        curves.pr_curve(df, "s", curves.F.col("y") == 1).collect()
    assert curves.pr_curve(df.filter("y = 1").union(spark.createDataFrame([(None, 0)], df.schema)), "s", curves.F.col("y") == 1).count() == 1
