"""Agreement and classification metrics.

Raw rows are shuffled once, as partial counts per (gold, predicted). Everything else is arithmetic on
that table of at most k^2 rows: it is unfolded to one row per class (true positives, support,
predicted) and aggregated from there, without joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, probability as pr
from ..functions.scalar import ratio
from ..sources.shared import stored

METRICS = ("precision", "recall", "f1_score")
COUNTS = ("tp", "support", "predicted")


def confusion_counts(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Non-empty cells (gold, pred, n), optionally per group."""
    return df.groupBy(*by, F.col(true).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def class_counts(cells: DataFrame, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Per class: true positives, support, predicted. Classes are the union of both sides.

    Cells with a NULL prediction end in a row with a NULL label and no counts. ``carry`` names numeric
    cell columns that are summed along on the gold side, so totals need no second aggregation.
    """
    none = F.lit(0).cast("long")
    known = F.col("pred").isNotNull()
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(none)
    seen = F.when(known, F.col("n")).otherwise(none)

    def side(label: Column, *counts: Column, own: bool) -> Column:
        named = [c.alias(name) for c, name in zip(counts, COUNTS)]
        extra = [(F.col(c) if own else F.lit(None).cast("double")).cast("double").alias(c) for c in carry]
        return F.struct(F.when(known, label).alias("label"), *named, *extra)

    sides = F.array(
        side(F.col("gold"), hit, seen, none, own=True), side(F.col("pred"), none, none, seen, own=False)
    )
    return (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in (*COUNTS, *carry)])
    )


def precision_recall_f1(classes: DataFrame) -> DataFrame:
    """Add precision, recall and F1 per class; 0 where undefined."""
    return (
        classes.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1_score", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))
    )


def _kappa(n: Column, po: Column) -> Column:
    chance = F.try_divide(F.sum(F.col("support").cast("double") * F.col("predicted")), n * n)
    return F.try_divide(po - chance, F.nullif(1.0 - chance, F.lit(0.0)))


def _alpha(n: Column, po: Column) -> Column:
    """Nominal alpha for two coders: 1 - Do/De over the 2n pooled values."""
    pooled = (F.col("support") + F.col("predicted")).cast("double")
    values = 2.0 * n
    expected = 1.0 - F.try_divide(F.sum(pooled * (pooled - 1.0)), values * (values - 1.0))
    return 1.0 - F.try_divide(1.0 - po, F.nullif(expected, F.lit(0.0)))


def summary(classes: DataFrame, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """One row (per group) with every scalar metric, from per-class counts; sums of ``carry`` go along."""
    n = F.sum("support").cast("double")
    po = F.try_divide(F.sum("tp"), n)
    scored = precision_recall_f1(classes)
    aggs = [
        F.coalesce(F.sum("support"), F.lit(0)).alias("n"),
        F.count_if(F.col("support") > 0).alias("gold_classes"),
        po.alias("accuracy"),
        _kappa(n, po).alias("cohen_kappa"),
        _alpha(n, po).alias("krippendorff_alpha"),
        *[F.sum(c).alias(c) for c in carry],
    ]
    for m in METRICS:
        one = F.max(F.when(F.col("label").cast("string") == "1", F.col(m)))
        aggs += [
            F.avg(F.when(F.col("label").isNotNull(), F.col(m))).alias(f"{m}_macro"),
            F.try_divide(F.sum(F.col(m) * F.col("support")), n).alias(f"{m}_weighted"),
            F.coalesce(one, F.lit(0.0)).alias(f"{m}_binary"),
        ]
    return scored.groupBy(*by).agg(*aggs)


def averaged(metric: str, average: str = "auto") -> Column:
    """Pick an averaged metric of ``summary``; "auto" is binary for exactly two gold classes, else macro."""
    if average == "auto":
        return F.when(F.col("gold_classes") == 2, F.col(f"{metric}_binary")).otherwise(F.col(f"{metric}_macro"))
    return F.col(f"{metric}_{average}")


def _grid(cells: DataFrame) -> DataFrame:
    """All (gold, pred) pairs of the label union, with n = 0. Size k^2, from a single row of k labels."""
    labels = cells.select(F.explode(F.array("gold", "pred")).alias("label")).agg(
        F.sort_array(F.collect_set("label")).alias("labels")
    )
    return labels.select("labels", F.explode("labels").alias("gold")).select(
        "gold", F.explode("labels").alias("pred"), F.lit(0).cast("long").alias("n")
    )


def confusion_matrix(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Cells of the full matrix, zeros included."""
    return matrix_of(confusion_counts(df, true, pred))


def matrix_of(cells: DataFrame) -> DataFrame:
    """The same from counted cells (gold, pred, n)."""
    return cells.unionByName(_grid(cells)).groupBy("gold", "pred").agg(F.sum("n").alias("n"))


def confusion_normalized(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Each cell over its gold row sum (0 for a class never seen as gold). The window is on k^2 rows."""
    row = F.sum("n").over(Window.partitionBy("gold"))
    return confusion_matrix(df, true, pred).withColumn("share", ratio(F.col("n"), row))


def accuracy(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))


def _named(classes: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Classes 0..k-1 under their names; a class that never occurs gets a row of zeros."""
    if names is None:
        return classes
    zero = F.lit(0).cast("long")
    known = classes.sparkSession.createDataFrame(list(enumerate(names)), "label int, name string")
    grid = known.select(F.col("label").cast("long"), "name", *[zero.alias(c) for c in COUNTS])
    given = classes.select(F.col("label").cast("long"), F.lit(None).cast("string").alias("name"), *COUNTS)
    merged = given.unionByName(grid).groupBy("label").agg(F.max("name").alias("name"), *[F.sum(c).alias(c) for c in COUNTS])
    return merged.select(F.coalesce("name", F.col("label").cast("string")).alias("label"), *COUNTS)


def per_class_metrics(df: DataFrame, true: str, pred: str, names: Sequence[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; ``names`` lists the names of classes 0..k-1."""
    classes = _named(class_counts(confusion_counts(df, true, pred)), names)
    return precision_recall_f1(classes).select("label", *METRICS, "support")


def averaged_metrics(df: DataFrame, true: str, pred: str, average: str = "auto") -> DataFrame:
    """precision, recall and F1 under one averaging rule."""
    s = summary(class_counts(confusion_counts(df, true, pred)))
    return s.select(*[averaged(m, average).alias(m) for m in METRICS])


def classification_report(df: DataFrame, true: str, pred: str, names: Sequence[str] | None = None) -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg."""
    return report_of(confusion_counts(df, true, pred), names)


def report_of(cells: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The same from counted cells (gold, pred, n)."""
    classes = precision_recall_f1(_named(class_counts(cells), names))
    s = summary(classes.select("label", *COUNTS))
    rows = [
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(m) for m in METRICS], F.col("n").alias("support")),
        *[
            F.struct(F.lit(f"{a} avg").alias("class"), *[F.col(f"{m}_{a}").alias(m) for m in METRICS], F.col("n").alias("support"))
            for a in ("macro", "weighted")
        ],
    ]
    per_class = classes.select(F.col("label").cast("string").alias("class"), *METRICS, "support")
    return per_class.unionByName(s.select(F.inline(F.array(*rows))))


def cohen_kappa(df: DataFrame, true: str, pred: str) -> DataFrame:
    return summary(class_counts(confusion_counts(df, true, pred))).select("n", "cohen_kappa")


def krippendorff_alpha(df: DataFrame, true: str, pred: str) -> DataFrame:
    return summary(class_counts(confusion_counts(df, true, pred))).select("n", "krippendorff_alpha")


def weighted_agreement(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Linear-weight agreement: 1 - |i - j| / (k - 1) averaged over rows, i and j being label positions."""
    return weighted_agreement_of(confusion_counts(df, true, pred))


def weighted_agreement_of(cells: DataFrame) -> DataFrame:
    """The same from counted cells (gold, pred, n)."""
    labels = cells.select(F.explode(F.array("gold", "pred")).alias("label")).agg(F.sort_array(F.collect_set("label")))
    placed = cells.withColumn("labels", labels.scalar())
    gap = F.abs(F.array_position("labels", F.col("gold")) - F.array_position("labels", F.col("pred")))
    steps = F.greatest(F.size("labels") - 1, F.lit(1))
    return placed.agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * (1.0 - gap / steps)) / F.sum("n")).alias("weighted_agreement"),
    )


def agreement_metrics(annotations: DataFrame) -> DataFrame:
    """The agreement report of one annotation run: one row.

    ``num_samples`` counts valid annotations, ``num_valid`` those whose label belongs to the data set.
    With no usable row every metric is 0.
    """
    return agreement_of(annotation_cells(annotations))


def annotation_cells(annotations: DataFrame) -> DataFrame:
    """Valid annotations counted per (gold, pred), pred being NULL where the label does not belong to the data set; ``weight`` sums the confidence of the others."""
    usable = F.col("llm_label") >= 0
    return (
        annotations.filter("is_valid")
        .groupBy(F.col("gold_label").alias("gold"), F.when(usable, F.col("llm_label")).alias("pred"))
        .agg(
            F.count("*").alias("n"),
            F.count("*").alias("num_samples"),
            F.sum(F.when(usable, F.col("llm_confidence_numeric"))).alias("weight"),
        )
    )


def agreement_of(cells: DataFrame) -> DataFrame:
    """``agreement_metrics`` from ``annotation_cells``."""
    carry = ["num_samples", "weight"]
    zero = F.lit(0.0)
    return summary(class_counts(cells, carry=carry), carry=carry).select(
        F.coalesce(F.col("num_samples").cast("long"), F.lit(0)).alias("num_samples"),
        F.col("n").alias("num_valid"),
        F.coalesce("accuracy", zero).alias("accuracy"),
        *[F.coalesce(averaged(m), zero).alias(m) for m in METRICS],
        F.when(F.col("n") > 0, F.col("cohen_kappa")).otherwise(zero).alias("cohen_kappa"),
        F.coalesce("accuracy", zero).alias("agreement_rate"),
        ratio(F.col("weight"), F.col("n")).alias("average_confidence"),
    )


def exact_match(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Share of rows whose two label sets are equal, order and repeats aside."""
    same = F.array_sort(F.array_distinct(true)) == F.array_sort(F.array_distinct(pred))
    return df.agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("exact_match"))


def multilabel_class_counts(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Per-class counts for label sets. Only the labels that occur are unfolded, and pre-aggregated."""
    t, p = F.array_contains(F.col(true), F.col("label")), F.array_contains(F.col(pred), F.col("label"))
    return (
        df.select(true, pred, F.explode(F.array_union(true, pred)).alias("label"))
        .groupBy("label")
        .agg(F.count_if(t & p).alias("tp"), F.count_if(t).alias("support"), F.count_if(p).alias("predicted"))
    )


def multilabel_macro_f1(df: DataFrame, true: str, pred: str, num_labels: int) -> DataFrame:
    """Mean F1 over all ``num_labels`` classes; a class that never occurs scores 0."""
    scored = precision_recall_f1(multilabel_class_counts(df, true, pred))
    return scored.agg((F.coalesce(F.sum("f1_score"), F.lit(0.0)) / F.lit(num_labels)).alias("macro_f1"))


def multilabel_kappa(df: DataFrame, true: str, pred: str, num_labels: int) -> DataFrame:
    """Kappa of each class taken as yes/no, from per-class counts and the row total."""
    flags = F.array(*[F.struct(F.lit(c).alias("label"), F.array_contains(F.col(true), F.lit(c)).alias("t"), F.array_contains(F.col(pred), F.lit(c)).alias("p")) for c in range(num_labels)])
    per = df.select(F.inline(flags)).groupBy("label").agg(
        F.count("*").cast("double").alias("n"),
        F.avg((F.col("t") == F.col("p")).cast("double")).alias("po"),
        F.avg(F.col("t").cast("double")).alias("yt"),
        F.avg(F.col("p").cast("double")).alias("yp"),
    )
    chance = F.col("yt") * F.col("yp") + (1 - F.col("yt")) * (1 - F.col("yp"))
    return per.select("label", F.try_divide(F.col("po") - chance, F.nullif(1.0 - chance, F.lit(0.0))).alias("cohen_kappa"))


def multilabel_kappa_mean(df: DataFrame, true: str, pred: str, num_labels: int) -> DataFrame:
    """Mean of the kappas of all classes; a class on which kappa is not defined counts as 0."""
    return multilabel_kappa(df, true, pred, num_labels).agg((F.coalesce(F.sum("cohen_kappa"), F.lit(0.0)) / F.lit(num_labels)).alias("cohen_kappa"))


def label_counts(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Predicted and gold counts and shares per class."""
    classes = class_counts(confusion_counts(df, true, pred))
    total = F.sum("support").over(Window.partitionBy())  # k rows
    return classes.select(
        "label",
        F.col("predicted").alias("llm_count"),
        F.col("support").alias("gold_count"),
        ratio(F.col("predicted"), total).alias("llm_share"),
        ratio(F.col("support"), total).alias("gold_share"),
    )


def confidence_distribution(annotations: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())  # three rows
    return (
        annotations.filter("is_valid")
        .groupBy("llm_confidence")
        .agg(F.count("*").alias("n"))
        .withColumn("share", ratio(F.col("n"), total))
    )


def fairness_by_group(df: DataFrame, true: str, pred: str, groups: str) -> DataFrame:
    """Weighted metrics per subgroup. ``groups`` is an array column: a row may belong to several.

    Empty groups produce no row. Rows are shuffled as counts per (group, gold, pred).
    """
    unfolded = df.select(F.col(true), F.col(pred), F.explode(F.array_distinct(groups)).alias("group"))
    return fairness_of(confusion_counts(unfolded, true, pred, by=["group"]))


def fairness_of(cells: DataFrame) -> DataFrame:
    """The same from counted cells (group, gold, pred, n)."""
    return summary(class_counts(cells, by=["group"]), by=["group"]).select(
        "group",
        "accuracy",
        F.col("precision_weighted").alias("precision"),
        F.col("recall_weighted").alias("recall"),
        F.col("f1_score_weighted").alias("f1_score"),
        F.col("n").alias("sample_size"),
        (1.0 - F.col("accuracy")).alias("error_rate"),
    )


def _grouping(by: Sequence[str]) -> Column:
    """Names of the columns a row of grouping sets is grouped by; ``all`` for the total."""
    names = F.concat_ws(" x ", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in by])
    return F.when(names == "", "all").otherwise(names)


def fairness_crossed(df: DataFrame, true: str, pred: str, by: Sequence[str], crossed: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Weighted metrics in total, per value of each attribute of ``by``, and per combination of them, from one scan.

    ``crossed`` names the combinations (all of them, if it is not given). Rows are counted once per (attributes, gold, pred); grouping
    sets add these cells up. ``grouping`` tells which attributes a row is grouped by; the others are NULL there. NULL is a value.
    """
    by = list(by)
    sets = [[], *[[c] for c in by], *[list(c) for c in (crossed if crossed is not None else [x for k in range(2, len(by) + 1) for x in combinations(by, k)])]]
    cells = confusion_counts(df, true, pred, by=by)
    summed = cells.groupingSets([[*s, "gold", "pred"] for s in sets], *by, "gold", "pred").agg(F.sum("n").alias("n"), _grouping(by).alias("grouping"))
    keys = ["grouping", *by]
    return summary(class_counts(summed, by=keys), by=keys).select(
        *keys,
        "accuracy",
        *[F.col(f"{m}_weighted").alias(m) for m in METRICS],
        F.col("n").alias("sample_size"),
        (1.0 - F.col("accuracy")).alias("error_rate"),
    )


def fairness_crossed_gaps(scores: DataFrame, metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1_score")) -> DataFrame:
    """Per grouping of ``fairness_crossed``: how many groups there are and the largest difference in each metric between them."""
    return scores.groupBy("grouping").agg(F.count("*").alias("num_groups"), *[(F.max(m) - F.min(m)).alias(f"{m}_gap") for m in metrics])


def fairness_gaps(df: DataFrame, true: str, pred: str, groups: str, positive: int = 1) -> DataFrame:
    """Largest difference between groups in positive rate (parity) and in true/false positive rates."""
    unfolded = df.select(F.col(true), F.col(pred), F.explode(F.array_distinct(groups)).alias("group"))
    t, p = F.col(true) == positive, F.col(pred) == positive
    rates = unfolded.groupBy("group").agg(
        F.avg(p.cast("double")).alias("rate"),
        F.avg(F.when(t, p.cast("double"))).alias("tpr"),
        F.avg(F.when(~t, p.cast("double"))).alias("fpr"),
    )
    spread = {c: F.max(c) - F.min(c) for c in ("rate", "tpr", "fpr")}
    return rates.agg(
        F.count("*").alias("num_groups"),
        spread["rate"].alias("parity_difference"),
        spread["tpr"].alias("tpr_gap"),
        spread["fpr"].alias("fpr_gap"),
        F.greatest(spread["tpr"], spread["fpr"]).alias("equalized_odds_gap"),
    )


def macro_over_datasets(reports: DataFrame, metrics: Sequence[str] = ("accuracy", "f1_score", "cohen_kappa")) -> DataFrame:
    """Mean and population standard deviation of per-data-set metrics."""
    aggs = [F.count("*").alias("num_datasets")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return reports.agg(*aggs)


def dataset_report(df: DataFrame, true: str, pred: str, by: str, confidence: str | None = None) -> DataFrame:
    """Agreement report per data set from one aggregation keyed by (data set, gold, pred)."""
    weight = F.sum(confidence) if confidence else F.lit(None).cast("double")
    cells = df.groupBy(by, F.col(true).alias("gold"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n"), weight.alias("weight")
    )
    scores = summary(class_counts(cells, by=[by], carry=["weight"]), by=[by], carry=["weight"])
    return scores.select(
        by,
        F.col("n").alias("num_samples"),
        "accuracy",
        averaged("f1_score").alias("f1_score"),
        "cohen_kappa",
        (F.col("weight") / F.col("n")).alias("average_confidence"),
    )


def compare_models(first: DataFrame, second: DataFrame, by: str, names: tuple[str, str] = ("llm", "supervised")) -> DataFrame:
    """Two per-data-set reports side by side, with differences (second minus first)."""
    metrics = ("accuracy", "f1_score")
    a = first.select(by, *[F.col(m).alias(f"{names[0]}_{m}") for m in metrics])
    b = second.select(by, *[F.col(m).alias(f"{names[1]}_{m}") for m in metrics])
    joined = a.join(b, by)
    return joined.select("*", *[(F.col(f"{names[1]}_{m}") - F.col(f"{names[0]}_{m}")).alias(f"{m}_gain") for m in metrics])


def _long(df: DataFrame, section: str, values: Sequence[str], group: Column | None = None) -> DataFrame:
    """Metric columns to rows (section, group, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(F.lit(section).alias("section"), (F.lit("all") if group is None else group).alias("group"), F.inline(pairs))


def comprehensive_metrics(
    df: DataFrame,
    true: str,
    pred: str,
    prob: str | None = None,
    groups: str | None = None,
    trust_label: str | None = None,
    trust_score: str | None = None,
) -> DataFrame:
    """All metric groups the given columns allow, as one long table.

    ``prob`` is the probability of class 1, ``groups`` an array of subgroups. The rows are read once, when called:
    one aggregation counts everything, and its result, of the size of cells, bins and distinct scores, is stored.
    """
    from . import calibration, curves

    counts = stored(_expanded_counts(df, true, pred, prob, groups, trust_label if trust_score else None, trust_score), "counts")
    whole = counts.filter("kind = 'all'")
    cells = whole.groupBy("gold", "pred").agg(F.sum("n").alias("n"))
    scores = summary(class_counts(cells))
    weighted = scores.select("accuracy", *[F.col(f"{m}_weighted").alias(m) for m in METRICS])
    out = _long(weighted, "classification", ["accuracy", *METRICS])
    coded = scores.select("accuracy", "cohen_kappa", "krippendorff_alpha", F.col("accuracy").alias("percentage_agreement"))
    out = out.unionByName(_long(coded, "agreement", coded.columns))
    out = out.unionByName(_long(weighted_agreement_of(cells), "agreement", ["weighted_agreement"]))
    if prob:
        bins = whole.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "sum_p", "sum_y", "sum_sq")])
        cal = calibration.calibration_summary(bins, more={"brier_score": F.sum("sum_sq") / F.sum("n")})
        out = out.unionByName(_long(cal, "calibration", ["ece", "mce", "brier_score", "reliability", "resolution"]))
    if groups:
        fair = fairness_of(counts.filter("kind = 'group'").select("group", "gold", "pred", "n"))
        names = ["accuracy", *METRICS, "sample_size", "error_rate"]
        out = out.unionByName(_long(fair, "fairness", names, F.col("group").cast("string")))
    if trust_label and trust_score:
        curve = curves.metrics_of(curves.accumulated(counts.filter("kind = 'score'").select("score", "pos", "neg")))
        out = out.unionByName(_long(curve, "trust_prediction", curve.columns))
    return out


def _expanded_counts(df: DataFrame, true: str, pred: str, prob: str | None, groups: str | None, trust_label: str | None, trust_score: str | None) -> DataFrame:
    """Every row as one of kind "all", one "group" per subgroup and one "score", counted together by (group, gold, pred, bin, score)."""
    from . import calibration, curves

    none = F.lit(None)
    p = F.col(prob).cast("double") if prob else none.cast("double")
    y = F.col(true).cast("double") if prob else none.cast("double")
    of = df.schema[groups].dataType.elementType if groups else "string"
    gold, given = F.col(true), F.col(pred)

    def entry(kind: str, group: Column = none, cell: bool = True, bin_: Column = none, score: Column = none, hit: Column = none) -> Column:
        side = [c if cell else none.cast(df.schema[name].dataType) for c, name in ((gold, true), (given, pred))]
        whole = kind == "all"
        return F.struct(
            F.lit(kind).alias("kind"), group.cast(of).alias("group"), side[0].alias("gold"), side[1].alias("pred"), bin_.cast("int").alias("bin"), score.cast("double").alias("score"),
            (p if whole else none.cast("double")).alias("p"), (y if whole else none.cast("double")).alias("y"), hit.cast("boolean").alias("hit"),
        )

    kinds = [F.array(entry("all", bin_=calibration.bin_index(p, fixed.BINARY_BINS) if prob else none))]
    if groups:
        kinds.append(F.coalesce(F.transform(F.array_distinct(groups), lambda g: entry("group", g)), F.array().cast(f"array<{_type_of(df, entry('group'))}>")))
    if trust_label and trust_score:
        score = F.col(trust_score).cast("double")
        one = F.array(entry("score", cell=False, score=curves.ranked_score(score), hit=F.col(trust_label) == 1))
        kinds.append(F.filter(one, lambda e: e["score"].isNotNull()))
    gap = F.col("p") - F.col("y")
    return df.select(F.inline(F.concat(*kinds))).groupBy("kind", "group", "gold", "pred", "bin", "score").agg(
        F.count("*").alias("n"), F.sum("p").alias("sum_p"), F.sum("y").alias("sum_y"), F.sum(gap * gap).alias("sum_sq"),
        F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"),
    )


def _type_of(df: DataFrame, c: Column) -> str:
    return df.select(c.alias("c")).schema["c"].dataType.simpleString()


def _class_rows(cells: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """The classification report as (section, group, metric, value)."""
    report = report_of(cells, names)
    return _long(report, "classes", [*METRICS, "support"], F.col("class"))


def agreement_report(annotations: DataFrame, dataset: str, names: Sequence[str] | None = None) -> DataFrame:
    """The whole agreement bundle of a run as (dataset, section, group, metric, value): the scalars of
    ``agreement_metrics``, the classification report, and the cells of the confusion matrix (group gold, metric predicted).

    The annotations are read once, when called; their cells are stored and everything else comes from them.
    """
    counted = stored(annotation_cells(annotations), "cells")
    scalars = agreement_of(counted)
    usable = counted.filter("pred IS NOT NULL").select("gold", "pred", "n")
    cells = matrix_of(usable)
    label = lambda c: F.col(c).cast("string")
    matrix = cells.select(F.lit("confusion").alias("section"), label("gold").alias("group"), label("pred").alias("metric"), F.col("n").cast("double").alias("value"))
    out = _long(scalars, "agreement", scalars.columns).unionByName(_class_rows(usable, names)).unionByName(matrix)
    return out.select(F.lit(dataset).alias("dataset"), "*")


def supervised_report(preds: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The whole report of saved predictions as (section, group, metric, value): size, classes, averaged and per-class
    scores, ECE, Brier score, mean entropy and confidence.

    The predictions are read once, when called: sums per (gold, predicted, confidence bin) are stored.
    """
    from . import calibration

    probs, gold = F.col("probabilities"), F.col("gold_label")
    rows = preds.select(
        gold.alias("gold"), F.col("predicted_label").alias("pred"), F.size(probs).alias("k"), pr.max_prob(probs).alias("p"), "entropy", "max_prob",
        (pr.argmax_label(probs) == gold).cast("double").alias("y"), pr.squared_error(probs, gold).alias("sq"),
    )
    counts = rows.groupBy("gold", "pred", calibration.bin_index(F.col("p"), fixed.CALIBRATION_BINS).alias("bin")).agg(
        F.count("*").alias("n"), F.max("k").alias("k"), F.sum("p").alias("sum_p"), F.sum("y").alias("sum_y"),
        *[f(c).alias(f"{name}_{c}") for c in ("sq", "entropy", "max_prob") for f, name in ((F.sum, "sum"), (F.count, "n"))],
    )
    counts = stored(counts, "counts")
    mean = lambda c: F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}"))
    size = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_samples"), F.max("k").alias("num_classes"), mean("sq").alias("brier_score"),
        mean("entropy").alias("average_entropy"), mean("max_prob").alias("average_confidence"),
    )
    bins = counts.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "sum_p", "sum_y")])
    cells = counts.groupBy("gold", "pred").agg(F.sum("n").alias("n"))
    parts = [
        _long(size, "overall", size.columns),
        _long(calibration.calibration_summary(bins), "overall", ["ece"]),
        _class_rows(cells, names),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
