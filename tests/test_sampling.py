"""Splits and samples: published quotas, brute-force selection, odd shapes, chi-square."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from labelquality.operators import sampling as sp
from labelquality.operators.ranking import ranked


def frame(spark, counts):
    """ids 0.. with label i repeated counts[i] times."""
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "label string, n int")
    rows = df.select("label", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    return rows.select((F.xxhash64("label", "k") % 1_000_000_007).alias("id"), "label")


def brute(rows, quotas):
    """{id: split} by md5 order; quotas[label] = [(split, n), ...]."""
    out = {}
    for label, parts in quotas.items():
        ids = sorted((r.id for r in rows if r.label == label), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
        at = 0
        for split, n in parts:
            for i in ids[at : at + n]:
                out[i] = split
            at += n
    return out


def test_published_quota(spark):
    df = frame(spark, [89543, 7777])
    sample = sp.stratified_sample_n(df, 10_000)
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {"0": 9201, "1": 799}
    report = sp.sampling_report(df, sample).first()
    assert report.chi2_statistic == 0.0 and report.p_value == 1.0
    assert report.max_proportion_difference == pytest.approx(1.1631730374106475e-05, rel=1e-9)
    assert report.proportion_test_passed and report.recommendation == "APPROVED for LLM annotation"
    assert report.full_distribution == {"0": 89543, "1": 7777} and report.sample_proportions == {"0": 0.9201, "1": 0.0799}


def test_selection_is_the_hash_order(spark):
    df = frame(spark, [50, 31, 1])
    rows = df.collect()
    got = {r.id: r.split for r in sp.stratified_split(df).collect()}
    assert len(got) == 82 and set(got) == {r.id for r in rows}
    sizes = {s: sum(v == s for v in got.values()) for s in ("train", "dev", "test")}
    held = math.ceil(0.3 * 82)
    assert sizes == {"train": 82 - held, "dev": held - math.ceil(held / 2), "test": math.ceil(held / 2)}
    per = {}
    for r in rows:
        per.setdefault(r.label, {}).setdefault(got[r.id], 0)
        per[r.label][got[r.id]] += 1
    quotas = {lb: [(s, c.get(s, 0)) for s in ("train", "dev", "test")] for lb, c in per.items()}
    assert got == brute(rows, quotas)


@pytest.mark.parametrize("n", [0, 1, 7, 81, 82, 500])
def test_sample_sizes(spark, n):
    df = frame(spark, [50, 31, 1])
    sample = sp.stratified_sample_n(df, n)
    assert sample.count() == min(n, 82) and sample.distinct().count() == min(n, 82)
    assert sample.columns == df.columns


def test_one_label_only_and_empty(spark):
    one = frame(spark, [40])
    assert {r.split: r["count"] for r in sp.stratified_split(one).groupBy("split").count().collect()} == {"train": 28, "dev": 6, "test": 6}
    assert sp.stratified_split(one.filter("false")).count() == 0


def test_null_is_a_label(spark):
    rows = [(i, None if i % 4 == 0 else "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label string")
    sample = sp.stratified_sample_n(df, 100)
    assert sample.count() == 100 and sample.filter("label IS NULL").count() == 25
    split = {r.split: r["count"] for r in sp.stratified_split(df).groupBy("split").count().collect()}
    assert split == {"train": 140, "dev": 30, "test": 30}


def test_repeated_ids_are_refused(spark):
    df = spark.createDataFrame([(7, "a")] * 100, "id long, label string")
    with pytest.raises(Exception, match="ids repeat"):
        sp.stratified_sample_n(df, 10).count()


def test_building_runs_no_job(spark):
    df = frame(spark, [50, 30])
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        sp.stratified_sample_n(df, 20, many=False), sp.factorize_labels(df, "label")
        sp.stratified_split(df, many=False), sp.mini_splits(df, many=False), sp.split_in_two(df, 0.5, "a", "b", many=False)
        sp.split_from_existing(df.withColumn("split", F.lit("train")), present=["train"], many=False)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_split_rules(spark):
    """validation is dev; dev from train where the data set says so; unknown names and NULL do not pass unseen."""
    base = spark.range(1000).withColumn("label", (F.col("id") < 700).cast("int"))
    name = F.when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "validation").otherwise("test")
    got = {r.split: r["count"] for r in sp.split_from_existing(base.withColumn("split", name)).groupBy("split").count().collect()}
    assert got == {"train": 600, "dev": 200, "test": 200}
    two = base.withColumn("split", F.when(F.col("id") % 10 < 6, "train").otherwise("test"))
    got = {r.split: r["count"] for r in sp.split_from_existing(two, dev_from="train").groupBy("split").count().collect()}
    assert got == {"train": 510, "dev": 90, "test": 400}
    many = base.withColumn("split", F.concat(F.lit("s"), F.col("id") % 9)).withColumn("split", F.when(F.col("id") < 500, "train").when(F.col("id") < 700, "test").otherwise(F.col("split")))
    out = sp.split_from_existing(many)
    assert out.filter("split = 'train'").count() == 500 and out.count() == 1000
    with pytest.raises(Exception, match="no split"):
        sp.split_from_existing(base.withColumn("split", F.when(F.col("id") > 20, "train"))).collect()


def test_chi_square_tail(spark):
    import math

    from labelquality.functions.statistics import chi2_ln_sf, chi2_sf

    def exact(x, dof):
        h = x / 2
        if dof % 2 == 0:
            terms = [j * math.log(h) - math.lgamma(j + 1) for j in range(dof // 2)]
        else:
            e = math.erfc(math.sqrt(h))
            start = math.log(e) + h if e > 0 else math.log((1 - 1 / (2 * h) + 3 / (4 * h * h)) / math.sqrt(math.pi * h))
            terms = [start] + [(j - 0.5) * math.log(h) - math.lgamma(j + 0.5) for j in range(1, (dof - 1) // 2 + 1)]
        top = max(terms)
        return -h + top + math.log(sum(math.exp(t - top) for t in terms))

    rows = [(x, k) for x in (1e-3, 0.5, 8.0, 50.0, 1500.0, 2000.0, 1e6, 1e10) for k in range(1, 51)]
    for r in spark.createDataFrame(rows, "x double, k int").select("x", "k", chi2_ln_sf(F.col("x"), F.col("k")).alias("l"), chi2_sf(F.col("x"), F.col("k")).alias("p")).collect():
        assert r.l == pytest.approx(exact(r.x, r.k), rel=1e-9, abs=1e-12) and 0 <= r.p <= 1


def test_mini_splits(spark):
    tiny = frame(spark, [30, 20])
    got = sp.mini_splits(tiny).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 1, "dev": 1, "test": 50}
    more = frame(spark, [900, 300])
    got = sp.mini_splits(more).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 6, "dev": 6, "test": 1188}


def test_split_from_existing(spark):
    df = frame(spark, [100, 60])
    given = df.withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("test"))
    counts = {r.split: r["count"] for r in given.groupBy("split").count().collect()}
    got = {r.split: r["count"] for r in sp.split_from_existing(given).groupBy("split").count().collect()}
    assert got["train"] == counts["train"] and got["test"] == math.ceil(counts["test"] / 2)
    assert got["dev"] + got["test"] == counts["test"]
    whole = sp.split_from_existing(df.withColumn("split", F.lit("all")))
    assert {r.split: r["count"] for r in whole.groupBy("split").count().collect()} == {"train": 112, "dev": 24, "test": 24}
    done = df.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), (F.abs("id") % 3 + 1).cast("int")))
    assert sp.split_from_existing(done).exceptAll(done).count() == 0


def test_many_labels_and_a_hot_one(spark):
    """Sizes are exact with more labels than a table in every task should hold; a third of the rows share one label, some have none."""
    n = 20_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1001 != 0, F.concat(F.lit("l"), F.floor(F.col("id") / 2))).alias("label"))
    out = sp.stratified_split(df)
    assert out.columns == ["id", "label", "split"] and "Join" in main_branch(out)
    got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert got == {"train": 14000, "dev": 3000, "test": 3000}
    hot = {r.split: r["count"] for r in out.filter("label = 'hot'").groupBy("split").count().collect()}
    size = df.filter("label = 'hot'").count()
    assert abs(hot["train"] - 0.7 * size) <= 1 and abs(hot["dev"] - 0.15 * size) <= 1.5
    assert out.select("id").distinct().count() == n
    few = df.withColumn("label", F.when(F.col("label") == "hot", "hot").otherwise(F.substring("label", 1, 2)))
    for f in (lambda m: sp.stratified_split(few, many=m), lambda m: sp.stratified_sample_n(few, 777, many=m), lambda m: sp.mini_splits(few, many=m), lambda m: sp.split_in_two(few, 0.15, "a", "b", many=m)):
        assert f(True).exceptAll(f(False)).count() == 0 and f(False).exceptAll(f(True)).count() == 0
    assert sp.stratified_sample_n(df, 5000).count() == 5000


def test_ranked_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("key"))
    got = ranked(df, "key", [F.desc("x")], "t")
    for key in "ab":
        rows = got.filter(F.col("key") == key).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range(len(rows))) and {r.total for r in rows} == {len(rows)}
        assert [r.x for r in rows] == sorted((r.x for r in rows), reverse=True)


def main_branch(df):
    """Names of the optimized plan's nodes, those of scalar subqueries left out."""
    found, left = [], [df._jdf.queryExecution().optimizedPlan()]
    while left:
        plan = left.pop()
        found.append(plan.nodeName())
        left += [plan.children().apply(k) for k in range(plan.children().size())]
    return found


def test_cut_points_leave_text_in_place(spark):
    """The output is a narrow pass: projections only between the scan and the split column."""
    df = frame(spark, [50, 31]).withColumn("text", F.lit("x"))
    assert not set(main_branch(sp.stratified_split(df, many=False))) & {"Join", "Aggregate", "Window", "Sort", "RepartitionByExpression"}


def test_chi_square(spark):
    from labelquality.functions.statistics import chi2_sf

    known = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (16.918977604620448, 9, 0.05), (0.0, 3, 1.0), (10.827566170662733, 1, 0.001), (1.0, 4, 0.909795989568950)]
    df = spark.createDataFrame(known, "x double, k int, p double")
    for r in df.withColumn("q", chi2_sf(F.col("x"), F.col("k"))).collect():
        assert r.q == pytest.approx(r.p, abs=1e-9)


def test_review_required(spark):
    full, sample = frame(spark, [50, 50]), frame(spark, [30, 10])
    report = sp.sampling_report(full, sample).first()
    assert not report.proportion_test_passed and report.recommendation == "REVIEW REQUIRED"
    # 2 x 2 table [[30, 10], [20, 20]]: |O - E| = 5, less 0.5 for k = 2
    want = 2 * 4.5**2 / 25 + 2 * 4.5**2 / 15
    assert report.chi2_statistic == pytest.approx(want) and 0.02 < report.p_value < 0.05


def test_label_distribution_and_factorize(spark):
    df = spark.createDataFrame([(5, "b"), (2, "c"), (3, "b"), (9, "a"), (1, None)], "id int, label string")
    got = {r.id: r.label_code for r in sp.factorize_labels(df, "label").collect()}
    assert got == {2: 0, 3: 1, 5: 1, 9: 2, 1: -1}
    assert {r.label: r.proportion for r in sp.label_distribution(df.filter("id > 1")).collect()} == {"b": 0.5, "c": 0.25, "a": 0.25}
