"""Stratified splits and samples with exact quotas.

Selection is by hash order: rows of a label are ordered by md5("seed:id"), then id, and consecutive
stretches of that order go to the splits. The quotas turn into one cut point (hash, id) per label and
split. The cut points come from two passes over (id, label) alone: counts per (label, hash bucket), then a ranking
inside the one bucket per cut in which the quota falls. No pass puts a label into one task.

With up to FEW labels the cut points reach the rows as a scalar subquery: the output is a narrow pass over the input, the
text never moves. With more labels rows meet their cut points in a join by label; labels that hold at least one in FEW
rows, of which there are at most FEW, keep to the scalar subquery and are dealt evenly in that join, so no label makes a large task.
Label rows are then summed and ranked in parts as well. ``many`` says which it is; if it is not given, one job over the
label column asks when the function is called. The rest is lazy where labels are few.

NULL is a label like any other. Ids have to be unique; a repeated id at a cut raises an error when the result is computed,
because no exact quota exists then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.scalar import ratio
from ..functions.statistics import chi2_ln_sf, chi2_sf
from ..sources.shared import stored
from .ranking import ranked

BUCKET_DIGITS = 4  # 65,536 hash buckets per label
FEW = 256  # labels whose cut points go to every task
SPREAD_DIGITS = 3  # rows of a large label are dealt to 4,096 keys


def label_key(label: Column) -> Column:
    """A label as a string that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit(""))


def order_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def _total(rows: DataFrame, column: str, many: bool) -> Column:
    """Sum of a column over all label rows, for each of them."""
    return rows.agg(F.sum(column)).scalar() if many else F.sum(column).over(Window.partitionBy())  # at most FEW rows


def largest_remainder(counts: DataFrame, total: Column, weight: str, name: str, many: bool = False) -> DataFrame:
    """Add ``name``: integer shares of ``total`` proportional to ``weight``, ties by label.

    ``counts`` has one row per label; ``total`` must be the same on every row. With ``many`` label rows are stored and ranked in parts.
    """
    exact = total * F.col(weight) / F.nullif(_total(counts, weight, many), F.lit(0))
    parts = counts.withColumn("_exact", F.coalesce(exact.cast("double"), F.lit(0.0))).withColumn("_floor", F.floor("_exact"))
    parts = parts.withColumn("_rest", F.col("_exact") - F.col("_floor")).withColumn("_total", F.round(total).cast("long"))
    order = [F.desc("_rest"), F.asc("label")]
    if many:
        parts = ranked(parts.withColumn("_one", F.lit("")), "_one", order, "shares").drop("_one", "total").withColumnRenamed("rank", "_rank")
    else:
        parts = parts.withColumn("_rank", F.row_number().over(Window.orderBy(*order)) - 1)
    missing = F.col("_total") - _total(parts, "_floor", many)
    return parts.withColumn(name, F.col("_floor") + (F.col("_rank") < missing).cast("long")).drop("_exact", "_floor", "_rest", "_rank", "_total")


def _label_counts(df: DataFrame, label_col: str) -> DataFrame:
    return df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))


def _counted(df: DataFrame, label_col: str, many: bool | None) -> tuple[DataFrame, bool]:
    """Rows per label, stored if there are many, and whether there are."""
    counts = _label_counts(df, label_col)
    if many is None:
        many = counts.limit(FEW + 1).count() > FEW
    return (stored(counts, "labels") if many else counts), many


def _cut_points(df: DataFrame, id_col: str, label_col: str, quotas: DataFrame, splits: Sequence[str], seed: int) -> DataFrame:
    """(key, cut_<split>...) where a cut is the (hash, id) of the last row that belongs to the split.

    ``quotas`` holds one row per label with a column per split. A split with no row of a label gets no cut.
    """
    keyed = df.select(
        F.col(id_col).alias("id"), label_key(F.col(label_col)).alias("key"), order_hash(id_col, seed).alias("h")
    ).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))

    running = F.lit(0).cast("long")
    ends = []
    for i, s in enumerate(splits):
        running = running + F.col(s)
        ends.append(F.struct(F.lit(i).alias("cut"), running.alias("upto")))
    wanted = quotas.select(label_key(F.col("label")).alias("key"), F.inline(F.array(*ends)))

    up_to_here = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (
        keyed.groupBy("key", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("after", F.sum("n").over(up_to_here))
    )
    edge = (
        buckets.join(wanted, "key")
        .filter((F.col("upto") > F.col("after") - F.col("n")) & (F.col("upto") <= F.col("after")))
        .select("key", "bucket", "cut", (F.col("upto") - F.col("after") + F.col("n")).alias("rank"))
    )
    within = Window.partitionBy("key", "cut").orderBy("h", "id")
    again = F.lead("id").over(within).eqNullSafe(F.col("id")) & (F.lead("h").over(within).eqNullSafe(F.col("h")))
    last = (
        keyed.join(edge, ["key", "bucket"])
        .withColumn("rn", F.row_number().over(within))
        .withColumn("again", again)
        .filter("rn = rank")
        .withColumn("id", F.when(F.col("again"), F.raise_error(F.lit("ids repeat: no exact split exists"))).otherwise(F.col("id")))
    )
    cuts = [
        F.max(F.when(F.col("cut") == i, F.struct("h", "id"))).alias(f"cut_{s}") for i, s in enumerate(splits)
    ]
    return last.groupBy("key").agg(*cuts)


def _as_map(cuts: DataFrame, splits: Sequence[str]) -> Column:
    """The cut points of at most FEW labels as one map, a scalar subquery."""
    entry = F.struct("key", F.struct(*[f"cut_{s}" for s in splits]))
    return cuts.agg(F.map_from_entries(F.collect_list(entry)).alias("cuts")).scalar()


def assign_splits(
    df: DataFrame, quotas: DataFrame, splits: Sequence[str], id_col: str, label_col: str, seed: int = fixed.SEED, many: bool = False
) -> DataFrame:
    """Add ``split``: quota rows of each label to the first split, the next ones to the second, and so on.

    Rows beyond the last quota get NULL. ``quotas`` has one row per label: label, n (its rows) and a column per split. Without ``many``
    there are at most FEW of them.
    """
    if many:
        quotas = stored(quotas, "quotas")
    cuts = _cut_points(df, id_col, label_col, quotas, splits, seed)
    key = label_key(F.col(label_col))
    placed = df.withColumn("_place", F.struct(order_hash(id_col, seed).alias("h"), F.col(id_col).alias("id")))
    if many:
        cuts = stored(cuts, "cuts")
        large = quotas.withColumn("_all", quotas.agg(F.sum("n")).scalar()).filter(F.col("n") * FEW >= F.col("_all"))
        large = large.select(label_key(F.col("label")).alias("key"))  # at most FEW
        placed = placed.withColumn("_large", F.element_at(_as_map(cuts.join(large, "key", "left_semi"), splits), key))
        dealt = F.when(F.col("_large").isNull(), key).otherwise(F.concat(F.lit("#"), F.substring("_place.h", 1, SPREAD_DIGITS)))  # no label's key
        points = cuts.join(large, "key", "left_anti").select(F.col("key").alias("_key"), F.struct(*[f"cut_{s}" for s in splits]).alias("_small"))
        placed = placed.withColumn("_key", dealt).join(points, "_key", "left").withColumn("_mine", F.coalesce("_large", "_small")).drop("_key", "_large", "_small")
    else:
        placed = placed.withColumn("_mine", F.element_at(_as_map(cuts, splits), key))
    split = None
    for s in splits:
        inside = F.col("_place") <= F.col(f"_mine.cut_{s}")
        split = F.when(inside, s) if split is None else split.when(inside, s)
    return placed.withColumn("split", split).select(*[F.col(f"`{c}`") for c in df.columns if c != "split"], "split")


def _two_stage_quotas(counts: DataFrame, holdout: float, second: float, many: bool = False) -> DataFrame:
    """Train, dev and test quotas: ``holdout`` of all rows leaves train, ``second`` of those is test.

    Sizes round up on the test side at each stage; shares per label are largest-remainder.
    """
    out = counts.withColumn("_all", _total(counts, "n", many))
    out = out.withColumn("_held", F.ceil(F.lit(float(holdout)) * F.col("_all"))).withColumn("_train", F.col("_all") - F.col("_held"))
    out = largest_remainder(out, F.col("_train"), "n", "train", many).withColumn("_temp", F.col("n") - F.col("train"))
    out = out.withColumn("_test", F.ceil(F.lit(float(second)) * F.col("_held")))
    out = largest_remainder(out, F.col("_held") - F.col("_test"), "_temp", "dev", many)
    return out.withColumn("test", F.col("_temp") - F.col("dev")).select("label", "n", "train", "dev", "test")


def stratified_split(
    df: DataFrame, id_col: str = "id", label_col: str = "label", holdout: float = 0.3, second: float = 0.5, seed: int = fixed.SEED, many: bool | None = None
) -> DataFrame:
    """70/15/15 by default, in two stratified stages; adds ``split``."""
    counts, many = _counted(df, label_col, many)
    return assign_splits(df, _two_stage_quotas(counts, holdout, second, many), ["train", "dev", "test"], id_col, label_col, seed, many)


def split_in_two(
    df: DataFrame, share: float, first: str, second: str, id_col: str = "id", label_col: str = "label", seed: int = fixed.SEED, many: bool | None = None
) -> DataFrame:
    """Stratified split into ``first`` and a ``share`` (rounded up) called ``second``."""
    counts, many = _counted(df, label_col, many)
    n = _total(counts, "n", many)
    counts = counts.withColumn("_size", n - F.ceil(F.lit(float(share)) * n))
    quotas = largest_remainder(counts, F.col("_size"), "n", first, many)
    quotas = quotas.withColumn(second, F.col("n") - F.col(first)).select("label", "n", first, second)
    return assign_splits(df, quotas, [first, second], id_col, label_col, seed, many)


def given_splits(df: DataFrame, split_col: str = "split") -> set[str]:
    """Which of train, dev (or validation) and test occur. One aggregate job."""
    names = {"train": "train", "dev": "dev", "validation": "dev", "test": "test"}
    found = df.agg(*[F.max(F.col(split_col) == n).alias(n) for n in names]).first()
    return {split for name, split in names.items() if found[name]}


def split_from_existing(
    df: DataFrame,
    split_col: str = "split",
    id_col: str = "id",
    label_col: str = "label",
    seed: int = fixed.SEED,
    dev_from: str = "test",
    present: Sequence[str] | None = None,
    many: bool | None = None,
) -> DataFrame:
    """Complete a data set that lacks dev or test, keeping the splits it has; ``validation`` is dev.

    Without dev it is cut from ``dev_from``: half of test, or 15% of train. Without test, test is half of dev. Without
    train everything is split 70/15/15. ``present`` names the splits there are; if it is not given, one job asks.
    Rows without a split raise an error; splits of other names stay as they are.
    """
    have = set(present) if present is not None else given_splits(df, split_col)
    if "train" not in have:
        return stratified_split(df.drop(split_col), id_col, label_col, seed=seed, many=many)
    known = F.col(split_col)
    known = F.when(known.isNull(), F.raise_error(F.lit("a row has no split"))).when(known == "validation", "dev").otherwise(known)
    out = df.drop(split_col).withColumn("split", known) if split_col != "split" else df.withColumn("split", known)

    def cut(rows: DataFrame, source: str, share: float, second: str) -> DataFrame:
        made = split_in_two(rows.filter(F.col("split") == source).drop("split"), share, source, second, id_col, label_col, seed, many)
        return rows.filter(F.col("split") != source).unionByName(made)

    if "dev" not in have:
        if dev_from == "test" and "test" in have:
            made = split_in_two(out.filter("split = 'test'").drop("split"), 0.5, "dev", "test", id_col, label_col, seed, many)
            out = out.filter("split != 'test'").unionByName(made)
        else:
            out = cut(out, "train", 0.15, "dev")
    return out if "test" in have else cut(out, "dev", 0.5, "test")


def stratified_sample_n(df: DataFrame, n: int, id_col: str = "id", label_col: str = "label", seed: int = fixed.SEED, many: bool | None = None) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) with the label proportions kept; all input columns."""
    counts, many = _counted(df, label_col, many)
    quotas = largest_remainder(counts, F.lit(n), "n", "sample", many)
    quotas = quotas.select("label", "n", F.least("sample", "n").alias("sample"))
    chosen = assign_splits(df, quotas, ["sample"], id_col, label_col, seed, many)
    return chosen.filter("split = 'sample'").drop("split")


def mini_splits(df: DataFrame, id_col: str = "id", label_col: str = "label", seed: int = fixed.SEED, many: bool | None = None) -> DataFrame:
    """Nearly all of a sample becomes test; min(100, 1%) rows go to train and dev, half each.

    Under 100 rows everything is test, and the first row also serves as train and as dev.
    """
    counts, many = _counted(df, label_col, many)
    counts = counts.withColumn("_all", F.least(F.lit(100), F.floor(_total(counts, "n", many) / 100)))
    quotas = largest_remainder(counts, F.col("_all"), "n", "_few", many)
    quotas = largest_remainder(quotas, F.col("_all") - F.floor(F.col("_all") / 2), "_few", "train", many)
    quotas = quotas.withColumn("dev", F.col("_few") - F.col("train")).withColumn("test", F.col("n") - F.col("_few"))
    whole = assign_splits(df, quotas.select("label", "n", "train", "dev", "test"), ["train", "dev", "test"], id_col, label_col, seed, many)
    first = df.orderBy(id_col).limit(1).withColumn("_n", df.agg(F.count("*")).scalar()).filter("_n < 100").drop("_n")
    for s in ("train", "dev"):
        whole = whole.unionByName(first.withColumn("split", F.lit(s)))
    return whole


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Count and proportion per label. The window runs over one row per label."""
    total = F.sum("n").over(Window.partitionBy())
    return _label_counts(df, label_col).withColumn("proportion", F.col("n") / total)


def sampling_validation(full: DataFrame, sample: DataFrame, label_col: str = "label") -> DataFrame:
    """Per label: counts and proportions on both sides and their absolute difference."""
    sides = _label_counts(full, label_col).select("label", F.col("n").alias("full_count"), F.lit(0).cast("long").alias("sample_count"))
    other = _label_counts(sample, label_col).select("label", F.lit(0).cast("long").alias("full_count"), F.col("n").alias("sample_count"))
    both = sides.unionByName(other).groupBy("label").agg(F.sum("full_count").alias("full_count"), F.sum("sample_count").alias("sample_count"))
    everything = Window.partitionBy()  # one row per label
    return (
        both.withColumn("full_proportion", ratio(F.col("full_count"), F.sum("full_count").over(everything)))
        .withColumn("sample_proportion", ratio(F.col("sample_count"), F.sum("sample_count").over(everything)))
        .withColumn("proportion_difference", F.abs(F.col("full_proportion") - F.col("sample_proportion")))
    )


def chi_square_test(validation: DataFrame) -> DataFrame:
    """2 x k contingency test of sample counts against the counts expected from the full proportions.

    For k = 2 the difference is reduced by up to 0.5 (Yates). Returns statistic, degrees of freedom, p and ln p.
    """
    everything = Window.partitionBy()  # one row per label
    observed = F.col("sample_count").cast("double")
    expected = F.col("full_proportion") * F.sum("sample_count").over(everything)
    table = validation.select(observed.alias("o"), expected.alias("e")).withColumn("k", F.count("*").over(everything))
    table = table.withColumn("col", F.col("o") + F.col("e"))
    total = F.sum("col").over(everything)

    def part(cell: str) -> Column:
        center = F.sum(cell).over(everything) * F.col("col") / F.nullif(total, F.lit(0.0))
        gap = F.abs(F.col(cell) - center)
        less = F.when(F.col("k") == 2, F.least(F.lit(0.5), gap)).otherwise(F.lit(0.0))
        return F.try_divide((gap - less) * (gap - less), center)

    stat = table.select("k", (part("o") + part("e")).alias("x")).agg(
        F.sum("x").alias("chi2_statistic"), (F.max("k") - 1).cast("int").alias("dof")
    )
    x, dof = F.col("chi2_statistic"), F.col("dof")
    return stat.withColumn("p_value", chi2_sf(x, dof)).withColumn("ln_p_value", chi2_ln_sf(x, dof))


def sampling_report(full: DataFrame, sample: DataFrame, label_col: str = "label", seed: int = fixed.SEED) -> DataFrame:
    """One row: sampling metadata, validation and the verdict, with maps keyed by label.

    The table of labels is computed when this is called and stored, as totals and test both need it.
    """
    per_label = stored(sampling_validation(full, sample, label_col), "labels")

    def by_label(value: str) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("label").cast("string"), value))))

    passed = F.col("max_proportion_difference") <= fixed.MAX_PROPORTION_GAP
    totals = per_label.agg(
        F.sum("full_count").alias("full_dataset_size"),
        F.sum("sample_count").alias("sample_size"),
        F.max("proportion_difference").alias("max_proportion_difference"),
        by_label("full_count").alias("full_distribution"),
        by_label("sample_count").alias("sample_distribution"),
        by_label("full_proportion").alias("full_proportions"),
        by_label("sample_proportion").alias("sample_proportions"),
        by_label("proportion_difference").alias("proportion_differences"),
    )
    test = chi_square_test(per_label).select(F.struct("chi2_statistic", "p_value"))
    return (
        totals.withColumn("_test", test.scalar())
        .select(
            F.lit(seed).alias("random_seed"),
            F.lit("hash order, largest remainder").alias("sampling_method"),
            F.lit(label_col).alias("stratify_column"),
            "*",
            F.col("_test.chi2_statistic").alias("chi2_statistic"),
            F.col("_test.p_value").alias("p_value"),
            passed.alias("proportion_test_passed"),
            F.when(passed, fixed.APPROVED).otherwise(fixed.NEEDS_REVIEW).alias("recommendation"),
        )
        .drop("_test")
    )


def factorize_labels(df: DataFrame, label_col: str, id_col: str = "id", out: str = "label_code") -> DataFrame:
    """Integer codes for string labels, in order of first appearance by id; -1 without a label."""
    first = df.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("_name")).agg(F.min(id_col).alias("_first"))
    codes = first.select("_name", (F.row_number().over(Window.orderBy("_first", "_name")) - 1).alias(out))  # one row per label
    joined = df.join(codes, F.col(label_col) == F.col("_name"), "left").drop("_name")
    return joined.withColumn(out, F.coalesce(out, F.lit(-1)))
