"""Split and sampling queries. Documents are stratified by language; scale is shown on lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as sp
from . import inputs
from .registry import query, r6

_DOCS = "rows AS (SELECT doc_id AS id, lang AS label, md5('42:' || doc_id) AS h FROM documents)"
_ORDERS = "rows AS (SELECT o_orderkey AS id, o_orderpriority AS label, md5('42:' || o_orderkey) AS h FROM orders)"


def _shares(source: str, weight: str, total: str, name: str, out: str, none: bool = False) -> str:
    """Largest-remainder shares of ``total`` by ``weight`` over the label rows of ``source``; with ``none`` all weights may be 0."""
    exact = f"({total}) * {weight}::DOUBLE / " + (f"nullif(sum({weight}) OVER (), 0)" if none else f"sum({weight}) OVER ()")
    return f"""{out}0 AS (SELECT *, {f'coalesce({exact}, 0)' if none else exact} AS ex FROM {source}),
    {out}1 AS (SELECT *, floor(ex)::BIGINT AS fl, row_number() OVER (ORDER BY ex - floor(ex) DESC, label) AS rk,
       ({total}) - sum(floor(ex)::BIGINT) OVER () AS miss FROM {out}0),
    {out} AS (SELECT * EXCLUDE (ex, fl, rk, miss), fl + (rk <= miss)::BIGINT AS {name} FROM {out}1)"""


_COUNTS = "c AS (SELECT label, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS tot FROM rows GROUP BY label)"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, id) AS rn FROM rows)"


def _split_sql(rows: str) -> str:
    return f"""WITH {rows}, {_COUNTS}, s AS (SELECT *, ceil(0.3::DOUBLE * tot)::BIGINT AS held FROM c),
    {_shares('s', 'n', 'tot - held', 'train', 'a')}, b AS (SELECT *, n - train AS temp, ceil(0.5::DOUBLE * held)::BIGINT AS tst FROM a),
    {_shares('b', 'temp', 'held - tst', 'dev', 'q')}, {_RANKED}
    SELECT id, label, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + dev THEN 'dev' ELSE 'test' END AS split
    FROM ranked JOIN q USING (label)"""


def _docs(spark, d):
    return inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))


def _orders(spark, d):
    return inputs.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))


@query("stratified_split", _split_sql(_DOCS))
def stratified_split(spark, d):
    return sp.stratified_split(_docs(spark, d))


_KEYS = "rows AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE o_custkey::VARCHAR END AS label, md5('42:' || o_orderkey) AS h FROM orders)"


@query("stratified_split_many_labels", _split_sql(_KEYS))
def stratified_split_many_labels(spark, d):
    """A label per customer, and one label for a third of the rows."""
    label = F.when(F.col("o_orderkey") % 3 == 0, "hot").otherwise(F.col("o_custkey").cast("string"))
    return sp.stratified_split(inputs.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), label.alias("label")))


@query("stratified_split_orders", _split_sql(_ORDERS))
def stratified_split_orders(spark, d):
    return sp.stratified_split(_orders(spark, d))


@query(
    "split_from_existing",
    f"""WITH all_rows AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS label,
        md5('42:' || (l_orderkey * 10 + l_linenumber)) AS h, CASE WHEN l_linestatus = 'O' THEN 'test' ELSE 'train' END AS given FROM lineitem),
      rows AS (SELECT * FROM all_rows WHERE given = 'test'), {_COUNTS}, s AS (SELECT *, ceil(0.5::DOUBLE * tot)::BIGINT AS held FROM c),
      {_shares('s', 'n', 'tot - held', 'dev', 'q')}, {_RANKED}
      SELECT id, label, CASE WHEN rn <= dev THEN 'dev' ELSE 'test' END AS split FROM ranked JOIN q USING (label)
      UNION ALL SELECT id, label, 'train' FROM all_rows WHERE given = 'train'""",
)
def split_from_existing(spark, d):
    """Train and test are given (by line status); dev is cut from test, per return flag."""
    items = inputs.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_returnflag").alias("label"),
        F.when(F.col("l_linestatus") == "O", "test").otherwise("train").alias("split"),
    )
    return sp.split_from_existing(items, present=["train", "test"]).select("id", "label", "split")


@query(
    "split_train_only",
    f"""WITH {_ORDERS}, {_COUNTS}, s AS (SELECT *, ceil(0.15::DOUBLE * tot)::BIGINT AS held FROM c),
      {_shares('s', 'n', 'tot - held', 'train', 'a')}, b AS (SELECT *, n - train AS devn FROM a),
      {_RANKED}, devrows AS (SELECT id, label, h FROM ranked JOIN b USING (label) WHERE rn > train),
      t AS (SELECT *, ceil(0.5::DOUBLE * held)::BIGINT AS tst FROM b),
      {_shares('t', 'devn', 'held - tst', 'dev', 'q')},
      again AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, id) AS rn FROM devrows)
      SELECT id, label, 'train' AS split FROM ranked JOIN a USING (label) WHERE rn <= train
      UNION ALL SELECT id, label, CASE WHEN rn <= dev THEN 'dev' ELSE 'test' END FROM again JOIN q USING (label)""",
)
def split_train_only(spark, d):
    """Only train is given: dev is 15% of it, and test half of that dev."""
    return sp.split_from_existing(_orders(spark, d).withColumn("split", F.lit("train")), present=["train"]).select("id", "label", "split")


@query(
    "split_dev_from_train",
    f"""WITH all_rows AS (SELECT o_orderkey AS id, o_orderpriority AS label, md5('42:' || o_orderkey) AS h,
        CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS given FROM orders),
      rows AS (SELECT * FROM all_rows WHERE given = 'train'), {_COUNTS}, s AS (SELECT *, ceil(0.15::DOUBLE * tot)::BIGINT AS held FROM c),
      {_shares('s', 'n', 'tot - held', 'train', 'q')}, {_RANKED}
      SELECT id, label, CASE WHEN rn <= train THEN 'train' ELSE 'dev' END AS split FROM ranked JOIN q USING (label)
      UNION ALL SELECT id, label, 'test' FROM all_rows WHERE given = 'test'""",
)
def split_dev_from_train(spark, d):
    """Train and test are given; dev is 15% of train."""
    rows = _orders(spark, d).withColumn("split", F.when(F.col("id") % 4 == 0, "test").otherwise("train"))
    return sp.split_from_existing(rows, dev_from="train", present=["train", "test"]).select("id", "label", "split")


@query(
    "split_validation",
    "SELECT o_orderkey AS id, o_orderpriority AS label, CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split FROM orders",
)
def split_validation(spark, d):
    """All splits are given, dev under the name validation: nothing is cut."""
    third = F.col("id") % 3
    rows = _orders(spark, d).withColumn("split", F.when(third == 0, "train").when(third == 1, "validation").otherwise("test"))
    return sp.split_from_existing(rows).select("id", "label", "split")


_SAMPLE = f"""{_COUNTS}, {_shares('c', 'n', '250', 'take', 'q')}, {_RANKED},
  smp AS (SELECT id, label FROM ranked JOIN q USING (label) WHERE rn <= take)"""


@query("stratified_sample_n", f"WITH {_DOCS}, {_SAMPLE} SELECT id, label FROM smp")
def stratified_sample_n(spark, d):
    return sp.stratified_sample_n(_docs(spark, d), 250)


@query(
    "mini_splits",
    f"""WITH {_DOCS}, {_COUNTS}, m AS (SELECT *, least(100, tot // 100)::BIGINT AS few FROM c),
      {_shares('m', 'n', 'few', 'k', 'a')}, {_shares('a', 'k', 'few - few // 2', 'train', 'q')}, {_RANKED}
      SELECT id, label, CASE WHEN rn <= train THEN 'train' WHEN rn <= k THEN 'dev' ELSE 'test' END AS split
      FROM ranked JOIN q USING (label)""",
)
def mini_splits(spark, d):
    return sp.mini_splits(_docs(spark, d))


@query("label_distribution", "SELECT lang AS label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS proportion FROM documents GROUP BY lang")
def label_distribution(spark, d):
    return sp.label_distribution(_docs(spark, d)).select("label", "n", r6("proportion"))


_VALID = f"""WITH {_DOCS}, {_SAMPLE},
  v AS (SELECT c.label, c.n AS f, coalesce(x.n, 0) AS s, c.n::DOUBLE / c.tot AS fp, coalesce(x.n, 0)::DOUBLE / sum(coalesce(x.n, 0)) OVER () AS sp
    FROM c LEFT JOIN (SELECT label, count(*) AS n FROM smp GROUP BY label) x USING (label))"""

_CHI = """e AS (SELECT label, s::DOUBLE AS o, fp * sum(s) OVER () AS e, count(*) OVER () AS k FROM v),
  m AS (SELECT *, (o + e) * sum(o) OVER () / sum(o + e) OVER () AS eo, (o + e) * sum(e) OVER () / sum(o + e) OVER () AS ee FROM e),
  g AS (SELECT sum((abs(o - eo) - y1) ** 2 / eo + (abs(e - ee) - y2) ** 2 / ee) AS x2, max(k) - 1 AS dof FROM (
     SELECT *, CASE WHEN k = 2 THEN least(0.5, abs(o - eo)) ELSE 0 END AS y1, CASE WHEN k = 2 THEN least(0.5, abs(e - ee)) ELSE 0 END AS y2 FROM m) t),
  p AS (SELECT x2, dof, CASE WHEN x2 <= 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 400),
     lambda i: exp((dof / 2.0 + i) * ln(x2 / 2) - x2 / 2 - lgamma(dof / 2.0 + i + 1)))) END AS pv FROM g)"""


@query(
    "sampling_validation",
    _VALID + """ SELECT label, f AS full_count, s AS sample_count, round(fp, 6) AS full_proportion, round(sp, 6) AS sample_proportion,
      round(abs(fp - sp), 6) AS proportion_difference FROM v""",
)
def sampling_validation(spark, d):
    docs = _docs(spark, d)
    v = sp.sampling_validation(docs, sp.stratified_sample_n(docs, 250))
    return v.select("label", "full_count", "sample_count", *[r6(c) for c in ("full_proportion", "sample_proportion", "proportion_difference")])


@query("chi_square_test", _VALID + f", {_CHI} SELECT round(x2, 6) AS chi2_statistic, dof::INT AS dof, round(pv, 6) AS p_value FROM p")
def chi_square_test(spark, d):
    docs = _docs(spark, d)
    t = sp.chi_square_test(sp.sampling_validation(docs, sp.stratified_sample_n(docs, 250)))
    return t.select(r6("chi2_statistic"), "dof", r6("p_value"))


# A sample that is not stratified: the labelled documents against all documents.
@query(
    "chi_square_unbalanced",
    f"""WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang),
      x AS (SELECT lang AS label, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY lang),
      v AS (SELECT label, c.n AS f, coalesce(x.n, 0) AS s, c.n::DOUBLE / sum(c.n) OVER () AS fp FROM c LEFT JOIN x USING (label)),
      {_CHI} SELECT round(x2, 6) AS chi2_statistic, dof::INT AS dof, round(pv, 6) AS p_value FROM p""",
)
def chi_square_unbalanced(spark, d):
    poor = inputs.labelled_text(spark, d).filter("quality = 0").select("id", F.col("lang").alias("label"))
    t = sp.chi_square_test(sp.sampling_validation(_docs(spark, d), poor))
    return t.select(r6("chi2_statistic"), "dof", r6("p_value"))


# A sample far from the proportions of the whole. For two degrees of freedom ln p is minus half of the statistic.
@query(
    "chi_square_skewed",
    f"""WITH c AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY ALL),
      x AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' OR l_linenumber = 1 GROUP BY ALL),
      v AS (SELECT label, c.n AS f, coalesce(x.n, 0) AS s, c.n::DOUBLE / sum(c.n) OVER () AS fp FROM c LEFT JOIN x USING (label)),
      {_CHI} SELECT round(x2, 4) AS chi2_statistic, dof::INT AS dof, round(-x2 / 2, 4) AS ln_p_value FROM g""",
)
def chi_square_skewed(spark, d):
    items = inputs.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), "l_linenumber")
    t = sp.chi_square_test(sp.sampling_validation(items, items.filter("label = 'R' OR l_linenumber = 1")))
    return t.select(F.round("chi2_statistic", 4).alias("chi2_statistic"), "dof", F.round("ln_p_value", 4).alias("ln_p_value"))


_MAPS = {"full_distribution": "f", "sample_distribution": "s", "full_proportions": "fp", "sample_proportions": "sp", "proportion_differences": "abs(fp - sp)"}


@query(
    "sampling_report",
    _VALID + f""", {_CHI} SELECT 42 AS random_seed, 'hash order, largest remainder' AS sampling_method, 'label' AS stratify_column,
      sum(f)::BIGINT AS full_dataset_size, sum(s)::BIGINT AS sample_size,
      round(max(abs(fp - sp)), 6) AS max_proportion_difference, round(any_value(x2), 6) AS chi2_statistic, round(any_value(pv), 6) AS p_value,
      max(abs(fp - sp)) <= 0.01 AS proportion_test_passed,
      {', '.join(f"string_agg(label || '=' || (1000000 * {v})::DOUBLE::BIGINT, ',' ORDER BY label) AS {k}" for k, v in _MAPS.items())},
      CASE WHEN max(abs(fp - sp)) <= 0.01 THEN 'APPROVED for LLM annotation' ELSE 'REVIEW REQUIRED' END AS recommendation FROM v, p""",
)
def sampling_report(spark, d):
    """Every column; maps are shown as label=value in millionths."""
    docs = _docs(spark, d)
    r = sp.sampling_report(docs, sp.stratified_sample_n(docs, 250))

    def shown(name):
        value = lambda e: F.rint(e["value"] * 1_000_000).cast("long").cast("string")
        entries = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), value(e)))
        return F.array_join(entries, ",").alias(name)

    return r.select(
        "random_seed", "sampling_method", "stratify_column", "full_dataset_size", "sample_size", r6("max_proportion_difference"), r6("chi2_statistic"),
        r6("p_value"), "proportion_test_passed", *[shown(m) for m in _MAPS], "recommendation",
    )


@query(
    "factorize_labels",
    """WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type)
      SELECT event_id AS id, e.event_type, code::INT AS label_code FROM events e JOIN f USING (event_type)""",
)
def factorize_labels(spark, d):
    events = inputs.table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    return sp.factorize_labels(events, "event_type")
