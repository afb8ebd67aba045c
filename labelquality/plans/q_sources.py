"""Reader, sink and incremental-run queries. Files are made from the benchmark tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text as tx
from ..operators import agreement as ag, sampling as sp
from ..sources import readers, sinks
from ..sources.shared import shared_dir, stored
from ..streaming import incremental as inc
from . import inputs, q_agreement as qa
from .oracle_parts import LABELLED, bundle_rows, classes, parsed
from .q_responses import _ANN_COLUMNS
from .q_sampling import _COUNTS, _RANKED, _SAMPLE, _DOCS, _shares
from .registry import query, r6


def _split_sql(rows: str, columns: str, where: str = "true") -> str:
    return f"""WITH {rows}, {_COUNTS}, s AS (SELECT *, ceil(0.3::DOUBLE * tot)::BIGINT AS held FROM c),
    {_shares('s', 'n', 'tot - held', 'train', 'a')}, b AS (SELECT *, n - train AS temp, ceil(0.5::DOUBLE * held)::BIGINT AS tst FROM a),
    {_shares('b', 'temp', 'held - tst', 'dev', 'q')}, {_RANKED},
    sp AS (SELECT ranked.*, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + dev THEN 'dev' ELSE 'test' END AS split
      FROM ranked JOIN q USING (label)) SELECT {columns} FROM sp WHERE {where}"""


_TEXT_ROWS = "rows AS (SELECT d.doc_id AS id, l.toxic AS label, d.text, md5('42:' || d.doc_id) AS h FROM documents d JOIN labels l USING (doc_id))"
_CLAIM_ROWS = """rows AS (SELECT d.doc_id AS id, d.text, md5('42:' || d.doc_id) AS h,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTS' WHEN quality = 0 AND toxic = 1 THEN 'REFUTES'
       WHEN quality = 0 THEN 'NOT ENOUGH INFO' ELSE 'DISPUTED' END AS label
  FROM documents d JOIN labels l USING (doc_id))"""
_CLAIM_CODE = "CASE label WHEN 'REFUTES' THEN 0 WHEN 'NOT ENOUGH INFO' THEN 1 WHEN 'SUPPORTS' THEN 2 END"
_HASH = "substr(sha256(text), 1, 16) AS text_hash"


FILE_BYTES = 1 << 28  # of text in a file: more than the block that one task reads, and no more than one task should write
OBJECT_ROWS = 50_000  # predictions in one object of lists, which is a file


def _write_csv_splits(spark, d, root, file_bytes=None):
    """Files as the tasks write them, or as many as it takes for about ``file_bytes`` of text in each."""
    rows = inputs.labelled_text(spark, d).select("id", "text", F.col("gold").alias("label"))
    parts = stored(sp.stratified_split(rows), "split")
    sizes = dict(parts.groupBy("split").agg(F.sum(F.octet_length("text"))).collect()) if file_bytes else {}  # three rows
    for split in readers.SPLITS:
        part = parts.filter(F.col("split") == split).drop("split")
        sinks.write_csv(part.repartition(1 + (sizes.get(split) or 0) // file_bytes) if file_bytes else part, f"{root}/{split}.csv")


@query("read_csv_splits", _split_sql(_TEXT_ROWS, f"id, {_HASH}, label, split"))
def read_csv_splits(spark, d):
    root = shared_dir(spark, "csv")
    _write_csv_splits(spark, d, root)
    back = readers.read_csv_splits(spark, root, {"id": "bigint"})
    return back.select("id", tx.text_hash(F.col("text")).alias("text_hash"), "label", "split")


@query("read_csv_splits_parallel", _split_sql(_TEXT_ROWS, f"id, {_HASH}, label, split"))
def read_csv_splits_parallel(spark, d):
    """Files of many blocks with line breaks in their texts, each of which many tasks may read; one per split unless it is large."""
    root = shared_dir(spark, "csv")
    _write_csv_splits(spark, d, root, FILE_BYTES)
    back = readers.read_csv_splits(spark, root, {"id": "bigint"}, multi_line="split")
    return back.select("id", tx.text_hash(F.col("text")).alias("text_hash"), "label", "split")


@query("read_csv_long_labels", "SELECT doc_id AS id, (1000000000000000001 + 9 * doc_id)::HUGEINT::VARCHAR AS label FROM documents")
def read_csv_long_labels(spark, d):
    """Labels of 19 digits keep them all."""
    root = shared_dir(spark, "csv")
    label = (F.col("doc_id").cast("decimal(38,0)") * 9 + F.expr("CAST(1000000000000000001 AS DECIMAL(38,0))")).cast("string")
    rows = inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("t").alias("text"), label.alias("label"))
    for k, split in enumerate(readers.SPLITS):
        sinks.write_csv(rows.filter(F.col("id") % 3 == k), f"{root}/{split}.csv")
    back = readers.read_csv_splits(spark, root, {"id": "bigint"})
    return back.select("id", F.col("label").cast("string").alias("label"))


def _write_claims(spark, d, root):
    q, t = F.col("quality"), F.col("gold")
    name = F.when((q == 1) & (t == 0), "SUPPORTS").when((q == 0) & (t == 1), "REFUTES").when(q == 0, "NOT ENOUGH INFO").otherwise("DISPUTED")
    rows = inputs.labelled_text(spark, d).select("id", F.col("text").alias("claim"), name.alias("label"))
    parts = stored(sp.stratified_split(rows), "split")
    for split, file in zip(readers.SPLITS, ("train", "paper_dev", "paper_test")):
        parts.filter(F.col("split") == split).drop("split").write.json(f"{root}/{file}.jsonl")


@query("read_jsonl_claims", _split_sql(_CLAIM_ROWS, f"id, {_HASH}, {_CLAIM_CODE} AS label, split", "label <> 'DISPUTED'"))
def read_jsonl_claims(spark, d):
    root = shared_dir(spark, "claims")
    _write_claims(spark, d, root)
    back = readers.read_jsonl_claims(spark, root, columns="id bigint, claim string, label string")
    return back.select("id", tx.text_hash(F.col("text")).alias("text_hash"), "label", "split")


_BROKEN = "id % 7 = 3"


def _broken_claims(spark, d):
    """Claims in which every seventh line is cut off in the middle."""
    root = shared_dir(spark, "claims")
    rows = inputs.labelled_text(spark, d).select("id", F.col("text").alias("claim"), F.when(F.col("quality") == 1, "SUPPORTS").otherwise("REFUTES").alias("label"))
    line = F.to_json(F.struct("id", "claim", "label"))
    line = F.when(F.expr(_BROKEN), F.substring(line, 1, 15)).otherwise(line)
    for k, file in enumerate(("train", "paper_dev", "paper_test")):
        rows.filter(F.col("id") % 3 == k).orderBy("id").coalesce(1).select(line.alias("value")).write.text(f"{root}/{file}.jsonl")
    return readers.read_jsonl_claims_kept(spark, root, columns="id bigint, claim string, label string")


_SPLIT3 = "CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split"


@query("read_jsonl_kept", f"WITH {LABELLED} SELECT id, {_HASH}, CASE WHEN quality = 1 THEN 2 ELSE 0 END AS label, {_SPLIT3} FROM labelled WHERE NOT {_BROKEN}")
def read_jsonl_kept(spark, d):
    return _broken_claims(spark, d)[0].select("id", tx.text_hash(F.col("text")).alias("text_hash"), "label", "split")


@query(
    "read_jsonl_errors",
    f"""WITH {LABELLED}, numbered AS (SELECT id, text, {_SPLIT3}, row_number() OVER (PARTITION BY id % 3 ORDER BY id) AS line FROM labelled)
      SELECT split, line, substr('{{"id":' || id || ',"claim":"', 1, 15) AS value FROM numbered WHERE {_BROKEN}""",
)
def read_jsonl_errors(spark, d):
    """The broken lines, with the place of each."""
    return _broken_claims(spark, d)[1].select("split", "line", F.substring("value", 1, 15).alias("value"))


@query(
    "load_dataset",
    "SELECT split, label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM ("
    + _split_sql(_CLAIM_ROWS, f"text, {_CLAIM_CODE} AS label, split", "label <> 'DISPUTED'")
    + ") x GROUP BY ALL",
)
def load_dataset(spark, d):
    root = shared_dir(spark, "datasets")
    _write_claims(spark, d, f"{root}/fever")
    back = readers.load_dataset(spark, "fever", root)
    return back.groupBy("split", "label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "load_dataset_imdb",
    f"""WITH all_rows AS (SELECT d.doc_id AS id, d.text, l.toxic AS label, md5('42:' || d.doc_id) AS h, CASE WHEN d.doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS given
        FROM documents d JOIN labels l USING (doc_id)),
      rows AS (SELECT * FROM all_rows WHERE given = 'test'), {_COUNTS}, s AS (SELECT *, ceil(0.5::DOUBLE * tot)::BIGINT AS held FROM c),
      {_shares('s', 'n', 'tot - held', 'dev', 'q')}, {_RANKED}
      SELECT id, {_HASH}, label, CASE WHEN rn <= dev THEN 'dev' ELSE 'test' END AS split FROM ranked JOIN q USING (label)
      UNION ALL SELECT id, {_HASH}, label, 'train' FROM all_rows WHERE given = 'train'""",
)
def load_dataset_imdb(spark, d):
    """A raw table with train and test: dev is half of test."""
    root = shared_dir(spark, "datasets")
    raw = inputs.labelled_text(spark, d).select("id", F.col("text").alias("review"), F.col("gold").alias("label"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    raw.write.parquet(f"{root}/imdb/raw")
    return readers.load_dataset(spark, "imdb", root).select("id", tx.text_hash(F.col("text")).alias("text_hash"), "label", "split")


_CRISIS = """WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type),
      all_rows AS (SELECT event_id AS id, props AS text, code::INT AS label, md5('42:' || event_id) AS h,
        CASE event_id % 4 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM events JOIN f USING (event_type))
      SELECT id, text, label, split FROM all_rows"""


def _load_crisis(spark, d, name):
    """A raw table with text labels and all splits, dev under the name validation."""
    root = shared_dir(spark, "datasets")
    part = F.col("event_id") % 4
    raw = inputs.table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("props").alias("tweet_text"), F.col("event_type").alias("class_label"),
        F.when(part == 0, "validation").when(part == 1, "test").otherwise("train").alias("split"),
    )
    raw.write.parquet(f"{root}/{name}/raw")
    return readers.load_dataset(spark, name, root).select("id", "text", "label", "split")


for _name in ("crisisbench", "crisisbench_humanitarian", "crisisbench_informativeness"):
    query(f"load_dataset_{_name}", _CRISIS)(lambda spark, d, name=_name: _load_crisis(spark, d, name))


@query(
    "load_dataset_jigsaw",
    f"""WITH {_TEXT_ROWS}, {_COUNTS}, m AS (SELECT *, least(100, tot // 100)::BIGINT AS few FROM c),
      {_shares('m', 'n', 'few', 'k', 'a')}, {_shares('a', 'k', 'few - few // 2', 'train', 'q', none=True)}, {_RANKED}, s AS (
      SELECT id, {_HASH}, label, CASE WHEN rn <= train THEN 'train' WHEN rn <= k THEN 'dev' ELSE 'test' END AS split FROM ranked JOIN q USING (label)),
      n AS (SELECT count(*) AS n FROM rows)
      SELECT * FROM s UNION ALL SELECT id, text_hash, label, x.split FROM (SELECT * FROM s ORDER BY id LIMIT 1) f, n, (SELECT unnest(['train', 'dev']) AS split) x WHERE n < 100""",
)
def load_dataset_jigsaw(spark, d):
    """A stratified sample goes before everything else."""
    root = shared_dir(spark, "datasets")
    rows = inputs.labelled_text(spark, d).select("id", "text", F.col("gold").alias("label"))
    sinks.write_csv(rows, f"{root}/jigsaw/sample.csv")
    back = readers.load_dataset(spark, "jigsaw", root, types={"id": "bigint"})
    return back.select("id", tx.text_hash(F.col("text")).alias("text_hash"), "label", "split")


@query("normalize_label_source", f"WITH {LABELLED} SELECT id, {_HASH}, (gold > 0)::INT AS label FROM labelled")
def normalize_label_source(spark, d):
    raw = inputs.labelled_text(spark, d).select("id", F.col("text").alias("comment_text"), F.col("gold").alias("toxic"))
    out = readers.normalize_label_source(raw, keep=["id"])
    return out.select("id", tx.text_hash(F.col("text")).alias("text_hash"), "label")


@query(
    "normalize_label_marks",
    "SELECT d.doc_id AS id, (l.toxic + (1 - l.quality) > 0)::INT AS label FROM documents d JOIN labels l USING (doc_id)",
)
def normalize_label_marks(spark, d):
    raw = inputs.labelled_text(spark, d).select("id", "text", F.col("gold").alias("insult"), (1 - F.col("quality")).alias("obscene"))
    return readers.normalize_label_source(raw, keep=["id"]).select("id", "label")


@query(
    "normalize_label_target",
    "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS text, ((l_quantity - 0.5::DOUBLE) / 50.0::DOUBLE >= 0.5)::INT AS label FROM lineitem",
)
def normalize_label_target(spark, d):
    raw = inputs.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_returnflag").alias("comment"),
        ((F.col("l_quantity") - 0.5) / 50.0).alias("target"),
    )
    return readers.normalize_label_source(raw, keep=["id"])


@query(
    "normalize_crisis_source",
    """WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type)
      SELECT event_id AS id, props AS text, code::INT AS label FROM events JOIN f USING (event_type)""",
)
def normalize_crisis_source(spark, d):
    raw = inputs.table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("props").alias("tweet_text"), F.col("event_type").alias("class_label")
    )
    return readers.normalize_crisis_source(raw, "id", keep=["id"])


@query("pick_text_column", "SELECT page_id AS id, substr(sha256(url), 1, 16) AS text_hash FROM pages")
def pick_text_column(spark, d):
    """No known text column: the first string column."""
    pages = inputs.table(spark, d, "pages")
    return pages.select(F.col("page_id").alias("id"), tx.text_hash(F.col(readers.pick_text_column(pages))).alias("text_hash"))


@query("pick_text_column_crisis", "SELECT event_id AS id, substr(sha256(props), 1, 16) AS text_hash FROM events")
def pick_text_column_crisis(spark, d):
    """The source's own candidates decide: comment is none of them here."""
    events = inputs.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("comment"), F.col("props").alias("tweet_text"))
    return events.select("id", tx.text_hash(F.col(readers.pick_text_column(events, fixed.CRISIS_TEXT_COLUMNS))).alias("text_hash"))


@query("test_limit", f"SELECT doc_id AS id, {_HASH} FROM documents ORDER BY doc_id LIMIT 50")
def test_limit(spark, d):
    docs = inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return readers.test_limit(docs).select("id", tx.text_hash(F.col("text")).alias("text_hash"))


_PRED_SQL = f"""WITH {classes()} SELECT example_id, gold_label, predicted_label::INT AS predicted_label, round(entropy, 6) AS entropy,
  round(max_prob, 6) AS max_prob, round(total, 6) AS probability_sum, predicted_label = gold_label AS correct FROM pred"""


def _shown(preds):
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    return preds.select(
        "example_id", "gold_label", "predicted_label", r6("entropy"), r6("max_prob"), r6(total, "probability_sum"), "correct"
    )


_PRED_FIELDS = ["example_id", "gold_label", "predicted_label", "logits", "probabilities", "entropy", "max_prob", "correct"]


@query("load_predictions", _PRED_SQL)
def load_predictions(spark, d):
    path = shared_dir(spark, "predictions")
    sinks.write_predictions(inputs.class_predictions(spark, d), path)
    return _shown(readers.load_predictions(spark, path, fields=_PRED_FIELDS))


@query("load_predictions_columns", _PRED_SQL)
def load_predictions_columns(spark, d):
    """Objects of parallel lists, one per thousand ids."""
    path = shared_dir(spark, "predictions-columns")
    preds = inputs.class_predictions(spark, d)
    rows = preds.groupBy(F.floor(F.col("example_id") / 1000).alias("chunk")).agg(F.collect_list(F.struct(*_PRED_FIELDS)).alias("r"))
    rows.select(*[F.col(f"r.{f}").alias(f) for f in _PRED_FIELDS]).write.json(path)
    return _shown(readers.load_predictions(spark, path, "columns", _PRED_FIELDS))


@query("load_predictions_lists", _PRED_SQL)
def load_predictions_lists(spark, d):
    """Files that are one object of parallel lists each, of about OBJECT_ROWS predictions; no task reads a list as a whole."""
    path = shared_dir(spark, "predictions-lists")
    preds = stored(inputs.class_predictions(spark, d), "predictions")
    objects = -(-preds.count() // OBJECT_ROWS) or 1
    preds = preds.withColumn("object", F.pmod(F.xxhash64("example_id"), F.lit(objects)))
    element = lambda f: F.regexp_replace(F.to_json(F.array(f)), r"^\[|\]$", "")
    cells = preds.select("object", "example_id", F.posexplode(F.array(*[element(f) for f in _PRED_FIELDS])).alias("field", "value"))
    cells = cells.join(preds.groupBy("object").agg(F.min("example_id").alias("first"), F.max("example_id").alias("last")), "object")
    names = F.array(*[F.lit(f'"{f}": [') for f in _PRED_FIELDS])
    opened = F.when(F.col("example_id") == F.col("first"), F.concat(F.when(F.col("field") == 0, "{").otherwise(""), F.get(names, F.col("field")))).otherwise("")
    closed = F.when(F.col("example_id") < F.col("last"), ",").when(F.col("field") < len(_PRED_FIELDS) - 1, "],").otherwise("]}")
    lines = cells.repartitionByRange(objects, "object").sortWithinPartitions("object", "field", "example_id")
    lines.select("object", F.concat(opened, "value", closed).alias("value")).write.partitionBy("object").text(path)
    return _shown(readers.load_predictions(spark, path, "lists", _PRED_FIELDS))


@query("resume_pending", "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, d):
    """Documents without a finished label."""
    todo = inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    done = inputs.table(spark, d, "labels").select(F.col("doc_id").alias("row_id"))
    return inc.resume_pending(todo, done)


@query("incremental_annotate", f"WITH {parsed()} SELECT {_ANN_COLUMNS} FROM ann")
def incremental_annotate(spark, d):
    """Two arrivals of response files, two runs over the same checkpoint, one result without repeats."""
    root = shared_dir(spark, "incremental")
    rows = inputs.with_raw_response(inputs.labelled_text(spark, d)).select("id", "text", "gold", "raw_response", "quality")
    for arrival in (0, 1):
        rows.filter(F.col("quality") == arrival).drop("quality").write.mode("append").parquet(f"{root}/in")
        inc.incremental_annotate(
            spark, f"{root}/in", "id bigint, text string, gold int, raw_response string", f"{root}/out", f"{root}/checkpoint", "jigsaw"
        )
    out = sinks.read_annotations(spark, f"{root}/out").withColumn("text_len", F.col("text_len").cast("long"))
    return out.withColumn("llm_rationale", F.coalesce("llm_rationale", F.lit("")))


def _two_arrivals(spark, d, root):
    """The first arrival has all rows; the second repeats the valid ones with other answers and brings a good answer to every second failed one."""
    rows = inputs.with_raw_response(inputs.labelled_text(spark, d)).select("id", "text", "gold", "raw_response")
    good = F.lit('{"label": "toxic", "confidence": "low"}')
    failed = inputs.annotations(spark, d).filter("NOT is_valid").select(F.col("row_id").alias("id"), F.lit(True).alias("failed"))
    second = rows.join(failed, "id", "left").filter("failed IS NULL OR id % 2 = 0").withColumn("raw_response", good).drop("failed")
    for arrival in (rows, second):
        arrival.write.mode("append").parquet(f"{root}/in")
        inc.incremental_annotate(spark, f"{root}/in", "id bigint, text string, gold int, raw_response string", f"{root}/out", f"{root}/checkpoint", "jigsaw")
    return sinks.read_annotations(spark, f"{root}/out")


@query(
    "incremental_repeats",
    f"""WITH {parsed()} SELECT row_id, CASE WHEN is_valid THEN raw_response WHEN row_id % 2 = 0 THEN '{{"label": "toxic", "confidence": "low"}}'
      ELSE raw_response END AS raw_response, is_valid OR row_id % 2 = 0 AS is_valid, (NOT is_valid)::BIGINT AS failures FROM ann""",
)
def incremental_repeats(spark, d):
    """An id that arrives again after a valid answer is left alone; one that failed takes the later answer. One row per id."""
    out = inc.latest_annotations(_two_arrivals(spark, d, shared_dir(spark, "repeats")))
    return out.select("row_id", "raw_response", "is_valid", "failures")


@query("resume_failed", f"WITH {parsed()} SELECT row_id AS id FROM ann WHERE NOT is_valid AND row_id % 2 <> 0")
def resume_failed(spark, d):
    """After both arrivals only the rows without a valid answer are offered again."""
    out = _two_arrivals(spark, d, shared_dir(spark, "resume"))
    todo = inputs.labelled_text(spark, d).select("id")
    return inc.resume_pending(todo, out, retry_failed=True)


@query("write_annotations", f"WITH {parsed()} SELECT is_valid, error_type, count(*) AS n, sum(row_id)::BIGINT AS ids FROM ann GROUP BY ALL")
def write_annotations(spark, d):
    path = shared_dir(spark, "annotations")
    sinks.write_annotations(inputs.annotations(spark, d, with_text=True), path)
    back = sinks.read_annotations(spark, path)
    return back.groupBy("is_valid", "error_type").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query(
    "failed_rows",
    f"""WITH {parsed()} SELECT row_id, substr(sha256(text), 1, 16) AS text_hash, length(text) AS text_len, error, raw_response AS raw_output
      FROM ann WHERE NOT is_valid""",
)
def failed_rows(spark, d):
    out = sinks.failed_rows(inputs.annotations(spark, d, with_text=True))
    return out.withColumn("text_len", F.col("text_len").cast("long"))


@query("write_sample_ids", f"WITH {_DOCS}, {_SAMPLE} SELECT id AS original_index, label FROM smp")
def write_sample_ids(spark, d):
    path = shared_dir(spark, "sample")
    docs = inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    sinks.write_sample_ids(sp.stratified_sample_n(docs, 250), path)
    return spark.read.schema("original_index bigint, label string").options(**readers.CSV_OPTIONS).csv(f"{path}/sample_ids.csv")


@query("write_metrics", f"WITH {qa._ANN_REP} SELECT dataset, num_samples, round(accuracy, 6) AS accuracy, round(cohen_kappa, 6) AS cohen_kappa, true AS combined FROM l_rep")
def write_metrics(spark, d):
    path = shared_dir(spark, "metrics")
    combined = sinks.write_metrics(qa._reports(spark, d), path)
    back = spark.read.json(f"{path}/combined" if combined else f"{path}/by_dataset")
    return back.select("dataset", "num_samples", r6("accuracy"), r6("cohen_kappa"), F.lit(combined).alias("combined"))


@query(
    "comprehensive_metrics",
    f"""WITH {parsed()}, ok AS (SELECT gold_label AS gold, llm_label AS pred, lang AS grp FROM ann WHERE is_valid AND llm_label >= 0),
      cells AS (SELECT gold, pred, count(*) AS n FROM ok GROUP BY ALL), gcells AS (SELECT grp, gold, pred, count(*) AS n FROM ok GROUP BY ALL),
      {bundle_rows('cells', 'gcells')} SELECT * FROM bundle""",
)
def comprehensive_metrics(spark, d):
    ann = inputs.annotations(spark, d, keep=("lang",)).filter("is_valid AND llm_label >= 0")
    out = ag.comprehensive_metrics(ann.withColumn("groups", F.array("lang")), "gold_label", "llm_label", groups="groups")
    return out.select("section", "group", "metric", r6("value"))
