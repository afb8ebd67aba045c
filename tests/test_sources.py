"""Readers, sinks, incremental runs."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from labelquality.functions import fixed
from labelquality.operators import annotations as an
from labelquality.plans import q_sources
from labelquality.sources import readers, segments, sinks
from labelquality.sources.shared import shared_dir
from labelquality.streaming import incremental as inc

AWKWARD = ['say "hi"', "two\nlines", " blanks ", "comma, and 'quotes'", "back\\slash", "tab\tand\r\nreturn", "ünï", '"']


def test_csv_round_trip(spark):
    root = shared_dir(spark, "csv")
    rows = spark.createDataFrame([(t, i % 2) for i, t in enumerate(AWKWARD)], "text string, label int")
    assert readers.read_csv_splits(spark, root) is None
    for s in readers.SPLITS:
        sinks.write_csv(rows, f"{root}/imdb/{s}.csv")
    back = readers.load_dataset(spark, "imdb", root)
    assert dict(back.dtypes) == {"text": "string", "label": "int", "split": "string"}
    for s in readers.SPLITS:
        part = back.filter(F.col("split") == s).drop("split")
        assert sorted(map(tuple, part.collect())) == sorted(map(tuple, rows.collect()))


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of a thousand bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_csv_split_inside_texts(spark, small_blocks):
    """One file, many tasks, the rows of the one-task read; a text lies across several blocks."""
    root = shared_dir(spark, "csv")
    texts = AWKWARD + ["", None, "\n", "\n\n x \n", 'a "\n" b', "long\n" * 300, "\ue000 \ue001\r\ue000\ue002", "end"]
    rows = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts * 3)], "id int, text string, label int").coalesce(1)
    for s in readers.SPLITS:
        sinks.write_csv(rows, f"{root}/{s}.csv")
    blocks = segments.segments(spark, f"{root}/train.csv", "\n").select("file", "block").distinct().collect()
    assert len(blocks) > 3 and len({b.file for b in blocks}) == 1
    plain = readers.read_csv_splits(spark, root, {"id": "int"})
    split = readers.read_csv_splits(spark, root, {"id": "int"}, multi_line="split")
    assert split.schema == plain.schema and sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert plain.count() == 9 * len(texts)


def test_csv_records_of_unquoted_and_blank_lines(spark, tmp_path, small_blocks):
    (tmp_path / "x.csv").write_bytes(b'id,text\r\n1,plain\r\n\r\n\n2,"a\r\nb"\r\n3,last')
    got = segments.csv_records(spark, f"{tmp_path}/x.csv").orderBy("record").collect()
    assert [(r.record, r.value) for r in got] == [(0, "id,text"), (1, "1,plain"), (2, '2,"a\r\nb"'), (3, "3,last")]
    (tmp_path / "empty.csv").write_bytes(b"")
    assert segments.csv_records(spark, f"{tmp_path}/empty.csv").collect() == []


@pytest.mark.parametrize("indent", [None, 2])
def test_predictions_of_any_size(spark, tmp_path, indent, small_blocks):
    """Elements are read by many tasks; commas, brackets and quotes inside texts separate nothing."""
    data = {
        "example_id": list(range(6)), "text": ['a, b "q" [x] {y', "back\\ slash\\\"", "new\nline, , ]", "", "é," * 400, None],
        "logits": [[0.1, 0.2], [1.0], [], [4.5], [1e-3, -2.0], None], "correct": [True, False, None, True, True, False], "other": ['x,"', None, "]", "}", ",", "\\"],
    }
    (tmp_path / "p.json").write_text(json.dumps(data, indent=indent))
    assert segments.segments(spark, str(tmp_path), ",").select("block").distinct().count() > 1
    fields = ["example_id", "text", "logits", "correct"]
    rows = readers.load_predictions(spark, str(tmp_path), "lists", [*fields, "entropy"]).orderBy("example_id").collect()
    assert [tuple(r) for r in rows] == [(*x, None) for x in zip(*(data[f] for f in fields))]


def test_predictions_in_empty_lists(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"example_id": [ ], "text": []}')
    assert readers.load_predictions(spark, str(tmp_path), "lists", ["example_id", "text"]).collect() == []


def test_csv_needs_its_columns(spark):
    root = shared_dir(spark, "csv")
    for s in readers.SPLITS:
        sinks.write_csv(spark.createDataFrame([("a", 1)], "review string, label int"), f"{root}/{s}.csv")
    assert readers.read_csv_splits(spark, root) is None


def test_jsonl_claims(spark, tmp_path):
    lines = [{"claim": "a", "label": "SUPPORTS"}, {"claim": "b", "label": "OTHER"}, {"claim": "c"}, {"label": "REFUTES"}, {"claim": "d", "label": "NOT ENOUGH INFO"}]
    folder = tmp_path / "fever"
    folder.mkdir()
    for name in ("train", "paper_dev", "paper_test"):
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    back = readers.load_dataset(spark, "fever", str(tmp_path)).filter("split = 'dev'")
    assert sorted((r.text, r.label) for r in back.collect()) == [("", 0), ("a", 2), ("d", 1)]


def test_unknown_or_missing_dataset(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.load_dataset(spark, "other", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        readers.load_dataset(spark, "imdb", str(tmp_path))


def test_label_rules(spark):
    def label(schema, row):
        return readers.normalize_label_source(spark.createDataFrame([row], schema)).first().label

    assert label("text string, label int, toxic int", ("t", 3, 1)) == 3
    assert label("text string, toxic double, insult int", ("t", 0.0, 1)) == 0
    assert label("text string, obscene int, insult int", ("t", 0, 1)) == 1
    assert label("text string, target double", ("t", 0.5)) == 1
    assert label("text string, target double", ("t", 0.49)) == 0
    with pytest.raises(ValueError):
        label("text string, other int", ("t", 1))


def test_text_column_rules(spark):
    def pick(schema):
        return readers.pick_text_column(spark.createDataFrame([], schema))

    assert pick("a string, comment string, comment_text string") == "comment_text"
    assert pick("a int, b string, c string") == "b" and pick("a int, b int") == "a"
    crisis = spark.createDataFrame([], "id int, comment string, tweet_text string")
    assert readers.pick_text_column(crisis, fixed.CRISIS_TEXT_COLUMNS) == "tweet_text"


@pytest.mark.parametrize("labels, kind", [
    (["1", "0", None], "int"), (["1.0", "0"], "double"), (["informative", "1"], "string"), (["1234567890", "-1"], "bigint"),
    (["9007199254740993000001", "1"], "decimal(38,0)"), (["0.1234567890123456789", "1"], "string"),
])
def test_csv_labels_keep_their_values(spark, labels, kind):
    root = shared_dir(spark, "csv")
    for s in readers.SPLITS:
        sinks.write_csv(spark.createDataFrame([("t", x) for x in labels], "text string, label string"), f"{root}/{s}.csv")
    back = readers.read_csv_splits(spark, root)
    assert dict(back.dtypes)["label"] == kind and back.filter("label IS NOT NULL").count() == 3 * sum(x is not None for x in labels)


def test_broken_claim_lines_are_an_error(spark, tmp_path):
    for name in ("train", "paper_dev", "paper_test"):
        (tmp_path / f"{name}.jsonl").write_text('{"claim": "a", "label": "SUPPORTS"}\n{"claim": "b", "lab\n')
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_jsonl_claims(spark, str(tmp_path)).collect()
    assert readers.read_jsonl_claims(spark, str(tmp_path), mode="DROPMALFORMED").count() == 3


def test_predictions_one_object_per_line(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"example_id": [1, 2]}\n{"example_id": [3, 4]}\n')
    rows = readers.load_predictions(spark, str(tmp_path), "columns", ["example_id"]).collect()
    assert sorted(r[0] for r in rows) == [1, 2, 3, 4]


def test_jigsaw_prefers_the_sample(spark):
    root = shared_dir(spark, "data")
    rows = spark.createDataFrame([(i, f"t{i}", i % 2) for i in range(1000)], "id long, text string, label int")
    sinks.write_csv(rows, f"{root}/jigsaw/sample.csv")
    for s in readers.SPLITS:
        sinks.write_csv(rows.limit(3), f"{root}/jigsaw/{s}.csv")
    got = {r.split: r["count"] for r in readers.load_dataset(spark, "jigsaw", root).groupBy("split").count().collect()}
    assert got == {"train": 5, "dev": 5, "test": 990}


def test_crisis_labels(spark):
    df = spark.createDataFrame([(2, "x", "flood"), (1, "y", "fire"), (3, "z", "flood")], "id int, tweet_text string, class_label string")
    got = {r.id: (r.text, r.label) for r in readers.normalize_crisis_source(df, "id", ["id"]).collect()}
    assert got == {1: ("y", 0), 2: ("x", 1), 3: ("z", 1)}
    with pytest.raises(ValueError):
        readers.normalize_crisis_source(df.drop("class_label"), "id")


def test_registry(spark):
    got = {r.dataset: r for r in readers.dataset_registry(spark).collect()}
    assert len(got) == 5 and got["fever"].train is None and got["imdb"].test == 0.15 and len(got["crisisbench_humanitarian"].classes) == 11


def test_predictions_as_one_object_of_lists(spark, tmp_path):
    data = {"example_id": [0, 1], "gold_label": [1, 0], "probabilities": [[0.2, 0.8], [0.5, 0.5]], "correct": [True, True]}
    (tmp_path / "p.json").write_text(json.dumps(data, indent=2))
    rows = readers.load_predictions(spark, str(tmp_path / "p.json"), "columns", list(data), multi_line=True).orderBy("example_id").collect()
    assert [tuple(r) for r in rows] == [(0, 1, [0.2, 0.8], True), (1, 0, [0.5, 0.5], True)]


def _responses(spark, ids):
    ok = '{"label": "toxic", "confidence": "high"}'
    return spark.createDataFrame([(i, "t", 1, ok if i % 3 else "broken") for i in ids], "id bigint, text string, gold int, raw_response string")


def test_incremental_runs_do_each_row_once(spark):
    root = shared_dir(spark, "inc")
    run = lambda: inc.incremental_annotate(spark, f"{root}/in", "id bigint, text string, gold int, raw_response string", f"{root}/out", f"{root}/cp", "jigsaw", files_per_batch=1)
    _responses(spark, range(10)).repartition(3).write.parquet(f"{root}/in")
    run()
    assert sinks.read_annotations(spark, f"{root}/out").count() == 10
    run()  # nothing new
    _responses(spark, range(10, 15)).write.mode("append").parquet(f"{root}/in")
    run()
    out = sinks.read_annotations(spark, f"{root}/out")
    assert sorted(r.row_id for r in out.select("row_id").collect()) == list(range(15))
    assert out.filter("NOT is_valid").count() == 5
    pending = inc.resume_pending(_responses(spark, range(20)), out)
    assert sorted(r.id for r in pending.collect()) == list(range(15, 20))


def test_ids_that_arrive_again(spark):
    """A valid answer is written once, in this batch or later ones; failed rows are offered again until one is valid."""
    root = shared_dir(spark, "inc")
    schema = "id bigint, text string, gold int, raw_response string"
    ok = '{"label": "%s", "confidence": "high"}'
    todo = spark.range(6)

    def arrive(*rows):
        spark.createDataFrame([(i, "t", 1, r) for i, r in rows], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        inc.incremental_annotate(spark, f"{root}/in", schema, f"{root}/out", f"{root}/cp", "jigsaw")
        out = sinks.read_annotations(spark, f"{root}/out")
        return {r.row_id: (r.is_valid, r.llm_label, r.failures) for r in inc.latest_annotations(out).collect()}, out

    first, out = arrive((0, ok % "toxic"), (0, ok % "toxic"), (1, "broken"), (1, "broken"), (2, "broken"), (3, ok % "non-toxic"))
    assert first == {0: (True, 1, 0), 1: (False, None, 1), 2: (False, None, 1), 3: (True, 0, 0)} and out.count() == 4
    assert sorted(r.id for r in inc.resume_pending(todo, out, retry_failed=True).collect()) == [1, 2, 4, 5]
    assert sorted(r.id for r in inc.resume_pending(todo, out).collect()) == [4, 5]
    second, out = arrive((0, ok % "non-toxic"), (1, ok % "toxic"), (2, "worse"), (3, "broken"), (4, ok % "toxic"))
    assert second == {0: (True, 1, 0), 1: (True, 1, 1), 2: (False, None, 2), 3: (True, 0, 1), 4: (True, 1, 0)}
    assert sorted(r.id for r in inc.resume_pending(todo, out, retry_failed=True).collect()) == [2, 5]
    assert sorted(r.id for r in inc.resume_pending(todo, out, retry_failed=True, max_failures=2).collect()) == [5]


def test_written_annotations(spark):
    path = shared_dir(spark, "ann")
    ann = an.parse_annotations(_responses(spark, range(6)), "jigsaw")
    sinks.write_annotations(ann, path)
    back = sinks.read_annotations(spark, path)
    assert sorted(r.row_id for r in sinks.valid_rows(back).collect()) == [1, 2, 4, 5]
    failed = sinks.failed_rows(back)
    assert failed.columns == ["row_id", "text_hash", "text_len", "error", "raw_output"] and failed.count() == 2


def test_metrics_files(spark):
    path = shared_dir(spark, "metrics")
    reports = spark.createDataFrame([("a", 0.5), ("b", 0.75)], "dataset string, accuracy double")
    assert sinks.write_metrics(reports, path)
    assert {r.dataset: r.accuracy for r in spark.read.json(f"{path}/combined").collect()} == {"a": 0.5, "b": 0.75}
    assert not sinks.write_metrics(reports.limit(1), shared_dir(spark, "metrics"))


def test_model_batches(spark):
    df = spark.createDataFrame([(1, "bad"), (2, "fine")], "id int, text string")
    out = an.annotate_with(df, lambda texts: texts.str.upper())
    assert out.columns == ["id", "text", "raw_response"] and {r.raw_response for r in out.collect()} == {"BAD", "FINE"}
    assert df.columns == ["id", "text"]


def test_entry_without_a_named_folder(tmp_path):
    """A local session that names no folder: queries run, and those that store take one of their own."""
    code = """
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
queries = entry.queries()
print(queries["confusion_matrix"](spark, "/root/testdata/sf0.001").count(), queries["read_csv_long_labels"](spark, "/root/testdata/sf0.001").count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split()[-1] == "200"


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_broken_lines_are_kept_apart(spark, tmp_path, small_blocks):
    """Each line lands on one side, with its number; blank lines on none."""
    good = [json.dumps({"claim": f"c{i} " + "x" * 200, "label": "SUPPORTS"}) for i in range(20)]
    lines = [*good[:3], '{"claim": "cut', "", *good[3:10], "plain text", '["list"]', "  \t", *good[10:], '{"claim": 1} {"claim": 2'] 
    for name in ("train", "paper_dev", "paper_test"):
        (tmp_path / f"{name}.jsonl").write_bytes("\r\n".join(lines).encode())
    assert segments.segments(spark, f"{tmp_path}/train.jsonl", "\n").select("block").distinct().count() > 2
    rows, errors = readers.read_jsonl_claims_kept(spark, str(tmp_path))
    assert rows.filter("split = 'dev'").count() == 20 and rows.columns == ["text", "label", "split"]
    got = sorted((r.line, r.value) for r in errors.filter("split = 'dev'").collect())
    assert [g for g in got if g[0] != len(lines)] == [(k, lines[k - 1]) for k in (4, 13, 14)]
    assert readers.read_jsonl_claims_kept(spark, f"{tmp_path}/none") is None


def _written(spark, monkeypatch, tmp_path):
    """Where queries of q_sources put their files, by name."""
    monkeypatch.setattr(q_sources, "shared_dir", lambda spark, name: str(tmp_path / name))
    return lambda pattern: sorted(str(f) for f in tmp_path.glob(pattern) if f.stat().st_size)


def test_large_splits_are_several_files(spark, small, monkeypatch, tmp_path):
    """No task writes a file of more than about FILE_BYTES, and the rows are those of one file."""
    files = _written(spark, monkeypatch, tmp_path)
    want = sorted(map(tuple, q_sources.read_csv_splits_parallel(spark, small).collect()))
    assert len(files("csv/train.csv/*.csv")) == 1
    monkeypatch.setattr(q_sources, "FILE_BYTES", 20_000, raising=False)
    got = sorted(map(tuple, q_sources.read_csv_splits_parallel(spark, small).collect()))
    assert len(files("csv/train.csv/*.csv")) > 1 and got == want


def test_many_predictions_are_several_objects(spark, small, monkeypatch, tmp_path):
    """No task writes an object of more than about OBJECT_ROWS predictions, and no shuffle deals elements by list."""
    files, plans = _written(spark, monkeypatch, tmp_path), []
    want = sorted(map(tuple, q_sources.load_predictions_columns(spark, small).collect()))
    monkeypatch.setattr(q_sources, "OBJECT_ROWS", len(want) // 4, raising=False)
    found = q_sources.load_predictions_lists(spark, small)
    assert sorted(map(tuple, found.collect())) == want and len(files("predictions-lists/*/*.txt")) > 2
    elements = segments.list_elements(spark, str(tmp_path / "predictions-lists"))
    plans.append(elements._jdf.queryExecution().sparkPlan().toString())
    assert "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]
