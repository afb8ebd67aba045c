"""Response parsing on hand-written answers: every extraction stage and every kind of fault."""

import pytest
from pyspark.sql import functions as F

from labelquality.functions import fixed, labels as lb
from labelquality.functions.responses import clean_response, extract_json, validate_response
from labelquality.operators import annotations as an

OK = '{"label": "toxic", "confidence": "high"}'
BAD, MISSING, REC = "parse_error", "schema_violation", "parse_error_recoverable"

# response, extracted text, extraction error
EXTRACTED = [
    (f"<json>{OK}</json>", OK, ""),
    (f"  <json> {OK} </json> trailing", OK, ""),
    (f"<json>{{}}</json> again <json>{OK}</json>", OK, ""),
    (f"</json> {OK} <json>", OK, REC),
    (f"<json></json>{OK}", OK, REC),
    (OK, OK, ""),
    (f"```json\n{OK}\n```", OK, REC),
    (f"```\n\n{OK}\n  \n```\nmore", OK, REC),
    (f"Here:\n```json\n{OK}", OK, REC),
    (f"Here ```json {OK} ```", OK, REC),
    ('```\n```\n{"a": 1}', '{"a": 1}', REC),
    ("```json\n{\n\"label\": 1\n}\n```", '{\n"label": 1\n}', REC),
    (f"Sure! {OK} bye", OK, REC),
    ('{"a": {"b": 1}}', '{"b": 1}}', REC),
    ('} { "x"', '} { "x"', BAD),
    ('{"a": 1} {', '{"a": 1}', REC),
    ("{}", "{}", BAD),
    ("x {}", "x {}", BAD),
    ("", "", BAD),
    ("no json here", "no json here", BAD),
]


def test_extract_json(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(EXTRACTED)], "i int, r string")
    got = extract_json(df, "r").orderBy("i").select("json_text", "extract_error").collect()
    assert [tuple(g) for g in got] == [(j, e) for _, j, e in EXTRACTED]


# JSON text, extraction error so far, valid, error type, label, rationale
VALIDATED = [
    (OK, "", True, "", "toxic", ""),
    (OK, REC, True, REC, "toxic", ""),
    ('{"label": " Not Toxic ", "confidence": "low", "rationale": ""}', "", True, "", "non-toxic", ""),
    ('{"label": "TOXIC", "confidence": "low", "rationale": "ten chars!"}', "", True, "", "toxic", "ten chars!"),
    ('{"label": "toxic", "confidence": "low", "rationale": "short"}', "", False, "content_violation", "", ""),
    ('{"label": "toxic", "confidence": "low", "rationale": null}', "", True, "", "toxic", ""),
    ('{"label": "toxic", "confidence": "low", "rationale": 0}', "", True, "", "toxic", ""),
    ('{"label": "toxic", "confidence": "low", "rationale": 5}', "", False, "unknown_error", "", ""),
    ('{"label": "toxic", "confidence": "low", "rationale": []}', "", True, "", "toxic", ""),
    ('{"label": "toxic", "confidence": "low", "rationale": [1, 2]}', "", False, "content_violation", "", ""),
    ('{"label": "toxic", "confidence": "low", "rationale": {"a": 1}}', "", False, "content_violation", "", ""),
    ('{"label": "bad", "confidence": "low", "rationale": "short"}', "", False, "content_violation", "", ""),
    ('{"label": "bad", "confidence": "low"}', "", False, MISSING, "", ""),
    ('{"label": "toxic", "confidence": "certain"}', "", False, MISSING, "", ""),
    ('{"label": "toxic", "confidence": "High"}', "", False, MISSING, "", ""),
    ('{"label": "toxic", "confidence": null}', "", False, MISSING, "", ""),
    ('{"label": "toxic", "confidence": 1}', "", False, MISSING, "", ""),
    ('{"label": "toxic"}', "", False, MISSING, "", ""),
    ('{"confidence": "low"}', REC, False, MISSING, "", ""),
    ('{"label": null, "confidence": "low"}', "", False, "unknown_error", "", ""),
    ('{"label": 1, "confidence": "low"}', "", False, "unknown_error", "", ""),
    ("{}", BAD, False, MISSING, "", ""),
    ("[1, 2]", "", False, MISSING, "", ""),
    ('["label", "confidence"]', "", False, "unknown_error", "", ""),
    ('"a string"', "", False, MISSING, "", ""),
    ('"label and confidence"', "", False, "unknown_error", "", ""),
    ("5", "", False, "unknown_error", "", ""),
    ("null", "", False, "unknown_error", "", ""),
    ("true", "", False, "unknown_error", "", ""),
    (OK + "}", "", False, BAD, "", ""),
    (OK + " tail", REC, False, REC, "", ""),
    (OK + "," + OK, "", False, BAD, "", ""),
    (OK + "],[" + OK, "", False, BAD, "", ""),
    ("", BAD, False, BAD, "", ""),
    ('{"label": "toxic", "conf', BAD, False, BAD, "", ""),
]


def test_validate_response(spark):
    df = spark.createDataFrame([(i, v[0], v[1]) for i, v in enumerate(VALIDATED)], "i int, json_text string, extract_error string")
    rows = validate_response(df, "toxicity").orderBy("i").collect()
    for row, (text, _, valid, kind, label, rationale) in zip(rows, VALIDATED):
        assert (row.is_valid, row.error_type, row.label, row.rationale) == (valid, kind, label, rationale), text
        assert row.confidence == ("low" if not valid else row.confidence)
        assert bool(row.error) != valid


def test_messages_name_the_fault(spark):
    texts = ['{"label": "x"}', '{"label": "x", "confidence": "sure"}', '{"label": "x", "confidence": "low"}']
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "i int, json_text string, extract_error string")
    got = [r.error for r in validate_response(df, "toxicity").orderBy("i").collect()]
    assert got == ["Missing required field: confidence", "Invalid confidence: sure", "Invalid label 'x'"]


def test_clean_response(spark):
    raw = " system x\nassistant\n" + OK + "\nmore "
    df = spark.createDataFrame([(raw,), ("plain\nsecond",), (None,)], "r string")
    single = [r[0] for r in df.select(clean_response(F.col("r"))).collect()]
    batch = [r[0] for r in df.select(clean_response(F.col("r"), "batch")).collect()]
    assert single == [OK + "\nmore", "plain\nsecond", None]
    assert batch == [OK, "plain", None]


def test_missing_response_is_invalid(spark):
    df = spark.createDataFrame([(1, 0, None)], "id int, gold int, raw_response string")
    row = an.parse_annotations(df, "jigsaw", text_col=None).first()
    assert (row.is_valid, row.error_type, row.llm_label) == (False, "parse_error", None)


def test_filters_do_not_multiply_the_parsing(spark):
    """A filter on a parsed column must sit above the parsing instead of repeating it."""
    df = spark.range(10).select("id", F.lit(0).alias("gold"), F.lit(OK).alias("raw_response"))
    out = an.parse_annotations(df, "jigsaw", text_col=None).filter("is_valid AND llm_label >= 0 AND llm_confidence = 'high'")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert out.count() == 10


def test_fever_labels(spark):
    rows = [(1, 2, '{"label": "NEI", "confidence": "medium"}'), (2, 0, '{"label": "Supports", "confidence": "high"}')]
    df = spark.createDataFrame(rows, "id int, gold int, raw_response string")
    got = {r.row_id: r for r in an.parse_annotations(df, "fever", text_col=None).collect()}
    assert (got[1].gold_label_str, got[1].llm_label, got[1].llm_label_str) == ("supports", 1, "NOT ENOUGH INFO")
    assert (got[2].gold_label_str, got[2].llm_label, got[2].llm_confidence_numeric) == ("refutes", 2, 0.9)


def test_summaries(spark):
    rows = [(True, ""), (True, "parse_error_recoverable"), (False, "parse_error"), (False, "parse_error")]
    df = spark.createDataFrame(rows, "is_valid boolean, error_type string")
    assert tuple(an.validation_pass_rate(df).first()) == (4, 2, 0.5)
    assert {(r.is_valid, r.error_type): r.n for r in an.error_breakdown(df).collect()}[(False, "parse_error")] == 2
    assert tuple(an.validation_pass_rate(df.filter("false")).first()) == (0, 0, 0.0)


def test_prompts(spark):
    prompt = spark.range(1).select(lb.prompt_text(F.lit("hi"), "sentiment")).first()[0]
    assert prompt.startswith("Task: Classify the sentiment of text as positive or negative.\n\nLabel must be one of: [\"positive\", \"negative\"]\nOutput format:")
    assert prompt.endswith('\n\nNow classify this text:\nText: "hi"\n\nOutput (JSON only, no other text):')
    for task in fixed.TASK_LABELS:
        assert "rationale" in lb.system_prompt(task, True) and "rationale" not in lb.system_prompt(task, False)
    with pytest.raises(ValueError):
        lb.system_prompt("other")
    messages = spark.range(1).select(lb.chat_messages(F.lit("hi"), "toxicity")).first()[0]
    assert [m.role for m in messages] == ["system", "user"] and messages[1].content == "Text: hi"


def test_head_tail_truncate(spark):
    text = " a b  c d e "
    got = spark.range(1).select(
        lb.head_tail_truncate(F.lit(text), 3), lb.head_tail_truncate(F.lit(text), 5), lb.head_tail_truncate(F.lit(text), 2, 0.0)
    ).first()
    assert tuple(got) == ("a d e", text, "d e")


def test_select_rationale_and_dedup(spark):
    rows = [(i, 1, 1, 0.9, 0.1) for i in range(2000)] + [(5000, 1, 0, 0.3, 0.9), (5001, -1, 0, 0.9, 0.1)]
    df = spark.createDataFrame(rows, "row_id int, llm_label int, gold_label int, llm_confidence_numeric double, entropy double")
    got = {r.row_id: r.rationale_reasons for r in an.select_rationale(df).collect()}
    assert got[5000][:3] == ["low_confidence", "disagreement", "baseline_uncertain"]
    audited = [i for i, why in got.items() if i < 2000]
    assert 60 <= len(audited) <= 140 and all(got[i] == ["audit"] for i in audited)
    texts = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id int, text string")
    assert {(r.id, r.copies) for r in an.dedup_by_hash(texts).collect()} == {(1, 2), (2, 1)}


@pytest.mark.parametrize("text, valid, label, error", [
    ('{"label": "x", "label": "toxic", "confidence": "low"}', True, "toxic", ""),
    ('{"label": "toxic", "confidence": "low", "rationale": "short", "rationale": "long enough now"}', True, "toxic", ""),
    ('{"label": "toxic", "confidence": "low", "n": NaN, "m": -Infinity}', True, "toxic", ""),
    ('{"label": "toxic", "label": 3, "confidence": "low"}', False, "", "Validation error: label is not a string"),
    ('{"confidence": "low", "confidence": "low"}', False, "", "Missing required field: label"),
    ('{"label": "toxic", "label": "toxic", "confidence": "low"} tail', False, "", "JSON parse error"),
    ('{"label": "toxic", "confidence": "low", }', False, "", "JSON parse error"),
    ('{"label": "toxic", "confidence": \'low\'}', False, "", "JSON parse error"),
    ('{"label": "toxic", "confidence": nan}', False, "", "JSON parse error"),
    ('NaN', False, "", "JSON parse error"),
])
def test_second_grammar(spark, text, valid, label, error):
    """Repeated keys and numbers that are none are read again; nothing else becomes valid by that."""
    from labelquality.functions.responses import validate_response

    df = spark.createDataFrame([(text, "")], "json_text string, extract_error string")
    row = validate_response(df, "toxicity").first()
    assert (row.is_valid, row.label, row.error) == (valid, label, error)
