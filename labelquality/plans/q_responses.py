"""Prompt columns, response parsing and validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import fixed, labels as lb, text as tx
from ..functions.responses import clean_response, extract_json
from ..operators import annotations as an
from ..operators.hard_cases import with_predictions
from . import inputs
from .oracle_parts import LABELLED, RAW, SUPERVISED, parsed
from .registry import query, r6


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SYSTEM = {
    why: "concat('Task: Classify whether text is toxic or non-toxic.', chr(10), chr(10), "
    "'Label must be one of: [\"toxic\", \"non-toxic\"]', " + _sql_text(rules) + ")"
    for why, rules in ((True, fixed.RULES_WITH_RATIONALE), (False, fixed.RULES_WITHOUT_RATIONALE))
}


@query(
    "prompt_text",
    f"""SELECT doc_id AS id, sha256(p) AS prompt_hash, length(p) AS prompt_len FROM (
      SELECT doc_id, concat({_SYSTEM[True]}, chr(10), chr(10), 'Now classify this text:', chr(10), 'Text: "', text, '"',
        chr(10), chr(10), 'Output (JSON only, no other text):') AS p FROM documents) q""",
)
def prompt_text(spark, d):
    docs = inputs.table(spark, d, "documents")
    p = docs.select(F.col("doc_id").alias("id"), lb.prompt_text(F.col("text"), "toxicity").alias("p"))
    return p.select("id", F.sha2("p", 256).alias("prompt_hash"), F.length("p").cast("long").alias("prompt_len"))


@query(
    "chat_messages",
    f"""SELECT doc_id AS id, i AS position, CASE i WHEN 0 THEN 'system' ELSE 'user' END AS role,
      sha256(CASE i WHEN 0 THEN {_SYSTEM[False]} ELSE 'Text: ' || text END) AS content_hash
      FROM documents, (SELECT unnest([0, 1]) AS i) k""",
)
def chat_messages(spark, d):
    docs = inputs.table(spark, d, "documents")
    m = docs.select(F.col("doc_id").alias("id"), F.posexplode(lb.chat_messages(F.col("text"), "toxicity")).alias("position", "m"))
    return m.select("id", "position", F.col("m.role").alias("role"), F.sha2("m.content", 256).alias("content_hash"))


@query(
    "chat_messages_turns",
    f"""SELECT conv_id, turn, sha256({_SYSTEM[True]}) AS system_hash, sha256('Text: ' || text) AS user_hash
      FROM conversations WHERE role = 'user'""",
)
def chat_messages_turns(spark, d):
    """Message pairs, with the rationale rules, for every user turn of the conversations."""
    turns = inputs.table(spark, d, "conversations").filter("role = 'user'")
    m = turns.select("conv_id", "turn", lb.chat_messages(F.col("text"), "toxicity", True).alias("m"))
    return m.select("conv_id", "turn", F.sha2(F.col("m")[0]["content"], 256).alias("system_hash"), F.sha2(F.col("m")[1]["content"], 256).alias("user_hash"))


@query(
    "head_tail_truncate",
    """SELECT doc_id AS id, sha256(t) AS truncated_hash, len(toks)::BIGINT AS tokens FROM (
      SELECT doc_id, toks, CASE WHEN len(toks) <= 512 THEN text
        ELSE array_to_string(list_concat(toks[1:256], toks[-256:]), ' ') END AS t
      FROM (SELECT doc_id, text, regexp_extract_all(text, '[^\\t\\n\\x0b\\x0c\\r\\x1c-\\x20\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+') AS toks
            FROM documents) a) b""",
)
def head_tail_truncate(spark, d):
    docs = inputs.table(spark, d, "documents")
    t = F.col("text")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.sha2(lb.head_tail_truncate(t), 256).alias("truncated_hash"),
        tx.word_count(t).cast("long").alias("tokens"),
    )


@query("raw_responses", f"WITH {RAW} SELECT id, gold, raw_text AS raw_response FROM raw")
def raw_responses(spark, d):
    return inputs.with_raw_response(inputs.labelled_text(spark, d)).select("id", "gold", "raw_response")


_CLEAN = {m: f"WITH {parsed(m)} SELECT id, r AS response FROM clean" for m in ("single", "batch")}


@query("clean_response", _CLEAN["single"])
def clean_response_single(spark, d):
    raw = inputs.with_raw_response(inputs.labelled_text(spark, d))
    return raw.select("id", clean_response(F.col("raw_response")).alias("response"))


@query("clean_response_batch", _CLEAN["batch"])
def clean_response_batch(spark, d):
    raw = inputs.with_raw_response(inputs.labelled_text(spark, d))
    return raw.select("id", clean_response(F.col("raw_response"), "batch").alias("response"))


@query("extract_json", f"WITH {parsed()} SELECT id, js AS json_text, how AS extract_error FROM found")
def extract_json_query(spark, d):
    raw = inputs.with_raw_response(inputs.labelled_text(spark, d))
    cleaned = raw.select("id", clean_response(F.col("raw_response")).alias("response"))
    return extract_json(cleaned, "response").drop("response")


@query(
    "validate_response",
    f"""WITH {parsed()} SELECT row_id AS id, is_valid, CASE WHEN is_valid THEN llm_label_str ELSE '' END AS label,
      llm_confidence AS confidence, error, error_type FROM ann""",
)
def validate_response_query(spark, d):
    raw = inputs.with_raw_response(inputs.labelled_text(spark, d)).select("id", "raw_response")
    return an.validated(raw, "toxicity").select("id", "is_valid", "label", "confidence", "error", "error_type")


_FORMS = (
    ('{"label": "non-toxic", "label": "toxic", "confidence": "high"}', "true, 'toxic', 'high', '', ''"),
    ('{"label": "toxic", "confidence": "low", "confidence": "sure"}', "false, '', 'low', 'Invalid confidence: sure', 'schema_violation'"),
    ('{"label": "toxic", "score": NaN, "confidence": "low"}', "true, 'toxic', 'low', '', ''"),
    ('{"confidence": "low", "label": "x", "score": -Infinity, "label": "Not Toxic", "confidence": "medium"}', "true, 'non-toxic', 'medium', '', ''"),
    ("{'label': 'toxic', 'confidence': 'low'}", "false, '', 'low', 'JSON parse error', 'parse_error'"),
    ('{"label": "toxic", "confidence": nan}', "false, '', 'low', 'JSON parse error', 'parse_error'"),
)


@query(
    "validate_response_repeated_keys",
    "SELECT doc_id AS id, x.* FROM documents, LATERAL (SELECT "
    + ", ".join(f"CASE doc_id % 6 {' '.join(f'WHEN {k} THEN f{k}.{c}' for k in range(6))} END AS {c}" for c in ("is_valid", "label", "confidence", "error", "error_type"))
    + " FROM " + ", ".join(f"(SELECT {want}) f{k}(is_valid, label, confidence, error, error_type)" for k, (_, want) in enumerate(_FORMS)) + ") x",
)
def validate_response_repeated_keys(spark, d):
    """What another common JSON grammar takes: repeated keys, NaN and infinities; and what neither takes."""
    form = F.element_at(F.array(*[F.lit(text) for text, _ in _FORMS]), (F.col("doc_id") % 6 + 1).cast("int"))
    raw = inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), form.alias("raw_response"))
    return an.validated(raw, "toxicity").select("id", "is_valid", "label", "confidence", "error", "error_type")


_ANN_COLUMNS = """row_id, substr(sha256(text), 1, 16) AS text_hash, length(text) AS text_len, gold_label, gold_label_str,
  llm_label, llm_label_str, llm_confidence, llm_confidence_numeric, '' AS llm_rationale, raw_response, is_valid, error, error_type"""


@query("parse_annotations", f"WITH {parsed()} SELECT {_ANN_COLUMNS} FROM ann")
def parse_annotations(spark, d):
    return _typed(inputs.annotations(spark, d, with_text=True))


@query("parse_annotations_batch", f"WITH {parsed('batch')} SELECT {_ANN_COLUMNS} FROM ann")
def parse_annotations_batch(spark, d):
    return _typed(inputs.annotations(spark, d, with_text=True, mode="batch"))


def _typed(df):
    return df.withColumn("text_len", F.col("text_len").cast("long"))


@query(
    "normalize_label",
    """SELECT id, CASE l WHEN 'nei' THEN 'not_enough_info' WHEN 'non_toxic' THEN 'non-toxic' WHEN 'nontoxic' THEN 'non-toxic'
        WHEN 'not_toxic' THEN 'non-toxic' ELSE l END AS label FROM (
      SELECT o_orderkey AS id, replace(lower(trim(v)), ' ', '_') AS l FROM (
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '  Not Toxic ' WHEN 'O' THEN 'NEI' ELSE ' ' || o_orderpriority || ' ' END AS v
        FROM orders) a) b""",
)
def normalize_label(spark, d):
    orders = inputs.table(spark, d, "orders")
    v = F.when(F.col("o_orderstatus") == "F", "  Not Toxic ").when(F.col("o_orderstatus") == "O", "NEI").otherwise(
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))
    )
    return orders.select(F.col("o_orderkey").alias("id"), lb.normalize_label(v).alias("label"))


@query(
    "display_label",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'NOT ENOUGH INFO' ELSE lower(o_orderpriority) END AS label
       FROM orders""",
)
def display_label(spark, d):
    orders = inputs.table(spark, d, "orders")
    name = F.when(F.col("o_orderstatus") == "O", "not_enough_info").otherwise(F.lower("o_orderpriority"))
    return orders.select(F.col("o_orderkey").alias("id"), lb.display_label(name).alias("label"))


@query(
    "label_names",
    """SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'refutes' WHEN 1 THEN 'NOT ENOUGH INFO' ELSE 'supports' END AS gold_name,
        CASE label % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE -1 END AS model_code FROM embeddings""",
)
def label_names(spark, d):
    vectors = inputs.table(spark, d, "embeddings")
    said = F.element_at(F.array(*[F.lit(x) for x in ("refutes", "not_enough_info", "supports", "unsure")]), F.col("label") % 4 + 1)
    return vectors.select(
        F.col("vec_id").alias("id"),
        lb.label_name(F.col("label") % 3, "fever").alias("gold_name"),
        lb.label_code(said, "fever").alias("model_code"),
    )


@query(
    "confidence_numeric",
    f"WITH {parsed()} SELECT row_id, llm_confidence, llm_confidence_numeric FROM ann WHERE is_valid",
)
def confidence_numeric(spark, d):
    ann = inputs.annotations(spark, d).filter("is_valid")
    return ann.select("row_id", "llm_confidence", lb.confidence_numeric(F.col("llm_confidence")).alias("llm_confidence_numeric"))


@query(
    "validation_pass_rate",
    f"""WITH {parsed()} SELECT count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid,
      round(avg(is_valid::INT), 6) AS pass_rate FROM ann""",
)
def validation_pass_rate(spark, d):
    return an.validation_pass_rate(inputs.annotations(spark, d)).select("total", "valid", r6("pass_rate"))


@query("error_breakdown", f"WITH {parsed()} SELECT is_valid, error_type, count(*) AS n FROM ann GROUP BY ALL")
def error_breakdown(spark, d):
    return an.error_breakdown(inputs.annotations(spark, d))


@query("error_breakdown_batch", f"WITH {parsed('batch')} SELECT is_valid, error_type, count(*) AS n FROM ann GROUP BY ALL")
def error_breakdown_batch(spark, d):
    return an.error_breakdown(inputs.annotations(spark, d, mode="batch"))


@query("text_hash", "SELECT doc_id AS id, substr(sha256(text), 1, 16) AS text_hash FROM documents")
def text_hash(spark, d):
    return inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.text_hash(F.col("text")).alias("text_hash"))


@query(
    "text_preview",
    """SELECT doc_id AS id, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 100) || '...' END AS text_preview FROM documents""",
)
def text_preview(spark, d):
    return inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), tx.text_preview(F.col("text")).alias("text_preview"))


@query(
    "dedup_by_hash",
    """SELECT substr(sha256(text), 1, 16) AS text_hash, sha256(text) AS sha256, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY text""",
)
def dedup_by_hash(spark, d):
    return an.dedup_by_hash(inputs.table(spark, d, "documents"), "doc_id")


@query(
    "select_rationale",
    f"""WITH {parsed()}, {SUPERVISED},
    m AS (SELECT a.row_id, a.llm_confidence_numeric, a.llm_label, a.gold_label, s.entropy,
       ('0x' || substr(md5('42:' || a.row_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
       FROM ann a LEFT JOIN sup s ON a.row_id = s.example_id),
    f AS (SELECT row_id,
       concat_ws('+', CASE WHEN llm_confidence_numeric < 0.6::DOUBLE THEN 'low_confidence' END,
         CASE WHEN llm_label >= 0 AND llm_label <> gold_label THEN 'disagreement' END,
         CASE WHEN entropy > 0.65 THEN 'baseline_uncertain' END, CASE WHEN u < 0.05 THEN 'audit' END) AS reasons FROM m)
    SELECT row_id, reasons FROM f WHERE reasons <> ''""",
)
def select_rationale(spark, d):
    both = with_predictions(inputs.annotations(spark, d), inputs.supervised(spark, d))
    chosen = an.select_rationale(both, entropy_threshold=0.65)
    return chosen.select("row_id", F.array_join("rationale_reasons", "+").alias("reasons"))


def _rule_model(texts: pd.Series) -> pd.Series:
    """A stand-in for a model: answers from two surface cues of the whole text."""
    toxic = texts.str.count("!") > 2
    sure = texts.str.len() % 3
    grade = sure.map({0: "low", 1: "medium", 2: "high"})
    name = toxic.map({True: "toxic", False: "non-toxic"})
    return '<json>{"label": "' + name + '", "confidence": "' + grade + '"}</json>'


@query(
    "annotate_with",
    f"""WITH {LABELLED}, a AS (SELECT id, gold, (length(text) - length(replace(text, '!', ''))) > 2 AS toxic, length(text) % 3 AS g FROM labelled)
    SELECT id AS row_id, gold AS gold_label, toxic::INT AS llm_label,
      CASE g WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS llm_confidence, true AS is_valid FROM a""",
)
def annotate_with(spark, d):
    base = inputs.labelled_text(spark, d).select("id", "text", "gold")
    answered = an.annotate_with(base, _rule_model)
    ann = an.parse_annotations(answered, "jigsaw", text_col=None)
    return ann.select("row_id", "gold_label", "llm_label", "llm_confidence", "is_valid")
