"""Hard-case queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hard_cases as hc, text_features as tf
from . import inputs
from .oracle_parts import LABELLED, SUPERVISED, parsed
from .q_text import _BASE
from .registry import query, r6

_REASONS = """concat_ws('+', CASE WHEN llm_label >= 0 AND llm_label <> gold_label THEN 'disagreement' END,
   CASE WHEN llm_confidence_numeric < 0.6::DOUBLE THEN 'low_confidence' END)"""


@query(
    "hard_cases",
    f"""WITH {parsed()} SELECT row_id, gold_label, llm_label, llm_confidence, {_REASONS} AS reason,
      CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 100) || '...' END AS text_preview
      FROM ann WHERE is_valid AND {_REASONS} <> ''""",
)
def hard_cases(spark, d):
    """The text comes along with its annotation: nothing is joined."""
    hard = hc.hard_cases(inputs.annotations(spark, d, keep=("text",)))
    return hard.select("row_id", "gold_label", "llm_label", "llm_confidence", F.array_join("reason", "+").alias("reason"), "text_preview")


@query(
    "hard_case_rate",
    f"""WITH {parsed()} SELECT count(*) AS total, count(*) FILTER (WHERE {_REASONS} <> '') AS hard_cases,
      round(count(*) FILTER (WHERE {_REASONS} <> '')::DOUBLE / count(*), 6) AS hard_case_rate FROM ann WHERE is_valid""",
)
def hard_case_rate(spark, d):
    return hc.hard_case_rate(inputs.annotations(spark, d)).select("total", "hard_cases", r6("hard_case_rate"))


@query(
    "hard_by_agreement",
    f"""WITH {parsed()} SELECT row_id, coalesce((llm_label = gold_label)::INT, 0)::DOUBLE AS agreement_score,
      coalesce((llm_label = gold_label)::INT, 0) < 0.7 AS is_hard_case_agreement FROM ann""",
)
def hard_by_agreement(spark, d):
    out = hc.hard_by_agreement(inputs.annotations(spark, d))
    return out.select("row_id", "agreement_score", "is_hard_case_agreement")


@query(
    "hard_by_entropy",
    f"WITH {LABELLED}, {SUPERVISED} SELECT example_id, round(entropy, 6) AS entropy_score, entropy > 0.5 AS is_hard_case_entropy FROM sup",
)
def hard_by_entropy(spark, d):
    out = hc.hard_by_entropy(inputs.supervised(spark, d), threshold=0.5)
    return out.select("example_id", r6("entropy_score"), "is_hard_case_entropy")


_BOTH = f"""{parsed()}, {SUPERVISED}, two_models AS (
   SELECT a.*, s.predicted_label AS supervised_label, s.entropy, s.max_prob FROM ann a LEFT JOIN sup s ON s.example_id = a.row_id),
  scored AS (SELECT *, coalesce(llm_label <> supervised_label, false) AS differs, coalesce((llm_label = gold_label)::INT, 0) AS agree,
    0.4::DOUBLE * (1 - coalesce((llm_label = gold_label)::INT, 0)) + 0.3::DOUBLE * coalesce(entropy, 0)
      + 0.3::DOUBLE * coalesce(llm_label <> supervised_label, false)::INT AS difficulty FROM two_models)"""


@query(
    "hard_cases_joined",
    f"""WITH {parsed()} SELECT row_id, {_REASONS} AS reason, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 100) || '...' END AS text_preview
      FROM ann WHERE is_valid AND {_REASONS} <> ''""",
)
def hard_cases_joined(spark, d):
    """Texts in a table of their own."""
    texts = inputs.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    hard = hc.hard_cases(inputs.annotations(spark, d), texts)
    return hard.select("row_id", F.array_join("reason", "+").alias("reason"), "text_preview")


def _both(spark, d):
    """Annotations and predictions of the labelled documents, from the same rows."""
    return inputs.trust_inputs(spark, d).drop("text")


@query(
    "hard_by_disagreement",
    f"WITH {_BOTH} SELECT row_id, differs::INT AS model_disagreement, differs AS is_hard_case_disagreement FROM scored",
)
def hard_by_disagreement(spark, d):
    return hc.hard_by_disagreement(_both(spark, d)).select("row_id", "model_disagreement", "is_hard_case_disagreement")


@query(
    "difficulty_score",
    f"WITH {_BOTH} SELECT row_id, round(difficulty, 6) AS difficulty_score, difficulty > 0.5 AS is_hard_case_overall FROM scored",
)
def difficulty_score(spark, d):
    return hc.difficulty_score(_both(spark, d)).select("row_id", r6("difficulty_score"), "is_hard_case_overall")


_FEATURES = ["word_count", "negation_density", "hedge_density", "avg_sentence_length"]


@query(
    "hard_case_patterns",
    f"""WITH {_BOTH}, {_BASE} SELECT difficulty > 0.5 AS is_hard, count(*) AS cases,
      round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS ratio,
      {', '.join(f"count(*) FILTER (WHERE llm_confidence = '{g}') AS {g}_confidence" for g in ('low', 'medium', 'high'))},
      {', '.join(f'round(avg(f.{c}), 6) AS mean_{c}' for c in _FEATURES)}
      FROM scored s JOIN full_feat f ON f.id = s.row_id GROUP BY 1""",
)
def hard_case_patterns(spark, d):
    """The text is joined once: annotations, predictions and features come from the same labelled rows."""
    base = tf.text_features(inputs.trust_inputs(spark, d), keep=inputs.TRUST_INPUT_COLUMNS)
    out = hc.hard_case_patterns(hc.difficulty_score(base), _FEATURES)
    grades = [f"{g}_confidence" for g in ("low", "medium", "high")]
    return out.select("is_hard", "cases", r6("ratio"), *grades, *[r6(f"mean_{c}") for c in _FEATURES])


@query(
    "error_pairs",
    f"""WITH {parsed()} SELECT gold_label, llm_label, count(*) AS n FROM ann WHERE is_valid AND llm_label >= 0 AND llm_label <> gold_label
      GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10""",
)
def error_pairs(spark, d):
    return hc.error_pairs(inputs.annotations(spark, d))
