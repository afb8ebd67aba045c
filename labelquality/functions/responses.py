"""From a raw model response to typed answer columns, as stages of SQL expressions.

Each stage adds a few columns that later stages refer to by name and that are computed once per row (see
``scalar.stage``); the whole chain is narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from .scalar import sql_lookup, sql_strip, sql_text, stage, strip

# Closes the array a response is wrapped in before parsing; see ``parsed_json``.
_END_MARK = "#end-of-response#"

_BLANK = fixed.WHITESPACE_RANGES.replace(r"\t-\r", r"\t\x0b-\r")  # white space but the line feed
_FENCED_LINES = rf"(?:\A|\n)[{_BLANK}]*```[^\n]*((?:\n(?![{_BLANK}]*```)[^\n]*)*+)"
_BLANK_LINE = rf"\n[{_BLANK}]*(?=\n|\z)"


def clean_response(raw: Column, mode: str = "single") -> Column:
    """Text after the last "assistant"; in batch mode only its first line."""
    if mode not in ("single", "batch"):
        raise ValueError(f"Unknown mode: {mode}")
    answer = strip(F.substring_index(raw, "assistant", -1))
    if mode == "batch":
        answer = strip(F.split_part(answer, F.lit("\n"), F.lit(1)))
    return answer


def extract_json(df: DataFrame, response: str, json: str = "json_text", error: str = "extract_error") -> DataFrame:
    """Add the JSON text found in ``response`` and how it was found.

    Tried in order: the last tagged block; the non-blank lines of the first code fence, which replace the
    response; the slice from the last opening to the last closing brace; the slice from the first opening
    brace; the response as it is. The order and its side effects are observable in ``error``.
    """
    tail = "substring_index(_r, '<json>', -1)"
    inside = sql_strip(f"regexp_extract({tail}, r'(?s)^(.*)</json>', 1)")
    # Every kept line still starts with its line feed; the first one is cut off.
    body = f"substring(regexp_replace(regexp_extract(_r, r'{_FENCED_LINES}', 1), r'{_BLANK_LINE}', ''), 2)"
    staged = stage(df, _r=sql_strip(f"`{response}`"))
    staged = stage(
        staged,
        _tagged=f"CASE WHEN contains(_r, '<json>') AND contains({tail}, '</json>') THEN {inside} ELSE '' END",
        _body=f"CASE WHEN contains(_r, '```json') OR startswith(_r, '```') THEN {body} ELSE '' END",
    )
    staged = stage(staged, _rest="CASE WHEN _body <> '' THEN _body ELSE _r END")
    staged = stage(
        staged,
        _last=r"regexp_extract(regexp_extract(_rest, r'(?s)\{[^{]*$', 0), r'(?s)^.*\}', 0)",
        _wide=r"regexp_extract(_rest, r'(?s)\{.*\}', 0)",
    )
    how = """CASE
        WHEN _tagged <> '' THEN ''
        WHEN _last NOT IN ('', '{}') AND _body = '' AND length(_last) = length(_rest) THEN ''
        WHEN _last NOT IN ('', '{}') OR _wide NOT IN ('', '{}') THEN 'parse_error_recoverable'
        ELSE 'parse_error' END"""
    found = """CASE
        WHEN _tagged <> '' THEN _tagged
        WHEN _last NOT IN ('', '{}') THEN _last
        WHEN _wide NOT IN ('', '{}') THEN _wide
        ELSE _rest END"""
    return stage(staged, **{json: found, error: how}).drop("_r", "_tagged", "_body", "_rest", "_last", "_wide")


def parsed_json(json: str) -> str:
    """SQL for a strictly parsed VARIANT array ``[value, end mark]``.

    Spark's JSON functions ignore anything after the first complete value. Wrapping the text in an array
    that ends in a known mark shows whether the whole text was consumed as exactly one value.
    """
    return f"""try_parse_json(concat('[', {json}, ', "{_END_MARK}"]'))"""


def lenient_json(json: str) -> str:
    """SQL for ``[object, end mark]`` by the second grammar: a key may repeat, and the last one counts; NaN and infinities are numbers.

    Both are what some JSON parsers take although VARIANT does not. Only objects are read this way, and only the fields an answer
    can have; inside the value of a field keys may not repeat.
    """
    options = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'true')"
    fields = "array<struct<label: variant, confidence: variant, rationale: variant, `end`: string>>"
    return f"""from_json(concat('[', {json}, ', {{"end": "{_END_MARK}"}}]'), '{fields}', {options})"""


# What can be wrong with a response, in the order it is looked for: condition, error type, message. The
# message of the first entry stands for the parser's own; its type is the one found while extracting.
_OBJECT = "'Validation error: response is not an object'"


def _faults(task: str, error: str) -> list[tuple[str, str, str]]:
    grades = ", ".join(sql_text(g) for g in fixed.CONFIDENCE_VALUES)
    names = ", ".join(sql_text(n) for n in fixed.TASK_LABELS[task])
    return [
        ("NOT _is_json", f"coalesce(nullif(`{error}`, ''), 'parse_error')", "'JSON parse error'"),
        ("_has_label IS NULL", "'unknown_error'", _OBJECT),
        ("NOT _has_label", "'schema_violation'", "'Missing required field: label'"),
        ("NOT _has_confidence", "'schema_violation'", "'Missing required field: confidence'"),
        ("_kind <> 'OBJECT'", "'unknown_error'", _OBJECT),
        ("_name IS NULL", "'unknown_error'", "'Validation error: label is not a string'"),
        (f"coalesce(_grade NOT IN ({grades}), true)", "'schema_violation'", "concat('Invalid confidence: ', coalesce(_grade, to_json(_conf)))"),
        ("_why_kind = 'SCALAR' AND NOT _why_zero", "'unknown_error'", "'Validation error: rationale has no length'"),
        (f"_size > 0 AND _size < {fixed.MIN_RATIONALE}", "'content_violation'", f"'Rationale too short (min {fixed.MIN_RATIONALE} chars)'"),
        (f"_name NOT IN ({names})", "'schema_violation'", "concat('Invalid label ''', _name, '''')"),
    ]


def validate_response(df: DataFrame, task: str, json: str = "json_text", error: str = "extract_error") -> DataFrame:
    """Add label, confidence, rationale, is_valid, error, error_type for the JSON text in column ``json``."""
    if task not in fixed.TASK_LABELS:
        raise ValueError(f"Unsupported task: {task}")

    def text_of(v: str) -> str:
        return f"CASE WHEN {v}_type = 'STRING' THEN try_variant_get({v}, '$', 'string') END"

    def kind_of(v: str) -> str:
        return f"""CASE WHEN {v}_type IS NULL THEN 'ABSENT' WHEN {v}_type IN ('VOID', 'STRING') THEN {v}_type
            WHEN startswith({v}_type, 'OBJECT') THEN 'OBJECT' WHEN startswith({v}_type, 'ARRAY') THEN 'ARRAY' ELSE 'SCALAR' END"""

    # A top-level string or array "has" a field when it contains the field's name; a scalar can have none.
    def has(field: str, v: str) -> str:
        return f"""CASE _kind WHEN 'OBJECT' THEN {v} IS NOT NULL
            WHEN 'STRING' THEN contains(try_variant_get(_top, '$', 'string'), '{field}')
            WHEN 'ARRAY' THEN coalesce(array_contains(try_variant_get(_top, '$', 'array<string>'), '{field}'), false) END"""

    plain = f"replace(lower({sql_strip('x')}), ' ', '_')"
    name = f"transform(array({text_of('_label')}), x -> {plain})[0]"
    staged = stage(df, _v=parsed_json(f"`{json}`"))
    staged = stage(
        staged,
        _top="try_variant_get(_v, '$[0]', 'variant')",
        _label="try_variant_get(_v, '$[0].label', 'variant')",
        _conf="try_variant_get(_v, '$[0].confidence', 'variant')",
        _why="try_variant_get(_v, '$[0].rationale', 'variant')",
        _is_json=f"""coalesce(try_variant_get(_v, '$[1]', 'string') = '{_END_MARK}', false)
            AND try_variant_get(_v, '$[2]', 'variant') IS NULL""",
    )
    again = f"CASE WHEN NOT _is_json AND contains(`{json}`, '{{') THEN {lenient_json(f'`{json}`')} END"
    staged = stage(staged, _again=again)
    staged = stage(staged, _second=f"NOT _is_json AND coalesce(size(_again) = 2 AND _again[0] IS NOT NULL AND _again[1].`end` = '{_END_MARK}' AND _again[0].`end` IS NULL, false)")
    fields = {"_label": "label", "_conf": "confidence", "_why": "rationale"}
    kept = [f"`{c}`" for c in staged.columns if c not in (*fields, "_is_json", "_again")]
    staged = staged.selectExpr(*kept, "_is_json OR _second AS _is_json", *[f"CASE WHEN _second THEN _again[0].{f} ELSE {v} END AS {v}" for v, f in fields.items()])
    staged = stage(staged, **{f"{v}_type": f"schema_of_variant({v})" for v in ("_top", "_label", "_conf", "_why")})
    staged = stage(
        staged,
        _kind=f"CASE WHEN _second THEN 'OBJECT' ELSE {kind_of('_top')} END",
        _why_kind=kind_of("_why"),
        _plain=name,
        _grade=text_of("_conf"),
        _reason=f"CASE WHEN _why IS NOT NULL THEN coalesce({text_of('_why')}, to_json(_why)) END",
        _why_zero="_why IS NOT NULL AND coalesce(try_variant_get(_why, '$', 'double') = 0, false)",
    )
    staged = stage(
        staged,
        _name=sql_lookup(fixed.LABEL_ALIASES, "_plain", "_plain"),
        _has_label=has("label", "_label"),
        _has_confidence=has("confidence", "_conf"),
        _size="""CASE _why_kind WHEN 'STRING' THEN length(_reason)
            WHEN 'ARRAY' THEN size(try_variant_get(_why, '$', 'array<variant>'))
            WHEN 'OBJECT' THEN size(json_object_keys(_reason)) END""",
    )
    faults = _faults(task, error)
    staged = stage(staged, _fault="CASE " + " ".join(f"WHEN {c} THEN {i}" for i, (c, _, _) in enumerate(faults)) + " END")
    kind = "CASE _fault " + " ".join(f"WHEN {i} THEN {k}" for i, (_, k, _) in enumerate(faults)) + f" ELSE `{error}` END"
    message = "CASE _fault " + " ".join(f"WHEN {i} THEN {m}" for i, (_, _, m) in enumerate(faults)) + " ELSE '' END"
    return staged.selectExpr(
        *[f"`{c}`" for c in df.columns],
        "_fault IS NULL AS is_valid",
        "CASE WHEN _fault IS NULL THEN _name ELSE '' END AS label",
        "CASE WHEN _fault IS NULL THEN _grade ELSE 'low' END AS confidence",
        "CASE WHEN _fault IS NULL AND _size > 0 THEN _reason ELSE '' END AS rationale",
        f"{message} AS error",
        f"{kind} AS error_type",
    )
