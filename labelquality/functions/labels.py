"""Label and prompt expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .scalar import let, lookup, strip


def normalize_label(label: Column) -> Column:
    """Strip, lower-case, blanks to underscores, then resolve the known aliases."""
    plain = F.replace(F.lower(strip(label)), F.lit(" "), F.lit("_"))
    return let(plain, lambda name: F.coalesce(lookup(fixed.LABEL_ALIASES, name), name))


def display_label(label: Column) -> Column:
    return F.coalesce(lookup(fixed.DISPLAY_LABELS, label), label)


def label_name(code: Column, dataset: str) -> Column:
    return lookup(fixed.LABEL_NAMES[dataset], code)


def label_code(name: Column, dataset: str) -> Column:
    """Integer code of a model label, -1 if the label is not one of the data set's."""
    return F.coalesce(lookup(fixed.LABEL_CODES[dataset], name), F.lit(-1))


def confidence_numeric(confidence: Column) -> Column:
    return lookup(fixed.CONFIDENCE_VALUES, confidence)


def system_prompt(task: str, with_rationale: bool = False) -> str:
    if task not in fixed.TASK_INSTRUCTIONS:
        raise ValueError(f"Unsupported task: {task}")
    choices = ", ".join(f'"{name}"' for name in fixed.TASK_LABELS[task])
    rules = fixed.RULES_WITH_RATIONALE if with_rationale else fixed.RULES_WITHOUT_RATIONALE
    return f"{fixed.TASK_INSTRUCTIONS[task]}\n\nLabel must be one of: [{choices}]{rules}"


def prompt_text(text: Column, task: str, with_rationale: bool = True) -> Column:
    return F.concat(
        F.lit(system_prompt(task, with_rationale) + '\n\nNow classify this text:\nText: "'),
        text,
        F.lit('"\n\nOutput (JSON only, no other text):'),
    )


def chat_messages(text: Column, task: str, with_rationale: bool = False) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(system_prompt(task, with_rationale))),
        message("user", F.concat(F.lit("Text: "), text)),
    )


def head_tail_truncate(text: Column, max_tokens: int = fixed.TRUNCATE_TOKENS, head_ratio: float = 0.5) -> Column:
    """Keep the first and the last white-space tokens of a long text; a short text is left untouched."""
    head = int(max_tokens * head_ratio)
    tail = max_tokens - head
    tokens = F.split(strip(text), f"[{fixed.WHITESPACE_RANGES}]+")
    kept = []
    if head:
        kept.append(F.slice(tokens, 1, head))
    if tail:
        kept.append(F.slice(tokens, -tail, tail))
    return F.when(F.size(tokens) <= max_tokens, text).otherwise(F.array_join(F.concat(*kept), " "))
