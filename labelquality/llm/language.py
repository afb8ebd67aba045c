"""Language identification in two steps: the family, then linear support vector machines between its languages.

Texts are read as byte trigrams over a small alphabet (letters without case, bytes beyond ASCII, everything else
a space). Families are learned too: languages with similar trigram profiles are merged until about the square
root of their number is left. One machine per family (one against the rest) picks the family, and one machine
per pair of languages of a family votes within it. A machine is a weight per trigram, so scoring a text is a sum.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .texts import flat, raw, slices, table

PER_LANGUAGE = 1000  # bound on labelled documents per language that a model is fitted on
DIM = 1 << 18
UNKNOWN = "und"
ASCII_LETTER = re.compile(rb"[A-Za-z]").search


def _codes() -> np.ndarray:
    """Six-bit code of each byte: 0 for ASCII beyond letters, 1 to 26 for letters, the rest folded onto 27 to 63."""
    code = np.zeros(256, np.int32)
    for k in range(26):
        code[ord("a") + k] = code[ord("A") + k] = k + 1
    code[128:] = 27 + np.arange(128) % 37
    return code


CODES = _codes()


def trigrams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram ids of texts in a row, and where each text begins; a text is padded by two spaces, so none is without."""
    data, starts = flat([p + b"  " for p in parts])
    c = np.concatenate((np.zeros(2, np.int32), CODES[data]))
    grams = c[:-2] << 12 | c[1:-1] << 6 | c[2:]
    return grams, starts


def has_letter(data: bytes) -> bool:
    if ASCII_LETTER(data):
        return True
    return not data.isascii() and any(unicodedata.category(c)[0] == "L" for c in set(data.decode("utf-8", "replace")))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float = 10.0, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by dual coordinate descent, on sparse unit rows; both
    sides weigh the same."""
    w, alpha, draw = np.zeros(DIM), np.zeros(len(rows)), np.random.default_rng(seed)
    positive = max(1, int((sign > 0).sum()))
    costs = np.where(sign > 0, 0.5 * len(rows) / positive, 0.5 * len(rows) / max(1, len(rows) - positive)) * cost
    for _ in range(rounds):
        for i in draw.permutation(len(rows)):
            index, value = rows[i]
            gradient = sign[i] * (w[index] @ value) - 1 + alpha[i] / (2 * costs[i])
            new = max(alpha[i] - gradient / (1 + 1 / (2 * costs[i])), 0.0)
            if new != alpha[i]:
                w[index] += (new - alpha[i]) * sign[i] * value
                alpha[i] = new
    return w


def group_families(profiles: np.ndarray) -> list[list[int]]:
    """Merge the two groups with the largest mean cosine between members until about sqrt(n) groups are left."""
    unit = profiles / np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
    near, groups = unit @ unit.T, [[k] for k in range(len(unit))]
    while len(groups) > max(1, int(np.ceil(np.sqrt(len(unit))))):
        pairs = [(near[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i])]
        _, i, j = max(pairs)
        groups[j] += groups.pop(i)
    return [sorted(g) for g in sorted(groups, key=min)]


@dataclass
class Model:
    """languages; families as lists of their positions; weights: one row per machine, families first, then pairs."""

    languages: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))

    def sums(self, parts: list[bytes]) -> np.ndarray:
        """Mean weight per trigram and machine for each text."""
        grams, starts = trigrams(parts)
        length = np.diff(starts)
        return np.stack([np.add.reduceat(w[grams], starts[:-1]) / length for w in self.weights], axis=1) if len(self.weights) else np.zeros((len(parts), 0))

    def predict(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Position of the language, and a score between 0 and 1: the certainty of the least certain step."""
        sums = self.sums(parts)
        n, heads = len(parts), len(self.families) if len(self.families) > 1 else 0
        family = sums[:, :heads].argmax(axis=1) if heads else np.zeros(n, np.int64)
        margin = np.full(n, np.inf)
        if heads:
            ranked = np.sort(sums[:, :heads], axis=1)
            margin = (ranked[:, -1] - ranked[:, -2]) / 2
        votes = np.full((n, len(self.languages)), -np.inf)
        for k, members in enumerate(self.families):
            votes[np.ix_(family == k, members)] = 0
        strength = np.zeros((n, len(self.languages)))
        for k, (a, b) in enumerate(self.pairs):
            s = sums[:, heads + k]
            votes[:, a] += s > 0
            votes[:, b] += s <= 0
            strength[:, a] += s
            strength[:, b] -= s
        best = np.argmax(votes + strength / (1 + np.abs(strength).max(initial=0)) * 0.5, axis=1)  # equal votes: the larger margins
        for k, (a, b) in enumerate(self.pairs):
            mine = (best == a) | (best == b)
            margin[mine] = np.minimum(margin[mine], np.abs(sums[mine, heads + k]))
        return best, np.where(np.isinf(margin), 1.0, 1 / (1 + np.exp(-np.minimum(margin, 50) * self.scale)))

    scale: float = 20.0


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Fit on (language, trigram ids, counts) of labelled documents."""
    languages = sorted({r[0] for r in rows})
    label = np.array([languages.index(r[0]) for r in rows], np.int64)
    vectors = [(index, count / np.linalg.norm(count)) for _, index, count in rows]
    profiles = np.zeros((len(languages), DIM), np.float32)
    for k, (index, value) in zip(label, vectors):
        profiles[k, index] += value
    families = group_families(profiles) if languages else []
    model = Model(languages, families, [(a, b) for f in families for i, a in enumerate(f) for b in f[i + 1 :]])
    weights = []
    if len(families) > 1:
        weights += [fit_machine(vectors, np.where(np.isin(label, f), 1.0, -1.0)) for f in families]
    for a, b in model.pairs:
        mine = np.flatnonzero((label == a) | (label == b))
        weights.append(fit_machine([vectors[i] for i in mine], np.where(label[mine] == a, 1.0, -1.0)))
    if weights:
        model.weights = np.array(weights, np.float32)
    return model


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        for lang, data in zip(part.column("lang").to_pylist(), raw(part.column("text"))):
            index, count = np.unique(trigrams([data])[0], return_counts=True)
            yield table(["lang", "index", "count"], [lang], [index.astype(np.int32)], [count.astype(np.int32)])


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Model from at most ``per_language`` rows of each language, chosen by a hash of doc_id and text.

    Reads whole texts of the chosen rows; their trigram counts (at most DIM numbers each) go to the driver.
    Rows without text, language or doc_id are not learned from; exact repeats count once, and rows that share a
    doc_id are chosen one by one. A hash threshold from the counts per language leaves little more than the sample
    before anything moves, so neither a task nor the ranking sees a large group.
    """
    known = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter("doc_id is not null and lang is not null and text is not null and text != ''").withColumn("h", F.xxhash64("doc_id", "text", F.lit(8)))
    total = known.groupBy(F.col("lang").alias("_lang")).agg(F.approx_count_distinct("h", 0.02).alias("n"))  # of different rows; the share leaves room for its error
    share = F.least(F.lit(1.0), F.lit(1.5 * per_language + 50) / F.col("n"))
    key = ["doc_id", "lang", "h"]
    # total has one row a language, of which the model's languages are as many
    near = known.select(*key).join(F.broadcast(total), F.col("lang") == F.col("_lang")).filter(F.col("h") <= -(2.0**63) + share * 2.0**64)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = near.select(*key).distinct().withColumn("rank", rank).filter(F.col("rank") <= per_language).select(*key)
    picked = known.join(F.broadcast(chosen), key)  # per_language rows a language, and their repeats
    counts = picked.groupBy(*key).agg(F.min("text").alias("text")).select("lang", "text")
    found = counts.mapInArrow(_counts, "lang string, index array<int>, count array<int>").toArrow()
    rows = zip(found["lang"].to_pylist(), found["index"], found["count"])
    rows = [(lang, i.values.to_numpy(), c.values.to_numpy().astype(float)) for lang, i, c in rows]
    return fit(sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))


def _judge(model: Model, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text; UNKNOWN with 0 where it has no letter or nothing was learned."""
    names = np.array([*model.languages, UNKNOWN], object)
    good = np.array([has_letter(p) for p in parts]) & bool(model.languages)
    best, score = model.predict(parts) if model.languages else (np.zeros(len(parts), int), np.zeros(len(parts)))
    return names[np.where(good, best, len(names) - 1)], np.where(good, score, 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learned.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names, score = _judge(model, raw(part.column("text")))
            yield table(["doc_id", "lang_pred", "score"], part.column("doc_id"), names, score)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether the doc_id's CRC leaves 1 when divided by 3; such documents are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the rows that are not held out, predict for all."""
    model = learn(docs.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text ``predict`` does not call und, row by row; all columns. Without any label, rows with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            parts = raw(part.column(text_col))
            keep = _judge(model, parts)[0] != UNKNOWN if model.languages else np.array([has_letter(t) for t in parts])
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
