"""Quality rules: gradient-boosted trees over statistics of a document.

Statistics come from whole texts in one pass. The trees are fitted on labelled documents, are monotonic in chosen
statistics (more symbols, repeats or capitals never make a text better), and are scored as flat node arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .texts import raw, slices, table

MAX_LABELLED = 20_000  # bound on labelled documents that a model is fitted on
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
CAPITALS = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b".,;:!?"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {  # name: direction in which the chance of good quality may move with it, 0 if free
    "log_words": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "capital_share": -1, "digit_share": 0,
    "mark_share": 0, "word_length": 0, "distinct_share": 0, "words_per_line": 0, "beyond_ascii_share": 0,
}


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words covered by windows of ``size`` words that occur at least twice; exact."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    kinds, grams = len(code), ids
    if kinds == len(words):
        return 0
    for k in range(1, size):
        high = int(grams.max()) + 1
        if high * kinds >= 1 << 62:  # renumber before the next word would overflow
            grams = np.unique(grams, return_inverse=True)[1].ravel()
        grams = grams[: len(words) - k] * kinds + ids[k:]
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    begin = np.isin(grams, np.unique(twice))
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += begin
    cover[size:] -= begin
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(data: bytes) -> tuple[list[int], list[float]]:
    """Counts in the order of COUNTS and features in the order of FEATURES, of one text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, size = len(words), len(data)
    without = lambda which: size - len(data.translate(None, which))
    chars = len(data.decode("utf-8", "replace")) - without(WHITE)
    beyond = size - without(bytes(range(128)))
    symbols, dup, repeat = without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)
    per_char, per_word = max(chars, 1), max(n, 1)
    features = [
        float(np.log1p(n)), symbols / per_char, dup / max(len(lines), 1), repeat / per_word, without(CAPITALS) / per_char, without(DIGITS) / per_char,
        without(MARKS) / per_char, chars / per_word, len(set(words)) / per_word, n / max(len(lines), 1), beyond / max(size, 1),
    ]
    return [n, chars, symbols, dup, repeat], features


@dataclass
class Trees:
    """Node arrays of all trees: children are positions, a leaf is its own child, ``roots`` begins each tree."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds for each row: all trees of all rows go down one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, smooth: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for a 0/1 outcome, second-order, on histograms of quantile bins.

    A split on a feature with a direction must have its children's values in that order, and the children's later
    values are bounded by their middle, so the whole sum is monotonic in that feature.
    """
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) if len(col) else np.zeros(1) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T)])
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), start)
    nodes: list[tuple] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        queue = [(len(nodes), np.arange(len(y)), 0, -np.inf, np.inf)]
        nodes.append((0, 0.0, len(nodes), len(nodes), 0.0))
        while queue:
            at, rows, level, low, high = queue.pop()
            best = None
            if level < depth:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    gs = np.cumsum(np.bincount(binned[f, rows], g[rows], len(e) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[f, rows], h[rows], len(e) + 1))[:-1]
                    gr, hr = total_g - gs, total_h - hs
                    a, b = np.clip(-gs / (hs + smooth), low, high), np.clip(-gr / (hr + smooth), low, high)
                    gain = -(gs * a + (hs + smooth) * a * a / 2 + gr * b + (hr + smooth) * b * b / 2)
                    good = (hs >= least) & (hr >= least) & (directions[f] * (b - a) >= 0)
                    gain = np.where(good, gain, -np.inf)
                    k = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k, a[k], b[k])
                v = float(np.clip(-total_g / (total_h + smooth), low, high))
                if best is not None and best[0] <= -(total_g * v + (total_h + smooth) * v * v / 2) + 1e-9:
                    best = None
            if best is None:
                value = rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + smooth), low, high))
                nodes[at] = (0, 0.0, at, at, value)
                margin[rows] += value
                continue
            _, f, k, a, b = best
            left, middle = binned[f, rows] <= k, (a + b) / 2
            bounds = [(low, high), (low, high)]
            if directions[f] > 0:
                bounds = [(low, middle), (middle, high)]
            elif directions[f] < 0:
                bounds = [(middle, high), (low, middle)]
            kids = (len(nodes), len(nodes) + 1)
            nodes[at] = (f, float(edges[f][k]), *kids, 0.0)
            for kid, part, (lo, hi) in zip(kids, (rows[left], rows[~left]), bounds):
                nodes.append((0, 0.0, kid, kid, 0.0))
                queue.append((kid, part, level + 1, lo, hi))
    flat = np.array(nodes or np.zeros((0, 5)), float)
    whole = lambda k: flat[:, k].astype(np.int32)
    return Trees(np.array(roots, np.int32), whole(0), flat[:, 1], whole(2), whole(3), flat[:, 4], depth, start)


_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """(doc_id, counts, features array<double>, chance) for every row; chance is null without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [statistics(t) for t in raw(part.column("text"))]
            counts, x = np.array([c for c, _ in found], np.int64), np.array([f for _, f in found], float)
            chance = pa.nulls(len(x), pa.float64()) if model is None else pa.array(model.chance(x))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield table(["doc_id", *COUNTS, "features", "chance"], part.column("doc_id"), *counts.T.copy(), rows, chance)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"{_SCHEMA}, features array<double>, chance double")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = MAX_LABELLED) -> Trees:
    """Fit on at most ``limit`` labelled rows, chosen by a hash of the doc_id; their statistics go to the driver.

    Labels that are null, or neither 0 nor 1, are left out; of several labels of one document the smallest counts.
    Rows of one doc_id with equal statistics count once; others are rows of their own within the limit.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(limit)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")  # limit rows
    rows = document_statistics(picked.select("doc_id", "text")).select("doc_id", "features").distinct().join(F.broadcast(chosen), "doc_id")
    got = rows.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id", "features").limit(limit).toArrow()
    got = got.take(np.argsort(got["doc_id"].to_numpy(), kind="stable")) if got.num_rows else got
    x = np.array(got["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy().astype(float), list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, counts, base_failed, kept, chance) for every row, from whole texts.

    A text fails the base rules with fewer than MIN_WORDS words, or when repeated five-word windows cover more than
    MAX_REPEAT_PERCENT of its words; other texts are kept if the trees give good quality a chance of ``least`` or
    more. Null texts have no words. Without any labels the trees say one half for every text.
    """
    found = document_statistics(docs, id_col, text_col, model).drop("features")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("chance") >= least))
