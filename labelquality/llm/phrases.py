"""Removal of repeated passages of words, located by Aho-Corasick automata.

A shard holds the stretches of some anchors. Windows that recur in it are confirmed by counting, compiled into
automata of bounded size, and all stretches of the shard are streamed through them: a hit is an occurrence. Words
become single characters by a table of the shard, so a phrase is a short string and matching is exact.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import repeats
from .texts import table

MIN_WORDS = 50
GRAM = 15
SHARD = 8000  # phrases in one automaton


def match(size: int) -> repeats.Matcher:
    """Matcher for windows of ``size`` words: how many rows hold each window, and the smallest doc_id of them."""

    def run(bodies: list[bytes], windows: np.ndarray, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code: dict[bytes, int] = {}
        lines = []
        for body in bodies:
            ids = [code.setdefault(w, len(code)) for w in body.split(b" ")]
            lines.append("".join([chr(i if i < 0xD800 else i + 0x800) for i in ids]))
        seen: dict[str, int] = {}
        for line, n, k in zip(lines, windows.tolist(), rows.tolist()):
            for o in range(n):
                phrase = line[o : o + size]
                seen[phrase] = seen.get(phrase, 0) + k
        confirmed = [p for p, k in seen.items() if k > 1]
        del seen
        begin = np.concatenate(([0], np.cumsum(windows)))
        total, least = np.ones(begin[-1], np.int64), np.full(begin[-1], repeats.NO_DOC)
        for s in range(0, len(confirmed), SHARD):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            shard = confirmed[s : s + SHARD]
            for k, phrase in enumerate(shard):
                automaton.add_word(phrase, k)
            automaton.make_automaton()
            hits = [(k, end - size + 1, which) for k, line in enumerate(lines) for end, which in automaton.iter(line)]
            stretch, offset, which = (np.array(x, np.int64) for x in zip(*hits))
            times, smallest = np.bincount(which, rows[stretch], len(shard)).astype(np.int64), np.full(len(shard), repeats.NO_DOC)
            np.minimum.at(smallest, which, first[stretch])
            at = begin[stretch] + offset
            total[at], least[at] = times[which], smallest[which]
        return total, least

    return run


def _cut(size: int):
    def run(texts: list[bytes], rest: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(texts, rest.column("spans").to_pylist()):
            words, at, kept, ranges = text.split(), 0, [], repeats.covered(found)
            for s, e in ranges:
                kept += words[at:s]
                at = e
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [s for s, _ in ranges], [e for _, e in ranges]))
        columns = zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))
        return table(["k1", "k2", "n_words", "n_removed", "kept_sha256", "starts", "ends"], rest.column("k1"), rest.column("k2"), *(pa.array(c, t) for c, t in columns))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, starts, ends) for every row of ``docs``.

    Removes every word covered by a window of ``size`` words whose sequence also starts in a document with a smaller
    doc_id. ``starts`` and ``ends`` list the removed word ranges. Null texts have no words. Rows
    without a doc_id come after all others and are equal among themselves, as are rows that repeat a doc_id. An
    empty table gives an empty result.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    found = repeats.spans(rows, repeats.Windows(size, min(GRAM, size // 4 + 1), words=True), match(size)).filter("first < own")
    found = repeats.by_text(found)
    schema = "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>"
    cut = repeats.with_texts(rows, found, "left", _cut(size), schema)
    own = rows.groupBy(*repeats.KEY).agg(F.min("doc_id").alias("own"))
    later = (F.coalesce("doc_id", F.lit(int(repeats.NO_DOC))) > F.col("own")) & (F.col("n_words") >= size)  # a copy: all its windows occur before
    pick = lambda copy, else_: F.when(later, copy).otherwise(F.col(else_)).alias(else_)
    return rows.select("doc_id", *repeats.KEY).join(cut.join(own, repeats.KEY), repeats.KEY).select(
        "doc_id", "n_words", pick(F.col("n_words"), "n_removed"), pick(F.lit(hashlib.sha256().hexdigest()), "kept_sha256"),
        pick(F.array(F.lit(0).cast("long")), "starts"), pick(F.array("n_words"), "ends"),
    )
