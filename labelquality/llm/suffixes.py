"""Removal of repeated byte strings, found on a Burrows-Wheeler transform by threshold-bounded interval expansion.

Intervals of strings are extended to the left level by level. An extended interval whose right end has no
common-prefix value yet gives it one, the length of the string before; so values come in increasing order, and the
work is one interval for each value. Values below the few symbols that the suffix sort packs into its first keys are
read off these keys, and the expansion starts with the intervals of that length. It stops at the minimum length:
ends without a value then are those between suffixes that share that many bytes or more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .texts import table

MIN_BYTES = 400
GRAM = 100


def packed_prefixes(symbols: np.ndarray, ends: int) -> tuple[np.ndarray, int]:
    """Keys that order suffixes by their first symbols, as many as fit into 63 bits, and how many that is.

    Symbols from ``ends`` on are renumbered first. A prefix is cut at the first end mark, and the mark decides then.
    """
    n = len(symbols)
    used = np.unique(symbols[symbols >= ends])
    base = len(used) + 1
    s = np.where(symbols < ends, 0, np.searchsorted(used, symbols) + 1).astype(np.int64)
    width = min(n, max(1, int((62 - np.log2(ends + 2)) / np.log2(max(base, 2)))))
    key, going, mark = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, np.int64)
    for k in range(width):
        key *= base
        here = np.zeros(n, np.int64)
        here[: n - k] = s[k:]
        stops = going & (here == 0)
        at = np.flatnonzero(stops[: max(n - k, 0)])
        mark[at] = symbols[at + k] + 1
        going &= here > 0
        key += np.where(going, here, 0)
    return key * (ends + 1) + mark, width


def suffix_order(symbols: np.ndarray, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffix array, its inverse, the sorted packed prefixes and their width.

    After sorting by packed prefixes only the places that are still tied are sorted again, by the rank of what
    follows, over doubled distances. Symbols below ``ends`` occur once, the last one of them at the end.
    """
    key, step = packed_prefixes(symbols, ends)
    n, width = len(symbols), step
    order = np.argsort(key)
    prefix = key[order]
    new = np.concatenate(([True], prefix[1:] != prefix[:-1]))
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        suffix = order[tied]
        follow = suffix + step
        key = rank[suffix] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        rank[suffix] = np.repeat(tied[first], np.diff(np.append(first, len(tied))))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order, rank, prefix, width


def long_matches(symbols: np.ndarray, ends: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse, and for each place in it whether the suffix shares ``least`` symbols with the one before.

    Symbols below ``ends`` occur once and end a part; no match goes across them. The expansion starts from the
    intervals of all strings of the packed width (or of ``least``), whose borders the packed prefixes show.
    """
    order, rank, prefix, width = suffix_order(symbols, ends)
    n = len(symbols)
    if width > least:  # shorter strings: fewer symbols of the packed prefixes count
        same = np.zeros(n, bool)
        common = np.ones(n - 1, bool)
        for k in range(least):
            a, b = order[:-1] + k, order[1:] + k
            good = (a < n) & (b < n)
            x, y = symbols[np.minimum(a, n - 1)], symbols[np.minimum(b, n - 1)]
            common &= good & (x == y) & (x >= ends)
        same[1:] = common
        return order, rank, same
    before = symbols[order - 1]  # the transform
    back = rank[order - 1]  # where the suffix that is one symbol longer stands
    inside = before >= ends
    open_ = np.zeros(n + 1, bool)
    open_[1:n] = prefix[1:] == prefix[:-1]
    left = np.flatnonzero(~open_[:n])
    right = np.append(left[1:], n)
    top = int(symbols.max()) + 1
    for _ in range(width, least):
        one = right - left == 1
        at = left[one]
        at = at[inside[at]]
        lefts, rights = [back[at]], [back[at] + 1]
        wide, span = left[~one], (right - left)[~one]
        if len(wide):
            which = np.repeat(np.arange(len(wide)), span)
            place = np.arange(len(which)) - np.repeat(np.cumsum(span) - span, span) + wide[which]
            keep = inside[place]
            which, place = which[keep], place[keep]
            key = which * top + before[place]
            by = np.argsort(key, kind="stable")
            key, place = key[by], place[by]
            new = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
            last = np.append(new[1:], len(key)) - 1 if len(key) else new
            lefts.append(back[place[new]])
            rights.append(back[place[last]] + 1)
        left, right = np.concatenate(lefts), np.concatenate(rights)
        fresh = open_[right]
        left, right = left[fresh], right[fresh]
        open_[right] = False
        if not len(left):
            break
    return order, rank, open_[:n]


def match(least: int) -> repeats.Matcher:
    """Matcher for windows of ``least`` bytes: how many rows hold each window, and the smallest doc_id of them."""

    def run(bodies: list[bytes], windows: np.ndarray, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = len(bodies)
        length = np.array([len(b) for b in bodies], np.int64)
        begin = np.cumsum(length + 1) - length - 1
        symbols = np.zeros(int((length + 1).sum()), np.int64)
        inner = np.ones(len(symbols), bool)
        inner[begin + length] = False
        symbols[inner] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64) + m
        symbols[begin + length] = np.arange(m)
        start = np.repeat(begin - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
        weight, least_doc = np.zeros(len(symbols), np.int64), np.full(len(symbols), repeats.NO_DOC)
        weight[start], least_doc[start] = np.repeat(rows, windows), np.repeat(first, windows)
        order, rank, same = long_matches(symbols, m, least)
        new = np.flatnonzero(~same)
        group = np.cumsum(~same) - 1
        total, smallest = np.add.reduceat(weight[order], new), np.minimum.reduceat(least_doc[order], new)
        mine = group[rank[start]]
        return total[mine], smallest[mine]

    return run


def _cut(keep_text: bool):
    def run(texts: list[bytes], rest: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(texts, rest.column("spans").to_pylist()):
            ranges = repeats.covered(found)
            at, kept = 0, []
            for s, e in ranges:
                kept.append(text[at:s])
                at = e
            left = b"".join([*kept, text[at:]])
            out.append((len(text), len(text) - len(left), len(ranges), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if keep_text else None))
        return table(["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], rest.column("k1"), rest.column("k2"), *(pa.array(c, t) for c, t in zip(zip(*out), _TYPES)))

    return run


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_BYTES, keep_text: bool = True) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, n_spans, kept_sha256, kept) for every different text, named by ``repeats.keyed``.

    ``kept_sha256`` is of the bytes that are left; ``kept`` is their text, without the rest of a character that a cut
    went through, or null unless ``keep_text``.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    windows = repeats.Windows(least, min(GRAM, least // 4 + 1))
    found = repeats.by_text(repeats.spans(rows, windows, match(least)))
    schema = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"
    return repeats.with_texts(rows, found, "left", _cut(keep_text), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_BYTES, keep_text: bool = False) -> DataFrame:
    """(doc_id, k1, k2, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    Removes every byte covered by a string of ``least`` bytes that also starts anywhere else in the corpus, in the
    same document too. Null texts are empty, repeated rows are one another's copies, doc_ids may be null, an empty
    table gives an empty result. See ``cut_texts`` for the columns.
    """
    cut = cut_texts(docs, id_col, text_col, least, keep_text)
    rows = repeats.keyed(docs, id_col, text_col).select("doc_id", *repeats.KEY)
    return rows.join(cut, repeats.KEY).select("doc_id", *cut.columns)
