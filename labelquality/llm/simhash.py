"""SimHash near-duplicates: Golay decoding turns fingerprint segments into keys that tolerate errors.

A fingerprint has 64 bits: A and B of 23 bits and C of 18 bits, C in halves C1 and C2. A 23-bit segment is
decoded with the perfect binary Golay code [23, 12, 7]: its keys g are the indices of the codewords that decode
any word at distance 0 or 1 from it (one key, or six). Two segments at distance 2 or less have a word at
distance 1 or less from both, so they share a key. Three errors spread over (A, B, C) as follows:

* A and B at most 2 errors, and one half of C none: keys (gA, gB, C1) and (gA, gB, C2);
* C at least 2 errors, so A or B has none and the other at most 1: keys (A, gB) and (B, gA);
* A or B has all 3 errors: keys (B, C) and (A, C).

So all pairs within three bits meet under a key; meetings are verified by counting bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import stored
from .graph import components
from .texts import free, raw, slices, table

MAX_BITS = 3
DIRECT = 512  # members of a key that are compared at once; more are first split by an exact 16-bit block
GENERATOR = 0xC75  # of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: one where more than half of the shingle hashes have a one. No word: zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    size = min(shingle, len(words))
    of, n = xxhash.xxh64_intdigest, len(words) - size + 1
    hashes = [of(line[i:j], seed) for i, j in zip(starts[:n].tolist(), (ends[size - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row. Whole texts; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in raw(part.column("text"))], "<u8")
            yield table(["doc_id", "fp"], part.column("doc_id"), prints.view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def golay_index() -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word; every word is within distance 3 of exactly one."""
    message = np.arange(1 << 12, dtype=np.int32)
    code = np.zeros_like(message)
    for bit in range(12):
        code ^= np.where(message >> bit & 1, GENERATOR << bit, 0).astype(np.int32)
    index = np.zeros(1 << 23, np.int16)
    ones = [1 << i for i in range(23)]
    errors = [0, *ones]
    errors += [a | b for i, a in enumerate(ones) for b in ones[:i]]
    errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]
    for e in errors:
        index[code ^ e] = message
    return index


def golay_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of each 23-bit segment as (n, 6), and which of them are there; two segments within two bits share one."""
    near = segment[:, None] ^ np.array([0, *(1 << i for i in range(23))], np.int64)
    keys = np.sort(golay_index()[near].astype(np.int64), axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    order = np.argsort(~first, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(keys, order, 1), np.take_along_axis(first, order, 1)


def segment_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: all keys of each fingerprint, the kind of key in the top bits."""
    fp = fp.astype(np.uint64)
    a, b, c = ((fp >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in ((0, 23), (23, 23), (46, 18)))
    ga, has_a = golay_keys(a)
    gb, has_b = golay_keys(b)
    ab = (ga[:, :, None] << 12 | gb[:, None, :]).reshape(len(fp), 36)
    has_ab = (has_a[:, :, None] & has_b[:, None, :]).reshape(len(fp), 36)
    kinds = [
        (ab << 9 | (c & 511)[:, None], has_ab),
        (ab << 9 | (c >> 9)[:, None], has_ab),
        (a[:, None] << 12 | gb, has_b),
        (b[:, None] << 12 | ga, has_a),
        ((b << 18 | c)[:, None], np.ones((len(fp), 1), bool)),
        ((a << 18 | c)[:, None], np.ones((len(fp), 1), bool)),
    ]
    rows, keys = [], []
    for kind, (key, has) in enumerate(kinds):
        row, col = np.nonzero(has)
        rows.append(row)
        keys.append(key[row, col] | kind << 59)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2048):
            fp = batch.column("fp").slice(k, 2048).to_numpy()
            row, key = segment_keys(fp.view(np.uint64))
            yield table(["key", "sub", "fp"], key, np.zeros(len(key), np.int32), fp[row])


def near_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members of one key just as all their pairs within three bits do, at most one a member.

    Compares all pairs in blocks and keeps, for each member, the smallest position reached.
    """
    n, label = len(fp), np.arange(len(fp))
    step = max(1, (1 << 21) // n)
    while True:
        least = label.copy()
        for k in range(0, n, step):
            near = np.bitwise_count(fp[k : k + step, None] ^ fp) <= MAX_BITS
            least[k : k + step] = np.where(near, label, n).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows as arrays in which no key is cut, except keys of more rows than a batch holds at once."""
    held = None
    for batch in batches:
        got = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "sub", "fp")])
        held = got if held is None else np.concatenate([held, got], axis=1)
        if not held.shape[1]:
            continue
        start = np.flatnonzero((held[:2] == held[:2, -1:]).all(axis=0))[0]  # the last key may go on in the next batch
        if start:
            yield held[:, :start]
            held = held[:, start:]
    if held is not None and held.shape[1]:
        yield held


def _meet(split: bool):
    """Verify the members of each key. With ``split``, keys of more than DIRECT members return members under finer keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sub, fp in _runs(batches):
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))))
            size = np.diff(np.append(new, len(key)))
            a, b, finer = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((3, 0), np.int64)]
            two = new[size == 2]
            good = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= MAX_BITS
            a.append(fp[two[good]])
            b.append(fp[two[good] + 1])
            for i, n in zip(new[size > 2].tolist(), size[size > 2].tolist()):
                if split and n > DIRECT:
                    mine = fp[i : i + n]
                    for block in range(4):
                        value = mine >> (16 * block) & 0xFFFF
                        finer.append(np.stack([np.full(n, key[i]), block << 16 | value, mine]))
                else:
                    x, y = near_links(fp[i : i + n].view(np.uint64))
                    a.append(x.view(np.int64))
                    b.append(y.view(np.int64))
            more = np.concatenate(finer, axis=1)
            links = sum(map(len, a))
            none = np.full(links, -1, np.int64)
            yield table(
                ["a", "b", "key", "sub"],
                np.concatenate([*a, more[2]]), np.concatenate([*b, more[2]]),
                np.concatenate([none, more[0]]), np.concatenate([none, more[1]]).astype(np.int32),
            )

    return run


def links(prints: DataFrame) -> DataFrame:
    """(a, b): fingerprints within three bits, enough of them to connect all that are linked.

    ``prints`` holds distinct fingerprints. Members of a key meet in one sorted stream; a key of more than
    DIRECT members is dealt again by four exact 16-bit blocks (three errors leave one block without any).
    """
    schema = "a long, b long, key long, sub int"
    keyed = prints.mapInArrow(_keyed, "key long, sub int, fp long")
    met = stored(keyed.repartition("key").sortWithinPartitions("key", "sub").mapInArrow(_meet(True), schema), "met")
    again = met.filter("key >= 0").select("key", "sub", F.col("a").alias("fp")).repartition("key", "sub")
    again = again.sortWithinPartitions("key", "sub").mapInArrow(_meet(False), schema)
    return met.filter("key < 0").select("a", "b").union(again.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: the smallest doc_id that links of three bits or fewer reach.

    Equal fingerprints are one node, so copies never form pairs. Texts without words share the fingerprint zero.
    Null texts count as empty; rows with a null doc_id take part but do not name a component; repeated rows stay
    repeated; an empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(prints.select("fp")))
    named = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(smallest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of every group of linked fingerprints: the one with the smallest doc_id, rows without a doc_id last; all columns.

    Decides by row, so rows that share a doc_id or have none are told apart, and exact repeats go as well.
    """
    mark = free("_row", docs.columns)
    marked = stored(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")
    rows = stored(_row_fingerprints(marked, mark, id_col, text_col, shingle), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    prints = rows.groupBy("fp").agg(F.min(rank).alias("first"))
    found = components(links(prints.select("fp")))
    named = prints.join(found, prints["fp"] == found["node"], "left").select("first", F.coalesce("component", "fp").alias("component"))
    stay = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(mark))
    return marked.join(stay, mark, "left_semi").select(*docs.columns)


def _row_fingerprints(docs: DataFrame, mark: str, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints = np.array([fingerprint(t, shingle) for t in raw(part.column("text"))], "<u8")
            yield table(["row", "doc_id", "fp"], part.column("row"), part.column("doc_id"), prints.view(np.int64))

    rows = docs.select(F.col(mark).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of its group; all columns. Rows without a doc_id cannot be told apart and go only if their group has one."""
    found = near_duplicates(docs, id_col, text_col)
    dropped = found.filter("doc_id != component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti")
