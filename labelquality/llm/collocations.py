"""Frequent phrases by Rabin-Karp fingerprints.

Every word and every run of two to four words in a piece of text gets a 64-bit fingerprint from prefix polynomials. Tasks count
fingerprints, a shuffle adds them up, and only fingerprints that occur often enough are looked at again: then the
occurrences behind them are read from the text, compared with the first one in the slice, and counted by their
words, so that texts which share a fingerprint part again. Runs of three and four words are counted only
where all their pairs are frequent. What is frequent goes to the tasks as a bit table of bounded size, which lets
every frequent fingerprint through and few others; with more fingerprints than it can tell apart the work grows, the results stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import stored
from .texts import flat, mix, raw, slices, table

LEAST = 30
LONGEST = 4
COVERED = (80, 100)  # a longer phrase as often as 80 of 100 covers a shorter one
TOP = 2000
UNKNOWN = "und"
SLICE = 2 << 20  # bytes that are worked on at once
HELD = 1_000_000  # fingerprints counted in a task before they are folded, and different ones before they are passed on
PHRASES = 150_000  # different phrases of a task before they are passed on
BITS = (16, 28)  # least and largest size of the bit table, as powers of two
PER_FINGERPRINT = 16  # bits

BASE, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER_BYTES = LOWER.tobytes()
VALUE = np.arange(1, 257, dtype=np.uint64)


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial of ``values[start:end]`` for every pair, modulo 2**64, from one pass of prefix sums; independent of its place."""
    up, down = POWERS.upto(len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, up[:-1], out=prefix[1:])
    np.cumsum(prefix, out=prefix)
    return (prefix[end] - prefix[start]) * down[start]


def chunks(data: bytes, size: int) -> Iterator[bytes]:
    """Cut behind breaks between pieces, every ``size`` bytes or at the next break after that."""
    at = 0
    while len(data) - at > size:
        kinds = KIND[np.frombuffer(data, np.uint8, size, at)]
        breaks = np.flatnonzero(kinds == BREAK)
        if len(breaks):
            end = at + int(breaks[-1]) + 1
        else:
            rest = KIND[np.frombuffer(data, np.uint8, offset=at + size)]
            end = at + size + int((rest == BREAK).argmax()) + 1 if (rest == BREAK).any() else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


class Grams:
    """Words of one chunk: ``start`` and ``end`` in its bytes, hash, piece; and fingerprints of runs of words."""

    def __init__(self, data: bytes, seeds: np.ndarray, of: np.ndarray):
        """``seeds``: seed by text; ``of``: end of each text in ``data``. Texts end in a break."""
        self.data = data.translate(LOWER_BYTES)
        raw_bytes = np.frombuffer(self.data, np.uint8)
        kind = KIND[raw_bytes]
        inside = np.concatenate(([0], (kind == WORD).view(np.int8), [0]))
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == BREAK, dtype=np.int32)[self.start] if len(raw_bytes) else self.start
        self.hash = mix(prefix_hashes(VALUE[raw_bytes], self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self.text = np.searchsorted(of, self.start, "right")
        self.seed = seeds[self.text]

    def runs(self, n: int) -> np.ndarray:
        """First words of runs of ``n`` words within a piece."""
        count = max(len(self.start) - n + 1, 0)
        return np.flatnonzero(self.piece[:count] == self.piece[n - 1 :])

    def fingerprints(self, n: int, first: np.ndarray) -> np.ndarray:
        return mix(prefix_hashes(self.hash, first, first + n) * np.uint64(2 * n + 1) ^ self.seed[first])


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed=7)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Grams, list[str]]]:
    """Chunks of the texts; with each the languages of its texts."""
    for part in slices(batches, limit=SLICE):
        langs = [x if x is not None else UNKNOWN for x in part.column("lang").to_pylist()]
        texts = raw(part.column("text"))
        if len(texts) == 1:
            for data in chunks(texts[0], SLICE):
                yield Grams(data + b"\n", np.array([_seed(langs[0])], np.uint64), np.array([len(data) + 1])), langs
        else:
            data, offsets = flat([t + b"\n" for t in texts])
            seeds = {x: _seed(x) for x in set(langs)}
            yield Grams(data.tobytes(), np.array([seeds[x] for x in langs], np.uint64), offsets[1:]), langs


class Filter:
    """A bit table of fingerprints by their upper bits: false for none that was put in."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - bits), words

    def __call__(self, fingerprint: np.ndarray) -> np.ndarray:
        bit = fingerprint >> self.shift
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_table(fingerprints: DataFrame) -> Filter:
    """The filter of column ``fp``, 16 bits each where the largest size allows it: 32 MB at most, in the driver and in tasks."""
    bits = min(max((fingerprints.count() * PER_FINGERPRINT).bit_length(), BITS[0]), BITS[1])
    bit = F.shiftrightunsigned("fp", 64 - bits)
    words = fingerprints.select(F.shiftrightunsigned(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return Filter(bits, out.view(np.uint64))


class _Counts:
    """Counts fingerprints of a task; folds them now and then, and passes them on when there are many different ones."""

    def __init__(self) -> None:
        self.fp, self.n, self.waiting = [], [], 0

    def add(self, fp: np.ndarray) -> None:
        self.fp.append(fp)
        self.n.append(np.ones(len(fp), np.int64))
        self.waiting += len(fp)

    def fold(self, least: int) -> Iterator[pa.RecordBatch]:
        if not self.fp:
            return
        fp, n = np.concatenate(self.fp), np.concatenate(self.n)
        order = np.argsort(fp)
        fp, n = fp[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if len(fp) else np.zeros(0, np.int64)
        fp, n = fp[first], np.add.reduceat(n, first) if len(first) else n
        self.fp, self.n, self.waiting = [fp], [n], 0
        if len(fp) >= least:
            self.fp, self.n = [], []
            for s in range(0, len(fp), 1 << 18):
                yield table(["fp", "n"], fp[s : s + (1 << 18)].view(np.int64), n[s : s + (1 << 18)])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for grams, _ in _grams(batches):
        for n in (1, 2):
            counts.add(grams.fingerprints(n, grams.runs(n)))
        if counts.waiting >= HELD:
            yield from counts.fold(HELD)
    yield from counts.fold(1)


def _long(pairs: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for grams, _ in _grams(batches):
            two = np.zeros(len(grams.start) + 1, bool)
            first = grams.runs(2)
            two[first] = pairs(grams.fingerprints(2, first))
            for n in range(3, LONGEST + 1):
                first = grams.runs(n)
                for k in range(n - 1):
                    first = first[two[first + k]]
                counts.add(grams.fingerprints(n, first))
            if counts.waiting >= HELD:
                yield from counts.fold(HELD)
        yield from counts.fold(1)

    return run


def _word_numbers(grams: Grams) -> np.ndarray:
    """The same number for words of the same bytes, others for others: by hash, checked against the text."""
    order = np.argsort(grams.hash, kind="stable")
    sorted_ = grams.hash[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)][number]  # the first word of the same hash
    size = grams.end - grams.start
    same = bool((size == size[head]).all())
    if same:
        data = np.frombuffer(grams.data, np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = bool((data[np.repeat(grams.start, size) + step] == data[np.repeat(grams.start[head], size) + step]).all())
    if same:
        return number
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(grams.data[s:e], len(seen)) for s, e in zip(grams.start.tolist(), grams.end.tolist())], np.int64)


def _phrases(frequent: Filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        names = ["lang", "size", "phrase", "n"]

        def flush() -> pa.RecordBatch:
            keys = list(found)
            out = table(names, pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.binary()), np.fromiter(found.values(), np.int64, len(keys)))
            found.clear()
            return out

        for grams, langs in _grams(batches):
            for lang, n in zip(langs, np.bincount(grams.text, minlength=len(langs)).tolist()):
                if n:
                    found[lang, 0, b""] += n  # all words of a language
            number = _word_numbers(grams)
            for n in range(1, LONGEST + 1):
                first = grams.runs(n)
                fp = grams.fingerprints(n, first)
                some = frequent(fp)
                first, fp = first[some], fp[some]
                if not len(first):
                    continue
                order = np.argsort(fp, kind="stable")
                first, fp = first[order], fp[order]
                new = np.concatenate(([True], fp[1:] != fp[:-1]))
                pointer = first[np.flatnonzero(new)][np.cumsum(new) - 1]  # the first occurrence of the same fingerprint
                differs = np.zeros(len(first), bool)
                for k in range(n):
                    differs |= number[first + k] != number[pointer + k]
                differs |= grams.seed[first] != grams.seed[pointer]
                times = np.add.reduceat((~differs).astype(np.int64), np.flatnonzero(new))
                heads = first[np.flatnonzero(new)]
                if differs.any():  # occurrences that share a fingerprint but not the words
                    heads, times = np.concatenate((heads, first[differs])), np.concatenate((times, np.ones(int(differs.sum()), np.int64)))
                start, end = grams.start[heads], grams.end[heads + n - 1]
                tight = sum((grams.end[heads + k] - grams.start[heads + k] for k in range(n)), np.zeros(len(heads), np.int64)) + n - 1 == end - start
                data = grams.data
                for s, e, plain, t, c in zip(start.tolist(), end.tolist(), tight.tolist(), grams.text[heads].tolist(), times.tolist()):
                    phrase = data[s:e].replace(b"\t", b" ") if plain else b" ".join(data[s:e].split())
                    found[langs[t], n, phrase] += c
            if len(found) >= PHRASES:
                yield flush()
        yield flush()

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, n): exact counts of all phrases of 1 to 4 words with ``least`` or more occurrences in a language,
    and of all words of a language as a phrase of size 0."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    often = lambda counts: counts.groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("fp")
    short = stored(often(rows.mapInArrow(_short, "fp long, n long")), "fingerprints")
    long = stored(often(rows.mapInArrow(_long(bit_table(short)), "fp long, n long")), "fingerprints")
    found = rows.mapInArrow(_phrases(bit_table(short.union(long))), "lang string, size int, phrase binary, n long")
    counted = found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("size") == 0))
    return counted.withColumn("phrase", F.col("phrase").cast("string"))


def _wide(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    Null languages count as ``und``, null texts as empty; repeated rows count again; an empty table gives an empty result.
    Ranks break ties by more occurrences, then by the phrase's bytes. Other columns are not read. Very long texts are
    cut between pieces, where no phrase lies, so memory is bounded by the longest piece.
    """
    counts = stored(phrase_counts(docs, text_col, lang_col, least), "phrases")
    words = F.split("phrase", " ")
    part = lambda first, size: F.array_join(F.slice(words, first, size), " ")
    known = counts.filter("size > 0").select("lang", "phrase", "n")
    phrases = counts.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))

    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1), lambda f: part(f, s)))),
        lambda p: p.isNotNull(),
    )
    longest = phrases.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = _wide(F.col("longer")) * F.lit(COVERED[1]) >= _wide(F.col("a")) * F.lit(COVERED[0])
    left = phrases.join(longest, ["lang", "phrase"], "left").filter(F.coalesce(~covered, F.lit(True))).drop("longer")

    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumn("head", part(F.lit(1), F.col("k"))).withColumn("tail", part(F.col("k") + 1, F.col("size") - F.col("k")))
    scored = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    scored = scored.join(known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    exact = F.expr("CAST(CAST(a AS DECIMAL(20,0)) * 2000000BD DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)")
    worst = scored.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc(F.col("cut")["score"]), F.desc("a"), "phrase")
    best = worst.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    total = counts.filter("size = 0").select("lang", "n")
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut")["l"].alias("l"), F.col("cut")["r"].alias("r"), "n", F.col("cut")["score"].alias("score"))
