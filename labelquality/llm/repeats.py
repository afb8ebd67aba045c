"""Repeated windows of bytes or words in a corpus: candidates, routing and spans; the operators bring the matcher.

A window is a fixed number of consecutive units (bytes or words) of one text. Each window has an anchor, the gram
of a few units with the smallest hash in it, so equal windows have equal anchors, and neighbouring windows mostly
share theirs. A stretch is a maximal row of windows with one anchor. The steps:

1. Every text gives its anchors. Anchors that occur once cannot hold a repeated window and drop out.
2. Texts that have other anchors give their stretches, routed by anchor: an anchor's shard holds all windows that
   can be equal to one another. Equal stretches of a task are sent once.
3. A matcher finds, in each shard, which windows occur where. Of anchors with more than BUSY rows only the
   different stretches travel, added up. Anchors with more than CROWD different stretches are split instead by the
   digest of each window, which needs no common place.
4. Runs of repeated windows go back to their texts.

Equal texts are folded from the start: they are one text with a number of rows and a smallest doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import stored
from .texts import flat, mix, raw, slices, table

CROWD = 4096  # different stretches of one anchor that meet in one place
BUSY = 2000  # rows of one anchor that travel to its shard; of more, only the different stretches do
GROUP_BYTES = 1 << 18  # of stretches that are matched together; arrays of that many numbers stay in the cache
SLICE = 1 << 18  # bytes of texts that are hashed together
CHUNK = 1 << 20  # units of one text that are hashed together
KEY = ["k1", "k2"]

_RNG = np.random.default_rng(400)
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
BASE = int(_RNG.integers(1 << 60, 1 << 62)) | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers, modulo 2^64, of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
            _powers[k] = out
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the units in each [start, end): the same wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


@dataclass(frozen=True)
class Windows:
    """Windows of ``size`` units; ``words`` or else bytes; anchors are grams of ``gram`` units."""

    size: int
    gram: int
    words: bool = False

    def normal(self, data: bytes) -> bytes:
        return b" ".join(data.split()) if self.words else data

    def units(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of normal texts in a row, and of their units: codes, starts, ends, and where each text's units begin."""
        if not self.words:
            data, at = flat(parts)
            place = np.arange(len(data))
            return data, BYTE_CODE[data], place, place + 1, at
        counts = [p.count(b" ") + 1 if p else 0 for p in parts]
        data = np.frombuffer(b" ".join(p for p in parts if p), np.uint8)
        at = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        space = np.flatnonzero(data == 32)
        some = len(data) > 0
        starts, ends = np.concatenate(([0], space + 1))[: len(space) + some], np.concatenate((space, [len(data)]))[: len(space) + some]
        codes = span_hash(prefix_sums(BYTE_CODE[data]), starts, ends) if some else np.zeros(0, np.uint64)
        return data, codes, starts, ends, at

    def stretches(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first window, number of windows, anchor hash) of every stretch; windows count units over all texts."""
        out = []
        if len(codes) <= 2 * CHUNK or len(at) == 2 and len(codes) <= CHUNK + self.size:
            out.append(self._stretches(codes, at))
        else:  # long texts go by chunks that overlap by all but one unit of a window
            for t in range(len(at) - 1):
                for s in range(at[t], max(at[t + 1] - self.size + 1, at[t]), CHUNK):
                    e = min(s + CHUNK + self.size - 1, at[t + 1])
                    text, first, count, anchor = self._stretches(codes[s:e], np.array([0, e - s]))
                    out.append((text + t, first + s, count, anchor))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else self._stretches(codes[:0], np.zeros(1, np.int64))

    def _stretches(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(codes)
        if n < self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        prefix = prefix_sums(codes)
        grams = mix((prefix[self.gram :] - prefix[: -self.gram]) * powers(n - self.gram + 1)[1])
        low = np.uint64(0xFFFFFFFF)
        ranked = grams & ~low | (low - np.arange(len(grams), dtype=np.uint64))  # equal hashes: the last one wins
        place = (low - (sliding_min(ranked, self.size - self.gram + 1) & low)).astype(np.int64)
        end = np.repeat(at[1:], np.diff(at))
        start = np.arange(n - self.size + 1)
        start = start[start + self.size <= end[: len(start)]]
        place = place[start]
        if not len(start):
            return self._stretches(codes[:0], at)
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))))
        first = start[new]
        return np.searchsorted(at, first, "right") - 1, first, np.diff(np.append(new, len(start))), grams[place[new]]


def keyed_columns(id_col: str, text_col: str) -> list[Column]:
    """doc_id, k1, k2, text: two 64-bit hashes name a text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*keyed_columns(id_col, text_col))


def _packed(rows: DataFrame) -> DataFrame:
    """(k1, k2, size, packed): texts compressed for the way; a task sends copies of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()  # bounded by the rows of one input split
        for part in slices(batches):
            keys = list(zip(part.column("k1").to_pylist(), part.column("k2").to_pylist()))
            new = [k for k, key in enumerate(keys) if not (key in sent or sent.add(key))]
            part = part.take(pa.array(new, pa.int64()))
            texts = raw(part.column("text"))
            packed = [pa.compress(t, codec="zstd", asbytes=True) if t else b"" for t in texts]
            yield table(["k1", "k2", "size", "packed"], part.column("k1"), part.column("k2"), np.array([len(t) for t in texts], np.int64), pa.array(packed, pa.binary()))

    return rows.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, size long, packed binary")


def with_texts(rows: DataFrame, more: DataFrame, how: str, fn: Callable[[list[bytes], pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Join the texts of ``rows`` with ``more`` on the key and map each different text once.

    ``fn`` gets a list of texts and the record batch of their other columns, and returns a batch.
    """
    joined = _packed(rows).repartition(*KEY).join(more, KEY, how)
    extra = [c for c in joined.columns if c not in ("size", "packed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            take, total = [], 0
            sizes = batch.column("size").to_pylist()
            for k, key in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())):
                if key != last:
                    take.append(k)
                    total += sizes[k]
                last = key
                if take and (total >= SLICE or k == len(sizes) - 1):
                    part = batch.take(pa.array(take))
                    packed = zip(part.column("packed").to_pylist(), part.column("size").to_pylist())
                    yield fn([pa.decompress(p, decompressed_size=n, codec="zstd", asbytes=True) if n else b"" for p, n in packed], part.select(extra))
                    take, total = [], 0

    return joined.sortWithinPartitions(*KEY).mapInArrow(run, schema)


def _anchors(windows: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            parts = [windows.normal(t) for t in raw(part.column("text"))]
            _, codes, _, _, at = windows.units(parts)
            text, _, _, anchor = windows.stretches(codes, at)
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(text)), bool), (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]))))
            times = np.diff(np.append(new, len(text)))
            take = pa.array(text[new])
            yield table(["h", "k1", "k2", "times"], anchor[new].view(np.int64), part.column("k1").take(take), part.column("k2").take(take), np.minimum(times, 2).astype(np.int32))

    return run


_FOUND = "h long, d1 long, d2 long, k1 long, k2 long, rows long, first long, starts array<long>, windows int, stretch binary"


def _stretches(windows: Windows):
    def run(texts: list[bytes], rest: pa.RecordBatch) -> pa.RecordBatch:
        parts = [windows.normal(t) for t in texts]
        data, codes, starts, ends, at = windows.units(parts)
        text, first, count, anchor = windows.stretches(codes, at)
        wanted = rest.column("anchors")
        of = np.repeat(np.arange(len(parts)), np.diff(wanted.offsets.to_numpy()))
        salt = mix(np.arange(1, len(parts) + 1).astype(np.uint64))
        mine = np.flatnonzero(np.isin(anchor ^ salt[text], wanted.flatten().to_numpy().view(np.uint64) ^ salt[of]))
        text, first, count, anchor = text[mine], first[mine], count[mine], anchor[mine]
        body = data.tobytes()
        cut = [body[s:e] for s, e in zip(starts[first].tolist(), ends[first + count + windows.size - 2].tolist())] if len(first) else []
        digest = np.frombuffer(b"".join(hashlib.blake2b(c, digest_size=16).digest() for c in cut), np.int64).reshape(-1, 2)
        # equal stretches of one text are one row: a text that repeats itself gives few of them
        order = np.lexsort((first, digest[:, 1], digest[:, 0], text))
        text, first, count, anchor, digest = text[order], first[order], count[order], anchor[order], digest[order]
        differs = (text[1:] != text[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(text)), bool), differs)))
        starts_of = pa.ListArray.from_arrays(pa.array(np.append(new, len(text)), pa.int32()), pa.array(first - at[text], pa.int64()))
        seen: set[bytes] = set()
        sent = [cut[k] if not (d in seen or seen.add(d)) else None for k, d in zip(order[new].tolist(), (x.tobytes() for x in digest[new]))]
        times = np.diff(np.append(new, len(text)))
        text, count, anchor, digest = text[new], count[new], anchor[new], digest[new]
        take = pa.array(text)
        pick = lambda c: rest.column(c).take(take)
        return table(
            ["h", "d1", "d2", "k1", "k2", "rows", "first", "starts", "windows", "stretch"],
            anchor.view(np.int64), digest[:, 0], digest[:, 1], pick("k1"), pick("k2"), pick("rows").to_numpy() * times, pick("first"),
            starts_of, count.astype(np.int32), pa.array(sent, pa.binary()),
        )

    return run


#: What a matcher gets: stretches, their numbers of windows, of rows, and smallest doc_ids; and what it returns for
#: every window of every stretch in turn: the number of rows it occurs in, and the smallest doc_id.
Matcher = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]

NO_DOC = np.iinfo(np.int64).max
#: For each of ``starts``, the units from start + low to start + high of a text are covered.
_SPANS = "k1 long, k2 long, starts array<long>, low long, high long, first long, own long"


def _runs(total: np.ndarray, first: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each maximal row of windows that occur twice or more and agree in ``first``."""
    edge = border | np.concatenate(([True], (first[1:] != first[:-1]) | ((total[1:] > 1) != (total[:-1] > 1))))
    new = np.flatnonzero(edge)
    last = np.append(new[1:], len(total)) - 1
    good = total[new] > 1
    return new[good], last[good]


def _match(matcher: Matcher, size: int):
    """Sorted rows of whole anchors to spans of repeated windows, as windows of their texts."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            for part in slices([batch], "stretch", GROUP_BYTES):
                held.append(part)
                weight += part.column("stretch").nbytes + 16 * part.num_rows
                if weight < GROUP_BYTES:
                    continue
                whole = pa.Table.from_batches(held).combine_chunks()
                h = whole.column("h").to_numpy()
                start = int(np.flatnonzero(h == h[-1])[0])  # the last anchor may go on
                if start:
                    yield whole.slice(0, start)
                held = whole.slice(start).combine_chunks().to_batches()
                weight = sum(x.column("stretch").nbytes + 16 * x.num_rows for x in held) if start else 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches):
            ids = np.stack([whole.column(c).to_numpy() for c in ("h", "d1", "d2")])
            new = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0))))
            kind = np.repeat(np.arange(len(new)), np.diff(np.append(new, ids.shape[1])))
            rows, first, count = (whole.column(c).to_numpy() for c in ("rows", "first", "windows"))
            bodies: list[bytes] = [b""] * len(new)
            for k, body in zip(kind.tolist(), whole.column("stretch").to_pylist()):
                if body is not None:
                    bodies[k] = body
            n = count[new].astype(np.int64)
            total, least = matcher(bodies, n, np.add.reduceat(rows, new), np.minimum.reduceat(first, new))
            begin = np.concatenate(([0], np.cumsum(n)))
            border = np.zeros(len(total), bool)
            border[begin[:-1]] = True
            low, high = _runs(total, least, border)
            owner = np.searchsorted(begin, low, "right") - 1  # runs per kind, then per member of the kind
            runs_of = np.bincount(owner, minlength=len(n))
            at = np.concatenate(([0], np.cumsum(runs_of)))
            member = np.repeat(np.arange(len(kind)), runs_of[kind])
            inner = np.arange(len(member)) - np.repeat(np.concatenate(([0], np.cumsum(runs_of[kind])))[:-1], runs_of[kind])
            r = at[kind[member]] + inner
            base = begin[kind[member]]
            take = pa.array(member)
            pick = lambda c: whole.column(c).combine_chunks().take(take)
            yield table(
                ["k1", "k2", "starts", "low", "high", "first", "own"],
                pick("k1"), pick("k2"), pick("starts"), low[r] - base, high[r] - base + size, least[low[r]], first[member],
            )

    return run


def _window_digests(windows: Windows):
    """Each window of a stretch by its digest and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "stretch", 1 << 14):
            bodies = part.column("stretch").to_pylist()
            data, _, starts, ends, at = windows.units(bodies)
            body, n = data.tobytes(), np.diff(at) - windows.size + 1
            window = np.concatenate([np.arange(a, a + k) for a, k in zip(at, n)])
            digest = b"".join(hashlib.blake2b(body[s:e], digest_size=16).digest() for s, e in zip(starts[window].tolist(), ends[window + windows.size - 1].tolist()))
            w = np.frombuffer(digest, np.int64).reshape(-1, 2)
            of = np.repeat(np.arange(len(bodies)), n)
            take = pa.array(of)
            yield table(
                ["w1", "w2", "h", "d1", "d2", "offset", "rows", "first"],
                w[:, 0], w[:, 1], *(part.column(c).take(take) for c in ("h", "d1", "d2")), window - at[of], part.column("rows").take(take), part.column("first").take(take),
            )

    return run


_PLACE = ["h", "d1", "d2"]


def _kinds(found: DataFrame) -> DataFrame:
    """The different stretches with all their rows added up, in tasks first."""
    return found.groupBy(*_PLACE).agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("windows").alias("windows"), F.max("stretch").alias("stretch"))


def _members(found: DataFrame, hits: DataFrame) -> DataFrame:
    """Spans of the texts from those of their stretches: (d1, d2, low, high, first)."""
    mine = found.select("d1", "d2", "k1", "k2", "starts", F.col("first").alias("own"))
    return mine.join(hits, ["d1", "d2"]).select("k1", "k2", "starts", "low", "high", "first", "own")


def _busy_spans(found: DataFrame, matcher: Matcher, windows: Windows) -> DataFrame:
    """Spans of anchors with many rows: their different stretches are matched, and the result joins the rows."""
    each = _kinds(found).select(*_PLACE, F.col("d1").alias("k1"), F.col("d2").alias("k2"), "rows", "first", F.array(F.lit(0).cast("long")).alias("starts"), "windows", "stretch")
    hits = each.repartition("h").sortWithinPartitions(*_PLACE).mapInArrow(_match(matcher, windows.size), _SPANS)
    return _members(found, hits.select(F.col("k1").alias("d1"), F.col("k2").alias("d2"), "low", "high", "first"))


def _crowded_spans(found: DataFrame, windows: Windows) -> DataFrame:
    """Spans of anchors with too many stretches for one place: windows are counted by digest, all over the cluster."""
    schema = "w1 long, w2 long, h long, d1 long, d2 long, offset long, rows long, first long"
    each = stored(_kinds(found).mapInArrow(_window_digests(windows), schema), "windows")
    twice = each.groupBy("w1", "w2").agg(F.sum("rows").alias("total"), F.min("first").alias("least")).filter("total > 1")
    hits = each.join(twice, ["w1", "w2"]).select("d1", "d2", F.col("offset").alias("low"), (F.col("offset") + windows.size).alias("high"), F.col("least").alias("first"))
    return _members(found, hits)


def spans(rows: DataFrame, windows: Windows, matcher: Matcher) -> DataFrame:
    """(k1, k2, starts, low, high, first, own): units of each text covered by windows that occur twice or more.

    For each of ``starts`` these are the units from start + low to start + high. ``rows`` comes from ``keyed``.
    ``first`` is the smallest doc_id in which each window of the range occurs, and ``own`` the smallest doc_id of the
    text itself; rows without a doc_id count as last.
    """
    anchors = stored(rows.select("k1", "k2", "text").mapInArrow(_anchors(windows), "h long, k1 long, k2 long, times int"), "anchors")
    twice = anchors.groupBy("h").agg(F.sum("times").alias("n")).filter("n > 1").select("h")
    wanted = anchors.join(twice, "h").groupBy(*KEY).agg(F.collect_set("h").alias("anchors"))
    copies = rows.groupBy(*KEY).agg(F.count("*").alias("rows"), F.coalesce(F.min("doc_id"), F.lit(int(NO_DOC))).alias("first"))
    wanted = wanted.join(copies, KEY)
    found = stored(with_texts(rows, wanted, "inner", _stretches(windows), _FOUND), "stretches")
    load = found.groupBy(*_PLACE).agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    load = stored(load.filter((F.col("kinds") > CROWD) | (F.col("n") > BUSY)), "load")
    quiet = found.join(load, "h", "left_anti").repartition("h").sortWithinPartitions(*_PLACE)
    busy, crowded = (found.join(load.filter(f"kinds {op} {CROWD}"), "h", "left_semi") for op in ("<=", ">"))
    return quiet.mapInArrow(_match(matcher, windows.size), _SPANS).union(_busy_spans(busy, matcher, windows)).union(_crowded_spans(crowded, windows))


def by_text(found: DataFrame) -> DataFrame:
    """(k1, k2, spans): what ``spans`` found, gathered per text."""
    return found.groupBy(*KEY).agg(F.collect_list(F.struct("starts", "low", "high")).alias("spans"))


def covered(found: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges of the spans of one text, joined where they overlap or touch."""
    out: list[list[int]] = []
    for s, e in sorted((s + x["low"], s + x["high"]) for x in found or () for s in x["starts"]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
