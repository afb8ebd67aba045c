"""Near-duplicate vectors by randomly rotated binary codes with correction factors.

A unit vector x is rotated at random; its code is the sign of each coordinate, s, and its correction factor is
f = <s, x> / sqrt(D). For another unit vector y, <s, y> / (sqrt(D) f) estimates the cosine without bias, and for a
true cosine of t the error is at most sqrt(1 - t^2) sqrt(1 - f^2) / f, mostly a factor sqrt(D - 1) smaller. Pairs
whose estimate plus its error bound is below the threshold are done; the others are recomputed exactly.

Candidate pairs share a band of code bits of several rotations. A pair at the threshold's angle shares a given bit
with probability 1 - angle / pi; band width follows the logarithm of the number of vectors, and the number of
bands is such that a pair is missed with a probability of at most MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.shared import stored
from .graph import components
from .texts import table

THRESHOLD = 0.98
MISS = 1e-6
CHUNK = 2048  # vectors of one band value that meet in one place; more are split into pairs of chunks
SMALL = 48  # vectors of one band value that are compared by shifting instead of as a matrix


def band_plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits per band and number of bands for groups of up to n vectors."""
    width = min(30, max(6, math.ceil(math.log2(max(n, 1) / 8 + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(MISS) / math.log1p(-same))


@lru_cache(maxsize=4)
def rotations(dim: int, columns: int) -> np.ndarray:
    """Random orthogonal matrices side by side, cut to so many columns."""
    draw = np.random.default_rng([dim, 20])
    parts = []
    for _ in range(-(-columns // dim)):
        q, r = np.linalg.qr(draw.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1)[:, : max(columns, dim)]


def band_values(unit: np.ndarray, width: int, bands: int) -> np.ndarray:
    bits = unit @ rotations(unit.shape[1], width * bands)[:, : width * bands] > 0
    return bits.reshape(len(unit), bands, width) @ (1 << np.arange(width, dtype=np.int64))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-300)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Coded:
    """Unit vectors with their rotated form, codes and error bounds."""

    def __init__(self, vectors: np.ndarray, width: int, bands: int, threshold: float, epsilon: float | None):
        self.unit, self.bands, self.threshold = unit_rows(vectors), None, threshold
        dim = self.unit.shape[1]
        self.bands = band_values(self.unit, width, bands)
        rotated = self.unit @ rotations(dim, width * bands)[:, :dim]
        sign = np.where(rotated > 0, 1.0, -1.0)
        factor = np.maximum((sign * rotated).sum(axis=1) / math.sqrt(dim), 1e-9)
        self.rotated, self.estimator = rotated.astype(np.float32), (sign / (math.sqrt(dim) * factor[:, None])).astype(np.float32)
        certain = math.sqrt(max(dim - 1, 1))
        spread = math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(1 - factor**2, 0)) / factor
        self.least = threshold - spread * (epsilon if epsilon is not None else certain) / certain - 1e-4

    def linked(self, a: np.ndarray, b: np.ndarray, band: np.ndarray | int) -> np.ndarray:
        """Which pairs are linked and share no band before ``band``, so that a pair counts in one place only."""
        maybe = np.flatnonzero(np.einsum("ij,ij->i", self.estimator[a], self.rotated[b]) >= self.least[a])
        exact = np.einsum("ij,ij->i", self.unit[a[maybe]], self.unit[b[maybe]]) >= self.threshold
        return self._first(a, b, maybe[exact], band)

    def linked_block(self, rows: slice, columns: slice, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs between two ranges of vectors, the row before the column."""
        i, j = np.nonzero(self.estimator[rows] @ self.rotated[columns].T >= self.least[rows, None])
        a, b = i + rows.start, j + columns.start
        keep = a < b
        a, b = a[keep], b[keep]
        good = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 17):
            part = slice(k, k + (1 << 17))
            good[part] = np.einsum("ij,ij->i", self.unit[a[part]], self.unit[b[part]]) >= self.threshold
        at = self._first(a, b, np.flatnonzero(good), band)
        return a[at], b[at]

    def _first(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, band: np.ndarray | int) -> np.ndarray:
        out = []
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            same = self.bands[a[part]] == self.bands[b[part]]
            out.append(part[same.argmax(axis=1) == (band[part] if isinstance(band, np.ndarray) else band)])
        return np.concatenate(out) if out else at


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 pairs that connect what the pairs (a, b) connect."""
    label = np.arange(n)
    while len(a):
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _meet(width: int, bands: int, threshold: float, epsilon: float | None, dtype: str):
    """Sorted rows (key, i, j, band, chunk, node, copies, vector) to counts of links and links that connect them."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) < 4096:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = np.stack([whole.column(c).to_numpy() for c in ("key", "i", "j")])
            start = int(np.flatnonzero((ids == ids[:, -1:]).all(axis=0))[0])  # the last group may go on
            if start:
                yield whole.slice(0, start), ids[:, :start]
            held = [whole.slice(start)]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield whole, np.stack([whole.column(c).to_numpy() for c in ("key", "i", "j")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, ids in runs(batches):
            node, copies, band, chunk = (whole.column(c).to_numpy() for c in ("node", "copies", "band", "chunk"))
            size = pc.binary_length(whole.column("vector")).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0))))
            length = np.diff(np.append(new, len(node)))
            links = np.zeros(len(node), np.int64)
            ends: list[tuple[np.ndarray, np.ndarray]] = []
            for dim in np.unique(size):  # vectors of one group have one length
                mine = np.flatnonzero(size == dim)
                vectors = np.frombuffer(b"".join(whole.column("vector").take(pa.array(mine)).to_pylist()), dtype).reshape(len(mine), -1)
                of = Coded(vectors, width, bands, threshold, epsilon)
                first = np.searchsorted(mine, new[size[new] == dim])
                count = length[size[new] == dim]

                def found(a: np.ndarray, b: np.ndarray) -> None:
                    np.add.at(links, mine[a], copies[mine[b]])
                    np.add.at(links, mine[b], copies[mine[a]])

                few = count <= SMALL
                left = np.repeat(np.where(few, count, 0), count) - (np.arange(len(mine)) - np.repeat(first, count))
                for shift in range(1, int(count[few].max(initial=0))):
                    a = np.flatnonzero(left > shift)
                    b = a + shift
                    at = of.linked(a, b, band[mine[a]])
                    at = at[_across(ids, chunk, mine[a[at]], mine[b[at]])]
                    found(a[at], b[at])
                    ends.append((node[mine[a[at]]], node[mine[b[at]]]))
                for s, n in zip(first[~few].tolist(), count[~few].tolist()):
                    pairs = [of.linked_block(slice(x, min(x + 512, s + n)), slice(y, min(y + 512, s + n)), int(band[mine[s]])) for x in range(s, s + n, 512) for y in range(x, s + n, 512)]
                    a, b = (np.concatenate(p) for p in zip(*pairs))
                    good = _across(ids, chunk, mine[a], mine[b])
                    a, b = a[good], b[good]
                    found(a, b)
                    x, y = _forest(n, a - s, b - s)
                    ends.append((node[mine[x + s]], node[mine[y + s]]))
            some = np.flatnonzero(links)
            a = np.concatenate([node[some], *(x for x, _ in ends)])
            b = np.concatenate([np.full(len(some), -1), *(y for _, y in ends)]).astype(np.int64)
            yield table(["a", "b", "n"], a, b, np.concatenate([links[some], np.zeros(len(a) - len(some), np.int64)]))

    return run


def _across(ids: np.ndarray, chunk: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair belongs to this pair of chunks (i, j): one member of each."""
    low, high = np.minimum(chunk[a], chunk[b]), np.maximum(chunk[a], chunk[b])
    return (ids[1, a] == low) & (ids[2, a] == high)


def _bytes(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            column = column.cast(pa.list_(pa.float32() if dtype == "<f4" else pa.float64()))
            offsets, values = column.offsets.to_numpy(), column.values
            missing = np.concatenate(([0], np.cumsum(pc.is_null(values).to_numpy(zero_copy_only=False))))
            values = values.to_numpy(zero_copy_only=False).astype(dtype)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
            some = np.concatenate(([0], np.cumsum(values != 0)))
            out = []
            for k, null in enumerate(pc.is_null(column).to_pylist()):
                s, e = offsets[k], offsets[k + 1]
                good = not null and missing[e] == missing[s] and bad[e] == bad[s] and some[e] > some[s]
                out.append(values[s:e].tobytes() if good else None)
            yield table(["vec_id", "label", "vector"], batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary()))

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, epsilon: float | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links join vectors of equal label and cosine >= threshold.

    Equal vectors of a label are one node with a number of copies, so copies never form pairs. Nodes are dealt by
    (label, length, band, band value); a value with more than CHUNK nodes is split into pairs of chunks. A linked
    pair counts only under its first common band, so partial counts add up, and of a dense group only links that
    connect it leave a task. ``epsilon`` shrinks the certain error bound to a confidence bound of that many
    standard widths; the default loses nothing. Vectors that are null, empty, zero or hold null or non-finite
    numbers, and those without a label, link with nothing, not even with copies; vectors of different length never link.
    Null vec_ids take part but name no component; such rows are not kept. Repeated rows count as vectors of their own.
    """
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    dtype = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    rows = stored(rows.mapInArrow(_bytes(dtype), "vec_id long, label string, vector binary"), "vectors")
    valid = rows.filter("label is not null and vector is not null")
    nodes = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    width, bands = band_plan(most, threshold)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                data = part.column("vector").to_pylist()
                for size in sorted({len(d) for d in data}):
                    mine = np.array([k for k, d in enumerate(data) if len(d) == size])
                    values = band_values(unit_rows(np.frombuffer(b"".join(data[k] for k in mine), dtype).reshape(len(mine), -1)), width, bands)
                    take = pa.array(np.repeat(mine, bands))
                    yield table(
                        ["label", "size", "band", "value", "node", "copies", "vector"],
                        part.column("label").take(take), np.full(len(take), size), np.tile(np.arange(bands), len(mine)), values.ravel(),
                        *(part.column(c).take(take) for c in ("node", "copies", "vector")),
                    )

    place = ["label", "size", "band", "value"]
    dealt = nodes.select("label", "node", "copies", "vector").mapInArrow(keyed, "label string, size long, band long, value long, node long, copies long, vector binary")
    crowded = nodes.select("label", "node", "copies", "vector").mapInArrow(keyed, dealt.schema).groupBy(*place).count().filter(F.col("count") > CHUNK)
    dealt = dealt.join(crowded, place, "left").withColumn("chunks", F.coalesce(F.ceil(F.col("count") / CHUNK), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(F.xxhash64(*place).alias("key"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), *place, "chunk", "node", "copies", "vector")
    groups = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", *place)
    met = stored(groups.drop("label", "size", "value").mapInArrow(_meet(width, bands, threshold, epsilon, dtype), "a long, b long, n long"), "met")
    counts = met.filter("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    found = components(met.filter("b >= 0").select("a", "b")).withColumnRenamed("node", "member")
    named = nodes.join(found, F.col("node") == F.col("member"), "left").join(counts, "node", "left")
    named = named.select("label", "vector", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = rows.join(named.drop("least").join(smallest, "component"), ["label", "vector"], "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
