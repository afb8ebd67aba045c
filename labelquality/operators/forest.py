"""Random forests whose trees are grown, kept and asked in tasks; the driver holds thresholds and the few decisions above the parts.

The rules are those of Spark's forest: thresholds at 31 quantiles of each feature, Poisson weights of rows per tree,
a draw of features per node, Gini gain, no decision without gain, and leaves that agree joined with their parent.
A tree of all rows has about as many nodes as rows, so none is brought to one place:

* Rows become bytes, one bin number per feature. Rows of equal bins are one key with its counts; a Poisson draw with
  the count as its mean is the sum of the draws of its rows.
* Keys are packed into chunks and stored. Weights are drawn from seed, tree and chunk, so each pass sees the same ones.
* Nodes of more than ``KEYS_PER_PART`` keys are decided level by level from summed histograms. Each smaller one is a
  part: its keys go to one task, which grows all below it and writes it as one row.
* To score, chunks go to the parts they fall into, and the votes go back to the chunk and are added in tree order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.shared import stored
from .curves import accumulated

KEYS_PER_PART = 500_000
KEYS_PER_CHUNK = 4096
CHUNKS_PER_TASK = 16
NODES_AT_ONCE = 1024

_CHUNK = "chunk binary, bins binary, n0 binary, n1 binary"
_BAG = "tree int, node long, bins binary, weights binary"
_SUMS = "tree int, node long, sums binary"
_SPLIT = "tree int, node long, feature int, cut int, gain double, n0 long, n1 long, left0 long, left1 long, left_keys long, right_keys long"
_PART = "tree int, node long, size int, n0 long, n1 long, feature int, cut int, gain double, features binary, cuts binary, lefts binary, shares binary"


@dataclass(frozen=True)
class Rules:
    """Settings of a forest that tasks need; names are those of Spark's forest."""

    features: int
    numTrees: int = 20
    maxDepth: int = 5
    maxBins: int = 32
    seed: int = 0
    featureSubsetStrategy: str = "auto"
    bootstrap: bool = True
    subsamplingRate: float = 1.0
    minInstancesPerNode: int = 1
    minInfoGain: float = 0.0

    def __post_init__(self) -> None:
        within = {
            "numTrees": self.numTrees >= 1, "maxDepth": 0 <= self.maxDepth <= 30, "maxBins": 2 <= self.maxBins <= 65536,
            "subsamplingRate": 0 < self.subsamplingRate <= 1, "minInstancesPerNode": self.minInstancesPerNode >= 1, "minInfoGain": self.minInfoGain >= 0,
            "featureSubsetStrategy": 1 <= self.drawn <= self.features,
        }
        for name, good in within.items():
            if not good:
                raise ValueError(f"{name} cannot be {getattr(self, name)}")

    @property
    def bins(self) -> np.dtype:
        return np.dtype(np.uint8 if self.maxBins <= 256 else np.uint16)

    @property
    def drawn(self) -> int:
        """Features drawn per node."""
        name, n = str(self.featureSubsetStrategy).lower(), self.features
        if name == "auto":
            name = "all" if self.numTrees == 1 else "sqrt"
        known = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}
        if name in known:
            return known[name]
        return min(n, int(name)) if name.isdigit() else math.ceil(float(name) * n)


SETTINGS = {name for name in Rules.__dataclass_fields__ if name != "features"}


# --- arrays ---


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a + b
    p, q = a / n, b / n
    return 1.0 - p * p - q * q


def _hash(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def features_of(nodes: np.ndarray, tree: int, rules: Rules) -> np.ndarray:
    """The features drawn for each node, in ascending order; they follow from seed, tree and node."""
    if rules.drawn >= rules.features:
        return np.tile(np.arange(rules.features), (len(nodes), 1))
    start = _hash(_hash(np.array([rules.seed & (2**64 - 1)], np.uint64)) + np.uint64(tree))
    order = _hash(_hash(start + nodes.astype(np.uint64))[:, None] + np.arange(rules.features, dtype=np.uint64))
    return np.sort(np.argpartition(order, rules.drawn - 1, axis=1)[:, : rules.drawn], axis=1)


def _histogram(at: np.ndarray, bins: np.ndarray, weights: list[np.ndarray], drawn: np.ndarray, rules: Rules) -> np.ndarray:
    """Sums of each weight by node, drawn feature and bin; ``at`` is the place of a row's node in ``drawn``."""
    nodes, k = drawn.shape
    out = np.empty((len(weights), nodes * k * rules.maxBins))
    slot = (at[:, None] * k + np.arange(k)) * rules.maxBins + bins[np.arange(len(at))[:, None], drawn[at]]
    for i, w in enumerate(weights):
        out[i] = np.bincount(slot.ravel(), np.repeat(w, k), out.shape[1])
    return out.reshape(len(weights), nodes, k, rules.maxBins)


def _decide(sums: np.ndarray, drawn: np.ndarray, rules: Rules) -> tuple[np.ndarray, ...]:
    """Per node: best feature (-1 for none), last bin of its left side, gain, and all sums of the left side."""
    left = np.cumsum(sums, axis=3)
    total = left[:, :, :1, -1:]
    a0, a1 = left[0, :, :, :-1], left[1, :, :, :-1]
    b0, b1 = total[0] - a0, total[1] - a1
    with np.errstate(invalid="ignore", divide="ignore"):
        n = total[0] + total[1]
        gain = _gini(total[0], total[1]) - (a0 + a1) / n * _gini(a0, a1) - (b0 + b1) / n * _gini(b0, b1)
    enough = np.minimum(a0 + a1, b0 + b1) >= max(1, rules.minInstancesPerNode)
    gain = np.where(enough & (gain >= rules.minInfoGain), gain, -np.inf).reshape(len(drawn), -1)
    best, each = gain.argmax(1), np.arange(len(drawn))
    slot, cut = np.divmod(best, rules.maxBins - 1)
    gain = gain[each, best]
    return np.where(gain > 0, drawn[each, slot], -1), cut, gain, left[:, each, slot, cut]


def walk(bins: np.ndarray, features: np.ndarray, cuts: np.ndarray, lefts: np.ndarray) -> np.ndarray:
    """The node each row ends in, going down from node 0."""
    at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(live):
        f = features[at[live]]
        live, f = live[f >= 0], f[f >= 0]
        here = at[live]
        at[live] = lefts[here] + (bins[live, f] > cuts[here])
    return at


def _share(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Share of the second class; NaN where nothing was drawn, which is no vote."""
    with np.errstate(invalid="ignore"):
        return n1 / (n0 + n1)


def grow(bins: np.ndarray, weights: np.ndarray, tree: int, root: int, rules: Rules) -> dict[str, np.ndarray]:
    """Everything below node ``root``, from its rows: arrays over nodes, level by level, brothers side by side."""
    nodes, counts = np.array([root], np.int64), weights.sum(0, keepdims=True).astype(np.float64)
    rows, ends, levels, made = np.arange(len(bins)), np.array([0, len(bins)]), [], 1
    w0, w1 = weights[:, 0].astype(np.float64), weights[:, 1].astype(np.float64)
    depth = root.bit_length() - 1
    while len(nodes):
        m = len(nodes)
        feature, cut, gain, left = np.full(m, -1), np.zeros(m, np.int64), np.zeros(m), np.zeros((m, 2))
        if depth < rules.maxDepth:
            for start in range(0, m, NODES_AT_ONCE):
                part = slice(start, min(start + NODES_AT_ONCE, m))
                mine, drawn = rows[ends[part.start] : ends[part.stop]], features_of(nodes[part], tree, rules)
                at = np.repeat(np.arange(len(drawn)), np.diff(ends[part.start : part.stop + 1]))
                sums = _histogram(at, bins[mine], [w0[mine], w1[mine]], drawn, rules)
                feature[part], cut[part], gain[part], sides = _decide(sums, drawn, rules)
                left[part] = sides.T
        split = feature >= 0
        below = np.where(split, made + 2 * (np.cumsum(split) - 1), 0)
        levels.append((feature, cut, below, counts, gain))
        made += 2 * int(split.sum())
        # Rows of decided nodes stay in order of nodes: those of a left side, then those of the right.
        at = np.repeat(np.arange(m), np.diff(ends))
        keep = split[at]
        rows, at = rows[keep], at[keep]
        side = 2 * (np.cumsum(split) - 1)[at] + (bins[rows, feature[at]] > cut[at])
        rows = rows[np.argsort(side, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(side, minlength=2 * int(split.sum())))])
        nodes = (2 * nodes[split][:, None] + np.arange(2)).ravel()
        counts = np.stack([left[split], counts[split] - left[split]], 1).reshape(-1, 2)
        depth += 1
    return _pruned(levels)


def _pruned(levels: list[tuple[np.ndarray, ...]]) -> dict[str, np.ndarray]:
    """Leaves that agree are joined with their parent, from the lowest up; what is left is numbered anew."""
    starts = np.cumsum([0] + [len(level[0]) for level in levels])
    feature, cut, below, counts, gain = (np.concatenate(x) for x in zip(*levels))
    says = counts[:, 1] > counts[:, 0]
    for start, stop in zip(starts[-2::-1], starts[:0:-1]):
        here = start + np.flatnonzero(feature[start:stop] >= 0)
        a, b = below[here], below[here] + 1
        feature[here[(feature[a] < 0) & (feature[b] < 0) & (says[a] == says[b])]] = -1
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for start, stop in zip(starts[:-1], starts[1:]):
        here = start + np.flatnonzero(kept[start:stop] & (feature[start:stop] >= 0))
        kept[below[here]] = kept[below[here] + 1] = True
    place = np.cumsum(kept) - 1
    lefts = np.where(feature >= 0, place[below], 0)[kept]
    return {"features": feature[kept], "cuts": cut[kept], "lefts": lefts, "counts": counts[kept], "gain": gain[:1]}


# --- stored rows ---


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as hold the largest."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _whole(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64)


def _matrix(data: bytes, rules: Rules) -> np.ndarray:
    return np.frombuffer(data, rules.bins).reshape(-1, rules.features)


def _binned(x, thresholds: list[np.ndarray], rules: Rules):
    """Column of keys: the bytes of the bin numbers of the features, which are doubles in an array column."""

    def bins(column: pa.Array) -> pa.Array:
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, rules.features)
        out = np.empty(values.shape, rules.bins)
        for j, t in enumerate(thresholds):
            out[:, j] = np.searchsorted(t, values[:, j])
        width = rules.features * rules.bins.itemsize
        return pa.Array.from_buffers(pa.binary(width), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())

    return F.arrow_udf(bins, "binary")(x)


def _chunks(keys: DataFrame) -> tuple[DataFrame, int]:
    """Distinct keys with their counts, packed into stored rows that are named by their content, and the number of keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, KEYS_PER_CHUNK):
                part = batch.slice(start, KEYS_PER_CHUNK)
                bins = b"".join(part.column(0).to_pylist())
                counts = [_small(part.column(c).to_numpy()) for c in (1, 2)]
                yield _batch(_CHUNK + ", size int", [(hashlib.blake2b(bins, digest_size=16).digest(), bins, *counts, part.num_rows)])

    table = stored(keys.sortWithinPartitions("key").mapInArrow(pack, _CHUNK + ", size int"), "forest-keys")
    return table, table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def _dealt(chunks: DataFrame, size: int) -> DataFrame:
    return chunks.repartition(max(1, -(-size // (KEYS_PER_CHUNK * CHUNKS_PER_TASK))), "chunk")


def _drawn(name: bytes, tree: int, counts: np.ndarray, rules: Rules) -> np.ndarray:
    """How often a tree drew the rows of each key, by class."""
    if not rules.bootstrap and rules.subsamplingRate >= 1.0:
        return counts
    rng = np.random.default_rng([rules.seed & (2**64 - 1), tree, *np.frombuffer(name, np.uint32).tolist()])
    if rules.bootstrap:
        return rng.poisson(counts * rules.subsamplingRate)
    return rng.binomial(counts, rules.subsamplingRate)


class Top:
    """The decisions of a tree above its parts. Nodes that have no decision (yet) are those where rows come to lie."""

    def __init__(self) -> None:
        self.nodes, self.features, self.cuts, self.lefts, self.gains, self.counts = [1], [-1], [0], [0], [0.0], [None]

    def split(self, at: int, feature: int, cut: int, gain: float, sides: list[tuple[int, int]]) -> None:
        self.features[at], self.cuts[at], self.gains[at], self.lefts[at] = feature, cut, gain, len(self.nodes)
        for side, counts in enumerate(sides):
            for name, value in zip(("nodes", "features", "cuts", "lefts", "gains", "counts"), (2 * self.nodes[at] + side, -1, 0, 0, 0.0, counts)):
                getattr(self, name).append(value)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in (self.nodes, self.features, self.cuts, self.lefts))

    def ends(self) -> list[int]:
        """Places of the nodes without a decision that the root leads to."""
        found, look = [], [0]
        while look:
            at = look.pop()
            if self.features[at] < 0:
                found.append(at)
            else:
                look += [self.lefts[at], self.lefts[at] + 1]
        return found

    def join(self, leaf: set[int]) -> None:
        """Leaves that agree are joined with their parent; ``leaf`` holds the places of parts that are one leaf."""
        for at in range(len(self.nodes) - 1, -1, -1):
            if self.features[at] >= 0:
                pair = [self.lefts[at], self.lefts[at] + 1]
                if leaf.issuperset(pair) and len({self.counts[x][1] > self.counts[x][0] for x in pair}) == 1:
                    self.features[at] = -1
                    leaf.add(at)


def _falls(bins: np.ndarray, top: tuple[np.ndarray, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """Node and rows of each node that rows fall into."""
    nodes, *decisions = top
    at = walk(bins, *decisions)
    for place in np.unique(at):
        yield int(nodes[place]), np.flatnonzero(at == place)


def _sums(chunks: DataFrame, tops: list[tuple], open_nodes: list[list[int]], rules: Rules) -> DataFrame:
    """Histograms of the open nodes of each tree: weights of both classes, and drawn keys."""

    def add(batches):
        found = {}
        for batch in batches:
            for row in batch.to_pylist():
                bins = _matrix(row["bins"], rules)
                counts = np.stack([_whole(row[c], len(bins)) for c in ("n0", "n1")], 1)
                for tree, wanted in enumerate(open_nodes):
                    if not wanted:
                        continue
                    w = _drawn(row["chunk"], tree, counts, rules)
                    some = np.flatnonzero(w.any(1))
                    for node, rows in _falls(bins[some], tops[tree]):
                        if node in wanted:
                            mine = some[rows]
                            each = [w[mine, 0], w[mine, 1], np.ones(len(mine))]
                            sums = _histogram(np.zeros(len(mine), np.int64), bins[mine], each, features_of(np.array([node]), tree, rules), rules)
                            found[tree, node] = found.get((tree, node), 0) + sums
        yield _batch(_SUMS, [(*key, sums.tobytes()) for key, sums in found.items()])

    return chunks.mapInArrow(add, _SUMS)


def _splits(sums: DataFrame, rules: Rules) -> DataFrame:
    def decide(table: pa.Table) -> pa.Table:
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        total = sum(np.frombuffer(x) for x in table["sums"].to_pylist()).reshape(3, 1, -1, rules.maxBins)
        drawn = features_of(np.array([node]), tree, rules)
        feature, cut, gain, left = _decide(total, drawn, rules)
        all0, all1, keys = total[:, 0, 0].sum(1)
        left0, left1, left_keys = left[:, 0]
        if node.bit_length() > rules.maxDepth:
            feature = [-1]
        row = (tree, node, int(feature[0]), int(cut[0]), float(gain[0]), *map(int, (all0, all1, left0, left1, left_keys, keys - left_keys)))
        return pa.Table.from_batches([_batch(_SPLIT, [row])])

    return sums.groupBy("tree", "node").applyInArrow(decide, _SPLIT)


def _tops(chunks: DataFrame, size: int, rules: Rules, keys_per_part: int) -> tuple[list[Top], set[tuple[int, int]]]:
    """Decide nodes of more than ``keys_per_part`` keys, a pass for each level. Also the places of large nodes that no feature divides."""
    tops, leaves = [Top() for _ in range(rules.numTrees)], set()
    large = {(tree, 0) for tree in range(rules.numTrees)} if size > keys_per_part else set()
    while large:
        wanted = [[top.nodes[at] for at in range(len(top.nodes)) if (tree, at) in large] for tree, top in enumerate(tops)]
        place = {(tree, tops[tree].nodes[at]): at for tree, at in large}
        found = _splits(_sums(_dealt(chunks, size), [t.arrays() for t in tops], wanted, rules), rules).collect()
        large = set()
        for r in found:
            top, at = tops[r["tree"]], place[r["tree"], r["node"]]
            top.counts[at] = (r["n0"], r["n1"])
            if r["feature"] < 0:
                leaves.add((r["tree"], at))
                continue
            top.split(at, r["feature"], r["cut"], r["gain"], [(r["left0"], r["left1"]), (r["n0"] - r["left0"], r["n1"] - r["left1"])])
            large |= {(r["tree"], top.lefts[at] + side) for side, n in enumerate((r["left_keys"], r["right_keys"])) if n > keys_per_part}
    return tops, leaves


def _bags(chunks: DataFrame, tops: list[tuple], skip: set[tuple[int, int]], rules: Rules) -> DataFrame:
    """The drawn keys of each tree with their weights, by the part they fall into."""

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bins, out = _matrix(row["bins"], rules), []
                counts = np.stack([_whole(row[c], len(bins)) for c in ("n0", "n1")], 1)
                for tree, top in enumerate(tops):
                    w = _drawn(row["chunk"], tree, counts, rules)
                    some = np.flatnonzero(w.any(1))
                    for node, rows in _falls(bins[some], top):
                        if (tree, node) not in skip:
                            out.append((tree, node, bins[some[rows]].tobytes(), _small(w[some[rows]])))
                yield _batch(_BAG, out)

    return chunks.mapInArrow(deal, _BAG)


def _part_row(tree: int, node: int, counts: np.ndarray, features: np.ndarray, cuts: np.ndarray, lefts: np.ndarray, gain: float) -> tuple:
    n0, n1 = map(int, counts[0])
    packed = (features.astype(np.int16).tobytes(), cuts.astype(np.uint16).tobytes(), lefts.astype(np.int32).tobytes(), _share(counts[:, 0], counts[:, 1]).tobytes())
    return tree, node, len(features), n0, n1, int(features[0]), int(cuts[0]), float(gain), *packed


def _grown(bags: DataFrame, parts: int, rules: Rules) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        bins = [_matrix(x, rules) for x in table["bins"].to_pylist()]
        weights = [_whole(w, 2 * len(b)).reshape(-1, 2) for w, b in zip(table["weights"].to_pylist(), bins)]
        g = grow(np.concatenate(bins), np.concatenate(weights), tree, node, rules)
        return pa.Table.from_batches([_batch(_PART, [_part_row(tree, node, g["counts"], g["features"], g["cuts"], g["lefts"], g["gain"][0])])])

    return bags.repartition(parts, "tree", "node").groupBy("tree", "node").applyInArrow(build, _PART)


def _thresholds(x: DataFrame, rules: Rules) -> list[np.ndarray]:
    """Per feature halfway between neighbouring values: all of them if they are few, else those nearest to every part of the rows."""
    values = x.select(F.posexplode("x").alias("feature", "score")).groupBy("feature", "score").agg(F.count("*").alias("pos"), F.lit(1).cast("long").alias("neg"))
    values = stored(values, "forest-values")
    kinds = {r["feature"]: (r["m"], r["n"]) for r in values.groupBy("feature").agg(F.count("*").alias("m"), F.sum("pos").alias("n")).collect()}
    few = [j for j, (m, _) in kinds.items() if m <= rules.maxBins]
    all_values = {j: [] for j in few}
    for r in values.filter(F.col("feature").isin(few)).select("feature", "score").collect():
        all_values[r["feature"]].append(r["score"])
    out = []
    for j in range(rules.features):
        m, n = kinds[j]
        if j in all_values:
            v = np.sort(np.array(all_values[j]))
            out.append((v[:-1] + v[1:]) / 2.0)
            continue
        acc = accumulated(values.filter(F.col("feature") == j).select("score", "pos", "neg"))
        # Rows up to a value, and the number of values below it.
        acc = acc.select("score", "pos", (F.col("positives") - F.col("tp") + F.col("pos")).alias("c"), (F.col("negatives") - F.col("fp")).alias("i"))
        stride = n / rules.maxBins
        goals = [stride]
        while len(goals) < rules.maxBins - 1:
            goals.append(goals[-1] + stride)
        past = [F.min(F.when(F.abs(F.col("c") - F.col("pos") - t) < F.abs(F.col("c") - t), F.col("i"))).alias(f"g{k}") for k, t in enumerate(goals)]
        first = acc.filter("i > 0").agg(*past).first()
        places, last = [], 0
        for i in first:
            last = max(last + 1, i) if i is not None else m
            if last >= m:
                break
            places.append(last)
        wanted = sorted({i - 1 for i in places} | set(places))
        v = {r["i"]: r["score"] for r in acc.filter(F.col("i").isin(wanted)).select("i", "score").collect()}
        out.append(np.array([(v[i - 1] + v[i]) / 2.0 for i in places]))
    return out


# --- learner and model ---


class Forest(Estimator):
    """Learner for a vector column and a label of 0 and 1."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", keys_per_part: int = KEYS_PER_PART, **settings) -> None:
        super().__init__()
        unknown = set(settings) - SETTINGS
        if unknown:
            raise ValueError(f"Unknown settings: {sorted(unknown)}")
        self.columns, self.keys_per_part, self.settings = (featuresCol, labelCol), keys_per_part, settings

    def _fit(self, df: DataFrame) -> ForestModel:
        vector, label = self.columns
        rows = df.select(vector_to_array(vector).alias("x"), F.col(label).cast("double").alias("y"))
        seen = rows.agg(F.max(F.size("x")), F.bool_and(F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(False)))).first()
        if seen[0] is None:
            raise ValueError("No rows to learn from")
        if not seen[1]:
            raise ValueError("Labels must be 0 or 1")
        rules = Rules(features=seen[0], **self.settings)
        thresholds = _thresholds(rows, rules)
        keyed = rows.select(_binned(F.col("x"), thresholds, rules).alias("key"), "y")
        chunks, size = _chunks(keyed.groupBy("key").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")))
        tops, large_leaves = _tops(chunks, size, rules, self.keys_per_part)
        skip = {(tree, tops[tree].nodes[at]) for tree, at in large_leaves}
        arrays = [top.arrays() for top in tops]
        parts = sum(len(top.ends()) for top in tops)
        grown = stored(_grown(_bags(_dealt(chunks, size), arrays, skip, rules), parts, rules), "forest-parts")
        leaves = {}
        sizes = {(r["tree"], r["node"]): (r["size"], r["n0"], r["n1"]) for r in grown.select("tree", "node", "size", "n0", "n1").collect()}
        for tree, top in enumerate(tops):
            leaf = set()
            for at in top.ends():
                n, *counts = sizes.get((tree, top.nodes[at]), (0, *(top.counts[at] or (0, 0))))
                top.counts[at] = tuple(counts)
                if n <= 1:
                    leaf.add(at)
            top.join(leaf)
            leaves |= {(tree, top.nodes[at]): top.counts[at] for at in leaf.intersection(top.ends()) if (tree, top.nodes[at]) not in sizes}
        none = np.zeros(1, np.int64)
        single = [_part_row(*key, np.array([counts]), none - 1, none, none, 0.0) for key, counts in leaves.items()]
        table = grown.unionByName(df.sparkSession.createDataFrame(single, _PART)) if single else grown
        return ForestModel(rules, thresholds, [(*t.arrays(), t.gains[0]) for t in tops], table, vector)


class ForestModel(Model, MLWritable, MLReadable):
    """A fitted forest: thresholds, the decisions above the parts, and the stored table of the parts."""

    def __init__(self, rules: Rules, thresholds: list[np.ndarray], tops: list[tuple], table: DataFrame, vector: str) -> None:
        super().__init__()
        self.rules, self.thresholds, self.tops, self.table, self.vector = rules, thresholds, tops, table, vector

    def roots(self) -> list[tuple[int, float, float] | None]:
        """(feature, threshold, gain) of the first decision of every tree; None for a single leaf."""
        below = {r["tree"]: (r["feature"], r["cut"], r["gain"]) for r in self.table.filter("node = 1").select("tree", "feature", "cut", "gain").collect()}
        above = [(int(top[1][0]), int(top[2][0]), top[4]) for top in self.tops]
        found = [a if a[0] >= 0 else below[tree] for tree, a in enumerate(above)]
        return [(f, float(self.thresholds[f][cut]), gain) if f >= 0 else None for f, cut, gain in found]

    def _votes(self, chunks: DataFrame) -> DataFrame:
        """What each tree says on the keys of each chunk; a task takes the rows of a part after the part itself."""
        rules, tops = self.rules, [top[:4] for top in self.tops]
        routed, said = "tree int, node long, chunk binary, bins binary, places binary", "chunk binary, tree int, node long, places binary, value binary"

        def route(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    bins = _matrix(row["bins"], rules)
                    out = [
                        (tree, node, row["chunk"], bins[rows].tobytes(), rows.astype(np.uint16).tobytes())
                        for tree, top in enumerate(tops)
                        for node, rows in _falls(bins, top)
                    ]
                    yield _batch(routed, out)

        def ask(batches):
            part = None
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    tree, node, chunk, bins, places, *arrays = (batch.column(c)[i].as_py() for c in range(batch.num_columns))
                    if chunk is None:
                        part = [np.frombuffer(a, kind) for a, kind in zip(arrays, (np.int16, np.uint16, np.int32, np.float64))]
                        continue
                    features, cuts, lefts, shares = part
                    out.append((chunk, tree, node, places, shares[walk(_matrix(bins, rules), features, cuts, lefts)].tobytes()))
                yield _batch(said, out)

        arrays = ["features", "cuts", "lefts", "shares"]
        asked = chunks.mapInArrow(route, routed).select("*", *[F.lit(None).cast("binary").alias(c) for c in arrays])
        parts = self.table.select("tree", "node", *[F.lit(None).cast("binary").alias(c) for c in ("chunk", "bins", "places")], *arrays)
        number = sum(int((top[1] < 0).sum()) for top in self.tops)
        both = parts.unionByName(asked).repartition(number, "tree", "node").sortWithinPartitions("tree", "node", F.asc_nulls_first("chunk"))
        return both.mapInArrow(ask, said)

    def _scores(self, keys: DataFrame) -> DataFrame:
        """Stored table of keys with the sum of shares over the trees and the number of trees that vote."""
        rules, schema = self.rules, "key binary, share double, votes long"
        chunks, size = _chunks(keys)
        dealt = _dealt(chunks, size)
        own = dealt.select("chunk", F.lit(-1).alias("tree"), F.lit(0).cast("long").alias("node"), F.lit(None).cast("binary").alias("places"), F.col("bins").alias("value"))
        order = ("chunk", "tree", "node")
        together = _dealt(own.unionByName(self._votes(dealt)), size).sortWithinPartitions(*order)

        def add(batches):
            bins = total = votes = None

            def done():
                width = bins.shape[1] * bins.itemsize
                keys = pa.Array.from_buffers(pa.binary(width), len(bins), [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
                return pa.RecordBatch.from_arrays([keys, pa.array(total), pa.array(votes)], ["key", "share", "votes"])

            for batch in batches:
                for i in range(batch.num_rows):
                    tree, places, value = (batch.column(c)[i].as_py() for c in (1, 3, 4))
                    if tree < 0:
                        if bins is not None:
                            yield done()
                        bins = _matrix(value, rules)
                        total, votes = np.zeros(len(bins)), np.zeros(len(bins), np.int64)
                        continue
                    at, share = np.frombuffer(places, np.uint16), np.frombuffer(value)
                    total[at] += np.nan_to_num(share)
                    votes[at] += ~np.isnan(share)
            if bins is not None:
                yield done()

        return stored(together.mapInArrow(add, schema), "forest-scores")

    def _transform(self, df: DataFrame) -> DataFrame:
        """Scores every distinct key when called; the result joins them to the rows."""
        names, key = df.columns, "_key"
        while key in names:
            key = "_" + key
        keyed = df.withColumn(key, _binned(vector_to_array(self.vector), self.thresholds, self.rules))
        zero = F.lit(0).cast("long")
        scores = self._scores(keyed.select(F.col(key).alias("key")).distinct().select("key", zero.alias("n0"), zero.alias("n1")))
        share, votes = F.col(f"{key}_share"), F.col(f"{key}_votes")
        p = F.coalesce(F.try_divide(share, votes), F.lit(0.0))
        q = F.when(votes > 0, 1.0 - p).otherwise(0.0)
        added = {"rawPrediction": array_to_vector(F.array(votes - share, share)), "probability": array_to_vector(F.array(q, p)), "prediction": (p > q).cast("double")}
        joined = keyed.join(scores.toDF(key, f"{key}_share", f"{key}_votes"), key)
        return joined.select(*names, *[c.alias(name) for name, c in added.items()])

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        about = {
            "rules": vars(m.rules), "vector": m.vector, "thresholds": [t.tolist() for t in m.thresholds],
            "tops": [[*(a.tolist() for a in top[:4]), top[4]] for top in m.tops],
        }
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"forest": about})
        m.table.write.parquet(f"{path}/parts")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        about = meta["forest"]
        tops = [(*(np.array(a, np.int64) for a in top[:4]), top[4]) for top in about["tops"]]
        table = spark.read.schema(_PART).parquet(f"{path}/parts")
        model = ForestModel(Rules(**about["rules"]), [np.array(t) for t in about["thresholds"]], tops, table, about["vector"])
        model._resetUid(meta["uid"])
        return model
