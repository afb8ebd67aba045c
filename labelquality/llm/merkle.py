"""Merkle manifest of documents: ternary hash trees in a van Emde Boas layout.

A tree over n ordered leaves is cut into aligned blocks of 3**height leaves. A block's nodes, from its leaves up to
its root, are one array in van Emde Boas order: the upper half of its levels first, then the subtrees below it, each
laid out the same way. So a path from leaf to root touches few stretches of the array, whatever the size of a page.
``addresses`` computes a node's place; construction and the retrieval of siblings both use it. The roots of blocks are the
leaves of the next, 3**height times smaller tree of blocks, and so on until one block holds a root. Each block is
built and read in one task; a source of any size is many blocks. Subroots of sources are the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranking import ranked
from ..sources.shared import stored

ARITY = 3
HEIGHT = 8  # levels of a block above its leaves: 6,561 leaves and 9,841 nodes
DIGEST = 32
_BLOCKS = "key string, block long, total long, height int, root binary, nodes binary"
_PATHS = "key string, rank long, siblings binary, shape binary, subroot binary, root binary"


def nodes_in(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


@lru_cache(maxsize=None)
def layout(levels: int) -> tuple[tuple[int, int, int], ...]:
    """By depth, for the nodes that are roots of bottom trees there: (depth of the root of the top tree above them, nodes
    of that top tree, nodes of each bottom tree)."""
    found: dict[int, tuple[int, int, int]] = {0: (0, 0, 0)}

    def halve(first: int, count: int) -> None:
        if count > 1:
            upper = count // 2
            found[first + upper] = (first, nodes_in(upper), nodes_in(count - upper))
            halve(first, upper)
            halve(first + upper, count - upper)

    halve(0, levels)
    return tuple(found[d] for d in range(levels))


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in the array of nodes ``index`` (from the left) at ``depth`` of a complete tree of ``levels`` levels."""
    if depth == 0:
        return np.zeros(len(index), np.int64)
    above, top, bottom = layout(levels)[depth]
    below = ARITY ** (depth - above)
    return addresses(levels, above, index // below) + top + index % below * bottom


def height_for(total: int, most: int) -> int:
    """Levels that a block of a tree of ``total`` leaves has above its leaves: all that are needed, or ``most``."""
    height = 0
    while ARITY**height < total and height < most:
        height += 1
    return height


def combine(parts: list[bytes]) -> bytes:
    """Digest of digests, which are written as lowercase hex text."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def build_block(leaves: list[bytes], height: int) -> np.ndarray:
    """(nodes, 32) array of a block in van Emde Boas order; places of nodes that do not exist are zero."""
    nodes = np.zeros((nodes_in(height + 1), DIGEST), np.uint8)
    level = leaves
    for up in range(height + 1):
        if up:
            level = [combine(level[s : s + ARITY]) for s in range(0, len(level), ARITY)]
        nodes[addresses(height + 1, height - up, np.arange(len(level)))] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, DIGEST)
    return nodes


def siblings_in(nodes: np.ndarray, height: int, count: int, index: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For leaves ``index`` of a block of ``count``: digests of the others in their runs, level by level and from left to
    right, and the shape: per level one byte, place in the run * 4 + length of the run."""
    n = len(index)
    found = np.zeros((n, height, ARITY - 1, DIGEST), np.uint8)
    there = np.zeros((n, height, ARITY - 1), bool)
    shape = np.zeros((n, height), np.uint8)
    at = index
    for up in range(height):
        first = at // ARITY * ARITY
        place = at - first
        shape[:, up] = place * 4 + np.minimum(count - first, ARITY)
        for k in range(ARITY - 1):
            other = first + k + (k >= place)
            some = other < count
            found[some, up, k] = nodes[addresses(height + 1, height - up, other[some])]
            there[:, up, k] = some
        at, count = at // ARITY, -(-count // ARITY)
    return [found[i][there[i]].tobytes() for i in range(n)], [s.tobytes() for s in shape]


def fold(digest: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that follows from a leaf and its siblings."""
    at = 0
    for s in shape:
        place, others = s >> 2, (s & 3) - 1
        run = [siblings[k : k + DIGEST] for k in range(at, at + others * DIGEST, DIGEST)]
        digest, at = combine([*run[:place], digest, *run[place:]]), at + others * DIGEST
    return digest


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(columns: list[Column]) -> Column:
    """Digest of a row: of each value its UTF-8 length, a colon and the value, or a dash for null."""
    return F.unhex(F.sha2(F.concat(*map(_field, columns)), 256))


def _hex(column: str) -> Column:
    return F.lower(F.hex(column))


def _build(height: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        total = rows["total"][0].as_py()
        levels = height_for(total, height)
        nodes = build_block(rows["digest"].to_pylist(), levels)
        first = [rows["key"][0].as_py()], [rows["block"][0].as_py()], [total], pa.array([levels], pa.int32())
        return pa.table([*map(pa.array, first), pa.array([nodes[0].tobytes()], pa.binary()), pa.array([nodes.tobytes()], pa.binary())], ["key", "block", "total", "height", "root", "nodes"])

    return run


def _level(rows: DataFrame, height: int) -> DataFrame:
    """Rows (key, rank, total, digest) with their block."""
    return rows.withColumn("block", F.expr(f"rank div {ARITY**height}"))


def build(leaves: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks from the leaves up, and (key, root), from (key, rank, total, digest); a tree for every key."""
    levels, roots, level = [], None, leaves
    while True:
        inner = _level(level.select("key", "rank", "total", "digest"), height)
        blocks = stored(inner.groupBy("key", "block").applyInArrow(_build(height), _BLOCKS), "blocks")
        levels.append(blocks)
        done = blocks.filter(F.col("total") <= ARITY**height).select("key", "root")
        roots = done if roots is None else roots.union(done)
        level = blocks.filter(F.col("total") > ARITY**height)
        level = level.select("key", F.col("block").alias("rank"), F.ceil(F.col("total") / ARITY**height).alias("total"), F.col("root").alias("digest"))
        if level.isEmpty():
            return levels, roots


def _paths(left: pa.Table, right: pa.Table) -> pa.Table:
    """Paths of the leaves of one block, and what is above the block."""
    left = left.sort_by("rank")
    n, height = left.num_rows, right["height"][0].as_py()
    nodes = np.frombuffer(right["nodes"][0].as_py(), np.uint8).reshape(-1, DIGEST)
    rank = left["rank"].to_numpy()
    # rows of one rank may repeat, places of the block do not
    siblings, shape = siblings_in(nodes, height, int(right["count"][0].as_py()), rank % ARITY**height if height else rank * 0)
    above = [right[c][0].as_py() for c in ("siblings", "shape", "subroot", "top")]
    columns = [pa.array([s + above[0] for s in siblings], pa.binary()), pa.array([s + above[1] for s in shape], pa.binary())]
    columns += [pa.array([x] * n, pa.binary()) for x in above[2:]]
    return pa.table([left["key"], left["rank"], *columns], ["key", "rank", "siblings", "shape", "subroot", "root"])


def paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(key, rank, siblings, shape, subroot, root) of every leaf: its way up through its tree and then on as ``above`` says.

    ``above``: (key, siblings, shape, subroot, root) of every tree's root. Goes from the highest blocks down.
    """
    full = ARITY**height
    found, more = None, ["siblings", "shape", "subroot", "top"]
    for k in range(len(levels) - 1, -1, -1):
        blocks = levels[k].select("key", "block", "total", "height", "nodes", F.least(F.lit(full), F.col("total") - F.col("block") * full).alias("count"))
        right = blocks.filter(F.col("total") <= full).join(above.withColumnRenamed("root", "top"), "key").select(*blocks.columns, *more)
        if found is not None:
            inner = found.withColumnsRenamed({"rank": "block", "root": "top"})
            right = right.unionByName(blocks.filter(F.col("total") > full).join(inner, ["key", "block"]).select(*blocks.columns, *more))
        rows = leaves if k == 0 else levels[k - 1].filter(F.col("total") > full).select("key", F.col("block").alias("rank"))
        left = _level(rows.select("key", "rank"), height)
        found = left.groupBy("key", "block").cogroup(right.groupBy("key", "block")).applyInArrow(_paths, _PATHS)
        if k:
            found = stored(found, "paths")
    return found


def leaf_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars") -> DataFrame:
    """(key, doc_id, digest, tampered): digests of the rows, also as they are after tampering.

    Tampering hits rows whose doc_id's CRC is even: it deletes the line feeds of their texts. The key tells sources apart
    in byte order, null first.
    """
    doc_id, text, source = F.col(id_col).cast("long"), F.col(text_col), F.col(source_col).cast("string")
    fields = lambda t: [doc_id, source, F.col(lang_col), F.col(chars_col), t]
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains(text, F.lit("\n")), F.lit(False))
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"), doc_id.alias("doc_id"), digest_of(fields(text)).alias("digest"),
        F.when(hit, digest_of(fields(F.replace(text, F.lit("\n"), F.lit(""))))).alias("tampered"),
    )


def _verify(height: int):
    def run(batches):
        for part in batches:
            columns = {c: part.column(c).to_pylist() for c in ("digest", "tampered", "siblings", "shape")}
            roots = [fold(t or d, s, p) for d, t, s, p in zip(columns["digest"], columns["tampered"], columns["siblings"], columns["shape"])]
            proofs = [hashlib.sha256(s.hex().encode()).hexdigest() for s in columns["siblings"]]
            keep = [part.column(c) for c in ("doc_id", "digest", "subroot", "root", "siblings", "shape")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(proofs, pa.string()), pa.array(roots, pa.binary())], names=["doc_id", "digest", "subroot", "root", "siblings", "shape", "proof_sha256", "folded"])

    return run


def manifest(docs: DataFrame, height: int = HEIGHT, **columns: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, siblings, shape) for every row of ``docs``.

    Leaves of a source ascend by doc_id (null first), rows of one doc_id by their digests, and repeated rows each have a
    leaf. Null is a source of its own and comes first. Null values are hashed as a dash, an empty text as ``0:``. ``siblings`` and ``shape``
    are the proof that ``fold`` takes. ``folded_root`` is recomputed from the tampered row where tampering hits, else
    from the row as it is. An empty table gives an empty result. Other columns are not read.
    """
    leaves = stored(ranked(leaf_rows(docs, **columns), "key", [F.asc_nulls_first("doc_id"), F.col("digest")], "leaves"), "ranked")
    levels, subroots = build(leaves, height)
    subroots = stored(subroots.select("key", F.col("root").alias("digest")), "subroots")
    tops = stored(ranked(subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "digest"), "key", [F.col("source")], "sources"), "tops")
    upper, root = build(tops, height)
    none = F.lit(b"")
    start = root.select("key", none.alias("siblings"), none.alias("shape"), none.alias("subroot"), "root")
    over = tops.join(paths(tops, upper, start, height).drop("subroot"), ["key", "rank"])
    over = stored(over.select(F.col("source").alias("key"), "siblings", "shape", F.col("digest").alias("subroot"), "root"), "over")
    found = leaves.join(paths(leaves, levels, over, height), ["key", "rank"])
    schema = "doc_id long, digest binary, subroot binary, root binary, siblings binary, shape binary, proof_sha256 string, folded binary"
    checked = found.select("doc_id", "digest", "tampered", "siblings", "shape", "subroot", "root").mapInArrow(_verify(height), schema)
    return checked.select(
        "doc_id", _hex("digest").alias("leaf"), _hex("subroot").alias("subroot"), _hex("root").alias("root"), "proof_sha256", _hex("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"), "siblings", "shape",
    )
