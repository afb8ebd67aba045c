"""Token ids on disk: canonical length-limited Huffman codes in independent blocks, decoded by table at bit-offset checkpoints.

A file set is a folder with two tables. ``code`` holds the code length of every id, all a canonical code needs. ``blocks``
holds one row per block in ascending doc_id order: (part, block, start, n_tokens, body); ``part`` counts the files
in order, ``start`` the ids of the part before the block. A body is

    4 bytes  magic "CHB1"
    u32      documents d             u64  ids n          u32  ids between checkpoints c
    d bytes  1 if the doc_id is null
    d i64    doc_ids                 d u64  ids of each document
    u64      bit offset of every c-th id (ceil(n / c) of them)
    u32      big-endian words of code bits

all little-endian but the last. A block holds whole documents, about BLOCK ids, and one document at least. It is read
without any other block, and all its checkpoints at once: each step decodes one id behind every checkpoint.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources.shared import shared_dir
from .texts import slices, table
from .tokens import encoder

LIMIT = 20  # bits of the longest code; grows by itself for more ids than it can tell apart
BLOCK = 1 << 20  # ids
EVERY = 512  # ids between checkpoints
END = 2
MAGIC = b"CHB1"
HEAD = struct.Struct("<4sIQI")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of the best prefix code with no code above ``limit``, by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    n, out = len(used), np.zeros(len(counts), np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit into codes of {limit} bits")
    if n <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight, items, leaf = counts[order].astype(np.int64), np.empty(0, np.int64), []
    for _ in range(limit):
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, packages))
        by_weight = np.argsort(both, kind="stable")
        leaf.append(by_weight < n)
        items = both[by_weight]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Code:
    """Canonical codes from lengths: by length, then by id, counting up."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = max(int(lengths.max(initial=0)), 1)
        used = np.flatnonzero(lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        room = np.int64(1) << (self.limit - self.lengths[order])  # entries of the decoding table
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (np.cumsum(room) - room).astype(np.uint64) >> (self.limit - self.lengths[order]).astype(np.uint64)
        self.entries = np.zeros(1 << self.limit, np.uint32)
        entries = np.repeat(order.astype(np.uint32) << np.uint32(5) | self.lengths[order].astype(np.uint32), room)
        self.entries[: len(entries)] = entries

    def encode(self, ids: np.ndarray, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
        """(bit offsets of every ``every``-th id, 32-bit words)."""
        length = self.lengths[ids]
        end = np.cumsum(length)
        at = end - length
        word = at >> 5
        placed = self.codes[ids] << (64 - length - (at & 31)).astype(np.uint64)  # the code within the 64 bits from its word on
        n = (int(end[-1]) + 31 >> 5) + 1 if len(ids) else 1
        # codes do not overlap, so sums of their parts are below 2**32 and exact
        words = np.bincount(word, (placed >> np.uint64(32)).astype(float), n) + np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(float), n)[:n]
        return at[::every].astype(np.uint64), words.astype(np.uint32)

    def decode(self, words: np.ndarray, offsets: np.ndarray, n: int, every: int = EVERY) -> np.ndarray:
        """The ``n`` ids; one step reads the next id of all checkpoints."""
        words = np.concatenate((words, np.zeros(every * self.limit // 32 + 2, np.uint32))).astype(np.uint64)
        pair = words[:-1] << np.uint64(32) | words[1:]
        at, out = offsets.astype(np.int64), np.empty((min(every, n), len(offsets)), np.uint32)
        right = np.uint64(64 - self.limit)
        for step in out:
            entry = self.entries[pair[at >> 5] << (at & 31).astype(np.uint64) >> right]
            np.right_shift(entry, 5, out=step)
            at += entry & 31
        return out.T.ravel()[:n]


def pack(code: Code, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, every: int = EVERY) -> bytes:
    offsets, words = code.encode(ids, every)
    null = bytes(d is None for d in doc_ids)
    return b"".join((
        HEAD.pack(MAGIC, len(doc_ids), len(ids), every), null, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(),
        offsets.astype("<u8").tobytes(), words.astype(">u4").tobytes(),
    ))


def unpack(code: Code, body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids)."""
    magic, d, n, every = HEAD.unpack_from(body)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEAD.size + d
    doc_ids, lengths = np.frombuffer(body, "<i8", d, at).tolist(), np.frombuffer(body, "<u8", d, at + 8 * d).astype(np.int64)
    at += 16 * d
    marks = -(-n // every)
    words = np.frombuffer(body, ">u4", offset=at + 8 * marks).astype(np.uint32)
    ids = code.decode(words, np.frombuffer(body, "<u8", marks, at), n, every)
    return [None if gone else x for gone, x in zip(body[HEAD.size : HEAD.size + d], doc_ids)], lengths, ids


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        last = np.array([end], encode.kind).tobytes()
        for part in slices(batches):
            out = [ids + last for ids in encode([t or "" for t in part.column("text").to_pylist()])]
            yield table(["doc_id", "ids"], part.column("doc_id"), pa.array(out, pa.binary()))

    return run


def _counts(kind: np.dtype, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in slices(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), kind), minlength=size)
        some = np.flatnonzero(total)
        yield table(["id", "n"], some, total[some])

    return run


def _blocks(lengths: np.ndarray, kind: np.dtype, size: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(lengths), TaskContext.get().partitionId()
        block = start = waiting = 0
        doc_ids, texts = [], []

        def flush() -> pa.RecordBatch:
            each = [len(t) // kind.itemsize for t in texts]
            body = pack(code, doc_ids, each, np.frombuffer(b"".join(texts), kind), every)
            return table(["part", "block", "start", "n_tokens", "body"], [part], [block], [start], [sum(each)], pa.array([body], pa.large_binary()).cast(pa.binary()))

        for some in slices(batches, "ids"):
            for doc_id, ids in zip(some.column("doc_id").to_pylist(), some.column("ids").to_pylist()):
                n = len(ids) // kind.itemsize
                if texts and waiting + n > size:
                    yield flush()
                    block, start, waiting = block + 1, start + waiting, 0
                    doc_ids, texts = [], []
                doc_ids.append(doc_id)
                texts.append(ids)
                waiting += n
        if texts:
            yield flush()

    return run


def write(docs: DataFrame, vocabulary: str, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, every: int = EVERY) -> None:
    """Encode every whole text with the vocabulary and write the ids, ``end`` after each document, in ascending doc_id order.

    Null texts count as empty (``end`` alone), null doc_ids come last, rows of one doc_id follow each other by a hash of their
    ids, repeated rows are written each; an empty table gives a file set without blocks. Other columns are not read. Texts
    are encoded once; their ids are stored, counted (one number per id reaches the driver) and dealt by ranges.
    """
    library = encoder(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    plain = shared_dir(docs.sparkSession, "ids")
    rows.mapInArrow(_encode(vocabulary, end), "doc_id long, ids binary").write.option("compression", "zstd").parquet(plain)
    ids = docs.sparkSession.read.schema("doc_id long, ids binary").parquet(plain)
    counted = ids.select("ids").mapInArrow(_counts(library.kind, library.size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(library.size, np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    lengths = code_lengths(counts, max(LIMIT, int(len(counted)).bit_length()))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("ids"), F.monotonically_increasing_id()]
    dealt = ids.select("doc_id", "ids", order[1].alias("h"), order[2].alias("row"))
    dealt = dealt.repartitionByRange(order[0], "h", "row").sortWithinPartitions(order[0], "h", "row").select("doc_id", "ids")
    blocks = dealt.mapInArrow(_blocks(lengths, library.kind, block, every), "part long, block long, start long, n_tokens long, body binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


def _decode(lengths: np.ndarray, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for some in slices(batches, "body"):
            for base, body in zip(some.column("start").to_pylist(), some.column("body").to_pylist()):
                doc_ids, each, ids = unpack(code, body)
                packed, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(each)
                texts = [packed[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), each.tolist())]
                columns = [pa.array(doc_ids, pa.int64()), base + ends - each, each, pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                if keep_ids:
                    columns.append(pa.array([bytes(t) for t in texts], pa.binary()))
                yield table(["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)], *columns)

    return run


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) per document of a file set; ``start`` counts the ids of all documents before it.

    ids are little-endian unsigned 32-bit integers. Blocks are read independently; only the ids per part (one row a file) meet
    in one place. There are at most as many parts as shuffle partitions when the files were written, so their bases are broadcast.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()[0], np.uint8)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), "part").select((F.col("base") + F.col("start")).alias("start"), "body")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return placed.mapInArrow(_decode(lengths, keep_ids), schema)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write ``docs`` to a fresh file set in the shared folder and read it back: see ``write`` and ``read``."""
    path = shared_dir(docs.sparkSession, "token-ids")
    write(docs, vocabulary, path)
    return read(docs.sparkSession, path)
