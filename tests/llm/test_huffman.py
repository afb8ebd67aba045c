"""Codes against brute force, files against the tokenizers library."""

import heapq
import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from labelquality.llm import huffman
from labelquality.llm.catalog import vocabulary
from labelquality.llm.tokens import encoder

EDGES = [None, "", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "\n\n  tab\tend ", "naïve 日本語 🙂 ​　x", "''s 's'S", "a" * 5000, "  \n" * 700, "1234567890" * 30, "\x00\x7f\x85\xa0", "\U0001f600́é"]


def cost(counts, lengths):
    return int((counts * lengths.astype(np.int64)).sum())


def plain_huffman(counts):
    heap = [(int(c), (k,)) for k, c in enumerate(counts) if c]
    bits = np.zeros(len(counts), np.int64)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        bits[list(x + y)] += 1
        heapq.heappush(heap, (a + b, x + y))
    return bits


def test_lengths_are_best():
    draw = np.random.default_rng(0)
    for n in (2, 3, 17, 300):
        counts = (draw.pareto(0.5, n) * 10).astype(np.int64) + 1
        lengths = huffman.code_lengths(counts, 40)
        assert cost(counts, lengths) == cost(counts, plain_huffman(counts))
    for counts in ([1, 2, 4, 8, 16], [1, 1, 1, 1, 50], [5, 0, 9, 1, 1]):
        counts = np.array(counts)
        used = np.flatnonzero(counts)
        fits = (x for x in itertools.product(range(1, 4), repeat=len(used)) if sum(2.0**-k for k in x) <= 1)
        best = min(int((counts[used] * x).sum()) for x in fits)
        lengths = huffman.code_lengths(counts, 3)
        assert lengths.max() <= 3 and cost(counts, lengths) == best


def test_lengths_at_the_limit():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, np.int64), 3)
    assert (huffman.code_lengths(np.ones(8, np.int64), 3) == 3).all()
    assert huffman.code_lengths(np.array([0, 7, 0]), 3).tolist() == [0, 1, 0]
    assert huffman.code_lengths(np.zeros(4, np.int64), 3).tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("n,every", [(0, 4), (1, 4), (4, 4), (5, 4), (1000, 7), (3000, 512), (100, 512)])
def test_ids_round_trip(n, every):
    draw = np.random.default_rng(n)
    ids = np.minimum(draw.geometric(0.05, n) * draw.integers(1, 9, n), 60000).astype(np.int64)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=65536)))
    assert code.lengths.max(initial=0) <= huffman.LIMIT
    offsets, words = code.encode(ids, every)
    assert len(offsets) == -(-n // every)
    assert code.decode(words, offsets, n, every).tolist() == ids.tolist()
    codes = [format(int(c), "b").zfill(int(b)) for c, b in zip(code.codes, code.lengths) if b]
    assert "".join(format(int(code.codes[i]), "b").zfill(int(code.lengths[i])) for i in ids) == "".join(f"{w:032b}" for w in words)[: int(code.lengths[ids].sum())]
    assert not any(b.startswith(a) for a, b in itertools.permutations(codes[:40], 2))


def test_any_block_and_checkpoint_alone():
    """A block is read without the others, and ids behind a checkpoint without those before it."""
    ids = np.random.default_rng(1).integers(0, 300, 1000)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids)))
    doc_ids, lengths, back = huffman.unpack(code, huffman.pack(code, [5, None, -3], [400, 0, 600], ids, 16))
    assert (doc_ids, lengths.tolist(), back.tolist()) == ([5, None, -3], [400, 0, 600], ids.tolist())
    offsets, words = code.encode(ids, 16)
    assert code.decode(words, offsets[10:11], 16, 16).tolist() == ids[160:176].tolist()
    with pytest.raises(ValueError):
        huffman.unpack(code, b"XXXX" + bytes(40))


def expected(rows):
    library = Tokenizer.from_file(vocabulary())
    library.no_padding(), library.no_truncation()
    ids = [(d, library.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    out, start = [], 0
    for d, x in sorted(ids, key=lambda r: (r[0] is None, r[0] or 0)):
        out.append((d, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


def test_encoder_equals_library(texts):
    library = Tokenizer.from_file(vocabulary())
    some = [t or "" for t in EDGES] + list(texts.values())
    found = encoder(vocabulary())(some)
    for text, ids in zip(some, found):
        assert np.frombuffer(ids, encoder(vocabulary()).kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_files_equal_library(spark, make_docs, texts):
    rows = [(-1 - k, t) for k, t in enumerate(EDGES)] + list(texts.items())
    found = huffman.round_trip(make_docs(rows), vocabulary()).collect()
    assert sorted(map(tuple, found)) == sorted(expected(rows))


def test_small_blocks_and_order(spark, make_docs, tmp_path):
    rows = [(k * 7 % 101, f"word{k} " * (k % 9)) for k in range(101)] + [(3000, "long " * 4000)]
    huffman.write(make_docs(rows), vocabulary(), f"{tmp_path}/ids", block=64, every=8)
    blocks = spark.read.parquet(f"{tmp_path}/ids/blocks").orderBy("part", "block").collect()
    assert len(blocks) > 15
    found = huffman.read(spark, f"{tmp_path}/ids", keep_ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in found] == expected(rows)
    for r in found:
        assert len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]


def test_nulls_ties_repeats_empty_and_clashes(spark, make_docs):
    rows = [(None, "b"), (None, None), (4, "same"), (4, "same"), (4, "other one"), (1, "x")]
    found = sorted(map(tuple, huffman.round_trip(make_docs(rows).selectExpr("*", "1 AS ids", "2 AS part", "3 AS h", "4 AS row"), vocabulary()).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [1, 4, 4, 4, None, None]
    assert [r[1] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1].tolist()]
    assert sorted(r[2:] for r in found) == sorted(r[2:] for r in expected(rows))
    assert huffman.round_trip(make_docs([]), vocabulary()).collect() == []
