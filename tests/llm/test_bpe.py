import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from labelquality.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_query(spark, small, texts, library):
    rows = entry.queries()["op7_bpe"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == want(library, texts[r["doc_id"]])


def test_random_texts(library):
    encode = bpe.encoder(PATH)[1]
    rng = random.Random(0)
    alphabet = "abcdefgh ABC  \n\t\r'sdmlltvre 0123½²Ⅷ\x1c\x1f\x85\xa0 　éüß中文🎉́.,!?-_#​﻿İıſʼ͸ა$%&|"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    for _ in range(1000):  # any code points, also some that are younger than Python's tables
        text = "".join(chr(rng.choice([rng.randint(0, 0x24F), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), 0x1C89, 0x105C0])) for _ in range(20))
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_every_token_encodes_to_itself():
    vocabulary = bpe.encoder(PATH)[0]
    assert len(vocabulary.automaton) == len(vocabulary.parts) == 50_256


def test_cache_does_not_change_results(monkeypatch, texts):
    encode = bpe.encoder(PATH)[1]
    before = [encode(t) for t in list(texts.values())[:40]]
    monkeypatch.setattr(bpe, "CACHED_PIECES", 50)
    assert [encode(t) for t in list(texts.values())[:40]] == before


def test_edge_cases(spark, make_docs, library):
    rows = [(1, None), (2, ""), (3, "a<|endoftext|> b<|endoftext|>"), (3, "same"), (3, "same"), (None, "x"), (4, "z" * 300_000), (5, "ab " * 100_000)]
    docs = make_docs(rows).withColumn("ids", bpe.F.lit(1))
    got = sorted((tuple(r) for r in bpe.digests(docs, PATH).collect()), key=str)
    assert got == sorted(((i, *want(library, t)) for i, t in rows), key=str)
    assert bpe.digests(make_docs([]).limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH).withColumn("ids", bpe.F.when(bpe.F.col("doc_id") != 2, bpe.F.col("ids"))), PATH)
    assert {r["doc_id"]: r["text"] for r in back.collect()}[2] is None
