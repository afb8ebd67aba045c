"""Pieces by arrays against the library, and what a worker remembers."""

import random
from types import SimpleNamespace

import numpy as np
from tokenizers import Tokenizer

from labelquality.llm import bpe, tokens
from labelquality.llm.catalog import vocabulary


def test_borders_and_ids_equal_the_library(monkeypatch):
    """Spaces, apostrophes, special tokens and unsettled characters in any order, many texts at once, little memory."""
    monkeypatch.setattr(tokens, "CACHED", 50)
    library, split = Tokenizer.from_file(vocabulary()), bpe.splitter(vocabulary())
    found, draw = tokens.Encoder(vocabulary()), random.Random(3)
    common = [*" \t\n\x0b\x1f\x85\xa0 　'~.1é日stmdrevlS", "'ll", "'re", " 's", "  ", " the", "''"]
    rare = ["<|endoftext|>", "<|endof", "🙂", "\U0001f1e6"]
    for _ in range(300):
        texts = ["".join(draw.choices(common + rare * (draw.random() < 0.2), k=draw.randrange(25))) for _ in range(20)]
        for text, ids in zip(texts, found(texts), strict=True):
            assert np.frombuffer(ids, found.kind).tolist() == library.encode(text, add_special_tokens=False).ids
        texts = [t for t in texts if not found._odd(t)]
        chars, begin = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.cumsum([0, *map(len, texts)])
        lengths = [len(p) for t in texts for p in split(t)]
        assert tokens.borders(chars, begin).tolist() == (np.cumsum(lengths) - lengths).tolist()
    assert found([]) == [] and found(["", ""]) == [b"", b""]


def test_pieces_in_use_outlast_a_full_memory(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 50)
    found, asked = tokens.Encoder(vocabulary()), []
    tokenize = found.pieces.model.tokenize
    found.pieces.model = SimpleNamespace(tokenize=lambda piece: asked.append(piece) or tokenize(piece))
    for k in range(60):
        found([f"lasting {'abcdefgh'[k % 8]}{'klmnopqrst'[k // 8]} " + " ".join("xyz"[j] + "uvw"[k % 3] * (k // 3 + 1) for j in range(3))])
    assert len(asked) > 2 * tokens.CACHED and asked.count("lasting") == 1
