"""Encoding with the tokenizers library: each distinct piece of text goes through it once per worker, for as long as it is remembered.

Texts are cut into pieces together, by arrays over their characters, and equal pieces are found by Arrow. Texts with special tokens
or with characters whose class is not settled go one by one.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from . import bpe

CACHED = 200_000  # pieces, in each of two halves, that a worker remembers; results do not depend on it
OTHER, LETTER, NUMBER, SPACE = range(4)


class Pieces(dict):
    """Packed ids by piece; when full, the pieces seen become the older half and what is older goes."""

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        self.size = library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = {t.content: np.array([i], self.kind).tobytes() for i, t in library.get_added_tokens_decoder().items()}
        self.model = library.model
        self.printable = {b: c for c, b in bpe._byte_of().items()} | {0xFF: "\n"}
        self.older: dict[str, bytes] = {}

    def packed(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; those not remembered are encoded by the library's model."""
        found = list(map(self.get, pieces))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            found[k] = self.older.get(pieces[k])
            if found[k] is not None:
                self._keep(pieces[k], found[k])
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            # one join and one translation for all; no byte of a UTF-8 text is 0xFF, no printable stand-in is a line feed
            joined = "\udcff".join([pieces[k] for k in new]).encode("utf-8", "surrogateescape").decode("latin-1").translate(self.printable)
            tokenize, code = self.model.tokenize, "H" if self.kind.itemsize == 2 else "I"
            ids, ends = array(code), [0]
            for shown in joined.split("\n"):
                ids.extend([t.id for t in tokenize(shown)])
                ends.append(len(ids) * ids.itemsize)
            data = ids.tobytes()
            for k, a, b in zip(new, ends, ends[1:]):
                found[k] = data[a:b]
                self._keep(pieces[k], found[k])
        return found

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= bpe.LONG_PIECE:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every settled code point."""
    out = np.zeros(max(high for _, high in bpe.SETTLED) + 1, np.uint8)
    for low, high in bpe.SETTLED:
        out[low : high + 1] = [{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(low, high + 1)]
    out[sorted(bpe.SPACE)] = SPACE
    return out


def borders(chars: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where pieces begin (see ``bpe.PATTERN``) in texts that stand in a row, each from its place in ``begin`` on.

    Pieces are runs of one class. A run takes a space (0x20) before it along, so white space in front of it ends one earlier and
    its last character begins a piece. An apostrophe that begins a piece ends it after s, t, m, d, re, ve or ll.
    """
    if not len(chars):
        return np.zeros(0, np.int64)
    of = _classes()[chars]
    gap, first = of == SPACE, np.zeros(len(chars), bool)
    first[begin[begin < len(chars)]] = True
    last = np.append(first[1:], True)
    start = first.copy()
    start[1:] |= of[1:] != of[:-1]
    start[1:] &= first[1:] | gap[1:] | (chars[:-1] != 0x20)
    start[:-1] |= gap[:-1] & ~gap[1:] & ~last[:-1]
    at = np.flatnonzero((chars == ord("'")) & start & ~last)
    next_, after = chars[at + 1], np.where(last[at + 1], 0, chars[np.minimum(at + 2, len(chars) - 1)])
    is_ = lambda a, b: (next_ == ord(a)) & (after == ord(b))
    short, long = np.isin(next_, [ord(c) for c in "stmd"]), is_("r", "e") | is_("v", "e") | is_("l", "l")
    start[at[short | long] + 1] = False
    ends = np.concatenate((at[short] + 2, at[long] + 3))
    start[ends[ends < len(chars)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Whole texts to packed ids (``kind`` says how wide), equal to the library's without special tokens added."""

    def __init__(self, path: str):
        self.pieces, self.split = Pieces(path), bpe.splitter(path)
        self.kind, self.size, self.special = self.pieces.kind, self.pieces.size, self.pieces.special
        special = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.beyond = re.compile("[^" + "".join(f"\\u{low:04x}-\\u{high:04x}" for low, high in bpe.SETTLED) + "]")

    def _odd(self, text: str) -> bool:
        return bool(self.cut and self.cut.search(text)) or not text.isascii() and bool(self.beyond.search(text))

    def _one(self, text: str) -> bytes:
        parts = self.cut.split(text) if self.cut else [text]
        return b"".join([self.special[p] if k % 2 else b"".join(self.pieces.packed(self.split(p))) for k, p in enumerate(parts)])

    def _many(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        data = joined.encode()
        place = np.frombuffer(data, np.uint8)
        if len(data) == len(joined):
            chars, place = place, np.arange(len(data))
        else:
            chars, place = np.frombuffer(joined.encode("utf-32-le"), "<u4"), np.flatnonzero(place & 0xC0 != 0x80)  # of each character
        begin = np.cumsum([0, *map(len, texts)])
        start = borders(chars, begin)
        offsets = np.append(place[start], len(data)).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which, packed = cut.indices.to_numpy(), self.pieces.packed(cut.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(packed), self.kind)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        times = size[which]
        ends = np.cumsum(times)
        ids = flat[np.repeat((np.cumsum(size) - size)[which] - ends + times, times) + np.arange(times.sum())].tobytes()
        at = (np.concatenate(([0], ends))[np.searchsorted(start, begin)] * self.kind.itemsize).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [self._odd(t) for t in texts]
        rest = iter(self._many([t for t, o in zip(texts, odd) if not o]))
        return [self._one(t) if o else next(rest) for t, o in zip(texts, odd)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)
