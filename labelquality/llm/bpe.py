"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a piece exactly one token can end the encoding. Tokens that end at a position come from an
automaton over the vocabulary; a token is the right one if the last token of the prefix before it is compatible
with it: encoding the two tokens' bytes gives these two tokens again. Back-pointers from the end give the ids.
Pieces come from the vocabulary's own pre-tokenization, and distinct pieces are encoded once per worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .texts import slices, table

CACHED_PIECES = 100_000  # distinct pieces, in each of two halves, that a worker remembers; results do not depend on it
LONG_PIECE = 64  # longer pieces are not remembered
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"""
#: Code points whose classes are the same in all Unicode versions since 15: texts of these alone go through re.
SETTLED = ((0x0000, 0x1C7F), (0x1E00, 0xA7BF))
SPACE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out, start = [], 0
    for k in range(1, len(points) + 1):
        if k == len(points) or points[k] != points[k - 1] + 1:
            out.append(f"\\u{points[start]:04x}-\\u{points[k - 1]:04x}")
            start = k
    return "".join(out)


def splitter(path: str) -> Callable[[str], list[str]]:
    """Cut a text into pieces as the byte-level pre-tokenizer does; texts with unsettled characters ask the library's own."""
    settled = [c for low, high in SETTLED for c in range(low, high + 1)]
    classes = {k: _ranges([c for c in settled if unicodedata.category(chr(c))[0] == k]) for k in "LN"} | {"S": _ranges(sorted(SPACE))}
    plain = re.compile(PATTERN.format(**classes)).findall
    beyond = re.compile("[^" + "".join(f"\\u{low:04x}-\\u{high:04x}" for low, high in SETTLED) + "]").search
    library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    return lambda text: [text[a:b] for _, (a, b) in library(text)] if beyond(text) else plain(text)


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next code point from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def token_bytes(path: str) -> dict[int, bytes]:
    """Bytes of every token, all that decoding needs."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    byte = _byte_of()
    plain = {i: bytes(byte[c] for c in t) for t, i in model["model"]["vocab"].items()}
    return plain | {t["id"]: t["content"].encode() for t in model["added_tokens"]}


class Vocabulary:
    """Tokens in merge order: ``rank`` of a byte is below all merges, and a merge's rank follows its place in the list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        byte = _byte_of()
        ids = {"".join(chr(byte[c]) for c in t): i for t, i in model["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.size = max(*ids.values(), *self.special.values()) + 1
        rank = {chr(b): b for b in range(256)}
        self.parts, self.merged = [(r, r) for r in range(256)], {}
        for pair in model["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            left, right = ("".join(chr(byte[c]) for c in x) for x in (left, right))
            if left + right not in rank:
                rank[left + right] = len(self.parts)
                self.parts.append((rank[left], rank[right]))
            self.merged.setdefault((rank[left], rank[right]), rank[left + right])
        self.packed = [ids[t].to_bytes(4, "little") for t in rank]  # ranks count up in the dict's order
        self.known: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            if self._stable(r):
                self.automaton.add_word(t, (r, len(t)))
        self.automaton.make_automaton()

    def _stable(self, token: int) -> bool:
        """Whether a token's bytes encode to the token: its two parts must meet as neighbours before they merge."""
        left, right = self.parts[token]
        return left == right == token or self._compatible(left, right, token)

    def _compatible(self, left: int, right: int, limit: int = 1 << 31) -> bool:
        """Whether no merge ranked below ``limit`` joins bytes across the border of two neighbouring tokens.

        Undo merges from the latest on. A border that some earlier pair could have crossed at the moment when both
        its sides were there would have been crossed.
        """
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right or self.parts[right][0] == right:
                inner = self.parts[left][1]
                if inner == left:
                    if self.parts[right][0] == right:
                        return True
                    limit, right = right + 1, self.parts[right][0]
                else:
                    limit, left = left, inner
            else:
                limit, right = right + 1, self.parts[right][0]

    def encode(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        data = piece.encode().decode("latin-1")  # one character a byte
        last, length, done, known = [0] * (len(data) + 1), [0] * (len(data) + 1), 0, self.known
        for end, (token, size) in self.automaton.iter(data):
            end += 1
            if end == done:
                continue
            if size != end:
                pair = last[end - size] << 32 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    fits = known[pair] = self._compatible(last[end - size], token)
                if not fits:
                    continue
            last[end], length[end], done = token, size, end
        out, at = [], len(data)
        while at:
            out.append(self.packed[last[at]])
            at -= length[at]
        out.reverse()
        return b"".join(out)


class _Pieces(dict):
    """Ids of pieces seen lately; when full, the pieces seen become the older half and what is older goes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.vocabulary.encode(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=1)
def encoder(path: str) -> tuple[Vocabulary, Callable[[str], bytes]]:
    vocabulary = Vocabulary(path)
    pieces, split = _Pieces(vocabulary), splitter(path)
    cut = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None

    def ordinary(text: str) -> bytes:
        return b"".join(map(pieces.__getitem__, split(text)))

    def encode(text: str) -> bytes:
        if cut is None or not cut.search(text):
            return ordinary(text)
        out, at = [], 0
        for found in cut.finditer(text):
            out += [ordinary(text[at : found.start()]), vocabulary.special[found[0]].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, ordinary(text[at:])])

    return vocabulary, encode


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary) for every row: ids of the whole text as little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of a byte-level BPE file in the JSON form of the tokenizers library, the same on
    every machine. Strings of special tokens give their ids. Null texts count as empty and give no ids; rows keep
    their number and may repeat. A text is held once in memory, a batch is a few of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(vocabulary)[1]
        for part in slices(batches):
            out = [ids(t or "") for t in part.column("text").to_pylist()]
            yield table(["doc_id", "ids"], part.column("doc_id"), pa.array(out, pa.binary()))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def _text(ids: bytes, token: Callable[[int], bytes]) -> str:
    return b"".join(map(token, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Replace ``ids_col`` by the decoded text; other columns stay. Null ids give null; bytes that are not UTF-8 become U+FFFD."""
    kept = [c for c in encoded.columns if c != ids_col]
    schema = encoded.select(*kept).schema.add(out_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = token_bytes(vocabulary).__getitem__
        for part in slices(batches, ids_col):
            out = [None if x is None else _text(x, token) for x in part.column(ids_col).to_pylist()]
            yield table([*kept, out_col], *(part.column(c) for c in kept), pa.array(out, pa.string()))

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and again decoded texts, and the ids if asked for.

    Null texts count as empty, rows keep their number and may repeat, an empty table gives an empty result. One pass: ids leave
    the worker only if they are kept.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, token = encoder(vocabulary)[1], token_bytes(vocabulary).__getitem__
        for part in slices(batches):
            ids = [ids_of(t or "") for t in part.column("text").to_pylist()]
            columns = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(_text(x, token).encode()).hexdigest() for x in ids]]
            arrays = [part.column("doc_id"), *map(pa.array, columns, (pa.int64(), pa.string(), pa.string()))]
            yield table(names, *arrays, *([pa.array(ids, pa.binary())] if keep_ids else []))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
