"""Scoring texts with a causal self-attention model over subword ids, interpolated with word counts of the corpus.

What is gathered: word counts of all training documents, the subword counts that follow from them, and how often each
subword follows each input of the model in all training documents. The attention head is fitted on all of them too: tasks take steps on
their part, and their weights are averaged, several rounds in turn. Texts are encoded once; every later
step reads the stored ids, and the words back from them. The probability of a word is the mean of the model's (the product over its subwords) and its share of all training tokens. A text's score is the sum over its
words and its end. Counts of the TOP most frequent words go to every task; rarer words meet their counts in a join.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import shared_dir, stored
from . import attention, bpe
from .texts import raw, slices, table
from .tokens import Pieces

TOP = 300_000  # bound on words whose counts go to every task
SAMPLE, SHARE = 1000, 1  # the attention head is fitted on one in SHARE training documents, which is all, or about SAMPLE, whichever is more
ROUNDS = 3  # of averaging
PER_ROUND = 1000  # documents at least; where there are fewer for each, several rounds go over the same ones
LEARNERS = 256  # at most, each on a part of a round's documents
PER_LEARNER = 500  # documents at least, where there are so many
BATCH, RATE = 192, 0.004  # windows of a step, and its size
CHUNKS = 16  # of the weights, averaged apart
PAIRS = 2_000_000  # counted in a task before they are added up, and different ones before they are passed on
SLICE = 1 << 19  # bytes of ids that are counted or scored together
FLUSH = 300_000  # different words counted in a task before they are passed on
CACHED_WORDS = 200_000  # a worker remembers; results do not depend on it
MODEL_SHARE = 0.5
LOG_MODEL, LOG_REST, LOG_10 = math.log(MODEL_SHARE), math.log(1 - MODEL_SHARE), math.log(10)
END = "<|endoftext|>"


def tokens(data: bytes) -> list[bytes]:
    return data.lower().split()


def held_out(doc_id: Column) -> Column:
    """Whether the doc_id's CRC is divisible by 10; such documents, and those without a doc_id, are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


class _Words(dict):
    """Packed subword ids of words seen lately; each word is encoded with a space before it, by the library's model."""

    def __init__(self, path: str):
        pieces = Pieces(path)
        self.size, self.special, self.tokenize, self.printable = pieces.size, pieces.special, pieces.model.tokenize, pieces.printable
        self.kind, self.older = pieces.kind, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", [t.id for t in self.tokenize((b" " + word).decode("latin-1").translate(self.printable))]).tobytes()
        if len(word) <= bpe.LONG_PIECE:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=1)
def _encoder(path: str) -> tuple[_Words, int, int]:
    words = _Words(path)
    return words, int(np.frombuffer(words.special[END], words.kind)[0]), words.size


@lru_cache(maxsize=1)
def _tokens(path: str, size: int, end: int) -> tuple[pa.Array, np.ndarray]:
    """Bytes of tokens without the space before a word, none for the end; and whether a token opens a word: the end, and what starts with a space, which no word holds."""
    found, opens = [b""] * size, np.zeros(size, bool)
    for number, token in bpe.token_bytes(path).items():
        found[number], opens[number] = token.removeprefix(b" "), token.startswith(b" ")
    found[end], opens[end] = b"", True
    return pa.array(found, pa.binary()), opens


def _words(ids: np.ndarray, begin: np.ndarray, token: pa.Array) -> pa.Array:
    """The words of encoded texts in a row, and an empty one for each text's end; ``begin``: where they open, and the number of ids."""
    _, offsets, data = token.take(pa.array(ids)).buffers()
    at = np.frombuffer(offsets, np.int32, len(ids) + 1)[begin]
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(at), data or pa.py_buffer(b"")])


def _count(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoder.cache_clear()  # texts are encoded; workers give the words they remember back, and in the other steps too
        token, opens = _tokens(path, size, end)
        held, waiting = [pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})], 0

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            """Add up what is held, and pass it on if there are ``least`` different words."""
            all_ = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])
            held.clear()
            if all_.num_rows >= least:
                yield from all_.to_batches()
                all_ = all_.slice(0, 0)
            held.append(all_)

        for part in slices(batches, "ids", SLICE):
            ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), _narrow(size))
            words, n = pc.value_counts(_words(ids, np.append(np.flatnonzero(opens[ids]), len(ids)), token)).flatten()
            held.append(pa.table({"word": words, "n": n}).filter(pc.greater(pc.binary_length(words), 0)))
            waiting += len(words)
            if waiting >= FLUSH:
                yield from flush(FLUSH)
                waiting = 0
        yield from flush(1)

    return run


def word_counts(texts: DataFrame, path: str, size: int, end: int) -> DataFrame:
    """(word binary, n) over all ``encoded`` texts, lower case in A-Z; tasks count first, so a frequent word is a few rows."""
    found = texts.select("ids").mapInArrow(_count(path, size, end), "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _narrow(size: int) -> np.dtype:
    """How token ids are stored."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, size = _encoder(path)
        last, kind = end.to_bytes(4, "little"), _narrow(size)
        for part in slices(batches):
            out = [np.frombuffer(b"".join(map(words.__getitem__, tokens(t))) + last, "<u4").astype(kind).tobytes() for t in raw(part.column("text"))]
            yield table(["doc_id", "ids"], part.column("doc_id"), pa.array(out, pa.binary()))

    return run


def encoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary) of every row, computed once: subwords of its words, each with a space before it, and the end."""
    schema, to = "doc_id long, ids binary", shared_dir(rows.sparkSession, "encoded")
    rows.mapInArrow(_encode(path), schema).write.option("compression", "zstd").parquet(to)
    return rows.sparkSession.read.schema(schema).parquet(to)


def _subword_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoder.cache_clear()
        total = np.zeros(size, np.int64)
        for part in slices(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), _narrow(size)), minlength=size)
        some = np.flatnonzero(total)
        yield table(["id", "n"], some, total[some])

    return run


class _Pairs:
    """Adds up (input, token) pairs of a task; pairs as input * size + token."""

    def __init__(self, size: int):
        self.size, self.fresh, self.waiting = size, [], 0
        self.pair = self.n = np.empty(0, np.int64)

    def add(self, pair: np.ndarray) -> None:
        self.fresh.append(pair)
        self.waiting += len(pair)

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        """Fold what waits, and pass it on if there are ``least`` different pairs."""
        pair, n = np.unique(np.concatenate([np.empty(0, np.int64), *self.fresh]), return_counts=True)
        self.pair, where = np.unique(np.concatenate((self.pair, pair)), return_inverse=True)
        old, self.n = np.concatenate((self.n, n)), np.zeros(len(self.pair), np.int64)
        np.add.at(self.n, where, old)
        self.fresh, self.waiting = [], 0
        if len(self.pair) >= least:
            yield table(["present", "id", "n"], (self.pair // self.size).astype(np.int32), (self.pair % self.size).astype(np.int32), self.n)
            self.pair = self.n = np.empty(0, np.int64)


def _pair_counts(token_input: np.ndarray, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoder.cache_clear()
        size = len(token_input)
        present, pairs = token_input.astype(np.int64), _Pairs(size)
        present[end] = attention.INPUTS  # after the end the next text starts
        present *= size
        for part in slices(batches, "ids"):
            ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), _narrow(size))
            pairs.add(present[np.append(end, ids[:-1])] + ids)
            if pairs.waiting >= PAIRS:
                yield from pairs.flush(PAIRS)
        yield from pairs.flush(1)

    return run


def pair_counts(texts: DataFrame, token_input: np.ndarray, end: int) -> DataFrame:
    """(present int, id int, n): how often each subword follows each input, the start among them, in all ``ids``."""
    found = texts.select("ids").mapInArrow(_pair_counts(token_input, end), "present int, id int, n long")
    return found.groupBy("present", "id").agg(F.sum("n").alias("n"))


def _class_counts(token_class: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((attention.INPUTS + 2, attention.CLASSES), np.int64)
        for batch in batches:
            np.add.at(found, (batch.column("present").to_numpy(), token_class[batch.column("id").to_numpy()]), batch.column("n").to_numpy())
        present, of = np.nonzero(found)
        yield table(["present", "class", "n"], present.astype(np.int32), of.astype(np.int32), found[present, of])

    return run


def corpus_tables(pairs: DataFrame, subwords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every subword, and how often each class follows each input, from all pairs.

    Two tables of a fixed bound reach the driver: subwords by BEFORE inputs, and inputs by classes.
    """
    few = pairs.groupBy(F.least("present", F.lit(attention.BEFORE - 1)).alias("present"), "id").agg(F.sum("n").alias("n")).orderBy("present", "id").toArrow()
    token_class = attention.cluster(subwords, tuple(few[c].to_numpy() for c in ("present", "id", "n")))
    counted = pairs.mapInArrow(_class_counts(token_class), "present int, class int, n long").groupBy("present", "class").agg(F.sum("n").alias("n")).toArrow()
    given = np.zeros((attention.INPUTS + 2, attention.CLASSES))
    given[counted["present"].to_numpy(), counted["class"].to_numpy()] = counted["n"].to_numpy()
    return token_class, given


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in sorted(w)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape).astype(np.float32)
        at += like[n].size
    return out


def _packed(weights: np.ndarray, base: np.ndarray) -> bytes:
    """Single-precision weights by the differences of their bits from those of ``base``, byte by byte, which takes little room and loses nothing."""
    bits = weights.view(np.uint32) - base.view(np.uint32)
    return pa.compress(bits.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, base: np.ndarray) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=base.nbytes, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    return (planes.T.copy().view(np.uint32).ravel() + base.view(np.uint32)).view(np.float32)


def _steps(frame: attention.Frame, w: dict[str, np.ndarray], turn: int, rounds: int):
    """One pass of a task over its documents, batch by batch; its weights and the number of its windows leave in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, kind = {n: x.copy() for n, x in w.items()}, _narrow(len(frame.token_input))
        adam, total = attention.Adam(frame, mine), 0
        draw = np.random.default_rng((turn, TaskContext.get().partitionId()))
        speed = RATE * (1 - 0.9 * turn / rounds)
        for part in slices(batches, "ids"):
            keys, target, valid = frame.windows([np.frombuffer(x, kind) for x in part.column("ids").to_pylist()])
            order = draw.permutation(len(keys))
            total += len(keys)
            for s in range(0, len(keys), BATCH):
                pick = order[s : s + BATCH]
                adam.step(keys[pick], target[pick], valid[pick], speed * min(1.0, (adam.taken + 1) / 20))
        if total:
            parts = zip(np.array_split(_flat(mine), CHUNKS), np.array_split(_flat(w), CHUNKS))
            yield table(["chunk", "weights", "windows"], pa.array(range(CHUNKS), pa.int32()), pa.array([_packed(x, y) for x, y in parts], pa.binary()), pa.array([total] * CHUNKS, pa.int64()))

    return run


def _average(w: dict[str, np.ndarray]):
    def run(group: pa.Table) -> pa.Table:
        base, windows = np.array_split(_flat(w), CHUNKS)[group["chunk"][0].as_py()], group["windows"].to_pylist()
        mean = sum(_unpacked(x, base).astype(np.float64) * n for x, n in zip(group["weights"].to_pylist(), windows)) / sum(windows)
        return pa.table([group["chunk"].slice(0, 1), pa.array([mean.tobytes()], pa.binary())], ["chunk", "mean"])

    return run


def fit_head(known: DataFrame, frame: attention.Frame, w: dict[str, np.ndarray], documents: int, sample: int = SAMPLE, share: int = SHARE, rounds: int = ROUNDS) -> attention.Model:
    """Train the head on one in ``share`` of the ``documents`` of ``known`` (see ``encoded``), or on about ``sample``, chosen by a hash of doc_id and ids.

    By default that is every document. They are dealt to the rounds by another hash, so that each is learned from in one round; where there are
    fewer than PER_ROUND for each, they are dealt to fewer, which take turns. A round's documents are dealt to up to LEARNERS tasks, and a task goes once over its own;
    the weights of all tasks are averaged by their windows, in CHUNKS groups of at most LEARNERS parts, and the mean (1.5 MB) is what
    the next round starts from. No documents come to the driver, and a task holds one slice of them.
    """
    one_in = max(1, min(share, documents // max(sample, 1)))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", "ids", F.lit(2)), F.lit(one_in)) == 0) if one_in > 1 else known
    deals = max(1, min(rounds, documents // one_in // PER_ROUND))
    learners = max(1, min(LEARNERS, documents // one_in // deals // PER_LEARNER))
    ids = chosen.select("ids", F.pmod(F.xxhash64("doc_id", "ids", F.lit(3)), F.lit(deals)).alias("deal"))
    if deals == 1:
        ids = stored(ids.repartition(learners), "sample")
    for turn in range(rounds):
        mine = ids.filter(F.col("deal") == turn % deals).select("ids")
        found = mine.repartition(learners).mapInArrow(_steps(frame, w, turn, rounds), "chunk int, weights binary, windows long")
        means = found.groupBy("chunk").applyInArrow(_average(w), "chunk int, mean binary").toArrow().sort_by("chunk")
        if len(means):  # a round may have been dealt nothing
            w = _shaped(np.concatenate([np.frombuffer(x, np.float64) for x in means["mean"].to_pylist()]), w)
    return frame.model(w)


_ROWS = "row long, doc_id long, n_tokens long, n_known long, base double, score double, word binary, model float"


def _score(path: str, size: int, model: attention.Model, top: dict[bytes, int], top_counts: np.ndarray, total: int, ends: int):
    """A row per text with the sums over its frequent words, and a row per rare word with the model's log probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoder.cache_clear()
        token, opens = _tokens(path, size, model.end)
        counts = np.concatenate((top_counts, [ends])).astype(float)
        with np.errstate(divide="ignore"):  # the logarithm of a share of nothing is -inf
            shares = LOG_REST + np.log(counts / max(total, 1))
        logs = np.log10(counts + 0.1)
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches, "ids", SLICE):
            packed = [np.frombuffer(x, _narrow(size)) for x in part.column("ids").to_pylist()]
            ids = np.concatenate(packed).astype(np.int64)
            begin = np.append(np.flatnonzero(opens[ids]), len(ids))  # of subwords
            at = np.searchsorted(begin, np.concatenate(([0], np.cumsum([len(x) for x in packed]))))  # of tokens
            words = _words(ids, begin, token)
            kinds = words.dictionary_encode()
            where = np.fromiter(map(top.get, kinds.dictionary.to_pylist(), repeat(-2)), np.int64, len(kinds.dictionary))[kinds.indices.to_numpy()]
            where[at[1:] - 1] = -1  # the end, which is last in the counts
            found = np.add.reduceat(model.log_probabilities(ids, begin[at]), begin[:-1])
            frequent = where >= -1
            place = np.maximum(where, -1)
            count = np.where(frequent, counts[place], 0)
            mixed = np.where(frequent, np.logaddexp(found + LOG_MODEL, shares[place]) / LOG_10, 0)
            base = np.where(frequent, logs[place], 0)
            sums = [np.add.reduceat(x, at[:-1]) for x in ((count > 0).astype(np.int64), base, mixed)]
            number = row + np.arange(len(packed))
            row += len(packed)
            yield table(
                ["row", "doc_id", "n_tokens", "n_known", "base", "score", "word", "model"],
                number, part.column("doc_id"), np.diff(at), *sums, pa.nulls(len(packed), pa.binary()), pa.nulls(len(packed), pa.float32()),
            )
            rare = np.flatnonzero(~frequent)
            of = np.searchsorted(at, rare, "right") - 1
            nothing = [pa.nulls(len(rare), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield table(
                ["row", "doc_id", "n_tokens", "n_known", "base", "score", "word", "model"],
                number[of], *nothing, words.take(pa.array(rare)), found[rare].astype(np.float32),
            )

    return run


def _mixed(model: Column, share: Column) -> Column:
    """log10 of the sum of two numbers given by their logarithms, however small; null is the logarithm of 0."""
    more, less = F.greatest(model, share), F.least(model, share)
    return F.when(share.isNull(), model).otherwise(more + F.log1p(F.exp(less - more))) / F.lit(LOG_10)


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, top: int = TOP, share: int = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Scores are log10 probabilities of whole texts, null texts counting as empty (their end alone). Documents that
    are held out or have no doc_id are scored but not learned from. ``fit_head`` says what ``sample``, ``share`` and ``rounds`` are.
    Subword counts (one number per vocabulary entry), the tables of pairs (see corpus_tables), the ``top`` most frequent words and
    the model's weights pass through the driver. Repeated rows are scored one by one; without training documents every
    word is unknown; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = encoded(rows, vocabulary)
    known = texts.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    _, end, size = _encoder(vocabulary)
    words = stored(word_counts(known, vocabulary, size, end), "words")
    ends = known.count()
    n, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = n + ends, kinds + (ends > 0)
    frequent = words.orderBy(F.desc("n"), "word").limit(top).toArrow()
    places = {w: k for k, w in enumerate(frequent["word"].to_pylist())}
    parts = known.select("ids").mapInArrow(_subword_counts(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    subwords = np.zeros(size)
    subwords[parts["id"].to_numpy()] = parts["n"].to_numpy()
    pairs = stored(pair_counts(known, attention.inputs(subwords), end), "pairs")
    frame, w = attention.begin(subwords, end, *corpus_tables(pairs, subwords))
    model = fit_head(known, frame, w, ends, sample, share, rounds)
    all_rows = stored(texts.mapInArrow(_score(vocabulary, size, model, places, frequent["n"].to_numpy(), total, ends), _ROWS), "scores")
    rare = all_rows.filter("word is not null").select("row", "word", "model").join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mixed = _mixed(F.col("model").cast("double") + F.lit(LOG_MODEL), F.lit(LOG_REST) + F.log(F.col("n") / F.lit(max(total, 1))))
    rare = rare.groupBy("row").agg(F.count_if(F.col("n") > 0).alias("rare_known"), F.sum(F.log10(F.col("n") + 0.1)).alias("rare_base"), F.sum(mixed).alias("rare_score"))
    heads = all_rows.filter("word is null").join(rare, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    size_ = F.lit(math.log10(total + 0.1 * (distinct + 1)))
    return heads.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", plus("n_known", "rare_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (plus("base", "rare_base") - F.col("n_tokens") * size_).alias("base_score"), plus("score", "rare_score").alias("score"),
    )
