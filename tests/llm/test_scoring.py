import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from labelquality.llm import attention, scoring
from labelquality.llm.catalog import vocabulary


def slow_base(rows):
    """(doc_id, text) -> the columns but score, by the formulas."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    split = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter()
    for i, t in rows:
        if i is not None and not held(i):
            counts.update(split(t))
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = split(t)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        out.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), total, base))
    return sorted(out, key=str)


def compare(got, rows):
    want = slow_base(rows)
    got = sorted((tuple(r) for r in got), key=lambda r: str(r[:6]))
    key = lambda r: (str(r[:5]), r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] <= 1e-9


def test_query(spark, small, texts):
    compare(entry.queries()["op2_scoring"](spark, small).collect(), list(texts.items()))


def test_held_out_texts_score_above_the_base(spark):
    """The base spends 0.1 on every unseen word there may be, so it is only met on more than a handful of texts."""
    rows = entry.queries()["op2_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_rare_words_meet_their_counts_in_the_join(spark, documents, texts):
    """The result does not depend on how many words go to every task."""
    a, b = (sorted(map(tuple, scoring.score(documents, vocabulary(), sample=20, rounds=1, top=n).collect())) for n in (10, 100_000))
    assert len(a) == len(texts)
    for x, y in zip(a, b):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-5)


def small_model(steps, seed=0):
    rng = np.random.default_rng(seed)
    sample = []
    for _ in range(60):  # a token comes back after five places: only attention can know
        seed_ = rng.integers(1, 9, 5)
        sample.append(np.append(np.tile(seed_, 20), 0))
    counts = np.bincount(np.concatenate(sample), minlength=12).astype(float)
    return attention.train(counts, sample, 0, steps=steps, batch=32, rate=0.01), sample


def test_model_learns_from_context():
    before, sample = small_model(0)
    after, _ = small_model(800)
    ids, at = np.concatenate(sample), np.concatenate(([0], np.cumsum([len(x) for x in sample])))
    assert after.log_probabilities(ids, at).mean() > before.log_probabilities(ids, at).mean() + 0.3


def test_probabilities_sum_to_one_and_are_causal():
    model, _ = small_model(50)
    prefix = np.array([3, 1, 4, 1, 5] * 7)
    total = 0.0
    for t in range(12):
        ids = np.append(prefix, t)
        total += math.exp(model.log_probabilities(ids, np.array([0, len(ids)]))[-1])
    assert total == pytest.approx(1, abs=1e-4)
    a, b = np.append(prefix, [1, 2, 3]), np.append(prefix, [7, 8, 2])
    pa, pb = (model.log_probabilities(x, np.array([0, len(x)])) for x in (a, b))
    assert pa[: len(prefix)] == pytest.approx(pb[: len(prefix)])


def untrained(seed=0):
    """A frame, weights none of which is zero, and 192 windows: inputs, classes to predict, which of them exist."""
    draw = np.random.default_rng(seed)
    counts = draw.integers(1, 50, 3000).astype(float)
    given = draw.integers(0, 9, (attention.INPUTS + 2, attention.CLASSES)).astype(float)
    frame, w = attention.begin(counts, 0, draw.integers(0, attention.CLASSES, 3000), given)
    w["out"] += draw.normal(0, 0.3, w["out"].shape).astype(np.float32)
    lists = [np.append(draw.integers(1, 3000, n), 0) for n in draw.integers(1, 150, 80)]
    return frame, w, tuple(x[:192] for x in frame.windows(lists))


def slow_loss(frame, w, k, t, ok):
    """Mean negative log probability of the classes to predict, in double precision."""
    w = {n: x.astype(float) for n, x in w.items()}
    s = attention.STRIDE
    query, key, value = w["embed"] @ w["q"] / math.sqrt(attention.DIM), w["embed"] @ w["k"], w["embed"] @ w["v"]
    total = 0.0
    for row, goal, real in zip(k, t, ok):
        for i in np.flatnonzero(real):
            seen = [j for j in range(s + i + 1) if row[j] != frame.start + 1]
            score = np.array([query[row[s + i]] @ key[row[j]] + w["bias"][s + i - j] for j in seen])
            a = np.exp(score - score.max())
            logits = (a / a.sum()) @ value[row[seen]] @ w["out"] + w["logits"][row[s + i]]
            total -= logits[goal[i]] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
    return total / ok.sum()


@pytest.mark.parametrize("far", [0, 200])
def test_steps_follow_the_loss(far):
    """The first moment after one step is the gradient (10 times the mean); also where exponentials leave single precision."""
    frame, w, (k, t, ok) = untrained()
    k, t, ok = k[:24], t[:24], ok[:24]
    w["logits"][::2] += far
    w["logits"][1::2] -= far
    w["bias"] += np.float32(far)
    before, adam = {n: x.copy() for n, x in w.items()}, attention.Adam(frame, w)
    adam.step(k, t, ok, 0.004)
    draw = np.random.default_rng(1)
    for n, x in before.items():
        way = draw.normal(0, 1, x.shape) * (adam.first[n] != 0)
        loss = lambda e: slow_loss(frame, before | {n: x.astype(float) + e * way}, k, t, ok)  # noqa: B023, E731
        slope = (loss(1e-5) - loss(-1e-5)) / 2e-5
        assert (adam.first[n] * way).sum() == pytest.approx(slope, rel=2e-3, abs=1e-6)


def test_a_step_takes_little_memory():
    """What a step works on stays in the cache: no array of tokens by classes for the whole batch, and no new tables of all weights."""
    frame, w, (k, t, ok) = untrained()
    adam = attention.Adam(frame, w)
    adam.step(k, t, ok, 0.004)
    tracemalloc.start()
    adam.step(k, t, ok, 0.004)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6


def test_words_are_read_back_and_counted(monkeypatch):
    """Slices and parts that are passed on add up to the words of all texts; ends, empty texts and rare bytes are no words."""
    monkeypatch.setattr(scoring, "FLUSH", 40)
    monkeypatch.setattr(scoring, "SLICE", 64)
    words, end, size = scoring._encoder(vocabulary())
    draw = np.random.default_rng(8)
    some = ["a", "beta", "gammadelta", "naïve", "x" * 40, "12-34", "\u00a0", "\x00", "😀é", "<|endoftext|>", *(f"w{k}" for k in range(90))]
    texts = ["", *(" ".join(draw.choice(some, draw.integers(0, 30))) for _ in range(60)), ""]
    tokens = [scoring.tokens(t.encode()) for t in texts]
    kind = scoring._narrow(size)
    ids = [np.append(np.frombuffer(b"".join(words[w] for w in t), "<u4"), end).astype(kind) for t in tokens]
    token, opens = scoring._tokens(vocabulary(), size, end)
    flat = np.concatenate(ids)
    read = scoring._words(flat, np.append(np.flatnonzero(opens[flat]), len(flat)), token)
    assert read.to_pylist() == [w for t in tokens for w in [*t, b""]]
    batch = pa.record_batch([pa.array([x.tobytes() for x in ids], pa.binary())], ["ids"])
    parts, got = list(scoring._count(vocabulary(), size, end)(iter([batch, batch]))), Counter()
    for part in parts:
        assert len(set(part["word"].to_pylist())) == part.num_rows
        got.update(dict(zip(part["word"].to_pylist(), part["n"].to_pylist())))
    assert len(parts) > 1 and got == Counter(w for t in tokens for w in t for _ in range(2))


def test_weights_travel_in_little_room_without_loss():
    """Weights a few hundred steps away from those a round begins with; and any bits."""
    draw = np.random.default_rng(9)
    base = draw.normal(0, 3, 20_000).astype(np.float32)
    near = base + draw.normal(0, 0.01, len(base)).astype(np.float32)
    odd = np.array([0.0, -0.0, np.inf, -np.inf, np.nan, 1e-45, 3e38], np.float32)
    for x, y in ((near, base), (base, near), (odd, odd[::-1].copy()), (base, base)):
        assert scoring._unpacked(scoring._packed(x, y), y).tobytes() == x.tobytes()
    assert len(scoring._packed(near, base)) < 0.75 * near.nbytes


def test_windows_score_each_token_once():
    at = np.array([0, 1, 18, 18, 90])
    inputs = np.arange(90) % 50
    keys, place = attention.windows(inputs, at, 50)
    assert sorted(place[place < 90].tolist()) == list(range(90))
    for k, p in zip(keys, place):
        for i, token in enumerate(p):
            if token < 90:
                begin = max(a for a in at if a <= token)
                row = [*([51] * 64), 50, *inputs[begin:token]]
                assert k[: attention.STRIDE + i + 1].tolist() == row[-(attention.STRIDE + i + 1) :]


def test_edge_cases(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "A b\x0bc"), (None, "a b"), (4, "x" * 5000), (4, "x y"), (4, "x y"), (5, "é " * 60_000)] + [(k, "a b c") for k in range(10, 30)]
    docs = make_docs(rows).withColumn("word", scoring.F.lit("x")).withColumn("n", scoring.F.lit("x"))
    compare(scoring.score(docs, vocabulary(), rounds=1).collect(), rows)
    compare(scoring.score(make_docs([(None, "a b")]), vocabulary(), rounds=1).collect(), [(None, "a b")])
    assert scoring.score(make_docs([]).limit(0), vocabulary(), rounds=1).count() == 0


def test_long_unknown_words_count_in_full(spark, make_docs, monkeypatch):
    """Words so unlikely that their probability is no double: alone, after a known word, and in a row without an id."""
    fit, models = scoring.fit_head, []
    monkeypatch.setattr(scoring, "fit_head", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    draw = np.random.default_rng(5)
    word, other = ("".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 3000)) for _ in range(2))
    out = next(i for i in range(100, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    texts = [(out, word), (out, f"a {word} b {other}"), (None, word)]
    rows = [(k, "a b c") for k in range(30)] + texts
    got = scoring.score(make_docs(rows), vocabulary(), rounds=1).filter("held_out or doc_id is null").collect()
    words, end, _ = scoring._encoder(vocabulary())
    counts = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for w in [*t.encode().split(), None])
    total, want = sum(counts.values()), []
    for i, t in texts:
        parts = [(w, np.frombuffer(words[w], "<u4").astype(np.int64)) for w in t.encode().split()] + [(None, np.array([end]))]
        ids, at = np.concatenate([p for _, p in parts]), np.cumsum([0] + [len(p) for _, p in parts])
        log = models[0].log_probabilities(ids, np.array([0, len(ids)]))
        found = [(counts[w], log[a:b].sum()) for (w, _), a, b in zip(parts, at, at[1:])]
        want.append((i, sum(math.log10(0.5 * math.exp(m) + 0.5 * n / total) if n else (m + math.log(0.5)) / math.log(10) for n, m in found)))
    assert min(log) < 0 and min(s for _, s in want) < -744 / math.log(10)
    got = sorted(((r["doc_id"], r["score"]) for r in got if r["n_tokens"] != 4), key=str)
    assert [i for i, _ in got] == [i for i, _ in sorted(want, key=str)]
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(want, key=str)], rel=1e-5)


def test_pairs_of_all_training_documents_are_counted(spark, make_docs, monkeypatch):
    """The tables behind the model are those of every training row, however few documents the head is fitted on."""
    begin, seen = attention.begin, []
    monkeypatch.setattr(scoring.attention, "begin", lambda *a: seen.append((a[0], {"token_class": a[2], "given": a[3]})) or begin(*a))
    monkeypatch.setattr(scoring, "PAIRS", 50)
    draw = np.random.default_rng(6)
    some = ["alpha", "beta", "gammadelta", "naïve", "x" * 40, "12-34", "Unbelievably"]
    rows = [(k, " ".join(draw.choice(some, draw.integers(0, 30)))) for k in range(60)] + [(1, None), (7, "alpha beta"), (None, "never learned")]
    scoring.score(make_docs(rows), vocabulary(), sample=2, rounds=1).collect()
    counts, tables = seen[0]
    words, end, size = scoring._encoder(vocabulary())
    token_input, pairs = attention.inputs(counts), Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            ids = [x for w in (t or "").encode().lower().split() for x in np.frombuffer(words[w], "<u4").tolist()] + [end]
            pairs.update(zip([attention.INPUTS, *token_input[ids].tolist()], ids))
    want = np.zeros((attention.INPUTS + 2, attention.CLASSES))
    for (present, token), n in pairs.items():
        want[present, tables["token_class"][token]] += n
    assert (tables["given"] == want).all() and want.sum() == counts.sum()
    few = Counter()
    for (present, token), n in pairs.items():
        few[min(present, attention.BEFORE - 1), token] += n
    table = [np.array(x) for x in zip(*((p, t, n) for (p, t), n in sorted(few.items())))]
    assert (attention.cluster(counts, table) == tables["token_class"]).all()


def test_more_documents_and_learners_train_the_head(spark, make_docs, monkeypatch):
    """The share of documents that the head sees grows with the corpus; several tasks' weights are averaged and still predict better."""
    monkeypatch.setattr(scoring, "PER_LEARNER", 20)
    draw = np.random.default_rng(3)
    rows = []
    for k in range(400):  # a word comes back after three places
        seed = [f"w{x}" for x in draw.integers(0, 9, 3)]
        rows.append((k, " ".join(seed * 12)))
    seen = []
    docs = make_docs(rows)
    known = docs.filter(~scoring.held_out(scoring.F.col("doc_id"))).select("doc_id", "text")
    fitted = scoring.stored

    def sizes(df, name):
        out = fitted(df, name)
        if name == "sample":
            seen.append(out.count())
        return out

    monkeypatch.setattr(scoring, "stored", sizes)
    n = known.count()
    score = lambda **k: sum(r["score"] for r in scoring.score(docs, vocabulary(), **k).filter("held_out").collect())
    untrained, trained = score(rounds=0), score(rounds=6, sample=400)
    assert trained > untrained
    score(rounds=0, sample=40, share=100)
    score(rounds=0, sample=1, share=4)
    assert seen[1] == n and abs(seen[2] - 40) < 25 and abs(seen[3] - n / 4) < 40


def test_the_head_learns_from_every_training_document(spark, make_docs, monkeypatch, tmp_path):
    """Each training row is in one round; of few rows, each is in all rounds."""
    monkeypatch.setattr(scoring, "PER_ROUND", 40, raising=False)
    monkeypatch.setattr(scoring, "PER_LEARNER", 10)
    words, end, size = scoring._encoder(vocabulary())

    def noting(folder):
        def steps(frame, w, turn, rounds):
            def run(batches):
                for batch in batches:
                    for k, x in enumerate(batch.column("ids").to_pylist()):
                        with open(f"{folder}/{turn}-{scoring.TaskContext.get().taskAttemptId()}-{k}-{hash(x)}", "wb") as f:
                            f.write(x)
                yield from ()

            return run

        return steps

    for n, times in ((200, 1), (60, 3)):
        folder = tmp_path / str(n)
        folder.mkdir()
        monkeypatch.setattr(scoring, "_steps", noting(str(folder)))
        rows = [(k, f"text number {k}") for k in range(n)] + [(7, "text number 7"), (None, "never learned")]
        scoring.score(make_docs(rows), vocabulary(), sample=20).count()
        known = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
        want = Counter(np.append(np.frombuffer(b"".join(words[w] for w in t.encode().split()), "<u4"), end).astype("<u2").tobytes() for t in known)
        assert Counter(f.read_bytes() for f in folder.iterdir()) == Counter({t: k * times for t, k in want.items()})
