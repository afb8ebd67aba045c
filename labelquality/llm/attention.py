"""A small causal self-attention model over subword ids, in numpy.

The model reads classes of tokens from context: one attention head with a bias per distance, on top of a table of
the next class given the present token. A token's probability is that of its class times its share of the class.
Texts are scored by windows of 2 * STRIDE inputs that overlap by half; each window scores its last STRIDE tokens,
so each token is scored once, with STRIDE to 2 * STRIDE - 1 tokens of context (fewer at the beginning).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

STRIDE = 16
EPOCHS = 8  # bound on passes over the sample
WIDTH = 2 * STRIDE
DIM = 16
CLASSES = 160
OWN = 128  # of the classes that are a single token
INPUTS = 2048  # frequent tokens that are told apart as context; the others are one
BEFORE = 512  # inputs told apart when tokens are put into classes
BATCH = 128  # windows scored together
LIMIT = np.float32(60)  # of logits; far above what training gives, and safe in single precision
PART = 256  # tokens whose classes are predicted together in training, so that arrays stay in the cache
CHUNK = 1 << 15  # weights that are moved together, for the same reason
ONES = np.ones(4096, np.float32)

DISTANCE = STRIDE + np.arange(STRIDE)[:, None] - np.arange(WIDTH)[None, :]  # of query i to key j; negative is the future
ALLOWED = DISTANCE >= 0


@dataclass
class Model:
    """Tables by token id: input, class and log share; by input: query, key, value and logits; weights of the head."""

    start: int
    end: int
    token_input: np.ndarray
    token_class: np.ndarray
    log_share: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    logits: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log probability of every token; ``at`` holds the n + 1 offsets of the texts in ``ids``."""
        if not len(ids):
            return np.zeros(0)
        keys, place = windows(self.token_input[ids], at, self.start)
        target = np.append(self.token_class[ids], 0)[place]  # place is len(ids) beyond a text's end
        found = np.empty(len(ids) + 1)
        bias = np.where(ALLOWED, self.bias[np.maximum(DISTANCE, 0)], -np.inf).astype(np.float32)
        none = len(self.query) - 1
        shares = np.exp(self.logits)
        least_score = self._bound(self.query, self.key) + np.abs(self.bias).max(initial=0)
        least_logit = self._bound(self.value, self.out.T)
        for s in range(0, len(keys), BATCH):
            k, p = keys[s : s + BATCH], place[s : s + BATCH]
            now, goal = k[:, STRIDE:].ravel(), target[s : s + BATCH].ravel()
            score = self.query.take(k[:, STRIDE:], axis=0) @ self.key.take(k, axis=0).transpose(0, 2, 1)
            score += bias
            np.exp(np.minimum(score, LIMIT, out=score) if least_score > LIMIT else score, out=score)
            score *= (k != none)[:, None, :]
            context = score @ self.value.take(k, axis=0)
            context /= score.sum(axis=2, keepdims=True)
            logits = context.reshape(-1, DIM) @ self.out
            if least_logit > LIMIT:
                np.minimum(logits, LIMIT, out=logits)
            chosen = logits[np.arange(len(goal)), goal] + self.logits[now, goal]
            np.exp(logits, out=logits)
            found[p.ravel()] = chosen - np.log(np.vecdot(logits, shares.take(now, axis=0)))
        return found[:-1] + self.log_share[ids]

    @staticmethod
    def _bound(a: np.ndarray, b: np.ndarray) -> float:
        """No product of a row of one and a row of the other is larger; below LIMIT nothing has to be clipped."""
        return float(np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max())


def windows(inputs: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of each window, shape (n, WIDTH), and the place of the token each of its last STRIDE inputs predicts.

    A text's inputs are a start mark and its tokens but the last. Inputs before the text are ``start + 1``, a mark
    for nothing; places beyond its end are the number of all tokens.
    """
    length = np.diff(at)
    blocks = -(-length // STRIDE)
    text = np.repeat(np.arange(len(length)), blocks)
    block = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    offset = (block[:, None] - 1) * STRIDE + np.arange(WIDTH)[None, :]  # of the input within its text
    source = at[text][:, None] + offset - 1
    inside = (offset >= 1) & (offset < length[text][:, None])
    keys = np.where(inside, np.append(inputs, 0)[np.clip(source, 0, len(inputs))], np.where(offset == 0, start, start + 1))
    last = offset[:, STRIDE:]
    place = np.where(last < length[text][:, None], at[text][:, None] + last, len(inputs))
    return keys.astype(np.int32), place


def inputs(counts: np.ndarray) -> np.ndarray:
    """Input of every token: the most frequent have their own, the others share one."""
    frequent = np.argsort(-counts, kind="stable")[: INPUTS - 1]
    token_input = np.full(len(counts), INPUTS - 1, np.int32)
    token_input[frequent] = np.arange(len(frequent))
    return token_input


def cluster(counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], classes: int = CLASSES, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Class of every token: the most frequent have their own, the others go by what precedes them (k-means on root shares).

    ``pairs``: different (input, token) pairs and how often the token follows the input; inputs from BEFORE - 1 on are one.
    """
    order = np.argsort(-counts, kind="stable")
    own = min(OWN, len(counts))
    token_class = np.zeros(len(counts), np.int32)
    token_class[order[:own]] = np.arange(own)
    rest = order[own:]
    before, token, n = pairs
    follows = np.bincount(token, n, len(counts))
    seen = rest[follows[rest] > 0]
    row = np.full(len(counts), -1)
    row[seen] = np.arange(len(seen))
    mine = row[token] >= 0
    profile = np.zeros((len(seen), BEFORE), np.float32)
    profile[row[token[mine]], before[mine]] = np.sqrt(n[mine] / follows[token[mine]])
    weight = np.log1p(counts[seen]).astype(np.float32)
    groups = classes - own
    draw = np.random.default_rng(seed)
    if len(seen) <= groups:
        token_class[rest] = own
        token_class[seen] = own + np.arange(len(seen)) % groups
        return token_class
    centers = profile[:groups] + 1e-3 * draw.random((groups, profile.shape[1]), np.float32)
    for _ in range(rounds):
        near = (profile @ centers.T - 0.5 * (centers**2).sum(axis=1)).argmax(axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, near, profile * weight[:, None])
        mass = np.bincount(near, weight, groups)[:, None]
        centers = np.where(mass > 0, total / np.maximum(mass, 1e-9), centers).astype(np.float32)
    token_class[rest] = own + int(np.bincount(near, minlength=groups).argmax())
    token_class[seen] = own + near
    return token_class


@dataclass
class Frame:
    """What training leaves as it is: inputs and classes of tokens, their shares of the class, the mark of a text's start."""

    start: int
    end: int
    token_input: np.ndarray
    token_class: np.ndarray
    share: np.ndarray

    def windows(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, classes to predict, which of them exist) of all windows of some texts."""
        ids = np.concatenate(lists).astype(np.int64)
        at = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        keys, place = windows(self.token_input[ids], at, self.start)
        return keys, np.append(self.token_class[ids], 0)[place], place < len(ids)

    def model(self, w: dict[str, np.ndarray]) -> Model:
        scale = np.float32(DIM**-0.5)
        query, key, value = w["embed"] @ w["q"] * scale, w["embed"] @ w["k"], w["embed"] @ w["v"]
        return Model(self.start, self.end, self.token_input, self.token_class, self.share, query, key, value, w["logits"], w["out"], w["bias"])


def begin(counts: np.ndarray, end: int, token_class: np.ndarray, given: np.ndarray, seed: int = 0) -> tuple[Frame, dict[str, np.ndarray]]:
    """The untrained model: ``counts`` of tokens, their classes, and how often a class follows a present input, all of the whole corpus.

    Shares of tokens in their class come from ``counts`` (plus one half each); logits begin at ``given``, the attention head at nothing.
    """
    draw = np.random.default_rng(seed)
    mass = counts + 0.5
    share = np.log(mass) - np.log(np.maximum(np.bincount(token_class, mass, CLASSES), 1e-30))[token_class]
    general = np.bincount(token_class, mass, CLASSES) / mass.sum()
    logits = np.log(np.maximum((given + 20 * general) / (given.sum(axis=1, keepdims=True) + 20), 1e-30))
    w = {
        "logits": logits.astype(np.float32), "embed": draw.normal(0, 0.3, (INPUTS + 2, DIM)).astype(np.float32), "out": np.zeros((DIM, CLASSES), np.float32),
        **{n: draw.normal(0, DIM**-0.5, (DIM, DIM)).astype(np.float32) for n in ("q", "k", "v")}, "bias": (-0.1 * np.arange(WIDTH)).astype(np.float32),
    }
    return Frame(INPUTS, end, inputs(counts), token_class, share), w


def _places(rows: int, width: int) -> np.ndarray:
    """Where each pair of numbers of a table stands in it."""
    return np.arange(rows * width // 2).reshape(rows, width // 2)


def _summed(rows: np.ndarray, at: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
    """Add each of ``rows`` to the row of ``out`` that ``at`` names, number by number, which numpy does fast, and faster for two as a complex one."""
    np.add.at(out.reshape(-1).view(np.complex64), places.take(at, axis=0).ravel(), rows.reshape(-1).view(np.complex64))


def _even(total: np.ndarray) -> bool:
    """Whether sums of exponentials are far from both ends of single precision, so that nothing was lost in them."""
    return bool(total.min() > 1e-25 and total.max() < 1e25)


class Adam:
    """Steps on a model's weights, in place. What a step needs is kept between steps and worked on in parts that fit the cache."""

    def __init__(self, frame: Frame, w: dict[str, np.ndarray]):
        self.frame, self.w, self.taken = frame, w, 0
        self.first, self.second = {n: np.zeros_like(x) for n, x in w.items()}, {n: np.zeros_like(x) for n, x in w.items()}
        inputs_ = len(w["embed"])
        self.places = [_places(inputs_, n) for n in (CLASSES, DIM, 2 * DIM)]
        self.g = {n: np.zeros(w[n].shape, np.float32) for n in ("logits", "out", "bias")}
        self.to = [np.zeros((inputs_, n), np.float32) for n in (DIM, 2 * DIM)]
        self.room = [np.empty((PART, CLASSES), np.float32) for _ in range(2)]
        self.spare = np.empty(CHUNK, np.float32)

    def step(self, k: np.ndarray, t: np.ndarray, ok: np.ndarray, speed: float) -> None:
        """One step on windows ``k`` with classes ``t`` to predict where ``ok``."""
        w = self.w
        self.taken += 1
        for x in (*self.g.values(), *self.to):
            x.fill(0)
        q, both = w["q"] * np.float32(DIM**-0.5), np.concatenate((w["k"], w["v"]), axis=1)
        with np.errstate(over="ignore"):
            self._gradients(k, t, ok, w["embed"] @ q, w["embed"] @ both)
        of_both = w["embed"].T @ self.to[1]
        g = self.g | {"embed": self.to[0] @ q.T + self.to[1] @ both.T, "q": w["embed"].T @ self.to[0] * np.float32(DIM**-0.5), "k": of_both[:, :DIM], "v": of_both[:, DIM:]}
        for n, d in g.items():
            self._move(w[n], d, self.first[n], self.second[n], speed)

    def _move(self, w: np.ndarray, d: np.ndarray, first: np.ndarray, second: np.ndarray, speed: float) -> None:
        """``first`` and ``second`` are 10 and 100 times the means of gradients and of their squares."""
        even = (1 - 0.99**self.taken) ** -0.5 * 0.1
        least, speed = np.float32(1e-8 / even), np.float32(0.1 * speed / (1 - 0.9**self.taken) / even)
        size = max(1, CHUNK * len(w) // w.size)
        for s in range(0, len(w), size):
            x, one, two = (y[s : s + size] for y in (d, first, second))
            spare = self.spare[: x.size].reshape(x.shape)
            one *= np.float32(0.9)
            one += x
            np.multiply(x, x, out=spare)
            two *= np.float32(0.99)
            two += spare
            np.sqrt(two, out=spare)
            spare += least
            np.divide(one, spare, out=spare)
            spare *= speed
            w[s : s + size] -= spare

    def _gradients(self, k: np.ndarray, t: np.ndarray, ok: np.ndarray, queries: np.ndarray, both: np.ndarray) -> None:
        """Add the gradients of logits, out and bias to ``g``, and those of the tables of queries and of keys and values to ``to``."""
        now = k[:, STRIDE:]
        query, beside = queries.take(now, axis=0), both.take(k, axis=0)
        key, value = beside[:, :, :DIM], beside[:, :, DIM:]
        score = query @ key.transpose(0, 2, 1)
        score += np.where(ALLOWED, self.w["bias"][np.maximum(DISTANCE, 0)], np.float32(-1e9))
        none = k == self.frame.start + 1
        some = np.flatnonzero(none.any(axis=1))
        score[some] -= np.where(none[some], np.float32(1e9), np.float32(0))[:, None, :]
        a = np.exp(score)
        total = a.reshape(-1, WIDTH) @ ONES[:WIDTH]
        if not _even(total):
            score -= score.max(axis=2, keepdims=True)
            np.exp(score, out=a)
            total = a.reshape(-1, WIDTH) @ ONES[:WIDTH]
        a *= (1 / total).reshape(a.shape[:2])[:, :, None]
        context = a @ value
        dcontext = self._classes(context.reshape(-1, DIM), now.ravel(), t.ravel(), ok.ravel() * np.float32(1 / max(ok.sum(), 1))).reshape(context.shape)
        da = dcontext @ value.transpose(0, 2, 1)
        da -= np.vecdot(dcontext, context)[:, :, None]
        da *= a
        far = da.sum(axis=0)
        np.add.at(self.g["bias"], DISTANCE[ALLOWED], far[ALLOWED])
        _summed((da @ key).reshape(-1, DIM), now.ravel(), self.places[1], self.to[0])
        back = np.empty_like(beside)
        np.matmul(da.transpose(0, 2, 1), query, out=back[:, :, :DIM])
        np.matmul(a.transpose(0, 2, 1), dcontext, out=back[:, :, DIM:])
        _summed(back.reshape(-1, 2 * DIM), k.ravel(), self.places[2], self.to[1])

    def _classes(self, flat: np.ndarray, now: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gradient of the context of tokens; those of the logits and of the way out are added to ``g``."""
        out, back = self.w["out"], np.empty_like(flat)
        for s in range(0, len(now), PART):
            x, here, y = flat[s : s + PART], now[s : s + PART], weight[s : s + PART]
            logits, p = (r[: len(x)] for r in self.room)
            np.matmul(x, out, out=logits)
            logits += np.take(self.w["logits"], here, axis=0, out=p, mode="clip")
            np.exp(logits, out=p)
            total = p @ ONES[:CLASSES]
            if not _even(total):
                logits -= logits.max(axis=1, keepdims=True)
                np.exp(logits, out=p)
                total = p @ ONES[:CLASSES]
            p *= (y / total)[:, None]
            p[np.arange(len(x)), goal[s : s + PART]] -= y
            _summed(p, here, self.places[0], self.g["logits"])
            self.g["out"] += x.T @ p
            np.matmul(p, out.T, out=back[s : s + PART])
        return back


def train(
    counts: np.ndarray, sample: list[np.ndarray], end: int, steps: int = 600, batch: int = 192, rate: float = 0.004, seed: int = 0,
    token_class: np.ndarray | None = None, given: np.ndarray | None = None,
) -> Model:
    """Fit in one place to token ids of texts (each ends with ``end``); ``counts`` are token counts of the whole corpus.

    Where ``token_class`` and ``given`` (see ``begin``) are not named, they are those of the texts.
    """
    token_input = inputs(counts)
    lists = sample or [np.zeros(0, np.int64)]
    ids = np.concatenate(lists).astype(np.int64)
    keys, place = windows(token_input[ids], np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64), INPUTS)
    valid = place < len(ids)
    present, goal = keys[:, STRIDE:][valid], ids[place[valid]]
    if token_class is None:
        pair, n = np.unique(np.minimum(present, BEFORE - 1) * len(counts) + goal, return_counts=True)
        token_class = cluster(counts, (pair // len(counts), pair % len(counts), n), seed=seed)
    if given is None:
        given = np.bincount(present * CLASSES + token_class[goal], minlength=(INPUTS + 2) * CLASSES).reshape(-1, CLASSES)
    frame, w = begin(counts, end, token_class, given, seed)
    target = np.append(token_class[ids], 0)[place]
    adam, draw = Adam(frame, w), np.random.default_rng(seed + 1)
    steps = min(steps, math.ceil(EPOCHS * len(keys) / batch))
    for step in range(1, steps + 1):
        pick = draw.integers(0, len(keys), batch)
        adam.step(keys[pick], target[pick], valid[pick], rate * min(1.0, step / 20) * (1 - 0.9 * step / steps))
    return frame.model(w)
