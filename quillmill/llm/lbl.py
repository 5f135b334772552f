"""The neural part of the language model: a log-bilinear network over leaves.

A leaf is a token of the vocabulary; leaves lie in classes of equal size. The
vectors of the last ``ORDER`` leaves each go through the matrix of their
position and add up to a prediction. Its products with the class vectors and
with the leaf vectors of one class give P(class) and P(leaf | class), each
normalised exactly; their product is P(leaf).

Training is noise-contrastive estimation in minibatches, at both levels: tell
the class that came from classes of the unigram distribution (their expectation
taken exactly), and the leaf that came from leaves drawn from the unigrams of
its class. Scores are unnormalised while training. Steps are scaled by the
history of each row (Adagrad).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

ORDER = 3
WIDTH = 32
CLASSES = 64
MEMBERS = 128
LEAVES = CLASSES * MEMBERS
#: Weight of noise against data, and leaves drawn for each class that a minibatch holds.
RATIO = 8
DRAWN = 32
BATCH = 4096
RATE = 0.1
#: Tokens whose probabilities are worked out at once.
BLOCK = 8192
#: Rows of a number that occurs no more often than this are added up side by side with those of other numbers.
OFTEN = 32
#: Scores beyond this are shifted before they are exponentiated.
STEEP = 60.0
#: Weights that belong to no single leaf.
WHOLE = ("mix", "group", "group_bias")


def firsts(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each token where its text starts."""
    return np.repeat(starts, np.diff(np.append(starts, len(ids))))


def contexts(ids: np.ndarray, starts: np.ndarray, at: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """(n, ORDER): the leaves before each of some tokens, nearest first; before a text lies leaf 0. ``first`` has what ``firsts`` gives, if it is known."""
    first = (firsts(ids, starts) if first is None else first)[at]
    return np.stack([np.where(at - i >= first, ids[np.maximum(at - i, 0)], 0) for i in range(1, ORDER + 1)], axis=1).astype(np.uint16)


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct row numbers, the most frequent ones first, and sums of ``values`` by them."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    size = np.diff(np.append(first, len(rows)))
    falling = np.argsort(-size, kind="stable")
    first, size = first[falling], size[falling]
    sums = values.take(order[first], axis=0)
    above = np.searchsorted(-size, -np.arange(OFTEN + 1)).tolist()  # how many occur more often
    often = above[OFTEN]
    for i, (at, n) in enumerate(zip(first[:often].tolist(), size[:often].tolist(), strict=True)):
        sums[i] = values.take(order[at : at + n], axis=0).sum(axis=0)
    for i in range(1, OFTEN):
        if above[i] > often:
            sums[often : above[i]] += values.take(order[first[often : above[i]] + i], axis=0)
    return ordered[first], sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):  # the reciprocal of infinity is the zero that is due
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Net:
    """Vectors, matrices, and the squared steps that each row has taken."""

    unigrams: np.ndarray  # of leaves
    weights: dict[str, np.ndarray]
    history: dict[str, np.ndarray]

    @classmethod
    def new(cls, counts: np.ndarray, seed: int = 7) -> Net:
        """From the counts of leaves; a leaf of count zero is never predicted."""
        rng = np.random.default_rng(seed)
        share = np.maximum(counts, 1e-9) / counts.sum()
        groups = share.reshape(CLASSES, MEMBERS).sum(axis=1)
        weights = {
            "context": rng.normal(0, 0.1, (LEAVES, WIDTH)),
            "leaf": rng.normal(0, 0.1, (LEAVES, WIDTH)),
            "bias": np.log(share / np.repeat(groups, MEMBERS)),
            "mix": np.stack([np.eye(WIDTH) / (i + 1) for i in range(ORDER)]),
            "group": rng.normal(0, 0.1, (CLASSES, WIDTH)),
            "group_bias": np.log(groups),
        }
        return cls(share, {k: w.astype(np.float32) for k, w in weights.items()}, {k: np.full(w.shape, 0.1, np.float32) for k, w in weights.items()})

    def copy(self) -> Net:
        return Net(self.unigrams, {k: w.copy() for k, w in self.weights.items()}, {k: h.copy() for k, h in self.history.items()})

    def move(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        change = gradient * gradient
        change += self.history[name][rows]
        self.history[name][rows] = change
        np.divide(gradient, np.sqrt(change, out=change), out=change)
        change *= RATE
        change += self.weights[name][rows]
        self.weights[name][rows] = change

    def guess(self, before: np.ndarray) -> np.ndarray:
        """What contexts (n, ORDER) predict, by their vectors side by side."""
        seen = self.weights["context"].take(before.reshape(-1), axis=0).reshape(len(before), -1)
        return seen @ self.weights["mix"].reshape(-1, WIDTH)

    def step(self, before: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """One minibatch: contexts (n, ORDER) and their targets. Vectors of leaves go with their bias as one more column."""
        w = self.weights
        order = np.argsort(target // MEMBERS, kind="stable")  # short integers are sorted by counting
        before, target = before[order], target[order]
        own, n = (target // MEMBERS).astype(np.intp), len(target)
        guess = self.guess(before)
        guessed = np.ones((n, WIDTH + 1), np.float32)
        guessed[:, :WIDTH] = guess
        noise = RATIO * self.groups
        odds = guess @ w["group"].T
        odds += w["group_bias"] - np.log(noise)
        pull, each = sigmoid(odds), np.arange(n)
        hit = 1 - pull[each, own]
        pull *= -noise
        pull[each, own] += hit
        leaves = w["leaf"].take(target, axis=0)
        gain = 1 - sigmoid(np.einsum("ij,ij->i", guess, leaves) + w["bias"][target] - self.expected[target])
        back = pull @ w["group"]
        leaves *= gain[:, None]
        back += leaves
        cuts = np.searchsorted(own, np.arange(CLASSES + 1))
        held = np.flatnonzero(np.diff(cuts))
        drawn = self.draw(held, rng)
        vectors = np.empty((len(held), DRAWN, WIDTH + 1), np.float32)
        vectors[:, :, :WIDTH] = w["leaf"].take(drawn, axis=0)
        vectors[:, :, WIDTH] = w["bias"][drawn] - self.expected[drawn]
        lost = np.empty((n, DRAWN), np.float32)
        parts = [slice(*c) for c in zip(cuts[held].tolist(), cuts[held + 1].tolist(), strict=True)]
        for part, v in zip(parts, vectors, strict=True):
            np.matmul(guessed[part], v.T, out=lost[part])
        sigmoid(lost)
        lost *= np.float32(-RATIO / DRAWN)
        shifts = np.empty((n + drawn.size, WIDTH + 1), np.float32)
        np.multiply(guessed, gain[:, None], out=shifts[:n])
        for part, v, shift in zip(parts, vectors, shifts[n:].reshape(vectors.shape), strict=True):
            back[part] += lost[part] @ v[:, :WIDTH]
            np.matmul(lost[part].T, guessed[part], out=shift)
        at, sums = summed(np.concatenate([target, drawn.reshape(-1).astype(np.uint16)]), shifts)
        mix, turns, came = np.empty_like(w["mix"]), np.zeros_like(w["context"]), np.zeros(LEAVES, bool)
        for i, m in enumerate(w["mix"]):  # what leaves share at one place is added up before it is multiplied
            rows, shares = summed(before[:, i], back)
            mix[i] = w["context"].take(rows, axis=0).T @ shares
            turns[rows] += shares @ m.T
            came[rows] = True
        came = np.flatnonzero(came)
        group = pull.T @ guessed
        self.move("leaf", sums[:, :-1], at)
        self.move("bias", sums[:, -1], at)
        self.move("context", turns.take(came, axis=0), came)
        for name, gradient in (("mix", mix), ("group", group[:, :-1]), ("group_bias", group[:, -1])):
            self.move(name, gradient)

    def draw(self, held: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """DRAWN leaves of each held class, by their unigrams."""
        found = np.searchsorted(self.stairs, held[:, None] + rng.random((len(held), DRAWN)))
        return np.minimum(found, (held[:, None] + 1) * MEMBERS - 1)

    def __post_init__(self):
        self.groups = self.unigrams.reshape(CLASSES, MEMBERS).sum(axis=1).astype(np.float32)
        inside = (self.unigrams.reshape(CLASSES, MEMBERS) / self.unigrams.reshape(CLASSES, MEMBERS).sum(axis=1, keepdims=True)).reshape(-1)
        self.stairs = np.cumsum(inside)
        self.expected = np.log(RATIO * inside).astype(np.float32)

    def train(self, ids: np.ndarray, starts: np.ndarray, rng: np.random.Generator, share: float = 1.0) -> np.ndarray:
        """Minibatches of that share of the tokens of some texts, in random order; gives the tokens' numbers."""
        order = rng.permutation(len(ids))[: int(np.ceil(share * len(ids)))]
        first = firsts(ids, starts)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            self.step(contexts(ids, starts, some, first), ids[some], rng)
        return order

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 P of each token, given those before it in its text."""
        out, first = np.empty(len(ids)), firsts(ids, starts)
        for at in range(0, len(ids), BLOCK):
            some = np.arange(at, min(at + BLOCK, len(ids)))
            out[some] = self._block(self.guess(contexts(ids, starts, some, first)), ids[some])
        return out / math.log(10)

    def _block(self, guess: np.ndarray, target: np.ndarray) -> np.ndarray:
        w = self.weights
        out = np.empty(len(target))
        order = np.argsort(target // MEMBERS, kind="stable")
        guess, target = guess[order], target[order]
        own = (target // MEMBERS).astype(np.intp)
        cuts = np.searchsorted(own, np.arange(CLASSES + 1))
        of_class = chosen(guess @ w["group"].T + w["group_bias"], own)
        inside = np.empty((len(target), MEMBERS), np.float32)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            part, members = slice(cuts[k], cuts[k + 1]), slice(k * MEMBERS, (k + 1) * MEMBERS)
            np.matmul(guess[part], w["leaf"][members].T, out=inside[part])
            inside[part] += w["bias"][members]
        out[order] = of_class + chosen(inside, (target % MEMBERS).astype(np.intp))
        return out


def learned(start: Net, end: Net, tally: np.ndarray) -> list[tuple[int, bytes, bytes, bytes]]:
    """What a task learned from so many tokens of each leaf: per class the leaves met, how often, and what changed in them; as class -1 the rest, times the tokens."""
    out = []
    for k in np.unique(np.flatnonzero(tally) // MEMBERS).tolist():
        met = k * MEMBERS + np.flatnonzero(tally[k * MEMBERS : (k + 1) * MEMBERS])
        change = np.column_stack([end.weights[w][met] - start.weights[w][met] for w in ("context", "leaf", "bias")])
        out.append((k, met.astype("<u2").tobytes(), tally[met].astype("<f8").tobytes(), change.astype("<f2").tobytes()))
    rest = np.concatenate([(end.weights[w] - start.weights[w]).reshape(-1) for w in WHOLE])
    return [*out, (-1, b"", np.array([tally.sum()], "<f8").tobytes(), rest.astype("<f2").tobytes())]


class Total:
    """The mean of what tasks learned: of each leaf over its own tokens, of the rest over all. Parts merge in any order."""

    def __init__(self):
        self.sums: dict[int, np.ndarray] = {}

    def add(self, k: int, met: bytes, tally: bytes, change: bytes) -> None:
        n = np.frombuffer(tally, "<f8")
        change = np.frombuffer(change, "<f2").reshape(len(n), -1).astype(float)
        at = np.frombuffer(met, "<u2").astype(int) - k * MEMBERS if met else np.zeros(1, int)
        held = self.sums.setdefault(k, np.zeros((MEMBERS if met else 1, change.shape[1] + 1)))
        held[at, 0] += n
        held[at, 1:] += n[:, None] * change

    def means(self) -> list[tuple[int, bytes, bytes, bytes]]:
        out = []
        for k, held in self.sums.items():
            met = np.flatnonzero(held[:, 0])
            mean = (held[met, 1:] / held[met, :1]).astype("<f2").tobytes()
            out.append((k, (k * MEMBERS + met).astype("<u2").tobytes() if k >= 0 else b"", held[met, 0].astype("<f8").tobytes(), mean))
        return out

    def applied(self, start: Net) -> Net:
        """The start moved by the mean change."""
        net = start.copy()
        for k, met, _, mean in self.means():
            mean = np.frombuffer(mean, "<f2").astype(np.float32)
            if k >= 0:
                at, mean = np.frombuffer(met, "<u2"), mean.reshape(-1, 2 * WIDTH + 1)
                net.weights["context"][at] += mean[:, :WIDTH]
                net.weights["leaf"][at] += mean[:, WIDTH:-1]
                net.weights["bias"][at] += mean[:, -1]
            else:
                for w, part in zip(WHOLE, np.split(mean, np.cumsum([net.weights[w].size for w in WHOLE])[:-1]), strict=True):
                    net.weights[w] += part.reshape(net.weights[w].shape)
        return net


def chosen(scores: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Log-probability of one column in each row, scores normalised over the row."""
    if scores.size and not (-STEEP < scores.min() and scores.max() < STEEP):
        scores -= scores.max(axis=1, keepdims=True)
    found = scores[np.arange(len(scores)), column]
    return found - np.log(np.exp(scores, out=scores).sum(axis=1))
