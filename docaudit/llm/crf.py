"""Linear-chain conditional random fields over many sequences at once, in numpy."""

from __future__ import annotations

import numpy as np


class Chain:
    """Scores: start[k], move[k, l], and weights[f, k] for feature values f of each position."""

    def __init__(self, features: int, labels: int):
        self.weights = np.zeros((features, labels))
        self.move = np.zeros((labels, labels))
        self.start = np.zeros(labels)

    def fit(self, x: np.ndarray, y: np.ndarray, offsets: np.ndarray, rounds: int = 120, rate: float = 0.1, decay: float = 1e-3, share: np.ndarray | None = None) -> "Chain":
        """Maximum likelihood with weight decay by Adam; x[n, f] features, y[n] labels, offsets[s + 1] sequences, share[s] their weights."""
        labels, count = self.move.shape[0], len(offsets) - 1
        share = np.ones(count) if share is None else share
        each = np.repeat(share, np.diff(offsets))
        gold = np.eye(labels)[y]
        inner = np.ones(len(x), bool)
        inner[offsets[:-1]] = False
        pairs = np.flatnonzero(inner)
        gold_move = np.zeros_like(self.move)
        np.add.at(gold_move, (y[pairs - 1], y[pairs]), each[pairs])
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.weights, self.move, self.start)]
        total = each.sum()
        for step in range(1, rounds + 1):
            marginal, moves = self.marginals(x @ self.weights, offsets, each)
            grads = (
                x.T @ ((gold - marginal) * each[:, None]) / total - decay * self.weights,
                (gold_move - moves) / total - decay * self.move,
                ((gold - marginal)[offsets[:-1]] * share[:, None]).sum(0) / total - decay * self.start,
            )
            for p, g, s in zip((self.weights, self.move, self.start), grads, state):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.99 * s[1] + 0.01 * g * g
                p += rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
        return self

    def marginals(self, emission: np.ndarray, offsets: np.ndarray, each: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """P(label at position), by scaled forward-backward; with `each`, also the expected moves weighted by it."""
        n, labels = emission.shape
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        e = np.exp(emission - emission.max(1, keepdims=True)) if n else emission
        move = np.exp(self.move)
        alpha, beta = np.empty((n, labels)), np.empty((n, labels))
        sizes, at = lengths[order], offsets[:-1][order]
        longest = int(sizes[0]) if len(sizes) else 0
        # The lanes still active at step t are a prefix of `order`.
        active = np.searchsorted(-sizes, -np.arange(longest), "left")
        for t in range(longest):
            i = at[: active[t]] + t
            a = e[i] * (np.exp(self.start) if t == 0 else alpha[i - 1] @ move)
            alpha[i] = a / a.sum(1, keepdims=True)
        for t in range(longest - 1, -1, -1):
            i = at[: active[t]] + t
            b = np.ones((len(i), labels))
            if t + 1 < longest and active[t + 1]:
                j = i[: active[t + 1]] + 1
                b[: len(j)] = (e[j] * beta[j]) @ move.T
            beta[i] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(1, keepdims=True) if n else 1
        if each is None:
            return p, None
        inner = np.ones(n, bool)
        inner[offsets[:-1][lengths > 0]] = False
        j = np.flatnonzero(inner)
        joint = alpha[j - 1][:, :, None] * move[None] * (e[j] * beta[j])[:, None, :]
        joint *= (each[j] / joint.sum((1, 2)))[:, None, None]
        return p, joint.sum(0)

    def viterbi(self, emission: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The best label sequence of every sequence."""
        n, labels = emission.shape
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        sizes, at = lengths[order], offsets[:-1][order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), "left")
        best, back = np.empty((n, labels)), np.zeros((n, labels), np.int16)
        for t in range(longest):
            i = at[: active[t]] + t
            if t == 0:
                best[i] = emission[i] + self.start
            else:
                ways = best[i - 1][:, :, None] + self.move[None]
                back[i] = ways.argmax(1)
                best[i] = ways.max(1) + emission[i]
        out = np.zeros(n, np.int64)
        for t in range(longest - 1, -1, -1):
            i = at[: active[t]] + t
            ended = sizes[: len(i)] == t + 1
            out[i] = best[i].argmax(1)
            k = i[~ended]
            out[k] = back[k + 1, out[k + 1]]
        return out
