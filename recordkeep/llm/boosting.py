"""Gradient-boosted trees on small binned samples, for models that are fitted on a bounded sample and broadcast."""

from __future__ import annotations

import numpy as np


class Trees:
    """Boosted regression trees of fixed depth for the logistic loss; ``fit`` and ``probability`` are vectorised."""

    def __init__(self, rounds: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.base = 0.0
        self.splits: list[tuple[np.ndarray, np.ndarray]] = []  # per tree: feature and threshold of each inner node
        self.leaves: list[np.ndarray] = []

    def _gain(self, left_g: np.ndarray, left_h: np.ndarray, all_g: np.ndarray, all_h: np.ndarray) -> np.ndarray:
        gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
        gain[(left_h < self.least) | (all_h - left_h < self.least)] = 0
        return gain

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Two kinds of columns: flags are summed by a matrix product, others by histograms of quantile bins."""
        n, width = x.shape
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        is_flag = ((x == 0) | (x == 1)).all(axis=0)
        flags, plain = np.flatnonzero(is_flag), np.flatnonzero(~is_flag)
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in plain]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in zip(plain, edges, strict=True)], axis=1) if len(plain) else np.zeros((n, 0), np.int64)
        offsets, row = np.arange(len(plain)) * self.bins, np.arange(n)
        set_flags = np.ascontiguousarray(x[:, flags].T.astype(np.float32))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            features, cuts = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                count, first = 2**level, 2**level - 1
                here = at - first
                all_g, all_h = (np.bincount(here, v, count)[:, None] for v in (g, h))
                held = np.zeros((n, 2 * count), np.float32)
                held[row, here], held[row, count + here] = g, h
                on = (set_flags @ held).T.astype(float)
                flag_gain = self._gain(all_g - on[:count], all_h - on[count:], all_g, all_h)
                slot = (here[:, None] * len(plain) * self.bins + offsets + binned).ravel()
                size = count * len(plain) * self.bins
                left_g, left_h = (np.cumsum(np.bincount(slot, np.repeat(v, len(plain)), size).reshape(count, len(plain), self.bins), axis=2).reshape(count, -1) for v in (g, h))
                plain_gain = self._gain(left_g, left_h, all_g, all_h)
                for node in range(count):
                    best_flag = int(flag_gain[node].argmax()) if len(flags) else -1
                    best_plain = int(plain_gain[node].argmax()) if len(plain) else -1
                    of_flag = flag_gain[node, best_flag] if best_flag >= 0 else 0.0
                    of_plain = plain_gain[node, best_plain] if best_plain >= 0 else 0.0
                    f, b = divmod(best_plain, self.bins)
                    if of_flag > max(of_plain, 1e-6):
                        features[first + node], cuts[first + node] = flags[best_flag], 0.5
                    elif of_plain > 1e-6 and b < len(edges[f]):
                        features[first + node], cuts[first + node] = plain[f], edges[f][b]
                at = 2 * at + 1 + (x[row, features[at]] > cuts[at])
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            score += value[leaf]
            self.splits.append((features, cuts))
            self.leaves.append(value)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, row = np.full(len(x), self.base), np.arange(len(x))
        for (features, cuts), value in zip(self.splits, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, features[at]] > cuts[at])
            score += value[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
