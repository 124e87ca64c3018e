"""Linear models on sparse rows in numpy: small enough for one machine, fitted on bounded samples."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: `first` has each row's first entry and the end."""

    def __init__(self, first: np.ndarray, index: np.ndarray, value: np.ndarray, width: int):
        self.first, self.index, self.value, self.width = first, index, value, width
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.index], len(self.first) - 1)

    def back(self, of_rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * of_rows[self.row], self.width)

    def __len__(self) -> int:
        return len(self.first) - 1


def rows_from(lists: list, width: int) -> Rows:
    """Rows from (indices, values) pairs."""
    first = np.concatenate([[0], np.cumsum([len(i) for i, _ in lists])]).astype(np.int64)
    cat = lambda k, kind: np.concatenate([np.asarray(x[k], kind) for x in lists]) if lists else np.zeros(0, kind)
    return Rows(first, cat(0, np.int64), cat(1, np.float64), width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Steps for a vector of parameters."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient**2 - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit_logistic(x: Rows, target: np.ndarray, l2: float = 1e-5, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft targets in [0, 1], both classes weighing the same."""
    both = np.zeros(x.width + 1)
    adam = Adam(len(both), rate)
    positive, negative = target / max(target.sum(), 1e-9) / 2, (1 - target) / max((1 - target).sum(), 1e-9) / 2
    for _ in range(rounds):
        p = sigmoid(x.times(both[:-1]) + both[-1])
        g = -positive * (1 - p) + negative * p
        both -= adam.step(np.concatenate([x.back(g) + l2 * both[:-1], [g.sum()]]))
    return both[:-1], float(both[-1])


def fit_nonnegative_pu(x: Rows, positive: np.ndarray, prior: float, l2: float = 2e-5, rounds: int = 600, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept from positives and unlabelled rows: the risk of calling unlabelled rows negative,
    less the part that positives among them make up, never counts below zero."""
    both = np.zeros(x.width + 1)
    both[-1] = np.log(prior / (1 - prior))
    adam = Adam(len(both), rate)
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    for _ in range(rounds):
        z = x.times(both[:-1]) + both[-1]
        p, as_negative = sigmoid(z), np.logaddexp(0, z)
        rest = as_negative[~positive].sum() / n_u - prior * as_negative[positive].sum() / n_p
        if rest >= 0:
            g = np.where(positive, -prior * (1 - p) / n_p - prior * p / n_p, p / n_u)
        else:  # step back out of the overfit
            g = np.where(positive, prior * p / n_p, -p / n_u)
        both -= adam.step(np.concatenate([x.back(g) + l2 * both[:-1], [g.sum()]]))
    return both[:-1], float(both[-1])
