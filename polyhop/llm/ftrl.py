"""Logistic regression on sparse hashed features by follow-the-regularised-leader (proximal) updates."""

from __future__ import annotations

import numpy as np


class Ftrl:
    def __init__(self, dim: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.dim, self.alpha, self.beta, self.l1, self.l2 = dim, alpha, beta, l1, l2
        self.z = np.zeros(dim + 1)  # the last one is the bias
        self.n = np.zeros(dim + 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == self.dim, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, i: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g

    def weights(self) -> np.ndarray:
        return self.at(np.arange(self.dim + 1))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, *, epochs: int = 3, pairs: dict[int, list] | None = None, penalty: float = 0.0, seed: int = 0, **kw) -> np.ndarray:
    """rows: each example's feature places and values. pairs: of some examples, how their features differ from
    those of counterfactual forms, in the same shape; the penalty is on the squared difference of the two logits. Returns
    dim weights and the bias."""
    model, rng = Ftrl(dim, **kw), np.random.default_rng(seed)
    bias_i, bias_v = np.array([dim]), np.array([1.0])
    rows = [(np.concatenate([i, bias_i]), np.concatenate([v, bias_v])) for i, v in rows]
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, v = rows[k]
            w = model.at(i)
            f = float(w @ v)
            g = (sigmoid(f) - y[k]) * v
            model.step(i, g, w)
            for at, d in (pairs or {}).get(k, ()):
                w = model.at(at)
                if gap := float(w @ d):
                    model.step(at, penalty * gap * d, w)
    return model.weights()
