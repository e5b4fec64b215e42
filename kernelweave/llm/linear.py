"""Sparse rows in numpy and the two ways of fitting a logistic scorer to them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Rows of (feature, value); feature 0 is in every row, so that none is empty."""

    features: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, features: list[np.ndarray], values: list[np.ndarray]) -> Rows:
        lengths = np.fromiter(map(len, features), np.int64, len(features))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return cls(np.concatenate(features), np.concatenate(values).astype(np.float64), starts)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * weights[self.features], self.starts)

    def gradient(self, by_row: np.ndarray, width: int) -> np.ndarray:
        lengths = np.diff(np.append(self.starts, len(self.features)))
        return np.bincount(self.features, self.values * np.repeat(by_row, lengths), width)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def adam(gradient: Callable[[np.ndarray], np.ndarray], width: int, rounds: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def fit_soft(rows: Rows, targets: np.ndarray, width: int, rounds=120, rate=0.1, decay=1e-5) -> np.ndarray:
    """Weights that minimise the log loss against soft labels."""
    n = len(targets)
    return adam(lambda w: rows.gradient((sigmoid(rows.dot(w)) - targets) / n, width) + decay * w, width, rounds, rate)


def fit_positive_unlabelled(
    positive: Rows, unlabelled: Rows, prior: float, width: int, rounds=300, rate=0.05, decay=1e-5
) -> np.ndarray:
    """Non-negative positive-unlabelled risk with the logistic loss.

    The risk is prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)]). Where the estimate of the
    negative part falls below zero, the step climbs out of it instead of following it down.
    """
    n_p, n_u = len(positive.starts), len(unlabelled.starts)

    def gradient(w):
        z_p, z_u = positive.dot(w), unlabelled.dot(w)
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        of_negative = unlabelled.gradient(sigmoid(z_u) / n_u, width) - prior * positive.gradient(
            sigmoid(z_p) / n_p, width
        )
        if negative < 0:
            return -of_negative
        return prior * positive.gradient(-sigmoid(-z_p) / n_p, width) + of_negative + decay * w

    return adam(gradient, width, rounds, rate)
