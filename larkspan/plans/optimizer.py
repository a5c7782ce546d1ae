"""The optimizer that all trainings share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Parameters, features, labels to summed gradient, summed loss, right answers.
Gradient = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, float, int]]


class Adam:
    """First and second moments kept from step to step."""

    def __init__(self, size: int, rate: float, b1: float = 0.9, b2: float = 0.999):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0
        self.rate, self.b1, self.b2 = rate, b1, b2

    def step(self, theta: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = self.b1 * self.m + (1 - self.b1) * grad
        self.v = self.b2 * self.v + (1 - self.b2) * grad**2
        m, v = self.m / (1 - self.b1**self.t), self.v / (1 - self.b2**self.t)
        return theta - self.rate * m / (np.sqrt(v) + 1e-8)
