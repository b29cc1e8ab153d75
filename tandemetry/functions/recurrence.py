"""A cascade of second-order filters as one linear recurrence, worked off in blocks.

The state of a cascade is two numbers a part. What a block of samples adds to the output and to the state, and what a state
does over a block, are matrices found once by running the cascade on unit states and unit samples. So the samples of all
blocks are one product, and only the states are handed on one after the other; a stretch whose start isn't known yet can be
run from a state of zero and corrected, as the state after it is a power of one matrix times its start, plus what it added.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Cascade:
    """parts: (b0, b1, b2, a1, a2) each."""

    def __init__(self, parts: list[tuple[float, float, float, float, float]]):
        self.parts, self.size = parts, 2 * len(parts)
        self.step = self._run(np.zeros((1, self.size)), np.eye(self.size))[1]
        self.seen, self.kept = self._run(np.zeros((BLOCK, self.size)), np.eye(self.size))
        self.forced, self.added = self._run(np.eye(BLOCK), np.zeros((self.size, BLOCK)))

    def _run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample by sample; x: (sample, column), state: (2 a part, column)."""
        state = state.copy()
        for k, (b0, b1, b2, a1, a2) in enumerate(self.parts):
            p, q, y = state[2 * k], state[2 * k + 1], np.empty_like(x)
            for i, s in enumerate(x):
                y[i] = out = b0 * s + p
                p, q = b1 * s - a1 * out + q, b2 * s - a2 * out
            state[2 * k], state[2 * k + 1], x = p, q, y
        return x, state

    def steady(self, first: np.ndarray) -> np.ndarray:
        """The state in which a constant input ``first`` stays as it is."""
        return np.concatenate([[first * (1 - b0), first * (b2 - a2)] for b0, _, b2, _, a2 in self.parts])

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and state after x: (sample, column), from state: (2 a part, column)."""
        whole = len(x) // BLOCK
        u = x[: whole * BLOCK].reshape(whole, BLOCK, x.shape[1])
        y = np.einsum("ij,bjc->bic", self.forced, u)
        added = np.einsum("ij,bjc->bic", self.added, u)
        for b in range(whole):
            y[b] += self.seen @ state
            state = self.kept @ state + added[b]
        rest = x[whole * BLOCK :]
        if len(rest):  # a block's matrices, cut to the samples left
            m = len(rest)
            y_rest = self.seen[:m] @ state + self.forced[:m, :m] @ rest
            state = self.over(m) @ state + self.added[:, BLOCK - m :] @ rest
            rest = y_rest
        return np.concatenate([y.reshape(whole * BLOCK, x.shape[1]), rest]), state

    def over(self, samples: int) -> np.ndarray:
        """What a state becomes over so many samples of zero."""
        return np.linalg.matrix_power(self.step, samples)
