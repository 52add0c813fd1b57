"""Some eigenvectors of an operator that is only known by its products with blocks of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def span(block: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """An orthonormal basis of real columns that span those of ``block``."""
    if np.iscomplexobj(block):
        block = np.concatenate([block.real, block.imag], axis=1)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    return u[:, s > least * max(s[0], 1e-300)]


def block_davidson(apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, wanted: Callable[[np.ndarray], tuple[np.ndarray, int]], symmetric: bool, block: int, keep: int, residual: float, rounds: int, correction: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values and unit vectors (columns) of the operator behind ``apply``, one multiplication a round.

    ``wanted`` puts the values of a small matrix in the order they are looked for and tells how many of the first have to
    converge. The basis starts with ``start`` (orthonormal), is extended by ``correction`` (residuals, values) of those that
    haven't, with a few of the next ones, and shrinks to ``keep`` vectors when ``keep`` and three blocks are reached. Complex pairs go in by
    real and imaginary parts. Vectors that don't reach ``residual`` in ``rounds`` multiplications raise.
    """
    basis, product = start, apply(start)
    for _ in range(rounds):
        inner = basis.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2) if symmetric else np.linalg.eig(inner)
        order, m = wanted(values)
        values, turn = values[order], turn[:, order]
        rest = lambda at: product @ turn[:, at] - (basis @ turn[:, at]) * values[at]  # noqa: B023, E731
        first = rest(np.arange(m))
        open_ = np.flatnonzero(np.linalg.norm(first, axis=0) > residual)
        if not len(open_):
            return values[:m], basis @ turn[:, :m]
        # vectors a little further on go along: they keep the ones before apart from what follows
        ahead = np.arange(m, min(m + max(block - len(open_), 0) // 2, len(values)))
        grown = np.concatenate([first[:, open_[:block]], rest(ahead)], axis=1)
        if correction is not None:
            grown = correction(grown, np.concatenate([values[open_[:block]], values[ahead]]))
        grown = grown / np.maximum(np.linalg.norm(grown, axis=0), 1e-300)
        if basis.shape[1] + 2 * grown.shape[1] > keep + 3 * block:
            shrink = span(turn[:, :keep], 1e-10)
            basis, product = basis @ shrink, product @ shrink
        for _ in range(2):
            grown = span(grown - basis @ (basis.T @ grown))
        basis, product = np.column_stack([basis, grown]), np.column_stack([product, apply(grown)])
    raise ArithmeticError(f"{len(open_)} of {m} eigenvectors haven't converged in {rounds} rounds")
