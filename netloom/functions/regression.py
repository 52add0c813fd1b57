"""Principal-component regression of every gene on all others, without a decomposition per gene."""

from __future__ import annotations

import numpy as np


def _one_gene(x: np.ndarray, k: int, n_comp: int) -> np.ndarray:
    """Coefficients of gene ``k`` straight from the decomposition without it."""
    rest = np.delete(x, k, axis=1)
    u, d, vt = np.linalg.svd(rest, full_matrices=False)
    return np.insert(vt[:n_comp].T @ ((u[:, :n_comp].T @ x[:, k]) / d[:n_comp]), k, 0.0)


def pc_coefficients(x: np.ndarray, genes: np.ndarray, n_comp: int = 3, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Row i: coefficients of all columns of ``x`` (cells x genes, scaled) for gene ``genes[i]``; 0 for itself.

    With K = X X' = Q D Q', leaving out gene k is a rank-one change of K: its leading eigenvalues solve
    1 = sum z_i^2 / (d_i - m) with z = Q' x_k, one root between neighbouring d; eigenvectors follow from the
    roots. All genes are solved at once by bisection. Where eigenvalues (nearly) repeat or z hardly meets
    one, the gene is solved on its own. ``pairs`` (D rising, Q), if known, saves the decomposition of K.
    """
    if not 2 < n_comp <= x.shape[1]:
        raise ValueError("n_comp must be above 2 and at most the number of genes")
    d, q = np.linalg.eigh(x @ x.T) if pairs is None else pairs
    d, q = d[::-1], q[:, ::-1]
    z = q.T @ x[:, genes]
    zz = z * z
    weights = np.zeros_like(z)
    top = max(d[0], 1e-300)
    hard = np.zeros(len(genes), bool)
    if len(d) <= n_comp:
        hard[:] = True
    for r in range(n_comp if not hard.all() else 0):
        gap = d[r] - d[r + 1]
        hard |= (gap < 1e-9 * top) | (zz[r] < 1e-14 * top) | (zz[r + 1] < 1e-14 * top)
        lo, hi = np.zeros(len(genes)), np.ones(len(genes))
        for _ in range(80):
            mid = (lo + hi) / 2
            m = d[r + 1] + gap * mid
            with np.errstate(divide="ignore", invalid="ignore"):
                f = 1 - (zz / (d[:, None] - m)).sum(axis=0)
            up = f > 0
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        m = d[r + 1] + gap * (lo + hi) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            u = z / (d[:, None] - m)
            u /= np.sqrt((u * u).sum(axis=0))
            weights += u * ((u * z).sum(axis=0) / m)
        hard |= ~np.isfinite(weights).all(axis=0)
    out = (x.T @ (q @ np.where(hard, 0.0, weights))).T
    out[np.arange(len(genes)), genes] = 0
    for i in np.flatnonzero(hard):
        out[i] = _one_gene(x, genes[i], n_comp)
    return out
