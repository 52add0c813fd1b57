"""Alignment with vectors held as tables, against the dense Laplacian."""

import numpy as np
import pytest
from test_numeric import laplacian

from netloom.operators import manifold as mf
from netloom.operators import wide_manifold as wm


@pytest.mark.parametrize(("symmetric", "d"), [(True, 3), (False, 5)])
def test_manifold_by_tables(spark, monkeypatch, symmetric, d):
    """Several chunks, groups and pieces of edges, genes without edges, complex pairs; the driver gets no vector of all genes."""

    def held(*_):
        raise AssertionError("a vector of all genes on the driver")

    for name, small in (("CHUNK", 16), ("GROUP", 3), ("PIECE", 500)):
        monkeypatch.setattr(wm, name, small)
    monkeypatch.setattr(mf.JointLaplacian, "apply", held)
    monkeypatch.setattr(mf.JointLaplacian, "dense", held)
    monkeypatch.setattr(mf.JointLaplacian, "diagonal", property(held))
    rng = np.random.default_rng(d)
    n, nets = 200, []
    for _ in range(2):
        w = np.where(rng.random((n, n)) < 0.06, np.round(rng.normal(0, 0.4, (n, n)), 3), 0)
        w[-3:] = w[:, -3:] = 0
        nets.append((w + w.T) / 2 if symmetric else w)
    frames = [spark.createDataFrame([(0, f"g{i:03d}", f"g{j:03d}", float(w[i, j])) for i, j in zip(*np.nonzero(w))], "net_id int, target string, source string, weight double") for w in nets]
    axis = spark.createDataFrame([(f"g{i:03d}",) for i in range(n)], "gene string")
    rows = {(r.side, r.gene): r for r in mf.manifold_alignment(*frames, d=d, x_genes=axis, y_genes=axis, driver_genes=0, dense_genes=0).collect()}
    assert len(rows) == 2 * n
    v = np.array([[complex(*z) for z in zip(rows[s, f"g{i:03d}"].coords, rows[s, f"g{i:03d}"].coords_im)] for s in "XY" for i in range(n)])
    whole = laplacian(*nets)
    values = np.linalg.eigvals(whole).real
    own = np.array([v[:, k].conj() @ whole @ v[:, k] for k in range(d)])
    np.testing.assert_allclose(np.linalg.norm(v, axis=0), 1, atol=1e-9)
    np.testing.assert_allclose(own.real, np.sort(values[values >= 1e-8])[:d], atol=1e-7)
    assert np.abs(whole @ v - v * own).max() < 1e-7
    assert symmetric or np.abs(own.imag).max() > 1e-3
