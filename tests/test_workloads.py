"""The complete workloads against dense numpy, isolated and knocked-out genes and empty cells included."""

import numpy as np
import pytest
from test_numeric import brute_beta, spread

from netloom.jobs import workloads as wl
from netloom.operators.qc import QcParams

NC = {"n_nets": 2, "n_samp_cells": 25, "q": 0.9}
TD = {"rank": 2, "max_iter": 3, "decimals": 1}
QC = QcParams(min_lib_size=3, remove_outlier_cells=False, min_percent=0.05)


def sample(seed, genes, n_cells=30):
    """Counts of genes by cells; the last gene is in the few cells that no network draws, so that it has no edge."""
    rng = np.random.default_rng(seed)
    x = rng.poisson(rng.uniform(0.3, 3, (len(genes), 1)), (len(genes), n_cells)).astype(float)
    x[-1] = 0
    drawn = np.random.default_rng(42)
    x[-1, np.setdiff1d(np.arange(n_cells), [drawn.choice(n_cells + 1, NC["n_samp_cells"]) for _ in range(NC["n_nets"])])] = 2
    x[0, 5] = x[:, 5].sum()
    return x


def long(spark, samples):
    rows = [(label, g, f"c{j:02d}", float(x[i, j])) for label, genes, x in samples for i, g in enumerate(genes) for j in range(x.shape[1]) if x[i, j]]
    rows += [(label, "rare", "c99", 50.0) for label, _, _ in samples]  # this cell is kept and left without an entry
    return spark.createDataFrame(rows, "label string, gene string, cell string, value double")


def kept(genes, x):
    """Quality control of ``long``: genes by cells, cell c99 (no entry but the rare gene) last."""
    x = np.column_stack([x, np.zeros(len(x))])
    cells = np.append(x[:, :-1].sum(axis=0) > 3, True)
    x = x[:, cells]
    rows = (x > 0).sum(axis=1) / x.shape[1] > 0.05
    return [g for g, k in zip(genes, rows) if k], x[rows]


def network(x, q):
    """Scaled, thresholded network of one sample (genes by draws); genes without a positive sum or variance have no edges."""
    out, fine = np.zeros((len(x), len(x))), x.sum(axis=1) > 0
    vary = fine & (x.std(axis=1) > 0)
    z = ((x[vary] - x[vary].mean(axis=1, keepdims=True)) / x[vary].std(axis=1, keepdims=True)).T
    beta = np.array([brute_beta(z, k, 3) for k in range(vary.sum())])
    whole = np.zeros((fine.sum(), fine.sum()))
    at = np.flatnonzero(vary[fine])
    whole[np.ix_(at, at)] = beta
    cut, top = np.quantile(np.abs(whole), q), np.abs(whole).max()
    out[np.ix_(np.flatnonzero(fine), np.flatnonzero(fine))] = np.where(np.abs(whole) >= cut, whole / top, 0)
    return out


def networks(x):
    rng = np.random.default_rng(42)
    return [network(x[:, rng.choice(x.shape[1], NC["n_samp_cells"], replace=True)], NC["q"]) for _ in range(NC["n_nets"])]


def denoised(nets):
    """Alternating least squares on the cube of those rows and columns that have an edge, from the same start."""
    cube = np.stack(nets, axis=-1)
    rows, columns = (np.flatnonzero((cube != 0).any(axis=(k, 2))) for k in (1, 0))
    part = cube[np.ix_(rows, columns)]
    rng = np.random.default_rng(42)
    f = [rng.random((n, TD["rank"])) for n in part.shape]
    last = None
    for _ in range(TD["max_iter"]):
        for m, rule in enumerate(("ijt,jk,tk->ik", "ijt,ik,tk->jk", "ijt,ik,jk->tk")):
            a, b = (f[o] for o in range(3) if o != m)
            f[m] = np.einsum(rule, part, a, b) @ np.linalg.pinv((a.T @ a) * (b.T @ b))
        error = np.linalg.norm(part - np.einsum("ik,jk,tk->ijt", *f)) / np.linalg.norm(part)
        if last is not None and abs(last - error) < 1e-6:
            break
        last = error
    mean = np.einsum("ik,jk,k->ij", f[0], f[1], f[2].mean(axis=0))
    out = np.zeros(cube.shape[:2])
    out[np.ix_(rows, columns)] = np.round(mean / np.abs(mean).max(), TD["decimals"])
    return out


def distances(x, y, d):
    """Distance of the two sides of each gene on the joint manifold."""
    n = len(x)
    a, b = x + 1, y + 1
    cross = np.eye(n) * 0.9 * (a.sum() + b.sum()) / (2 * n)
    lap = -np.block([[a, cross], [cross, b]])
    np.fill_diagonal(lap, 0)
    np.fill_diagonal(lap, -lap.sum(axis=0))
    values, vectors = np.linalg.eigh(lap) if np.allclose(lap, lap.T) else np.linalg.eig(lap)
    order = [i for i in np.argsort(values.real, kind="stable") if values[i].real >= 1e-8][:d]
    v = vectors[:, order]
    return np.sqrt((np.abs(v[:n] - v[n:]) ** 2).sum(axis=1))


def check(found, genes, want):
    got = {r["Gene"]: r for r in found.collect()}
    assert sorted(got) == sorted(genes)
    np.testing.assert_allclose([got[g]["Distance"] for g in genes], want, atol=1e-6)
    np.testing.assert_allclose([got[g]["FC"] for g in genes], want**2 / np.mean(want**2), rtol=1e-4, atol=1e-6)


def test_net(spark):
    names = [f"g{i:02d}" for i in range(20)]
    one, two = names[:19] + ["z"], names[1:] + ["z"]
    samples = [("X", one, sample(1, one)), ("Y", two, sample(2, two))]
    sides, axis = {}, None
    for label, genes, x in samples:
        genes, x = kept(genes, x)
        sides[label] = (genes, x / np.where(x.sum(axis=0) > 0, x.sum(axis=0), 1) * 1e6)
        axis = set(genes) if axis is None else axis & set(genes)
    axis, dense = sorted(axis), []
    for genes, x in sides.values():
        w = denoised(networks(x[[genes.index(g) for g in axis]]))
        dense.append((w + w.T) / 2)
    assert any((w == 0).all(axis=0).any() for w in dense)  # a gene without an edge keeps its row
    check(wl.net(long(spark, samples), QC, nc=NC, td=TD, ma={"d": 3}), axis, distances(*dense, 3))


@pytest.mark.parametrize("method", ["default", "propagation"])
def test_knk(spark, method):
    genes = [f"g{i:02d}" for i in range(20)]
    x = sample(3, genes)
    entries = long(spark, [("all", genes, x)])
    genes, x = kept(genes, x)
    out = [genes.index("g03"), genes.index("g08")]
    nets = networks(x)

    def finish(stack):
        w = denoised(stack).T.copy()
        np.fill_diagonal(w, 0)
        return w

    wild = finish(nets)
    if method == "default":
        knocked = wild.copy()
        knocked[out] = 0
    else:
        again = []
        for w in nets:
            w = w.copy()
            np.fill_diagonal(w, 0)
            left = spread(w, x, out, 2)
            again.append(network(left[:, np.random.default_rng(42).choice(x.shape[1], NC["n_samp_cells"], replace=True)], NC["q"]))
        knocked = finish(again)
    found = wl.knk(entries, ["g03", "g08"], method, degree=2, qc=QC, nc=NC, td=TD)
    check(found, genes, distances(wild, knocked, 2))
    with pytest.raises(KeyError):
        wl.knk(entries, ["none"], qc=QC, nc=NC, td=TD)


def test_steps(spark, tmp_path):
    """Both kinds of run, step by step through a folder, end where the whole job ends."""
    names = [f"g{i:02d}" for i in range(12)]
    limits = dict(min_lib_size=3, remove_outlier_cells=False, min_percent=0.05)
    pair = long(spark, [("X", names, sample(4, names)), ("Y", names, sample(5, names))])
    values = lambda df: {r["Gene"]: round(r["Distance"], 6) for r in df.collect()}
    folder = str(tmp_path / "net")
    wl.run_step(spark, folder, "qc", pair, **limits)
    for step, keywords in (("nc", NC), ("td", TD), ("ma", {"d": 2}), ("dr", {})):
        last = wl.run_step(spark, folder, step, **keywords)
    assert values(last) == values(wl.net(pair, QC, nc=NC, td=TD, ma={"d": 2}))
    one = pair.filter("label = 'X'")
    folder = str(tmp_path / "knk")
    wl.run_step(spark, folder, "qc", one, labels=("X",), **limits, min_exp_avg=0, min_exp_sum=0)
    for step, keywords in (("nc", NC), ("td", TD), ("ko", {"ko_genes": ["g01"], "method": "propagation", "nc": NC, "td": TD}), ("ma", {}), ("dr", {})):
        last = wl.run_step(spark, folder, step, labels=("X",), **keywords)
    assert values(last) == values(wl.knk(one, ["g01"], "propagation", qc=QC, nc=NC, td=TD))
    with pytest.raises(ValueError):
        wl.run_step(spark, folder, "ko")
