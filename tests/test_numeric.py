"""Numeric cores against brute force from the definition."""

import math

import numpy as np
import pytest

from netloom.functions.regression import _one_gene, pc_coefficients
from netloom.functions.statistics import boxcox_lambda, chi2_sf, gamma_q
from netloom.operators import edges as ed
from netloom.operators import manifold as mf
from netloom.operators import pcnet, tensor
from netloom.operators import regulation as rg


def scaled(n, g, seed):
    x = np.random.default_rng(seed).poisson(2.0, (n, g)).astype(float)
    return (x - x.mean(axis=0)) / x.std(axis=0)


def brute_beta(x, k, n_comp):
    """Scores of the other genes' leading components, each scaled by its square, times the gene."""
    rest = np.delete(x, k, axis=1)
    v = np.linalg.svd(rest, full_matrices=False)[2][:n_comp].T
    s = rest @ v
    s = s / (s**2).sum(axis=0)
    return np.insert(v @ (s.T @ x[:, k]), k, 0)


@pytest.mark.parametrize(("n", "g"), [(100, 60), (40, 120), (12, 9)])
def test_pc_coefficients(n, g):
    x = scaled(n, g, n)
    got = pc_coefficients(x, np.arange(g), 3)
    want = np.array([brute_beta(x, k, 3) for k in range(g)])
    np.testing.assert_allclose(got, want, atol=1e-8)
    np.testing.assert_allclose(_one_gene(x, 2, 3), want[2], atol=1e-8)


def test_pc_coefficients_repeated_genes():
    x = scaled(30, 10, 1)
    x[:, 5] = x[:, 4]
    got = pc_coefficients(x, np.array([4, 5]), 3)
    np.testing.assert_allclose(got[0], brute_beta(x, 4, 3), atol=1e-7)
    with pytest.raises(ValueError):
        pc_coefficients(x, np.array([0]), 2)


def test_all_cells_network(spark):
    x = np.random.default_rng(6).poisson(0.7, (60, 12)).astype(float)
    x[0] += 1
    rows = [("all", f"g{j:02d}", f"c{i}", float(x[i, j])) for i in range(60) for j in range(12) if x[i, j]]
    rows += [("all", "g99", f"c{i}", 1.0) for i in range(60)]  # doesn't vary
    entries = spark.createDataFrame(rows, "label string, gene string, cell string, value double")
    got = {(r.target, r.source): r.weight for r in pcnet.all_cells_network(entries).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for k in range(12):
        want = brute_beta(z, k, 3)
        for j in range(12):
            assert abs(got.get((f"g{k:02d}", f"g{j:02d}"), 0.0) - want[j]) < 1e-6
    assert not any("g99" in k for k in got)


def test_all_cells_network_of_genes_apart(spark):
    """Genes that no cell shares are still correlated: each is found where the other is not."""
    x = np.random.default_rng(8).poisson(1.5, (80, 10)).astype(float)
    x[:40, 0], x[40:, 1] = 0, 0
    assert not (x[:, 0] * x[:, 1]).any()
    entries = spark.createDataFrame([(f"g{j:02d}", f"c{i}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "gene string, cell string, value double")
    got = {(r.target, r.source): r.weight for r in pcnet.all_cells_network(entries).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for k in range(10):
        np.testing.assert_allclose([got.get((f"g{k:02d}", f"g{j:02d}"), 0.0) for j in range(10)], brute_beta(z, k, 3), atol=1e-6)


@pytest.mark.parametrize(("held", "pairs"), [(8_000_000, 1 << 21), (500, 64)])
def test_gene_gram(spark, monkeypatch, held, pairs):
    """Repeated and null entries, negative ones, several strips of genes; all at once and in many small steps."""
    monkeypatch.setattr(pcnet, "GRAM_ENTRIES", held)
    monkeypatch.setattr(pcnet, "GRAM_PAIRS", pairs)
    rng = np.random.default_rng(0)
    rows = [(f"c{c}", f"g{g:03d}", float(v)) for c, g, v in zip(rng.integers(0, 40, 2500), rng.integers(0, 600, 2500), rng.integers(-3, 5, 2500))]
    x = np.zeros((40, 600))
    for c, g, v in rows:
        x[int(c[1:]), int(g[1:])] += v
    entries = spark.createDataFrame([*rows, ("c1", "g001", None)], "cell string, gene string, value double")
    gram = x.T @ x
    want = {(f"g{i:03d}", f"g{j:03d}"): gram[i, j] for i, j in zip(*np.nonzero(gram)) if i <= j}
    assert {(r.g1, r.g2): r.dot for r in pcnet.gene_gram(entries).collect()} == want
    assert pcnet.gene_gram(entries.filter("false")).collect() == []


def test_pc_networks_in_parts(spark, monkeypatch):
    """Several networks of unlike samples, several blocks and parts of genes; a cell drawn twice, one without an entry."""
    monkeypatch.setattr(pcnet, "GENE_BLOCK", 4)
    monkeypatch.setattr(pcnet, "OWN_GENES", 8)
    rng = np.random.default_rng(14)
    rows, draws, want = [], [], {}
    for net, n in ((0, 30), (1, 14)):
        x = rng.poisson(1.2, (n, 21)).astype(float)
        x[:, 20], x[3] = 0, 0
        x[5] = x[4]
        rows += [(net, i, f"g{j:02d}", f"c{min(i, 4) if i == 5 else i}", float(x[i, j])) for i in range(n) for j in range(21) if x[i, j]]
        draws += [(net, i, f"c{4 if i == 5 else i}") for i in range(n)]
        z = (x[:, :20] - x[:, :20].mean(axis=0)) / x[:, :20].std(axis=0)
        want |= {(net, f"g{k:02d}"): brute_beta(z, k, 3) for k in range(20)}
    drawn = spark.createDataFrame(rows, "net_id int, draw_id int, gene string, cell string, value double").repartition(5)
    got = {(r.net_id, r.target, r.source): r.weight for r in pcnet.pc_networks(drawn, spark.createDataFrame(draws, "net_id int, draw_id int, cell string")).collect()}
    assert not any("g20" in k for k in got)
    for (net, k), beta in want.items():
        np.testing.assert_allclose([got.get((net, k, f"g{j:02d}"), 0.0) for j in range(20)], beta, atol=1e-7)


def decaying(seed, n=90, genes=70, rank=8):
    """Counts whose spectrum falls to nothing after some components, with a gene and a cell without an entry."""
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, rank)) * 2.0 ** -np.arange(rank)) @ rng.standard_normal((rank, genes)) + 3
    x[7], x[:, 11] = 0, 0
    return x


def entries_of(spark, x):
    rows = [("all", f"g{j:02d}", f"c{i:02d}", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]]
    axes = (spark.createDataFrame([(f"c{i:02d}",) for i in range(len(x))], "cell string"), spark.createDataFrame([(f"g{j:02d}",) for j in range(x.shape[1])], "gene string"))
    return spark.createDataFrame(rows, "label string, gene string, cell string, value double"), *axes


@pytest.mark.parametrize("standardize", [True, False])
def test_pca_by_products(spark, standardize):
    from netloom.operators import views

    x = decaying(2)
    entries, cells, genes = entries_of(spark, x)
    std = np.where(x.std(axis=0) > 0, x.std(axis=0), 1) if standardize else 1
    z = (x - x.mean(axis=0)) / std
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    for dense in (0, 5000):
        scores, shares, loadings = views.pca_tables(entries, 4, standardize, None, cells, genes, dense)
        got = np.array([[r[f"PC{k}"] for k in range(1, 5)] for r in sorted(scores.collect(), key=lambda r: r.cell)])
        np.testing.assert_allclose(np.abs(got), np.abs(u[:, :4] * s[:4]), atol=1e-6)
        np.testing.assert_allclose([r.share for r in sorted(shares.collect(), key=lambda r: r.component)], (s**2 / (s**2).sum())[:4], rtol=1e-8)
        np.testing.assert_allclose(np.abs([r.loadings for r in sorted(loadings.collect(), key=lambda r: r.gene)]), np.abs(vt[:4].T), atol=1e-6)
    with pytest.raises(ValueError):
        views.pca_tables(entries, dense_genes=3)


def test_all_cells_network_by_products(spark):
    """Without the matrix of all genes: on a falling spectrum the leading eigenpairs give the same network."""
    x = decaying(3)
    entries, cells, _ = entries_of(spark, x)
    weights = lambda df: {(r.target, r.source): r.weight for r in df.collect()}
    got, want = (weights(pcnet.all_cells_network(entries, 3, cells, dense, 20)) for dense in (0, 5000))
    assert got and max(abs(got.get(k, 0.0) - want.get(k, 0.0)) for k in got.keys() | want.keys()) < 1e-6


@pytest.mark.parametrize("block", [1 << 21, 1000])
def test_all_cells_network_leaves_no_component_out(spark, monkeypatch, block):
    """A flat spectrum, repeated eigenvalues, twin genes, one that doesn't vary: without the matrix the network is that of the definition, whatever the rank."""
    monkeypatch.setattr(pcnet, "BLOCK_NUMBERS", block)
    x = np.random.default_rng(21).poisson(0.8, (90, 60)).astype(float)
    x[:, 31], x[:, 40] = x[:, 30], 1
    entries, cells, _ = entries_of(spark, x)
    vary = [j for j in range(60) if j != 40]
    z = (x[:, vary] - x[:, vary].mean(axis=0)) / x[:, vary].std(axis=0)
    got = {(r.target, r.source): r.weight for r in pcnet.all_cells_network(entries, 3, cells, 0, 6).collect()}
    assert not any("g40" in k for k in got)
    for k, target in enumerate(vary):
        np.testing.assert_allclose([got.get((f"g{target:02d}", f"g{j:02d}"), 0.0) for j in vary], brute_beta(z, k, 3), atol=1e-7)


def test_chi2():
    for x in (0.0, 0.1, 1.0, 3.84, 20.0, 200.0):
        assert abs(chi2_sf(x) - gamma_q(0.5, x / 2)) < 1e-12
    assert abs(chi2_sf(3.0, 2) - math.exp(-1.5)) < 1e-12


def test_boxcox_lambda(spark):
    values = np.exp(np.random.default_rng(3).normal(0.3, 0.7, 400))
    df = spark.createDataFrame([(float(v),) for v in values], "distance double")

    def worth(k):
        t = np.log(values) if abs(k) < 1e-12 else (values**k - 1) / k
        return (k - 1) * np.log(values).sum() - len(values) / 2 * np.log(t.var())

    best = max(np.linspace(-4, 4, 8001), key=worth)
    assert abs(boxcox_lambda(df) - best) < 2e-3


def cube_of(seed, rank=2, noise=0.0):
    rng = np.random.default_rng(seed)
    cube = np.einsum("ik,jk,tk->ijt", rng.random((6, rank)), rng.random((5, rank)), rng.random((3, rank)))
    return cube + noise * rng.standard_normal(cube.shape)


def stack_of(spark, cube):
    rows = [(t, f"g{i}", f"g{j}", float(cube[i, j, t])) for i in range(6) for j in range(5) for t in range(3)]
    return spark.createDataFrame(rows, "net_id int, target string, source string, weight double")


def plain_als(cube, rank, sweeps, seed=42):
    """Errors by sweep and the last factors, on the dense cube from the same seeded start."""
    rng = np.random.default_rng(seed)
    f, errors = [rng.random((n, rank)) for n in cube.shape], []
    for _ in range(sweeps):
        for m in range(3):
            a, b = (f[o] for o in range(3) if o != m)
            unfolded = np.moveaxis(cube, m, 0).reshape(cube.shape[m], -1)
            f[m] = unfolded @ np.einsum("ik,jk->ijk", a, b).reshape(-1, rank) @ np.linalg.pinv((a.T @ a) * (b.T @ b))
        errors.append(np.linalg.norm(cube - np.einsum("ik,jk,tk->ijt", *f)) / np.linalg.norm(cube))
    return errors, f


def test_cp_als_against_dense(spark, tmp_path):
    """Errors sweep by sweep, the mean network, its rounding; a run that stops goes on from its saved state."""
    cube = cube_of(0, noise=0.02)
    edges = stack_of(spark, cube)
    errors, f = plain_als(cube, 2, 5)
    model = tensor.cp_als(edges, rank=2, tol=0, max_iter=5)
    np.testing.assert_allclose(model.errors, errors, rtol=1e-8)
    mean = np.einsum("ik,jk,k->ij", f[0], f[1], f[2].mean(axis=0))
    got = {(r.target, r.source): r.weight for r in tensor.average_network(model).collect()}
    assert max(abs(got[f"g{i}", f"g{j}"] - mean[i, j]) for i in range(6) for j in range(5)) < 1e-8
    rounded = np.rint(mean / np.abs(mean).max() * 10) / 10
    want = {(f"g{i}", f"g{j}"): rounded[i, j] for i, j in zip(*np.nonzero(rounded))}
    assert {(r.target, r.source): r.weight for r in tensor.denoised_network(model).collect()} == want
    state = str(tmp_path / "state")
    tensor.cp_als(edges, rank=2, tol=0, max_iter=3, state=state, save_every=2)
    (tmp_path / "state" / "4" / "target").mkdir(parents=True)  # a state that wasn't finished
    again = tensor.cp_als(edges, rank=2, tol=0, max_iter=5, state=state, save_every=2)
    np.testing.assert_allclose(again.errors, errors, rtol=1e-8)


def test_cp_als_start_is_one_stream(spark):
    """Rows dealt anyhow have the numbers of one seeded stream."""
    names = spark.createDataFrame([(i,) for i in range(40)], "at long").repartition(5)
    got = {r.source: r.f for r in tensor._start(names, "source", 3, 42, 21).collect()}
    rng = np.random.default_rng(42)
    rng.random(21)
    want = rng.random((40, 3))
    assert all(got[i] == want[i].tolist() for i in range(40))


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(tensor, "TILE_ROWS", 4)
    monkeypatch.setattr(tensor, "TILE_COLUMNS", 3)
    cube = cube_of(4)
    model = tensor.cp_als(stack_of(spark, cube), rank=2, tol=1e-7, max_iter=12)
    assert all(x >= y - 1e-9 for x, y in zip(model.errors, model.errors[1:])) and model.errors[-1] < 0.1
    got = {(r.target, r.source): r.weight for r in tensor.average_network(model).collect()}
    assert len(got) == 30 and max(abs(got[f"g{i}", f"g{j}"] - cube[i, j].mean()) for i in range(6) for j in range(5)) < 0.1


@pytest.mark.parametrize("symmetric", [True, False])
def test_manifold_residual(spark, symmetric):
    """Eigenvectors of the joint Laplacian built densely, for networks with isolated genes, symmetric or not."""
    rng = np.random.default_rng(3)
    n, nets = 9, []
    for _ in range(2):
        w = np.round(rng.normal(0, 0.5, (n, n)) * (rng.random((n, n)) < 0.3), 2)
        w[[2, 7]] = 0
        w[:, [2, 7]] = 0
        nets.append((w + w.T) / 2 if symmetric else w)
    frames = [spark.createDataFrame([(0, f"g{i}", f"g{j}", float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "net_id int, target string, source string, weight double") for w in nets]
    axis = spark.createDataFrame([(f"g{i}",) for i in range(n)], "gene string")
    rows = {(r.side, r.gene): r for r in mf.manifold_alignment(*frames, d=3, x_genes=axis, y_genes=axis).collect()}
    assert len(rows) == 2 * n
    lap = laplacian(*nets)
    values = np.linalg.eigvals(lap)
    values = sorted((v for v in values if v.real >= 1e-8), key=lambda v: v.real)[:3]
    v = np.array([[complex(*z) for z in zip(rows[s, f"g{i}"].coords, rows[s, f"g{i}"].coords_im)] for s in "XY" for i in range(n)])
    for k, value in enumerate(values):
        own = (v[:, k].conj() @ lap @ v[:, k]) / (v[:, k].conj() @ v[:, k])
        assert abs(own.real - value.real) < 1e-8
        np.testing.assert_allclose(lap @ v[:, k], own * v[:, k], atol=1e-7)


def test_manifold_of_equal_networks(spark):
    rng = np.random.default_rng(5)
    w = rng.random((8, 8))
    w = np.round((w + w.T) / 2, 3)
    rows = [(0, f"g{i}", f"g{j}", float(w[i, j])) for i in range(8) for j in range(8)]
    e = spark.createDataFrame(rows, "net_id int, target string, source string, weight double")
    got = {(r.side, r.gene): np.array(r.coords) for r in mf.manifold_alignment(e, e, d=3).collect()}
    assert len(got) == 16
    # equal networks: the lowest vectors agree on both sides
    for i in range(8):
        np.testing.assert_allclose(got["X", f"g{i}"], got["Y", f"g{i}"], atol=1e-6)


def laplacian(x, y):
    """From degrees: each gene's sum of (weight + 1) over the others into it, and the coupling of its two sides."""
    n = len(x)
    c = 0.9 * (x.sum() + y.sum() + 2 * n * n) / (2 * n)
    out = np.zeros((2 * n, 2 * n))
    for w, at in ((x, 0), (y, n)):
        for j in range(n):
            into = [i for i in range(n) if i != j]
            out[at + np.array(into), at + j] = -(w[into, j] + 1)
            out[at + j, at + j] = (w[into, j] + 1).sum() + c
            out[at + j, (at + j + n) % (2 * n)] = -c
    return out


@pytest.mark.parametrize(("symmetric", "d"), [(True, 3), (False, 12)])
def test_manifold_by_blocks(spark, symmetric, d):
    """The iterative path against the dense one: values, residuals, distances of genes; with isolated genes."""
    rng = np.random.default_rng(d)
    n, nets = 200, []
    for _ in range(2):
        w = np.where(rng.random((n, n)) < 0.06, np.round(rng.normal(0, 0.4, (n, n)), 3), 0)
        w[-3:] = w[:, -3:] = 0
        nets.append((w + w.T) / 2 if symmetric else w)
    frames = [spark.createDataFrame([(0, f"g{i:03d}", f"g{j:03d}", float(w[i, j])) for i, j in zip(*np.nonzero(w))], "net_id int, target string, source string, weight double") for w in nets]
    axis = spark.createDataFrame([(f"g{i:03d}",) for i in range(n)], "gene string")
    lap = mf.JointLaplacian(*mf.align_networks(*frames, axis, axis))
    whole = laplacian(*nets)
    np.testing.assert_allclose(lap.dense(), whole, atol=1e-9)
    block = rng.standard_normal((2 * n, 5))
    np.testing.assert_allclose(lap.apply(block), whole @ block, atol=1e-9)
    assert lap.symmetric() == symmetric
    values, vectors = mf.smallest_eigenvectors(lap, d)
    all_values = np.linalg.eigvals(whole)
    want = np.sort([v.real for v in all_values if v.real >= 1e-8])[:d]
    np.testing.assert_allclose(values.real, want, atol=1e-7)
    assert np.abs(whole @ vectors - vectors * values).max() < 1e-7
    if not symmetric:
        assert np.abs(values.imag).max() > 1e-3
    apart = lambda table: {r.gene: r.distance for r in rg.pair_distance(table).collect()}
    by_blocks, by_dense = apart(mf.manifold_table(lap, vectors)), apart(mf.manifold_alignment(*frames, d=d, x_genes=axis, y_genes=axis))
    assert len(by_blocks) == n and max(abs(by_blocks[g] - by_dense[g]) for g in by_dense) < 1e-6


def test_manifold_takes_few_products():
    """Sparse networks of small weights: the diagonal tells the genes apart, whatever the coupling; the smallest values aren't missed."""
    rng, n, d = np.random.default_rng(3), 800, 2
    nets = []
    for _ in range(2):
        w = np.triu(np.where(rng.random((n, n)) < 0.015, rng.random((n, n)), 0), 1)
        w[0] = w[:, 0] = 0
        nets.append(w + w.T)
    whole = laplacian(*nets)
    lap, products = mf.JointLaplacian.__new__(mf.JointLaplacian), []
    lap.n, lap.c, lap.diagonal = n, -whole[0, n], whole.diagonal().copy()
    lap.symmetric = lambda: True
    lap.apply = lambda block: products.append(block.shape[1]) or whole @ block
    values, vectors = mf.smallest_eigenvectors(lap, d)
    want = np.linalg.eigvalsh(whole)
    np.testing.assert_allclose(values, want[want >= 1e-8][:d], atol=1e-7)
    assert np.abs(whole @ vectors - vectors * values).max() < 1e-7
    assert len(products) <= 40


def spread(b, x, seeds, degree):
    """A knockout that spreads in one network, on dense arrays."""
    live, p = b.copy(), np.zeros_like(x)
    p[seeds] = x[seeds]
    total, seen = p.copy(), np.zeros(len(x), bool)
    for _ in range(degree):
        if seen.all():
            break
        p = live @ p
        total += p
        live[seen] = 0
        live[:, seen] = 0
        seen = seen | (p != 0).any(axis=1)
    return np.maximum(x - total, 0)


@pytest.mark.parametrize("seeds", [[1], [0, 4]])
def test_propagation_against_dense(spark, seeds):
    """Three networks side by side: sparse, full (all genes reached at once) and without edges; one gene has no counts."""
    rng = np.random.default_rng(8)
    nets = [np.round(rng.normal(0, 1, (7, 7)) * (rng.random((7, 7)) < share), 2) for share in (0.35, 1.0, 0.0)]
    nets[2][2, 5] = 1.0
    x = rng.poisson(3, (7, 4)).astype(float)
    x[6] = 0
    rows = [(t, f"g{i}", f"g{j}", float(b[i, j])) for t, b in enumerate(nets) for i in range(7) for j in range(7) if i != j and b[i, j]]
    edges = spark.createDataFrame(rows, "net_id int, target string, source string, weight double")
    counts = spark.createDataFrame([(f"g{i}", f"c{j}", float(x[i, j])) for i in range(7) for j in range(4) if x[i, j]], "gene string, cell string, value double")
    axis = spark.createDataFrame([(f"g{i}",) for i in range(7)], "gene string")
    names = [f"g{i}" for i in seeds]
    got = np.zeros((3, 7, 4))
    for r in ed.propagate_knockout(edges, counts, names, 3, axis).collect():
        got[r.net_id, int(r.gene[1:]), int(r.cell[1:])] = r.value
    for t, b in enumerate(nets):
        b = b.copy()
        np.fill_diagonal(b, 0)
        np.testing.assert_allclose(got[t], spread(b, x, seeds, 3), atol=1e-9)
    some = ed.propagate_knockout(edges, counts, names, 3, axis, spark.createDataFrame([("c2",)], "cell string")).collect()
    assert {r.cell for r in some} == {"c2"} and len(some) == (got[:, :, 2] > 0).sum()
    with pytest.raises(KeyError):
        ed.propagate_knockout(edges, counts, ["g1", "zz"], 1, axis)


def test_numbered(spark):
    from netloom.storage import numbered

    rows = [(f"n{i:03d}",) for i in range(300)]
    got = numbered(spark.createDataFrame(rows[::-1], "name string").repartition(7), "name", name="at").collect()
    assert sorted((r["at"], r.name) for r in got) == [(i, f"n{i:03d}") for i in range(300)]
    assert numbered(spark.createDataFrame([], "name string"), "name").collect() == []


def test_quantile_against_numpy(spark):
    """Many ties, values far apart, an empty network row: cuts equal numpy's on the dense matrix."""
    rng = np.random.default_rng(12)
    nets = [np.round(rng.normal(0, 1, (9, 9)), 1), rng.normal(0, 1, (9, 9)) * 10.0 ** rng.integers(-12, 4, (9, 9)), np.eye(9)]
    rows = [(t, f"g{i}", f"g{j}", float(w[i, j])) for t, w in enumerate(nets) for i in range(9) for j in range(9) if w[i, j]]
    edges = spark.createDataFrame(rows, "net_id int, target string, source string, weight double")
    sizes = spark.createDataFrame([(t, 9) for t in range(3)], "net_id int, n_genes int")
    for q in (0.0, 0.37, 0.9, 0.95, 1.0):
        got = ed.quantile_threshold(edges, sizes, q).collect()
        for t, w in enumerate(nets):
            cut = np.quantile(np.abs(w), q)
            assert sorted(r.weight for r in got if r.net_id == t) == sorted(w[(np.abs(w) >= cut) & (w != 0)].tolist())


def test_knockout_spreads_as_weights_of_the_knocked_out_genes(spark, monkeypatch):
    """No step may make a row for each gene and cell: with many cells that share a few profiles, all but the result stays small; values as by matrices."""
    rng = np.random.default_rng(3)
    n, cells = 6, 400
    w = {i: np.where(rng.random((n, n)) < 0.5, rng.integers(-3, 4, (n, n)), 0).astype(float) for i in (0, 1)}
    for m in w.values():
        np.fill_diagonal(m, 0)
    x = rng.integers(0, 3, (n, cells)).astype(float)
    edges = spark.createDataFrame([(i, f"g{t}", f"g{s}", float(m[t, s])) for i, m in w.items() for t, s in zip(*np.nonzero(m))], "net_id int, target string, source string, weight double")
    counts = spark.createDataFrame([(f"g{g}", f"c{c}", float(x[g, c])) for g, c in zip(*np.nonzero(x))], "gene string, cell string, value double")
    sizes, write = {}, ed.materialize

    def counted(df, name):
        table = write(df, name)
        sizes[name] = max(sizes.get(name, 0), table.count())
        return table

    monkeypatch.setattr(ed, "materialize", counted)
    found = ed.knockout_perturbation(edges, counts, ["g0", "g1"], 3, cells=spark.createDataFrame([("c5",), ("c7",)], "cell string")).collect()
    assert sizes["step"] <= 2 * n * 2 and sizes["profiles"] <= 12
    for i, m in w.items():
        live, p, visited = m.copy(), np.where(np.arange(n)[:, None] < 2, x, 0.0), np.zeros(n, bool)
        total = p.copy()
        for _ in range(3):
            p = live @ p
            total += p
            live[visited] = 0
            live[:, visited] = 0
            visited |= (p != 0).any(axis=1)
            if visited.all():
                live[:] = 0
        got = {(r["gene"], r["cell"]): r["value"] for r in found if r["net_id"] == i and r["value"]}
        want = {(f"g{g}", f"c{c}"): total[g, c] for g in range(n) for c in (5, 7) if total[g, c]}
        assert got == pytest.approx(want)
