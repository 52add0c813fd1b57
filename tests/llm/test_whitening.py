import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from netloom.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(rows):
    """From the definition, in fractions up to the covariance: values by vec_id and x, for the leading 16."""
    xs = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, dims = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(dims)]
    centred = np.array([[x[i] * n - s[i] for i in range(dims)] for x in fit], object)
    cov = (centred.T @ centred).astype(object)
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in cov])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    return xs, n, s, values, vectors, cov


def check(rows, got, k):
    xs, n, s, values, vectors, cov = plain(rows)
    assert len(got) == k * len(rows)
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    deviation = Counter((i, sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in xs)
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({key: k * c for key, c in deviation.items()})
    by_id = {i: (np.array(x) * n - np.array(s, object)).astype(float) / n for i, x in xs}
    for c in range(1, k + 1):
        own = {r.vec_id: r.whitened for r in got if r.component == c}
        want = {i: y @ vectors[:, c - 1] / math.sqrt(values[c - 1]) for i, y in by_id.items()}
        top = max(want, key=lambda i: abs(want[i]))
        sign = math.copysign(1, want[top] * own[top])
        assert all(math.isclose(own[i], sign * want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)
        assert all(math.isclose(r.explained, values[c - 1] / np.trace(cov), rel_tol=1e-10) for r in got if r.component == c)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(rows, whitening.op13_whitening(spark, SF).collect(), 16)


@pytest.mark.parametrize("seed", range(12))
def test_inertia_and_eigenpairs(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 30))
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spectra = [rng.standard_normal(d) ** 2, np.repeat(rng.random(-(-d // 3)), 3)[:d], 10.0 ** -np.arange(d), np.ones(d), np.r_[5, 5 + 1e-11, np.zeros(max(d - 2, 0))][:d], rng.integers(0, 3, d).astype(float)]
    values = np.sort(spectra[seed % len(spectra)])[::-1]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    for shift in rng.standard_normal(5):
        assert whitening.positive_pivots(v - shift * np.eye(d)) == (np.linalg.eigvalsh(v) > shift).sum()
    k = min(d, 16)
    found, vectors = whitening.leading_eigenpairs(v, 16)
    assert np.allclose(found, values[:k], atol=1e-12 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.abs(v @ vectors - vectors * found).max() < 1e-12 * max(values) * d


def test_zero_pivots():
    swap = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert whitening.positive_pivots(swap) == 1 and whitening.positive_pivots(np.zeros((3, 3))) == 0
    assert whitening.positive_pivots(np.kron(np.eye(4), swap)) == 4


def test_repeated_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(5).tolist()) for i in range(30)]
    good += [(100 + i, good[0][1]) for i in range(50)]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [1.0, 2.0]), (205, []), (206, [1e300] * 5)]
    df = spark.createDataFrame([(i, v, "n", 1.0) for i, v in good + odd], "vec_id long, embedding array<double>, n string, x double").repartition(5)
    check(good, whitening.whiten(df).collect(), 5)
    null_id = df.union(spark.createDataFrame([(None, good[3][1], "n", 1.0)], df.schema))
    assert sum(r.vec_id is None for r in whitening.whiten(null_id).collect()) == 5
    assert whitening.whiten(df.filter("false")).collect() == []
    assert whitening.whiten(df.filter("vec_id >= 100 AND vec_id < 150")).collect() == []  # one distinct vector


def test_low_rank_and_large_entries(spark):
    rng = np.random.default_rng(3)
    flat = [(i, [float(a), float(2 * a), 7.0, float(b)]) for i, (a, b) in enumerate(rng.integers(-50, 50, (40, 2)).tolist())]
    df = spark.createDataFrame(flat, "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(df).collect()} == {1, 2}
    huge = [(i, [float(a) * 1e9, float(b), 3.0 * a * 1e9 + b]) for i, (a, b) in enumerate(rng.integers(-900, 900, (25, 2)).tolist())]
    got = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    _, n, s, values, _, cov = plain(huge)
    want = {i: sum((n * a - b) ** 2 for a, b in zip(x, s)) for i, x in plain(huge)[0]}
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in got)
    assert math.isclose(next(r.explained for r in got if r.component == 1), values[0] / np.trace(cov), rel_tol=1e-9)
