import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import neighbours


def fine_rows(rows):
    return [(i, v) for i, v in rows if i is not None and v and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def brute(rows, k):
    fine = fine_rows(rows)
    out = {}
    for q, v in fine:
        if q % 20 == 0:
            best = {}
            for i, w in fine:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float((np.float64(w) * np.float64(v)).sum()))
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


ODD = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, []), (300, [1.0, 2.0]), (None, [1.0] * 4)]


def answers(spark, rows, k):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, block string, part int")
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_few_are_all_returned(spark):
    """Tables of fewer candidates than are verified: the exact answer, ties and repeated rows included."""
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(4).round(2).tolist()) for i in range(70)]
    rows[7] = (7, rows[8][1])  # tie
    rows += [*ODD, (20, rows[20][1]), (9, [9.0, 1.0, 0.5, 0.25])]
    got, want = answers(spark, rows, 20), brute(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    some = answers(spark, rows[:5], 20)
    assert {q: len(v) for q, v in some.items()} == {0: 4}


def test_collisions_against_brute_force(spark):
    """Far more vectors than are verified, of lengths from 1e-3 to 1e3 and with thousands of equal ones."""
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** (i % 7 - 3)).tolist()) for i in range(3000)]
    rows += [(3000 + i, [30.0, 1.0, 2.0, 3.0]) for i in range(3000)] + ODD
    got, want = answers(spark, rows, 5), brute(rows, 5)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    same = [np.isclose(s, t, rtol=1e-12) for q in want for (_, s), (_, t) in zip(got[q], want[q])]
    assert np.mean(hits) >= 0.9 and np.mean(same) >= 0.9


def recall(spark, df, queries, k=20):
    ids, vectors = zip(*((r.vec_id, r.embedding) for r in df.collect()))
    ids, vectors = np.array(ids), np.array(vectors, float)
    got = {}
    for r in neighbours.nearest(df, df.filter(queries), k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    out = []
    for q in [i for i, x in enumerate(ids) if x in got]:
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        out.append(len(got[ids[q]] & set(ids[np.argsort(-scores, kind="stable")[:k]].tolist())) / k)
    return np.mean(out)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    assert recall(spark, spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"), "vec_id % 20 = 0") >= 0.9


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_recall_of_random_vectors(spark, spread, tmp_path):
    """No structure at all: Gaussian vectors, in two blocks; and the same with log-normal lengths."""
    vector = F.array(*[F.randn(j) * F.exp(F.col("stretch")) for j in range(64)])
    df = spark.range(0, 60_000, numPartitions=8).withColumn("stretch", F.randn(99) * spread).select(F.col("id").alias("vec_id"), vector.alias("embedding"))
    df.write.parquet(str(tmp_path / "v"))
    assert recall(spark, spark.read.parquet(str(tmp_path / "v")), "vec_id % 1000 = 0") >= 0.9


def test_verified_share_is_bounded():
    rng = np.random.default_rng(5)
    for n in (500, 2000, 20_000):
        vectors = rng.standard_normal((n, 64))
        wanted = neighbours.candidates_wanted(n, 20)
        found, _ = neighbours.BlockIndex(vectors).search(vectors[:30], wanted)
        share = np.array([len(f) for f in found]) / n
        assert wanted <= 80 + 0.05 * n + 1
        assert share.min() * n >= wanted and share.mean() <= 1.5 * wanted / n and share.max() <= 2 * wanted / n


@pytest.mark.parametrize("radius", [0.05, neighbours.RADIUS])
def test_windows_grow_by_what_they_take_in(radius):
    """Collisions equal a plain count over all projections. Entries touched: the smaller side of the first windows, then what windows take in."""
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((4000, 16)) * rng.lognormal(0, 0.1, (4000, 1))
    wanted = neighbours.candidates_wanted(4000, 20)
    index = neighbours.BlockIndex(vectors)
    unit = vectors / np.abs(vectors).max()
    lengths = np.sqrt((unit**2).sum(axis=1))
    lifted = np.column_stack([unit, np.sqrt(lengths.max() ** 2 - lengths**2)])
    for query in vectors[:20]:
        (found,), last = index.search(query[None], wanted, radius)
        centre = np.append(query * lengths.max() / np.linalg.norm(query), 0.0)
        need, steps = int(np.ceil(neighbours.THRESHOLD * neighbours.PROJECTIONS)), radius
        apart = np.abs((lifted - centre) @ index.directions)
        first = inside = apart <= index.widths * steps
        while (inside.sum(axis=1) >= need).sum() < wanted:
            steps *= neighbours.GROWTH
            inside = apart <= index.widths * steps
        least = np.sort(inside.sum(axis=1))[-wanted]
        assert set(found) == set(np.flatnonzero(inside.sum(axis=1) >= least))
        sizes = first.sum(axis=0)
        assert index.touched == np.minimum(sizes, 4000 - sizes).sum() + inside.sum() - sizes.sum()
        index.touched = 0


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df, df).collect() == []
