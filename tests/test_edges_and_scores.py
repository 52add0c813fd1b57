"""Hand-made cases at the bounds."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import edges as ed
from netloom.operators import qc, scoring
from netloom.operators import regulation as rg
from netloom.sources import mtx
from netloom.sources.tables import default_barcodes, expression_table

ENTRIES = "label string, gene string, cell string, value double"


def test_qc_bounds(spark):
    rows = [("a", "g1", "c1", 10.0), ("a", "g1", "c2", 11.0), ("a", "MT-1", "c2", 0.5), ("a", "g2", "c3", 12.0), ("a", "mt-2", "c3", 6.0), ("a", "g1", "c4", -3.0), ("a", "g1", "c4", 1.0)]
    entries = spark.createDataFrame(rows, ENTRIES)
    sums = qc.clamp_negative(qc.collapse_duplicate_genes(entries))
    assert not sums.filter("cell = 'c4'").take(1)
    totals = qc.cell_totals(sums, entries.select("label", "cell").distinct())
    assert {r.cell: r["size"] for r in totals.collect()} == {"c1": 10.0, "c2": 11.5, "c3": 18.0, "c4": 0.0}
    assert {r.cell for r in qc.filter_lib_size(totals, 10).collect()} == {"c2", "c3"}
    assert {r.cell for r in qc.filter_mito_ratio(totals, entries, 0.1).collect()} == {"c1", "c2"}
    none = entries.filter(~qc.is_mito(F.col("gene")))
    assert qc.filter_mito_ratio(totals, none, 0.1).count() == 4
    with pytest.raises(ValueError):
        qc.library_size_histogram(entries, 2)


def test_quartiles_by_sketch(spark):
    """Ten million sizes in an order unlike their own: ranks within the error that the result tells; exact by default."""
    n, accuracy = 10_000_000, 1000
    sizes = spark.range(n).select(F.lit("a").alias("label"), ((F.col("id") * 7_368_787) % n).cast("double").alias("size"))
    (row,) = qc.quartiles(sizes, accuracy).collect()
    assert row.rank_error == 1 / accuracy
    assert abs(row.q1 / n - 0.25) <= row.rank_error and abs(row.q3 / n - 0.75) <= row.rank_error
    few = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "label string, size double")
    assert [tuple(r) for r in qc.quartiles(few).collect()] == [("a", 1.75, 3.25, 0.0)]


def test_quantile_counts_zeros(spark):
    e = spark.createDataFrame([(0, "a", "b", 3.0), (0, "b", "a", -1.0)], "net_id int, target string, source string, weight double")
    sizes = spark.createDataFrame([(0, 2)], "net_id int, n_genes int")
    keep = lambda q: {r.weight for r in ed.quantile_threshold(e, sizes, q).collect()}
    assert keep(0) == {3.0, -1.0} and keep(0.6) == {3.0, -1.0} and keep(0.7) == {3.0} and keep(1) == {3.0}
    with pytest.raises(KeyError):
        ed.knockout_rows(e, ["z"])


def test_ranks_with_zeros(spark):
    entries = spark.createDataFrame([("a", "g1", "c", 5.0), ("a", "g2", "c", 5.0), ("a", "g3", "c", -1.0)], ENTRIES)
    got = {t: {r.gene: (r["rank"], r.zero_rank) for r in scoring.rank_genes_per_cell(entries, 6, t).collect()} for t in ("average", "min", "max", "dense")}
    assert got["average"] == {"g1": (1.5, 4.0), "g2": (1.5, 4.0), "g3": (6.0, 4.0)}
    assert got["min"]["g3"] == (6.0, 3.0) and got["max"]["g1"] == (2.0, 5.0) and got["dense"]["g3"] == (3.0, 2.0)


def test_fdr_ties_and_zero_distance(spark):
    p = spark.createDataFrame([(0.01,), (0.02,), (0.02,), (0.9,)], "p_value double")
    got = sorted(r.adjusted for r in rg.fdr_adjust(p).collect())
    assert got == pytest.approx(sorted([0.04, 0.02 * 4 / 2.5, 0.02 * 4 / 2.5, 0.9]))
    d = spark.createDataFrame([("a", 0.0), ("b", 4.0)], "gene string, distance double")
    assert {r.gene: r.transformed for r in rg.boxcox(d, 0.5).collect()} == {"a": None, "b": 2.0}
    assert {r.gene: r.transformed for r in rg.boxcox(d, -0.5).collect()}["b"] == pytest.approx(1.0)
    one = spark.createDataFrame([("X", "a", [1.0])], "side string, gene string, coords array<double>")
    with pytest.raises(ValueError):
        rg.d_regulation(one)


def test_regulation_keeps_genes(spark):
    """Null p, zero distances and sides that agree: every gene has its row."""
    p = spark.createDataFrame([("a", 0.01), ("b", None), ("c", 0.5), ("d", float("nan"))], "gene string, p_value double")
    assert {r.gene: r.adjusted for r in rg.fdr_adjust(p).collect()} == {"a": pytest.approx(0.02), "b": None, "c": pytest.approx(0.5), "d": None}
    side = lambda s, values: [(s, f"g{i}", [v, 1.0]) for i, v in enumerate(values)]
    table = lambda x, y: {r.Gene: r for r in rg.d_regulation(spark.createDataFrame(side("X", x) + side("Y", y), "side string, gene string, coords array<double>")).collect()}
    got = table([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])
    assert len(got) == 3 and all(r.Distance == 0 and r.FC == 0 and r["p-value"] == 1 and r["adjusted p-value"] == 1 and r.Z is None for r in got.values())
    got = table([1.0, 2.0, 3.0, 5.0], [1.0, 2.5, 4.0, 3.0])
    assert len(got) == 4 and got["g0"].FC == 0 and got["g0"]["boxcox-transformed distance"] is None and got["g3"]["p-value"] < got["g1"]["p-value"] < 1
    moved = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 2.0)], "gene string, distance double")
    assert {r.gene: r.FC for r in rg.fold_change(moved, 1).collect()} == {"a": 0.0, "b": 0.0, "c": float("inf")}
    assert {r.gene: r.p_value for r in rg.chi2_pvalue(rg.fold_change(moved, 1)).collect()} == {"a": 1.0, "b": 1.0, "c": 0.0}


@pytest.mark.parametrize("ties", scoring.TIES)
def test_ranks_against_pandas(spark, ties):
    """All genes in all cells, negatives, absent genes and an empty cell included; signatures over them."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    names = [f"g{i}" for i in rng.permutation(12)]
    x = pd.DataFrame(rng.integers(-2, 4, (12, 9)).astype(float), index=names, columns=[f"c{j}" for j in range(9)])
    x.loc[names[3]] = 0.0
    x["c8"] = 0.0
    entries = spark.createDataFrame([("a", g, c, float(x.loc[g, c])) for g in names for c in x.columns if x.loc[g, c]], ENTRIES)
    cells = spark.createDataFrame([("a", c) for c in x.columns], "label string, cell string")
    want = x.rank(ascending=False, method=ties)
    axis = spark.createDataFrame([(g, i) for i, g in enumerate(names)], "gene string, gene_pos long")
    ranks = scoring.rank_genes_per_cell(entries, 12, ties, axis)
    assert all(r["rank"] == want.loc[r.gene, r.cell] for r in ranks.collect())
    if ties == "first":
        got = scoring.first_ranks(ranks, names[1:] + ["none"], axis, cells).collect()
        assert len(got) == 11 * 9 and all(r["rank"] == want.loc[r.gene, r.cell] for r in got)
    pos, neg = names[2:6], names[7:9]

    def auc(genes, c):
        r = want.loc[genes, c]
        if (r > 8).all():
            return 0.0
        n = len(genes)
        return 1 - (r.where(r <= 8, 9).sum() - n * (n + 1) / 2) / (n * 8)

    got = {r.cell: r.score for r in scoring.u_score(entries, names, pos, neg, 8, 0.5, ties, cells).collect()}
    assert got == {c: pytest.approx(auc(pos, c) - 0.5 * auc(neg, c)) for c in x.columns}


def test_controls_are_drawn(spark):
    """Bins larger than the number of controls: seeded draws with repeats in order of mean, once for each target."""
    import numpy as np

    bins = [("a", f"g{i:02d}", float((i * 7) % 40), (i * 7) % 40 // 20) for i in range(40)] + [("a", "h", 50.0, 2), ("a", "i", 51.0, 2)]
    df = spark.createDataFrame(bins, "label string, gene string, mean double, bin int")
    got = {}
    for r in scoring.control_genes(df, ["g01", "g39", "h"], 6, 5).collect():
        got.setdefault(r.target, set()).add(r.gene)
    for target, b in (("g01", 0), ("g39", 273 % 40 // 20)):
        own = [g for _, g, m, k in sorted(bins, key=lambda x: (x[2], x[1])) if k == b]
        assert got[target] == {own[i] for i in np.random.RandomState(5).choice(20, 6, replace=True)}
    assert got["h"] == {"h", "i"}


def test_sources(spark, tmp_path):
    (tmp_path / "matrix.txt").write_text("%%comment\n%x\n3 2 4\n1 1 5\n1 1 2\n3 2 1.5\n2 1 0\n")
    (tmp_path / "genes.tsv").write_text("A\tx\nB\ty\nC\tz\n")
    (tmp_path / "barcodes.tsv").write_text("c1\nc2\n")
    want = {("A", "c1", 7.0), ("C", "c2", 1.5)}
    got = lambda df: {(r.gene, r.cell, r.value) for r in df.collect()}
    assert got(mtx.read_folder(spark, str(tmp_path))) == want
    bare = mtx.read_mtx_sparse(spark, str(tmp_path / "matrix.txt"), str(tmp_path / "genes.tsv"))
    assert got(bare) == {("A", "barcode_0", 7.0), ("C", "barcode_1", 1.5)}
    (tmp_path / "dense.csv").write_text("7,0\n0,0\n0,1.5\n")
    assert got(mtx.read_mtx_dense(spark, str(tmp_path / "dense.csv"), str(tmp_path / "genes.tsv"), str(tmp_path / "barcodes.tsv"))) == want
    import zipfile

    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.write(tmp_path / "matrix.txt", "matrix.txt")
    assert got(mtx.read_mtx_sparse(spark, str(tmp_path / "m.zip"), str(tmp_path / "genes.tsv"), str(tmp_path / "barcodes.tsv"))) == want
    with pytest.raises(ValueError):
        mtx.read_mtx_sparse(spark, str(tmp_path / "matrix.bin"), "", "")
    (tmp_path / "wide.csv").write_text("gene,c1,c2\nA,7,0\nC,0,1.5\n")
    assert got(expression_table(spark, str(tmp_path / "wide.csv"))) == want
    assert [r.cell for r in default_barcodes(spark, 2).collect()] == ["barcode_0", "barcode_1"]


def test_steps_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("X", "g", "c", 1.0), ("Y", "g", "c", 2.0)], ENTRIES)
    mtx.write_step(df, str(tmp_path), "qc", {"min_percent": 0.1})
    back, kws = mtx.read_step(spark, str(tmp_path), "qc")
    assert kws == {"min_percent": 0.1} and sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        mtx.write_step(df, str(tmp_path), "zz")


def test_cell_cycle_score(spark):
    """Bins, draws and scores on a dense table; names in mixed case."""
    import numpy as np

    rng = np.random.default_rng(2)
    names = [f"g{i:02d}" for i in range(40)]
    x = rng.poisson(rng.uniform(0.5, 4, (40, 1)), (40, 15)).astype(float)
    x[:, 0] += 1
    entries = spark.createDataFrame([("a", g, f"c{j:02d}", float(x[i, j])) for i, g in enumerate(names) for j in range(15) if x[i, j]], ENTRIES)
    pos = ["g03", "G11", "g20", "absent"]
    got = {r.cell: r.score for r in scoring.cell_cycle_score(entries, pos, n_bins=5, n_ctrl=4, seed=7).collect()}
    mean = x.mean(axis=1)
    order = sorted(range(40), key=lambda i: (mean[i], names[i]))
    cuts = [mean[order[int(np.round(40 / 5 * k))]] for k in range(1, 5)]
    bins = [next((k + 1 for k, c in enumerate(cuts) if mean[i] <= c), 0) for i in range(40)]
    hit = {bins[i] for i in (3, 11, 20)}
    pool = [i for i in order if bins[i] in hit]
    draw = np.random.default_rng(7)
    controls = sorted({pool[k] for _ in pos for k in draw.choice(len(pool), 4)})
    want = x[[3, 11, 20]].mean(axis=0) - x[controls].mean(axis=0)
    np.testing.assert_allclose([got[f"c{j:02d}"] for j in range(15)], want, atol=1e-9)
    with pytest.raises(ValueError):
        scoring.cell_cycle_score(entries, ["none"])


def test_qq_and_pca(spark):
    import numpy as np
    from statistics import NormalDist

    from netloom.operators import views

    rng = np.random.default_rng(9)
    fc = rng.exponential(1, 30)
    table = spark.createDataFrame([(f"g{i:02d}", float(v), float(i % 2)) for i, v in enumerate(fc)], "Gene string, FC double, `adjusted p-value` double")
    rows = sorted(views.qq_table(table).collect(), key=lambda r: r.i)
    want = [NormalDist().inv_cdf((1 + (i + 1) / 31) / 2) ** 2 for i in range(30)]
    np.testing.assert_allclose([r.observed for r in rows], np.sort(fc))
    np.testing.assert_allclose([r.theoretical for r in rows], want)
    slope = np.subtract(*np.quantile(fc, [0.75, 0.25])) / np.subtract(*np.quantile(want, [0.75, 0.25]))
    assert rows[0].slope == pytest.approx(slope) and rows[0].intercept == pytest.approx(np.quantile(fc, 0.25) - slope * np.quantile(want, 0.25))
    x = rng.normal(0, 1, (25, 6)) @ rng.normal(0, 1, (6, 6))
    entries = spark.createDataFrame([("a", f"g{j}", f"c{i:02d}", float(x[i, j])) for i in range(25) for j in range(6)], ENTRIES)
    scores, shares, loadings = views.pca_tables(entries, 3)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    got = np.array([[r[f"PC{k}"] for k in (1, 2, 3)] for r in sorted(scores.collect(), key=lambda r: r.cell)])
    np.testing.assert_allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-8)
    np.testing.assert_allclose([r.share for r in sorted(shares.collect(), key=lambda r: r.component)], (s**2 / (s**2).sum())[:3])
    np.testing.assert_allclose(np.abs([r.loadings for r in sorted(loadings.collect(), key=lambda r: r.gene)]), np.abs(vt[:3].T), atol=1e-8)


def test_archive_is_streamed(spark, tmp_path, monkeypatch):
    """A member of 20 MB: a small part of it in memory at once; lines in order through chunks, whatever their ends."""
    import tracemalloc
    import zipfile

    monkeypatch.setattr(mtx, "CHUNK", 1 << 18)
    path = tmp_path / "a long name.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("m.txt", "w") as f:
        for k in range(20):
            f.write(b"".join(b"%09d %09d 1" % (k * 45_000 + i, i) + (b"\r\n" if i % 2 else b"\n") for i in range(45_000)))
        f.write(b"last")
    tracemalloc.start()
    n = 0
    for lines in mtx.archive_lines(f"file:{path}"):
        n += len(lines)
    assert tracemalloc.get_traced_memory()[1] < 10e6
    tracemalloc.stop()
    assert n == 20 * 45_000 + 1
    rows = mtx.numbered(mtx._lines(spark, str(path)), *mtx.ORDER)
    wrong = rows.filter("value <> 'last' AND NOT (cast(split(value, ' ')[0] AS long) = n AND endswith(value, ' 1'))")
    assert (rows.count(), wrong.count(), rows.filter("value = 'last'").first().n) == (n, 0, n - 1)


def test_quality_control_deals_rows_by_number(spark, monkeypatch):
    """What quality control keeps lies in parts of so many rows, not in one for each core; cells named twice count their entries once."""
    from netloom import storage
    from netloom.operators import qc

    monkeypatch.setattr(storage, "TASK_ROWS", 20)
    rows = [("all", f"g{g}", f"c{c}", float(1 + (g * c) % 3)) for c in range(40) for g in range(20)]
    entries = spark.createDataFrame(rows, "label string, gene string, cell string, value double")
    cells = entries.select("label", "cell").union(entries.select("label", "cell"))
    params = qc.QcParams(min_lib_size=1, remove_outlier_cells=False, min_percent=0.0, min_exp_avg=0.0, min_exp_sum=0.0)
    kept = qc.sc_qc(entries, params, cells)
    assert kept.rdd.getNumPartitions() >= 40
    assert sorted(map(tuple, kept.collect())) == sorted(rows)
