"""Scores of cells by gene signatures.

Zeros are absent from entries; their ranks and values follow from counts, so that no dense table is made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dealt, materialize, numbered


#: Ways to rank equal values.
TIES = ("average", "min", "max", "dense", "first")


def gene_places(genes: DataFrame) -> DataFrame:
    """``gene`` and its place ``gene_pos`` from 0, given or by name."""
    return genes.select("gene", "gene_pos") if "gene_pos" in genes.columns else numbered(genes.select("gene").distinct(), "gene", name="gene_pos")


def rank_genes_per_cell(entries: DataFrame, n_genes: int, ties: str = "average", genes: DataFrame | None = None) -> DataFrame:
    """``rank`` of each present gene in its cell, largest first, and ``zero_rank`` of the absent ones.

    ``ties``: average, min, max, dense, or first: equal values in the order of ``genes`` (``gene``, and ``gene_pos`` if it isn't the order of
    names; else the genes of the entries). Absent genes then differ in rank, so that ``zero_rank`` is null and what their ranks follow
    from is added: ``gene_pos``, and ``above``, the number of positive values in the cell (see ``first_ranks``). Values must not be 0; negative
    ones rank after the zeros.
    """
    if ties not in TIES:
        raise ValueError(f"unknown ties: {ties}")
    cell, size = Window.partitionBy("label", "cell"), entries.count()
    if ties == "first":
        entries = entries.join(gene_places(entries if genes is None else genes), "gene")
    order = cell.orderBy(F.desc("value"), *(["gene_pos"] if ties == "first" else []))
    rows = dealt(entries, size, "label", "cell").withColumns({"present": F.count("*").over(cell), "above": F.count_if(F.col("value") > 0).over(cell), "low": F.rank().over(order)})
    zeros = F.lit(n_genes) - F.col("present")
    shift = F.when((F.col("value") < 0) & (zeros > 0), F.lit(1) if ties == "dense" else zeros).otherwise(0)
    if ties == "first":
        return rows.select("label", "cell", "gene", (F.col("low") + shift).cast("double").alias("rank"), F.lit(None).cast("double").alias("zero_rank"), "gene_pos", "above")
    rows = rows.withColumns({"same": F.count("*").over(Window.partitionBy("label", "cell", "value")), "dense": F.dense_rank().over(order)})
    dense_above = F.coalesce(F.max(F.when(F.col("value") > 0, F.col("dense"))).over(cell), F.lit(0))
    own = {"average": F.col("low") + (F.col("same") - 1) / 2, "min": F.col("low"), "max": F.col("low") + F.col("same") - 1, "dense": F.col("dense")}[ties]
    zero = {"average": F.col("above") + (zeros + 1) / 2, "min": F.col("above") + 1, "max": F.col("above") + zeros, "dense": dense_above + 1}[ties]
    return rows.select("label", "cell", "gene", (own + shift).cast("double").alias("rank"), zero.cast("double").alias("zero_rank"))


def _cells(entries: DataFrame, cells: DataFrame | None) -> DataFrame:
    return (entries if cells is None else cells).select("label", "cell").distinct()


def first_ranks(ranks: DataFrame, wanted: list[str], genes: DataFrame, cells: DataFrame) -> DataFrame:
    """``label``, ``cell``, ``gene``, ``rank`` of the ``wanted`` genes in every one of ``cells`` (label, cell), ties by ``first``.

    An absent gene ranks after the positive values and after the absent genes before it, which are its place less the present
    genes before it: gaps are counted, zeros never made. ``ranks`` come from ``rank_genes_per_cell``.
    """
    places = {r[0]: int(r[1]) for r in gene_places(genes).filter(F.col("gene").isin(*wanted)).collect()} if wanted else {}
    own = [(g, places[g]) for g in dict.fromkeys(wanted) if g in places]
    if not own:
        return cells.select("label", "cell", F.lit("").alias("gene"), F.lit(0.0).alias("rank")).filter("false")
    before = [F.count_if(F.col("gene_pos") < p).alias(f"before{i}") for i, (_, p) in enumerate(own)]
    given = [F.max(F.when(F.col("gene") == g, F.col("rank"))).alias(f"rank{i}") for i, (g, _) in enumerate(own)]
    sums = ranks.groupBy("label", "cell").agg(F.max("above").alias("above"), *before, *given)
    sums = cells.select("label", "cell").distinct().join(sums, ["label", "cell"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = [F.struct(F.lit(g).alias("gene"), F.coalesce(F.col(f"rank{i}"), (zero("above") + F.lit(p + 1) - zero(f"before{i}")).cast("double")).alias("rank")) for i, (g, p) in enumerate(own)]
    return sums.select("label", "cell", F.explode(F.array(*rows)).alias("r")).select("label", "cell", "r.gene", "r.rank")


def signature_auc(ranks: DataFrame, genes: list[str], max_rank: int = 1500, cells: DataFrame | None = None, n_genes: int | None = None, ties: str = "average") -> DataFrame:
    """Area score of a signature in each cell: 1 - (sum of ranks - n(n+1)/2) / (n max_rank).

    Ranks above ``max_rank`` count as max_rank + 1; if all are, the score is 0. ``cells`` (label, cell) adds cells without an entry, whose
    ``n_genes`` genes are all tied at zero by ``ties``. Ranks by ``first`` are to hold every gene of the signature (``first_ranks``).
    """
    n = len(genes)
    cap = lambda r: F.when(r > max_rank, F.lit(max_rank + 1.0)).otherwise(r)
    own = F.col("gene").isin(*genes) if genes else F.lit(False)
    zero = F.max("zero_rank") if "zero_rank" in ranks.columns else F.lit(None).cast("double")
    sums = ranks.groupBy("label", "cell").agg(F.sum(F.when(own, cap(F.col("rank"))).otherwise(0.0)).alias("s"), F.count_if(own).alias("found"), F.count_if(own & (F.col("rank") <= max_rank)).alias("low"), zero.alias("zero_rank"))
    if cells is not None:
        empty = {"average": ((n_genes or 0) + 1) / 2, "max": float(n_genes or 0)}.get(ties, 1.0)
        sums = cells.select("label", "cell").distinct().join(sums, ["label", "cell"], "left").fillna({"s": 0.0, "found": 0, "low": 0, "zero_rank": empty})
    if not n:
        return sums.select("label", "cell", F.lit(0.0).alias("auc"))
    missing = F.lit(n) - F.col("found")
    total = F.col("s") + F.when(missing > 0, missing * cap(F.col("zero_rank"))).otherwise(0.0)
    none = (F.col("low") == 0) & ((missing == 0) | (F.col("zero_rank") > max_rank))
    return sums.select("label", "cell", F.when(none, 0.0).otherwise(1 - (total - n * (n + 1) / 2) / (n * max_rank)).alias("auc"))


def u_score(entries: DataFrame, all_genes: list[str], pos: list[str], neg: list[str], max_rank: int = 1500, w_neg: float = 1.0, ties: str = "average", cells: DataFrame | None = None) -> DataFrame:
    """AUC of the positive genes that aren't negative ones, less the weighted AUC of the negative ones.

    Genes that the data lack are dropped; an empty list scores 0. ``all_genes`` is the gene axis in its order, genes without an entry
    included; ``cells`` (label, cell) adds cells without any.
    """
    known = set(all_genes)
    up, down = ([g for g in dict.fromkeys(x) if g in known] for x in (pos, neg))
    up = [g for g in up if g not in set(down)]
    every, empty = _cells(entries, cells), cells
    if ties == "first":
        axis = entries.sparkSession.createDataFrame([(g, i) for i, g in enumerate(dict.fromkeys(all_genes))], "gene string, gene_pos long")
        ranks = first_ranks(rank_genes_per_cell(entries, len(known), ties, axis), up + down, axis, every)
        empty = every
    else:
        ranks = rank_genes_per_cell(entries, len(known), ties)
    a, b = (signature_auc(ranks, g, max_rank, empty, len(known), ties) for g in (up, down))
    return a.join(b.withColumnRenamed("auc", "down"), ["label", "cell"]).select("label", "cell", (F.col("auc") - w_neg * F.col("down")).alias("score"))


def gene_means(entries: DataFrame, cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Mean of each gene over all cells: ``label``, ``gene``, ``mean``.

    ``cells`` (label, cell) and ``genes`` (gene, and label if labels differ) are the axes, cells and genes without an entry included; without them
    those that have one count.
    """
    n = _cells(entries, cells).groupBy("label").agg(F.count("*").alias("n"))
    sums = entries.groupBy("label", "gene").agg(F.sum("value").alias("s"))
    if genes is not None:
        axis = genes.select("label", "gene") if "label" in genes.columns else n.select("label").crossJoin(genes.select("gene"))
        sums = axis.distinct().join(sums, ["label", "gene"], "left").fillna(0.0, ["s"])
    return sums.join(F.broadcast(n), "label").select("label", "gene", (F.col("s") / F.col("n")).alias("mean"))


def qcut_bins(means: DataFrame, n_bins: int = 25) -> DataFrame:
    """Bins of equal frequency by linear quantiles, closed on the right, lowest included: ``bin`` from 0.

    Equal edges are an error, as a bin would be empty by construction.
    """
    edges = F.percentile("mean", F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)]))
    cut = means.groupBy("label").agg(edges.alias("edges"))
    for row in cut.collect():  # one row of n_bins + 1 numbers a label
        if len(set(row["edges"])) < n_bins + 1:
            raise ValueError("quantile edges must be unique")
    joined = means.join(F.broadcast(cut), "label")
    above = F.size(F.filter("edges", lambda e: e < F.col("mean")))
    return joined.select("label", "gene", "mean", F.greatest(above - 1, F.lit(0)).alias("bin"))


def mean_cut_bins(means: DataFrame, n_bins: int = 25) -> DataFrame:
    """Cut i is the mean at place round(G / n_bins x i) in order; bin = first i >= 1 with mean <= cut i, else 0."""
    order = Window.partitionBy("label").orderBy("mean", "gene")
    placed = means.withColumn("place", F.row_number().over(order) - 1).withColumn("g", F.count("*").over(Window.partitionBy("label")))
    marks = F.explode(F.sequence(F.lit(1), F.lit(n_bins - 1))) if n_bins > 1 else F.explode(F.array().cast("array<int>"))
    cuts = placed.select("label", "g").distinct().withColumn("i", marks).withColumn("place", F.rint(F.col("g") / n_bins * F.col("i")).cast("int"))
    cuts = cuts.join(placed.select("label", "place", "mean"), ["label", "place"]).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "mean"))).alias("cuts"))
    joined = means.join(F.broadcast(cuts), "label", "left")
    first = F.array_min(F.transform(F.filter("cuts", lambda c: F.col("mean") <= c["mean"]), lambda c: c["i"]))
    return joined.select("label", "gene", "mean", F.coalesce(first, F.lit(0)).alias("bin"))


def control_genes(bins: DataFrame, targets: list[str], n_ctrl: int = 50, seed: int = 42) -> DataFrame:
    """Controls of each target: all genes of its bin if there are at most ``n_ctrl``, else a sample with
    repeats, the same draws for each target, de-duplicated: ``target``, ``gene``.
    """
    spark = bins.sparkSession
    wanted = spark.createDataFrame([(t,) for t in targets], "target string")
    if (lost := wanted.join(bins, wanted["target"] == bins["gene"], "left_anti").take(1)):
        raise ValueError(f"target not in the data: {lost[0].target}")
    own = bins.join(F.broadcast(wanted), F.col("gene") == F.col("target")).select("label", "target", "bin")
    order = Window.partitionBy("label", "bin").orderBy("mean", "gene")
    placed = bins.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("label", "bin")))
    sizes = [r[0] for r in placed.filter(F.col("n") > n_ctrl).select("n").distinct().collect()]
    draws = spark.createDataFrame([(int(n), int(p)) for n in sizes for p in set(np.random.RandomState(seed).choice(n, n_ctrl, replace=True).tolist())], "n bigint, place int")
    some = placed.filter(F.col("n") > n_ctrl).join(F.broadcast(draws), ["n", "place"]).select("label", "bin", "gene")
    pool = some.unionByName(placed.filter(F.col("n") <= n_ctrl).select("label", "bin", "gene"))
    return own.join(pool, ["label", "bin"]).select("label", "target", "gene")


def binned_control_score(entries: DataFrame, targets: list[str], n_bins: int = 25, n_ctrl: int = 50, seed: int = 42, cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Mean over the targets of a target's value less the mean of its controls, in each cell.

    Targets and controls become one signed weight per gene, so that the entries are read once. ``cells`` and ``genes`` are the axes
    (see ``gene_means``).
    """
    if not targets:
        raise ValueError("the gene list is empty")
    targets = list(dict.fromkeys(targets))
    controls = control_genes(qcut_bins(gene_means(entries, cells, genes), n_bins), targets, n_ctrl, seed)
    sizes = controls.groupBy("label", "target").agg(F.count("*").alias("n"))
    minus = controls.join(sizes, ["label", "target"]).select("label", "gene", (F.lit(-1.0) / F.col("n")).alias("w"))
    plus = controls.select("label", F.col("target").alias("gene"), F.lit(1.0).alias("w")).distinct()
    weights = minus.unionByName(plus).groupBy("label", "gene").agg((F.sum("w") / len(targets)).alias("w"))
    cells = _cells(entries, cells)
    scored = entries.join(weights, ["label", "gene"]).groupBy("label", "cell").agg(F.sum(F.col("value") * F.col("w")).alias("score"))
    return cells.join(scored, ["label", "cell"], "left").fillna(0.0, ["score"])


def control_pool(bins: DataFrame, pos: list[str]) -> DataFrame:
    """Genes of all bins that hold a positive gene: ``label``, ``gene``."""
    hit = bins.filter(F.upper("gene").isin(*[g.upper() for g in pos])).select("label", "bin").distinct()
    return bins.join(F.broadcast(hit), ["label", "bin"], "left_semi").select("label", "gene")


def draw_controls(bins: DataFrame, pos: list[str], n_ctrl: int = 50, seed: int = 42) -> DataFrame:
    """Controls: for each positive gene ``n_ctrl`` draws with repeats from the pool of ``control_pool``; distinct ``label``, ``gene``.

    The pool is numbered by mean, then name. Only the drawn numbers, at most ``n_ctrl`` a positive gene, are made on the driver.
    """
    spark = bins.sparkSession
    pool = numbered(bins.join(control_pool(bins, pos), ["label", "gene"], "left_semi").select("label", "mean", "gene"), "label", "mean", "gene")
    ends = pool.groupBy("label").agg(F.min("n").alias("first"), F.count("*").alias("size")).collect()  # one row a label
    rows = []
    for r in ends:
        rng = np.random.default_rng(seed)
        drawn = {int(i) for _ in pos for i in rng.choice(r["size"], n_ctrl)}
        rows += [(r["first"] + i,) for i in drawn]
    return pool.join(F.broadcast(spark.createDataFrame(rows, "n long")), "n", "left_semi").select("label", "gene")


def cell_cycle_score(entries: DataFrame, pos: list[str], n_bins: int = 25, n_ctrl: int = 50, seed: int = 42, cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Mean of the positive genes less the mean of drawn controls of like expression, in each cell: bins by ``mean_cut_bins``, then draws, then scores.

    Names count in any case. Positive genes and controls that the data have count each once, a gene in both lists in both.
    ``cells`` and ``genes`` are the axes (see ``gene_means``).
    """
    name = F.upper("gene")
    wanted = sorted({g.upper() for g in pos})
    entries = materialize(entries.withColumn("gene", name), "entries")
    axis = None if genes is None else genes.withColumn("gene", name)
    bins = materialize(mean_cut_bins(gene_means(entries, cells, axis), n_bins), "bins")
    if not bins.filter(F.col("gene").isin(*wanted)).take(1):
        raise ValueError("no positive gene is in the data")
    controls = draw_controls(bins, pos, n_ctrl, seed)
    share = lambda genes, sign: genes.join(F.broadcast(genes.groupBy("label").agg(F.count("*").alias("k"))), "label").select("label", "gene", (F.lit(sign) / F.col("k")).alias("w"))
    up = bins.filter(F.col("gene").isin(*wanted)).select("label", "gene")
    weights = share(up, 1.0).unionByName(share(controls, -1.0)).groupBy("label", "gene").agg(F.sum("w").alias("w"))
    scored = entries.join(weights, ["label", "gene"]).groupBy("label", "cell").agg(F.sum(F.col("value") * F.col("w")).alias("score"))
    return _cells(entries, cells).join(scored, ["label", "cell"], "left").fillna(0.0, ["score"])


def signature_score(entries: DataFrame, pos: list[str], controls: list[str], cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Mean of the positive genes less the mean of the controls in each cell (names in any case).

    Genes of the lists that the axis has count, with an entry or not; ``cells`` and ``genes`` are the axes (see ``gene_means``).
    """
    up, other = ({g.upper() for g in x} for x in (pos, controls))
    name = F.upper("gene")
    axis = entries if genes is None else genes
    known = {r[0] for r in axis.select(name.alias("g")).filter(F.col("g").isin(*(up | other))).distinct().collect()}
    if not up & known:
        raise ValueError("no positive gene is in the data")
    part = lambda names: F.sum(F.when(name.isin(*names), F.col("value")).otherwise(0.0)) / len(names) if names else F.lit(0.0)
    scored = entries.groupBy("label", "cell").agg((part(up & known) - part(other & known)).alias("score"))
    return scored if cells is None else _cells(entries, cells).join(scored, ["label", "cell"], "left").fillna(0.0, ["score"])
