"""The two workloads, step by step through written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as ed
from ..operators.manifold import manifold_alignment
from ..operators.normalize import cpm_norm
from ..operators.pcnet import cell_draws, make_networks
from ..operators.qc import QcParams, qc_tables
from ..operators.regulation import d_regulation
from ..operators.tensor import cp_als, denoised_network
from ..sources.mtx import read_step, write_step
from ..storage import materialize

#: Quality control of the knockout workload, where not given.
KNK_QC = QcParams(min_exp_avg=0.05, min_exp_sum=25)


def denoise(networks: DataFrame, rank: int = 5, tol: float = 1e-6, max_iter: int = 1000, decimals: int = 1, seed: int = 42, state: str | None = None) -> DataFrame:
    """One denoised network: mean of the rank-K model, scaled and rounded. ``state``: see ``cp_als``."""
    return denoised_network(cp_als(materialize(networks, "networks"), rank, tol, max_iter, seed, state), decimals)


def symmetrize_denoised(network: DataFrame) -> DataFrame:
    """(A + A') / 2 of a denoised network, for the comparison of two samples."""
    return ed.symmetrize(network)


def direct_denoised(network: DataFrame, strict: float = 0.0) -> DataFrame:
    """A denoised network for knockouts: directions made strict, turned round, without diagonal."""
    return ed.zero_diagonal(ed.transpose(ed.strict_direction(network, strict)))


def reconstruct_networks(networks: DataFrame, counts: DataFrame, ko_genes: list[str], degree: int, genes: DataFrame, cells: DataFrame, **nc) -> DataFrame:
    """Each network of ``networks`` made anew from the counts that a spreading knockout in it leaves.

    All networks draw the same cells, so that only those cells' counts stand once for each network.
    """
    size, seed = nc.get("n_samp_cells", 500), nc.get("seed", 42)
    if size is None:
        drawn = cells.select("cell").distinct().withColumn("draw_id", F.lit(0))
    else:
        drawn = cell_draws(cells, 1, size, seed).select("draw_id", "cell")
    drawn = materialize(drawn, "drawn")
    left = ed.propagate_knockout(ed.zero_diagonal(networks), counts, ko_genes, degree, genes, drawn.select("cell").distinct())
    if size is not None:
        draws = drawn.select(ed.each_network(networks), "draw_id", "cell")
        return make_networks(left, draws=draws, **{k: v for k, v in nc.items() if k not in ("n_nets", "n_samp_cells", "seed")})
    left, parts = materialize(left, "left"), None
    for (i,) in networks.select("net_id").distinct().orderBy("net_id").collect():  # a few networks, each over all cells
        one = left.filter(F.col("net_id") == i).select(F.lit("all").alias("label"), "gene", "cell", "value")
        part = make_networks(one, cells=cells, **{**nc, "n_nets": 1}).withColumn("net_id", F.lit(i))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def knockout_network(wild: DataFrame, ko_genes: list[str], genes: DataFrame, method: str = "default", networks: DataFrame | None = None, counts: DataFrame | None = None, cells: DataFrame | None = None, degree: int = 2, strict: float = 0.0, nc: dict | None = None, td: dict | None = None) -> DataFrame:
    """The denoised network after the knockout: rows set to zero (default), or made anew from what a spreading knockout leaves."""
    if method == "default":
        return ed.knockout_rows(wild, ko_genes, genes)
    if method != "propagation":
        raise ValueError(f"unknown knockout method: {method}")
    again = reconstruct_networks(networks, counts, ko_genes, degree, genes, cells, **(nc or {}))
    return direct_denoised(denoise(again, **(td or {})), strict)


def net(entries: DataFrame, qc: QcParams = QcParams(), nc: dict | None = None, td: dict | None = None, ma: dict | None = None, dr: dict | None = None, x: str = "X", y: str = "Y") -> DataFrame:
    """Compare two samples: differential regulation of every gene that both have after quality control."""
    kept, cells = qc_tables(entries, qc)
    kept = materialize(ed.shared_genes(cpm_norm(materialize(kept, "kept")), x, y), "qc")
    genes = materialize(ed.gene_axis(kept), "genes")
    sides = []
    for s in (x, y):
        of = lambda df: df.filter(F.col("label") == s)  # noqa: B023, E731
        networks = make_networks(of(kept), cells=of(cells), **(nc or {}))
        sides.append(materialize(symmetrize_denoised(denoise(networks, **(td or {}))), "td"))
    return d_regulation(materialize(manifold_alignment(*sides, x_genes=genes, y_genes=genes, **(ma or {})), "ma"), **(dr or {}))


def knk(entries: DataFrame, ko_genes: list[str], method: str = "default", degree: int = 2, strict: float = 0.0, qc: QcParams = KNK_QC, nc: dict | None = None, td: dict | None = None, ma: dict | None = None, dr: dict | None = None) -> DataFrame:
    """Knock genes out of one sample and compare it with itself: every gene after quality control has a row."""
    if method not in ("default", "propagation"):
        raise ValueError(f"unknown knockout method: {method}")
    kept, cells = qc_tables(entries, qc)
    kept = materialize(kept, "qc")
    genes = materialize(ed.gene_axis(kept), "genes")
    ed.check_known(ko_genes, genes)
    networks = materialize(make_networks(kept, cells=cells, **(nc or {})), "nc")
    wild = materialize(direct_denoised(denoise(networks, **(td or {})), strict), "td")
    knocked = materialize(knockout_network(wild, ko_genes, genes, method, networks, kept, cells, degree, strict, nc, td), "ko")
    return d_regulation(materialize(manifold_alignment(wild, knocked, x_genes=genes, y_genes=genes, **{"d": 2, **(ma or {})}), "ma"), **(dr or {}))


#: Steps of a run in a folder, and the one each reads.
STEPS = {"qc": None, "nc": "qc", "td": "nc", "ko": "td", "ma": "td", "dr": "ma"}


def run_step(spark: SparkSession, folder: str, step: str, entries: DataFrame | None = None, labels: tuple[str, ...] = ("X", "Y"), **keywords) -> DataFrame:
    """Run one step from the tables that earlier steps wrote in ``folder``, write its table there and return it.

    Two ``labels`` are two samples to compare; one is a sample to knock genes out of, which has the step ``ko``
    (keywords ``ko_genes``, ``method``, ``degree``, ``strict``, ``nc``, ``td``) between ``td`` and ``ma``. ``qc`` takes ``entries`` and
    the limits; it also writes the tables ``cells`` and ``genes`` (all genes of a label; of two labels those they share).
    """
    if step not in STEPS or (step == "ko" and len(labels) != 1):
        raise ValueError(f"not a step of this run: {step}")
    read = lambda name: read_step(spark, folder, name)[0]
    of = lambda df, s: df.filter(F.col("label") == s).drop("label")
    named = lambda tables: _union([t.withColumn("label", F.lit(s)) for s, t in tables])
    before = read(STEPS[step]) if STEPS[step] else None
    if step == "qc":
        if entries is None:
            raise ValueError("qc needs entries")
        kept, cells = qc_tables(entries.filter(F.col("label").isin(*labels)), (KNK_QC if len(labels) == 1 else QcParams()).with_(**keywords))
        kept = materialize(kept, "kept")
        write_step(cells, folder, "cells")
        out = kept if len(labels) == 1 else cpm_norm(kept)
        write_step(ed.gene_axis(kept if len(labels) == 1 else ed.shared_genes(kept, *labels)), folder, "genes")
    elif step == "nc":
        rows = before.join(read("genes"), "gene", "left_semi")
        out = named([(s, make_networks(of(rows, s).withColumn("label", F.lit(s)), cells=of(read("cells"), s), **keywords)) for s in labels])
    elif step == "td":
        strict = keywords.pop("strict", 0.0)
        finish = symmetrize_denoised if len(labels) == 2 else (lambda e: direct_denoised(e, strict))
        out = named([(s, finish(denoise(of(before, s), **keywords))) for s in labels])
    elif step == "ko":
        s = labels[0]
        out = named([(s, knockout_network(of(before, s), genes=read("genes"), networks=of(read("nc"), s), counts=of(read("qc"), s), cells=of(read("cells"), s), **keywords))])
    elif step == "ma":
        sides = (of(before, labels[0]), of(read("ko"), labels[0]) if len(labels) == 1 else of(before, labels[1]))
        out = manifold_alignment(*sides, x_genes=read("genes"), y_genes=read("genes"), **({"d": 2} if len(labels) == 1 else {}) | keywords)
    else:
        out = d_regulation(before, **keywords)
    write_step(out, folder, step, keywords)
    return read(step)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
