"""Quality control of cells and genes on sparse entries.

Zeros are absent, so counts of cells come from ``cells`` (label, cell): the distinct cells of the entries
unless given, which matters where a cell has no entry at all. Values must not be NaN.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import dealt, materialize

MITO = "^MT-"
#: Above so many cells the mean of a gene is tested, else its sum.
MANY_CELLS = 500


@dataclass(frozen=True)
class QcParams:
    min_lib_size: float = 1000
    remove_outlier_cells: bool = True
    min_percent: float = 0.05
    max_mito_ratio: float = 0.1
    min_exp_avg: float = 0
    min_exp_sum: float = 0
    #: Quartiles of sizes by a sketch of this accuracy (see ``quartiles``); exact without.
    quartile_accuracy: int | None = None

    def with_(self, **changes) -> QcParams:
        return replace(self, **changes)


def is_mito(gene: Column) -> Column:
    return F.upper(gene).rlike(MITO)


def collapse_duplicate_genes(entries: DataFrame) -> DataFrame:
    """Sum the rows of equal gene names; sums of zero leave."""
    return entries.groupBy("label", "gene", "cell").agg(F.sum("value").alias("value")).filter("value <> 0")


def clamp_negative(entries: DataFrame) -> DataFrame:
    """Values below zero count as zero, which is absent."""
    return entries.filter("value > 0")


def cells_of(entries: DataFrame) -> DataFrame:
    return entries.select("label", "cell").distinct()


def cell_totals(entries: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """``size`` and ``mito`` (sum over mitochondrial genes) of each cell, in one pass over the entries."""
    sums = entries.groupBy("label", "cell").agg(F.sum("value").alias("size"), F.sum(F.when(is_mito(F.col("gene")), F.col("value")).otherwise(0.0)).alias("mito"))
    if cells is None:
        return sums
    return cells.select("label", "cell").join(sums, ["label", "cell"], "left").fillna(0.0, ["size", "mito"])


def filter_lib_size(totals: DataFrame, min_lib_size: float) -> DataFrame:
    """Cells whose size is above the limit."""
    return totals.filter(F.col("size") > min_lib_size)


def quartiles(totals: DataFrame, accuracy: int | None = None) -> DataFrame:
    """``label``, ``q1``, ``q3``, ``rank_error``: quartiles of the cells' sizes, linear between neighbours and exact (error 0).

    The exact ones keep all distinct sizes of a label in one buffer. With ``accuracy`` a mergeable sketch stands for them: its quartiles are
    sizes whose rank is off by at most 1 / accuracy of the cells.
    """
    at = F.array(F.lit(0.25), F.lit(0.75))
    q = F.percentile("size", at) if accuracy is None else F.percentile_approx("size", at, F.lit(accuracy))
    error = F.lit(0.0 if accuracy is None else 1 / accuracy).alias("rank_error")
    return totals.groupBy("label").agg(q.alias("q")).select("label", F.col("q")[0].cast("double").alias("q1"), F.col("q")[1].cast("double").alias("q3"), error)


def filter_outlier_cells(totals: DataFrame, accuracy: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """Cells within 1.5 interquartile ranges of the quartiles of their label (those of ``of``, if given), bounds included."""
    bounds = quartiles(totals if of is None else of, accuracy).drop("rank_error")
    joined = totals.join(F.broadcast(bounds), "label")  # one row a label
    return joined.filter("size >= q1 - 1.5 * (q3 - q1) AND size <= q3 + 1.5 * (q3 - q1)").drop("q1", "q3")


def filter_mito_ratio(totals: DataFrame, genes: DataFrame, max_mito_ratio: float) -> DataFrame:
    """Cells whose mitochondrial share is below the limit; all cells of a label that has no such gene.

    ``genes`` (label, gene) lists the genes of the data, absent ones included. A cell of size 0 goes if
    its label has such genes.
    """
    present = genes.filter(is_mito(F.col("gene"))).select("label").distinct().withColumn("has_mito", F.lit(True))
    joined = totals.join(F.broadcast(present), "label", "left")
    return joined.filter(F.col("has_mito").isNull() | F.coalesce(F.try_divide("mito", "size") < max_mito_ratio, F.lit(False))).drop("has_mito")


def gene_totals(entries: DataFrame, kept_cells: DataFrame) -> DataFrame:
    """``sum``, ``detected`` and ``n_cells`` of each gene over the kept cells."""
    return _gene_totals(entries.join(kept_cells.select("label", "cell"), ["label", "cell"], "left_semi"), kept_cells)


def _gene_totals(entries: DataFrame, kept_cells: DataFrame) -> DataFrame:
    """The same of entries of kept cells only."""
    n = kept_cells.groupBy("label").agg(F.count("*").alias("n_cells"))
    sums = entries.groupBy("label", "gene").agg(F.sum("value").alias("sum"), F.count_if(F.col("value") != 0).alias("detected"))
    return sums.join(F.broadcast(n), "label")


def filter_gene_detection(totals: DataFrame, min_percent: float) -> DataFrame:
    """Genes found in more than this share of the cells."""
    return totals.filter(F.col("detected") / F.col("n_cells") > min_percent)


def filter_gene_expression(totals: DataFrame, min_exp_avg: float, min_exp_sum: float) -> DataFrame:
    """Genes whose mean (many cells) or sum (few) reaches the limit."""
    mean = F.col("sum") / F.col("n_cells")
    return totals.filter(F.when(F.col("n_cells") > MANY_CELLS, mean >= min_exp_avg).otherwise(F.col("sum") >= min_exp_sum))


#: What the report tells: each step and the one before it.
REPORTED = {"lib_size": "cells", "outlier": "lib_size", "mito": "outlier", "detection": "genes", "expression": "detection"}


class _Counted:
    """Counts rows by label as they pass, in the job that writes them."""

    def __init__(self, labels: list[str]):
        self.labels, self.seen = labels, {}

    def __call__(self, step: str, df: DataFrame) -> DataFrame:
        self.seen[step] = Observation()
        return df.observe(self.seen[step], F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("label") == x).alias(f"n{i}") for i, x in enumerate(self.labels)])

    def removed(self) -> list[tuple[str, str, int]]:
        count = lambda step, i: self.seen[step].get[f"n{i}"]
        return [(x, after, count(before, i) - count(after, i)) for after, before in REPORTED.items() for i, x in enumerate(self.labels) if count(before, i)]


def qc_run(entries: DataFrame, params: QcParams = QcParams(), cells: DataFrame | None = None, genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``qc_tables``, and the report: how many cells or genes each step removes (``label``, ``step``, ``removed``).

    Each step's rows are counted where they pass on their way into the tables of kept cells and genes; no step runs twice.
    """
    spark = entries.sparkSession
    entries = materialize(clamp_negative(collapse_duplicate_genes(entries)), "entries")  # read three times below
    rows = entries.count()
    entries = dealt(entries, rows, "label", "cell")  # a task that reads the table would have a share of it
    totals = materialize(cell_totals(entries, cells), "totals")
    counted = _Counted(sorted(r[0] for r in totals.select("label").distinct().collect()))
    large = lambda df: filter_lib_size(df, params.min_lib_size)
    kept = counted("lib_size", large(counted("cells", totals)))
    kept = counted("outlier", filter_outlier_cells(kept, params.quartile_accuracy, large(totals)) if params.remove_outlier_cells else kept)
    kept = counted("mito", filter_mito_ratio(kept, entries if genes is None else genes, params.max_mito_ratio))
    kept_cells = materialize(kept.select("label", "cell"), "cells")
    # an inner join with distinct cells, dealt alike, stays above the dealing (a semi join would be pushed below it)
    own = entries.join(dealt(kept_cells, rows, "label", "cell").distinct(), ["label", "cell"])
    found = counted("detection", filter_gene_detection(counted("genes", _gene_totals(own, kept_cells)), params.min_percent))
    found = counted("expression", filter_gene_expression(found, params.min_exp_avg, params.min_exp_sum))
    kept_genes = materialize(found.select("label", "gene"), "genes")
    kept = own.join(kept_genes, ["label", "gene"])
    report = spark.createDataFrame(counted.removed(), "label string, step string, removed long")  # five rows a label
    return kept.select("label", "gene", "cell", "value"), kept_cells, report


def qc_tables(entries: DataFrame, params: QcParams = QcParams(), cells: DataFrame | None = None, genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries of the cells and genes that pass all steps, and those cells (``label``, ``cell``), some of which may
    have no entry left.
    """
    return qc_run(entries, params, cells, genes)[:2]


def sc_qc(entries: DataFrame, params: QcParams = QcParams(), cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """Entries of the cells and genes that pass all steps, in the order of the steps above."""
    return qc_run(entries, params, cells, genes)[0]


def qc_report(entries: DataFrame, params: QcParams = QcParams(), cells: DataFrame | None = None, genes: DataFrame | None = None) -> DataFrame:
    """How many cells or genes each step removes: ``label``, ``step``, ``removed``. It comes with the tables (``qc_run``)."""
    return qc_run(entries, params, cells, genes)[2]


def library_size_histogram(entries: DataFrame, axis: int = 0, bins: int = 10) -> DataFrame:
    """Histogram of the sums per cell (``axis`` 0) or gene (1) of each label: ``label``, ``bin``, ``n``."""
    if axis not in (0, 1):
        raise ValueError("axis must be 0 (cells) or 1 (genes)")
    key = "cell" if axis == 0 else "gene"
    sums = entries.groupBy("label", key).agg(F.sum("value").alias("size"))
    ends = sums.groupBy("label").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    place = F.least(F.floor((F.col("size") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(bins - 1))
    return sums.join(F.broadcast(ends), "label").groupBy("label", F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
