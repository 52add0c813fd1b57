"""Normalisation of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_size(entries: DataFrame) -> DataFrame:
    sizes = entries.groupBy("label", "cell").agg(F.sum("value").alias("size"))
    return entries.join(sizes, ["label", "cell"])


def cpm_norm(entries: DataFrame) -> DataFrame:
    """Counts per million of the cell's total."""
    return _with_size(entries).select("label", "gene", "cell", F.try_divide(F.col("value") * 1e6, F.col("size")).alias("value"))


def log_normalize(entries: DataFrame) -> DataFrame:
    """ln(1 + 10,000 x share of the cell's total)."""
    return _with_size(entries).select("label", "gene", "cell", F.log1p(F.try_divide("value", "size") * 1e4).alias("value"))


def gene_moments(entries: DataFrame, n_cells: DataFrame) -> DataFrame:
    """``mean`` and population ``std`` of each gene over all cells, zeros included.

    ``n_cells``: one row (label, n). Genes that don't vary have no row: they can't be scaled.
    """
    sums = entries.groupBy("label", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.join(F.broadcast(n_cells), "label").select("label", "gene", mean.alias("mean"), std.alias("std")).filter("std > 0")


def zscore_genes(entries: DataFrame) -> DataFrame:
    """(value - mean) / std of each gene for the entries there are; an absent one has -mean / std."""
    n = entries.select("label", "cell").distinct().groupBy("label").agg(F.count("*").alias("n"))
    moments = gene_moments(entries, n)
    return entries.join(moments, ["label", "gene"]).select("label", "gene", "cell", ((F.col("value") - F.col("mean")) / F.col("std")).alias("value"))
