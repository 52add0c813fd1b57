"""Tables behind plots."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import numbered
from .pcnet import DENSE_GENES, GeneProducts


def pca_tables(entries: DataFrame, n_components: int | None = None, standardize: bool = True, transform: Callable[[DataFrame], DataFrame] | None = None, cells: DataFrame | None = None, genes: DataFrame | None = None, dense_genes: int = DENSE_GENES):
    """Scores of cells (``cell``, ``PC1``, ``PC2``, ...), explained shares, and loadings of genes.

    Cells are rows and genes features; ``cells`` (cell) and ``genes`` (gene) are the axes, those without an entry included. Components come
    from the products of the genes' covariance with blocks of vectors. Up to ``dense_genes`` genes the block is the identity; beyond, only
    leading components are found, and ``n_components`` must name how many.
    """
    spark = entries.sparkSession
    entries = transform(entries) if transform else entries
    products = GeneProducts(entries, standardize, cells, genes)
    k = min(n_components or min(products.n, products.size), products.size)
    if products.size <= dense_genes:
        values, vectors = np.linalg.eigh(products.apply(np.eye(products.size)))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    elif n_components is None:
        raise ValueError(f"more than {dense_genes} genes: n_components must be given")
    else:
        values, vectors = products.leading(k)
    scaled = vectors / products.scale[:, None]
    lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(v).ravel()))
    by_gene = lambda v, name: spark.createDataFrame(pa.table({"g": np.arange(products.size), name: lists(v)})).join(products.genes, "g").select("gene", name)
    base = products.mean @ scaled
    scored = entries.join(by_gene(scaled, "w"), "gene").groupBy("cell").agg(*[F.sum(F.col("value") * F.col("w")[i]).alias(f"PC{i + 1}") for i in range(k)])
    if cells is not None:
        scored = cells.select("cell").distinct().join(scored, "cell", "left").fillna(0.0)
    scores = scored.select("cell", *[(F.col(f"PC{i + 1}") - float(base[i])).alias(f"PC{i + 1}") for i in range(k)])
    shares = spark.createDataFrame([(i + 1, float(values[i] / products.trace)) for i in range(k)], "component int, share double")
    return scores, shares, by_gene(vectors, "loadings")


def label_embedding(scores: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Group names (``group``, ``cell``) beside the cells' coordinates; without groups all are in "all"."""
    if groups is None:
        return scores.withColumn("group", F.lit("all"))
    return scores.join(groups.select("cell", "group"), "cell")


def qq_table(regulation: DataFrame, exp_col: str = "FC", stat_col: str = "adjusted p-value", threshold: float = 0.1) -> DataFrame:
    """Sorted values beside chi-square (1 degree) quantiles at i / (n + 1), with the line through their quartiles."""

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        normal = NormalDist()
        return p.map(lambda v: normal.inv_cdf((1 + v) / 2) ** 2)

    rows = regulation.select("Gene", F.col(exp_col).alias("observed"), (F.col(f"`{stat_col}`") < threshold).alias("significant"))
    rows = numbered(rows, "observed", "Gene", name="i").withColumn("i", (F.col("i") + 1).cast("int"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    rows = rows.withColumn("theoretical", quantile(F.col("i") / (F.col("n") + 1)))
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    line = rows.agg(q("observed").alias("o"), q("theoretical").alias("t"))
    slope = F.try_divide(F.col("o")[1] - F.col("o")[0], F.col("t")[1] - F.col("t")[0])
    line = line.select(slope.alias("slope"), (F.col("o")[0] - slope * F.col("t")[0]).alias("intercept"))
    return rows.crossJoin(F.broadcast(line)).select("Gene", "i", "observed", "theoretical", "significant", "slope", "intercept")
