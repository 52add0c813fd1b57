"""Differential regulation: how far each gene moved between two aligned sides.

A table has one row a gene, so that ranks over all of it are cheap.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import boxcox_lambda, chi2_sf
from ..storage import materialize


def check_pairs(manifold: DataFrame) -> DataFrame:
    """Genes that lack one side: ``gene``, ``side`` (the one that is there). Empty for a sound manifold."""
    sides = manifold.groupBy("gene").agg(F.collect_set("side").alias("sides"))
    return sides.filter(F.size("sides") < 2).select("gene", F.col("sides")[0].alias("side"))


def pair_distance(manifold: DataFrame) -> DataFrame:
    """Euclidean distance between the two sides of each gene; imaginary parts (``coords_im``) count too."""
    def side(s: str) -> DataFrame:
        rows = manifold.filter(F.col("side") == s)
        coords = F.concat("coords", "coords_im") if "coords_im" in manifold.columns else F.col("coords")
        return rows.select("gene", coords.alias(s))

    squares = F.aggregate(F.zip_with("X", "Y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return side("X").join(side("Y"), "gene").select("gene", F.sqrt(squares).alias("distance"))


def boxcox(distances: DataFrame, lmbda: float | None = None) -> DataFrame:
    """Box-Cox of positive distances as ``transformed``; 1/t where the exponent is below 0; null for 0.

    The exponent is the one of largest likelihood unless given.
    """
    if lmbda is None:
        distances = materialize(distances, "distances")  # read once a round of the search
        positive = distances.filter("distance > 0")
        lmbda = boxcox_lambda(positive)
    t = F.ln("distance") if lmbda == 0 else (F.pow("distance", F.lit(lmbda)) - 1) / lmbda
    t = F.when(F.col("distance") > 0, t)
    return distances.withColumn("transformed", F.try_divide(F.lit(1.0), t) if lmbda < 0 else t)


def zscore(df: DataFrame, column: str) -> DataFrame:
    """``Z``: distance from the mean in population standard deviations."""
    moments = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("sd"))
    return df.crossJoin(F.broadcast(moments)).withColumn("Z", F.try_divide(F.col(column) - F.col("m"), F.col("sd"))).drop("m", "sd")


def fold_change(distances: DataFrame, n_ko_genes: int = 0) -> DataFrame:
    """``FC``: squared distance over the mean square of all but the ``n_ko_genes`` largest.

    Where that mean is 0, a gene that didn't move has 0 and one that did has infinity.
    """
    top = distances.orderBy(F.desc("distance"), "gene").limit(n_ko_genes).select("gene")
    rest = distances.join(F.broadcast(top), "gene", "left_anti") if n_ko_genes else distances
    mean = rest.agg(F.avg(F.col("distance") * F.col("distance")).alias("m"))
    square = F.col("distance") * F.col("distance")
    still = F.when(F.col("distance") == 0, 0.0).when(F.col("distance").isNotNull(), float("inf"))
    return distances.crossJoin(F.broadcast(mean)).withColumn("FC", F.when(F.coalesce("m", F.lit(0.0)) == 0, still).otherwise(square / F.nullif("m", F.lit(0.0)))).drop("m")


def chi2_pvalue(df: DataFrame, column: str = "FC", degrees: float = 1.0) -> DataFrame:
    """``p_value``: 1 - the chi-square distribution function; null for null and NaN, 0 for infinity."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or math.isnan(v) else 0.0 if math.isinf(v) else chi2_sf(v, degrees) for v in x], dtype=object)

    return df.withColumn("p_value", p(F.col(column).cast("double")))


def fdr_adjust(df: DataFrame, column: str = "p_value") -> DataFrame:
    """``adjusted``: p x n / average rank, at most 1 (no monotone step); n counts the p that are there. Rows without p stay, without ``adjusted``.

    Equal values are counted first, so that the running sum goes over distinct values: one window, meant for a table
    of genes.
    """
    given = df.filter(F.col(column).isNotNull() & ~F.isnan(column))
    counts = given.groupBy(column).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    total = given.agg(F.count("*").alias("n"))
    ranks = counts.withColumn("rank", upto - F.col("c") + (F.col("c") + 1) / 2).crossJoin(F.broadcast(total))
    ranks = ranks.select(F.col(column).alias("__p"), F.least(F.col(column) * F.col("n") / F.col("rank"), F.lit(1.0)).alias("adjusted"))
    return df.join(ranks, df[column] == ranks["__p"], "left").drop("__p")


def sort_regulation(df: DataFrame, by: str | list[str] = "p-value", ascending: bool | list[bool] = True) -> DataFrame:
    by = [by] if isinstance(by, str) else by
    ways = [ascending] * len(by) if isinstance(ascending, bool) else ascending
    return df.orderBy(*[F.asc(f"`{b}`") if a else F.desc(f"`{b}`") for b, a in zip(by, ways)], F.asc("Gene"))


def d_regulation(manifold: DataFrame, n_ko_genes: int = 0, lmbda: float | None = None, sorted_by: str | list[str] = "p-value", ascending: bool | list[bool] = True) -> DataFrame:
    """The table of all genes: distance, its Box-Cox, Z, fold change, p-value and adjusted p-value.

    Every gene has its row. One that didn't move has no Box-Cox distance and no Z (nor has any if all moved alike); if none moved, every
    fold change is 0 and every p-value 1.
    """
    if (alone := check_pairs(manifold).take(1)):
        raise ValueError(f"gene without its other side: {alone[0].gene}")
    rows = zscore(boxcox(pair_distance(manifold), lmbda), "transformed")
    rows = fdr_adjust(chi2_pvalue(fold_change(rows, n_ko_genes)))
    names = {"gene": "Gene", "distance": "Distance", "transformed": "boxcox-transformed distance", "p_value": "p-value", "adjusted": "adjusted p-value"}
    return sort_regulation(rows.withColumnsRenamed(names).select("Gene", "Distance", "boxcox-transformed distance", "Z", "FC", "p-value", "adjusted p-value"), sorted_by, ascending)
