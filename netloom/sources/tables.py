"""The star-schema tables mapped onto cells, genes and networks.

``entries(label, gene, cell, value)`` holds the non-zero counts of a gene in a cell; zeros are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt, materialize


def _read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def one_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of part kinds (genes) by customer (cell), one label."""
    return _counts(spark, sf_dir).groupBy(F.lit("all").alias("label"), "gene", "cell").agg(F.sum("l_quantity").alias("value"))


def two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for two samples: finished orders (X) and open ones (Y)."""
    rows = _counts(spark, sf_dir).filter("o_orderstatus IN ('F', 'O')")
    label = F.when(F.col("o_orderstatus") == "F", "X").otherwise("Y")
    return rows.groupBy(label.alias("label"), "gene", "cell").agg(F.sum("l_quantity").alias("value"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders, part = _read(spark, sf_dir, "lineitem", "orders", "part")
    n = lineitem.count()
    lines = dealt(lineitem.select("l_orderkey", "l_partkey", "l_quantity"), n, "l_orderkey")
    rows = lines.join(dealt(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    # by cell: sums of a cell's genes need no other shuffle
    return dealt(rows.select(_kind().alias("gene"), F.col("o_custkey").cast("string").alias("cell"), "o_orderstatus", "l_quantity"), n, "cell")


def _kind() -> Column:
    return F.concat(F.when(F.col("p_brand") == "Brand#1", "mt-").otherwise(""), F.replace("p_brand", F.lit("Brand#"), F.lit("B")), F.lit("_"), "p_type")


def part_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of all parts, sold or not: ``gene``."""
    (part,) = _read(spark, sf_dir, "part")
    return part.select(_kind().alias("gene")).distinct()


def copurchase_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric networks of parts that are in one order, one network per year; an order has a few lines."""
    lineitem, orders = _read(spark, sf_dir, "lineitem", "orders")
    lines = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.year("o_orderdate").alias("net_id"), F.col("l_partkey").cast("string").alias("gene"), F.col("l_quantity").cast("double").alias("q"))
    other = lines.select("l_orderkey", F.col("gene").alias("source"), F.col("q").alias("q2"))
    pairs = lines.withColumnRenamed("gene", "target").join(other, "l_orderkey").filter("target <> source")
    return pairs.groupBy("net_id", "target", "source").agg(F.sum(F.least("q", "q2")).alias("weight"))


def dense_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a dense signed table: gene = dimension, cell = vector."""
    (vectors,) = _read(spark, sf_dir, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("string").alias("cell"), F.posexplode("embedding").alias("d", "v"))
    return rows.select(F.lit("all").alias("label"), F.format_string("d%02d", "d").alias("gene"), "cell", F.col("v").cast("double").alias("value"))


def trade_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed networks between nations, one per year: ``net_id``, ``target``, ``source``, ``weight``.

    A written table of years x nations x nations rows, so that queries that read it more than once join the orders once.
    """
    lineitem, orders, customer, supplier, nation = _read(spark, sf_dir, "lineitem", "orders", "customer", "supplier", "nation")
    rows = lineitem.select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity").join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(customer.select("c_custkey", F.col("c_nationkey").alias("tk")), F.col("o_custkey") == F.col("c_custkey")).join(supplier.select("s_suppkey", F.col("s_nationkey").alias("sk")), F.col("l_suppkey") == F.col("s_suppkey"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    sums = rows.groupBy(F.year("o_orderdate").alias("net_id"), "tk", "sk").agg(F.sum(signed).alias("weight")).filter("weight <> 0")
    named = sums.join(nation.select(F.col("n_nationkey").alias("tk"), F.col("n_name").alias("target")), "tk").join(nation.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("source")), "sk")
    return materialize(named.select("net_id", "target", "source", "weight"), "trade")


def paired_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as two aligned sides: ``side`` X or Y, ``gene``, ``coords``."""
    (vectors,) = _read(spark, sf_dir, "embeddings")
    side = F.when(F.col("vec_id") % 2 == 0, "X").otherwise("Y")
    return vectors.select(side.alias("side"), F.expr("vec_id div 2").cast("string").alias("gene"), F.col("embedding").cast("array<double>").alias("coords"))


def default_barcodes(spark: SparkSession, n: int) -> DataFrame:
    """Names of ``n`` cells that came without any: ``cell``, ``cell_pos``."""
    return spark.range(n).select(F.concat(F.lit("barcode_"), F.col("id").cast("string")).alias("cell"), F.col("id").alias("cell_pos"))


def expression_table(spark: SparkSession, path: str, label: str = "all") -> DataFrame:
    """A headed table of genes (rows) by cells (columns) as entries; tab-separated if ``.tsv``, else commas."""
    wide = spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",")
    gene, *cells = wide.columns
    long = wide.unpivot([gene], cells, "cell", "value").select(F.lit(label).alias("label"), F.col(gene).alias("gene"), "cell", F.col("value").try_cast("double").alias("value"))
    return long.filter("value <> 0")
