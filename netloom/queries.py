"""Registered queries of the network operators and their DuckDB SQL.

Every query reads the star-schema tables as mapped in ``sources.tables``; the SQL maps them alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import workloads
from .operators import edges as ed
from .operators import manifold as mf
from .operators import normalize as nm
from .operators import pcnet, qc, scoring, tensor, views
from .operators import regulation as rg
from .sources import mtx
from .sources import tables as st
from .storage import materialize, numbered, shared_dir

ONE = qc.QcParams(min_lib_size=500, min_percent=0.2)
TWO = qc.QcParams(min_lib_size=150, min_percent=0.1)
#: Each sweep of the denoising costs three jobs: the registered queries stop it at this change of the error (default 1e-6).
TD = {"tol": 1e-3}

_GENE = "CASE WHEN p_brand = 'Brand#1' THEN 'mt-' ELSE '' END || replace(p_brand, 'Brand#', 'B') || '_' || p_type"
_COUNTS = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
_ONE = f"e AS (SELECT 'all' AS label, {_GENE} AS gene, CAST(o_custkey AS VARCHAR) AS cell, sum(l_quantity) AS value {_COUNTS} GROUP BY 1, 2, 3)"
_TWO = f"e AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE 'Y' END AS label, {_GENE} AS gene, CAST(o_custkey AS VARCHAR) AS cell, sum(l_quantity) AS value {_COUNTS} WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3)"
_DENSE = "e AS (SELECT 'all' AS label, CAST(vec_id AS VARCHAR) AS cell, 'd' || lpad(CAST(d AS VARCHAR), 2, '0') AS gene, CAST(embedding[d + 1] AS DOUBLE) AS value FROM embeddings, range(64) AS g(d) WHERE embedding IS NOT NULL AND d < len(embedding))"
_NETS = """n AS (SELECT * FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS net_id, t.n_name AS target, s.n_name AS source, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation t ON t.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY 1, 2, 3) WHERE weight <> 0)"""
_PAIRS = "m AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'X' ELSE 'Y' END AS side, CAST(vec_id // 2 AS VARCHAR) AS gene, CAST(embedding AS DOUBLE[]) AS coords FROM embeddings)"


def _qc_sql(entries: str, p: qc.QcParams) -> str:
    """CTEs of every QC step."""
    return f"""{entries},
cells AS (SELECT label, cell, sum(value) AS size, sum(CASE WHEN upper(gene) LIKE 'MT-%' THEN value ELSE 0 END) AS mito FROM e WHERE value > 0 GROUP BY 1, 2),
lib AS (SELECT * FROM cells WHERE size > {p.min_lib_size}),
bounds AS (SELECT label, quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.75) AS q3 FROM lib GROUP BY 1),
outl AS (SELECT lib.* FROM lib JOIN bounds USING (label) WHERE size >= q1 - 1.5 * (q3 - q1) AND size <= q3 + 1.5 * (q3 - q1)),
mitos AS (SELECT DISTINCT label FROM e WHERE upper(gene) LIKE 'MT-%'),
mit AS (SELECT outl.* FROM outl WHERE label NOT IN (SELECT label FROM mitos) OR mito / nullif(size, 0) < {p.max_mito_ratio}),
ncells AS (SELECT label, count(*) AS n_cells FROM mit GROUP BY 1),
genes AS (SELECT label, gene, sum(value) AS s, count(*) AS detected, any_value(n_cells) AS n_cells FROM e JOIN mit USING (label, cell) JOIN ncells USING (label) WHERE value > 0 GROUP BY 1, 2),
det AS (SELECT * FROM genes WHERE detected / n_cells > {p.min_percent}),
expr AS (SELECT * FROM det WHERE CASE WHEN n_cells > 500 THEN s / n_cells >= {p.min_exp_avg} ELSE s >= {p.min_exp_sum} END),
kept AS (SELECT e.* FROM e SEMI JOIN mit USING (label, cell) SEMI JOIN expr USING (label, gene) WHERE value > 0)"""


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _gene_list(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    entries = materialize(st.one_sample(spark, sf_dir), "entries")
    return entries, [r[0] for r in entries.select("gene").distinct().orderBy("gene").collect()]


def _counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    entries = materialize(st.one_sample(spark, sf_dir), "entries")
    return entries, entries.select("gene").distinct().count()


def _u_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, genes = _gene_list(spark, sf_dir)
    return _round(scoring.u_score(entries, genes, genes[:12] + ["unknown"], genes[10:15], max_rank=40), "score")


def _sizes(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    """The order of every network is the number of nations."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.count_distinct("n_name").cast("int").alias("n_genes"))
    return edges.select("net_id").distinct().join(F.broadcast(n))


def _factors(edges: DataFrame, by: str) -> tuple[dict, dict]:
    """Names of each mode, and factors that are a fixed rule of the place of a name, in a column ``by`` (member or at)."""
    names = {m: materialize(numbered(edges.select(F.col(m).alias("member")).distinct(), "member", name="at"), "names") for m in tensor.MODES}
    value = lambda k: ((F.col("at") * 3 + k * 5) % 7 + 1) / 4
    return names, {m: names[m].select(F.col(by).alias(m), F.array(*[value(k) for k in range(3)]).alias("f")) for m in tensor.MODES}


def _mttkrp(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = st.trade_networks(spark, sf_dir)
    return tensor.mttkrp(edges, "target", _factors(edges, "member")[1], 3)


def _average(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, factors = _factors(st.trade_networks(spark, sf_dir), "at")
    return _round(tensor.average_network(tensor.CpModel(names, factors, [], 3)).select("target", "source", "weight"), "weight")


def _denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, factors = _factors(st.trade_networks(spark, sf_dir), "at")
    return tensor.denoised_network(tensor.CpModel(names, factors, [], 3)).select("target", "source", "weight")


def _cp(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = materialize(ed.scale_edges(st.trade_networks(spark, sf_dir)), "edges")
    return tensor.average_network(tensor.cp_als(edges, rank=3, max_iter=8)).select("target", "source", "weight")


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Two networks to align, of two years' trade, and their gene axes: nations, and regions, which have no edge; the second lacks
    one region.
    """
    nets = st.trade_networks(spark, sf_dir)
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    nations, regions = read("nation").select(F.col("n_name").alias("gene")), read("region")
    axis = lambda where: nations.union(regions.filter(where).select("r_name")).distinct()
    return nets.filter("net_id = 1996"), nets.filter("net_id = 1997"), axis("true"), axis("r_regionkey > 0")


_PAIR = """a AS (SELECT * FROM n WHERE net_id = 1996), b AS (SELECT * FROM n WHERE net_id = 1997),
g AS ((SELECT n_name AS gene FROM nation UNION SELECT r_name FROM region) INTERSECT (SELECT n_name FROM nation UNION SELECT r_name FROM region WHERE r_regionkey > 0)),
x AS (SELECT a.* FROM a WHERE target IN (SELECT gene FROM g) AND source IN (SELECT gene FROM g)), y AS (SELECT b.* FROM b WHERE target IN (SELECT gene FROM g) AND source IN (SELECT gene FROM g))"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared gene with the edges of both networks into and out of it."""
    x, y, genes = ed.align_networks(*_pair(spark, sf_dir))
    ends = lambda e, end, name: e.groupBy(F.col(end).alias("gene")).agg(F.count("*").alias(name))
    for e, end, name in ((x, "source", "x_out"), (x, "target", "x_in"), (y, "source", "y_out"), (y, "target", "y_in")):
        genes = genes.join(ends(e, end, name), "gene", "left")
    return genes.fillna(0)


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(mf.laplacian_degrees(*ed.align_networks(*_pair(spark, sf_dir))), "degree", "c")


def _manifold_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years of parts bought together, all parts a gene each."""
    nets = materialize(ed.scale_edges(st.copurchase_networks(spark, sf_dir)), "nets")
    axis = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("gene"))
    return mf.manifold_alignment(nets.filter("net_id = 1996"), nets.filter("net_id = 1997"), d=2, x_genes=axis, y_genes=axis)


def _manifold(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, a, b = _pair(spark, sf_dir)
    return mf.manifold_alignment(ed.scale_edges(x), ed.scale_edges(y), d=3, x_genes=a, y_genes=b)


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of nations on their customers. In even years a nation gets nothing from nations of its own region, so that a knockout of two
    of them reaches all nations in one step in odd years only.
    """
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet").select("n_name", "n_regionkey")
    nets = st.trade_networks(spark, sf_dir)
    for end in ("target", "source"):
        nets = nets.join(read("nation").select(F.col("n_name").alias(end), F.col("n_regionkey").alias(f"{end}_region")), end)
    nets = nets.filter("net_id % 2 = 1 OR target_region <> source_region").select("net_id", "target", "source", "weight")
    return ed.zero_diagonal(ed.scale_edges(nets))


def _propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene = nation, cell = market segment; the first two nations of the first region are knocked out together."""
    x = _nation_counts(spark, sf_dir)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey = 0").select(F.col("n_name").alias("gene"))
    genes = [r[0] for r in x.join(nations, "gene", "left_semi").select("gene").distinct().orderBy("gene").limit(2).collect()]
    return _round(ed.propagate_knockout(_spread(spark, sf_dir), x, genes, 2), "value")


def _nation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    rows = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("gene"), F.col("c_mktsegment").alias("cell")).agg(F.count("*").cast("double").alias("value"))


def _first_nation(x: DataFrame) -> str:
    return x.agg(F.min("gene")).first()[0] or ""


def _fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("p_value"))
    return _round(rg.fdr_adjust(rows), "adjusted")


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.pair_distance(st.paired_coordinates(spark, sf_dir))


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three networks, each drawing about a third of all cells by a remainder, and the cells of the third of every hundred twice."""
    entries = materialize(st.one_sample(spark, sf_dir), "entries")
    cells = entries.select("cell").distinct().withColumn("c", F.col("cell").cast("long"))
    twice = F.expr("CASE WHEN c % 100 = 3 THEN array(c, -c) ELSE array(c) END")
    draws = cells.select((F.col("c") * 7 % 3).cast("int").alias("net_id"), F.explode(twice).alias("draw_id"), "cell").withColumn("draw_id", F.col("draw_id").cast("int"))
    return ed.draw_cells(entries, draws)


_DRAWN = "w AS (SELECT CAST(c * 7 % 3 AS INTEGER) AS net_id, CAST(unnest(CASE WHEN c % 100 = 3 THEN [c, -c] ELSE [c] END) AS INTEGER) AS draw_id, CAST(c AS VARCHAR) AS cell FROM (SELECT DISTINCT CAST(cell AS BIGINT) AS c FROM e))"


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, genes = _gene_list(spark, sf_dir)
    return _round(scoring.binned_control_score(entries, genes[:10], n_bins=5, n_ctrl=1000), "score")


def _networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, cells = qc.qc_tables(st.one_sample(spark, sf_dir), ONE)
    return pcnet.make_networks(kept, q=0.9, cells=cells)


def _job_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workloads.net(st.two_samples(spark, sf_dir), TWO, td=TD)


def _job_knk(spark: SparkSession, sf_dir: str, method: str = "default") -> DataFrame:
    entries = materialize(st.one_sample(spark, sf_dir), "entries")
    genes = [r[0] for r in qc.sc_qc(entries, ONE).select("gene").distinct().orderBy("gene").limit(2).collect()]
    return workloads.knk(entries, genes, method, qc=ONE, nc={"q": 0.5}, td={**TD, "decimals": 2}, dr={"n_ko_genes": len(genes)})


def _axes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Counts, all customers (cells, with or without an order), and the gene axis: part kinds and regions, which nobody buys; its names in order."""
    entries = materialize(st.one_sample(spark, sf_dir), "entries")
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    cells = read("customer").select(F.lit("all").alias("label"), F.col("c_custkey").cast("string").alias("cell"))
    genes = materialize(st.part_kinds(spark, sf_dir).union(read("region").select("r_name")).distinct(), "genes")
    return entries, cells, genes, [r[0] for r in genes.orderBy("gene").collect()]


_AXES = f"""{_ONE}, c AS (SELECT CAST(c_custkey AS VARCHAR) AS cell FROM customer), g AS (SELECT gene, row_number() OVER (ORDER BY gene) AS i FROM (SELECT {_GENE} AS gene FROM part UNION SELECT r_name FROM region)),
d AS (SELECT c.cell, g.gene, g.i, coalesce(value, 0) AS value FROM c CROSS JOIN g LEFT JOIN e ON e.cell = c.cell AND e.gene = g.gene)"""


def _u_axes(spark: SparkSession, sf_dir: str, ties: str) -> DataFrame:
    """Signatures that hold genes without an entry, on all cells."""
    entries, cells, _, names = _axes(spark, sf_dir)
    return _round(scoring.u_score(entries, names, names[:10], names[12:16], max_rank=60, ties=ties, cells=cells), "score")


def _u_axes_sql(rank: str) -> str:
    return f"""WITH {_AXES}, r AS (SELECT cell, i, least({rank}, 61) AS r FROM d)
SELECT 'all' AS label, cell, round(CASE WHEN min(r) FILTER (i <= 10) > 60 THEN 0 ELSE 1 - (sum(r) FILTER (i <= 10) - 55) / 600 END - CASE WHEN min(r) FILTER (i BETWEEN 13 AND 16) > 60 THEN 0 ELSE 1 - (sum(r) FILTER (i BETWEEN 13 AND 16) - 10) / 240 END, 6) AS score FROM r GROUP BY 2"""


def _first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by order of appearance, names of genes turned round in order, of the genes at every seventh place, in every cell."""
    entries, cells, genes, names = _axes(spark, sf_dir)
    places = numbered(genes, "gene", name="n").select("gene", (F.lit(len(names) - 1) - F.col("n")).alias("gene_pos"))
    ranks = scoring.rank_genes_per_cell(entries, len(names), "first", places)
    return scoring.first_ranks(ranks, names[::7], places, cells).select("cell", "gene", "rank")


def _binned_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, cells, genes, names = _axes(spark, sf_dir)
    return _round(scoring.binned_control_score(entries, names[:6] + names[-2:], n_bins=4, n_ctrl=1000, cells=cells, genes=genes), "score")


def _signature_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, cells, genes, names = _axes(spark, sf_dir)
    return _round(scoring.signature_score(entries, names[:8], names[20:60], cells, genes), "score")


def _mean_bins_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, cells, genes, _ = _axes(spark, sf_dir)
    return scoring.mean_cut_bins(scoring.gene_means(entries, cells, genes), 10).select("gene", "bin")


def _still(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """Paired vectors of which every ``every``-th gene didn't move."""
    pairs = st.paired_coordinates(spark, sf_dir)
    left = pairs.filter("side = 'X'")
    same = left.filter(F.col("gene").cast("long") % every == 0).withColumn("side", F.lit("Y"))
    moved = pairs.filter("side = 'Y'").filter(F.col("gene").cast("long") % every != 0)
    both = left.unionByName(same).unionByName(moved)
    return both.join(moved.unionByName(same).select("gene"), "gene", "left_semi").join(left.select("gene"), "gene", "left_semi")


def _regulation(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    table = rg.d_regulation(_still(spark, sf_dir, every), lmbda=0.5)
    return _round(table.withColumnRenamed("boxcox-transformed distance", "transformed"), "Distance", "transformed", "Z", "FC", "p-value", "adjusted p-value")


def _regulation_sql(every: int) -> str:
    """Every column from its definition; the distribution function by Simpson's rule."""
    return f"""WITH {_PAIRS}, t AS (SELECT a.gene, CASE WHEN CAST(a.gene AS BIGINT) % {every} = 0 THEN 0 ELSE list_distance(a.coords, b.coords) END AS d
  FROM m a LEFT JOIN m b ON a.gene = b.gene AND b.side = 'Y' WHERE a.side = 'X' AND (b.gene IS NOT NULL OR CAST(a.gene AS BIGINT) % {every} = 0)),
f AS (SELECT gene, d, CASE WHEN d > 0 THEN (sqrt(d) - 1) / 0.5 END AS b, coalesce(d * d / nullif(avg(d * d) OVER (), 0), 0) AS fc FROM t),
p AS (SELECT gene, 1 - 2 / sqrt(pi()) * sqrt(any_value(fc) / 2) / 3000 * sum(CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(fc / 2) * (i / 1000.0::DOUBLE) * (i / 1000.0::DOUBLE))) AS p FROM f, range(1001) AS g(i) GROUP BY gene)
SELECT f.gene AS Gene, round(d, 6) AS Distance, round(b, 6) AS transformed, round((b - avg(b) OVER ()) / nullif(stddev_pop(b) OVER (), 0), 6) AS Z, round(fc, 6) AS FC, round(p, 6) AS "p-value",
  round(least(p * count(*) OVER () / (rank() OVER (ORDER BY round(p, 12)) + (count(*) OVER (PARTITION BY round(p, 12)) - 1) / 2), 1), 6) AS "adjusted p-value" FROM f JOIN p USING (gene)"""


def _auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, genes = _gene_list(spark, sf_dir)
    return _round(scoring.signature_auc(scoring.rank_genes_per_cell(entries, len(genes)), genes[:10], 40), "auc")


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, genes = _gene_list(spark, sf_dir)
    return scoring.control_genes(scoring.qcut_bins(scoring.gene_means(entries), 5), genes[:3], 1000)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/netloom-{uuid.uuid4().hex}"


def _mtx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts written as a coordinate list with name files, each as part files in order, and read again."""
    entries = materialize(st.one_sample(spark, sf_dir), "entries")
    folder = _folder(spark)
    genes, cells = (numbered(entries.select(c).distinct(), c, name=n) for c, n in (("gene", "g"), ("cell", "c")))
    for df, c, n in ((genes, "gene", "g"), (cells, "cell", "c")):
        df.orderBy(n).select(c).write.text(f"{folder}/{c}s.tsv")
    lines = entries.join(genes, "gene").join(cells, "cell").select(F.lit(1).alias("o"), F.col("c").alias("at"), F.concat_ws(" ", F.col("g") + 1, F.col("c") + 1, "value").alias("value"))
    head = spark.createDataFrame([(0, 0, f"{genes.count()} {cells.count()} {entries.count()}")], "o int, at long, value string")
    head.union(lines).orderBy("o", "at").select("value").write.text(f"{folder}/matrix.txt")
    return mtx.read_mtx_sparse(spark, f"{folder}/matrix.txt", f"{folder}/genes.tsv", f"{folder}/cells.tsv")


def _dense_round_trip(spark: SparkSession, sf_dir: str, whole_folder: bool) -> DataFrame:
    """All vectors as a dense table (a line each) with name files, read as files or as a folder."""
    folder = _folder(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding IS NOT NULL").orderBy("vec_id")
    vectors.select(F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ",", "0").alias("value")).write.text(f"{folder}/matrix.csv")
    vectors.select(F.col("vec_id").cast("string")).write.text(f"{folder}/genes.tsv")
    spark.range(64).select(F.format_string("d%02d", "id").alias("value")).orderBy("value").write.text(f"{folder}/barcodes.tsv")
    if whole_folder:
        return mtx.read_folder(spark, folder)
    return mtx.read_mtx_dense(spark, *(f"{folder}/{n}" for n in ("matrix.csv", "genes.tsv", "barcodes.tsv")))


def _headed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as a headed table, a row each, read again."""
    path = f"{_folder(spark)}/wide.csv"
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding IS NOT NULL")
    vectors.select(F.col("vec_id").alias("gene"), *[F.col("embedding")[i].cast("double").alias(f"d{i:02d}") for i in range(64)]).write.option("header", True).csv(path)
    return st.expression_table(spark, path)


_DENSE_BACK = f"WITH {_DENSE} SELECT label, cell AS gene, gene AS cell, value FROM e WHERE value <> 0"


def _step_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    mtx.write_step(st.two_samples(spark, sf_dir), folder, "qc", {})
    return mtx.read_step(spark, folder, "qc")[0].select("label", "gene", "cell", "value")


def _manifold_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired vectors through the CSV files of an alignment."""
    folder = _folder(spark)
    mtx.write_csv(st.paired_coordinates(spark, sf_dir), folder, "ma")
    rows = mtx.read_csv(spark, folder, "ma")
    return rows.select("side", "gene", *[F.col("coords")[k].alias(f"NLMA_{k + 1}") for k in range(64)])


def _regulation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    mtx.write_csv(_regulation(spark, sf_dir, 3), folder, "dr")
    return mtx.read_csv(spark, folder, "dr")


def _all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pcnet.make_networks(qc.sc_qc(st.one_sample(spark, sf_dir), ONE), n_nets=1, n_samp_cells=None, q=0.0)


def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, genes = _gene_list(spark, sf_dir)
    return _round(scoring.signature_score(nm.log_normalize(entries), genes[:8], genes[20:60]), "score")


def _cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, genes = _gene_list(spark, sf_dir)
    return _round(scoring.cell_cycle_score(nm.log_normalize(entries), genes[:20]), "score")


def _mean_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.mean_cut_bins(scoring.gene_means(st.one_sample(spark, sf_dir)), 10).select("gene", "bin")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, genes = _gene_list(spark, sf_dir)
    return scoring.control_pool(scoring.mean_cut_bins(scoring.gene_means(entries), 10), genes[:2]).select("gene")


def _qq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rg.fdr_adjust(rg.chi2_pvalue(rg.fold_change(_distances(spark, sf_dir))))
    table = rows.select(F.col("gene").alias("Gene"), "FC", F.col("adjusted").alias("adjusted p-value"))
    return _round(views.qq_table(table), "observed", "theoretical", "slope", "intercept")


QUERIES = {
    "read_mtx_sparse": (_mtx_round_trip, f"WITH {_ONE} SELECT * FROM e"),
    "read_step": (_step_round_trip, f"WITH {_TWO} SELECT * FROM e"),
    "read_mtx_dense": (lambda s, d: _dense_round_trip(s, d, False), _DENSE_BACK),
    "read_folder": (lambda s, d: _dense_round_trip(s, d, True), _DENSE_BACK),
    "read_expression_table": (_headed_round_trip, _DENSE_BACK),
    "manifold_csv": (_manifold_csv, f"WITH {_PAIRS} SELECT side, gene, " + ", ".join(f"coords[{k}] AS NLMA_{k}" for k in range(1, 65)) + " FROM m"),
    "regulation_csv": (_regulation_csv, _regulation_sql(3)),
    "qc_tables_cells": (lambda s, d: qc.qc_tables(st.two_samples(s, d), TWO)[1], f"WITH {_qc_sql(_TWO, TWO)} SELECT label, cell FROM mit"),
    "default_barcodes": (lambda s, d: st.default_barcodes(s, s.read.parquet(f"{d}/customer.parquet").count()), "SELECT 'barcode_' || i AS cell, i AS cell_pos FROM (SELECT row_number() OVER () - 1 AS i FROM customer)"),
    "cal_pcnet": (_all_cells, None),
    "signature_auc": (
        _auc,
        f"""WITH {_ONE}, g AS (SELECT gene, row_number() OVER (ORDER BY gene) AS i FROM (SELECT DISTINCT gene FROM e)), c AS (SELECT DISTINCT cell FROM e),
r AS (SELECT cell, gene, i, rank() OVER (PARTITION BY cell ORDER BY coalesce(value, 0) DESC) + (count(*) OVER (PARTITION BY cell, coalesce(value, 0)) - 1) / 2 AS r FROM c CROSS JOIN g LEFT JOIN e USING (cell, gene))
SELECT 'all' AS label, cell, round(CASE WHEN min(r) > 40 THEN 0 ELSE 1 - (sum(CASE WHEN r > 40 THEN 41 ELSE r END) - 55) / 400 END, 6) AS auc FROM r WHERE i <= 10 GROUP BY 2""",
    ),
    "control_genes": (
        _controls,
        f"WITH {_ONE}, m AS (SELECT gene, sum(value) / (SELECT count(DISTINCT cell) FROM e) AS v FROM e GROUP BY 1), q AS (SELECT quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM m), b AS (SELECT gene, greatest(len(list_filter(q, lambda x : x < v)) - 1, 0) AS bin, row_number() OVER (ORDER BY gene) AS i FROM m, q) SELECT 'all' AS label, t.gene AS target, b.gene FROM b t JOIN b USING (bin) WHERE t.i <= 3",
    ),
    "entry_mean_cpm": (
        lambda s, d: nm.cpm_norm(qc.sc_qc(st.one_sample(s, d), ONE)).groupBy("gene").agg(F.round(F.avg("value"), 4).alias("mean_cpm")).orderBy(F.desc("mean_cpm"), "gene").limit(20),
        f"WITH {_qc_sql(_ONE, ONE)} SELECT gene, round(avg(value * 1e6 / size), 4) AS mean_cpm FROM (SELECT *, sum(value) OVER (PARTITION BY cell) AS size FROM kept) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    ),
    "collapse_duplicate_genes": (
        lambda s, d: qc.collapse_duplicate_genes(st.trade_networks(s, d).select(F.col("source").alias("label"), F.col("target").alias("gene"), F.lit("c").alias("cell"), F.col("weight").alias("value"))),
        f"WITH {_NETS} SELECT source AS label, target AS gene, 'c' AS cell, sum(weight) AS value FROM n GROUP BY 1, 2 HAVING sum(weight) <> 0",
    ),
    "clamp_negative": (lambda s, d: qc.clamp_negative(st.dense_sample(s, d)), f"WITH {_DENSE} SELECT label, gene, cell, value FROM e WHERE value > 0"),
    "filter_lib_size": (lambda s, d: qc.filter_lib_size(qc.cell_totals(st.one_sample(s, d)), 500), f"WITH {_qc_sql(_ONE, ONE)} SELECT * FROM lib"),
    "filter_outlier_cells": (lambda s, d: qc.filter_outlier_cells(qc.filter_lib_size(qc.cell_totals(st.two_samples(s, d)), 150)), f"WITH {_qc_sql(_TWO, TWO)} SELECT * FROM outl"),
    "filter_mito_ratio": (lambda s, d: qc.filter_mito_ratio(qc.cell_totals(st.one_sample(s, d)), st.one_sample(s, d), 0.1), f"WITH {_ONE} SELECT * FROM (SELECT label, cell, sum(value) AS size, sum(CASE WHEN upper(gene) LIKE 'MT-%' THEN value ELSE 0 END) AS mito FROM e GROUP BY 1, 2) WHERE mito / size < 0.1"),
    "filter_gene_detection": (
        lambda s, d: qc.filter_gene_detection(qc.gene_totals(st.one_sample(s, d), qc.cells_of(st.one_sample(s, d))), 0.2).select("gene", "detected", "n_cells"),
        f"WITH {_ONE}, c AS (SELECT count(DISTINCT cell) AS n_cells FROM e) SELECT gene, count(*) AS detected, any_value(n_cells) AS n_cells FROM e, c GROUP BY 1 HAVING count(*) / any_value(n_cells) > 0.2",
    ),
    "filter_gene_expression": (
        lambda s, d: qc.filter_gene_expression(qc.gene_totals(st.two_samples(s, d), qc.cells_of(st.two_samples(s, d))), 1.5, 400).select("label", "gene", F.col("sum").alias("s")),
        f"WITH {_TWO}, c AS (SELECT label, count(DISTINCT cell) AS n FROM e GROUP BY 1) SELECT label, gene, sum(value) AS s FROM e JOIN c USING (label) GROUP BY 1, 2 HAVING CASE WHEN any_value(n) > 500 THEN sum(value) / any_value(n) >= 1.5 ELSE sum(value) >= 400 END",
    ),
    "sc_qc": (lambda s, d: qc.sc_qc(st.two_samples(s, d), TWO), f"WITH {_qc_sql(_TWO, TWO)} SELECT label, gene, cell, value FROM kept"),
    "qc_report": (
        lambda s, d: qc.qc_report(st.two_samples(s, d), TWO),
        f"WITH {_qc_sql(_TWO, TWO)}, t AS (SELECT label, 'cells' AS step, count(*) AS n FROM cells GROUP BY 1 UNION ALL SELECT label, 'lib_size', count(*) FROM lib GROUP BY 1 UNION ALL SELECT label, 'outlier', count(*) FROM outl GROUP BY 1 UNION ALL SELECT label, 'mito', count(*) FROM mit GROUP BY 1 UNION ALL SELECT label, 'genes', count(*) FROM genes GROUP BY 1 UNION ALL SELECT label, 'detection', count(*) FROM det GROUP BY 1 UNION ALL SELECT label, 'expression', count(*) FROM expr GROUP BY 1), o AS (SELECT * FROM (VALUES ('cells', 'lib_size'), ('lib_size', 'outlier'), ('outlier', 'mito'), ('genes', 'detection'), ('detection', 'expression')) AS v(before, after)) SELECT a.label, o.after AS step, a.n - coalesce(b.n, 0) AS removed FROM o JOIN t a ON a.step = o.before LEFT JOIN t b ON b.step = o.after AND b.label = a.label",
    ),
    "library_size_histogram": (
        lambda s, d: qc.library_size_histogram(st.two_samples(s, d), 0, 12),
        f"WITH {_TWO}, z AS (SELECT label, cell, sum(value) AS size FROM e GROUP BY 1, 2), m AS (SELECT label, min(size) AS lo, max(size) AS hi FROM z GROUP BY 1) SELECT label, CAST(least(floor((size - lo) * 12 / nullif(hi - lo, 0)), 11) AS INTEGER) AS bin, count(*) AS n FROM z JOIN m USING (label) GROUP BY 1, 2",
    ),
    "cpm_norm": (lambda s, d: _round(nm.cpm_norm(st.one_sample(s, d)), "value"), f"WITH {_ONE} SELECT label, gene, cell, round(value * 1e6 / sum(value) OVER (PARTITION BY cell), 6) AS value FROM e"),
    "log_normalize": (lambda s, d: _round(nm.log_normalize(st.one_sample(s, d)), "value"), f"WITH {_ONE} SELECT label, gene, cell, round(ln(1 + value / sum(value) OVER (PARTITION BY cell) * 1e4), 6) AS value FROM e"),
    "zscore_genes": (lambda s, d: _round(nm.zscore_genes(st.dense_sample(s, d)), "value"), f"WITH {_DENSE} SELECT label, gene, cell, round((value - avg(value) OVER g) / stddev_pop(value) OVER g, 6) AS value FROM e WINDOW g AS (PARTITION BY gene)"),
    "shared_genes": (lambda s, d: ed.shared_genes(st.two_samples(s, d)), f"WITH {_TWO} SELECT label, gene, cell, value FROM e WHERE gene IN (SELECT gene FROM e WHERE label = 'X' INTERSECT SELECT gene FROM e WHERE label = 'Y')"),
    "draw_cells": (_draws, f"WITH {_ONE}, {_DRAWN} SELECT net_id, draw_id, gene, cell, value FROM e JOIN w USING (cell)"),
    "expressed_genes": (lambda s, d: ed.expressed_genes(_draws(s, d)), f"WITH {_ONE}, {_DRAWN} SELECT net_id, gene, sum(value) AS total FROM e JOIN w USING (cell) GROUP BY 1, 2 HAVING sum(value) > 0"),
    "gene_gram": (
        lambda s, d: _round(pcnet.gene_correlation(st.dense_sample(s, d), s.read.parquet(f"{d}/embeddings.parquet").count()), "r"),
        f"WITH {_DENSE} SELECT a.gene AS g1, b.gene AS g2, round(corr(a.value, b.value), 6) AS r FROM e a JOIN e b ON a.cell = b.cell AND a.gene <= b.gene GROUP BY 1, 2",
    ),
    "symmetrize": (lambda s, d: ed.symmetrize(st.trade_networks(s, d)), f"WITH {_NETS} SELECT * FROM (SELECT net_id, target, source, sum(weight) / 2 AS weight FROM (SELECT * FROM n UNION ALL SELECT net_id, source, target, weight FROM n) GROUP BY 1, 2, 3) WHERE weight <> 0"),
    "scale_edges": (lambda s, d: _round(ed.scale_edges(st.trade_networks(s, d)), "weight"), f"WITH {_NETS} SELECT net_id, target, source, round(weight / max(abs(weight)) OVER (PARTITION BY net_id), 6) AS weight FROM n"),
    "quantile_threshold": (
        lambda s, d: ed.quantile_threshold(ed.zero_diagonal(st.trade_networks(s, d)), _sizes(s, d, st.trade_networks(s, d)), 0.9),
        f"WITH {_NETS}, z AS (SELECT * FROM n WHERE target <> source), a AS (SELECT net_id, abs(weight) AS v FROM z UNION ALL SELECT net_id, 0.0 FROM (SELECT net_id, (SELECT count(DISTINCT n_name) ** 2 FROM nation) - count(*) AS k FROM z GROUP BY 1), range((SELECT CAST(count(DISTINCT n_name) ** 2 AS BIGINT) FROM nation)) AS g(i) WHERE i < k), c AS (SELECT net_id, quantile_cont(v, 0.9) AS cut FROM a GROUP BY 1) SELECT net_id, target, source, weight FROM z JOIN c USING (net_id) WHERE abs(weight) >= cut",
    ),
    "stack_networks": (
        lambda s, d: tensor.stack_networks(st.trade_networks(s, d)),
        f"WITH {_NETS} SELECT net_id, count(*) AS edges, count(DISTINCT target) AS targets, sum(weight) AS total FROM n GROUP BY 1",
    ),
    "cp_mttkrp": (
        _mttkrp,
        f"WITH {_NETS}, s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM n)), t AS (SELECT net_id, row_number() OVER (ORDER BY net_id) - 1 AS j FROM (SELECT DISTINCT net_id FROM n)) SELECT target, " + ", ".join(f"sum(weight * ((i * 3 + {k * 5}) % 7 + 1) / 4 * ((j * 3 + {k * 5}) % 7 + 1) / 4) AS k{k}" for k in range(3)) + " FROM n JOIN s USING (source) JOIN t USING (net_id) GROUP BY 1",
    ),
    "cp_average_network": (
        _average,
        f"WITH {_NETS}, t AS (SELECT target, row_number() OVER (ORDER BY target) - 1 AS h FROM (SELECT DISTINCT target FROM n)), s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM n)), y AS (SELECT " + ", ".join(f"avg(((j * 3 + {k * 5}) % 7 + 1) / 4) AS c{k}" for k in range(3)) + " FROM (SELECT row_number() OVER (ORDER BY net_id) - 1 AS j FROM (SELECT DISTINCT net_id FROM n))) SELECT target, source, round(" + " + ".join(f"((h * 3 + {k * 5}) % 7 + 1) / 4 * ((i * 3 + {k * 5}) % 7 + 1) / 4 * c{k}" for k in range(3)) + ", 6) AS weight FROM t, s, y",
    ),
    "cp_denoised_network": (
        _denoised,
        f"WITH {_NETS}, t AS (SELECT target, row_number() OVER (ORDER BY target) - 1 AS h FROM (SELECT DISTINCT target FROM n)), s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM n)), y AS (SELECT " + ", ".join(f"avg(((j * 3 + {k * 5}) % 7 + 1) / 4) AS c{k}" for k in range(3)) + " FROM (SELECT row_number() OVER (ORDER BY net_id) - 1 AS j FROM (SELECT DISTINCT net_id FROM n))) SELECT * FROM (SELECT target, source, round_even(w / max(abs(w)) OVER () * 10, 0) / 10 AS weight FROM (SELECT target, source, " + " + ".join(f"((h * 3 + {k * 5}) % 7 + 1) / 4 * ((i * 3 + {k * 5}) % 7 + 1) / 4 * c{k}" for k in range(3)) + " AS w FROM t, s, y)) WHERE weight <> 0",
    ),
    "cp_als": (_cp, None),
    "scale_and_round": (lambda s, d: ed.scale_and_round(st.trade_networks(s, d)), f"WITH {_NETS} SELECT * FROM (SELECT net_id, target, source, round_even(weight / max(abs(weight)) OVER (PARTITION BY net_id) * 10, 0) / 10 AS weight FROM n) WHERE weight <> 0"),
    "strict_direction": (
        lambda s, d: ed.strict_direction(st.trade_networks(s, d), 0.75),
        f"WITH {_NETS} SELECT net_id, target, source, w AS weight FROM (SELECT a.net_id, a.target, a.source, 0.25 * a.weight + 0.75 * CASE WHEN abs(a.weight) < abs(coalesce(b.weight, 0)) THEN 0 ELSE a.weight END AS w FROM n a LEFT JOIN n b ON a.net_id = b.net_id AND a.target = b.source AND a.source = b.target) WHERE w <> 0",
    ),
    "transpose_network": (lambda s, d: ed.zero_diagonal(ed.transpose(st.trade_networks(s, d))), f"WITH {_NETS} SELECT net_id, source AS target, target AS source, weight FROM n WHERE target <> source"),
    "knockout_rows": (lambda s, d: ed.knockout_rows(st.trade_networks(s, d), [_first_nation(_nation_counts(s, d))]), f"WITH {_NETS} SELECT * FROM n WHERE target <> (SELECT min(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey)"),
    "ko_propagation": (
        _propagation,
        f"""WITH {_NETS}, b AS (SELECT net_id, target, source, weight / max(abs(weight)) OVER (PARTITION BY net_id) AS weight FROM n JOIN nation t ON t.n_name = target JOIN nation s ON s.n_name = source WHERE net_id % 2 = 1 OR t.n_regionkey <> s.n_regionkey), b0 AS (SELECT * FROM b WHERE target <> source),
x AS (SELECT net_id, n_name AS gene, c_mktsegment AS cell, CAST(count(*) AS DOUBLE) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey, (SELECT DISTINCT net_id FROM b0) GROUP BY 1, 2, 3),
p0 AS (SELECT * FROM x WHERE gene IN (SELECT DISTINCT gene FROM x JOIN nation ON n_name = gene WHERE n_regionkey = 0 ORDER BY 1 LIMIT 2)),
p1 AS (SELECT b0.net_id, target AS gene, cell, sum(weight * value) AS value FROM b0 JOIN p0 ON b0.net_id = p0.net_id AND source = gene GROUP BY 1, 2, 3),
v1 AS (SELECT DISTINCT net_id, gene FROM p1 WHERE value <> 0),
open1 AS (SELECT DISTINCT x.net_id FROM x ANTI JOIN v1 USING (net_id, gene)),
p2 AS (SELECT b0.net_id, target AS gene, cell, sum(weight * value) AS value FROM b0 JOIN p1 ON b0.net_id = p1.net_id AND source = gene JOIN open1 ON b0.net_id = open1.net_id GROUP BY 1, 2, 3),
p AS (SELECT net_id, gene, cell, sum(value) AS p FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY 1, 2, 3)
SELECT net_id, gene, cell, round(v, 6) AS value FROM (SELECT coalesce(x.net_id, p.net_id) AS net_id, coalesce(x.gene, p.gene) AS gene, coalesce(x.cell, p.cell) AS cell, greatest(coalesce(value, 0) - coalesce(p, 0), 0) AS v FROM x FULL JOIN p USING (net_id, gene, cell)) WHERE v > 0""",
    ),
    "joint_laplacian": (
        _degrees,
        f"""WITH {_NETS}, {_PAIR}, k AS (SELECT count(*) AS n FROM g),
c AS (SELECT n, 0.9 * ((SELECT coalesce(sum(weight), 0) FROM x) + (SELECT coalesce(sum(weight), 0) FROM y) + 2 * n * n) / (2 * n) AS c FROM k)
SELECT side, gene, round(coalesce(s, 0) + n - 1 + c, 6) AS degree, round(c, 6) AS c FROM (
  SELECT 'X' AS side, g.gene, s FROM g LEFT JOIN (SELECT source AS gene, sum(weight) AS s FROM x WHERE target <> source GROUP BY 1) q ON g.gene = q.gene
  UNION ALL SELECT 'Y', g.gene, s FROM g LEFT JOIN (SELECT source AS gene, sum(weight) AS s FROM y WHERE target <> source GROUP BY 1) q ON g.gene = q.gene), c""",
    ),
    "align_networks": (
        _aligned,
        f"""WITH {_NETS}, {_PAIR} SELECT gene, (SELECT count(*) FROM x WHERE source = gene) AS x_out, (SELECT count(*) FROM x WHERE target = gene) AS x_in,
(SELECT count(*) FROM y WHERE source = gene) AS y_out, (SELECT count(*) FROM y WHERE target = gene) AS y_in FROM g""",
    ),
    "manifold_alignment": (_manifold, None),
    "manifold_wide": (_manifold_wide, None),
    "check_pairs": (lambda s, d: rg.check_pairs(st.paired_coordinates(s, d)), f"WITH {_PAIRS} SELECT gene, min(side) AS side FROM m GROUP BY 1 HAVING count(DISTINCT side) < 2"),
    "pair_distance": (lambda s, d: _round(_distances(s, d), "distance"), f"WITH {_PAIRS} SELECT a.gene, round(list_distance(a.coords, b.coords), 6) AS distance FROM m a JOIN m b USING (gene) WHERE a.side = 'X' AND b.side = 'Y'"),
    "boxcox": (lambda s, d: _round(rg.boxcox(_distances(s, d), 0.5), "distance", "transformed"), f"WITH {_PAIRS} SELECT gene, round(d, 6) AS distance, round(CASE WHEN d > 0 THEN (sqrt(d) - 1) / 0.5 END, 6) AS transformed FROM (SELECT a.gene, list_distance(a.coords, b.coords) AS d FROM m a JOIN m b USING (gene) WHERE a.side = 'X' AND b.side = 'Y')"),
    "zscore_distance": (lambda s, d: _round(rg.zscore(_distances(s, d), "distance").select("gene", "Z"), "Z"), f"WITH {_PAIRS} SELECT gene, round((d - avg(d) OVER ()) / stddev_pop(d) OVER (), 6) AS Z FROM (SELECT a.gene, list_distance(a.coords, b.coords) AS d FROM m a JOIN m b USING (gene) WHERE a.side = 'X' AND b.side = 'Y')"),
    "fold_change": (
        lambda s, d: _round(rg.fold_change(_distances(s, d), 3).select("gene", "FC"), "FC"),
        f"WITH {_PAIRS}, t AS (SELECT gene, d, row_number() OVER (ORDER BY d DESC, gene) AS r FROM (SELECT a.gene, list_distance(a.coords, b.coords) AS d FROM m a JOIN m b USING (gene) WHERE a.side = 'X' AND b.side = 'Y')) SELECT gene, round(d * d / (SELECT avg(d * d) FROM t WHERE r > 3), 6) AS FC FROM t",
    ),
    "chi2_pvalue": (
        lambda s, d: _round(rg.chi2_pvalue(rg.fold_change(_distances(s, d))).select("gene", "p_value"), "p_value"),
        f"WITH {_PAIRS}, t AS (SELECT gene, d * d / avg(d * d) OVER () AS fc FROM (SELECT a.gene, list_distance(a.coords, b.coords) AS d FROM m a JOIN m b USING (gene) WHERE a.side = 'X' AND b.side = 'Y')) SELECT gene, round(1 - 2 / sqrt(pi()) * sqrt(any_value(fc) / 2) / 3000 * sum(CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(fc / 2) * (i / 1000.0::DOUBLE) * (i / 1000.0::DOUBLE))), 6) AS p_value FROM t, range(1001) AS g(i) GROUP BY gene",
    ),
    "fdr_adjust": (_fdr, "SELECT l_orderkey, l_linenumber, l_tax AS p_value, round(least(l_tax * count(*) OVER () / (rank() OVER (ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2), 1), 6) AS adjusted FROM lineitem"),
    "fdr_adjust_nulls": (
        lambda s, d: _round(rg.fdr_adjust(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.nullif("l_tax", F.lit(0.0)).alias("p_value"))), "adjusted"),
        "SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS p_value, CASE WHEN l_tax <> 0 THEN round(least(l_tax * count(nullif(l_tax, 0)) OVER () / (rank() OVER (ORDER BY nullif(l_tax, 0) NULLS LAST) + (count(*) OVER (PARTITION BY l_tax) - 1) / 2), 1), 6) END AS adjusted FROM lineitem",
    ),
    "d_regulation_some_still": (lambda s, d: _regulation(s, d, 3), _regulation_sql(3)),
    "d_regulation_all_still": (lambda s, d: _regulation(s, d, 1), _regulation_sql(1)),
    "sort_regulation": (
        lambda s, d: rg.sort_regulation(_round(_distances(s, d), "distance").withColumnRenamed("gene", "Gene"), "distance", False),
        f"WITH {_PAIRS} SELECT a.gene AS Gene, round(list_distance(a.coords, b.coords), 6) AS distance FROM m a JOIN m b USING (gene) WHERE a.side = 'X' AND b.side = 'Y' ORDER BY 2 DESC, 1",
    ),
    "d_regulation": (lambda s, d: rg.d_regulation(st.paired_coordinates(s, d)), None),
    "rank_genes_per_cell": (
        lambda s, d: scoring.rank_genes_per_cell(*_counted(s, d)).select("cell", "gene", "rank", "zero_rank"),
        f"WITH {_ONE} SELECT cell, gene, rank() OVER (PARTITION BY cell ORDER BY value DESC) + (count(*) OVER (PARTITION BY cell, value) - 1) / 2 AS rank, count(*) OVER (PARTITION BY cell) + ((SELECT count(DISTINCT gene) FROM e) - count(*) OVER (PARTITION BY cell) + 1) / 2 AS zero_rank FROM e",
    ),
    "u_score": (
        _u_query,
        f"""WITH {_ONE}, g AS (SELECT gene, row_number() OVER (ORDER BY gene) AS i FROM (SELECT DISTINCT gene FROM e)), c AS (SELECT DISTINCT cell FROM e),
r AS (SELECT cell, gene, i, rank() OVER (PARTITION BY cell ORDER BY coalesce(value, 0) DESC) + (count(*) OVER (PARTITION BY cell, coalesce(value, 0)) - 1) / 2 AS r FROM c CROSS JOIN g LEFT JOIN e USING (cell, gene)),
k AS (SELECT cell, i, CASE WHEN r > 40 THEN 41 ELSE r END AS r FROM r),
u AS (SELECT cell, CASE WHEN min(r) > 40 THEN 0 ELSE 1 - (sum(r) - 55) / 400 END AS a FROM k WHERE i <= 10 GROUP BY 1), w AS (SELECT cell, CASE WHEN min(r) > 40 THEN 0 ELSE 1 - (sum(r) - 15) / 200 END AS b FROM k WHERE i BETWEEN 11 AND 15 GROUP BY 1)
SELECT 'all' AS label, cell, round(a - b, 6) AS score FROM u JOIN w USING (cell)""",
    ),
    "u_score_axes": (lambda s, d: _u_axes(s, d, "average"), _u_axes_sql("rank() OVER (PARTITION BY cell ORDER BY value DESC) + (count(*) OVER (PARTITION BY cell, value) - 1) / 2")),
    "u_score_first": (lambda s, d: _u_axes(s, d, "first"), _u_axes_sql("row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene)")),
    "rank_genes_first": (_first_ranks, f"WITH {_AXES} SELECT cell, gene, CAST(r AS DOUBLE) AS rank FROM (SELECT cell, gene, i, row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene DESC) AS r FROM d) WHERE (i - 1) % 7 = 0"),
    "binned_control_axes": (
        _binned_axes,
        f"""WITH {_AXES}, m AS (SELECT gene, any_value(i) AS i, avg(value) AS v FROM d GROUP BY 1), q AS (SELECT quantile_cont(v, [0, 0.25, 0.5, 0.75, 1.0]) AS q FROM m),
b AS (SELECT gene, i, greatest(len(list_filter(q, lambda x : x < v)) - 1, 0) AS bin, max(i) OVER () AS last FROM m, q),
x AS (SELECT cell, bin, avg(value) AS ctrl FROM d JOIN b USING (gene) GROUP BY 1, 2)
SELECT 'all' AS label, cell, round(avg(value - ctrl), 6) AS score FROM d JOIN b USING (gene) JOIN x USING (cell, bin) WHERE b.i <= 6 OR b.i > last - 2 GROUP BY 2""",
    ),
    "mean_cut_axes": (
        _mean_bins_axes,
        f"WITH {_AXES}, m AS (SELECT gene, v, row_number() OVER (ORDER BY v, gene) - 1 AS p, count(*) OVER () AS g FROM (SELECT gene, sum(value) / count(*) AS v FROM d GROUP BY 1)), k AS (SELECT i, v AS cut FROM m JOIN range(1, 10) AS r(i) ON p = round_even(g / 10 * i, 0)) SELECT gene, CAST(coalesce((SELECT min(i) FROM k WHERE m.v <= cut), 0) AS INTEGER) AS bin FROM m",
    ),
    "signature_axes": (_signature_axes, f"WITH {_AXES} SELECT 'all' AS label, cell, round(sum(CASE WHEN i <= 8 THEN value ELSE 0 END) / 8 - sum(CASE WHEN i BETWEEN 21 AND 60 THEN value ELSE 0 END) / 40, 6) AS score FROM d GROUP BY 2"),
    "qcut_bins": (
        lambda s, d: scoring.qcut_bins(scoring.gene_means(st.one_sample(s, d)), 5).select("gene", "bin"),
        f"WITH {_ONE}, m AS (SELECT gene, sum(value) / (SELECT count(DISTINCT cell) FROM e) AS v FROM e GROUP BY 1), q AS (SELECT quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM m) SELECT gene, CAST(greatest(len(list_filter(q, lambda x : x < v)) - 1, 0) AS INTEGER) AS bin FROM m, q",
    ),
    "binned_control_score": (
        _binned,
        f"""WITH {_ONE}, c AS (SELECT DISTINCT cell FROM e), m AS (SELECT gene, sum(value) / (SELECT count(*) FROM c) AS v FROM e GROUP BY 1), q AS (SELECT quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM m),
b AS (SELECT gene, greatest(len(list_filter(q, lambda x : x < v)) - 1, 0) AS bin, row_number() OVER (ORDER BY gene) AS i FROM m, q),
x AS (SELECT cell, bin, sum(value) / any_value(n) AS ctrl FROM e JOIN b USING (gene) JOIN (SELECT bin, count(*) AS n FROM b GROUP BY 1) USING (bin) GROUP BY 1, 2)
SELECT 'all' AS label, c.cell, round(avg(coalesce(e.value, 0) - coalesce(x.ctrl, 0)), 6) AS score FROM c CROSS JOIN (SELECT * FROM b WHERE i <= 10) t LEFT JOIN e ON e.cell = c.cell AND e.gene = t.gene LEFT JOIN x ON x.cell = c.cell AND x.bin = t.bin GROUP BY 1, 2""",
    ),
    "mean_cut_bins": (
        _mean_bins,
        f"WITH {_ONE}, m AS (SELECT gene, v, row_number() OVER (ORDER BY v, gene) - 1 AS p, count(*) OVER () AS g FROM (SELECT gene, sum(value) / (SELECT count(DISTINCT cell) FROM e) AS v FROM e GROUP BY 1)), k AS (SELECT i, v AS cut FROM m JOIN range(1, 10) AS r(i) ON p = round_even(g / 10 * i, 0)) SELECT gene, CAST(coalesce((SELECT min(i) FROM k WHERE m.v <= cut), 0) AS INTEGER) AS bin FROM m",
    ),
    "control_pool": (
        _pool,
        f"WITH {_ONE}, m AS (SELECT gene, v, row_number() OVER (ORDER BY v, gene) - 1 AS p, count(*) OVER () AS g FROM (SELECT gene, sum(value) / (SELECT count(DISTINCT cell) FROM e) AS v FROM e GROUP BY 1)), k AS (SELECT i, v AS cut FROM m JOIN range(1, 10) AS r(i) ON p = round_even(g / 10 * i, 0)), b AS (SELECT gene, coalesce((SELECT min(i) FROM k WHERE m.v <= cut), 0) AS bin FROM m) SELECT gene FROM b WHERE bin IN (SELECT bin FROM b ORDER BY gene LIMIT 2)",
    ),
    "signature_score": (
        _signature,
        f"WITH {_ONE}, g AS (SELECT gene, row_number() OVER (ORDER BY gene) AS i FROM (SELECT DISTINCT gene FROM e)), l AS (SELECT cell, i, ln(1 + value / sum(value) OVER (PARTITION BY cell) * 1e4) AS v FROM e JOIN g USING (gene)) SELECT 'all' AS label, cell, round(sum(CASE WHEN i <= 8 THEN v ELSE 0 END) / 8 - sum(CASE WHEN i BETWEEN 21 AND 60 THEN v ELSE 0 END) / 40, 6) AS score FROM l GROUP BY 2",
    ),
    "cell_cycle_score": (lambda s, d: _cycle(s, d), None),
    "make_networks": (_networks, None),
    "pca_tables": (lambda s, d: views.pca_tables(st.dense_sample(s, d), 4)[0], None),
    "label_embedding": (
        lambda s, d: views.label_embedding(st.dense_sample(s, d).groupBy("cell").agg(F.round(F.sum("value"), 6).alias("total")), s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("cell"), F.col("label").alias("group"))),
        f"WITH {_DENSE} SELECT cell, round(sum(value), 6) AS total, any_value(v.label) AS \"group\" FROM e JOIN embeddings v ON e.cell = CAST(v.vec_id AS VARCHAR) GROUP BY 1",
    ),
    "network_subgraph": (
        lambda s, d: ed.subgraph(st.trade_networks(s, d), 20, 200),
        f"WITH {_NETS}, k AS (SELECT net_id, target, source, abs(weight) AS weight FROM n WHERE abs(weight) >= 20) SELECT * FROM k WHERE (net_id, target) IN (SELECT (net_id, target) FROM k GROUP BY net_id, target HAVING sum(weight) > 200) AND (net_id, source) IN (SELECT (net_id, source) FROM k GROUP BY net_id, source HAVING sum(weight) > 200)",
    ),
    "qq_table": (_qq, None),
    "qq_order": (lambda s, d: _qq(s, d).select("Gene", "i", "observed"), f"WITH {_PAIRS}, t AS (SELECT gene, d * d / avg(d * d) OVER () AS fc FROM (SELECT a.gene, list_distance(a.coords, b.coords) AS d FROM m a JOIN m b USING (gene) WHERE a.side = 'X' AND b.side = 'Y')) SELECT gene AS Gene, CAST(row_number() OVER (ORDER BY fc, gene) AS INTEGER) AS i, round(fc, 6) AS observed FROM t"),
    "job_net": (_job_net, None),
    "job_knk": (_job_knk, None),
    "job_knk_propagation": (lambda s, d: _job_knk(s, d, "propagation"), None),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
