"""Operations on edge tables: ``net_id``, ``target`` (row), ``source`` (column), ``weight``; zeros absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..storage import materialize


def gene_axis(entries: DataFrame) -> DataFrame:
    """Distinct genes of entries: the rows and columns of their networks, edges or not."""
    return entries.select("gene").distinct()


def network_genes(edges: DataFrame) -> DataFrame:
    """Genes that have an edge."""
    return edges.select(F.col("target").alias("gene")).union(edges.select("source")).distinct()


def shared_genes(entries: DataFrame, a: str = "X", b: str = "Y") -> DataFrame:
    """Entries of the genes that both labels have."""
    genes = lambda x: entries.filter(F.col("label") == x).select("gene")
    return entries.join(genes(a).intersect(genes(b)), "gene", "left_semi").filter(F.col("label").isin(a, b))


def draw_cells(entries: DataFrame, draws: DataFrame) -> DataFrame:
    """Entries of drawn cells: ``draws`` (net_id, draw_id, cell) may draw a cell more than once.

    Entries that have a ``net_id`` go to that network alone.
    """
    return entries.join(draws, ["net_id", "cell"] if "net_id" in entries.columns else ["cell"]).select("net_id", "draw_id", "gene", "cell", "value")


def expressed_genes(drawn: DataFrame) -> DataFrame:
    """Genes with a positive sum in each sample."""
    return drawn.groupBy("net_id", "gene").agg(F.sum("value").alias("total")).filter("total > 0")


def transpose(edges: DataFrame) -> DataFrame:
    swap = {"target": "source", "source": "target"}
    return edges.select(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns])


def zero_diagonal(edges: DataFrame) -> DataFrame:
    return edges.filter("target <> source")


def symmetrize(edges: DataFrame) -> DataFrame:
    """(A + A') / 2."""
    both = edges.select("net_id", "target", "source", "weight").unionByName(transpose(edges).select("net_id", "target", "source", "weight"))
    return both.groupBy("net_id", "target", "source").agg((F.sum("weight") / 2).alias("weight")).filter("weight <> 0")


def scale_edges(edges: DataFrame) -> DataFrame:
    """A / max |A| of each network."""
    top = edges.groupBy("net_id").agg(F.max(F.abs("weight")).alias("top"))
    return edges.join(F.broadcast(top), "net_id").select("net_id", "target", "source", F.try_divide("weight", "top").alias("weight"))


#: Bins in which the order statistics of a network's weights are looked for.
BINS = 65_536


def quantile_threshold(edges: DataFrame, sizes: DataFrame, q: float) -> DataFrame:
    """Edges at or above the ``q``-quantile of |A| over all entries of each network, zeros too.

    ``sizes`` (net_id, n_genes) gives the networks' orders. The quantile is linear between order
    statistics. Zeros come first in order, so that only edges are ranked: order statistic k of all entries
    is edge k - zeros, or 0. Edges are counted in BINS bins of |A| first; only those in the one or two bins that
    hold the order statistics are then told apart, equal values counted together.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must lie in [0, 1]")
    tops = edges.groupBy("net_id").agg(F.count("*").alias("n"), F.max(F.abs("weight")).alias("top")).join(sizes, "net_id")
    total = F.col("n_genes").cast("long") * F.col("n_genes")
    tops = tops.select("net_id", "top", (total - F.col("n")).alias("zeros"), (q * (total - 1)).alias("at"), (total - 1).alias("last"))
    size = F.abs("weight").alias("v")
    bin_of = F.least(F.floor(F.try_divide("v", "top") * BINS), F.lit(BINS - 1))
    binned = edges.select("net_id", size).join(F.broadcast(tops), "net_id").withColumn("bin", F.coalesce(bin_of, F.lit(0)))
    place = lambda c: F.col(c) - F.col("zeros")
    low, high = F.floor("at"), F.least(F.floor("at") + 1, F.col("last"))
    upto = F.sum("c").over(Window.partitionBy("net_id").orderBy("bin"))  # at most BINS rows a network
    counts = binned.groupBy("net_id", "bin").agg(F.count("*").alias("c")).withColumn("upto", upto)
    counts = counts.join(F.broadcast(tops.select("net_id", "zeros", low.alias("low"), high.alias("high"))), "net_id")
    holds = lambda c: (place(c) < F.col("upto")) & (place(c) >= F.col("upto") - F.col("c"))
    held = counts.filter(holds("low") | holds("high")).select("net_id", "bin", (F.col("upto") - F.col("c")).alias("before"))
    values = binned.join(F.broadcast(held), ["net_id", "bin"]).groupBy("net_id", "bin", "before", "v").agg(F.count("*").alias("c"))
    values = values.withColumn("hi", F.col("before") + F.sum("c").over(Window.partitionBy("net_id", "bin").orderBy("v"))).select("net_id", "v", "hi")
    found = tops.join(values, "net_id", "left")
    pick = lambda k: F.when(F.max(F.col("zeros") > k), 0.0).otherwise(F.min(F.when(F.col("hi") + F.col("zeros") > k, F.col("v"))))
    cut = found.groupBy("net_id").agg(pick(low).alias("a"), pick(high).alias("b"), F.max(F.col("at") - F.floor("at")).alias("part"))
    cut = cut.select("net_id", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("cut"))  # one row a network
    return edges.join(F.broadcast(cut), "net_id").filter(F.abs("weight") >= F.col("cut")).select("net_id", "target", "source", "weight")


def strict_direction(edges: DataFrame, lambd: float = 1.0) -> DataFrame:
    """(1 - l) A + l S, where S is A without the entries that are smaller than their mirror image."""
    if lambd == 0:
        return edges
    back = edges.select("net_id", F.col("source").alias("target"), F.col("target").alias("source"), F.col("weight").alias("back"))
    kept = F.when(F.abs("weight") < F.abs(F.coalesce("back", F.lit(0.0))), 0.0).otherwise(F.col("weight"))
    out = edges.join(back, ["net_id", "target", "source"], "left").withColumn("weight", (1 - lambd) * F.col("weight") + lambd * kept)
    return out.filter("weight <> 0").select("net_id", "target", "source", "weight")


def check_known(genes: list[str], axis: DataFrame) -> None:
    """Raise for genes that ``axis`` (gene) lacks."""
    wanted = axis.sparkSession.createDataFrame([(g,) for g in genes], "gene string")
    if missing := [r[0] for r in wanted.join(axis, "gene", "left_anti").collect()]:
        raise KeyError(f"genes not in the network: {sorted(missing)}")


def knockout_rows(edges: DataFrame, genes: list[str], axis: DataFrame | None = None) -> DataFrame:
    """The network with the rows of ``genes`` set to zero; a gene that ``axis`` (else: every edge) lacks is an error."""
    check_known(genes, network_genes(edges) if axis is None else axis)
    return edges.filter(~F.col("target").isin(*genes)) if genes else edges


def scale_and_round(edges: DataFrame, decimals: int = 1) -> DataFrame:
    """A / max |A|, rounded half to even; zeros leave."""
    unit = 10.0**decimals
    return scale_edges(edges).withColumn("weight", F.rint(F.col("weight") * unit) / unit).filter("weight <> 0")


def align_networks(x: DataFrame, y: DataFrame, x_genes: DataFrame | None = None, y_genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both networks on the genes they share, and those genes (``gene``).

    ``x_genes`` and ``y_genes`` are the networks' gene axes, genes without edges included; without them only
    genes that have an edge count.
    """
    shared = (network_genes(x) if x_genes is None else x_genes.select("gene")).intersect(network_genes(y) if y_genes is None else y_genes.select("gene"))
    ends = lambda e: e.join(shared.hint("merge"), e["target"] == shared["gene"], "left_semi").join(shared.hint("merge"), e["source"] == shared["gene"], "left_semi")
    return ends(x), ends(y), shared


def subgraph(edges: DataFrame, weight_least: float = 0.1, connected: float = 0.0) -> DataFrame:
    """|A| of at least ``weight_least``, between rows and columns whose sums exceed ``connected``."""
    strong = edges.select("net_id", "target", "source", F.abs("weight").alias("weight")).filter(F.col("weight") >= weight_least)
    rows = strong.groupBy("net_id", "target").agg(F.sum("weight").alias("s")).filter(F.col("s") > connected)
    columns = strong.groupBy("net_id", "source").agg(F.sum("weight").alias("s")).filter(F.col("s") > connected)
    return strong.join(rows, ["net_id", "target"], "left_semi").join(columns, ["net_id", "source"], "left_semi").select("net_id", "target", "source", "weight")


def each_network(edges: DataFrame) -> Column:
    """One row for each network of ``edges``, of which there are a few: a generator of ``net_id``."""
    kind = edges.schema["net_id"].dataType
    ids = sorted(r[0] for r in edges.select("net_id").distinct().collect())
    return F.explode(F.array(*map(F.lit, ids)).cast(ArrayType(kind))).alias("net_id")


def _reached(steps: DataFrame, profiles: DataFrame) -> DataFrame:
    """``net_id``, ``gene`` of those that a step (net_id, gene, ko, w) gives a value other than 0 in some cell."""
    values = steps.join(profiles, "ko").groupBy("net_id", "gene", "profile").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return values.filter("value <> 0").select("net_id", "gene").distinct()


def knockout_perturbation(edges: DataFrame, x: DataFrame, ko_genes: list[str], degree: int, genes: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """What a knockout that spreads over ``degree`` steps takes from the counts of each network: ``net_id``, ``gene``, ``cell``, ``value``.

    ``edges``: networks without diagonal; ``x``: counts (``gene``, ``cell``, ``value``) that all networks share. The
    first perturbation is the counts of all knocked-out genes together; each step multiplies by the network.
    After a step the genes reached by earlier steps leave the network on both ends; a network whose genes
    (``genes``, else those of ``x``) have all been reached takes no more steps. An unknown gene is an error. ``cells`` (cell) restricts the result.

    Steps are linear in the counts of the knocked-out genes: what spreads is a weight for each gene and knocked-out gene, and cells come in at the
    end. Cells with the same counts of the knocked-out genes (a profile) reach the same genes, so that profiles stand for cells there.
    """
    axis = materialize(gene_axis(x) if genes is None else genes.select("gene").distinct(), "axis")
    check_known(ko_genes, axis)
    n_genes, spark = axis.count(), x.sparkSession
    given = x.filter(F.col("gene").isin(*ko_genes) if ko_genes else F.lit(False)).filter("value <> 0")
    given = materialize(given.select(F.col("gene").alias("ko"), "cell", F.col("value").cast("double").alias("value")), "given")
    profiles = given.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("ko", "value"))).alias("own")).select("own").distinct()
    profiles = materialize(profiles.withColumn("profile", F.monotonically_increasing_id()).select("profile", F.inline("own")), "profiles")
    kos = spark.createDataFrame([(g,) for g in dict.fromkeys(ko_genes)], "ko string")
    p = materialize(kos.select(each_network(edges), F.col("ko").alias("gene"), "ko", F.lit(1.0).alias("w")), "step")
    total, live, visited = p, edges.select("net_id", "target", "source", "weight"), p.select("net_id", "gene").filter("false")
    for k in range(degree):
        before = p.select("net_id", F.col("gene").alias("source"), "ko", "w")
        step = live.join(before, ["net_id", "source"]).groupBy("net_id", F.col("target").alias("gene"), "ko").agg(F.sum(F.col("weight") * F.col("w")).alias("w"))
        p = materialize(step.filter("w <> 0"), "step")
        total = total.unionByName(p)
        if k == degree - 1:
            break
        for end in ("target", "source"):
            live = live.join(visited.withColumnRenamed("gene", end), ["net_id", end], "left_anti")
        new = _reached(p.join(visited, ["net_id", "gene"], "left_anti"), profiles)
        visited = materialize(visited.unionByName(new), "visited")
        closed = visited.groupBy("net_id").count().filter(F.col("count") >= n_genes).select("net_id")
        live = materialize(live.join(F.broadcast(closed), "net_id", "left_anti").select("net_id", "target", "source", "weight"), "live")
    weights = materialize(total.groupBy("net_id", "gene", "ko").agg(F.sum("w").alias("w")), "spread")
    if cells is not None:
        given = given.join(cells, "cell", "left_semi")
    return weights.join(given, "ko").groupBy("net_id", "gene", "cell").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def propagate_knockout(edges: DataFrame, x: DataFrame, ko_genes: list[str], degree: int, genes: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Counts of each network after ``knockout_perturbation``: max(x - perturbation, 0), zeros absent.

    Every network has counts of its own, so that the result is as large as ``x`` times the networks; ``cells``
    (cell) restricts it to the cells that are needed, while the knockout spreads over all.
    """
    taken = knockout_perturbation(edges, x, ko_genes, degree, genes, cells).withColumnRenamed("value", "p")
    if cells is not None:
        x = x.join(cells, "cell", "left_semi")
    before = x.select(each_network(edges), "gene", "cell", "value")
    left = before.join(taken, ["net_id", "gene", "cell"], "full")
    return left.select("net_id", "gene", "cell", F.greatest(F.coalesce("value", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)), F.lit(0.0)).alias("value")).filter("value > 0")
