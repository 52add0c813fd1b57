"""Low-rank denoising of a stack of networks.

The stack is the edge table itself: modes ``target``, ``source`` and ``net_id``. A rank-K model is three
factor tables of K numbers a row; alternating least squares solves one mode at a time. The product over all
edges (the costly step) joins the other two factor tables and aggregates with map-side sums. Factors are tables throughout; the
driver holds K x K numbers a mode, which come with the write of each factor table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import children, discard, materialize, numbered, remove

MODES = ("target", "source", "net_id")
#: Rows and columns of a tile of the model's mean.
TILE_ROWS, TILE_COLUMNS = 256, 4_096


def stack_networks(edges: DataFrame) -> DataFrame:
    """The stack as the model sees it: one row for each network with its ``edges``, ``targets`` and ``total`` weight."""
    return edges.groupBy("net_id").agg(F.count("*").alias("edges"), F.count_distinct("target").alias("targets"), F.sum("weight").alias("total"))


@dataclass
class CpModel:
    """``names[mode]``: its members (column ``member``) with their number ``at``; ``factors[mode]``: ``at`` (in a column named like the mode)
    and ``f``, K numbers; ``errors`` by sweep.
    """

    names: dict[str, DataFrame]
    factors: dict[str, DataFrame]
    errors: list[float]
    rank: int


def mttkrp(edges: DataFrame, mode: str, factors: dict[str, DataFrame], rank: int) -> DataFrame:
    """For each member of ``mode``: sums over its edges of weight x the other two factors, k by k (``k0``, ``k1``, ...).

    ``factors[m]`` has a column named like the mode m and ``f``, an array of ``rank`` numbers.
    """
    rows = edges
    for i, m in enumerate(x for x in MODES if x != mode):
        rows = rows.join(factors[m].select(m, F.col("f").alias(f"f{i}")), m)
    return rows.groupBy(mode).agg(*[F.expr(f"sum(weight * f0[{k}] * f1[{k}]) AS k{k}") for k in range(rank)])


def _start(names: DataFrame, mode: str, rank: int, seed: int, first: int) -> DataFrame:
    """Seeded uniform numbers, those of row ``at`` being the numbers first + rank x at, ... of the seed's stream, wherever the row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            values = np.empty((len(at), rank))
            for lo, hi in zip(cuts := [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist()], [*cuts[1:], len(at)]):
                if lo < hi:
                    values[lo:hi] = np.random.Generator(np.random.PCG64(seed).advance(first + rank * int(at[lo]))).random((hi - lo, rank))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * rank, pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [mode, "f"])

    return names.select("at").mapInArrow(run, f"`{mode}` bigint, f array<double>")


def _pairs(rank: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(rank) for j in range(i, rank)]


def _turned(turn: np.ndarray) -> str:
    """Column ``p`` times a small matrix, in SQL. The numbers are one array literal, so that the code made for it is the same in each sweep."""
    columns = ", ".join(f"array({', '.join(f'{float(v)!r}D' for v in column)})" for column in turn.T)
    return f"transform(array({columns}), c -> aggregate(zip_with(c, p, (x, y) -> x * y), 0D, (s, v) -> s + v)) AS f"


def _written(table: DataFrame, mode: str, rank: int, product: bool) -> tuple[DataFrame, np.ndarray, float]:
    """A factor table written, its Gram matrix, and the sum of its product with column ``p`` if there is one: one job."""
    seen = Observation()
    sums = [F.expr(f"sum(f[{i}] * f[{j}]) AS g{i}_{j}") for i, j in _pairs(rank)]
    inner = " + ".join(f"f[{k}] * p[{k}]" for k in range(rank)) if product else "0D"
    written = materialize(table.observe(seen, F.expr(f"sum({inner}) AS inner"), *sums).select(mode, "f"), f"factor_{mode}")
    found, gram = seen.get, np.zeros((rank, rank))
    for i, j in _pairs(rank):
        gram[i, j] = gram[j, i] = found[f"g{i}_{j}"] or 0.0
    return written, gram, found["inner"] or 0.0


def _save(folder: str, sweep: int, factors: dict[str, DataFrame], errors: list[float]) -> None:
    """The state after a sweep; the errors are written last, so that a state that has them is whole."""
    spark = factors["target"].sparkSession
    for m in MODES:
        factors[m].write.mode("overwrite").parquet(f"{folder}/{sweep}/{m}")
    spark.createDataFrame([(json.dumps(errors),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{sweep}/errors")
    for old in children(spark, folder):
        if old.isdigit() and int(old) < sweep:
            remove(spark, f"{folder}/{old}")


def _saved(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], list[float]] | None:
    for sweep in sorted((int(c) for c in children(spark, folder) if c.isdigit()), reverse=True):
        if "errors" in children(spark, f"{folder}/{sweep}") and "_SUCCESS" in children(spark, f"{folder}/{sweep}/errors"):
            (row,) = spark.read.text(f"{folder}/{sweep}/errors", wholetext=True).collect()
            return {m: spark.read.parquet(f"{folder}/{sweep}/{m}") for m in MODES}, json.loads(row[0])
    return None


def cp_als(edges: DataFrame, rank: int = 5, tol: float = 1e-6, max_iter: int = 1000, seed: int = 42, state: str | None = None, save_every: int = 10) -> CpModel:
    """Alternating least squares until the relative error changes by less than ``tol``: one job a mode and sweep.

    Members are numbered in the order of their names. With ``state``, a folder, factors and errors are saved there each ``save_every`` sweeps,
    and a run that finds a saved state goes on from it (``edges``, ``rank`` and ``seed`` must be the same).
    """
    spark = edges.sparkSession
    names = {m: materialize(numbered(edges.select(F.col(m).alias("member")).distinct(), "member", name="at"), f"names_{m}") for m in MODES}
    for m in MODES:
        edges = edges.join(names[m].select(F.col("member").alias(m), F.col("at").alias(f"{m}_at")), m)
    edges = materialize(edges.select(*[F.col(f"{m}_at").alias(m) for m in MODES], "weight"), "stack")  # read once a mode and sweep
    square = edges.agg(F.sum(F.col("weight") * F.col("weight"))).first()[0] or 0.0
    factors, grams, errors, first = {}, {}, [], 0
    saved = _saved(spark, state) if state else None
    for m in MODES:
        begin = saved[0][m] if saved else _start(names[m], m, rank, seed, first)
        factors[m], grams[m], _ = _written(begin, m, rank, False)
        first += names[m].count() * rank
    errors = list(saved[1]) if saved else []
    while len(errors) < max_iter and not (len(errors) > 1 and abs(errors[-2] - errors[-1]) < tol):
        for mode in MODES:
            a, b = (grams[m] for m in MODES if m != mode)
            turn = np.linalg.pinv(a * b)
            p = f"array({', '.join(f'k{k}' for k in range(rank))}) AS p"
            solved = mttkrp(edges, mode, factors, rank).selectExpr(mode, p).selectExpr(mode, "p", _turned(turn))
            old = factors[mode]
            factors[mode], grams[mode], inner = _written(solved, mode, rank, True)
            discard(old)
        model = float((a * b * grams[mode]).sum())
        errors.append(float(np.sqrt(max(square - 2 * inner + model, 0.0) / square)) if square else 0.0)
        if state and len(errors) % save_every == 0:
            _save(state, len(errors), factors, errors)
    return CpModel(names, factors, errors, rank)


def _tiles(model: CpModel) -> DataFrame:
    """Pairs of row and column blocks of the model's mean over the networks: ``rows``, ``a`` and ``columns``, ``b`` (lists of K numbers)."""
    rank = model.rank
    mean = model.factors["net_id"].agg(*[F.avg(F.col("f")[k]).alias(f"m{k}") for k in range(rank)]).first()  # K numbers

    def blocks(mode: str, size: int, scale: list[float], names: str, values: str, number: str) -> DataFrame:
        f = F.array(*[F.col("f")[k] * s for k, s in enumerate(scale)])
        rows = model.factors[mode].join(model.names[mode], F.col(mode) == F.col("at")).select("at", F.col("member"), f.alias("f"))
        packed = rows.groupBy(F.expr(f"at div {size}").alias(number)).agg(F.sort_array(F.collect_list(F.struct("at", "member", "f"))).alias("all"))
        return packed.select(number, F.col("all.member").alias(names), F.col("all.f").alias(values))

    a = blocks("target", TILE_ROWS, [1.0] * rank, "rows", "a", "i")
    b = materialize(blocks("source", TILE_COLUMNS, [float(m or 0.0) for m in mean], "columns", "b", "j"), "columns")
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(max(b.count() - 1, 0)).cast("bigint"))
    tiles = a.withColumn("j", F.explode(every)).join(b, "j")
    return materialize(tiles.repartition("i", "j").select("rows", "a", "columns", "b"), "tiles")


def _each_tile(batches: Iterator[pa.RecordBatch], rank: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            rows, a, columns, b = (c[k].values for c in batch.columns)
            matrix = lambda v: v.flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)
            yield rows, columns, matrix(a) @ matrix(b).T


def _entries(rows: pa.Array, columns: pa.Array, values: np.ndarray, net_id: int) -> Iterator[pa.RecordBatch]:
    """The non-zero values of a tile, as edges, some rows at a time."""
    for lo in range(0, len(values), 16):
        i, j = np.nonzero(values[lo : lo + 16])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), net_id, np.int32)), rows.take(pa.array(i + lo)), columns.take(pa.array(j)), pa.array(values[lo + i, j])], ["net_id", "target", "source", "weight"])


_EDGES = "net_id int, target string, source string, weight double"


def average_network(model: CpModel, net_id: int = 0) -> DataFrame:
    """Mean over the networks of the model's reconstruction, as edges of one network.

    Tiles of A diag(mean C) B' are made where they are used; the cube is never built.
    """
    rank = model.rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, columns, values in _each_tile(batches, rank):
            yield from _entries(rows, columns, values, net_id)

    return _tiles(model).mapInArrow(run, _EDGES)


def denoised_network(model: CpModel, decimals: int = 1, net_id: int = 0) -> DataFrame:
    """``average_network`` over its largest absolute entry, rounded half to even; zeros leave.

    The tiles are multiplied twice, first for their maxima and then for the entries that survive rounding, which are the only rows made.
    """
    tiles, rank, unit = _tiles(model), model.rank, 10.0**decimals

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = max((float(np.abs(values).max(initial=0.0)) for _, _, values in _each_tile(batches, rank)), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([top])], ["top"])

    top = tiles.mapInArrow(tops, "top double").agg(F.max("top")).first()[0] or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, columns, values in _each_tile(batches, rank):
            yield from _entries(rows, columns, np.rint(values / top * unit) / unit, net_id)

    return tiles.mapInArrow(run, _EDGES)
