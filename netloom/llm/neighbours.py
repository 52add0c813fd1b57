"""Approximate nearest neighbours by collision counting on single projections.

Query-aware hashing (C2LSH, Gan et al. 2012; QALSH, Huang et al. 2015). A block of vectors is indexed by
``PROJECTIONS`` sorted arrays, one for each random direction. A query
looks at the window of each array that is centred on its own projection; the window grows by virtual rehashing
(same arrays, larger radius: only the entries that it takes in are counted anew) until enough vectors have collided with the
query in at least ``THRESHOLD`` of the arrays. Those are verified by exact inner products. Where the last radius brings in more than asked for, the
threshold rises, so that the verified share of a block is bounded by ``VERIFY`` and ``VERIFY_PER_K`` at every size.

Largest inner product becomes smallest distance by one more component that gives all vectors of a block the same
length. Blocks hold vectors of like length (bands of half an octave), so that this component stays small.

A task indexes one block once and streams queries through it; of every query only the block's best ``k`` go on and
are merged. Work is queries x vectors by the nature of the task (the query set is a share of the table); what is
shuffled for it is divided by ``BLOCK`` and ``QUERY_PART``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import bounded_batches, table

PROJECTIONS, SEED = 130, 11
#: Vectors of an index block, queries that one task streams through it.
BLOCK, QUERY_PART = 32_768, 32_768
#: Share of the arrays in which a candidate must collide; candidates to verify: a share of the block, and so many for each of the k.
THRESHOLD, VERIFY, VERIFY_PER_K = 0.8, 0.05, 4
#: First half-width of a window and growth of the radius, in standard deviations of the block's projections.
RADIUS, GROWTH = 0.8, 1.12


def valid_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id`` and ``v``: one row for each distinct vector of an id; components stay floats if they are, else doubles.

    Null, zero, empty and non-finite vectors, and rows without an id, take no part.
    """
    kind = df.schema[vector_column].dataType.simpleString()
    vector = df[vector_column].cast(kind if kind == "array<float>" else "array<double>")
    rows = df.select(df[id_column].alias("vec_id"), vector.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine).distinct()


def _banded(rows: DataFrame) -> DataFrame:
    """``band``: half octaves of the vector's length, scaled first so that squares neither overflow nor vanish."""
    top = F.array_max(F.transform("v", lambda x: F.abs(x).cast("double")))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top")))
    return rows.withColumn("top", top).withColumn("band", F.floor(2 * F.log2("top") + F.log2(squares) + 0.3).cast("int")).drop("top")


class BlockIndex:
    """Sorted arrays of one block: for each direction the projections in order, and the rows that they belong to."""

    def __init__(self, vectors: np.ndarray):
        n, dims = vectors.shape
        rng = np.random.default_rng(SEED)
        turns = [np.linalg.qr(rng.standard_normal((dims + 1, dims + 1)))[0] for _ in range(-(-PROJECTIONS // (dims + 1)))]
        self.directions = np.concatenate(turns, axis=1)[:, :PROJECTIONS]
        unit = vectors / np.abs(vectors).max()
        squares = (unit**2).sum(axis=1)
        self.length = np.sqrt(squares.max())
        lift = np.sqrt(np.maximum(squares.max() - squares, 0))
        projected = (np.column_stack([unit, lift]) @ self.directions).T
        order = np.argsort(projected, axis=1, kind="stable")
        self.rows = order.astype(np.uint16 if n <= 1 << 16 else np.int64)
        self.widths = np.maximum(projected.std(axis=1), 0.01 * self.length)
        # the arrays end to end, each moved past the one before, so that one binary search finds places in all of them
        self.shift = 4 * self.length * np.arange(PROJECTIONS)
        self.sorted = (np.take_along_axis(projected, order, axis=1) + self.shift[:, None]).ravel()
        self.begins = np.arange(PROJECTIONS) * n
        self.n = n
        self.touched = 0  # entries of windows looked at so far

    def _ends(self, centre: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of ``centre`` begin and end in each array."""
        middle, reach = centre + self.shift, self.widths * radius
        lo, hi = (np.searchsorted(self.sorted, at, side) - self.begins for at, side in ((middle - reach, "left"), (middle + reach, "right")))
        return lo.clip(0, self.n), hi.clip(0, self.n)

    def _counted(self, pieces: list[np.ndarray]) -> np.ndarray:
        """In how many of the pieces each row stands."""
        rows = np.concatenate(pieces, dtype=np.intp, casting="safe")
        self.touched += len(rows)
        return np.bincount(rows, minlength=self.n)

    def _collisions(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """In how many windows each row stands, counted by what is outside of those that hold more than half."""
        wide = hi - lo > self.n // 2
        ends = zip(self.rows, lo.tolist(), hi.tolist(), wide.tolist())
        inside, outside = [], []
        for rows, a, b, w in ends:
            if w:
                outside += (rows[:a], rows[b:])
            else:
                inside.append(rows[a:b])
        count = np.full(self.n, wide.sum())
        if inside:
            count += self._counted(inside)
        if outside:
            count -= self._counted(outside)
        return count

    def search(self, queries: np.ndarray, wanted: int, radius: float = RADIUS) -> tuple[list[np.ndarray], float]:
        """Rows that collide with each query often enough, at least ``wanted``; and the radius to go on with.

        The first windows are counted by their entries or by the rest, whichever are fewer; a larger radius adds the entries by which
        windows grow on either side.
        """
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit *= self.length / np.sqrt((unit**2).sum(axis=1, keepdims=True))  # a query's length doesn't change its order
        centres = np.column_stack([unit, np.zeros(len(unit))]) @ self.directions
        wanted = min(wanted, self.n)
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        found = []
        for centre in centres:
            lo, hi = self._ends(centre, radius)
            count = self._collisions(lo, hi)
            while True:
                often = np.bincount(count, minlength=need + 1)[::-1].cumsum()[::-1]  # vectors that collide so often or more
                if often[need] >= wanted:
                    break
                radius *= GROWTH
                further, beyond = self._ends(centre, radius)
                ends = zip(self.rows, further.tolist(), lo.tolist(), hi.tolist(), beyond.tolist())
                count += self._counted([piece for rows, a, b, c, d in ends for piece in (rows[a:b], rows[c:d])])
                lo, hi = further, beyond
            found.append(np.flatnonzero(count >= np.flatnonzero(often >= wanted)[-1]))
            if often[need] > 2 * wanted:  # the next query starts a step lower
                radius = max(RADIUS, radius / GROWTH)
        return found, radius


def candidates_wanted(n: int, k: int) -> int:
    """Vectors of a block of ``n`` to verify for each query."""
    return min(n, VERIFY_PER_K * k + int(np.ceil(VERIFY * n)))


def _best(q_id: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` ids of largest inner product, each once with its best."""
    keep = ids != q_id
    ids, score = ids[keep], (vectors[keep] * query).sum(axis=1)  # equal vectors score equally, unlike in a matrix product
    order = np.lexsort((ids, -score))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], score[order]


def _searched(k: int, dims: int):
    """Over rows in order of (block, part, kind): a block's vectors are gathered and indexed once, its queries then streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, radius, parts = None, None, RADIUS, []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("block", "part", "kind")])
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                rows, (block, part, kind) = batch.slice(lo, hi - lo), keys[lo].tolist()
                ids, values = rows.column("vec_id").to_numpy(), rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                if kind == 0:
                    if at != (block, part):
                        at, index, parts = (block, part), None, []
                    parts.append((ids, values))
                    continue
                if index is None:
                    all_ids, all_values = (np.concatenate(c) for c in zip(*parts))
                    index, radius, parts = BlockIndex(all_values.astype(float)), RADIUS, []
                queries = values.astype(float)
                found, radius = index.search(queries, candidates_wanted(index.n, k), radius)
                best = [_best(i, q, all_ids[near], all_values[near].astype(float), k) for i, q, near in zip(ids, queries, found)]
                columns = [np.repeat(ids, [len(b[0]) for b in best]), np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK, query_part: int = QUERY_PART) -> DataFrame:
    """The ``k`` candidates of largest inner product found for each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    A candidate is any row of ``vectors`` with another id than the query's; ``score`` is its exact inner
    product in double precision; ties go to the smaller id. Vectors that are null, zero, empty or hold
    null or non-finite components take no part, nor do those of another length than the most frequent one.
    Repeated rows count once; an id with several vectors counts once, with its best. Fewer candidates than
    ``k``: all of them. Empty tables give an empty result. Ids are whole numbers.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    everything = materialize(_banded(valid_vectors(vectors, id_column, vector_column)), "vectors")
    asked = materialize(valid_vectors(queries, id_column, vector_column), "queries")
    lengths = everything.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = lengths["d"] if lengths else 1
    everything, asked = (x.filter(F.size("v") == dims) for x in (everything, asked))
    # bands (a few, thousands at most) get as many blocks as their vectors fill; blocks are numbered through all bands
    bands = sorted((r["band"], -(-r["count"] // block)) for r in everything.groupBy("band").count().collect())
    firsts = np.cumsum([0, *(n for _, n in bands)]).tolist()
    of_band = spark.createDataFrame([(b, n, first) for (b, n), first in zip(bands, firsts)], "band int, n long, first long")
    n_parts = max(1, -(-asked.count() // query_part))
    dealt = everything.join(F.broadcast(of_band), "band").withColumn("block", F.col("first") + F.pmod(F.xxhash64(F.lit("data"), "vec_id"), "n"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))
    data = dealt.select("block", parts.alias("part"), F.lit(0).alias("kind"), F.col("vec_id").cast("bigint").alias("vec_id"), "v")
    asks = asked.withColumn("part", F.pmod(F.xxhash64(F.lit("query"), "vec_id"), F.lit(n_parts)).cast("int"))
    every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(firsts[-1] - 1, 0)).cast("bigint")))
    asks = asks.select(every_block.alias("block"), "part", F.lit(1).alias("kind"), F.col("vec_id").cast("bigint").alias("vec_id"), "v")
    # one task each for a part of the queries and a block
    tasks = max(1, min(firsts[-1] * n_parts, 100_000))
    rows = data.unionByName(asks).repartitionById(tasks, F.pmod(F.col("block") * n_parts + F.col("part"), F.lit(tasks)).cast("int"))
    found = rows.sortWithinPartitions("block", "part", "kind").mapInArrow(_searched(k, dims), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of every row whose id is divisible by 20, among all other rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
