"""Alignment of two networks on a common low-dimensional manifold.

The joint Laplacian of two networks on n genes is a diagonal, the networks' edges, a part of rank one (every entry counts
one more than its weight) and a coupling of each gene's two sides. It is only ever multiplied with blocks of vectors: the edges on the
executors, the rest, a few numbers a gene, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.eigen import block_davidson
from ..storage import materialize, numbered
from .edges import align_networks
from .wide_manifold import corrected, wide_eigenvectors, wide_table

#: Genes up to which all eigenvectors are found on a dense matrix of twice as many rows, and up to which the driver holds a basis.
DENSE_GENES, DRIVER_GENES = 1_000, 10_000
#: Vectors multiplied at once at least; random ones to start with; residual of an eigenvector; multiplications at most.
LEAST_BLOCK, RANDOM, RESIDUAL, ROUNDS = 24, 8, 1e-8, 1_000


def _weight_sums(x: DataFrame, y: DataFrame, genes: DataFrame) -> tuple[DataFrame, int, float]:
    """``side``, ``gene`` and the sum ``s`` of its column's weights without the diagonal; the number of genes; the cross weight."""
    n = genes.count()
    sums = lambda e: e.agg(F.coalesce(F.sum("weight"), F.lit(0.0)) + float(n) * n)
    c = 0.9 * (sums(x).first()[0] + sums(y).first()[0]) / (2 * n) if n else 0.0

    def side(e: DataFrame, name: str) -> DataFrame:
        columns = e.filter("target <> source").groupBy(F.col("source").alias("gene")).agg(F.sum("weight").alias("s"))
        return genes.join(columns.hint("merge"), "gene", "left").select(F.lit(name).alias("side"), "gene", F.coalesce("s", F.lit(0.0)).alias("s"))

    return side(x, "X").unionByName(side(y, "Y")), n, c


def laplacian_degrees(x: DataFrame, y: DataFrame, genes: DataFrame) -> DataFrame:
    """``side``, ``gene``, ``degree`` and the cross weight ``c`` of the joint Laplacian of two networks on ``genes`` (gene).

    Every entry of both networks counts one more than its weight, absent ones too; that part is a number of
    genes and never a table. c = 0.9 (sum of X + sum of Y) / 2n, diagonals included; a degree is the column
    sum without the diagonal, plus c. Genes without an edge into them have the smallest degree.
    """
    rows, n, c = _weight_sums(x, y, genes)
    return rows.select("side", "gene", (F.col("s") + (n - 1) + c).alias("degree"), F.lit(c).alias("c"))


class JointLaplacian:
    """The joint Laplacian of networks ``x`` and ``y`` on ``shared`` (gene): rows of X first, then those of Y.

    ``edges`` (at, source, weight) are the edges without diagonal, rows and columns numbered through both sides, dealt by row and
    in order, so that a task sums whole rows.
    """

    def __init__(self, x: DataFrame, y: DataFrame, shared: DataFrame):
        self.genes = materialize(numbered(shared.select("gene"), "gene", name="at"), "axis")
        self.n = n = self.genes.count()
        ends = [self.genes.select(F.col("gene").alias(c), F.col("at").alias(f"{c}_at")) for c in ("target", "source")]
        numbered_side = lambda e, first: e.filter("target <> source").join(ends[0].hint("merge"), "target").join(ends[1].hint("merge"), "source").select((F.col("target_at") + first).alias("at"), (F.col("source_at") + first).alias("source"), "weight")
        both = numbered_side(x, 0).unionByName(numbered_side(y, n)).groupBy("at", "source").agg(F.sum("weight").alias("weight"))
        self.edges = materialize(both.repartitionByRange("at").sortWithinPartitions("at", "source"), "edges")
        sums, _, self.c = _weight_sums(x, y, shared)
        self.weights = materialize(sums.join(self.genes.hint("merge"), "gene").select("side", "at", "s"), "weights")

    @cached_property
    def diagonal(self) -> np.ndarray:
        rows = self.weights.select((F.col("at") + F.when(F.col("side") == "Y", self.n).otherwise(0)).alias("at"), "s").toArrow()
        diagonal = np.empty(2 * self.n)
        diagonal[rows["at"].to_numpy()] = rows["s"].to_numpy() + (self.n - 1) + self.c
        return diagonal

    def symmetric(self) -> bool:
        back = self.edges.select(F.col("source").alias("at"), F.col("at").alias("source"), F.col("weight").alias("back"))
        apart = F.max(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("back", F.lit(0.0))))
        row = self.edges.join(back, ["at", "source"], "full").agg(apart.alias("apart"), F.max(F.abs("weight")).alias("top")).first()
        return (row["apart"] or 0.0) <= 1e-12 * (row["top"] or 0.0)

    def apply(self, block: np.ndarray) -> np.ndarray:
        """The Laplacian times a block of columns: one pass over the edges, without a shuffle."""
        shared = self.edges.sparkSession.sparkContext.broadcast(block)
        k = block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                at, source, weight = (c.to_numpy() for c in batch.columns)
                if not len(at):
                    continue
                first = np.flatnonzero(np.diff(at, prepend=-1))
                sums = np.add.reduceat(weight[:, None] * block[source], first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * k), len(first), [None, pa.py_buffer(sums.tobytes())]).cast(pa.binary())], ["at", "sums"])

        found = self.edges.mapInArrow(run, "at bigint, sums binary").toArrow().combine_chunks()
        product = np.zeros_like(block)
        if found.num_rows:
            np.add.at(product, found["at"].to_numpy(), np.frombuffer(b"".join(found["sums"].to_pylist())).reshape(-1, k))
        shared.destroy()
        return self.around(block) - product

    def around(self, block: np.ndarray) -> np.ndarray:
        """All but the edges times a block: diagonal, the ones off it, the coupling."""
        a, b = block[: self.n], block[self.n :]
        ones = np.concatenate([a.sum(axis=0) - a, b.sum(axis=0) - b])
        return self.diagonal[:, None] * block - ones - self.c * np.concatenate([b, a])

    def dense(self) -> np.ndarray:
        rows = self.edges.toArrow()
        out = self.around(np.eye(2 * self.n))
        out[rows["at"].to_numpy(), rows["source"].to_numpy()] -= rows["weight"].to_numpy()
        return out

    def correction(self, residual: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Residuals over the Laplacian less the values, as far as its diagonal and its coupling tell (2 x 2 a gene).

        The lesser eigenvalue of the 2 x 2 tells genes apart and is kept off 0; the greater one is the coupling's, alike for all.
        """
        p, q = self.diagonal[: self.n, None] - values + 1, self.diagonal[self.n :, None] - values + 1
        return corrected(p, q, self.c, residual, np.finfo(float).eps * max(np.abs(self.diagonal).max(), 1e-200))


def _wanted(values: np.ndarray, d: int, tol: float) -> list[int]:
    """Of the 2 d smallest by real part the first d that reach ``tol``."""
    order = np.argsort(values.real, kind="stable")[: 2 * d]
    return [i for i in order if values[i].real >= tol][:d]


def smallest_eigenvectors(lap: JointLaplacian, d: int, tol: float = 1e-8, residual: float = RESIDUAL, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Values and unit vectors (columns) of the ``d`` eigenvalues of smallest real part that reach ``tol``, by block Davidson steps.

    It starts with the genes of smallest degree, each for itself, as such vectors are nearly theirs alone, and RANDOM random ones. Residuals
    are corrected by the diagonal and the coupling. What doesn't reach ``residual`` in ``rounds`` multiplications raises.
    """
    n, block = lap.n, max(2 * d, LEAST_BLOCK)
    small = np.argsort(lap.diagonal[:n] + lap.diagonal[n:], kind="stable")[:block]
    lone = np.zeros((2 * n, len(small)))
    lone[small, np.arange(len(small))] = lone[n + small, np.arange(len(small))] = 1
    drawn = lap.correction(np.random.default_rng(7).standard_normal((2 * n, RANDOM)), np.full(RANDOM, float(n)))
    start = np.column_stack([lone, drawn / np.linalg.norm(drawn, axis=0)])
    sides = np.repeat([[1.0, 1.0], [1.0, -1.0]], n, axis=1).T

    def wanted(values: np.ndarray) -> tuple[np.ndarray, int]:
        return np.argsort(values.real, kind="stable"), min(int((values.real < tol).sum()) + d, 2 * d, len(values))

    least = max(residual, 64 * np.finfo(float).eps * np.abs(lap.diagonal).max())
    values, vectors = block_davidson(lap.apply, np.linalg.qr(np.column_stack([sides, start]))[0], wanted, lap.symmetric(), block, 2 * d + LEAST_BLOCK, least, rounds, lap.correction)
    own = _wanted(values, d, tol)
    return values[own], vectors[:, own]


def manifold_table(lap: JointLaplacian, vectors: np.ndarray) -> DataFrame:
    """``side``, ``gene``, ``coords``, ``coords_im``: the rows of the eigenvectors."""
    spark, width = lap.genes.sparkSession, vectors.shape[1]
    lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(v).ravel()))
    imaginary = vectors.imag if np.iscomplexobj(vectors) else np.zeros_like(vectors)
    rows = spark.createDataFrame(pa.table({"row": np.arange(2 * lap.n), "coords": lists(vectors.real), "coords_im": lists(imaginary)}))
    rows = rows.withColumn("side", F.when(F.col("row") < lap.n, "X").otherwise("Y")).withColumn("at", F.col("row") % max(lap.n, 1))
    return rows.join(lap.genes, "at").select("side", "gene", "coords", "coords_im")


def manifold_alignment(x: DataFrame, y: DataFrame, d: int = 30, tol: float = 1e-8, x_genes: DataFrame | None = None, y_genes: DataFrame | None = None, dense_genes: int = DENSE_GENES, driver_genes: int = DRIVER_GENES) -> DataFrame:
    """``side``, ``gene``, ``coords`` (and ``coords_im``): the eigenvectors of the d smallest eigenvalues of the
    joint Laplacian that reach ``tol``, by real part. Every gene that both axes share has a row on each side.

    ``x_genes`` and ``y_genes`` are the gene axes (see ``align_networks``). Up to ``dense_genes`` shared genes the Laplacian is
    decomposed whole on the driver; beyond, and where a basis fits, only blocks of a few times d vectors are held there; beyond ``driver_genes``
    these are tables too. All three find the same vectors.
    """
    lap = JointLaplacian(*align_networks(x, y, x_genes, y_genes))
    if not lap.n:
        return x.sparkSession.createDataFrame([], "side string, gene string, coords array<double>, coords_im array<double>")
    if lap.n > dense_genes and lap.n > 8 * d + 4 * LEAST_BLOCK:
        if lap.n > driver_genes:
            state, _, turn = wide_eigenvectors(lap, d, tol, RESIDUAL, ROUNDS)
            return wide_table(lap, state, turn)
        return manifold_table(lap, smallest_eigenvectors(lap, d, tol)[1])
    whole = lap.dense()
    values, vectors = np.linalg.eigh(whole) if np.allclose(whole, whole.T) else np.linalg.eig(whole)
    return manifold_table(lap, vectors[:, _wanted(values, d, tol)])
