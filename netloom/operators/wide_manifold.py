"""Alignment of networks of many genes: no vector of all genes is held on one machine.

Vectors are written tables of chunks of genes, both sides of a gene in one chunk. The driver holds sums of products of columns, a few
hundred numbers square at most. All values here are those of the joint Laplacian less the number of genes: the wanted ones are small then, and so
are their rounding errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.eigen import span
from ..storage import discard, materialize

if TYPE_CHECKING:
    from .manifold import JointLaplacian

#: Genes of a chunk; chunks whose vectors one task multiplies with their edges; edges multiplied at once.
CHUNK, GROUP, PIECE = 4_096, 16, 250_000
#: Vectors multiplied at once at least, random ones to start with.
LEAST_BLOCK, RANDOM = 8, 8
STATE = "chunk int, diagonal binary, basis binary, product binary, inner binary, gram binary"
ROWS = "at int, kind int, place long, a binary, b binary, c binary"
#: Makes, of a chunk (number, diagonals by side, basis, product), some numbers that are summed over the chunks, and columns.
Maker = Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def two_by_two(p: np.ndarray, q: np.ndarray, c: float, rounding: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of each gene's (p, -c; -c, q): the one of greater size, kept off 0, and the other."""
    middle, half = (p + q) / 2, np.sqrt(((p - q) / 2) ** 2 + c**2)
    large = np.where(np.abs(middle + half) >= np.abs(middle - half), middle + half, middle - half)
    large = np.where(np.abs(large) < rounding, rounding, large)
    return large, (p * q - c**2) / large


def corrected(p: np.ndarray, q: np.ndarray, c: float, residual: np.ndarray, rounding: float, least: float | None = None) -> np.ndarray:
    """Residuals over each gene's 2 x 2; the lesser eigenvalue is kept from 0 by ``least`` (else: a share of its mean)."""
    large, small = two_by_two(p, q, c, rounding)
    least = np.maximum(1e-3 * np.abs(small).mean(axis=0), rounding) if least is None else least
    det = large * np.where(np.abs(small) < least, least, small)
    a, b = residual[: len(p)], residual[len(p) :]
    return np.concatenate([(q * a + c * b) / det, (p * b + c * a) / det])


def _columns(packed: pa.Buffer, rows: int) -> np.ndarray:
    return np.frombuffer(packed).reshape(rows, -1) if packed.size else np.empty((rows, 0))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row; packed numbers are not copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for name, v in ((n, c[i]) for n, c in zip(batch.schema.names, batch.columns))}


def _batch(schema: str, *columns) -> pa.RecordBatch:
    """One row."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes() if isinstance(c, np.ndarray) else c], kinds[t]) for c, t in zip(columns, types)], list(names))


def _totals(table: DataFrame, schema: str, each: Callable[[dict], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all rows of what ``each`` makes of one, as flat arrays: a task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for row in _rows(batches):
            found = [np.ravel(v) for v in each(row)]
            total = found if total is None else [a + b for a, b in zip(total, found)]
        if total is not None:
            yield _batch(schema, *total)

    rows = table.mapInArrow(run, schema).collect()
    return [sum(np.frombuffer(r[at]) for r in rows) for at in range(len(rows[0]))]


class WideLaplacian:
    """A joint Laplacian whose vectors are tables (chunk, ...): start, growth and product of a basis."""

    def __init__(self, lap: JointLaplacian):
        self.lap, self.n, self.c, n = lap, lap.n, lap.c, lap.n
        self.chunks = -(-n // CHUNK)
        top = lap.weights.agg(F.max(F.abs("s"))).first()[0] or 0.0
        self.rounding = np.finfo(float).eps * (n + self.c + top)
        self.edges = self._packed()

    def _packed(self) -> DataFrame:
        """The edges by the group of their source (``at``): rows of targets in order, sources within the group, weights."""
        n, width, count = self.n, CHUNK * GROUP, self.lap.edges.count()
        rows = self.lap.edges.select((F.expr(f"source % {n}") / width).cast("int").alias("grp"), F.expr(f"int(at div {n})").alias("side"), F.expr(f"at % {n}").alias("target"), F.expr(f"int((source % {n}) % {width})").alias("source"), "weight")
        rows = rows.repartitionByRange(max(1, -(-count // (4 * PIECE))), "grp", "side", "target").sortWithinPartitions("grp", "side", "target", "source")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def packed() -> Iterator[pa.RecordBatch]:
                grp, side, target, source, weight = (np.concatenate(c) for c in zip(*held))
                key = grp.astype(np.int64) * 2 + side
                for own in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                    own = slice(own[0], own[-1] + 1)
                    yield _batch(ROWS, int(grp[own][0]), 1, int(key[own][0] << 40 | target[own][0]), target[own], source[own].astype(np.int32), weight[own])

            for batch in batches:
                if batch.num_rows:
                    held.append([c.to_numpy() for c in batch.columns])
                    size += batch.num_rows
                if size >= PIECE:
                    yield from packed()
                    held, size = [], 0
            if size:
                yield from packed()

        return materialize(rows.mapInArrow(pack, ROWS), "packed")

    def empty(self) -> DataFrame:
        """A basis without a column."""

        def run(table: pa.Table) -> pa.Table:
            order = np.lexsort([table["at"].to_numpy(), table["side"].to_numpy()])
            return pa.Table.from_batches([_batch(STATE, table["chunk"][0].as_py(), table["s"].to_numpy()[order], *[b""] * 4)])

        rows = self.lap.weights.select((F.col("at") / CHUNK).cast("int").alias("chunk"), F.expr("int(side = 'Y')").alias("side"), "at", "s")
        return materialize(rows.groupBy("chunk").applyInArrow(run, STATE), "state")

    def sums(self, state: DataFrame, make: Maker) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``make`` gives to be summed; products of the basis with its columns; products of these among themselves."""

        def each(row: dict) -> list[np.ndarray]:
            diagonal, basis, product = _chunk(row)
            numbers, columns = make(row["chunk"], diagonal, basis, product)
            return [numbers, basis.T @ columns, columns.T @ columns]

        numbers, inner, gram = _totals(state.select("chunk", "diagonal", "basis", "product"), "numbers binary, inner binary, gram binary", each)
        k = round(len(gram) ** 0.5)
        return numbers, inner.reshape(-1, k), gram.reshape(k, k)

    def grow(self, state: DataFrame, make: Maker, new: np.ndarray, less: np.ndarray, keep: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """The basis times ``keep``, with the columns of ``make`` times ``new`` less the basis times ``less`` beside it, and the products of all.

        Also the sums of products of the basis with its product and with itself.
        """
        n_new = new.shape[1]

        def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                diagonal, basis, product = _chunk(row)
                block = make(row["chunk"], diagonal, basis, product)[1] @ new - basis @ less
                yield _batch("chunk int, block binary, sides binary", row["chunk"], block, block.reshape(2, -1, n_new).sum(axis=1))

        made = materialize(state.select("chunk", "diagonal", "basis", "product").mapInArrow(columns, "chunk int, block binary, sides binary"), "block")
        (sides,) = _totals(made.select("sides"), "sides binary", lambda row: [np.frombuffer(row["sides"])])
        none = [F.lit(None).cast("binary").alias(c) for c in "bc"]
        to_edges = made.select((F.col("chunk") / GROUP).cast("int").alias("at"), F.lit(0).alias("kind"), F.col("chunk").cast("long").alias("place"), F.col("block").alias("a"), *none)
        partial = _by(to_edges.unionByName(self.edges), -(-self.chunks // GROUP)).mapInArrow(_multiplied(n_new), ROWS)
        own = state.select(F.col("chunk").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), F.col("diagonal").alias("a"), F.col("basis").alias("b"), F.col("product").alias("c"))
        block = made.select(F.col("chunk").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("place"), F.col("block").alias("a"), *none)
        rows = _by(own.unionByName(block).unionByName(partial), self.chunks)
        grown = materialize(rows.mapInArrow(_extended(n_new, sides.reshape(2, 1, n_new), self.c, keep), STATE), "state")
        inner, gram = _totals(grown.select("inner", "gram"), "inner binary, gram binary", lambda row: [np.frombuffer(row[c]) for c in ("inner", "gram")])
        discard(made)
        discard(state)
        k = round(len(gram) ** 0.5)
        return grown, inner.reshape(k, k), gram.reshape(k, k)


def _chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    diagonal = np.frombuffer(row["diagonal"])
    return diagonal.reshape(2, -1), _columns(row["basis"], len(diagonal)), _columns(row["product"], len(diagonal))


def _by(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(min(parts, 10_000), "at").sortWithinPartitions("at", "kind", "place")


def _multiplied(k: int):
    """Over rows of a group, its vectors (kind 0) before its edges (kind 1): sums by target, as rows of the chunks of the targets (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, np.empty(0)
        for row in _rows(batches):
            if row["at"] != at:
                at, block = row["at"], np.zeros((2, GROUP * CHUNK, k))
            if row["kind"] == 0:
                first = (row["place"] - at * GROUP) * CHUNK
                own = np.frombuffer(row["a"]).reshape(2, -1, k)
                block[:, first : first + own.shape[1]] = own
                continue
            side, target = row["place"] >> 40 & 1, np.frombuffer(row["a"], np.int64)
            first = np.flatnonzero(np.diff(target, prepend=-1))
            sums = np.add.reduceat(np.frombuffer(row["c"])[:, None] * block[side][np.frombuffer(row["b"], np.int32)], first, axis=0)
            chunk, place = np.divmod(target[first], CHUNK)
            cuts = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(chunk)]):
                yield _batch(ROWS, int(chunk[lo]), 2, row["place"], place[lo:hi].astype(np.int32), sums[lo:hi], b"")

    return run


def _extended(k: int, sides: np.ndarray, c: float, keep: np.ndarray):
    """Over rows of a chunk, its state (kind 0), new columns (kind 1) and their sums over edges (kind 2): the state with these columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, diagonal, basis, product, block, sums = None, *[np.empty(0)] * 5

        def extended() -> pa.RecordBatch:
            cross = c * (block[0] - block[1])
            image = diagonal[:, :, None] * block + np.stack([cross, -cross]) - sides - sums
            left, right = (np.column_stack([old @ keep, fresh.reshape(-1, k)]) for old, fresh in ((basis, block), (product, image)))
            return _batch(STATE, at, diagonal, left, right, left.T @ right, left.T @ left)

        for row in _rows(batches):
            if row["kind"] == 0:
                if at is not None:
                    yield extended()
                at, (diagonal, basis, product) = row["at"], _chunk({"diagonal": row["a"], "basis": row["b"], "product": row["c"]})
            elif row["kind"] == 1:
                block = np.frombuffer(row["a"]).reshape(2, -1, k)
                sums = np.zeros_like(block)
            else:
                sums[row["place"] >> 40 & 1, np.frombuffer(row["a"], np.int32)] += np.frombuffer(row["b"]).reshape(-1, k)
        if at is not None:
            yield extended()

    return run


def _starting(small: list[int], n: int, c: float, rounding: float, least: float) -> Maker:
    """The two sides, genes of smallest degree each for itself, and RANDOM random columns."""

    def make(chunk: int, diagonal: np.ndarray, basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = diagonal.shape[1]
        sides = np.repeat([[1.0, 1.0], [1.0, -1.0]], size, axis=1).T / np.sqrt(2 * n)
        lone = np.zeros((2, size, len(small)))
        for column, gene in enumerate(small):
            if gene // CHUNK == chunk:
                lone[:, gene % CHUNK, column] = np.sqrt(0.5)
        drawn = np.random.default_rng([7, chunk]).standard_normal((2 * size, RANDOM))
        return np.zeros(0), np.column_stack([sides, lone.reshape(2 * size, -1), _solved(diagonal, c, rounding, least, drawn, np.zeros(RANDOM))])

    return make


def _solved(diagonal: np.ndarray, c: float, rounding: float, least: float, residual: np.ndarray, values: np.ndarray) -> np.ndarray:
    p, q = (side[:, None] + c - values for side in diagonal)
    return corrected(p, q, c, residual, rounding, least)


def _residuals(turn: np.ndarray, values: np.ndarray, solve: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None) -> Maker:
    """Squares of the residuals of ``turn``'s vectors, and these corrected; complex ones by real and imaginary parts."""

    def make(chunk: int, diagonal: np.ndarray, basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = product @ turn - (basis @ turn) * values
        columns = solve(diagonal, rest, values) if solve else rest
        return (np.abs(rest) ** 2).sum(axis=0), np.column_stack([columns.real, columns.imag]) if np.iscomplexobj(columns) else columns

    return make


def _ritz(inner: np.ndarray, gram: np.ndarray, symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values, rising by real part, and unit vectors in a basis that is orthonormal but for rounding."""
    root = np.linalg.cholesky(gram)
    small = np.linalg.solve(root, np.linalg.solve(root, inner.T).T)
    values, turn = np.linalg.eigh((small + small.T) / 2) if symmetric else np.linalg.eig(small)
    order = np.argsort(values.real, kind="stable")
    return values[order], np.linalg.solve(root.T, turn[:, order])


def _apart(inner: np.ndarray, products: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns of columns (``products`` with each other, ``inner`` with the basis) and of the basis that make what is new in the columns orthonormal."""
    size = 1 / np.sqrt(np.maximum(np.diag(products), 1e-300))
    share = np.linalg.solve(gram, inner * size) if len(gram) else inner * size
    values, turn = np.linalg.eigh(products * np.outer(size, size) - (inner * size).T @ share)
    turn = turn[:, values > 1e-12] / np.sqrt(values[values > 1e-12])
    return size[:, None] * turn, share @ turn


def wide_eigenvectors(lap: JointLaplacian, d: int, tol: float, residual: float, rounds: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The last basis (chunk, basis), the ``d`` wanted values (of the Laplacian itself) and their turns of the basis, by block Davidson steps.

    As ``smallest_eigenvectors``, with the same start, order and corrections; the floor of a correction is that of value n throughout.
    """
    wide, n, c = WideLaplacian(lap), lap.n, lap.c
    rounding, block, symmetric = wide.rounding, max(2 * d, LEAST_BLOCK), lap.symmetric()
    keep, goal = 2 * d + LEAST_BLOCK, max(residual, 64 * rounding)
    small = [r[0] for r in lap.weights.groupBy("at").agg(F.sum("s").alias("s")).orderBy("s", "at").limit(block).collect()]
    state = wide.empty()

    def scale(chunk: int, diagonal: np.ndarray, basis: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.abs(two_by_two(diagonal[0] + c, diagonal[1] + c, c, rounding)[1]).sum(keepdims=True), np.zeros((diagonal.size, 1))

    least = max(1e-3 * float(wide.sums(state, scale)[0][0]) / n, rounding)
    make = _starting(small, n, c, rounding, least)
    solve = lambda diagonal, rest, values: _solved(diagonal, c, rounding, least, rest, values)
    _, _, products = wide.sums(state, make)
    new, _ = _apart(np.empty((0, len(products))), products, np.empty((0, 0)))
    state, inner, gram = wide.grow(state, make, new, np.empty((0, new.shape[1])), np.empty((0, 0)))
    for _ in range(rounds):
        values, turn = _ritz(inner, gram, symmetric)
        m = min(int((values.real + n < tol).sum()) + d, 2 * d, len(values))
        look = min(m + block // 2, len(values))
        # where correcting adds nothing to the basis, the residuals themselves do
        for way in (solve, None):
            make = _residuals(turn[:, :look], values[:look], way)
            squares, with_basis, products = wide.sums(state, make)
            norms = np.sqrt(squares)
            open_ = np.flatnonzero(norms[:m] > goal)
            if not len(open_):
                own = [i for i in range(m) if values[i].real + n >= tol][:d]
                return state, values[own] + n, turn[:, own]
            grown = np.concatenate([open_[:block], np.arange(m, min(m + max(block - len(open_), 0) // 2, look))])
            if np.iscomplexobj(turn):
                grown = np.concatenate([grown, grown + look])
            fresh, less = _apart(with_basis[:, grown], products[np.ix_(grown, grown)], gram)
            if fresh.shape[1]:
                break
        new = np.zeros((len(products), fresh.shape[1]))
        new[grown] = fresh
        full = len(values) + 2 * len(grown) > keep + 3 * block
        state, inner, gram = wide.grow(state, make, new, less, span(turn[:, :keep], 1e-10) if full else np.eye(len(values)))
    raise ArithmeticError(f"{len(open_)} of {m} eigenvectors haven't converged in {rounds} rounds")


def wide_table(lap: JointLaplacian, state: DataFrame, turn: np.ndarray) -> DataFrame:
    """``side``, ``gene``, ``coords``, ``coords_im``: the rows of the basis times ``turn``."""
    width = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(v).ravel()))
        for row in _rows(batches):
            found = _columns(row["basis"], row["diagonal"].size // 8) @ turn
            size = len(found) // 2
            at = row["chunk"] * CHUNK + np.tile(np.arange(size), 2)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(["X", "Y"], size)), lists(found.real), lists(found.imag if np.iscomplexobj(found) else np.zeros_like(found))], ["at", "side", "coords", "coords_im"])

    rows = state.select("chunk", "diagonal", "basis").mapInArrow(run, "at long, side string, coords array<double>, coords_im array<double>")
    return rows.join(lap.genes.hint("merge"), "at").select("side", "gene", "coords", "coords_im")
