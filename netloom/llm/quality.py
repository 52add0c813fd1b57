"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-Proximal.

Words, adjacent word pairs, and pairs of adjacent word shapes (lower, capital, upper, digits, signs) are
hashed into a fixed number of buckets. A text's value in a bucket is the square root of its share of the
text's n-grams, so that every text has length one; the share of repeated n-grams has a bucket of its own.
Training follows the regularised leader (McMahan et al. 2013) on shards of a bounded sample; after each
pass the shards' states are averaged. Scores are sparse dot products, summed for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .common import bounded_batches, held_out, sampled, steps, table, words_of

BUCKET_BITS = 18
#: Bucket of the share of words that repeat an earlier one, beyond those of the hashes.
REPEATS = 1 << BUCKET_BITS
#: Labelled rows to train on at most (about), shards that train at once, passes over them.
TRAIN_ROWS, SHARDS, PASSES = 8_000, 4, 6
THRESHOLD = 0.3
SIGNS = r"([^\p{L}\p{N}\p{M}\s]+)"


@dataclass
class Ftrl:
    """Per-bucket state of FTRL-Proximal; the last place is the intercept."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 1.0
    beta: float = 0.5
    l1: float = 0.005
    l2: float = 0.02

    @classmethod
    def fresh(cls) -> Ftrl:
        size = REPEATS + 2
        return cls(np.zeros(size), np.zeros(size))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of every non-zero feature of whole texts, by row."""
    rows, words = words_of(pc.replace_substring_regex(pc.fill_null(texts, ""), SIGNS, r" \1 "), r"\s+", lower=False)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    codes = words.dictionary_encode()
    distinct = codes.dictionary
    at = codes.indices.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(np.array(distinct.to_pylist(), object))
    long, first = pc.greater(pc.utf8_length(distinct), 1), pc.utf8_slice_codeunits(distinct, 0, 1)
    kind = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
    shape = np.select([~kind(pc.match_substring_regex(distinct, r"[\p{L}\p{N}]")), kind(pc.match_substring_regex(distinct, r"^\p{N}+$")), kind(pc.and_(long, pc.utf8_is_upper(distinct))), kind(pc.utf8_is_upper(first))], [1, 2, 3, 4], 0).astype(np.uint64)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BUCKET_BITS)
    one, sort = hashes[at], shape[at]
    same = rows[1:] == rows[:-1]
    two = (one[:-1] * mix + one[1:])[same]
    forms = (sort[:-1] * np.uint64(8) + sort[1:] + np.uint64(1000))[same]
    grams = [((h * mix) ^ (h >> np.uint64(29))) * mix >> shift for h in (one, two, forms)]
    owners = np.concatenate([rows, rows[1:][same], rows[1:][same]])
    keys, counts = np.unique(owners << BUCKET_BITS | np.concatenate(grams).astype(np.int64), return_counts=True)
    row, bucket = keys >> BUCKET_BITS, keys & (1 << BUCKET_BITS) - 1
    total = np.bincount(owners)
    value = np.sqrt(counts / total[row])
    # share of words that repeat an earlier one: a bucket of its own
    seen = np.unique(rows << 32 | at)
    own, n = np.unique(rows, return_counts=True)
    repeats = np.sqrt(1 - np.bincount(seen >> 32)[own] / n)
    return np.concatenate([row, own]), np.concatenate([bucket, np.full(len(own), REPEATS)]), np.concatenate([value, repeats])


def _examples(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            row, bucket, value = features(batch.column("text"))
            order = np.argsort(row, kind="stable")
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            offsets = pa.array([0, *ends], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], t)) for x, t in ((bucket, pa.int32()), (value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("y"), *lists], ["shard", "y", "at", "x"])

    return docs.select("shard", "y", "text").mapInArrow(run, "shard int, y double, at array<int>, x array<float>")


def _trainer(shared, turn: int):
    """A pass of one shard from the shared state; returns the buckets it has moved."""

    def train(part: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(shared.value.z.copy(), shared.value.n.copy())
        part = part.iloc[np.random.default_rng(turn).permutation(len(part))]
        for y, at, x in zip(part["y"], part["at"], part["x"]):
            model.learn(np.append(at, -1), np.append(x, 1.0), y)
        moved = np.flatnonzero(model.n)
        return pd.DataFrame({"bucket": moved, "z": model.z[moved], "n": model.n[moved]})

    return train


def fit(labelled: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, shards: int = SHARDS, passes: int = PASSES) -> np.ndarray:
    """Weights learned from ``text`` and ``label`` (0 or 1) of ``labelled``; rows with a null label teach nothing.

    ``rows`` bounds what a shard (one task) holds: about ``rows / shards`` examples. Without any example
    all weights are 0, and all scores 0.5.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    examples = materialize(_examples(labelled.filter(F.col(label).isNotNull()).select(shard.alias("shard"), F.col(label).cast("double").alias("y"), "text")), "examples")
    state = Ftrl.fresh()
    for turn in range(passes):
        trained = examples.groupBy("shard").applyInPandas(_trainer(spark.sparkContext.broadcast(state), turn), "bucket bigint, z double, n double")
        averaged = trained.groupBy("bucket").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()  # one row a bucket at most
        state = Ftrl.fresh()
        state.z[averaged["bucket"]], state.n[averaged["bucket"]] = averaged["z"], averaged["n"]
    return state.weights()


def score(docs: DataFrame, weights: np.ndarray, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of every row, with ``score`` (0 to 1, for label 1) of its whole text and ``predicted``.

    Null and empty texts score by the intercept alone. ``predicted`` is 1 from ``threshold`` on, else 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    kept = [c for c in columns if c not in ("score", "predicted")]
    narrow = docs.select(*kept, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in steps(batches, "__text"):
            row, bucket, value = features(batch.column("__text"))
            sums = np.bincount(row, w[bucket] * value, batch.num_rows) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels of those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id", "quality")
    chosen = sampled(labels.filter(~held_out(F.col("doc_id"))), F.col("doc_id"), TRAIN_ROWS, "quality")
    # the sample is bounded by TRAIN_ROWS rows of two numbers
    weights = fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return score(marked, weights, ["doc_id", "held_out"])
