"""SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two linked fingerprints must have one segment
that differs by at most one bit (two segments for two bits). Each segment is indexed once for every
bit position with that bit left out; two segments at most one bit apart then share a signature, which
an equality join finds. Candidates are verified on the whole fingerprint.

Only distinct fingerprints are indexed, so exact copies cost one row. A signature shared by more than
``PAIR_LIMIT`` distinct fingerprints is not paired up: its fingerprints are listed under themselves
and their 64 one-bit neighbours instead. Two fingerprints at most two bits apart have such a list
entry in common, and all in one entry are at most two bits apart, so each is linked to the smallest
alone. That path is exact and linear in the size of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .common import bounded_batches, steps, table
from .components import components

#: Words of a shingle, seed of its hash, bits by which linked fingerprints may differ.
SHINGLE_WORDS, SEED, DISTANCE = 3, 42, 2
#: Distinct fingerprints under one signature up to which candidates are compared with each other.
PAIR_LIMIT = 32

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a whole text (A-Z lower-cased, words between ASCII white space)."""
    tokens = text.encode("utf-8").translate(LOWER).split()
    n = len(tokens)
    if not n:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - words + 1]
    ends = ends[words - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        cut = slice(at, at + (1 << 16))
        ones += _ones(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[cut].tolist(), ends[cut].tolist())], np.uint64))
    return _fingerprint(ones, len(starts))


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduce(bits, axis=0, dtype=np.uint32).astype(np.int64)


def _fingerprint(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    return _fingerprint(sum((_ones(hashes[at : at + (1 << 16)]) for at in range(0, len(hashes), 1 << 16)), np.zeros(64, np.int64)), len(hashes))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed long) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _long(bits: int) -> Column:
    """A 64-bit pattern as a signed long."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def _signatures(fp: Column, segments: int) -> Column:
    """For each bit left out (by position): the other bits of its segment."""
    edges = [64 * k // segments for k in range(segments + 1)]
    return F.array(*[fp.bitwiseAND(_long((1 << hi) - (1 << lo) & ~(1 << bit))) for lo, hi in zip(edges, edges[1:]) for bit in range(lo, hi)])


def _close(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def links(fps: DataFrame, distance: int = DISTANCE, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that join all within ``distance`` bits.

    Every returned pair is within ``distance`` (1 or 2), and any two fingerprints within it are
    connected through returned pairs.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    segments = distance // 2 + 1
    signed = fps.select("fp", F.posexplode(_signatures(F.col("fp"), segments)).alias("bit", "rest"))
    groups = materialize(signed.groupBy("bit", "rest").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1"), "signatures")
    two = groups.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct().filter(_close(F.col("a"), F.col("b"), distance))

    # merge: the plan, and with it what is shuffled, stays the same at every size
    crowd = materialize(signed.join(groups.filter("n > 2").select("bit", "rest", "n").hint("merge"), ["bit", "rest"]), "crowd")
    some = crowd.filter(f"n <= {pair_limit}")
    lists = some.groupBy("bit", "rest").agg(F.collect_list("fp").alias("all"))
    each = lists.select(F.explode("all").alias("a"), "all")
    near = each.select("a", F.explode(F.filter("all", lambda y: (y > F.col("a")) & _close(F.col("a"), y, distance))).alias("b"))

    many = crowd.filter(f"n > {pair_limit}").select("fp").distinct()
    flips = [F.col("fp").bitwiseXOR(_long(1 << i)) for i in range(64)]
    if distance == 1:  # the lower end of the bit that differs stands for both
        listed = many.select("fp", F.posexplode(F.array(*[F.least(F.col("fp"), f) for f in flips])).alias("bit", "z"))
        by = ["bit", "z"]
    else:
        listed = many.select("fp", F.explode(F.array(F.col("fp"), *flips)).alias("z"))
        by = ["z"]
    stars = listed.groupBy(*by).agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b <> top").select(*by, "b")
    hot = listed.join(stars, by).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return two.unionByName(near).unionByName(hot).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``.

    Documents are linked if their fingerprints differ by at most ``distance`` bits; ``component_id`` is
    the smallest id that can be reached over links, the document's own included. Null and blank texts
    have fingerprint 0 and are linked as any other. A null id has its row but never names a component
    (null only if no row of the component has an id). Repeated rows each return a row. Other columns
    are not read.
    """
    marked = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "distinct")
    roots = components(links(distinct, distance, pair_limit))
    rooted = materialize(distinct.join(roots, distinct.fp == roots.id, "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root")), "rooted")
    owners = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    return marked.join(rooted.join(owners, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at two differing bits or fewer."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
