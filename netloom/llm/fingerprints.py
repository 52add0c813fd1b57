"""Document fingerprints: I-Match over several randomised lexicons.

The lexicon is all terms whose document frequency lies in a band [LOW, HIGH] of the number of documents
(Chowdhury et al. 2002), counted over all documents. Its size is bounded by the mean number of distinct
terms of a document divided by LOW, whatever the corpus, so that it can be broadcast. Randomised subsets
of the lexicon (Kolcz et al. 2004) give one hash each of the sorted distinct terms that they keep. Subsets
come at rates 1/2, 1/4, 1/8, ...; a document uses the four from the one at which a subset keeps about one
of its terms. At the first rate that two documents have in common, the share of subsets on which they agree
follows the overlap of their terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, steps, table, words_of

#: Band of document frequency, as shares of all documents.
LOW, HIGH = 1 / 2000, 0.05
#: Random subsets at each rate, rates of a document, and in-band terms under which all terms of a document count.
SUBSETS, RATES, FEWEST = 48, 4, 4
#: Documents of one sorted part, and parts at most.
PART_ROWS, MOST_PARTS = 2_000, 20_000
ENDS = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), to draw subsets from term hashes."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct term of each text, sorted by row, then hash.

    Terms are lower-case words without the signs at their ends.
    """
    rows, words = words_of(texts, None)
    if not len(rows):
        return rows, np.zeros(0, np.uint64)
    codes = words.dictionary_encode()
    distinct = pc.replace_substring_regex(codes.dictionary, ENDS, "")
    hashes, rank = np.unique(pd.util.hash_array(np.array(distinct.to_pylist(), object)), return_inverse=True)
    at = codes.indices.to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)[at]
    keys = np.unique((rows << 32 | rank[at])[full])  # ranks, so that one sort of numbers orders by row, then hash
    return keys >> 32, hashes[keys & 0xFFFFFFFF]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``term`` (64-bit hash, as a long) and ``df`` over all documents."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            terms, counts = np.unique(_terms(batch.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))], ["term", "df"])

    return docs.select("text").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band; at most (mean distinct terms of a document) / ``low``."""
    n = docs.count()
    band = document_frequencies(docs).filter((F.col("df") >= low * n) & (F.col("df") <= max(high * n, 1)))
    return np.sort(np.array([r[0] for r in band.select("term").collect()], np.int64).view(np.uint64))


def fingerprints(texts: pa.Array, known: np.ndarray, subsets: int = SUBSETS) -> list[str]:
    """Fingerprint of each text: kind, level, then for RATES rates the hashes of all subsets.

    Kind ``b``: of terms in the band; ``a``: of all terms, as fewer than FEWEST are in it; ``t``: the text
    has no terms, and its digest stands for it. An empty subset has hash 0.
    """
    count = len(texts)
    rows, terms = _terms(texts)
    at = np.searchsorted(known, terms)
    inside = np.zeros(len(terms), bool)
    if len(known):
        inside = known[np.minimum(at, len(known) - 1)] == terms
    enough = np.bincount(rows[inside], minlength=count) >= FEWEST
    keep = inside | ~enough[rows]
    rows, terms = rows[keep], terms[keep]
    sizes = np.bincount(rows, minlength=count)
    level = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    out = np.zeros((count, RATES, subsets), np.uint64)
    own = np.flatnonzero(sizes)
    if len(own):
        starts = np.cumsum(sizes[own]) - sizes[own]
        value = _mix(terms + np.uint64(1))
        masks = [(np.uint64(1) << (level[rows] + 1 + k).astype(np.uint64)) - np.uint64(1) for k in range(RATES)]
        for s in range(subsets):
            drawn = _mix(terms ^ _mix(np.full(1, 7919 * (s + 1), np.uint64)))
            for k in range(RATES):
                kept = (drawn & masks[k]) == 0
                out[own, k, s] = np.add.reduceat(np.where(kept, value, np.uint64(0)), starts)
    short = np.where(out != 0, np.maximum(_mix(out) >> np.uint64(48), np.uint64(1)), np.uint64(0))
    kinds = np.where(enough, "b", "a")
    hexes = short.astype(">u2").reshape(count, -1)
    texts = texts.to_pylist()
    return [f"{kinds[i]}{level[i]:02x}{hexes[i].tobytes().hex()}" if sizes[i] else "t" + hashlib.sha256((texts[i] or "").encode()).hexdigest() for i in range(count)]


def likeness(a: str, b: str) -> float:
    """Share of subsets, of those that keep a term of either, on which two fingerprints agree (0 to 1)."""
    if a == b:
        return 1.0
    if "t" in (a[0], b[0]):
        return 0.0
    la, lb = int(a[1:3], 16), int(b[1:3], 16)
    if abs(la - lb) >= RATES:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(f[3:]), ">u2").reshape(RATES, -1)[max(la, lb) - lev] for f, lev in ((a, la), (b, lb)))
    some = (x != 0) | (y != 0)
    return float(((x == y) & some).sum() / some.sum()) if some.any() else 0.0


def _parts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``part`` and ``guard``: documents cut by id into sorted parts.

    The first document of each part is also the guard at the end of the part before (of the last part for
    the first), so that each document meets the next one within its part. Only ids are looked at to find
    the cuts; one per part comes to the driver.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(lowest)).alias("id"))
    n_parts = max(1, min(MOST_PARTS, docs.count() // PART_ROWS))
    cuts = ids.repartitionByRange(n_parts, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("id")).select("id").collect()
    shared = spark.sparkContext.broadcast(np.unique(np.array([r[0] for r in cuts], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shared.value
        for batch in batches:
            key = batch.column(0).fill_null(lowest).to_numpy()
            part = np.searchsorted(first, key, side="right") - 1
            also = np.flatnonzero(first[part] == key)
            rows = np.concatenate([np.arange(len(key)), also])
            parts = np.concatenate([part, (part[also] - 1) % len(first)])
            guard = np.arange(len(rows)) >= len(key)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(parts.astype(np.int32)), pa.array(guard)], ["doc_id", "text", "part", "guard"])

    marked = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string, part int, guard boolean")
    return marked.repartition(n_parts, "part").sortWithinPartitions("part", "guard", F.asc_nulls_first("doc_id"), F.xxhash64("text"))


def fingerprint_documents(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next
    document's by id; after the last document comes the first. Null texts count as empty. Null ids come
    first; rows of one id are in the order of their texts' hashes. Repeated rows each return a row. Other
    columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(known)

    def digest(ids: list, texts: list[str], known: np.ndarray) -> pa.RecordBatch:
        """All rows but the last, which is only the next one of the row before it."""
        edited = []
        for text, after in zip(texts, texts[1:]):
            k = len(text) // 2
            edited.append(text[: len(text) - k] + after[:k])
        plain, changed = fingerprints(pa.array(texts, pa.string()), known), fingerprints(pa.array(edited, pa.string()), known)
        columns = [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(plain[:-1]), pa.array(changed)]
        columns += [pa.array(list(map(likeness, plain, changed)), pa.float64()), pa.array(list(map(likeness, plain, plain[1:])), pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        part, closed, ids, texts, size = None, False, [], [], 0
        for batch in batches:
            for i, text, p, guard in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    if len(ids) > 1:
                        yield digest(ids, texts, known)
                    part, closed, ids, texts, size = p, False, [], [], 0
                if closed:
                    continue
                closed = guard
                ids.append(i)
                texts.append(text or "")
                size += len(texts[-1])
                if size > 2 << 20 and len(ids) > 1:
                    yield digest(ids, texts, known)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield digest(ids, texts, known)

    return _parts(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint_documents(docs, lexicon(docs))
