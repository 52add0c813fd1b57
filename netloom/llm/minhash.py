"""Near-duplicates by Jaccard similarity of word shingles: sets that share a SimHash or MinHash key, verified on the whole sets.

Sets share a key if their fingerprints are joined by the links of ``simhash.links`` (two bits), but similarity 0.8 goes
further: such pairs differ by up to 11 of 64 bits, and segments short enough for that many are shared by chance with a
fixed part of the corpus. So each text also has ``BANDS`` keys of ``ROWS`` minima; a pair of similarity s
shares one with probability 1 - (1 - s^ROWS)^BANDS, 0.999998 at 0.8.

Only distinct sets are indexed, so exact copies cost one row. What counts is who reaches whom, so a key is done when all its sets
are in one component. First each key's sets are compared with one of them, that with the most company; where they are many and in many
components, with some more. Of what is open then, every two sets of one key in different components are compared, in blocks:
no key drops a partner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import bounded_batches, named, steps
from .components import components
from .simhash import LOWER, SEED, links, majority

#: Words of a shingle, least similarity of linked texts.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Keys of a text and minima in a key.
BANDS, ROWS = 25, 4
#: Rounds of leaders at most and leaders of a key in a round after the first; comparisons a row that need no other round; sets in a block.
ROUNDS, LEADERS, PAIR_LIMIT, BLOCK = 6, 4, 32, 512

_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FACTOR, _SHIFT = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


def shingles(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, a blank one has none."""
    tokens = text.encode("utf-8").translate(LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    found = {xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), SEED) for i in range(max(len(tokens) - words + 1, 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each of BANDS x ROWS hash functions; 0 without shingles."""
    if not len(hashes):
        return np.zeros(BANDS * ROWS, np.uint64)
    return np.min([(hashes[i : i + 4096] * _FACTOR + _SHIFT).min(1) for i in range(0, len(hashes), 4096)], axis=0)


def band_keys(least: np.ndarray) -> list[int]:
    """A key for each band of minima."""
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def _longs(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _marked(docs: DataFrame) -> DataFrame:
    """``doc_id``, hash of the text, and of its set of shingles: id, SimHash, size, keys (none without shingles), a byte of each minimum."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = [shingles(t or "") for t in batch.column(2).to_pylist()]
            least = [minima(s) for s in sets]
            keys = [_longs(band_keys(x) if len(s) else []) for s, x in zip(sets, least)]
            columns = [pa.array(_longs([set_id(s) for s in sets])), pa.array(_longs([majority(s) for s in sets])), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array([x.astype(np.uint8).view(np.int8) for x in least], pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "th", "set", "fp", "size", "keys", "minima"])

    narrow = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, th bigint, set bigint, fp bigint, size int, keys array<bigint>, minima array<tinyint>")


def _sets(texts: DataFrame) -> DataFrame:
    """``set`` and its ``shingles`` for each row of (th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(_longs([set_id(s) for s in sets])), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set", "shingles"])

    return texts.select("th", "text").mapInArrow(run, "set bigint, shingles array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose shingles are alike."""
    of = lambda end: sets.select(F.col("set").alias(end), F.col("shingles").alias(f"of_{end}"))
    both = pairs.distinct().join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    common = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("n"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return materialize(common.filter(F.col("n") >= (F.col("sizes") - F.col("n")) * similarity - 1e-9).select("a", "b"), "alike")


def _fit(similarity: float) -> Column:
    """Whether sets of sizes ``size`` and ``other`` can be alike."""
    return F.least("size", "other") >= F.greatest("size", "other") * similarity - 1e-9


def _ends() -> list[Column]:
    return [F.least("set", "with").alias("a"), F.greatest("set", "with").alias("b")]


def keyed(distinct: DataFrame) -> DataFrame:
    """``set``, ``size``, ``minima``, and ``keys`` with one of SimHash: sets whose fingerprints (``fp``) are within two bits, or joined by such, share it."""
    roots = components(links(distinct.select("fp").distinct()))
    own = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp"))
    return materialize(distinct.join(roots.hint("merge"), distinct.fp == roots.id, "left").select("set", "size", "minima", F.concat("keys", F.array(own)).alias("keys")), "keyed")


def key_members(sets: DataFrame) -> DataFrame:
    """``key``, ``set``, ``size``, ``n``, ``central`` of keys that ``n`` > 1 sets share; ``central`` counts the company of a set under all its keys.

    Every row gets the number of its key, keys of one set too: what the join makes follows the rows, not how many keys are shared.
    """
    rows = sets.select("set", "size", F.explode("keys").alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    shared = materialize(rows.join(counts.hint("merge"), "key"), "shared").filter("n > 1")
    central = shared.groupBy("set").agg(F.sum("n").alias("central"))
    return materialize(shared.join(central.hint("merge"), "set").select("key", "set", "size", "n", "central"), "members")


def _stars(members: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs of each key's sets with its leader of most company, or, in later turns, with LEADERS drawn from its components."""
    first = F.col("central") if turn == 0 else F.xxhash64(F.lit(turn), "set")
    part = F.lit(0) if turn == 0 else F.pmod(F.xxhash64(F.lit(turn), "root"), F.lit(LEADERS))
    leaders = members.groupBy("key", part.alias("part")).agg(F.max(F.struct(first.alias("first"), "set", "size", "root")).alias("top"))
    leaders = leaders.select("key", F.col("top.set").alias("with"), F.col("top.size").alias("other"), F.col("top.root").alias("of"))
    return members.join(leaders.hint("merge"), "key").filter((F.col("root") != F.col("of")) & _fit(similarity)).select(*_ends())


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of keys whose sets are in several components (``root``), not counting keys of two sets, which have been compared. ``top`` is the
    largest component of a key, ``apart`` the number of its sets that aren't in it.
    """
    rooted = members.drop("root", "top", "apart").filter("n > 2").join(roots.select(F.col("id").alias("set"), "root").hint("merge"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("own"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("own", "root")).alias("top"), F.sum("own").alias("all"))
    tops = tops.select("key", F.col("top.root").alias("top"), (F.col("all") - F.col("top.own")).alias("apart")).filter("apart > 0")
    return materialize(rooted.join(tops.hint("merge"), "key"), "open")


def _crossed(members: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """All pairs of sets of one key in different components that may be alike: sets outside the key's largest component with all, in blocks,
    each pair under the least of its keys (a key that isn't open any more has compared it).

    Of the minima of a similar pair fewer than 6 standard deviations below the mean agree with a probability of 1e-8; such pairs are left out.
    """
    number, spread = BANDS * ROWS, (BANDS * ROWS * similarity * (1 - similarity)) ** 0.5
    rows = members.join(sets.select("set", "minima", "keys").hint("merge"), "set").select("key", "set", "size", "root", "top", "minima", "keys", F.ceil(F.col("apart") / block).alias("is"), F.ceil(F.col("n") / block).alias("js"))
    own = lambda blocks: F.pmod(F.xxhash64(F.lit("block"), "set"), F.col(blocks))
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    left = rows.filter("root <> top").select("key", own("is").alias("i"), each("js").alias("j"), "set", "size", "root", "minima", "keys")
    right = rows.select("key", own("js").alias("j"), each("is").alias("i"), F.col("set").alias("with"), F.col("size").alias("other"), F.col("root").alias("of"), F.col("minima").alias("there"), F.col("keys").alias("theirs"))
    agree = F.size(F.filter(F.zip_with("minima", "there", lambda x, y: x == y), lambda same: same))
    here = F.array_min(F.array_intersect("keys", "theirs")) == F.col("key")
    alike = F.when((F.col("root") != F.col("of")) & _fit(similarity), F.when(here, agree >= number * similarity - 6 * spread)).otherwise(False)
    met = left.join(right.hint("merge"), ["key", "i", "j"]).filter(alike)
    return met.select(*_ends())


def linked(distinct: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """``id``, ``root``: components of the sets (``set``, ``fp``, ``size``, ``keys``, ``minima``) that share a key and are alike.

    ``sets`` gives ``set`` and ``shingles`` of the sets it is asked for (``set``).
    """
    distinct = keyed(distinct)
    members = key_members(distinct)
    texts = materialize(sets(members.select("set").distinct()), "sets")
    members, found, before = members.withColumn("root", F.col("set")), None, None
    for turn in range(ROUNDS):
        alike = _alike(_stars(members, similarity, turn), texts, similarity)
        found = alike if found is None else found.unionByName(alike)
        roots = components(found)
        members = _open(members, roots)
        rows, work = members.agg(F.count("*"), F.coalesce(F.sum(F.col("apart").cast("double")), F.lit(0.0))).first()
        if not rows:
            return roots
        if work <= PAIR_LIMIT * rows or before is not None and work > before / 2:
            break
        before = work
    return components(found.unionByName(_alike(_crossed(members, distinct, similarity), texts, similarity)))


def _rooted(docs: DataFrame, similarity: float) -> DataFrame:
    """``doc_id``, ``th`` (hash of the text), ``set`` and ``root`` (the component's smallest set) of every row."""
    marked = materialize(_marked(docs), "marked")
    distinct = materialize(marked.groupBy("set").agg(F.min("th").alias("th"), *[F.first(c).alias(c) for c in ("fp", "size", "keys", "minima")]), "distinct")

    def sets(wanted: DataFrame) -> DataFrame:
        hashes = wanted.join(distinct.select("set", "th").hint("merge"), "set").select("th")
        return _sets(docs.select(F.xxhash64("text").alias("th"), "text").join(hashes.hint("merge"), "th", "left_semi").dropDuplicates(["th"]))

    roots = linked(distinct, sets, similarity)
    rooted = distinct.select("set").join(roots.hint("merge"), F.col("set") == roots.id, "left").select("set", F.coalesce("root", "set").alias("root"))
    return materialize(marked.select("doc_id", "th", "set").join(rooted.hint("merge"), "set"), "rooted")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``set`` and ``component_id`` of every row of ``docs``.

    Documents are linked if the Jaccard similarity of their shingles is at least ``similarity``; ``component_id`` is
    the smallest id that can be reached over links, the document's own included. Null and blank texts are
    copies of each other. A null id has its row but never names a component (null only if no row of the component has
    an id). Repeated rows each return a row. Other columns are not read.
    """
    rooted = _rooted(docs, similarity)
    owners = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(owners, "root").select("doc_id", "set", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component with all columns of ``docs``: that of the smallest id, then of the smallest hash of the text.

    Rows without an id come last. What counts is the row, not its id: unlike texts under one id, or without an id, are
    documents of their own and stay. Of rows that agree in id and text the one with the smallest hash of all columns stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))).alias("first")
    winners = _rooted(docs, similarity).groupBy("root").agg(first).select(F.col("first.doc_id").alias("__doc"), F.col("first.th").alias("__th"))
    rows = docs.withColumn("__hash", F.xxhash64("text"))
    rows = rows.join(winners.hint("merge"), rows["doc_id"].eqNullSafe(winners["__doc"]) & (rows["__hash"] == winners["__th"]), "left_semi")
    one = rows.groupBy("doc_id", "__hash").agg(F.min_by(F.struct(*named(docs.columns)), F.xxhash64(*named(docs.columns))).alias("__row"))
    return one.select("__row.*")
