"""Repeated passages by collinear chaining of shared word k-mers.

Seeds are winnowed k-mers of words: of every WINDOW k-mers in a row the one of smallest hash, so that any
exact passage of WINDOW + K - 1 words has a seed in common with its copies. Every occurrence of a seed is
matched with the seed's first occurrence alone (smallest id, then place): matches grow with the input,
however often a passage occurs. The seeds of a passage may occur first in different documents, though, none of
which holds the passage. So runs of RUN words are matched with their own first occurrence as well, from the k-mers
that are smallest in RUN_WINDOW of them: an exact passage of RUN + RUN_WINDOW - 1 words always meets an earlier
document that holds RUN of its words in a row. And pairs of k-mers are, whatever stands between the two: what two fuzzy
copies have on both sides of a change, where the words of each side first occur in other documents, no document has before the first
copy. A pair's second k-mer is the one among the following PAIR_STEPS that has the smallest hash together with the first.

Matches of two documents are merged along diagonals, and the pieces chained in order in both texts, with a cost for
the gaps, by a Fenwick tree over the places in the other text. Chains are then aligned on the words themselves:
grown at both ends until too little agrees, and their gaps matched by edit distance. Those long and alike enough
are the passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, numbered
from .common import bounded_batches, steps, table

#: Words of a k-mer, k-mers of a winnowing window; words of a run and k-mers of the window that picks its start.
K, WINDOW = 5, 9
RUN, RUN_WINDOW = 40, 11
#: Pairs: k-mers of the window that picks the first, places of the second after it, bits that hold which (0: none).
PAIR_WINDOW, PAIR_STEPS, PAIR_BITS = 20, np.arange(9, 40), 5
#: Words of a chain's seeds from which it is aligned, words of a passage, share of its words that agree.
CHAIN_WORDS, PASSAGE_WORDS, IDENTITY = 10, 40, 0.8
#: Chaining: cost of a word in a gap. Growing: cost of a word that differs, and drop at which it ends.
GAP_COST, MISMATCH, DROP = 0.15, 3, 18
#: Growing past words put in or left out, before K words that agree: most of them on one side.
SKIP = 3
_SKIPS = sorted(((i, j) for i in range(SKIP + 1) for j in range(SKIP + 1) if i or j), key=lambda s: (max(s), sum(s)))
#: Longest gap that is aligned word by word; longer ones count as different.
GAP_WORDS = 200
#: UTF-8 bytes hashed at once.
STEP_BYTES = 1 << 20
#: Odd bases of the polynomial hashes of bytes and of words, modulo 2^64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        _POWERS[base] = np.multiply.accumulate(table)
    return _POWERS[base][:n]


def _range_hashes(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[start:end]``, the same wherever it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), len(values) + 1)
    return _mixed((sums[ends] - sums[starts]) * back[starts])


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each word (lower case, between ASCII white space)."""
    texts = pc.cast(pc.utf8_lower(pc.fill_null(texts, "")), pa.large_string())
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    cuts = cuts - cuts[0]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blank = _BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)  # where one text ends and the next begins
    edge[cuts] = True
    filled = ~blank
    opens, closes = filled.copy(), filled.copy()
    opens[1:] &= blank[:-1] | edge[1:-1]
    closes[:-1] &= blank[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = _range_hashes(raw.astype(np.uint64) + np.uint64(1), BYTE_BASE, starts, ends)
    return np.searchsorted(cuts, starts, side="right") - 1, hashes


def _smallest(values: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Which of ``values`` are the smallest (the first of equal ones) of ``window`` in a row of one document; of all where there are fewer."""
    picked = np.zeros(len(values), bool)
    if not len(values):
        return picked
    ends = np.flatnonzero(np.diff(row, append=-1))
    firsts = np.concatenate([[0], ends[:-1] + 1])
    short = ends - firsts + 1 < window
    picked[np.array([lo + values[lo : hi + 1].argmin() for lo, hi in zip(firsts[short], ends[short])], np.int64)] = True
    if len(values) >= window:
        view = np.lib.stride_tricks.sliding_window_view(values, window)
        best = np.arange(len(view)) + view.argmin(axis=1)
        picked[best[row[: len(view)] == row[window - 1 :]]] = True
    return picked


def _pairs(kmers: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First k-mer, step of the second and hash of each pair."""
    first = np.flatnonzero(_smallest(kmers, row, PAIR_WINDOW))
    second = first[:, None] + PAIR_STEPS
    inside = second < len(kmers)
    second[~inside] = 0
    inside &= row[second] == row[first][:, None]
    both = _mixed(kmers[first][:, None] * np.uint64(WORD_BASE) + kmers[second])
    step = np.where(inside, both, np.uint64(0xFFFFFFFFFFFFFFFF)).argmin(axis=1) if len(first) else np.zeros(0, np.int64)
    pairs = both[np.arange(len(first)), step]
    keep = inside[:, 0].copy() if len(first) else np.zeros(0, bool)
    keep[1:] &= (np.diff(pairs) != 0) | (np.diff(row[first]) != 0)  # one word over and over has one pair
    return first[keep], step[keep], pairs[keep]


def _numbered_docs(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """``doc`` (a number from 0 in the order of ids) and ``text``; what ids the numbers have, unless by a shift; bits of a place.

    Number and place are packed into one long, with as many bits for the place as the longest text may need. Ids that are
    unique and fit into the rest are shifted; else the distinct (id, text)s are numbered, which costs a join.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    seen = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(F.octet_length("text")).alias("bytes")).first()
    bits = max(1, ((seen["bytes"] or 0) // 2 + 1).bit_length())
    repeated = bool(rows.groupBy("doc_id").count().filter("count > 1").take(1))
    if not repeated and (seen["lo"] is None or seen["hi"] - seen["lo"] < 1 << (63 - bits - PAIR_BITS)):
        base = seen["lo"] or 0
        ids = rows.sparkSession.createDataFrame([(base,)], "base long")
        return rows.select((F.col("doc_id") - F.lit(base)).alias("doc"), "text"), ids, bits
    marked = rows.withColumn("th", F.xxhash64("text"))
    names = materialize(numbered(marked.select("doc_id", "th").distinct(), "doc_id", "th", name="doc"), "names")
    if names.count().bit_length() + bits + PAIR_BITS > 63:
        raise ValueError("numbers of documents and places in the longest text don't fit into 63 bits")
    single = marked.join(names, ["doc_id", "th"]).dropDuplicates(["doc"])
    return single.select("doc", "text"), names.select("doc", "doc_id"), bits


def _with_ids(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Numbers of documents replaced by their ids."""
    if "base" in ids.columns:
        base = F.lit(ids.first()["base"])
        return found.withColumns({c: F.col(c) + base for c in ("doc_id", "other_id")})
    for c in ("doc_id", "other_id"):
        found = found.join(ids.select(F.col("doc").alias(c), F.col("doc_id").alias("__id")), c).drop(c).withColumnRenamed("__id", c)
    return found


def seeds(docs: DataFrame, place_bits: int) -> DataFrame:
    """``h`` and ``at`` of every seed, run and pair: a hash whose lowest bits tell its kind (0, 1, 2), and number, first word's
    place and a pair's step (from 1), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=STEP_BYTES):
            rows, words = _word_hashes(batch.column(1))
            if len(rows) < K:
                continue
            start = np.flatnonzero(rows[: len(rows) - K + 1] == rows[K - 1 :])
            row = rows[start]
            kmers = _range_hashes(words, WORD_BASE, start, start + K)
            at = (batch.column(0).to_numpy()[row] << place_bits | (start - np.searchsorted(rows, row))) << PAIR_BITS
            picked, begins = _smallest(kmers, row, WINDOW), start[_smallest(kmers, row, RUN_WINDOW)]
            whole = begins + RUN <= len(rows)
            whole[whole] = rows[begins[whole]] == rows[begins[whole] + RUN - 1]
            begins = begins[whole]
            runs = _range_hashes(words, WORD_BASE, begins, begins + RUN)
            # text that repeats itself at once (the same run again within RUN words) has one run, at its start
            order = np.lexsort((begins, runs, rows[begins]))
            soon = (np.diff(runs[order]) == 0) & (np.diff(rows[begins][order]) == 0) & (np.diff(begins[order]) < RUN)
            alone = np.sort(order[np.concatenate([[True], ~soon])[: len(order)]])
            begins, runs = begins[alone], runs[alone]
            left, step, pairs = _pairs(kmers, row)
            h = np.concatenate([kmers[picked] & ~np.uint64(3), runs & ~np.uint64(3) | np.uint64(1), pairs & ~np.uint64(3) | np.uint64(2)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.concatenate([at[picked], at[np.searchsorted(start, begins)], at[left] | step + 1]))], ["h", "at"])

    return docs.mapInArrow(run, "h bigint, at bigint")


def _words(docs: DataFrame) -> DataFrame:
    """``id`` and ``words`` (32-bit hashes, packed) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=STEP_BYTES):
            rows, words = _word_hashes(batch.column(1))
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            small = words.astype("<u4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([small[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], ["id", "words"])

    return docs.mapInArrow(run, "id bigint, words binary")


def diagonals(x: np.ndarray, y: np.ndarray, reach: int = WINDOW + K) -> np.ndarray:
    """Matches (place here, place there) merged into pieces ``x1, x2, y1, y2`` (ends excluded), by x1."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(x - y) != 0) | (np.diff(x) > reach)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    pieces = np.column_stack([x[first], x[last] + K, y[first], y[last] + K])
    return pieces[np.lexsort((pieces[:, 2], pieces[:, 0]))]


def chains(pieces: np.ndarray) -> list[np.ndarray]:
    """Disjoint chains of pieces in order in both texts, best first.

    A chain's score is the words of its pieces less GAP_COST for each word of its gaps. The best chain that
    ends before a piece is a prefix maximum in a Fenwick tree over the places in the other text. Pieces may
    overlap the one before by fewer than K words.
    """
    n = len(pieces)
    if n == 1:
        return [pieces]
    ys = np.unique(pieces[:, 3])
    starts = np.searchsorted(ys, pieces[:, 2] + K - 1, side="right").tolist()
    stops = (np.searchsorted(ys, pieces[:, 3]) + 1).tolist()
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(ys) + 1)
    rows = pieces.tolist()
    score, before = [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=lambda i: rows[i][1])
    w = 0
    for j in range(n):
        x1, x2, y1, _ = rows[j]
        while w < n and rows[waiting[w]][1] <= x1 + K - 1:
            i = waiting[w]
            w += 1
            if i >= j:  # starts no earlier than this one
                continue
            value = (score[i] + GAP_COST * (rows[i][1] + rows[i][3]), i)
            at = stops[i]
            while at <= len(ys):
                if value > tree[at]:
                    tree[at] = value
                at += at & -at
        best, at = (0.0, -1), starts[j]
        while at:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - GAP_COST * (x1 + y1) if best[1] >= 0 else 0.0
        score[j] = x2 - x1 + max(gain, 0.0)
        before[j] = best[1] if gain > 0 else -1
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if chain:
            out.append(pieces[chain[::-1]])
    return out


def _grow(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words to add, and how many of them agree, when both texts go on in step."""
    n = min(len(a), len(b))
    got, hits, best, total = 0, 0, 0, 0
    for at in range(0, n, 256):
        same = a[at : min(n, at + 256)] == b[at : min(n, at + 256)]
        run = total + np.cumsum(np.where(same, 1, -MISMATCH))
        top = np.maximum(np.maximum.accumulate(run), best)
        stop = np.flatnonzero(top - run > DROP)
        run = run[: stop[0]] if len(stop) else run
        if len(run) and run.max() > best:
            k = int(run.argmax())
            hits += int(same[: k + 1].sum()) + (int((a[got:at] == b[got:at]).sum()) if at > got else 0)
            got, best = at + k + 1, int(run[k])
        if len(stop):
            break
        total = int(run[-1])
    return got, int((a[:got] == b[:got]).sum())


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Words to add on either side, and how many agree, where up to SKIP words may be left out on one side or both before the texts go on in step."""
    x, hits = _grow(a, b)
    y = x
    while True:
        for i, j in _SKIPS:
            here, there = a[x + i : x + i + K], b[y + j : y + j + K]
            if len(here) == len(there) == K and (here == there).all():
                more, same = _grow(a[x + i :], b[y + j :])
                x, y, hits = x + i + more, y + j + more, hits + same
                break
        else:
            return x, y, hits


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words of two gaps that agree in order (longest common subsequence)."""
    if not len(a) or not len(b) or max(len(a), len(b)) > GAP_WORDS:
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        step = np.maximum(row[1:], row[:-1] + (b == x))
        row = np.concatenate([[0], np.maximum.accumulate(step)])
    return int(row[-1])


def align(chain: np.ndarray, here: np.ndarray, there: np.ndarray) -> tuple[int, int, int, int, float]:
    """Bounds in both texts and share of agreeing words of a chain, grown at both ends."""
    agree, (x, y) = 0, chain[0, [0, 2]]
    x0, y0 = x, y
    for x1, x2, y1, y2 in chain.tolist():
        x1, y1 = (x1, y1) if x1 >= x and y1 >= y else (x1 + max(x - x1, y - y1), y1 + max(x - x1, y - y1))
        agree += _common(here[x:x1], there[y:y1])
        m = min(x2 - x1, y2 - y1)
        agree += int((here[x1 : x1 + m] == there[y1 : y1 + m]).sum()) if m > 0 else 0
        x, y = max(x, x2), max(y, y2)
    left, over, hits = _extend(here[:x0][::-1], there[:y0][::-1])
    x0, y0 = x0 - left, y0 - over
    right, over, more = _extend(here[x:], there[y:])
    x, y = x + right, y + over
    return int(x0), int(x), int(y0), int(y), (agree + hits + more) / max(x - x0, y - y0, 1)


#: Offsets of the k-mers that stand for a run.
_RUN_STEPS = np.append(np.arange(0, RUN - K, WINDOW), RUN - K)


def _chained(place_bits: int):
    """Candidate chains of each document with each earlier one."""
    mask = (1 << place_bits) - 1

    def found(x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """Chains of enough words, and pairs (places ``ends`` here and there) that lie in none of them."""
        covered = np.zeros(len(ends), bool)
        for chain in chains(diagonals(x, y)):
            if (chain[:, 1] - chain[:, 0]).sum() >= CHAIN_WORDS:
                covered |= (ends[:, 0] >= chain[0, 0]) & (ends[:, 1] + K <= chain[-1, 1])
                yield chain
        last = -1
        for pair in ends[~covered].tolist():
            if pair[0] >= last:  # pairs that begin within the one before are met by its alignment
                last = pair[1] + K
                yield np.array([[pair[0], pair[0] + K, pair[2], pair[2] + K], [pair[1], last, pair[3], pair[3] + K]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                here, there, kinds = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                step = lambda v: PAIR_STEPS[(v[kinds == 2] & ((1 << PAIR_BITS) - 1)) - 1]  # noqa: B023, E731
                x, y = here >> PAIR_BITS, there >> PAIR_BITS
                ends = np.column_stack([x[kinds == 2], x[kinds == 2] + step(here), y[kinds == 2], y[kinds == 2] + step(there)])
                long = lambda v: (v[kinds == 1][:, None] + _RUN_STEPS).ravel()  # noqa: B023, E731
                x, y = (np.concatenate([v[kinds == 0], long(v), ends[:, c], ends[:, c + 1]]) for v, c in ((x, 0), (y, 2)))
                order = np.argsort(y >> place_bits, kind="stable")
                x, y = x[order], y[order]
                other = y >> place_bits
                ends = ends[np.lexsort((ends[:, 0], ends[:, 2] >> place_bits))]
                owner = ends[:, 2] >> place_bits
                ends[:, 2:] &= mask
                cuts = np.append(np.flatnonzero(np.diff(other, prepend=-1)), len(other))
                bounds = np.searchsorted(owner, other[cuts[:-1]]), np.searchsorted(owner, other[cuts[:-1]], side="right")
                for lo, hi, left, right in zip(cuts[:-1].tolist(), cuts[1:].tolist(), *(b.tolist() for b in bounds)):
                    if (hi - lo - 1) * (WINDOW + K) + K < CHAIN_WORDS:  # too few matches for any chain
                        continue
                    out += [(doc, int(other[lo]), chain.astype("<i4").tobytes()) for chain in found(x[lo:hi], y[lo:hi] & mask, ends[left:right])]
            doc, other, chain = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(other, pa.int64()), pa.array(chain, pa.binary())], ["doc_id", "other_id", "chain"])

    return run


def aligned_parts(chain: np.ndarray, here: np.ndarray, there: np.ndarray, least: int, identity: float) -> Iterator[tuple[int, int, int, int, float]]:
    """The alignment of a chain if it is long and alike enough; else those of its two parts beside its widest gap."""
    waiting = [chain]
    while waiting:
        chain = waiting.pop()
        x0, x1, y0, y1, share = align(chain, here, there)
        if x1 - x0 < least:
            continue
        if share >= identity:
            yield x0, x1, y0, y1, share
        elif len(chain) > 1:
            gaps = np.abs(chain[1:, 0] - chain[:-1, 1]) + np.abs(chain[1:, 2] - chain[:-1, 3])
            cut = int(gaps.argmax()) + 1
            waiting += [chain[cut:], chain[:cut]]


def _aligned(least: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, other, chain, here, there in zip(*(c.to_pylist() for c in batch.columns)):
                here, there = np.frombuffer(here, "<u4"), np.frombuffer(there, "<u4")
                for x0, x1, y0, y1, share in aligned_parts(np.frombuffer(chain, "<i4").reshape(-1, 4).astype(np.int64), here, there, least, identity):
                    if doc != other or y0 < x0:
                        out.append((doc, other, x0, x1, y0, y1, share))
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 6 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "other_id", "start", "end", "other_start", "other_end", "identity"])

    return run


def repeated_passages(docs: DataFrame, least: int = PASSAGE_WORDS, identity: float = IDENTITY) -> DataFrame:
    """Passages that repeat earlier ones: ``doc_id``, ``other_id`` (a document that has it before), word bounds
    ``start``, ``end`` (excluded), ``other_start``, ``other_end``, and ``identity``.

    A passage has ``least`` words or more, of which a share ``identity`` or more agrees in order. Every exact repeat of
    RUN + RUN_WINDOW - 1 words or more is found, if not with every document that has it. Passages that repeat within one
    document are found as well. Exact copies of a document have one passage, the whole text. Null and empty texts, and
    rows without an id, have none. Repeated rows are one document; different texts of one id are documents of their own,
    in the order of the texts' hashes. Two passages of a document may overlap if their words occur first in two others.
    """
    bounded_batches(docs.sparkSession)
    narrow, ids, bits = _numbered_docs(docs)
    found = seeds(narrow, bits)  # made twice: cheaper than to keep all seeds on disk
    # written, so that the shuffles of both uses of the seeds are never on disk together, and Spark may split a seed of many rows in the join
    firsts = materialize(found.groupBy("h").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").select("h", "first"), "firsts")
    matches = found.join(firsts.hint("merge"), "h").filter("at > first")
    place = F.col("at").bitwiseAND(F.lit((1 << bits + PAIR_BITS) - 1).cast("long"))
    match = F.struct(place.alias("x"), F.col("first").alias("y"), F.col("h").bitwiseAND(F.lit(3)).cast("tinyint").alias("kind"))
    by_doc = matches.groupBy(F.shiftright("at", bits + PAIR_BITS).alias("doc_id")).agg(F.collect_list(match).alias("m"))
    chained = materialize(by_doc.select("doc_id", "m.x", "m.y", "m.kind").mapInArrow(_chained(bits), "doc_id bigint, other_id bigint, chain binary"), "chains")
    one = _words(narrow)
    here = chained.join(one.hint("merge"), chained.doc_id == one.id).select("doc_id", "other_id", "chain", F.col("words").alias("here"))
    again = one.withColumnsRenamed({"id": "id2", "words": "there"})
    both = here.join(again.hint("merge"), here.other_id == again.id2).select("doc_id", "other_id", "chain", "here", "there")
    kind = "doc_id bigint, other_id bigint, start bigint, end bigint, other_start bigint, other_end bigint, identity double"
    return _with_ids(both.mapInArrow(_aligned(least, identity), kind).distinct(), ids).select("doc_id", "other_id", "start", "end", "other_start", "other_end", "identity")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat earlier ones."""
    return repeated_passages(table(spark, sf_dir, "documents"))
