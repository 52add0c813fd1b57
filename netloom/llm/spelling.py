"""Spelling variants: words of a vocabulary at one inserted, deleted or replaced letter, found by FM-index search schemes.

Of two words that differ by one letter one half of the shorter word stands in both, at the start or at the end.
So a search matches one half exactly and goes on across the other, where it may take one error. Both schemes run on the FM-index of
a delimited list of words (``$word$word$``): an interval of suffix ranks stands for all places that a pattern has, and one step extends
the pattern by a letter. Steps go to the left; for the scheme that goes to the right (left half exact) the index is that of the reversed
words. As each scheme extends one way only, the interval of the other direction is never needed. All words of a list are
searched together, one letter at a time.

The vocabulary is split so that every search finds its matches in its own list: words of ``band`` letters, and of one more, meet
by band and half. Small halves share a list of about ``LIST_WORDS`` words; a half that more words share is cut into several
lists, each of which is searched for all words of that half.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .common import bounded_batches, steps, table, words_of

#: Letters of a word at least, occurrences at least; how much more frequent a form is than its variant.
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: A run whose hash this number divides loses a letter.
NOISE = 31
#: Words of one index, letters of one index at most (but for a single longer word), rows that one task searches, about.
LIST_WORDS, LIST_LETTERS, TASK_ROWS = 32_768, 2 << 20, 65_536

NO_LETTERS = "[^a-zÀ-ÿ]+"


def _count_step(ids: list, texts: pa.Array) -> tuple[list[str], list[int]]:
    """Words of some documents and how often they occur."""
    rows, words = words_of(pc.ascii_lower(pc.fill_null(texts, "")), NO_LETTERS, lower=False)
    codes = words.dictionary_encode()
    letters = pc.utf8_length(codes.dictionary).to_numpy(zero_copy_only=False)
    at = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = letters[at] >= LEAST_LETTERS if len(at) else np.empty(0, bool)
    n_words = max(len(letters), 1)
    pairs, counts = np.unique(rows[keep] * n_words + at[keep], return_counts=True)
    doc, word = np.divmod(pairs, n_words)
    names = codes.dictionary.to_pylist()
    raw = [w.encode() for w in names]
    starts = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids]
    crcs = np.fromiter((zlib.crc32(raw[w], starts[d]) for d, w in zip(doc.tolist(), word.tolist())), np.int64, len(pairs))
    hit = crcs % NOISE == 0
    whole = np.bincount(word[~hit], counts[~hit], len(names)).astype(np.int64)
    found = {names[w]: int(whole[w]) for w in np.flatnonzero(whole)}
    for w, h, n in zip(word[hit].tolist(), crcs[hit].tolist(), counts[hit].tolist()):
        if letters[w] > LEAST_LETTERS:
            cut = h % int(letters[w])
            name = names[w][:cut] + names[w][cut + 1 :]
            found[name] = found.get(name, 0) + n
    return list(found), list(found.values())


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of all words of ``LEAST_LETTERS`` letters or more that occur ``LEAST_COUNT`` times or more.

    Words are the maximal runs of letters of whole texts, A-Z lower-cased. A run loses a letter if ``NOISE`` divides the crc32 h of
    ``<doc_id>:<run>`` (a null id is empty): the one at h modulo its length. Null texts have no words.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            words, counts = _count_step(batch.column(0).to_pylist(), batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class FmIndex:
    """Suffix ranks of ``$word$word$...``: ``step`` puts a letter in front of patterns given by their rank intervals."""

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.letters, codes = np.unique(text, return_inverse=True)  # code 0 is the delimiter
        self.n = n = len(codes)
        self.suffixes = self._sorted(codes.astype(np.int64), max(map(len, words)) + 4)
        self.last = codes[self.suffixes - 1].astype(np.int64)  # the letter in front of each suffix
        self.places = np.sort(self.last * n + np.arange(n))
        self.starts = np.flatnonzero(codes == 0)[:-1]

    @staticmethod
    def _sorted(rank: np.ndarray, longest: int) -> np.ndarray:
        """Suffixes in the order of their first ``longest`` letters at least, by prefix doubling."""
        n, length = len(rank), 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - length, 0)] = rank[length:] + 1
            key = rank * (n + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
            rank[order] = new
            length *= 2
            if length >= longest or new[-1] == n - 1:
                return order

    def codes(self, letters: np.ndarray) -> np.ndarray:
        """Codes of letters; a letter that no word has gets one of its own."""
        at = np.minimum(np.searchsorted(self.letters, letters), len(self.letters) - 1)
        return np.where(self.letters[at] == letters, at, len(self.letters))

    def step(self, lo: np.ndarray, hi: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.places, code * self.n + lo), np.searchsorted(self.places, code * self.n + hi)

    def in_front(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the interval, code) of the letters that stand in front of each interval's suffixes; delimiters left out."""
        few = hi - lo <= len(self.letters)
        at, size = np.flatnonzero(few), (hi - lo)[few]
        owner = np.repeat(at, size)
        code = self.last[np.repeat(lo[few] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        owner, code = np.divmod(np.unique(owner * len(self.letters) + code), len(self.letters))
        many = np.flatnonzero(~few)
        owner = np.concatenate([owner, np.repeat(many, len(self.letters))])
        code = np.concatenate([code, np.tile(np.arange(len(self.letters)), len(many))])
        return owner[code > 0], code[code > 0]


def _once(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty intervals, each once for a query."""
    keep = hi > lo
    q, lo, hi = q[keep], lo[keep], hi[keep]
    order = np.lexsort((hi, lo, q))
    q, lo, hi = q[order], lo[order], hi[order]
    first = np.ones(len(q), bool)
    first[1:] = (np.diff(q) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)
    return q[first], lo[first], hi[first]


def search(index: FmIndex, queries: list[str], band: int, exact: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word of the index) at one error that agree in their last ``exact`` letters.

    Queries have ``band`` letters (matched with words as long, or one longer) or one more (matched with words one shorter).
    """
    sizes = np.array([len(w) for w in queries])
    letters = np.frombuffer("".join(w[::-1].ljust(band + 1, "\0") for w in queries).encode("utf-32-le"), np.uint32).reshape(-1, band + 1)
    codes = index.codes(letters)
    q = np.arange(len(queries))
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(index.starts) + 1)  # suffixes that start with a delimiter
    for t in range(exact):
        lo, hi = index.step(lo, hi, codes[q, t])
        keep = hi > lo
        q, lo, hi = q[keep], lo[keep], hi[keep]
    none = np.empty(0, np.int64)
    eq, elo, ehi = none, none, none  # patterns that have had their error
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for t in range(exact, band + 1):
        found = [(eq, *index.step(elo, ehi, codes[eq, t]))]
        long = sizes[q] > band
        found.append((q[long], lo[long], hi[long]))  # the query has a letter too many
        short = np.flatnonzero(~long)
        owner, code = index.in_front(lo[short], hi[short])
        own = short[owner]
        blo, bhi = index.step(lo[own], hi[own], code)
        found.append((q[own], *index.step(blo, bhi, codes[q[own], t])))  # it lacks one
        if t == band:  # past the last letter of the queries of ``band`` letters: the letter lacks in front of all
            done.append((q[own], blo, bhi))
        else:
            other = code != codes[q[own], t]
            found.append((q[own][other], blo[other], bhi[other]))  # it has another one
        eq, elo, ehi = _once(*(np.concatenate(x) for x in zip(*found)))
        if t + 1 == band:
            ended = sizes[eq] == band
            done.append((eq[ended], elo[ended], ehi[ended]))
            eq, elo, ehi = eq[~ended], elo[~ended], ehi[~ended]
        lo, hi = (lo, hi) if t == band else index.step(lo, hi, codes[q, t])
        keep = hi > lo
        q, lo, hi = q[keep], lo[keep], hi[keep]
    done.append((eq[sizes[eq] > band], elo[sizes[eq] > band], ehi[sizes[eq] > band]))
    q, lo, hi = _once(*(np.concatenate(x) for x in zip(*done)))
    lo, hi = index.step(lo, hi, np.zeros(len(q), np.int64))
    keep = hi > lo
    return q[keep], np.searchsorted(index.starts, index.suffixes[lo[keep]])


class WordList:
    """Words of one band and side under one index, searched for queries."""

    def __init__(self, side: int, band: int, words: list[str], counts: list[int]):
        self.side, self.band = side, band
        self.words, self.counts = words, np.array(counts, np.int64)
        self.turn = (lambda w: w[::-1]) if side == 0 else (lambda w: w)
        self.index = FmIndex([self.turn(w) for w in words])
        order = sorted(range(len(words)), key=words.__getitem__)
        self.place = np.empty(len(words), np.int64)
        self.place[order] = np.arange(len(words))

    def near(self, queries: list[str]) -> pa.RecordBatch:
        """Queries that have near words here, with their number and the most frequent one."""
        half = self.band // 2
        q, v = search(self.index, [self.turn(w) for w in queries], self.band, half if self.side == 0 else self.band - half)
        if self.side:  # pairs that agree in both halves count where the first halves meet
            own = np.fromiter((queries[a][:half] != self.words[b][:half] for a, b in zip(q.tolist(), v.tolist())), bool, len(q))
            q, v = q[own], v[own]
        order = np.lexsort((self.place[v], -self.counts[v], q))
        q, v = q[order], v[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        n_near = np.diff([*first, len(q)])
        columns = [pa.array([queries[i] for i in q[first]], pa.string()), pa.array(n_near, pa.int64()), pa.array(self.counts[v[first]], pa.int64()), pa.array([self.words[i] for i in v[first]], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (side, band, half, part, indexed, word, n) in that order, indexed ones of a part first."""
    at, last, words, counts, letters, built = None, None, [], [], 0, None

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal words, counts, letters, built
        if len(words) > 1 or built:
            yield (built or WordList(*at, words, counts)).near(words)
        words, counts, letters, built = [], [], 0, None

    for batch in batches:
        keys = np.column_stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("side", "band", "half", "part", "indexed")])
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            side, band, half, part, indexed = keys[lo].tolist()
            own = batch.column("word").slice(lo, hi - lo).to_pylist()
            if indexed:
                if (side, band) != at or (half, part) != last and (built or len(words) >= LIST_WORDS or letters >= LIST_LETTERS):
                    yield from closed()
                at, last = (side, band), (half, part)
                words += own
                counts += batch.column("n").slice(lo, hi - lo).to_pylist()
                letters += sum(map(len, own))
            elif (side, band) == at and (half, part) == last:  # words of the same half that another list holds
                built = built or WordList(*at, words, counts)
                yield built.near(own)
    yield from closed()


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """``word``, ``n_near``, ``best_n``, ``best`` of the words (``word``, ``n``) that have a near one."""
    size = F.length("word")
    band = F.explode(F.array_distinct(F.array(F.greatest(size - 1, F.lit(LEAST_LETTERS)), size))).alias("band")
    rows = words.select("word", "n", band)
    half = F.floor(F.col("band") / 2).cast("int")
    ends = F.array(F.struct(F.lit(0).alias("side"), F.xxhash64(F.substring("word", 1, half)).alias("half")), F.struct(F.lit(1).alias("side"), F.xxhash64(F.right("word", F.col("band") - half)).alias("half")))
    rows = materialize(rows.select("word", "n", "band", F.explode(ends).alias("end")).select("end.side", "band", "end.half", "word", "n"), "halves")
    shared = rows.groupBy("side", "band", "half").agg(F.count("*").alias("size")).filter("size > 1")
    parts = F.ceil(F.col("size") / list_words).cast("int")
    dealt = rows.join(shared, ["side", "band", "half"]).withColumn("own", F.pmod(F.xxhash64(F.lit("list"), "word"), parts).cast("int"))
    dealt = dealt.select("side", "band", "half", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "own", "word", "n")
    dealt = dealt.select("side", "band", "half", "part", (F.col("own") == F.col("part")).cast("int").alias("indexed"), "word", "n")
    tasks = max(1, min(100_000, -(-rows.count() // TASK_ROWS)))
    order = [F.col("side"), F.col("band"), F.col("half"), F.col("part"), F.col("indexed").desc()]
    dealt = dealt.repartition(tasks, "side", "band", "half", "part").sortWithinPartitions(*order)
    found = dealt.mapInArrow(_searched, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("first.m")).alias("best_n"), F.col("first.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the end of each chain of ``forms`` (word, root). Chains double in each round; a form is ``RATIO`` times as
    frequent as its word, so that five rounds reach the end of any.
    """
    forms = materialize(forms, "forms")
    while True:
        ahead = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(forms.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "forms")
        discard(forms)
        forms = longer.select("word", "root")
        if not longer.filter("next IS NOT NULL").take(1):
            return forms


def group_variants(words: DataFrame, ratio: int = RATIO, list_words: int = LIST_WORDS) -> DataFrame:
    """Every word of a vocabulary (``word`` of ``LEAST_LETTERS`` letters or more, each once, and its count ``n``) with its ``form``, ``root``,
    ``n``, ``n_near`` and ``form_n``.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. The form is the near word of
    largest ``n`` (ties: smallest in code-point order) if that is ``ratio`` times the word's or more, else null; the root ends the
    chain of forms. ``n_near`` is the number of near words. An empty table gives an empty result.
    """
    words = materialize(words.select("word", "n"), "vocabulary")
    own = F.col("best_n") >= ratio * F.col("n")
    rows = words.join(near_words(words, list_words), "word", "left")
    rows = materialize(rows.select("word", F.when(own, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(own, F.col("best_n")).alias("form_n")), "near")
    roots = _roots(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return group_variants(count_words(table(spark, sf_dir, "documents")))
