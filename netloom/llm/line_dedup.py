"""Line deduplication over a distributed suffix array of line numbers.

Every line that holds more than white space is a symbol; a document is a sequence of symbols, and a
suffix starts at each of its lines. Prefix doubling ranks suffixes by their first 1, 2, 4, ... lines:
each round ranks the pairs (rank here, rank 2^k lines on) of the round before, in order, by a range
partitioning of the distinct pairs. A suffix whose prefix occurs once has no neighbour that shares it
and leaves; so does one that is shorter than the prefix. Rounds go on until none is left.

Suffixes of equal rank are next to each other in the suffix array, with a longest common prefix of at
least the round's lines: an LCP interval. Its first suffix in document order is the first copy of a run,
the others start later copies. Intervals of ``min_lines`` lines delete; deeper ones lie within these, delete
the same lines, and tell how long the runs are: the longest run of a document is bounded by the last round
in which it has a later copy, and found between that round's length and twice as much by bisection, where
the prefix of any length l is the pair of ranks of its first and last 2^k lines. Lines of at least
``lone_words`` words also count as runs of one; their intervals are those of the first ranking.

DataFrame functions only. Hot lines cost a partial aggregation and a join that Spark may split. Joins are by merging: many small
tables broadcast one after the other, as they would be on a small corpus, cost the driver more memory than a large corpus does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import table

#: Shortest run, in lines, that counts as repeated; words from which a single line does, too.
MIN_LINES, LONE_WORDS = 2, 5

FILLED = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _sequences(docs: DataFrame, lone_words: int | None) -> DataFrame:
    """Lines with their place ``i`` in the document's sequence and 128 bits of hash; with ``lone_words``, whether they are ``long``."""
    long = lambda x: [] if lone_words is None else [x.rlike(rf"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{lone_words - 1}}}[^\x20\x09-\x0D]").alias("long")]
    symbols = F.filter(F.transform(_lines(F.col("text")), lambda x, n: F.when(x.rlike(FILLED), F.struct(n.alias("line"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2"), *long(x)))), lambda s: s.isNotNull())
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(symbols).alias("i", "s")).select("doc_id", "th", "i", "s.*")


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` occurs more than once, with its rank among all such in ``by`` order."""
    keys = rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)
    ranks = materialize(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    return rows.join(ranks.hint("merge"), by).drop(*by)


#: What names a suffix, in document order.
SUFFIX = ["doc_id", "th", "i"]


def _later(ranked: DataFrame, *by: str) -> DataFrame:
    """All suffixes of an interval (rows that agree in ``by``) but the first in document order."""
    firsts = ranked.groupBy(*by).agg(F.min(F.struct(*SUFFIX)).alias("first"))
    return ranked.join(firsts.hint("merge"), list(by)).filter(~F.struct(*SUFFIX).eqNullSafe(F.col("first"))).drop("first")


def _ahead(ranked: DataFrame, by: int) -> DataFrame:
    """Suffixes with the rank of the one ``by`` lines on, where there is one."""
    place = Window.partitionBy("doc_id", "th").orderBy(F.col("i").cast("long")).rangeBetween(by, by)
    return ranked.select(*SUFFIX, F.col("rank").alias("here"), F.max("rank").over(place).alias("next")).filter("next IS NOT NULL")


def _matched(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` where ``columns`` are equal, null ids included; each of them stands once."""
    b = b.withColumnsRenamed({c: f"__{c}" for c in columns})
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns))
    return a.join(b.hint("merge"), on, how).drop(*[f"__{c}" for c in columns])


def suffix_ranks(docs: DataFrame, lone_words: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Suffixes of repeated lines with their rank (and whether the line is ``long``), and those of each doubling round.

    Entry k of the list holds the suffixes whose first 2^k lines occur again: ``doc_id``, ``th``, ``i``, ``rank``.
    """
    lines = _ranked(_sequences(docs, lone_words), ["h1", "h2"])
    # rows that repeat are one document
    first = materialize(lines.repartition("doc_id", "th").dropDuplicates(SUFFIX), "suffixes")
    rounds, length = [first.select(*SUFFIX, "rank")], 1
    while rounds[-1].take(1):
        rounds.append(materialize(_ranked(_ahead(rounds[-1], length), ["here", "next"]), "suffixes"))
        length *= 2
    return first, rounds[: max(1, len(rounds) - 1)]


def later_copies(first: DataFrame, rounds: list[DataFrame], min_lines: int) -> DataFrame:
    """Lines that later copies of repeated runs cover: ``doc_id``, ``th`` (hash of the text), ``i``."""
    k = min_lines.bit_length() - 1
    if k >= len(rounds):
        starts = first.select(*SUFFIX).filter("false")
    elif min_lines == 1 << k:
        starts = _later(rounds[k], "rank")
    else:  # the first and the last 2^k lines of the run overlap
        starts = _later(_ahead(rounds[k], min_lines - (1 << k)), "here", "next")
    covered = starts.select("doc_id", "th", F.explode(F.sequence("i", F.col("i") + min_lines - 1)).alias("i"))
    if "long" in first.columns:
        covered = covered.unionByName(_later(first.filter("long"), "rank").select(*SUFFIX))
    return covered.distinct()


def longest_runs(rounds: list[DataFrame]) -> DataFrame:
    """``doc_id``, ``th``, ``longest``: lines of the longest run of each document that occurs before in document order.

    Runs of one line and documents without any are absent.
    """
    deep = [r.withColumn("k", F.lit(k)) for k, r in enumerate(rounds) if k] or [rounds[0].filter("false").withColumn("k", F.lit(1))]
    levels = materialize(reduce(DataFrame.unionByName, deep), "levels")  # one table, so that the plans below stay small
    later = materialize(_later(levels, "k", "rank").groupBy("doc_id", "th", "k", "rank").agg(F.count("*").alias("n")).drop("n"), "later")
    span = F.expr("shiftleft(1, k)")
    top = later.groupBy("doc_id", "th").agg(F.max("k").alias("k")).select("doc_id", "th", "k", span.alias("lo"), (2 * span - 1).alias("hi"))
    top = materialize(top, "longest")
    for _ in range(1, len(rounds)):
        if not top.filter("lo < hi").take(1):
            break
        asks = top.filter("lo < hi").select("doc_id", "th", "k", F.expr("(lo + hi + 1) div 2").cast("int").alias("ask"))
        wanted = _matched(later, asks, ["doc_id", "th", "k"]).select("k", "rank", "ask").distinct()
        starts = levels.join(wanted.hint("merge"), ["k", "rank"]).withColumn("at", F.expr("i + ask - shiftleft(1, k)"))
        ends = levels.select("doc_id", "th", "k", F.col("i").alias("at"), F.col("rank").alias("last"))
        runs = _matched(starts, ends, ["doc_id", "th", "k", "at"])
        hits = _later(runs, "k", "rank", "ask", "last").select("doc_id", "th", "ask", F.col("ask").alias("hit")).distinct()
        told = top.withColumn("ask", F.when(F.col("lo") < F.col("hi"), F.expr("(lo + hi + 1) div 2").cast("int")))
        told = _matched(told, hits, ["doc_id", "th", "ask"], "left")
        down = F.when(F.col("ask").isNotNull() & F.col("hit").isNull(), F.col("ask") - 1).otherwise(F.col("hi"))
        top = materialize(told.select("doc_id", "th", "k", F.coalesce("hit", "lo").alias("lo"), down.alias("hi")), "longest")
    return top.select("doc_id", "th", F.col("lo").alias("longest"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, lone_words: int | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated line runs (and of lines of ``lone_words`` words or more) deleted from ``text``.

    Copies are ordered by document id (null first), then hash of the text, then line; the first stays. Copies
    may overlap. All columns stay; ``n_chars``, if there is one, is counted anew. Added: ``n_lines`` (lines
    that hold more than white space), ``n_deleted`` of them, ``n_runs`` (stretches of deleted lines) and
    ``longest_run``: most lines in a row that occur in the same order before (0 if nothing is deleted). Blank lines
    take no part and stay, except that a text without any other line left becomes empty. A null text stays
    null with 0 lines; empty and blank texts are returned as they are. Equal rows get equal results and count as one document.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    if lone_words is not None and lone_words < 1:
        raise ValueError("lone_words must be 1 or more")
    first, rounds = suffix_ranks(docs, lone_words)
    gone = later_copies(first, rounds, min_lines).groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("i")).alias("__gone"))
    longest = longest_runs(rounds)
    gone = _matched(gone, longest, ["doc_id", "th"], "left")
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), "__gone", F.coalesce("longest", F.lit(1)).alias("__longest"))
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    rows = marked.join(gone.hint("merge"), marked["doc_id"].eqNullSafe(gone["__doc"]) & (marked["__hash"] == gone["__th"]), "left").drop("__doc", "__th", "__hash")
    none = F.array().cast("array<int>")
    rows = rows.withColumn("__gone", F.coalesce("__gone", none)).withColumn("__lines", _lines(F.col("text")))
    # places of the lines that take part, so that place i of the sequence is line __at[i]; sets of places are
    # compared by array_except, which hashes, so that a long text costs no more than its length
    rows = rows.withColumn("__at", F.coalesce(F.filter(F.transform("__lines", lambda x, n: F.when(x.rlike(FILLED), n)), lambda n: n.isNotNull()), none))
    rows = rows.withColumn("__dead", F.transform("__gone", lambda i: F.get("__at", i)))
    rows = rows.withColumn("__kept", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__dead"))
    kept = F.array_join(F.transform("__kept", lambda n: F.get("__lines", n)), "\n")
    text = F.when(F.size("__gone") == 0, F.col("text")).when(F.size("__gone") == F.size("__at"), F.lit("")).otherwise(kept)
    opens = F.array_except("__gone", F.transform("__gone", lambda i: i + 1))
    out = rows.withColumns({"text": text, "n_lines": F.size("__at"), "n_deleted": F.size("__gone"), "n_runs": F.size(opens), "longest_run": F.coalesce("__longest", F.lit(0))})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop("__gone", "__longest", "__lines", "__at", "__dead", "__kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every document."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), lone_words=LONE_WORDS)
    return done.select("doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


#: The rule straight from its definition: runs of any length, line by line longer.
OP7_SQL = rf"""
WITH RECURSIVE lines AS (
  SELECT doc_id, line, string_split(text, chr(10))[line + 1] AS l
  FROM documents, generate_series(0, len(string_split(text, chr(10))) - 1) AS g(line)
), filled AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS i
  FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), runs AS (
  SELECT doc_id, i, 1 AS length, key, nth FROM (
    SELECT doc_id, i, md5(l) AS key, row_number() OVER (PARTITION BY l ORDER BY doc_id, i) AS nth, count(*) OVER (PARTITION BY l) AS n FROM filled
  ) WHERE n > 1
  UNION ALL
  SELECT doc_id, i, length, key, nth FROM (
    SELECT doc_id, i, length, key, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nth, count(*) OVER (PARTITION BY key) AS n FROM (
      SELECT r.doc_id, r.i, r.length + 1 AS length, md5(r.key || md5(f.l)) AS key FROM runs r JOIN filled f ON f.doc_id = r.doc_id AND f.i = r.i + r.length)
  ) WHERE n > 1
), copies AS (
  SELECT r.* FROM runs r JOIN filled f USING (doc_id, i)
  WHERE nth > 1 AND (length >= {MIN_LINES} OR len(regexp_extract_all(f.l, '[^\x20\x09-\x0D]+')) >= {LONE_WORDS})
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + length)) AS i FROM copies WHERE length <= {MIN_LINES}),
stretches AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gone) GROUP BY doc_id
), dead AS (SELECT doc_id, line FROM filled JOIN gone USING (doc_id, i)),
kept AS (
  SELECT l.doc_id, string_agg(l, chr(10) ORDER BY l.line) AS text FROM lines l ANTI JOIN dead d ON l.doc_id = d.doc_id AND l.line = d.line GROUP BY l.doc_id
), sums AS (
  SELECT d.doc_id, d.text, coalesce(f.n, 0) AS n_lines, coalesce(g.n, 0) AS n_deleted, coalesce(r.n, 0) AS n_runs, coalesce(c.longest, 0) AS longest_run
  FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM filled GROUP BY 1) f USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g USING (doc_id)
  LEFT JOIN stretches r USING (doc_id)
  LEFT JOIN (SELECT doc_id, max(length) AS longest FROM copies GROUP BY 1) c USING (doc_id)
), texts AS (
  SELECT s.*, CASE WHEN n_deleted = 0 THEN s.text WHEN n_deleted = n_lines THEN '' ELSE k.text END AS kept FROM sums s LEFT JOIN kept k USING (doc_id)
)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_deleted AS INTEGER) AS n_deleted, CAST(n_runs AS INTEGER) AS n_runs,
  CAST(longest_run AS INTEGER) AS longest_run, length(kept) AS kept_chars, sha256(kept) AS kept_sha256
FROM texts
"""
