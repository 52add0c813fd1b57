"""Mixing sources to target weights.

The words of each source, document after document, are packed into blocks of fixed length. Output shards
have a fixed number of slots; every slot draws its source at random in proportion to the blocks that the
source's target needs, so that a shard's counts are multinomial. What a source draws in all would miss its target
by chance; its counts are therefore scaled, through all shards, to the blocks that the target needs (by cumulative
rounding, so that a shard changes by a slot or so for each of its sources, and totals are exact). The slots of a source, counted through
all shards, walk through pseudorandom permutations of its block numbers, a new one for each pass: no block
comes twice before all have come once. Slots and blocks then meet by (source, block number).

The permutation is the swap-or-not shuffle (Hoang, Morris, Rogaway 2012), which needs no table. Prefix sums
over documents go in two levels, so that no window holds a whole source. DataFrame functions only, no state
but the data: reruns agree. Draws hash with md5, which other engines have too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import named, table

#: Weights by the order of sources, passes over a source at most.
WEIGHTS, MOST_PASSES = (5, 2, 1), 3
#: Words in a block, slots in an output shard, rounds of the permutation, cells of the source lookup.
BLOCK_WORDS, SHARD_SLOTS, ROUNDS, CELLS = 64, 4096, 10, 1024
#: Slots that one task permutes, about; shards whose numbers one task sums up.
SLOTS_PER_TASK, SHARDS_A_PART = 100_000, 1024
#: Hex digits of md5(id) that make the first level of the order of documents in a source.
CHUNK_DIGITS = 3

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def _draw(*parts) -> Column:
    """60 pseudorandom bits of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])), 1, 15), 16, 10).cast("bigint")


def count_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, SPACE))).cast("bigint")


def plan_sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: ``sid`` (its place by code point, null last), ``source_size``, ``target`` and
    what drawing needs: ``n_blocks``, ``share`` (blocks to take) and its interval [``lo``, ``hi``) of all blocks taken.

    All sizes together are shared by weight; where a source would get more than ``most_passes`` times its
    size it gets that, and the rest is shared among the others, until none is above. Windows here run over
    sources, of which there is one row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("sid") % len(weights)).cast("bigint")).withColumn("cap", F.col("source_size") * most_passes)
    tightest = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything, earlier = tightest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), tightest.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"total": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "cap_before": F.coalesce(F.sum("cap").over(earlier), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(earlier), F.lit(0))})
    s = s.withColumn("capped", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")) > F.col("cap") / F.col("weight"))
    taken = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0)).over(everything)
    s = s.withColumns({"rest": F.col("total") - taken("cap"), "rest_weight": F.col("all_weight") - taken("weight")})
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.try_divide("rest", "rest_weight") * F.col("weight")))
    s = s.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words).cast("bigint"))
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("bigint")
    s = s.withColumn("share", share).withColumn("hi", F.sum("share").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
    return s.withColumn("lo", F.col("hi") - F.col("share")).select("source", "sid", "source_size", "target", "n_blocks", "share", "lo", "hi")


def _lay_out(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's first word in its source: ``start``. Order: chunk of the id's md5 (without an id: the text's), id, hash of the text."""
    named = sources.select(F.col("source").alias("__source"), "sid")
    rows = sized.join(named, sized["source"].eqNullSafe(named["__source"])).drop("__source")
    rows = rows.withColumn("chunk", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("th").cast("string"))), 1, CHUNK_DIGITS))
    chunks = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "chunk").orderBy("doc_id", "th").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("size").over(within)).join(chunks, ["sid", "chunk"])
    return rows.select("doc_id", "source", "th", "sid", "size", (F.col("base") + F.col("end") - F.col("size")).alias("start"))


def _draws(sources: DataFrame, shard_slots: int, rounds: int, most_passes: int) -> DataFrame:
    """One row per filled slot: ``sid``, ``shard``, ``pass`` and ``block``."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("share")).first()[0] or 0
    cells = sources.filter("share > 0").select("sid", "lo", "hi", F.explode(F.expr(f"sequence(lo * {CELLS} div {max(total, 1)}, (hi - 1) * {CELLS} div {max(total, 1)})")).alias("cell"))
    slots = spark.range(total).select(F.expr(f"id div {shard_slots}").alias("shard"), (_draw("slot", F.col("id").cast("string")) % max(total, 1)).alias("r"))
    chosen = slots.withColumn("cell", F.expr(f"r * {CELLS} div {max(total, 1)}")).join(cells, "cell").filter("r >= lo AND r < hi")
    counts = chosen.groupBy("sid", "shard").agg(F.count("*").alias("n"))
    # a source that draws nothing at all has its blocks in the first shard
    counts = sources.filter("share > 0").select("sid", "share").join(counts, "sid", "left").fillna({"shard": 0, "n": 1})
    # numbers of a source through all shards in two levels, so that no window holds them all
    counts = materialize(counts.withColumn("part", F.expr(f"shard div {SHARDS_A_PART}")), "counts")
    parts = counts.groupBy("sid", "part").agg(F.sum("n").alias("k"))
    through = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("sid", "part", F.coalesce(F.sum("k").over(through), F.lit(0)).alias("base"), F.sum("k").over(Window.partitionBy("sid")).alias("drawn"))
    upto = F.sum("n").over(Window.partitionBy("sid", "part").orderBy("shard"))
    counts = counts.withColumn("upto", upto).join(parts, ["sid", "part"]).withColumn("upto", F.col("base") + F.col("upto"))
    scaled = lambda upto: F.expr(f"CAST(share AS DECIMAL(19, 0)) * CAST({upto} AS DECIMAL(19, 0)) div drawn")
    counts = counts.select("sid", "shard", scaled("upto - n").alias("offset"), (scaled("upto") - scaled("upto - n")).alias("n")).filter("n > 0")
    name = lambda p: F.array(*[_draw("key", F.col("sid").cast("string"), str(p), str(i)) for i in range(rounds)])
    keyed = sources.select("sid", "n_blocks", F.array(*[name(p) for p in range(most_passes)]).alias("keys"))
    # few rows here make many slots: deal them to tasks of about SLOTS_PER_TASK
    parts = max(1, min(100_000, total // SLOTS_PER_TASK))
    rows = counts.join(keyed, "sid").repartition(parts, "sid", "shard").select("sid", "shard", "n_blocks", "keys", F.explode(F.expr("sequence(offset, offset + n - 1)")).alias("k"))
    rows = rows.withColumn("pass", F.expr("k div n_blocks"))

    def swap(x: Column, key: Column) -> Column:
        partner = (key % F.col("n_blocks") + F.col("n_blocks") - x) % F.col("n_blocks")
        return F.when(_draw("bit", key.cast("string"), F.greatest(x, partner).cast("string")) % 2 == 1, partner).otherwise(x)

    block = F.aggregate(F.get("keys", F.col("pass").cast("int")), F.col("k") % F.col("n_blocks"), swap)
    return rows.select("sid", "shard", "pass", block.alias("block"))


def _segments(laid: DataFrame, block_words: int) -> DataFrame:
    """Pieces of documents by block: words [``from``, ``to``) of the document that starts at ``start``."""
    b = block_words
    rows = laid.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
    return rows.select("sid", "block", "start", "doc_id", "source", "th", F.expr(f"greatest(start, block * {b}) - start").alias("from"), F.expr(f"least(start + size, (block + 1) * {b}) - start").alias("to"))


def _planned(docs: DataFrame, weights, most_passes, block_words, shard_slots, rounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized = materialize(docs.select("doc_id", "source", F.xxhash64("text").alias("th"), count_words(F.col("text")).alias("size")), "sizes")
    sources = materialize(plan_sources(sized, weights, most_passes, block_words), "sources")
    draws = materialize(_draws(sources, shard_slots, rounds, most_passes), "draws")  # also keeps the optimiser off the long block expression
    return sources, _lay_out(sized, sources), draws


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, rounds: int = ROUNDS) -> DataFrame:
    """What the mix takes of every row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    Null and blank texts have size 0 and nothing taken; a null source is a source, the last one. Repeated
    rows are documents of their own. ``taken`` is at most ``most_passes`` times ``size``. Only ``doc_id``,
    ``text`` and ``source`` are read.
    """
    sources, laid, draws = _planned(docs, weights, most_passes, block_words, shard_slots, rounds)
    times = draws.groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = _segments(laid, block_words).join(times, ["sid", "block"]).groupBy("sid", "start").agg(F.sum(F.expr("times * (`to` - `from`)")).alias("taken"))
    rows = laid.join(taken, ["sid", "start"], "left").join(sources.select("sid", "source_size", "target"), "sid")
    return rows.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, rounds: int = ROUNDS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each document and pass that takes any of it.

    ``text`` holds the words taken in that pass, in order, each with the white space after it; ``n_chars``,
    if there is one, is counted anew. A document taken whole three times has three rows. Rows of ``docs``
    that repeat (same id, source and text) share their other columns: those of the row with the smallest hash of all.
    """
    _, laid, draws = _planned(docs, weights, most_passes, block_words, shard_slots, rounds)
    pieces = _segments(laid, block_words).join(draws.select("sid", "block", "pass"), ["sid", "block"])
    piece = F.struct(F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to"))
    passes = pieces.groupBy("doc_id", "source", "th", "start", "pass").agg(F.sort_array(F.collect_list(piece)).alias("__pieces"))
    passes = passes.groupBy("doc_id", "source", "th").agg(F.collect_list("__pieces").alias("__passes"))
    passes = passes.select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("th").alias("__th"), "__passes")
    one = F.min_by(F.struct(*named(docs.columns)), F.xxhash64(*named(docs.columns))).alias("__row")
    single = docs.groupBy("doc_id", "source", F.xxhash64("text").alias("__hash")).agg(one).select("__row.*", "__hash")
    rows = single.join(passes, single["doc_id"].eqNullSafe(passes["__doc"]) & single["source"].eqNullSafe(passes["__source"]) & (single["__hash"] == passes["__th"]))
    rows = rows.withColumn("__words", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1)))
    rows = rows.select(*named(docs.columns), "__words", F.explode("__passes").alias("__pieces"))
    text = F.array_join(F.transform("__pieces", lambda p: F.array_join(F.slice("__words", p["from"] + 1, p["to"] - p["from"]), "")), "")
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*named(docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return mix_counts(table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    """The same mix in DuckDB's SQL."""
    draw = lambda text: f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
    steps, last = "", "p0"
    for i in range(ROUNDS):
        key = draw(f"'key:' || sid || ':' || pass || ':{i}'")
        steps += f""", p{i + 1} AS MATERIALIZED (
  SELECT sid, shard, pass, n_blocks, CASE WHEN {draw("'bit:' || key || ':' || greatest(x, y)")} % 2 = 1 THEN y ELSE x END AS x
  FROM (SELECT *, (key % n_blocks + n_blocks - x) % n_blocks AS y FROM (SELECT *, {key} AS key FROM p{i})))"""
        last = f"p{i + 1}"
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), named AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][sid % {len(WEIGHTS)} + 1] AS weight, {MOST_PASSES} * source_size AS cap FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source)
), filling AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM named
), capping AS (
  SELECT *, (total - cap_before) / (all_weight - weight_before) > cap / weight AS capped FROM filling
), targets AS (
  SELECT source, sid, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / (all_weight - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ()) * weight END AS target,
    CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT) AS n_blocks FROM capping
), shares AS (
  SELECT *, CAST(sum(share) OVER (ORDER BY sid) AS BIGINT) AS hi FROM (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target * n_blocks / source_size + 0.5) AS BIGINT) ELSE 0 END AS share FROM targets)
), size_of AS (SELECT CAST(sum(share) AS BIGINT) AS total FROM shares),
slots AS (
  SELECT id // {SHARD_SLOTS} AS shard, {draw("'slot:' || id")} % total AS r FROM size_of, range(total) AS g(id)
), drawn AS (
  SELECT sid, shard, count(*) AS n FROM slots JOIN shares ON r >= hi - share AND r < hi GROUP BY sid, shard
), running AS (
  SELECT sid, share, CAST(sum(n) OVER (PARTITION BY sid ORDER BY shard) AS BIGINT) AS upto, n, CAST(sum(n) OVER (PARTITION BY sid) AS BIGINT) AS drawn, shard FROM (
    SELECT s.sid, s.share, coalesce(d.shard, 0) AS shard, coalesce(d.n, 1) AS n FROM shares s LEFT JOIN drawn d USING (sid) WHERE s.share > 0)
), numbered AS (
  SELECT sid, shard, unnest(range(CAST(CAST(share AS HUGEINT) * (upto - n) // drawn AS BIGINT), CAST(CAST(share AS HUGEINT) * upto // drawn AS BIGINT))) AS k FROM running
), p0 AS MATERIALIZED (
  SELECT sid, shard, k // n_blocks AS pass, n_blocks, k % n_blocks AS x FROM numbered JOIN shares USING (sid)
){steps}, times AS (SELECT sid, x AS block, count(*) AS times FROM {last} GROUP BY sid, x),
laid AS (
  SELECT doc_id, sid, size, source_size, target, coalesce(CAST(sum(size) OVER (PARTITION BY sid ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, {CHUNK_DIGITS}), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM sized JOIN shares ON sized.source IS NOT DISTINCT FROM shares.source
), pieces AS (
  SELECT sid, doc_id, start, size, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM laid WHERE size > 0
), taken AS (
  SELECT doc_id, sum(times * (least(start + size, (block + 1) * {BLOCK_WORDS}) - greatest(start, block * {BLOCK_WORDS}))) AS taken
  FROM pieces JOIN times USING (sid, block) GROUP BY doc_id
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM laid LEFT JOIN taken USING (doc_id)
"""


OP9_SQL = _op9_sql()
