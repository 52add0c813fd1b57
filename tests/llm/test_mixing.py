from collections import defaultdict

from oracle import compare
from pyspark.sql import functions as F

from netloom.llm import mixing


def test_query(spark):
    compare(spark, mixing.op9_mixing, mixing.OP9_SQL)


def fill(sizes, weights):
    """Targets straight from the rule: share, stop at three times, share the excess anew."""
    target, open_ = {}, set(sizes)
    left = sum(sizes.values())
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > 3 * sizes[s]}
        if not full:
            return target | {s: unit * weights[s] for s in open_}
        for s in full:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


ROWS = [(i, " ".join(f"{s}{i}_{j}" for j in range(i % 7 * 40)), s, "x") for i, s in enumerate(["a", "b", "c", "d", "a", "a", None] * 30)]
ROWS += [(900, None, "a", "x"), (901, " \n", "b", "x"), (5, ROWS[5][1], "a", "x"), (None, "no id here", "e", "x"), (902, "w " * 50_000, "a", "x")]
SCHEMA = "doc_id long, text string, source string, sid string"


def test_targets_and_totals(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = mixing.mix_counts(docs, block_words=8).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    assert len(got) == len(ROWS)
    sizes = defaultdict(int)
    for _, t, s, _ in ROWS:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        source = r.source if r.doc_id is not None else "e"
        assert abs(r.target - want[source]) < 1e-6 and r.source_size == sizes[source]
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 3 * 8 for s in sizes)


def test_sources_of_the_query_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    rows = mixing.op9_mixing(spark, "/root/testdata/sf0.01").join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert len(rows) > 3 and all(abs(r.t - r.w) <= 0.05 * r.w for r in rows)


def test_documents_agree_with_counts(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    counts = {}
    for r in mixing.mix_counts(docs, block_words=8).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.taken
    mixed = mixing.mix_documents(docs, block_words=8).collect()
    words = defaultdict(list)
    for r in mixed:
        words[r.doc_id] += r.text.split()
        own = next(t for i, t, s, _ in ROWS if i == r.doc_id).split()
        at = 0
        for w in r.text.split()[:200]:  # the words of a pass keep their order
            at = own.index(w, at) + (w != "w")
    assert {d: len(w) for d, w in words.items()} == {d: n for d, n in counts.items() if n}


def test_permutation_takes_each_block_once(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    _, _, draws = mixing._planned(docs, (5, 2, 1), 3, 8, 64, 10)
    rows = draws.groupBy("sid", "pass", "block").count().filter(F.col("count") > 1).count()
    assert rows == 0


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_counts(docs).collect() == []
    assert mixing.mix_documents(docs).collect() == []
