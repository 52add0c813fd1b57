import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from netloom.llm import language, quality
from netloom.llm.common import held_out

SF = "/root/testdata/sf0.001"


def test_language_held_out_accuracy(spark):
    got = language.op2_language_id(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_backoff_against_definition():
    rng = random.Random(1)
    logs = lambda n: np.log(np.random.default_rng(n).random((n, 2)))
    grams = {k: {"".join(rng.choice("abc^$") for _ in range(k)): 0 for _ in range(6 * k)} for k in (1, 2, 3)}
    grams = {k: {g: i for i, g in enumerate(v)} for k, v in grams.items()}
    model = language.LanguageModel(["x", "y"], {"ab": 0, "c": 1}, logs(2), grams, {k: logs(len(v)) for k, v in grams.items()})
    words = ["ab", "c", "zzz", ""] + ["".join(rng.choice("abcz") for _ in range(rng.randrange(6))) for _ in range(200)]
    for word, got in zip(words, model.score(words)):
        want = model.word_logs[model.words[word]] if word in model.words else np.zeros(2)
        if word not in model.words:
            for k in (3, 2, 1):
                whole = f"^{word}$"
                found = [model.gram_logs[k][grams[k][whole[i : i + k]]] for i in range(len(whole) - k + 1) if whole[i : i + k] in grams[k]]
                if found:
                    want = np.mean(found, axis=0)
                    break
        np.testing.assert_allclose(got, want)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the house is big", "en"), (2, "la casa es grande", "es"), (3, "the", None), (4, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !? ", "q"), (4, "the", "q"), (4, "the", "q"), (None, "CASA " * 50_000, "q")], "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred, r.score > 0.5) for r in language.predict(odd, model, ["doc_id", "score"]).collect()]
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True), (None, "es", True)]
    none = language.fit(docs.filter("false"))
    assert {r.lang_pred for r in language.predict(odd, none, ["doc_id"]).collect()} == {"und"}
    assert language.predict(odd.filter("false"), model, ["doc_id"]).collect() == []


def test_features_are_unit_vectors():
    row, bucket, value = quality.features(pa.array(["a b c", None, "x", "", "a a a a $$$", "w " * 100_000]))
    n = {0: 3 + 2 + 2, 2: 1, 4: 5 + 4 + 4, 5: 100_000 + 2 * 99_999}
    for r in n:
        own = (row == r) & (bucket != quality.REPEATS)
        assert abs((value[own] ** 2).sum() - 1) < 1e-9
    assert set(row.tolist()) == set(n)


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.op3_quality(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.predicted == (r.score >= 0.3) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    pairs = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    good, bad = ([s for s, q in pairs if q == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9


def test_quality_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, quality int")
    weights = quality.fit(empty)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (3, " \n"), (None, "a " * 100_000)], "doc_id long, text string")
    assert [r.score for r in quality.score(odd, weights, ["doc_id"]).collect()] == [0.5] * 5
    assert quality.score(odd.filter("false"), weights, ["doc_id"]).collect() == []


def test_held_out(spark):
    import zlib

    rows = spark.range(50).withColumn("h", held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def plain_features(text):
    """Value of every bucket of a text, one n-gram at a time."""
    import math
    import re
    from collections import Counter

    import pandas as pd

    words = re.sub(r"([^\w\s]|_)+", lambda m: f" {m[0]} ", text).split()
    if not words:
        return {}
    full = (1 << 64) - 1
    mix = 0x9E3779B97F4A7C15
    h = [int(x) for x in pd.util.hash_array(np.array(words, object))]

    def shape(w):
        if not any(c.isalnum() for c in w):
            return 1
        if w.isdigit():
            return 2
        return 3 if len(w) > 1 and w.isupper() else 4 if w[0].isupper() else 0

    raw = h + [(a * mix + b) & full for a, b in zip(h, h[1:])] + [shape(a) * 8 + shape(b) + 1000 for a, b in zip(words, words[1:])]
    counts = Counter((((x * mix & full) ^ (x >> 29)) * mix & full) >> 64 - quality.BUCKET_BITS for x in raw)
    out = {b: math.sqrt(n / len(raw)) for b, n in counts.items()}
    return out | {quality.REPEATS: math.sqrt(1 - len(set(words)) / len(words))}


TEXTS = ["The cat, the CAT and 12 dogs!! ran", "a a a a $$$ buy now", "Il pleut. Il pleut 3 fois", "one", "UP up Up 9 9"]


def test_features_one_by_one():
    row, bucket, value = quality.features(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        got = {}
        for b, v in zip(bucket[row == i].tolist(), value[row == i].tolist()):
            got[b] = v
        want = plain_features(text)
        assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-12 for b in want)


def test_ftrl_one_by_one(spark):
    """One shard and two passes against FTRL-Proximal written out bucket by bucket; then averaged shards, and the scores."""
    import math

    rows = [(i, TEXTS[i % 5] + f" w{i % 3}", int(i % 5 in (0, 2))) for i in range(40)] + [(99, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").coalesce(1)
    alpha, beta, l1, l2 = quality.Ftrl.alpha, quality.Ftrl.beta, quality.Ftrl.l1, quality.Ftrl.l2

    def weight(z, n):
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)

    def one_pass(state, examples, turn):
        z, n = (dict(s) for s in state)
        for k in np.random.default_rng(turn).permutation(len(examples)):
            text, y = examples[k]
            x = {b: float(np.float32(v)) for b, v in plain_features(text).items()} | {"bias": 1.0}
            w = {b: weight(z.get(b, 0.0), n.get(b, 0.0)) for b in x}
            g = 1 / (1 + math.exp(-sum(w[b] * v for b, v in x.items()))) - y
            for b, v in x.items():
                old, new = n.get(b, 0.0), n.get(b, 0.0) + (g * v) ** 2
                z[b] = z.get(b, 0.0) + g * v - (math.sqrt(new) - math.sqrt(old)) / alpha * w[b]
                n[b] = new
        return z, n

    shards = {s: [] for s in (0, 1)}
    for doc_id, text, y, shard in docs.filter("quality IS NOT NULL").select("doc_id", "text", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(2))).collect():
        shards[shard].append((text, y))
    state = ({}, {})
    for turn in range(2):
        done = [one_pass(state, examples, turn) for examples in shards.values()]
        state = tuple({b: np.mean([d[k][b] for d in done if d[1].get(b)]) for b in set(done[0][k]) | set(done[1][k]) if any(d[1].get(b) for d in done)} for k in (0, 1))
    want = {b: weight(state[0][b], state[1][b]) for b in state[0]}
    got = quality.fit(docs, shards=2, passes=2)
    assert all(abs(got[-1 if b == "bias" else b] - w) < 1e-6 for b, w in want.items())
    assert set(np.flatnonzero(got[:-1])) == {b for b, w in want.items() if w and b != "bias"}
    for r, (_, text, _) in zip(quality.score(docs, got, ["doc_id"]).collect(), rows):
        p = 1 / (1 + math.exp(-sum(want.get(b, 0.0) * v for b, v in plain_features(text).items()) - want["bias"]))
        assert abs(r.score - p) < 1e-6 and r.predicted == (p >= 0.3)
