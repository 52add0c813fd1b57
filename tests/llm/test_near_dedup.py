import random
import re

import corpus_pipeline

from netloom.llm import minhash


def brute(rows, least=0.8):
    """Smallest id reachable over pairs whose 5-word shingles have that Jaccard similarity, and the pairs."""
    sets, post = {}, {}
    for d, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()
        for s in sets[d] or [()]:
            post.setdefault(s, []).append(d)
    root, pairs = {d: d for d in sets}, []

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        common = {}
        for s in sets[a] or [()]:
            for b in post[s]:
                if b < a:
                    common[b] = common.get(b, 0) + 1
        for b, n in common.items():
            if not sets[a] or n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                pairs.append((b, a))
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in sets}, pairs


def copies(rng, n, first):
    """One large group of near copies, each with some words changed, and pairs at the edge of similarity."""
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(text)))
    for i in range(n):
        own = [f"y{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((first + n + 2 * i, " ".join(own)))
        for _ in range(rng.randrange(0, 8)):
            own[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        rows.append((first + n + 2 * i + 1, " ".join(own)))
    return rows


def test_stage_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in source.collect()] + copies(random.Random(11), 150, 900_000) + [(990_000, None), (990_001, " \n"), (990_002, "A b"), (990_003, "a  B"), (990_004, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, pairs = brute(rows)
    assert len(pairs) > 1000
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    assert sorted(kept) == sorted(set(want.values()))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert found == want


def test_crowds_that_drift(spark):
    """Copies of copies of copies, some hundreds, between unlike texts: keys are crowded, and far ends are unlike. Of the pairs that
    brute force links, those whose ends meet in one component."""
    rng = random.Random(23)
    texts = [[f"w{rng.randrange(4000)}" for _ in range(250)]]
    for _ in range(600):
        own = list(rng.choice(texts[-100:]))
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(250)] = f"x{rng.randrange(10**6)}"
        texts.append(own)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, " ".join(f"u{rng.randrange(10**5)}" for _ in range(150))) for i in range(200)]
    want, pairs = brute(rows)
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 5000
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(want[found[d]] == want[d] for d in found)  # nothing is linked that isn't alike


def test_rows_not_ids_count(spark):
    """Unlike texts without an id or under one id all stay; copies of them, and repeated rows, don't. Extra columns stay."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[3]), (9, texts[0]), (None, None), (3, " ")]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, set string, root int, th string")
    got = [tuple(r) for r in minhash.keep_one(docs).collect()]
    want = [(None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[0]), (3, " ")]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(((*r, "x", 1, "y") for r in want), key=key)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).collect() == [] and minhash.keep_one(docs).collect() == []


def test_keys_drop_no_partner(spark):
    """Sets under one key are all compared, unless in one component: with one fingerprint, where b and c are alike but unlike the smallest (a)
    and under no other key; and in a crowd of unlike pairs of like sets, whose partners no leader is near.
    """
    a, b, c = set(range(1, 41)), set(range(100, 140)), set(range(100, 142))
    crowd = [set(range(10_000 * i, 10_000 * i + 60 + j)) for i in range(5, 105) for j in (0, 1)]
    sets = [sorted(x) for x in (a, b, c, *crowd)]
    table = [(i, 7 if i < 3 else 1 << 60 | 7919 * i << 20, len(x), [-1 - i] if i < 3 else [5]) for i, x in enumerate(sets)]
    distinct = spark.createDataFrame([(*r, minhash.minima(minhash.np.array(x, "uint64") * minhash.np.uint64(0x9E3779B97F4A7C15)).astype("uint8").view("int8").tolist()) for r, x in zip(table, sets)], "set long, fp long, size int, keys array<long>, minima array<tinyint>")
    shingles = spark.createDataFrame(list(enumerate(sets)), "set long, shingles array<long>")
    found = {r.id: r.root for r in minhash.linked(distinct, lambda wanted: shingles.join(wanted, "set")).collect()}
    assert found == {2: 1} | {i + 1: i for i in range(3, 203, 2)}
    keyed = minhash.keyed(distinct)
    blocks = minhash._open(minhash.key_members(keyed).withColumn("root", minhash.F.col("set")), spark.createDataFrame([], "id long, root long"))
    pairs = [tuple(r) for r in minhash._crossed(blocks, keyed, 0.8, block=16).distinct().collect()]
    assert sorted(pairs) == [(1, 2)] + [(i, i + 1) for i in range(3, 203, 2)]
