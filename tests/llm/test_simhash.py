import random
import re

import xxhash

from netloom.llm import components, simhash


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance):
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                root[top(a)] = top(b)
    lowest = {}
    for d, f in zip(ids, fps):
        if d is not None:
            lowest[top(f)] = min(d, lowest.get(top(f), d))
    return [lowest.get(top(f)) for f in fps]


def test_fingerprint_and_components(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("the of and Big small ÉTÉ été x1".split()) + rng.choice(["", "s", "ed"]) for _ in range(rng.choice([1, 2, 3, 40, 300]))) for _ in range(60)]
    rows = [(i, t, "n") for i, t in enumerate(base)]
    rows += [(100 + i, " ".join(t.split()[:-1]) + "\u0085\t end", "n") for i, t in enumerate(base)]
    rows += [(300, None, "n"), (301, "", "n"), (302, " \n\t", "n"), (303, "a  B\x0bc", "n"), (304, "a b C", "n"), (None, "a b C", "n"), (5, base[5], "n"), (400, "word " * 70_000, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    want = [brute_fingerprint(t) for _, t, _ in rows]
    comp = brute_components([r[0] for r in rows], want, 2)
    signed = [f - (1 << 64) if f >> 63 else f for f in want]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in got), key=key) == sorted(zip([r[0] for r in rows], signed, comp), key=key)


def test_links_with_hot_signatures(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre}
    for _ in range(200):  # a chain of many fingerprints about one centre
        fps.add(rng.choice(sorted(fps)) ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    for distance, limit in ((1, 4), (2, 8)):
        found = simhash.links(table, distance, limit).collect()
        assert all(0 < bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= distance for r in found)
        roots = {r.id: r.root for r in components.components(spark.createDataFrame(found, "a long, b long")).collect()}
        want = brute_components(signed, signed, distance)
        assert [roots.get(f, f) for f in signed] == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
