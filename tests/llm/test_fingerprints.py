import hashlib
import re

import numpy as np

from netloom.llm import fingerprints as fp


def test_edited_texts_and_order(spark):
    rows = [(i * 3 % 101, f"text number {i} " + "word%d " % i * (i % 9)) for i in range(101)]
    rows += [(500, None), (501, ""), (502, "x" * 60_000), (500, "again the same id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, part string")
    known = fp.lexicon(docs)
    parts = fp.PART_ROWS
    fp.PART_ROWS = 10
    try:
        got = fp.fingerprint_documents(docs, known).collect()
    finally:
        fp.PART_ROWS = parts
    assert len(got) == len(rows)
    order = sorted({r[0] for r in rows} - {None, 500})
    text = dict(rows)
    for r in got:
        if r.doc_id in order and r.doc_id not in (99, 100, 502):
            after = text[order[order.index(r.doc_id) + 1]] or ""
            own = text[r.doc_id] or ""
            k = len(own) // 2
            assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256((own[: len(own) - k] + after[:k]).encode()).hexdigest()
        if r.doc_id == 502:
            assert r.edited_sha256 == hashlib.sha256(("x" * 30_000 + "no id").encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_likeness_follows_overlap():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(5000)])
    a = rng.choice(words, 300, replace=False)
    half = np.concatenate([a[:150], rng.choice(words, 150)])
    known = np.sort(fp._terms(pa.array([" ".join(words)]))[1])
    f = fp.fingerprints(pa.array([" ".join(a), " ".join(a[::-1]), " ".join(half), " ".join(rng.choice(words, 300))]), known)
    assert f[0] == f[1] and fp.likeness(f[0], f[1]) == 1
    assert fp.likeness(f[0], f[3]) < 0.2 < fp.likeness(f[0], f[2]) + 0.15 < 0.9


def test_query(spark):
    got = fp.op4_fingerprints(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fp.fingerprint_documents(docs, fp.lexicon(docs)).collect() == []


FULL = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & FULL
    return x ^ (x >> 31)


def plain_terms(text):
    import pandas as pd

    words = {re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in (text or "").lower().split()} - {""}
    return {int(pd.util.hash_array(np.array([w], object))[0]) for w in words}


def plain_fingerprint(text, known):
    """(kind, level, hashes by rate and subset) term by term."""
    terms = plain_terms(text)
    inside = terms & known
    kind, terms = ("b", inside) if len(inside) >= fp.FEWEST else ("a", terms)
    if not terms:
        return "t", hashlib.sha256((text or "").encode()).hexdigest()
    level, table = len(terms).bit_length() - 1, []
    for k in range(fp.RATES):
        row = []
        for s in range(fp.SUBSETS):
            keep = [t for t in sorted(terms) if mix(t ^ mix(7919 * (s + 1))) & ((1 << level + 1 + k) - 1) == 0]
            total = sum(mix((t + 1) & FULL) for t in keep) & FULL
            row.append(max(mix(total) >> 48, 1) if total else 0)
        table.append(row)
    return kind, level, table


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if "t" in (a[0], b[0]) or abs(a[1] - b[1]) >= fp.RATES:
        return 0.0
    top = max(a[1], b[1])
    pairs = [(x, y) for x, y in zip(a[2][top - a[1]], b[2][top - b[1]]) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def test_against_brute_force(spark):
    """The lexicon's band, every subset's hash and every likeness, from the definitions."""
    rng = np.random.default_rng(3)
    vocabulary = [f"Term{i}" for i in range(300)] + ["the", "of", "(and)", "..."]
    share = np.r_[1 / np.arange(1, 301), [2.0, 2.0, 1.0, 1.0]]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 60), p=share / share.sum())) for _ in range(120)] + [None, "", "... !", "unheard words only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    count = {}
    for t in texts:
        for term in plain_terms(t):
            count[term] = count.get(term, 0) + 1
    known = {t for t, n in count.items() if 0.03 * len(texts) <= n <= 0.2 * len(texts)}
    found = fp.lexicon(docs, 0.03, 0.2)
    assert 20 < len(known) < len(count) and found.tolist() == sorted(known)
    rows = {r.doc_id: r for r in fp.fingerprint_documents(docs, found).collect()}
    plain = [plain_fingerprint(t, known) for t in texts]
    assert {p[0] for p in plain} == {"a", "b", "t"}
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        edited = plain_fingerprint(text[: len(text) - len(text) // 2] + after[: len(text) // 2], known)
        for got, want in ((rows[i].fingerprint, plain[i]), (rows[i].edited_fingerprint, edited)):
            if want[0] == "t":
                assert got == "t" + want[1]
            else:
                assert got == f"{want[0]}{want[1]:02x}" + "".join(f"{h:04x}" for row in want[2] for h in row)
        assert abs(rows[i].near_edited - plain_likeness(plain[i], edited)) < 1e-12
        assert abs(rows[i].near_next - plain_likeness(plain[i], plain[(i + 1) % len(texts)])) < 1e-12
