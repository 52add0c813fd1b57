import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from netloom.llm import spelling

SF = "/root/testdata/sf0.001"
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def plain_counts(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(counts):
    """Near words by patterns with one letter blanked or left out."""
    near = defaultdict(set)
    blank, left = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            blank[w[:i], w[i + 1 :]].add(w)
            left[w[:i] + w[i + 1 :]].add(w)
    for group in blank.values():
        for w in group:
            near[w] |= group - {w}
    for short, group in left.items():
        if short in counts:
            near[short] |= group
            for w in group:
                near[w].add(short)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(rows, key=lambda r: r[0])


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[0])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(plain_counts(rows))
    assert found(spelling.op12_spelling(spark, SF)) == want
    assert sum(r[1] is not None for r in want) >= 10


@pytest.mark.parametrize("list_words", [spelling.LIST_WORDS, 40])
def test_against_brute_force(spark, list_words):
    """Few letters, so that many words are near; halves that many words share, in one list or in several."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 11))) for _ in range(1500)}
    words |= {"a" * n for n in range(7, 60)} | {"prefixed" + "".join(rng.choice("xyz") for _ in range(4)) for _ in range(200)} | {"a" * 3000, "a" * 2999 + "b", "a" * 3001}
    counts = {w: rng.choice([2, 3, 30, 300, 3000, 40_000]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert found(spelling.group_variants(df, list_words=list_words)) == plain_variants(counts)


def test_long_chain(spark):
    """Roots follow forms to the last, however many."""
    counts = {"a" * (30 - k): 2 * 10**k for k in range(17)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(spelling.group_variants(df))
    assert got == plain_variants(counts) and {r[2] for r in got} == {"a" * 14}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Letters LETTERS ×letters÷ letters"), (3, "12 34 short"), (None, "letters"), (4, "Ālettersāletterz letterz"), (5, "x" * 50_000), (6, "x" * 50_000 + " Étudiant étudiant Étudiant")]
    docs = spark.createDataFrame([(d, t, "w", 3) for d, t in rows], "doc_id long, text string, word string, n int")
    assert found(spelling.group_variants(spelling.count_words(docs))) == plain_variants(plain_counts(rows))
    assert spelling.group_variants(spelling.count_words(docs.filter("false"))).collect() == []
    assert spelling.group_variants(spelling.count_words(docs.filter("doc_id < 3"))).collect() == []
