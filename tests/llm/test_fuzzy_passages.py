"""Fuzzy copies of passages whose pieces stand in earlier documents."""

import random

import pytest

from netloom.llm import passages as ps


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(6))


def changed(rng, words, every):
    """``words`` with a change (a word replaced, put in or left out) about every so many words."""
    out = []
    for w in words:
        kind = rng.randrange(3) if rng.random() < 1 / every else 3
        out += [[word(rng)], [w, word(rng)], [], [w]][kind]
    return out


def test_pieces_known_before(spark):
    """Three pieces of 30 words first occur in three documents; two later ones share all of them, with a word changed between."""
    rng = random.Random(3)
    text = lambda n: [word(rng) for _ in range(n)]
    rows, n = [], 60
    for k in range(n):
        pieces = [text(30) for _ in range(3)]
        rows += [(k * 5 + i, [*text(20), *p, *text(20)]) for i, p in enumerate(pieces)]
        rows += [(k * 5 + i, [*text(15), *pieces[0], word(rng), *pieces[1], word(rng), *pieces[2], *text(9)]) for i in (3, 4)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.other_id): r for r in ps.repeated_passages(docs).collect()}
    assert all(a == b + 1 and a % 5 == 4 for a, b in got)
    assert len(got) >= 0.95 * n
    assert sum(r.end - r.start >= 85 for r in got.values()) >= 0.9 * len(got)


@pytest.mark.parametrize(("every", "known", "least"), [(8, 0, 0.85), (12, 0.5, 0.9), (25, 1, 0.9), (12, 1, 0.75)])
def test_recall(spark, every, known, least):
    """Passages of 40 to 200 words, a change in ``every`` words between two copies; a share ``known`` of the passage's pieces
    (20 to 30 words) stands in a decoy each, before the first copy."""
    rng = random.Random(every)
    text = lambda n: [word(rng) for _ in range(n)]
    rows, pairs = [], []
    for _ in range(150):
        passage = text(rng.randrange(40, 201))
        at = 0
        while at < len(passage):
            size = rng.randrange(20, 31)
            if rng.random() < known:
                rows.append([*text(10), *passage[at : at + size], *text(10)])
            at += size
        copies = changed(rng, passage, every * 2), changed(rng, passage, every * 2)
        pairs.append((len(rows), len(rows) + 1))
        rows += [[*text(rng.randrange(30)), *c, *text(rng.randrange(30))] for c in copies]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {(r.other_id, r.doc_id) for r in ps.repeated_passages(docs).collect()}
    print(every, known, "recall", len(got & set(pairs)) / len(pairs), "others", len(got - set(pairs)))
    assert got <= set(pairs)
    assert len(got & set(pairs)) >= least * len(pairs)
