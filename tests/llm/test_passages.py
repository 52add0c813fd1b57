import random
import time
from pathlib import Path

import numpy as np

from netloom.llm import passages as ps

RNG = random.Random(9)
word = lambda: "".join(RNG.choice("abcdefghijklmnop") for _ in range(6))


def text(n):
    return [word() for _ in range(n)]


def test_chains_are_best():
    rng = np.random.default_rng(2)
    for _ in range(60):
        x, y = np.unique(rng.integers(0, 120, (25, 2)), axis=0).T
        pieces = ps.diagonals(x.astype(np.int64), y.astype(np.int64))
        n, score = len(pieces), np.zeros(len(pieces))
        for j in range(n):
            gains = [score[i] - ps.GAP_COST * (pieces[j, 0] - pieces[i, 1] + pieces[j, 2] - pieces[i, 3]) for i in range(j) if pieces[i, 1] <= pieces[j, 0] + ps.K - 1 and pieces[i, 3] <= pieces[j, 2] + ps.K - 1]
            score[j] = pieces[j, 1] - pieces[j, 0] + max([0.0, *gains])
        found = ps.chains(pieces)
        assert sum(map(len, found)) == n
        best = found[0]
        total = (best[:, 1] - best[:, 0]).sum() - ps.GAP_COST * ((best[1:, 0] - best[:-1, 1]).sum() + (best[1:, 2] - best[:-1, 3]).sum())
        assert abs(total - score.max()) < 1e-9


def test_planted_passages(spark):
    rows, passage = [], text(60)
    for i in range(40):
        rows.append((i, text(RNG.randrange(30, 200))))
    for i in (5, 11, 17):
        at = RNG.randrange(len(rows[i][1]))
        rows[i] = (i, rows[i][1][:at] + passage + rows[i][1][at:])
    fuzzy = [word() if k % 12 == 5 else w for k, w in enumerate(passage)]
    rows[23] = (23, rows[23][1][:20] + fuzzy + rows[23][1][20:])
    rows.append((50, rows[7][1]))  # exact copy
    rows.append((51, [w for k, w in enumerate(rows[8][1]) if k != 15]))  # near copy
    rows.append((52, text(30)))
    rows.append((53, passage[:25] + text(40)))  # too short to count
    inside = text(55)
    rows.append((54, inside + text(10) + inside))
    table = [(i, " ".join(w)) for i, w in rows] + [(60, None), (61, ""), (None, " ".join(passage)), (62, "same " * 30_000), (63, "same " * 300)]
    docs = spark.createDataFrame([(*r, 1) for r in table], "doc_id long, text string, h int")
    got = {(r.doc_id, r.other_id): r for r in ps.repeated_passages(docs).collect()}
    clean = {k for k in got if not {62, 63} & set(k)}
    assert clean - {(17, 11), (23, 11), (23, 17)} == {(11, 5), (17, 5), (23, 5), (50, 7), (51, 8), (54, 54)}
    words = dict(rows)
    for a in (11, 17):
        r = got[a, 5]
        assert set(passage) <= set(words[a][r.start : r.end]) and r.end - r.start <= 62
        assert r.identity > 0.95
    assert got[23, 5].identity < 1 and got[23, 5].end - got[23, 5].start >= 54
    assert (got[50, 7].start, got[50, 7].end, got[50, 7].identity) == (0, len(words[7]), 1.0)
    assert got[51, 8].end - got[51, 8].start == len(words[51])


def test_no_link_is_lost(spark):
    """Three thirds of a passage first occur in three documents, then whole, then apart again, then whole once more."""
    thirds = [text(30) for _ in range(3)]
    whole = thirds[0] + thirds[1] + thirds[2]
    rows = [(i, [*text(20), *thirds[i - 1], *text(20)]) for i in (1, 2, 3)]
    rows += [(4, [*text(15), *whole]), *((i, [*text(9), *thirds[i - 5], *text(31)]) for i in (5, 6, 7)), (8, [*whole, *text(60)])]
    for shift in (0, -5, 1 << 50):
        docs = spark.createDataFrame([(i + shift, " ".join(w)) for i, w in rows], "doc_id long, text string")
        got = [(r.doc_id - shift, r.other_id - shift, r.start, r.end) for r in ps.repeated_passages(docs).collect()]
        assert len(got) == 1 and got[0][:2] == (8, 4) and got[0][2] == 0 and 90 <= got[0][3] <= 93


def test_exact_repeats_against_brute_force(spark):
    """Words of few kinds, so that seeds repeat everywhere: whatever repeats 50 words lies in a passage or begins one."""
    rng = random.Random(4)
    phrases = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(8, 25))) for _ in range(25)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(2, rows[3][1] + " own"), (-(1 << 62), rows[4][1])]  # an id twice, an id far away
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    covered = {}
    for r in ps.repeated_passages(docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen, need = {}, 0
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = t.split()
        for i in range(len(w) - 49):
            other = seen.setdefault(tuple(w[i : i + 50]), (d, i))
            if other != (d, i) and d != 2:
                need += 1
                assert len(covered.get(d, set()) & set(range(i, i + 50))) >= 30
    assert need > 100


def test_word_hashes():
    import pyarrow as pa

    texts = ["A b\tc", None, "", " É é\n", "b", "aa a", "a aa  b"]
    rows, h = ps._word_hashes(pa.array(texts).slice(0))
    words = [w for t in texts for w in (t or "").lower().split()]
    assert rows.tolist() == [0, 0, 0, 3, 3, 4, 5, 5, 6, 6, 6]
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    some, _ = ps._word_hashes(pa.array(texts).slice(3, 3))
    assert some.tolist() == [0, 0, 1, 2, 2]


def test_empty(spark):
    assert ps.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_steps_leave_no_shuffle_files(spark):
    """The seeds are shuffled twice; what a step has shuffled is gone when its table is written."""
    made = lambda: {f.name.split("_")[1] for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    shared = text(80)
    docs = spark.createDataFrame([(i, " ".join(text(30) + shared + text(30))) for i in range(6)], "doc_id long, text string")
    before = made()
    found = ps.repeated_passages(docs)  # the tables of seeds and chains are written here
    end = time.time() + 20
    while len(made() - before) > 2 and time.time() < end:  # files are deleted beside the next query
        time.sleep(0.2)
    assert len(made() - before) <= 2  # the bounds and the repeats of ids, small
    assert {r.doc_id for r in found.collect()} == {1, 2, 3, 4, 5}
