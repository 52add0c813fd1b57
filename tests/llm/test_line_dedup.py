import random

import pytest
import xxhash
from oracle import compare

from netloom.llm import line_dedup


def text_hash(text):
    """Spark's xxhash64: texts under one id come in its order."""
    value = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def brute(rows, min_lines, lone_words=None):
    """(text, deleted, stretches, longest run) of each document, from the definition, run by run."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    seen, out = set(), {}
    for d, text in order:
        lines = [] if text is None else text.split("\n")
        at = [n for n, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        words = [lines[n] for n in at]
        gone, longest, lone = set(), 0, 0
        for i in range(len(words)):
            for n in range(1, len(words) - i + 1):
                run = tuple(words[i : i + n])
                if run in seen:
                    if n >= min_lines:
                        gone |= set(range(i, i + n))
                    longest = max(longest, n)
                    if n == 1 and lone_words and len(words[i].split()) >= lone_words:
                        gone.add(i)
                        lone = 1
                elif n == 1 or run[:-1] in seen:  # new runs are added one line beyond what is known
                    break
            for n in range(1, len(words) - i + 1):
                seen.add(tuple(words[i : i + n]))
        stretches = sum(i - 1 not in gone for i in gone)
        dead = {at[i] for i in gone}
        kept = text if not gone else "" if len(gone) == len(at) else "\n".join(x for n, x in enumerate(lines) if n not in dead)
        out[d, text] = (kept, len(gone), stretches, (longest if longest > 1 else 1) if gone else 0)
    return out


def check(spark, rows, least, lone=None):
    docs = spark.createDataFrame([(d, t, 0, "x", "y", 7) for d, t in rows], "doc_id long, text string, n_chars int, line string, rank string, k int")
    want = brute(rows, least, lone)
    got = line_dedup.dedup_lines(docs, least, lone).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    found = sorted(((r.doc_id, r.text, r.n_deleted, r.n_runs, r.longest_run) for r in got), key=key)
    assert found == sorted(((d, *want[d, t]) for d, t in rows), key=key)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.k == 7 for r in got)


def test_runs_that_only_overlap(spark):
    """A B C is deleted by its two pairs, but nothing longer than a pair occurs before; then the whole run does."""
    rows = [(1, "A\nB"), (2, "B\nC"), (3, "A\nB\nC"), (4, "x\nA\nB\nC\ny"), (5, "A\nB\nq")]
    got = {r.doc_id: (r.text, r.n_deleted, r.n_runs, r.longest_run) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("A\nB", 0, 0, 0), 2: ("B\nC", 0, 0, 0), 3: ("", 3, 1, 2), 4: ("x\ny", 3, 1, 3), 5: ("q", 2, 1, 2)}


@pytest.mark.parametrize(("least", "lone"), [(1, None), (2, 2), (3, None)])
def test_against_brute_force(spark, least, lone):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c c", "dd", "", " "]) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    whole = [f"line {rng.randrange(1000)}" for _ in range(45)]
    rows += [(70, "\n".join(whole)), (71, "\n".join(whole[:37] + ["own"] + whole[37:])), (72, "\n".join(whole[3:])), (73, "\n".join([*whole[20:], *whole[:25]]))]
    rows += [(100, None), (101, ""), (102, "\n\n"), (3, rows[3][1]), (None, "a\nb\nzz"), (None, "a\nb\nzz"), (None, "zz\nyy"), (200, "zz\na\nb\nzz"), (72, "\n".join(whole[9:]))]
    check(spark, rows, least, lone)


def test_one_line_over_and_over(spark):
    docs = spark.createDataFrame([(1, "a\n" * 3000 + "a"), (2, "b\n" + "a\n" * 700 + "c")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_deleted, r.longest_run) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: ("a", 3000, 3000), 2: ("b\nc", 700, 700)}


def test_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    compare(spark, line_dedup.op7_line_dedup, line_dedup.OP7_SQL)
