import random

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, lone):
    pairs, single, out = set(), set(), {}
    for d, text in rows:
        lines = text.split("\n")
        at = [n for n, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        gone = set()
        for i, n in enumerate(at):
            key = tuple(lines[m] for m in at[i : i + 2])
            if len(key) == 2:
                gone |= {i, i + 1} if key in pairs else set()
                pairs.add(key)
            if len(lines[n].split()) >= lone:
                gone |= {i} if lines[n] in single else set()
                single.add(lines[n])
        dead = {at[i] for i in gone}
        out[d] = text if not gone else "" if len(gone) == len(at) else "\n".join(x for n, x in enumerate(lines) if n not in dead)
    return out


def test_stage_against_brute_force(spark):
    rng = random.Random(9)
    line = lambda: rng.choice(["Contents", "a b c d", "a b  c\td e", " This work is licensed under the GNU License ", "", "\t", f"own {rng.random()} line of five words"])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 8)))) for i in range(80)]
    rows += [(100, "New\nThis is one repeated line\nx1"), (101, "Other\nThis is one repeated line\nx2")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], COLUMNS)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    want = brute(rows, 5)
    assert want[101] == "Other\nx2"
    assert got == {d: (t, len(t)) for d, t in want.items()}
