"""Compare a query with its SQL over the same tables."""

import math
import os

import duckdb

DATA = os.environ.get("NETLOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v
    return [columns[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in values), key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, query, sql, sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)) for x, y in zip(a, b)), (a, b)
