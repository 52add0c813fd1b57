"""Compare a query with its SQL over the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is not None, round(float(v), 3) if isinstance(v, (int, float)) else str(v)) for v in r)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in values), key=key)


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    want = _rows([d[0] for d in found.description], found.fetchall())
    df = query(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6) for x, y in zip(a, b)), (a, b)
    return len(got[1])
