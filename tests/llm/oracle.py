"""Runs a query's SQL in DuckDB and compares with Spark's rows, as sets with counts."""

from collections import Counter

import duckdb


def rows_of(arrow):
    cols = sorted(arrow.column_names)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return cols, Counter(tuple(plain(r[c]) for c in cols) for r in arrow.to_pylist())


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    got, want = rows_of(df.toArrow()), rows_of(con.sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
