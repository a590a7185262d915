"""Compare a query with its DuckDB SQL, row by row."""

import math

import duckdb

from brindle.llm.queries import QUERIES
from brindle.llm.sql import ORACLE_SQL

TABLES = ("documents", "pages")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda v: (v is None, str(type(v)), v if not isinstance(v, float) else round(v, 9) if math.isfinite(v) else 0)
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [key(v) for v in r])


def check(spark, name, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())
