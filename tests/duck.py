"""Compare a query with its SQL on the same tables."""

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, values) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(repr(r[i]) for i in order) for r in values)


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    relation = connect(sf_dir).sql(sql)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall())
