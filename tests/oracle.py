"""Compares a Spark result with DuckDB's."""

import math

import duckdb

from sparkloom.sources.tables import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(df, con, sql):
    found = con.execute(sql)
    expected = rows([c[0] for c in found.description], found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == expected[0], (got[0], expected[0])
    assert len(got[1]) == len(expected[1]), (len(got[1]), len(expected[1]))
    bad = [(a, b) for a, b in zip(got[1], expected[1]) if a != b]
    assert not bad, bad[:3]
