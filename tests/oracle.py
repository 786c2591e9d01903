"""Compares a query with its DuckDB SQL on the small tables."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def said(value):
    return "null" if value is None or isinstance(value, float) and math.isnan(value) else f"{value:.6f}" if isinstance(value, float) else str(value)


def compare(spark, query, sql, sf=SF):
    frame = query(spark, sf)
    columns = sorted(frame.columns)
    got = sorted(tuple(said(r[c]) for c in columns) for r in frame.collect())
    with duckdb.connect() as con:
        for file in os.listdir(sf):
            con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = sorted(tuple(said(r[i]) for i in at) for r in result.fetchall())
    assert got == want
