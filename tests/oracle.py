"""Runs a registered query and its DuckDB SQL side by side, comparing rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def views(sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*(table.column(n).to_pylist() for n in names), strict=True), key=repr)


def assert_same(spark, query, sql, sf_dir=DATA):
    got = rows(query(spark, sf_dir).toArrow())
    want = rows(views(sf_dir).sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for g, w in zip(got[1], want[1], strict=True):
        assert g == w
