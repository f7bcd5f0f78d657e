"""Rows of a query and of its DuckDB counterpart, as comparable lists."""

import os


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(columns, names, data):
    return sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in data)
