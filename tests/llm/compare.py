"""A query's rows next to its DuckDB counterpart's."""

import os


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def both(spark, name, sf_dir):
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(map(repr, ([r[c] for c in columns] for r in df.collect())))
    con = duck(sf_dir)
    con.execute(e.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    want = sorted(map(repr, ([r[names.index(c)] for c in columns] for r in con.fetchall())))
    return got, want
