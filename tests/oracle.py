"""Compare a query's rows with its SQL twin in DuckDB."""

import math
from pathlib import Path


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=str)


def compare(spark, query, sql, d):
    """(columns and rows of Spark, columns and rows of DuckDB), sorted."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, d)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    return (sorted(df.columns), rows_of(df.columns, df.collect())), (sorted(names), rows_of(names, found.fetchall()))
