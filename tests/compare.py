"""Rows of a query and of its SQL in DuckDB, made comparable."""

import glob
import math
import os

import duckdb


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "")
    return tuple(map(comparable, value)) if isinstance(value, list) else value


def both(query, sql, spark, folder):
    frame = query(spark, folder)
    columns = sorted(frame.columns)
    got = sorted((tuple(comparable(x) for x in row) for row in frame.select(*columns).collect()), key=repr)
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return got, sorted((tuple(comparable(row[i]) for i in at) for row in result.fetchall()), key=repr)
