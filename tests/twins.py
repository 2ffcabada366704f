"""Compares a query's rows with those of its SQL twin."""

import glob
import math
import os

import duckdb


def shape(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


def compare(spark, sf_dir, query, sql):
    base = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        base.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = query(spark, sf_dir)
    names = sorted(found.columns)
    want = base.sql(sql)
    assert sorted(want.columns) == names
    ours = sorted(map(repr, (tuple(shape(r[n]) for n in names) for r in found.collect())))
    theirs = sorted(map(repr, (tuple(map(shape, r)) for r in want.select(", ".join(names)).fetchall())))
    assert ours == theirs
