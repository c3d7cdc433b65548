"""Query results against DuckDB, row by row."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    return f"{v:.9e}" if isinstance(v, float) and v else "0" if isinstance(v, float) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(_norm, r)) for r in frame[cols].astype(object).itertuples(index=False))
