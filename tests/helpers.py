"""Small hand-made spans, and the comparison of a query with its SQL."""

import os

import duckdb
import pandas as pd

from spanloom.schema import SPANS, normalized

MS, S = 1_000_000, 1_000_000_000
MIN = 60 * S


def spans(spark, rows):
    """rows: dicts with at least span_id and start_time; the rest has defaults."""
    full = []
    for r in rows:
        d = {"trace_id": "1", "parent_span_id": None, "name": "op", "service_name": "svc", "duration": 100 * MS, "tags": {}} | r
        d.setdefault("end_time", d["start_time"] + d["duration"])
        full.append(tuple(d[f] for f in SPANS.fieldNames()))
    return normalized(spark.createDataFrame(full, SPANS))


def rows_of(pdf):
    def plain(v):
        if pd.isna(v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return round(v, 6) if isinstance(v, float) else v

    cols = sorted(pdf.columns)
    return cols, sorted((tuple(plain(v) for v in t) for t in pdf[cols].itertuples(index=False)), key=lambda t: tuple((v is None, str(v)) for v in t))


def oracle(sql, folder):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c.sql(sql).df()
