"""Side-by-side check of a Spark query against its DuckDB oracle SQL:
row count, column names and an order-insensitive value comparison."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

from joblake.plans.bindings import TABLES


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = _rows(s_cols, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = _rows(d_cols, rel.fetchall())
    res = {
        "rows_spark": len(s_rows), "rows_oracle": len(d_rows),
        "cols_match": sorted(s_cols) == sorted(d_cols),
        "values_match": s_rows == d_rows,
    }
    if not res["cols_match"]:
        res["cols"] = (sorted(s_cols), sorted(d_cols))
    if res["cols_match"] and not res["values_match"]:
        ds, ss = set(d_rows), set(s_rows)
        diff_s = [r for r in s_rows if r not in ds][:3]
        diff_d = [r for r in d_rows if r not in ss][:3]
        res["sample_diff"] = (diff_s, diff_d)
    res["ok"] = res["cols_match"] and res["values_match"]
    return res
