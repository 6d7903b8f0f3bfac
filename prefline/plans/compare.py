"""Compare a Spark query with its DuckDB oracle (tests and the check script).

Columns are compared by name; rows as an order-insensitive multiset.
Doubles must be equal bit for bit unless ``digits`` is given.
"""

from __future__ import annotations

import math
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duckdb_connection(root: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def _norm(v, digits):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, digits) if digits is not None else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(recursive=True), digits)
    return v


def compare(spark_df, con, sql: str, digits: int | None = None) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
        out["match"] = False
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    d_order = [d_index[s_cols[i]] for i in order]
    sa = Counter(tuple(_norm(r[i], digits) for i in order) for r in s_rows)
    da = Counter(tuple(_norm(r[i], digits) for i in d_order) for r in d_rows)
    out["match"] = sa == da
    if not out["match"]:
        only_s = list((sa - da).elements())[:3]
        only_d = list((da - sa).elements())[:3]
        out["only_spark"], out["only_oracle"] = only_s, only_d
    return out
