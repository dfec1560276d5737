"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import decimal
import math


def canon(v):
    if v is None:
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict(recursive=True))
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted(tuple(canon(r[i]) for i in idx) for r in res.fetchall())


def rows_of(df):
    """Plain sorted rows of a small Spark frame (for inline-frame tests)."""
    return sorted(tuple(canon(r[c]) for c in df.columns) for r in df.collect())
