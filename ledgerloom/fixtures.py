"""Driver tables -> retail ``Tables`` (Spark) and oracle CTEs (DuckDB).

The driver ships TPC-H-like Parquet tables. ``driver_tables`` reads them and
exposes every retail table as a lazy view defined by the SQL text in
``fixture_sql.VIEWS``. The same text, with ``fx_`` prefixed names, is what
``with_views`` puts in front of each oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixture_sql import VIEW_COLUMNS, VIEWS
from .schemas import SCHEMAS
from .tables import Tables

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# a base table is referenced only right after FROM / JOIN (names like "supplier" also occur as aliases)
_BASE_RE = re.compile(r"\b(FROM|JOIN)(\s+)(" + "|".join(BASE_TABLES) + r")\b", re.IGNORECASE)


def _templated(sql: str) -> str:
    """Turn bare base-table names into ``{name}`` placeholders for ``spark.sql(**frames)``."""
    escaped = sql.replace("{", "{{").replace("}", "}}")
    return _BASE_RE.sub(lambda m: m.group(1) + m.group(2) + "{" + m.group(3) + "}", escaped)


def read_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Retail tables over the driver's data at ``sf_dir`` (all lazy)."""
    base: dict[str, DataFrame] = {}

    def base_frame(n: str) -> DataFrame:
        if n not in base:
            base[n] = read_base(spark, sf_dir, n)
        return base[n]

    def loader(view: str):
        def load() -> DataFrame:
            text = VIEWS[view]
            used = sorted({m[2] for m in _BASE_RE.findall(text)})
            return spark.sql(_templated(text), **{u: base_frame(u) for u in used})
        return load

    t = Tables(spark, {v: loader(v) for v in VIEWS})
    t.params["sf_dir"] = sf_dir
    return t


def export_views(t: Tables, root: str, names: list[str], mode: str = "errorifexists") -> None:
    """Write retail views as Parquet folders ``root/<name>`` in their declared schema (for
    ``Tables.from_parquet``)."""
    for n in names:
        df = t[n]
        schema = SCHEMAS.get(n)
        if schema is not None:
            df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        df.write.mode(mode).parquet(f"{root.rstrip('/')}/{n}")


def as_of_date(t: Tables) -> Column:
    """The report day, taken from the data (newest order date) as a lazy scalar subquery."""
    return t.raw("as_of").select("d").scalar()


def now_ts(t: Tables, table: str = "error_log", col: str = "ts") -> Column:
    """The telemetry 'now': newest event timestamp, as a lazy scalar subquery."""
    return t.raw(table).select(F.max(col)).scalar()


# ---------------------------------------------------------------------------
# oracle side
_FX_RE = re.compile(r"\bfx(c?)_(\w+)\b")
_DUCK_TYPES = {"bigint": "BIGINT", "integer": "INTEGER", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
               "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
               "decimal(18,2)": "DECIMAL(18,2)"}


def conformed_view_sql(view: str) -> str:
    """``fx_<view>`` plus the declared-but-absent columns as typed nulls (mirrors ``Tables.conform``)."""
    have = set(VIEW_COLUMNS[view])
    extra = [f"CAST(NULL AS {_DUCK_TYPES[f.dataType.simpleString()]}) AS {f.name}"
             for f in SCHEMAS.get(view, ()) if f.name not in have] if view in SCHEMAS else []
    return "SELECT *" + "".join(", " + e for e in extra) + f" FROM fx_{view}"


def with_views(body: str) -> str:
    """Prefix ``body`` with a CTE for every ``fx_<view>`` / ``fxc_<view>`` (conformed) it mentions."""
    names, conformed = [], []
    for c, n in _FX_RE.findall(body):
        if n in VIEWS and n not in names:
            names.append(n)
        if c and n in VIEWS and n not in conformed:
            conformed.append(n)
    if not names:
        return body
    ctes = ",\n".join([f"fx_{n} AS (\n{VIEWS[n].strip()}\n)" for n in names]
                      + [f"fxc_{n} AS ({conformed_view_sql(n)})" for n in conformed])
    stripped = body.lstrip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if stripped.upper().startswith(head):
            return f"{head}{ctes},\n{stripped[len(head):]}"
    return f"WITH {ctes}\n{body}"
