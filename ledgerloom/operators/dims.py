"""Look up or create dimension rows by name (J10) with deterministic keys.

The reference inserts a name if absent and reads its id back, one row at a
time (and, without a unique index, may insert duplicates: D3). Set-wise:
distinct incoming names, ``left_anti`` against the dimension to find new
ones, give each a key derived from the name (D14: same input, same key),
``unionByName``. Lookups resolve a name to the smallest existing id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_POSITIVE = 0x7FFFFFFFFFFFFFFF


def name_key(name: Column) -> Column:
    """Deterministic positive 63-bit surrogate key from a natural key."""
    return F.xxhash64(name).bitwiseAND(F.lit(_POSITIVE))


def get_or_create(dim: DataFrame, names: DataFrame, name_col: str = "name", id_col: str = "id",
                  defaults: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Return ``(new_dim, lookup)``.

    ``names`` holds a ``name_col`` column (duplicates and nulls allowed; null
    and empty names are not created). Names are compared and created exactly
    as given, padding included, so every created name can be looked up.
    ``lookup`` has one row per name: ``(name_col, id_col)``.
    """
    wanted = (names.select(name_col)
              .where(F.col(name_col).isNotNull() & (F.col(name_col) != ""))
              .distinct())
    fresh = wanted.join(dim.select(name_col), on=name_col, how="left_anti")
    cols = {id_col: name_key(F.col(name_col)).cast(dim.schema[id_col].dataType)}
    for f in dim.schema.fields:
        if f.name in (id_col, name_col):
            continue
        val = (defaults or {}).get(f.name)
        cols[f.name] = (val if val is not None else F.lit(None)).cast(f.dataType)
    created = fresh.select(*[(cols[c].alias(c) if c != name_col else F.col(name_col)) for c in dim.columns])
    new_dim = dim.unionByName(created)
    lookup = new_dim.groupBy(name_col).agg(F.min(id_col).alias(id_col))
    return new_dim, lookup
