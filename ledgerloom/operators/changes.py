"""Set-wise application of row changes.

The reference applies one HTTP request at a time (``UPDATE ... WHERE id = ?``).
Here a whole batch of change rows is folded per key and joined onto the
current snapshot, producing a new snapshot. Several changes to one key are
applied in ``(change_ts, seq)`` order, field by field:

* ``set``      - the field takes the value of the last change that supplies one;
* ``guard``    - the change only counts where its guard holds (e.g. the
                 delivery date counts only when that change's status is
                 ``delivered``), evaluated on the change row itself;
* a null value always means "not supplied" (D22).

Folding uses ``max(struct(order..., value))`` with a filter, which Spark runs
as a partial/final sort aggregate (a struct is its buffer): a hot key is combined map-side. Keys not
in the current table are ignored, like an UPDATE that matches no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    value: Column            # expression over the change row
    guard: Column | None = None


def fold_changes(changes: DataFrame, keys: list[str], rules: dict[str, Rule],
                 order: tuple[str, ...] = ("change_ts", "seq")) -> DataFrame:
    """One row per key with the last supplied (and guard-passing) value of each field."""
    aggs = []
    for field, rule in rules.items():
        ok = rule.value.isNotNull()
        if rule.guard is not None:
            ok = ok & F.coalesce(rule.guard, F.lit(False))
        packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], rule.value.alias("v"))
        aggs.append(F.max(F.when(ok, packed))["v"].alias(f"_new_{field}"))
    return changes.groupBy(*keys).agg(*aggs)


def apply_changes(current: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, Rule],
                  order: tuple[str, ...] = ("change_ts", "seq"), stamp: str | None = "updated_at") -> DataFrame:
    """New snapshot of ``current`` with ``changes`` applied; column order and types kept.

    ``stamp`` names a column of ``current`` that takes the time (``order``'s first column) of the last change of a row,
    on rows that a change hits and on no others; it is left alone where ``current`` has no such column.
    """
    if stamp in current.columns and stamp not in rules:
        rules = {**rules, stamp: Rule(F.col(order[0]))}
    folded = fold_changes(changes, keys, rules, order)
    joined = current.join(folded, on=keys, how="left")
    out = []
    for c in current.columns:
        if c in rules:
            dtype = current.schema[c].dataType
            out.append(F.coalesce(F.col(f"_new_{c}").cast(dtype), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)
