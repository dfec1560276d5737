"""Differences between two JSON texts by path, compared by value.

Texts become VARIANT; objects open into their keys and arrays into their positions, one level a round, and only pairs of containers
that differ go into the next round (a written table under ``spark.checkpoint.dir``). A round has no shuffle: both sides of a
path are in one row. There are as many rounds as the deepest difference has levels.

* Key order and white space never matter; numbers are equal by value: integers and decimals exactly, as doubles where one of
  them is written with an exponent. Text, booleans and null are equal only to the same (``1`` and ``"1"`` differ).
* A null text is a missing side: an object or array on the other side is listed by its keys or positions, all added or removed.
  Deeper down, a missing side, or sides of different kinds, give one row with the whole subtree.
* Two containers with nothing inside (``{}`` and a missing text, ``{}`` and ``[]``) differ at their own path.
* Text that is not JSON, or names a key twice, gives one row at ``$`` with change 'unparsed' and both texts as they are, if they differ.
* Arrays are compared position by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshot import materialize

NUMBERS = "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def _kind(v: Column) -> Column:
    """'{', '[', 'n' (number) or the scalar's type; null for a missing side."""
    first = F.substring(F.to_json(v), 1, 1)
    return F.when(v.isNull(), None).when(first.isin("{", "["), first).otherwise(
        F.when(F.schema_of_variant(v).rlike(NUMBERS), "n").otherwise(F.schema_of_variant(v)))


def _equal(o: Column, n: Column) -> Column:
    """Sides known to be scalars of one kind, or to have equal text."""
    double = F.schema_of_variant(o).rlike("DOUBLE|FLOAT") | F.schema_of_variant(n).rlike("DOUBLE|FLOAT")
    as_double = F.try_variant_get(o, "$", "double") == F.try_variant_get(n, "$", "double")
    same_text = F.to_json(o).eqNullSafe(F.to_json(n))
    return same_text | F.coalesce((_kind(o) == "n") & (_kind(n) == "n") & double & as_double, F.lit(False))


def _step(path: Column, key: Column) -> Column:
    plain = key.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    quoted = F.concat(F.lit("['"), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("']"))
    return F.concat(path, F.when(plain, F.concat(F.lit("."), key)).otherwise(quoted))


def json_diff(df: DataFrame, old: str, new: str, keep: list[str]) -> DataFrame:
    """(``keep`` columns, path, change, old_value, new_value) for each difference between the texts ``old`` and ``new`` of a row.

    ``change`` is 'added', 'removed', 'changed' or 'unparsed'; values are JSON texts, null on a missing side. Two null texts, and an
    empty ``df``, give no rows; a repeated row gives its differences again. Columns of ``keep`` may have any name.
    """
    spark = df.sparkSession
    row = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    read = df.select(row, F.col(old).alias("ot"), F.col(new).alias("nt")).where(~F.col("ot").eqNullSafe(F.col("nt"))).select(
        "row", "ot", "nt", F.try_parse_json("ot").alias("o"), F.try_parse_json("nt").alias("n"))
    broken = (F.col("ot").isNotNull() & F.col("o").isNull()) | (F.col("nt").isNotNull() & F.col("n").isNull())
    found = [read.where(broken).select("row", F.lit("$").alias("path"), F.lit("unparsed").alias("change"),
                                       F.col("ot").alias("old_value"), F.col("nt").alias("new_value"))]
    pairs = read.where(~broken).select("row", F.lit("$").alias("path"), "o", "n")
    top = True
    while True:
        judged = pairs.where(~_equal(F.col("o"), F.col("n"))).withColumns({"ok": _kind(F.col("o")), "nk": _kind(F.col("n"))})
        kind = F.coalesce("ok", "nk") if top else F.col("ok")
        alike = F.col("ok").eqNullSafe(F.col("nk")) if not top else F.coalesce(F.col("ok") == F.col("nk"), F.lit(True))
        filled = ~F.coalesce(F.to_json("o"), F.to_json("n")).isin("{}", "[]") | (F.col("ok").isNotNull() & F.col("nk").isNotNull())
        opens = F.coalesce(kind.isin("{", "["), F.lit(False)) & alike & filled
        found.append(judged.where(~opens).select(
            "row", "path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed").alias("change"),
            F.to_json("o").alias("old_value"), F.to_json("n").alias("new_value")))
        pending = materialize(spark, judged.where(opens).select("row", "path", "o", "n", kind.alias("kind")))
        if pending.isEmpty():
            break
        pairs = _members(pending)
        top = False
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(keep)], "path", "change", "old_value", "new_value")


def _members(pairs: DataFrame) -> DataFrame:
    """The members of both sides of each pair, by key or position."""
    def objects(v: str) -> Column:
        return F.coalesce(F.variant_get(v, "$", "map<string,variant>"), F.expr("CAST(map() AS map<string,variant>)"))

    def arrays(v: str) -> Column:
        return F.coalesce(F.variant_get(v, "$", "array<variant>"), F.expr("CAST(array() AS array<variant>)"))

    both = F.map_zip_with(objects("o"), objects("n"), lambda _, a, b: F.struct(a.alias("o"), b.alias("n")))
    keyed = (pairs.where(F.col("kind") == "{").select("row", "path", F.explode(both).alias("key", "pair"))
             .select("row", _step(F.col("path"), F.col("key")).alias("path"), "pair.o", "pair.n"))
    zipped = F.zip_with(arrays("o"), arrays("n"), lambda a, b: F.struct(a.alias("o"), b.alias("n")))
    placed = (pairs.where(F.col("kind") == "[").select("row", "path", F.posexplode(zipped).alias("at", "pair"))
              .select("row", F.concat("path", F.lit("["), F.col("at").cast("string"), F.lit("]")).alias("path"), "pair.o", "pair.n"))
    return keyed.unionByName(placed)
