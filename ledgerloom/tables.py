"""Table registry: name -> DataFrame, conformed to the declared schema.

A ``Tables`` object is the only input every job takes. It can be built
from Parquet folders, from JDBC, from in-memory frames (tests) or from the
driver's TPC-H-like tables through the retail views in ``fixtures``.
Frames are created lazily: nothing is read until a job asks for a table,
and Catalyst prunes each scan to the columns the job actually uses.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import SCHEMAS


def conform(df: DataFrame, name: str) -> DataFrame:
    """Add declared-but-missing columns as typed nulls; keep existing columns as they are."""
    schema = SCHEMAS.get(name)
    if schema is None:
        return df
    have = set(df.columns)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in have]
    return df.select("*", *missing) if missing else df


class Tables:
    """Lazy mapping of table name to DataFrame."""

    def __init__(self, spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame] | DataFrame]):
        self.spark = spark
        self._loaders = dict(loaders)
        self._cache: dict[str, DataFrame] = {}
        self.params: dict[str, object] = {}

    def __contains__(self, name: str) -> bool:
        return name in self._loaders

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name not in self._loaders:
                raise KeyError(f"table {name!r} is not registered")
            src = self._loaders[name]
            df = src if isinstance(src, DataFrame) else src()
            self._cache[name] = conform(df, name)
        return self._cache[name]

    def raw(self, name: str) -> DataFrame:
        """The frame as registered, without conforming."""
        src = self._loaders[name]
        return src if isinstance(src, DataFrame) else src()

    def with_table(self, name: str, df: DataFrame) -> "Tables":
        """A copy of this registry with one table replaced (jobs return new snapshots)."""
        loaders = dict(self._loaders)
        loaders[name] = df
        out = Tables(self.spark, loaders)
        out.params = dict(self.params)
        return out

    @property
    def names(self) -> list[str]:
        return sorted(self._loaders)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> "Tables":
        return cls(spark, dict(frames))

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, names: list[str] | None = None, *,
                     declared: bool = True) -> "Tables":
        """One Parquet folder per table under ``root`` (``root/<name>``).

        With ``declared`` the reader gets the table's declared schema: column
        types are fixed, columns absent from the files read as null, extra
        file columns are not read.
        """
        names = names or sorted(SCHEMAS)

        def loader(n: str) -> Callable[[], DataFrame]:
            def load() -> DataFrame:
                reader = spark.read.schema(SCHEMAS[n]) if declared and n in SCHEMAS else spark.read
                return reader.parquet(f"{root.rstrip('/')}/{n}")
            return load

        return cls(spark, {n: loader(n) for n in names})

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, names: list[str] | None = None, *,
                  properties: dict | None = None, partitioning: dict | None = None) -> "Tables":
        """Tables read through Spark's JDBC source. ``partitioning`` maps a table name to
        ``(column, lower, upper, num_partitions)`` for a parallel range read."""
        from .sources.jdbc import read_table

        names = names or sorted(SCHEMAS)
        parts = partitioning or {}

        def loader(n: str) -> Callable[[], DataFrame]:
            def load() -> DataFrame:
                col, lo, hi, num = parts.get(n, (None, None, None, None))
                return read_table(spark, url, n, properties=properties, partition_column=col, lower=lo,
                                  upper=hi, num_partitions=num)
            return load

        return cls(spark, {n: loader(n) for n in names})
