"""Whole-table-set snapshot and the shared checkpoint folder.

``backup`` writes every table of a ``Tables`` registry to
``<root>/backup_<stamp>/<table>`` as Parquet, checks rows and checksum of
what was written against the source and leaves a manifest, from which
``restore`` checks a backup before it gives its tables back. The checksum is
a sum of row hashes: no order, no shuffle of rows. ``root`` must be a shared
filesystem on a cluster. ``materialize`` cuts lineage by writing a frame under the session's
``spark.checkpoint.dir`` and reading it back; ``remove_table`` removes such a
frame's files once nothing reads them any more.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir
from ..tables import Tables


MANIFEST = "backup_manifest"


def _content(df: DataFrame) -> DataFrame:
    """One row (rows, checksum): equal for equal rows in any order; repeated rows count. Columns must be hashable (no maps)."""
    # the null mask tells apart rows whose hashes agree because a hash passes over nulls
    nulls = F.concat(F.lit(""), *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns])
    hashed = F.xxhash64(nulls, *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hashed), F.lit(0)).cast("string").alias("checksum"))


def backup(t: Tables, root: str, stamp: str, names: list[str] | None = None) -> dict[str, int]:
    """Write the tables and the manifest; the rows of each table. A table that changed under way is an error, as is a used stamp."""
    names = names or t.names
    target = f"{root.rstrip('/')}/backup_{stamp}"
    if MANIFEST in names:
        raise ValueError(f"a table can't be named {MANIFEST}")
    lines = []
    for n in names:
        df = t[n]
        path = f"{target}/{n}"
        df.write.mode("errorifexists").parquet(path)
        written = _content(t.spark.read.schema(df.schema).parquet(path)).first()
        expected = _content(df).first()
        if written != expected:
            raise RuntimeError(f"backup of {n}: wrote {tuple(written)}, source has {tuple(expected)} (rows, checksum)")
        lines.append((n, written.rows, written.checksum, df.schema.json()))
    # written last: a backup without a manifest is not whole
    t.spark.createDataFrame(lines, "name string, rows bigint, checksum string, schema string").coalesce(1).write.json(f"{target}/{MANIFEST}")
    return {n: rows for n, rows, _, _ in lines}


def restore(spark: SparkSession, root: str, stamp: str, names: list[str] | None = None) -> Tables:
    """The tables of a backup, each checked against the manifest (rows and checksum) first; ``names`` picks some of them."""
    target = f"{root.rstrip('/')}/backup_{stamp}"
    lines = spark.read.schema("name string, rows bigint, checksum string, schema string").json(f"{target}/{MANIFEST}").collect()
    known = {r.name: r for r in lines}
    missing = sorted(set(names or []) - set(known))
    if missing:
        raise KeyError(f"not in the backup: {', '.join(missing)}")
    frames = {}
    for n in names or list(known):
        df = spark.read.schema(StructType.fromJson(json.loads(known[n].schema))).parquet(f"{target}/{n}")
        found = _content(df).first()
        if (found.rows, found.checksum) != (known[n].rows, known[n].checksum):
            raise RuntimeError(f"backup of {n}: {tuple(found)} (rows, checksum), its manifest says {(known[n].rows, known[n].checksum)}")
        frames[n] = df
    return Tables.from_frames(spark, frames)


def materialize(spark: SparkSession, df: DataFrame, name: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and return a frame reading it back."""
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/tables/{name or uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.parquet(path)


def remove_table(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a frame that ``materialize`` returned; nothing may read it afterwards. Other frames are left alone."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/"
    bare = re.compile("^file:/*(?=/)")  # Spark names local files with one slash or three
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if bare.sub("", folder).startswith(bare.sub("", root)):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
