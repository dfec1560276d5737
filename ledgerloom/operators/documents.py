"""Nested documents as ordered lines, so that no array has to fit one row or one task.

A parent with its children is one JSON document. Built as ``array<struct>`` it is one row, and a parent that holds
a third of all children is one task's. Here a document is a run of lines ``(key, section, position, line)``: opening and
closing lines come from the parent, each child is a line of its own, and the lines of a key put together in the order
(section, position) are the document's text.

``positions`` numbers the children of each key without gathering them: rows are range-partitioned on (key, order), so a
hot key spans as many sorted runs as it needs; each run counts inside itself as it is written, and a key that goes on from
the run before is moved up by what that run ended with. Only one row a run passes through the driver.

``write_documents`` range-partitions the lines on (key, section, position) and writes sorted text files: the files, in
the order of their names, are the documents one after the other, and a large document is written by many tasks. Spark's
own commit makes the files visible together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshot import materialize


def _count_in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each row within its key's stretch of this run, and whether the run's first key goes on."""
    run, at, last, count, leading = TaskContext.get().partitionId(), 0, None, 0, True
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        key = b.column(b.schema.get_field_index("_key"))
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        goes_on = last is not None and key[0].as_py() == last
        new[0] = not goes_on
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        local = np.arange(n) - start
        first_stretch = int(np.flatnonzero(new)[0]) if new.any() else n
        if goes_on:
            local[:first_stretch] += count
        lead = np.zeros(n, bool)
        if leading:
            seen = np.flatnonzero(new)
            end = int(seen[0]) if goes_on and len(seen) else int(seen[1]) if not goes_on and len(seen) > 1 else n
            lead[:end] = True
            leading = end == n
        last, count = key[n - 1].as_py(), int(local[-1]) + 1
        names = [*b.schema.names, "_run", "_at", "_local", "_lead"]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, run, np.int32)), pa.array(np.arange(at, at + n)), pa.array(local.astype(np.int64)), pa.array(lead)], names=names)
        at += n


def positions(df: DataFrame, keys: list[str], order: list[Column], out: str = "position") -> DataFrame:
    """``df`` with ``out`` (long, from 0): the place of each row among those of its keys, in ``order``.

    Equal rows get places of their own; null keys are a key like any other. The sorted runs are written once under
    ``spark.checkpoint.dir``, which fixes them. Names beginning with an underscore are used inside.
    """
    spark = df.sparkSession
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_key", key)
    schema = T.StructType([*runs.schema.fields, T.StructField("_run", T.IntegerType()), T.StructField("_at", T.LongType()),
                           T.StructField("_local", T.LongType()), T.StructField("_lead", T.BooleanType())])
    runs = materialize(spark, runs.mapInArrow(_count_in_runs, schema))
    ends = runs.groupBy("_run").agg(F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"),
                                    F.max_by("_local", "_at").alias("count"), F.bool_and("_lead").alias("single")).orderBy("_run").collect()
    carry, last, held = [], None, 0
    for r in ends:
        more = held if last is not None and r["first"] == last else 0
        if more:
            carry.append((r["_run"], more))
        last, held = r["last"], r["count"] + 1 + (more if r["single"] else 0)
    moved = spark.createDataFrame(carry, "_run int, _more long")  # one row a run at most
    place = F.col("_local") + F.when(F.col("_lead"), F.coalesce("_more", F.lit(0))).otherwise(0)
    return runs.join(F.broadcast(moved), "_run", "left").select(*df.columns, place.cast("long").alias(out))


def json_text(*fields: str | Column) -> Column:
    """The JSON text of a struct of the given fields, nulls written out."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def opened(text: Column, name: str) -> Column:
    """An object's JSON text, still open, with an array field begun."""
    return F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(f',"{name}":['))


def child_lines(child: DataFrame, key: str, fields: list[str], order: list[Column], section: int) -> DataFrame:
    """(key, section, position, line) of a child array: one line a child, commas between them."""
    placed = positions(child.select(key, *fields), [key], order)
    comma = F.when(F.col("position") > 0, F.lit(",")).otherwise(F.lit(""))
    return placed.select(key, F.lit(section).alias("section"), "position", F.concat(comma, json_text(*fields)).alias("line"))


def parent_lines(parent: DataFrame, key: str, section: int, line: Column) -> DataFrame:
    return parent.select(key, F.lit(section).alias("section"), F.lit(0).cast("long").alias("position"), line.alias("line"))


def write_documents(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write document lines as text files, a document's lines in order, large documents over many tasks."""
    key = lines.columns[0]
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, key, "section", "position").sortWithinPartitions(key, "section", "position")
     .select("line").write.mode(mode).text(path))
