"""Rewriting only the folders that changes touch, and backups that are checked when they are restored."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from compare import rows_of
from ledgerloom.operators.changes import Rule, apply_changes
from ledgerloom.sources import backup, change_fact, materialize, read_fact, restore, write_fact
from ledgerloom.tables import Tables

D = dt.date
BY = {"date_col": "day", "sort_by": ["id"], "files_per_partition": 2}


def _fact(spark, path, grain):
    rows = [(i, D(2024, 1 + i % 4, 1 + i % 3) if i % 50 else None, "new", i * 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, day date, status string, amount int")
    write_fact(df, path, grain=grain, **BY)
    return df


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def _apply(changes):
    return lambda rows: apply_changes(rows, changes, ["id"], {"status": Rule(F.col("status"))})


@pytest.mark.parametrize("grain", ["day", "month"])
def test_only_touched_folders_are_rewritten(spark, tmpdir_path, grain):
    path = f"{tmpdir_path}/fact"
    df = _fact(spark, path, grain)
    before = _files(path)
    changes = spark.createDataFrame([(4, dt.datetime(2024, 5, 1), 1, "old"), (4, dt.datetime(2024, 5, 2), 2, "done"), (50, dt.datetime(2024, 5, 1), 3, "done"),
                                     (9999, dt.datetime(2024, 5, 1), 4, "done"), (None, dt.datetime(2024, 5, 1), 5, "done")],
                                    "id bigint, change_ts timestamp, seq bigint, status string")
    assert change_fact(spark, path, changes, ["id"], _apply(changes), grain=grain, **BY) == 2     # the folder of 4 and the one of null days
    after = _files(path)
    kept = set(before) & set(after)
    assert all(before[f] == after[f] for f in kept) and len(kept) < len(before)
    rewritten = {os.path.dirname(f) for f in before.keys() ^ after.keys()}
    assert len(rewritten) == 2
    got = read_fact(spark, path).select(*df.columns)
    assert rows_of(got) == rows_of(apply_changes(df, changes, ["id"], {"status": Rule(F.col("status"))}))
    again = _files(path)
    assert change_fact(spark, path, changes.limit(0), ["id"], _apply(changes), grain=grain, **BY) == 0 and _files(path) == again


def test_refuses_moved_and_lost_rows_and_finishes_a_lost_exchange(spark, tmpdir_path):
    path = f"{tmpdir_path}/fact"
    df = _fact(spark, path, "day")
    before = _files(path)
    one = spark.createDataFrame([(4,)], "id bigint")
    with pytest.raises(ValueError, match="another folder"):
        change_fact(spark, path, one, ["id"], lambda rows: rows.withColumn("day", F.date_add("day", 1)), **BY)
    with pytest.raises(ValueError, match="every row"):
        change_fact(spark, path, one, ["id"], lambda rows: rows.where("id <> 4"), **BY)
    assert _files(path) == before
    # a call that was lost after its rows were written: its folder is gone, the next call with its name brings it back
    day = df.where("id = 4").first().day
    staged = df.where(F.col("day") == F.lit(day)).withColumn("amount", F.lit(7)).withColumn("_was", F.col("day").cast("string"))
    materialize(spark, staged, "change-lost")
    for f in glob.glob(f"{path}/day={day}/*"):
        os.remove(f)
    assert change_fact(spark, path, one, ["id"], lambda rows: rows, run_id="lost", **BY) == 1
    want = df.withColumn("amount", F.when(F.col("day") == F.lit(day), 7).otherwise(F.col("amount")))
    assert rows_of(read_fact(spark, path).select(*df.columns)) == rows_of(want)


def test_backup_comes_back_whole_and_changes_are_found(spark, tmpdir_path):
    a = spark.createDataFrame([(1, "x", None), (1, "x", None), (None, None, 2.5), (2, None, None)], "id bigint, name string, v double")
    b = spark.createDataFrame([], "id bigint, at timestamp")
    t = Tables.from_frames(spark, {"a": a, "b": b})
    assert backup(t, tmpdir_path, "s1") == {"a": 4, "b": 0}
    back = restore(spark, tmpdir_path, "s1")
    assert rows_of(back["a"]) == rows_of(a) and back["b"].schema == t["b"].schema and back["b"].count() == 0
    with pytest.raises(KeyError):
        restore(spark, tmpdir_path, "s1", ["c"])
    spark.createDataFrame([(1, "x", None), (1, "x", None), (None, None, 2.5), (None, "2", None)], a.schema).write.mode("overwrite").parquet(f"{tmpdir_path}/backup_s1/a")
    with pytest.raises(RuntimeError, match="manifest"):
        restore(spark, tmpdir_path, "s1")
    assert restore(spark, tmpdir_path, "s1", ["b"])["b"].count() == 0
