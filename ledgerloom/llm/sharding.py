"""Sharding by sampled splitters.

Every record gets an order key: a hash of its shard key in the high bits (equal keys are neighbours) and
a hash of the row in the low bits, so that the rows of one key can still be told apart. A
size-weighted sample of the keys gives quantile boundaries, which range-partition the records into many
small ranges; exact sizes are then counted, and a range over ``OVERFULL`` times the aim, in bytes or in rows, is
subdivided by boundaries drawn from a second sample inside it, also inside a group of equal keys.

Ranges are what tasks rank (one bounded window each); what is dealt to shards is larger: all ranges of a group of equal
keys go together. They are dealt largest first, each to the lightest shard. Only if the shards' bytes then differ, because
groups are too large to be dealt near equally, are the largest groups dealt range by range.

Only boundaries and range totals pass through the driver: about ``RANGES`` of them, more for very large
tables (one for ``ROWS_A_RANGE`` rows).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.snapshot import materialize
from .common import ship

RANGES = 2048
ROWS_A_RANGE = 100_000
SAMPLES_A_RANGE = 12
OVERFULL = 2.0
ROW_BITS = 24  # low bits of the order key that tell rows of equal keys apart
_LOW = (1 << ROW_BITS) - 1
_TOP = np.iinfo(np.int64).max & ~_LOW  # the last group has no boundary behind it
NEAR = 1.01  # shards are near equal when none is above this share of the mean


def _range_of(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``rows`` with ``_range``: the number of splitters at or below the order key."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(np.searchsorted(shared.value, keys.to_numpy(np.int64), side="right").astype(np.int64))

    return rows.withColumn("_range", F.pandas_udf(find, "long")("_order"))


def _sample(rows: DataFrame, weight: float, seed: int) -> DataFrame:
    """Rows drawn with chances in proportion to their size: a row of ``weight`` bytes is drawn once on average,
    and larger ones always. A fixed hash draws, so a repeated task draws the same rows."""
    coin = (F.xxhash64("_rid", F.lit(seed)) / F.lit(2.0**63) + 1) / 2
    return rows.where(coin < F.col("_size") / F.lit(float(weight))).select("_order")


def _quantiles(keys: np.ndarray, n: int) -> np.ndarray:
    """Boundaries between ``n`` equal parts of the sampled order keys. They move to the start of a group of equal
    keys, unless the group spans several parts: then it begins and ends at boundaries, and others are inside it."""
    if not len(keys) or n < 2:
        return np.zeros(0, np.int64)
    keys = np.sort(keys)
    cuts = keys[(np.arange(1, n) * len(keys)) // n]
    start = cuts & ~_LOW
    groups, times = np.unique(start, return_counts=True)
    wide = groups[times > 1]
    ends = wide[wide < _TOP] + (_LOW + 1)
    return np.unique(np.concatenate([start, cuts[np.isin(start, wide)], ends]))


def _units(totals: pd.DataFrame, splitters: np.ndarray) -> list[list[tuple[int, float, int]]]:
    """(range, bytes, rows) of the ranges that belong together: those of one group of equal keys, or one range."""
    below = np.concatenate([[np.iinfo(np.int64).min], splitters])  # where each range begins
    units: list[list] = []
    last = None
    for r, size, n in sorted(totals.itertuples(index=False, name=None)):
        r = int(r)
        inside = r > 0 and int(below[r]) & _LOW  # begins inside a group
        group = int(below[r]) & ~_LOW if inside or (r < len(splitters) and int(splitters[r]) & ~_LOW == int(below[r])) else None
        if group is None or group != last:
            units.append([])
        units[-1].append((r, float(size), int(n)))
        last = group
    return units


def _deal(units: list, n_shards: int) -> tuple[list[tuple[int, int, int]], float]:
    """(range, shard, first slot) of every range, and the largest shard's bytes."""
    heap = [(0.0, 0, s) for s in range(n_shards)]  # bytes, rows, shard
    dealt = []
    for unit in sorted(units, key=lambda u: (-sum(x[1] for x in u), u[0][0])):
        load, count, s = heapq.heappop(heap)
        for r, size, n in unit:
            dealt.append((r, s, count))
            load, count = load + size, count + n
        heapq.heappush(heap, (load, count, s))
    return dealt, max(h[0] for h in heap)


def shard_by_size(rows: DataFrame, size_col: str, key_col: str, n_shards: int = 16) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 to ``n_shards`` - 1) and ``slot`` (long, gapless from 0 in each shard).

    The sum of ``size_col`` is near equal in all shards: they differ by no more than about one range (a few
    ten thousandths of the whole) or the largest record. Rows of equal ``key_col`` (null is a key) are in one
    shard, unless whole groups cannot be dealt near equally: then groups above a share of a shard are divided, a whole
    shard's at first, then a half, a quarter and so on, until the shards are near equal.
    A null or negative size counts 0. Repeated rows are rows of their own. An empty table gives an empty one.
    All columns pass through; columns already named shard or slot are replaced. The table is written once
    under ``spark.checkpoint.dir``, which fixes the row numbers that break ties.
    """
    spark = ship(rows.sparkSession)
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    own = [f"c{i}" for i in range(len(kept))]  # no clash with the names used here
    rows = materialize(spark, rows.select(
        *[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own)], F.monotonically_increasing_id().alias("_rid"),
        F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_size"), F.xxhash64(F.col(f"`{key_col}`")).alias("_key")))
    rows = rows.withColumn("_order", F.col("_key").bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.xxhash64("_rid").bitwiseAND(F.lit(_LOW))))
    narrow = rows.select("_rid", "_order", "_size")
    n_rows, total = narrow.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0.0))).first()
    n_ranges = max(RANGES, n_rows // ROWS_A_RANGE)
    aim = max(total, 1.0) / n_ranges
    drawn = _sample(narrow, aim / SAMPLES_A_RANGE, 1).toPandas()["_order"].to_numpy(np.int64)  # about n_ranges x SAMPLES_A_RANGE keys
    splitters = _quantiles(drawn, n_ranges)

    totals = _totals(narrow, splitters)
    over = totals[(totals["size"] > OVERFULL * aim) & (totals["n"] > 1) | (totals["n"] > 2 * ROWS_A_RANGE)]
    if len(over):
        inside = _range_of(narrow, splitters).join(F.broadcast(spark.createDataFrame(over[["_range"]])), "_range", "left_semi")
        finer = aim / SAMPLES_A_RANGE / 4
        more = _sample(inside, finer, 2).unionByName(_sample(inside.withColumn("_size", F.lit(1.0)), ROWS_A_RANGE / 4, 3)).toPandas()["_order"].to_numpy(np.int64)
        more = np.sort(more)
        of = np.searchsorted(splitters, more, side="right")
        parts = {int(r): int(np.ceil(max(4 * z / aim, 4 * n / ROWS_A_RANGE))) for r, z, n in zip(over["_range"], over["size"], over["n"])}
        cuts = [_quantiles(more[np.searchsorted(of, r, "left"):np.searchsorted(of, r, "right")], k) for r, k in parts.items()]
        splitters = np.unique(np.concatenate([splitters, *cuts]))
        totals = _totals(narrow, splitters)

    units, share = _units(totals, splitters), total / n_shards
    dealt, most = _deal(units, n_shards)
    while most > NEAR * total / n_shards and any(len(u) > 1 for u in units):
        units = [p for u in units for p in ([[x] for x in u] if sum(x[1] for x in u) > share else [u])]
        dealt, most = _deal(units, n_shards)
        share /= 2
    places = spark.createDataFrame(pd.DataFrame(dealt, columns=["_range", "_shard", "_first"]).astype("int64"), "_range long, _shard long, _first long")
    ranked = _range_of(rows, splitters).withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy("_order", "_rid")) - 1)
    return ranked.join(F.broadcast(places), "_range").select(  # one row for each range
        *[F.col(o).alias(c) for c, o in zip(kept, own)], F.col("_shard").cast("int").alias("shard"), (F.col("_first") + F.col("_rank")).cast("long").alias("slot"))


def _totals(narrow: DataFrame, splitters: np.ndarray) -> pd.DataFrame:
    """_range, size, n of every range that has rows."""
    return _range_of(narrow, splitters).groupBy("_range").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).toPandas()
