"""The shipment feed with expiring state: status changes folded by the guards of the batch job W8.

``fold_shipments`` keeps one small state per shipment (``applyInPandasWithState``): the newest status and, apart from it, the
newest delivery date that came with the status 'delivered', each with its (change_ts, seq). A state that takes no change for
``ttl`` leaves the store, so the store holds the shipments of one ``ttl``, not all that ever were.

Output rows, append mode: ``kind`` 'state' is what a shipment's fold is after a batch, with the order of each field; ``kind``
'late' is a change older than the status its shipment had before the batch. A late change is folded like any other (it may still
carry the newest delivery date). ``read_shipments`` takes, field by field, the value with the greatest order over all state rows,
so it equals the batch fold of all changes for any order of arrival, also after a state has expired and begun anew, and a
replayed batch changes nothing.

Null values mean "not supplied" (D22). Changes without an id or a time fold into nothing and are late. Of changes with one
(change_ts, seq) the greatest value counts, as in the batch fold. Rows of one shipment arrive in Arrow batches and are folded as
they come, so a shipment with a third of all changes costs time but no memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.shipping import DELIVERED_STATUS

STATE = "status_ts timestamp, status_seq bigint, status string, delivery_ts timestamp, delivery_seq bigint, actual_delivery date"
IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
OUTPUT = f"id bigint, kind string, change_ts timestamp, seq bigint, {STATE}"


def _folder(ttl_ms: int, delivered: str):
    """The function that folds a shipment's changes into its state; see the module's docstring for the rows that come out."""
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = status, delivery = _parts(state.get if state.exists else None)
        for frame in frames:
            late = []
            for ts, seq, text, day in zip(frame["change_ts"], frame["seq"], frame["status"], frame["actual_delivery"]):
                ts, seq, text, day = (None if pd.isna(v) else v for v in (ts, seq, text, day))
                lost = ts is None or pd.isna(key[0])
                if lost or (before[0] is not None and _order(ts, seq) < before[0][0]):
                    late.append((None if pd.isna(key[0]) else key[0], "late", ts, seq, None, None, text, None, None, day))
                if lost:
                    continue
                if text is not None:
                    status = _newest(status, (_order(ts, seq), text))
                if day is not None and text == delivered:
                    delivery = _newest(delivery, (_order(ts, seq), day))
            if late:
                yield _frame(late)
        if status is None and delivery is None:
            return
        row = (*_flat(status), *_flat(delivery))
        state.update(row)
        state.setTimeoutDuration(ttl_ms)
        if (status, delivery) != before:
            yield _frame([(key[0], "state", None, None, *row)])
    return fold


def _order(ts, seq) -> tuple:
    """The order of a change; a missing ``seq`` is the smallest, as in Spark's comparison of structs."""
    return pd.Timestamp(ts), -1 if seq is None else 0, 0 if seq is None else int(seq)


def _newest(old: tuple | None, new: tuple) -> tuple:
    return new if old is None else max(old, new)


def _parts(state) -> tuple:
    """(status, delivery) of a stored state, each None or (order, value)."""
    if state is None:
        return None, None
    a_ts, a_seq, a, b_ts, b_seq, b = state
    return (None if a is None else (_order(a_ts, a_seq), a)), (None if b is None else (_order(b_ts, b_seq), b))


def _flat(part: tuple | None) -> tuple:
    if part is None:
        return None, None, None
    (ts, has_seq, seq), value = part
    return ts.to_pydatetime(), seq if has_seq == 0 else None, value


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in names:
        if c.endswith("_ts"):
            out[c] = pd.to_datetime(out[c])
        elif c == "id" or c == "seq" or c.endswith("_seq"):
            out[c] = out[c].astype("Int64")
    return out


def fold_shipments(changes: DataFrame, *, ttl: str = "30 days", delivered: str = DELIVERED_STATUS) -> DataFrame:
    """State and late rows of a stream of changes (id, change_ts, seq, status, actual_delivery); other columns are left aside."""
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    if ttl_ms <= 0:
        raise ValueError("ttl must be a positive duration")
    narrow = changes.select(F.col("id").cast("bigint").alias("id"), F.col("change_ts").cast("timestamp").alias("change_ts"),
                            F.col("seq").cast("bigint").alias("seq"), F.col("status").cast("string").alias("status"),
                            F.col("actual_delivery").cast("date").alias("actual_delivery"))
    return narrow.groupBy("id").applyInPandasWithState(
        _folder(ttl_ms, delivered), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def start_shipments(spark: SparkSession, source_dir: str, schema, sink_dir: str, *, checkpoint: str, ttl: str = "30 days",
                    name: str = "shipment_fold", available_now: bool = True) -> StreamingQuery:
    """Fold the Parquet files that land in ``source_dir``; rows go to ``sink_dir``, a folder for each ``kind``, exactly once.

    A run over what is there (``available_now``) removes expired states in its next batch with data, a running one each minute.
    """
    out = fold_shipments(spark.readStream.schema(schema).parquet(source_dir), ttl=ttl)
    writer = (out.writeStream.outputMode("append").format("parquet").partitionBy("kind").queryName(name)
              .option("checkpointLocation", checkpoint))
    if not available_now:
        return writer.trigger(processingTime="1 minute").start(sink_dir)
    # with processing time Spark always asks for one more batch without data: a run over what is there would never end
    idle = spark.conf.get(IDLE_BATCHES)
    spark.conf.set(IDLE_BATCHES, "false")
    try:
        return writer.trigger(availableNow=True).start(sink_dir)
    finally:
        spark.conf.set(IDLE_BATCHES, idle)


def _rows(spark: SparkSession, sink_dir: str, kind: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(sink_dir).where(F.col("kind") == kind)


def read_shipments(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The newest status and delivery date of each shipment: (id, status, actual_delivery), an aggregate combined map-side."""
    def newest(prefix: str, value: str):
        packed = F.struct(f"{prefix}_ts", f"{prefix}_seq", value)
        return F.max(F.when(F.col(value).isNotNull(), packed))[value].alias(value)
    return _rows(spark, sink_dir, "state").groupBy("id").agg(newest("status", "status"), newest("delivery", "actual_delivery"))


def read_late_changes(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The changes that came after a newer one: (id, change_ts, seq, status, actual_delivery)."""
    return _rows(spark, sink_dir, "late").select("id", "change_ts", "seq", "status", "actual_delivery")
