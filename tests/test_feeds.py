"""The feeds: any order of arrival, files sent again, hours without reports, late rows, state that expires."""

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from ledgerloom.operators.changes import fold_changes, Rule
from ledgerloom.streaming import feeds, shipments

TS = dt.datetime
CHANGES = "id bigint, change_ts timestamp, seq bigint, status string, actual_delivery date"


def _changes(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 1 if i % 3 == 0 else rng.randrange(2, 30)          # one shipment holds a third of all changes
        out.append((key, TS(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(400)), rng.choice([i, i, None]),
                    rng.choice(["delivered", "in_transit", "picked", None]), rng.choice([None, dt.date(2024, 1, 1 + i % 28)])))
    return out + [out[0], out[0], (None, TS(2024, 1, 1), 1, "picked", None), (5, None, 2, "lost", None)]


def _batch(spark, rows):
    df = spark.createDataFrame(rows, CHANGES).where("id IS NOT NULL AND change_ts IS NOT NULL")
    folded = fold_changes(df, ["id"], {"status": Rule(F.col("status")),
                                       "actual_delivery": Rule(F.col("actual_delivery"), guard=F.col("status") == "delivered")})
    return {r.id: (r._new_status, r._new_actual_delivery) for r in folded.collect()
            if r._new_status is not None or r._new_actual_delivery is not None}


def test_shipment_stream_equals_batch_fold_in_any_order(spark, tmpdir_path):
    rows = _changes(600, 3)
    random.Random(4).shuffle(rows)
    src, sink, ck = (os.path.join(tmpdir_path, n) for n in ("src", "sink", "ck"))
    schema = spark.createDataFrame([], CHANGES).schema
    for part in (rows[:200], rows[200:450], rows[450:], rows[:50]):   # the last file was sent before
        spark.createDataFrame(part, CHANGES).write.mode("append").parquet(src)
        shipments.start_shipments(spark, src, schema, sink, checkpoint=ck).awaitTermination(60)
    got = {r.id: (r.status, r.actual_delivery) for r in shipments.read_shipments(spark, sink).collect()}
    assert got == _batch(spark, rows)

    # late by hand: changes older than the newest status of the files before, or that fold into nothing
    order = lambda r: (r[1], -1 if r[2] is None else 0, r[2] or 0)
    newest, late = {}, 0
    for part in (rows[:200], rows[200:450], rows[450:], rows[:50]):
        late += sum(1 for r in part if r[0] is None or r[1] is None or (r[0] in newest and order(r) < newest[r[0]]))
        for r in part:
            if r[0] is not None and r[1] is not None and r[3] is not None:
                newest[r[0]] = max(newest.get(r[0], order(r)), order(r))
    assert late and shipments.read_late_changes(spark, sink).count() == late


def test_shipment_state_expires_and_result_stays(spark, tmpdir_path):
    src, sink, ck = (os.path.join(tmpdir_path, n) for n in ("src", "sink", "ck"))
    schema = spark.createDataFrame([], CHANGES).schema
    held = lambda: spark.read.format("statestore").load(ck).count()

    def send(*rows):
        spark.createDataFrame(list(rows), CHANGES).write.mode("append").parquet(src)
        shipments.start_shipments(spark, src, schema, sink, checkpoint=ck, ttl="4s").awaitTermination(60)

    send((1, TS(2024, 1, 5), 1, "delivered", dt.date(2024, 1, 5)), (2, TS(2024, 1, 5), 2, "picked", None))
    assert held() == 2
    time.sleep(5)
    send((3, TS(2024, 1, 1), 3, "picked", None), (1, TS(2024, 1, 2), 0, "in_transit", None))
    assert held() == 2                                     # 1 began anew, 3 is new, 2 has gone
    got = {r.id: (r.status, r.actual_delivery) for r in shipments.read_shipments(spark, sink).collect()}
    assert got == {1: ("delivered", dt.date(2024, 1, 5)), 2: ("picked", None), 3: ("picked", None)}


def test_reports_sent_again_count_once_and_empty_hours_are_zero(spark, tmpdir_path):
    schema = "id string, type string, severity string, ts timestamp"
    at = lambda h, m=0: TS(2024, 3, 1, h, m)
    first = [("a", "js", "high", at(1)), ("b", "js", "high", at(1, 5)), (None, "js", "high", at(1, 6)), ("c", "net", "low", at(4)),
             (None, "js", "high", at(1, 7))]
    src, out, ck = (os.path.join(tmpdir_path, n) for n in ("src", "out", "ck"))
    frame = spark.createDataFrame(first, schema)
    frame.coalesce(1).write.mode("append").parquet(src)
    frame.coalesce(1).write.mode("append").parquet(src)    # the same file again, within one batch

    def go():
        q = feeds.start_hourly_errors(spark, src, frame.schema, out, checkpoint=ck, watermark="6 hours", report_id="id")
        q.awaitTermination(60)
        return feeds.late_rows(q)

    assert go() == 0
    spark.createDataFrame(first[:2] + [("d", "js", "high", at(23))], schema).coalesce(1).write.mode("append").parquet(src)
    assert go() == 0                                       # again, in a later batch, still within the watermark
    spark.createDataFrame([("late", "js", "high", at(1)), ("late2", "js", "high", at(2))], schema).coalesce(1).write.mode("append").parquet(src)
    assert go() == 2
    windows = spark.read.parquet(out)
    got = {(r.window_start.hour, r.type): r.errors for r in windows.collect()}
    assert got == {(1, "js"): 4, (4, "net"): 1}
    full = {(r.window_start.hour, r.type): r.errors for r in feeds.closed_hours(windows, ["type", "severity"], ["errors"]).collect()}
    assert full == {(h, t): got.get((h, t), 0) for h in range(1, 5) for t in ("js", "net")}
    assert feeds.closed_hours(windows.limit(0), ["type", "severity"], ["errors"]).count() == 0
