"""Property tests: set-wise change folding equals sequential application."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.plans import shipping

STATUSES = ["preparing", "shipped", "delivered", None]
change = st.tuples(st.integers(1, 3), st.integers(0, 5), st.sampled_from(STATUSES),
                   st.one_of(st.none(), st.integers(1, 28)))


def sequential(current, changes):
    """The reference's behaviour: one UPDATE per change, in (change_ts, seq) order."""
    state = {k: dict(v) for k, v in current.items()}
    for seq, (key, ts, status, day) in sorted(enumerate(changes), key=lambda x: (x[1][1], x[0])):
        if key not in state:
            continue
        if status is not None:
            state[key]["status"] = status
        if day is not None and status == "delivered":
            state[key]["actual_delivery"] = dt.date(2024, 1, day)
    return state


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(change, min_size=0, max_size=12))
def test_fold_equals_sequential_application(spark, changes):
    current = {1: {"status": "preparing", "actual_delivery": None}, 2: {"status": "shipped", "actual_delivery": None}}
    cur = spark.createDataFrame([(k, v["status"], v["actual_delivery"]) for k, v in current.items()],
                                "id bigint, status string, actual_delivery date")
    rows = [(seq, key, dt.datetime(2024, 1, 1) + dt.timedelta(hours=ts), status,
             dt.date(2024, 1, day) if day else None) for seq, (key, ts, status, day) in enumerate(changes)]
    ch = spark.createDataFrame(rows, "seq bigint, id bigint, change_ts timestamp, status string, actual_delivery date")
    got = {r.id: {"status": r.status, "actual_delivery": r.actual_delivery}
           for r in shipping.apply_shipping_status(cur, ch).collect()}
    assert got == sequential(current, changes)


def test_only_rows_that_a_change_hits_are_stamped(spark):
    from pyspark.sql import functions as F

    from ledgerloom.plans import receiving, shipping
    from ledgerloom.schemas import SCHEMAS

    old, first, last = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"
    orders = spark.createDataFrame([(1, "pending", old), (2, "pending", old), (3, "pending", None)], "id long, status string, updated_at string").withColumn(
        "updated_at", F.col("updated_at").cast("timestamp"))
    changes = spark.createDataFrame([(1, "partial", last, 1), (1, "inspecting", first, 2), (3, None, first, 3), (9, "x", last, 4)],
                                    "id long, status string, change_ts string, seq long").withColumn("change_ts", F.col("change_ts").cast("timestamp"))
    changes = changes.withColumns({"actual_delivery": F.lit(None).cast("date"), "received_amount": F.lit(None).cast("double"), "quality_score": F.lit(None).cast("double")})
    for apply in (receiving.apply_receiving_status, shipping.apply_shipping_status):
        got = {r.id: (r.status, str(r.updated_at)) for r in apply(orders, changes).collect()}
        assert got == {1: ("partial", last), 2: ("pending", old), 3: ("pending", first)}
    assert "updated_at" not in shipping.apply_shipping_status(orders.drop("updated_at"), changes).columns
    reports = spark.createDataFrame([(7, 1, 88.0, [])], "id long, receiving_order_id long, overall_rating double, quality_checks array<struct<id:long>>")
    receipts = spark.createDataFrame([(1, 50.0, None), (2, 60.0, None)], "id long, quality_score double, updated_at timestamp")
    got = {r.id: (r.quality_score, r.updated_at and str(r.updated_at)) for r in receiving.apply_inspection_reports(reports, receipts, run_ts=last)[0].collect()}
    assert got == {1: (88.0, last), 2: (60.0, None)}
    scans = spark.createDataFrame([(4, "T", "Ann")], "shipping_order_id long, tracking_no string, operator string")
    assert shipping.append_tracking(scans).first().operator == "Ann" and SCHEMAS["tracking_records"]["operator"]


def test_equal_sales_are_numbered_in_slices(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from ledgerloom.plans import normalise

    monkeypatch.setattr(normalise, "SLICE", 70)
    rows = [(None, "hot", 1.0)] * 1000 + [(None, f"s{i % 400}", None) for i in range(1200)] + [(None, "even", 2.0)] * 140
    df = spark.createDataFrame(rows, "id long, name string, price double")
    same = F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(1)))
    want = sorted(r[0] for r in df.select(F.xxhash64("name", "price", same)).collect())
    for parts in (1, 5):
        got = normalise._numbered(df.repartition(parts), df.columns, "n")
        assert sorted(r[0] for r in got.select(F.xxhash64("name", "price", "n")).collect()) == want and len(set(want)) == len(rows)
