"""Behaviour pins on small inline frames: what the driver tables cannot show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import numeric_prefix_float, numeric_prefix_int, stock_status
from ledgerloom.operators import Rule, apply_changes, latest_per_key
from ledgerloom.plans import inventory, receiving, sales, shipping, telemetry
from ledgerloom.schemas import SCHEMAS
from ledgerloom.tables import Tables

D = dt.date
TS = dt.datetime


def empty(spark, name):
    return spark.createDataFrame([], SCHEMAS[name])


def test_trailing_days_rejects_bad_values(spark):
    t = Tables.from_frames(spark, {"sales": empty(spark, "sales")})
    for bad in (-1, "30", 1.5, True):
        with pytest.raises(ValueError):
            sales.sales_trend(t, as_of="2024-01-10", days=bad)


def test_trailing_window_is_inclusive_and_open_ended(spark):
    rows = [(D(2024, 1, 1), 1.0), (D(2023, 12, 31), 2.0), (D(2024, 1, 31), 4.0), (D(2024, 2, 5), 8.0)]
    s = spark.createDataFrame(rows, "date date, total_amount double")
    t = Tables.from_frames(spark, {"sales": s})
    got = {r["date"]: r["daily_total"] for r in sales.sales_trend(t, as_of="2024-01-31", days=30).collect()}
    # 2024-01-01 is exactly 30 days back (kept); the future day passes (no upper bound)
    assert got == {D(2024, 1, 1): 1.0, D(2024, 1, 31): 4.0, D(2024, 2, 5): 8.0}


def test_dashboard_zeroes_on_empty_tables_but_stats_stay_null(spark):
    t = Tables.from_frames(spark, {n: empty(spark, n) for n in
                                   ("sales", "inventory", "receiving_orders", "exception_records")})
    row = sales.dashboard_overview(t, as_of="2024-01-01").collect()[0]
    assert (row.total_sales, row.total_products, row.low_stock_count, row.today_sales) == (0.0, 0, 0, 0.0)
    st = receiving.receiving_stats(t).collect()[0]
    assert st.total_orders == 0 and st.total_amount is None and st.avg_quality_score is None  # D20


def test_stock_status_null_bounds(spark):
    df = spark.createDataFrame([(5, None, 3), (5, None, None), (5, 5, 1), (5, 1, 9)], "c int, mn int, mx int")
    got = [r[0] for r in df.select(stock_status(F.col("c"), F.col("mn"), F.col("mx"))).collect()]
    assert got == ["high", "normal", "low", "normal"]  # null min can still be high; low wins over high


def test_numeric_prefix_parsing(spark):
    df = spark.createDataFrame([("12abc",), ("12.7",), ("abc",), ("",), (" 7 ",), ("-3x",), ("0",), (None,)], "v string")
    ints = [r[0] for r in df.select(numeric_prefix_int("v")).collect()]
    floats = [r[0] for r in df.select(numeric_prefix_float("v")).collect()]
    assert ints == [12, 12, None, None, 7, -3, 0, None]
    assert floats == [12.0, 12.7, None, None, 7.0, -3.0, 0.0, None]


def test_alert_inbox_orders_unread_then_newest_with_id_tiebreak(spark):
    rows = [(i, "t", "m", "info", i % 2, TS(2024, 1, 1, 0, i // 3)) for i in range(1, 80)]
    a = spark.createDataFrame(rows, SCHEMAS["alerts"])
    got = inventory.alert_inbox(Tables.from_frames(spark, {"alerts": a})).collect()
    assert len(got) == 50
    keys = [(r.is_read, -r.created_at.timestamp(), -r.id) for r in got]
    assert keys == sorted(keys) and got[0].is_read == 0


def test_low_stock_alert_message_and_once_per_day(spark):
    inv = spark.createDataFrame([(1, "Widget", "c", 3, 5, 10, None, "s", None)], SCHEMAS["inventory"])
    t = Tables.from_frames(spark, {"inventory": inv, "alerts": empty(spark, "alerts")})
    row = inventory.low_stock_alerts(t, run_ts="2024-01-02 09:00:00").collect()[0]
    assert row.message == "Widget 库存不足，当前: 3，最低: 5" and row.severity == "warning"
    seen = spark.createDataFrame([(9, "low_stock", row.message, "warning", 0, TS(2024, 1, 2, 9))], SCHEMAS["alerts"])
    t2 = Tables.from_frames(spark, {"inventory": inv, "alerts": seen})
    assert inventory.low_stock_alerts(t2, run_ts="2024-01-02 10:00:00", once_per_day=True).count() == 0
    assert inventory.low_stock_alerts(t2, run_ts="2024-01-03 09:00:00", once_per_day=True).count() == 1


def test_apply_sales_can_go_negative_and_ignores_unknown(spark):
    inv = spark.createDataFrame([(1, "A", "c", 2, 1, 9, None, "s", None), (2, "B", "c", 5, 1, 9, None, "s", None)],
                                SCHEMAS["inventory"])
    s = spark.createDataFrame([("A", 3), ("A", 1), ("Z", 7)], "product_name string, quantity int")
    got = {r.product_name: r.current_stock for r in sales.apply_sales_to_stock(inv, s).collect()}
    assert got == {"A": -2, "B": 5}


def test_apply_sales_property_total_change_equals_known_sold(spark):
    inv = spark.createDataFrame([(i, f"P{i}", "c", 50, 1, 9, None, "s", None) for i in range(20)],
                                SCHEMAS["inventory"])
    s = spark.createDataFrame([(f"P{i % 25}", i % 4 + 1) for i in range(200)], "product_name string, quantity int")
    before = inv.agg(F.sum("current_stock")).first()[0]
    after = sales.apply_sales_to_stock(inv, s).agg(F.sum("current_stock")).first()[0]
    known = s.where(F.col("product_name").isin([f"P{i}" for i in range(20)])).agg(F.sum("quantity")).first()[0]
    assert before - after == known


def test_upsert_inventory_latest_wins_and_is_idempotent(spark):
    inv = spark.createDataFrame([(1, "A", "c", 2, 1, 9, None, "s", None)], SCHEMAS["inventory"])
    ch = spark.createDataFrame(
        [("A", "x", 7, TS(2024, 1, 1), 1), ("A", "y", 8, TS(2024, 1, 1), 2), ("N", None, 1, TS(2023, 1, 1), 3)],
        "product_name string, category string, current_stock int, change_ts timestamp, seq int")
    once = inventory.upsert_inventory(inv, ch, run_ts="2024-02-01 00:00:00")
    rows = {r.product_name: r for r in once.collect()}
    assert rows["A"].current_stock == 8 and rows["A"].category == "y" and rows["A"].id == 1
    assert rows["A"].min_stock is None  # whole row replaced
    twice = inventory.upsert_inventory(once, ch, run_ts="2024-02-01 00:00:00")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_change_folding_order_nulls_and_guards(spark):
    cur = spark.createDataFrame([(1, "preparing", None), (2, "preparing", None)],
                                "id bigint, status string, actual_delivery date")
    ch = spark.createDataFrame([
        (1, 1, TS(2024, 1, 1), "delivered", D(2024, 1, 1)),
        (2, 1, TS(2024, 1, 2), "in_transit", D(2024, 1, 9)),   # guard fails: date ignored
        (3, 1, TS(2024, 1, 3), None, None),                    # nothing supplied
        (4, 2, TS(2024, 1, 5), "delivered", None),             # delivered without a date
        (5, 2, TS(2024, 1, 4), "in_transit", None),            # older by time, later by seq
        (6, 9, TS(2024, 1, 5), "delivered", D(2024, 1, 5)),    # unknown key ignored
    ], "seq bigint, id bigint, change_ts timestamp, status string, actual_delivery date")
    out = {r.id: r for r in shipping.apply_shipping_status(cur, ch).collect()}
    assert out[1].status == "in_transit" and out[1].actual_delivery == D(2024, 1, 1)
    assert out[2].status == "delivered" and out[2].actual_delivery is None
    assert set(out) == {1, 2}


def test_packing_guard_needs_time_and_completed(spark):
    cur = spark.createDataFrame([(1, "pending", None, None)],
                                "id bigint, status string, actual_time int, completed_at timestamp")
    ch = spark.createDataFrame([(1, 1, TS(2024, 1, 1), "completed", None), (2, 1, TS(2024, 1, 2), "packing", 30)],
                               "seq bigint, id bigint, change_ts timestamp, status string, actual_time int")
    r = shipping.apply_packing_status(cur, ch).first()
    assert (r.status, r.actual_time, r.completed_at) == ("packing", None, None)


def test_exception_resolved_date_guard(spark):
    cur = spark.createDataFrame([(1, "reported", None)], "id bigint, status string, resolved_date date")
    ch = spark.createDataFrame([(1, 1, TS(2024, 1, 1), "resolved", D(2024, 1, 1)),
                                (2, 1, TS(2024, 1, 2), "investigating", D(2024, 1, 2))],
                               "seq bigint, id bigint, change_ts timestamp, status string, resolved_date date")
    r = receiving.apply_exception_status(cur, ch).first()
    assert (r.status, r.resolved_date) == ("investigating", D(2024, 1, 1))


def test_latest_per_key_tie_break_is_deterministic(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 1, "z")], "k int, o int, v string")
    got = {r.k: r.v for r in latest_per_key(df, ["k"], ["o"]).collect()}
    assert got == {1: "b", 2: "z"}


def test_apply_changes_generic_optional_fields(spark):
    cur = spark.createDataFrame([(1, "a", 1.0)], "id bigint, status string, score double")
    ch = spark.createDataFrame([(1, 1, TS(2024, 1, 1), "b", 5.0), (2, 1, TS(2024, 1, 2), "c", None)],
                               "seq bigint, id bigint, change_ts timestamp, status string, score double")
    r = apply_changes(cur, ch, ["id"], {"status": Rule(F.col("status")), "score": Rule(F.col("score"))}).first()
    assert (r.status, r.score) == ("c", 5.0)  # null score means "not supplied" (D22)


def test_inspection_detail_returns_real_array_and_empty_for_none(spark):
    ir = spark.createDataFrame([(10, 1, "i", D(2024, 1, 1), 90.0), (11, 2, "j", D(2024, 1, 1), 70.0)],
                               SCHEMAS["inspection_reports"])
    qc = spark.createDataFrame([(2, 10, "size, shape", "s", "pass", "1", None), (1, 10, "colour", "s", "fail", "2", "n")],
                               SCHEMAS["quality_checks"])
    t = Tables.from_frames(spark, {"inspection_reports": ir, "quality_checks": qc})
    got = {r.id: r.quality_checks for r in receiving.inspection_report_detail(t).collect()}
    assert [c.id for c in got[10]] == [1, 2] and got[10][1].check_item == "size, shape"  # D5: commas survive
    assert got[11] == []


def test_receiving_detail_takes_lowest_report(spark):
    ro = spark.createDataFrame([(1, "R1")], "id bigint, receiving_no string")
    ri = spark.createDataFrame([], SCHEMAS["receiving_items"])
    ir = spark.createDataFrame([(12, 1, "b", D(2024, 1, 2), 80.0), (11, 1, "a", D(2024, 1, 1), 60.0)],
                               SCHEMAS["inspection_reports"])
    t = Tables.from_frames(spark, {"receiving_orders": ro, "receiving_items": ri, "inspection_reports": ir,
                                   "quality_checks": spark.createDataFrame([], SCHEMAS["quality_checks"])})
    r = receiving.receiving_order_detail(t).first()
    assert r.inspection_report.id == 11 and r.items == []  # D6


def test_packing_list_unknown_priority_first_and_customer_from_shipment(spark):
    pt = spark.createDataFrame([(1, 5, "own", "low", "pending", "p", 30, None, None, TS(2024, 1, 1), None),
                                (2, 6, "own", "weird", "pending", "p", 30, None, None, TS(2024, 1, 3), None),
                                (3, 5, "own", "high", "pending", "p", 30, None, None, TS(2024, 1, 2), None)],
                               SCHEMAS["packing_tasks"])
    so = spark.createDataFrame([(5, "S5", None, "Alice", "Addr")],
                               "id bigint, shipping_no string, sales_order_id bigint, customer_name string, "
                               "shipping_address string")
    pi = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], SCHEMAS["packing_items"])
    t = Tables.from_frames(spark, {"packing_tasks": pt, "shipping_orders": so, "packing_items": pi})
    got = shipping.packing_task_list(t).collect()
    assert [r.id for r in got] == [2, 3, 1]
    assert [r.customer_name for r in got] == [None, "Alice", "Alice"]  # P14
    assert [r.item_count for r in got] == [0, 0, 2]


def test_telemetry_future_rows_count_in_totals_not_buckets(spark):
    now = TS(2024, 1, 2, 12, 0, 0)
    rows = [(1, "js", "high", TS(2024, 1, 2, 11, 30)), (2, "js", "critical", TS(2024, 1, 2, 13, 0)),
            (3, "net", "medium", TS(2024, 1, 1, 12, 0)), (4, "net", "medium", TS(2024, 1, 1, 12, 0, 1))]
    t = Tables.from_frames(spark, {"error_log": spark.createDataFrame(rows, SCHEMAS["error_log"])})
    stats = {(r.dimension, r.key): r.errors for r in telemetry.error_stats(t, now=now).collect()}
    assert stats[("total", None)] == 3  # strictly newer than now-24h, future row included
    trend = [r.errors for r in telemetry.error_hourly_trend(t, now=now).collect()]
    assert len(trend) == 24 and trend[23] == 1 and trend[0] == 1 and sum(trend) == 2


def test_performance_stats_ignores_missing_duration_and_zero_averages(spark):
    now = TS(2024, 1, 2)
    rows = [(1, "api_call", None, 500, TS(2024, 1, 1, 23)), (2, "api_call", 2500, 200, TS(2024, 1, 1, 23)),
            (3, "api_call", 2000, None, TS(2024, 1, 1, 22))]
    df = spark.createDataFrame(rows, "id bigint, type string, duration int, status int, ts timestamp")
    df = df.withColumn("duration", F.col("duration").cast("decimal(18,2)"))
    r = telemetry.performance_stats(Tables.from_frames(spark, {"metric_log": df}), now=now).first()
    assert r.page_load_avg == 0.0 and r.page_load_count == 0  # empty average reads 0
    assert r.api_avg == 2250.0 and r.api_total == 3 and r.api_slow == 1 and r.api_failed == 1  # D21


def test_keep_last_and_critical(spark):
    df = spark.createDataFrame([(i, "t", "critical" if i % 5 == 0 else "high", TS(2024, 1, 1)) for i in range(1, 31)],
                               SCHEMAS["error_log"])
    assert sorted(r.id for r in telemetry.telemetry_keep_last(df, n=10).collect()) == list(range(21, 31))
    r = telemetry.critical_errors(df).first()
    assert (r.processed, r.critical) == (30, 6)


def test_nested_children_page_a_hot_key(spark):
    from ledgerloom.operators import nest_children
    rows = [(1, i, i % 7) for i in range(1000)] + [(2, i, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, item int, q int")
    pages = nest_children(df, "k", ["item", "q"], "items", sort_fields=["item"], page_size=100).collect()
    hot = [p for p in pages if p.k == 1]
    assert len(hot) == 10 and all(len(p.items) <= 250 for p in hot)
    assert sorted(e.item for p in hot for e in p.items) == list(range(1000))
    assert all([e.item for e in p.items] == sorted(e.item for e in p.items) for p in hot)
    assert [(p.page, len(p.items)) for p in pages if p.k == 2] == [(0, 5)]


def test_append_tracking_and_exceptions_shapes(spark):
    scans = spark.createDataFrame([(5, TS(2024, 1, 1), "picked")], "shipping_order_id bigint, timestamp timestamp, status string")
    r = shipping.append_tracking(scans).first()
    assert (r.shipping_order_id, r.status, r.location) == (5, "picked", None)
    batch = spark.createDataFrame([(1, "damage", ["a.jpg", "b.jpg"])],
                                  "receiving_order_id bigint, exception_type string, evidence_files array<string>")
    e = receiving.append_exceptions(batch, run_ts="2024-01-01 00:00:00").first()
    assert e.status == "reported" and e.evidence_files == '["a.jpg","b.jpg"]' and e.created_at == TS(2024, 1, 1)


def test_split_requests_header_status_and_item_positions(spark):
    req = spark.createDataFrame([("SH1", "Ann", [(7, 2), (8, 1)])],
                                "shipping_no string, customer_name string, items array<struct<product_id:bigint,quantity:int>>")
    headers, items = shipping.split_shipping_orders(req, run_ts="2024-01-01 00:00:00")
    h = headers.first()
    assert h.status == "preparing" and h.shipping_no == "SH1"
    assert sorted((r.item_index, r.product_id, r.shipping_order_id == h.id) for r in items.collect()) == \
        [(0, 7, True), (1, 8, True)]


def test_append_reports_keeps_newest_by_arrival(spark):
    log = spark.createDataFrame([(i, "t", "high", TS(2024, 1, 1)) for i in range(1, 9)], SCHEMAS["error_log"])
    batch = spark.createDataFrame([(i, "t", "critical", TS(2024, 1, 2)) for i in range(9, 12)], SCHEMAS["error_log"])
    out = telemetry.append_reports(log, batch, run_ts="2024-01-02 00:00:00", keep=5).collect()
    assert sorted(r.id for r in out) == [7, 8, 9, 10, 11]
    assert {r.processed for r in out if r.id >= 9} == {False} and {r.processed for r in out if r.id < 9} == {None}


def test_detail_fetch_by_ids_list_or_frame(spark):
    so = spark.createDataFrame([(1, "S1"), (2, "S2"), (3, "S3")], "id bigint, shipping_no string")
    si = spark.createDataFrame([(1, 7, 1, 2), (2, 8, 1, 1)], SCHEMAS["shipping_items"])
    tr = spark.createDataFrame([(10, 1, None, TS(2024, 1, 1), None, "picked", None, None),
                                (11, 1, None, TS(2024, 1, 2), None, "shipped", None, None)], SCHEMAS["tracking_records"])
    t = Tables.from_frames(spark, {"shipping_orders": so, "shipping_items": si, "tracking_records": tr})
    by_list = shipping.shipping_order_detail(t, ids=[1, 3]).collect()
    assert sorted(r.id for r in by_list) == [1, 3]
    r1 = [r for r in by_list if r.id == 1][0]
    assert [x.status for x in r1.tracking_info] == ["shipped", "picked"]  # O6: newest first
    by_frame = shipping.shipping_order_detail(t, ids=spark.createDataFrame([(2,)], "x bigint")).collect()
    assert [(r.id, len(r.items), r.tracking_info) for r in by_frame] == [(2, 1, [])]


def test_error_stats_total_present_on_empty_window(spark):
    t = Tables.from_frames(spark, {"error_log": empty(spark, "error_log")})
    rows = [(r.dimension, r.key, r.errors) for r in telemetry.error_stats(t, now=TS(2024, 1, 1)).collect()]
    assert rows == [("total", None, 0)]
    assert [r.errors for r in telemetry.error_hourly_trend(t, now=TS(2024, 1, 1)).collect()] == [0] * 24


def test_details_and_splits_keep_one_row_above_ten_thousand_children(spark):
    from ledgerloom import bindings
    n = 10_050
    many = spark.range(n)
    ro = spark.createDataFrame([(1, "R1", 5, "S", D(2024, 1, 1), 1)], "id bigint, receiving_no string, supplier_id bigint, supplier_name string, planned_date date, total_amount int")
    so = spark.createDataFrame([(1, "S1", "c", "a", "k", D(2024, 1, 1), D(2024, 1, 2))],
                               "id bigint, shipping_no string, customer_name string, shipping_address string, carrier_code string, shipping_date date, expected_delivery date")
    one = F.lit(1).cast("bigint")
    t = Tables.from_frames(spark, {
        "as_of": spark.createDataFrame([(D(2024, 1, 1),)], "d date"), "receiving_orders": ro, "shipping_orders": so,
        "receiving_items": many.select(one.alias("receiving_order_id"), F.col("id").alias("product_id"), F.lit(2).alias("ordered_quantity"),
                                       F.lit(1).alias("received_quantity"), F.lit(0).alias("rejected_quantity"), F.lit(D(2024, 2, 1)).alias("expiry_date")),
        "shipping_items": many.select(one.alias("shipping_order_id"), (F.col("id") % 3).alias("product_id"), F.lit(1).alias("line_no"), F.lit(1).alias("quantity")),
        "tracking_records": many.select("id", one.alias("shipping_order_id"), F.timestamp_seconds(F.col("id")).alias("timestamp"), F.lit("x").alias("status")),
        "inspection_reports": spark.createDataFrame([(10, 1, "i", D(2024, 1, 1), 90.0)], SCHEMAS["inspection_reports"]),
        "quality_checks": many.select("id", F.lit(10).cast("bigint").alias("inspection_report_id"), F.lit("size").alias("check_item"))})
    [report] = receiving.inspection_report_detail(t).collect()
    assert report.page == 0 and [c.id for c in report.quality_checks] == list(range(n))
    [receipt] = receiving.receiving_order_detail(t).collect()
    assert [i.product_id for i in receipt["items"]] == list(range(n)) and len(receipt.inspection_report.quality_checks) == n
    [shipment] = shipping.shipping_order_detail(t).collect()
    assert [i.product_id for i in shipment["items"]] == sorted(i % 3 for i in range(n))
    assert [s.id for s in shipment.tracking_info] == list(range(n))[::-1]  # newest first over the whole order
    assert sorted((r.item_index, r.product_id) for r in bindings._split_receiving_orders(t).collect()) == [(i, i) for i in range(n)]
    assert sorted(r.item_index for r in bindings._split_shipping_orders(t).collect()) == list(range(n))


def test_pages_asked_for_keep_order_and_size(spark):
    from ledgerloom.operators import nest_children
    df = spark.createDataFrame([(1, i // 50) for i in range(250)] + [(1, 9)] * 101, "k int, item int")
    pages = sorted(nest_children(df, "k", ["item"], "items", sort_fields=["item"], page_size=100).collect(), key=lambda p: p.page)
    assert [len(p["items"]) for p in pages] == [100, 100, 100, 51]
    got = [e.item for p in pages for e in p["items"]]
    assert got == sorted(got)


def test_inspection_reports_without_checks_leave_a_row(spark):
    reports = spark.createDataFrame([(1, 5, "Ann", D(2024, 1, 1), 80.0, ["a.jpg", "b.jpg"], []), (2, 5, "Bob", D(2024, 1, 2), 90.0, None, [(7, "size")])],
                                    "id bigint, receiving_order_id bigint, inspector string, inspection_date date, overall_rating double, "
                                    "photos array<string>, quality_checks array<struct<id:bigint,check_item:string>>")
    orders, rows, checks = receiving.apply_inspection_reports(reports, spark.createDataFrame([(5, None)], "id bigint, quality_score double"))
    assert orders.first().quality_score == 90.0
    assert sorted((r.id, r.inspector, r.photos, r.certificates) for r in rows.collect()) == [(1, "Ann", '["a.jpg","b.jpg"]', None), (2, "Bob", None, None)]
    assert [(c.inspection_report_id, c.id, c.check_item) for c in checks.collect()] == [(2, 7, "size")]
