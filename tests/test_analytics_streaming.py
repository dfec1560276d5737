"""Analytics reports against brute force on small fixtures, and the streaming feeds against batch."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.quantiles import group_quantiles
from ledgerloom.plans import insights
from ledgerloom.schemas import SCHEMAS
from ledgerloom.streaming import feeds
from ledgerloom.tables import Tables

TS = dt.datetime
D = dt.date


def test_stock_ledger_skewed_product_matches_plain_running_sum(spark):
    rnd = random.Random(7)
    rows, stock = [], {}
    for i in range(1, 3001):
        pid = 1 if i % 3 else rnd.randint(2, 6)          # product 1 holds two thirds of the moves
        ch = rnd.choice([-2, 1, 3])
        stock[pid] = stock.get(pid, 0) + ch + (1 if i % 97 == 0 else 0)
        rows.append((i, pid, "adjust", ch, None, stock[pid], TS(2024, 1, 1) + dt.timedelta(minutes=37 * i)))
    tx = spark.createDataFrame(rows, SCHEMAS["inventory_transactions"])
    got = insights.stock_ledger(Tables.from_frames(spark, {"inventory_transactions": tx})).toPandas()
    pdf = pd.DataFrame(rows, columns=[f.name for f in SCHEMAS["inventory_transactions"].fields])
    pdf = pdf.sort_values(["product_id", "transaction_date", "id"])
    pdf["running"] = pdf.groupby("product_id")["quantity_change"].cumsum()
    pdf["prev"] = pdf.groupby("product_id")["stock_after"].shift(1)
    pdf["brk"] = (pdf["prev"].notna()) & (pdf["stock_after"] != pdf["prev"] + pdf["quantity_change"])
    m = got.merge(pdf, on="id")
    assert len(m) == 3000
    assert (m["running_balance"] == m["running"]).all()
    assert (m["is_break"] == m["brk"]).all() and m["is_break"].sum() > 0


def test_category_tree_depth_and_path(spark):
    cats = spark.createDataFrame([(1, "All", None, None, None), (2, "Food", None, 1, None), (3, "Fruit", None, 2, None),
                                  (4, "Orphan", None, 99, None)], SCHEMAS["categories"])
    got = {r.id: (r.depth, r.path) for r in insights.category_tree(Tables.from_frames(spark, {"categories": cats})).collect()}
    assert got == {1: (0, "All"), 2: (1, "All > Food"), 3: (2, "All > Food > Fruit")}


def test_freight_quote_matches_brute_force(spark):
    carriers = [("A", "a", 1.0, 6, 20, 1), ("B", "b", 2.0, 9, 10, 1), ("C", "c", 3.0, 1, 50, 0), ("D", "d", 0.0, 6, 20, 1)]
    car = spark.createDataFrame(carriers, "code string, name string, rating double, price_per_kg int, min_charge int, "
                                          "is_active int")
    ship = spark.createDataFrame([(i, f"S{i}", float(w)) for i, w in enumerate([0, 1, 2, 3, 5, 8, 40])],
                                 "id bigint, shipping_no string, weight double")
    t = Tables.from_frames(spark, {"carriers": car, "shipping_orders": ship})
    got = {r.id: (r.carrier_code, r.quote) for r in insights.freight_quote(t).collect()}
    for i, w in enumerate([0, 1, 2, 3, 5, 8, 40]):
        best = min((max(w * p, m), code) for code, _, _, p, m, act in carriers if act == 1)
        assert got[i] == (best[1], float(best[0]))


def test_promotion_match_best_discount(spark):
    promos = spark.createDataFrame([
        (1, "p1", "discount", "percentage", 10.0, D(2024, 1, 1), D(2024, 1, 31), 0, "[]", 1),
        (2, "p2", "discount", "amount", 5.0, D(2024, 1, 10), D(2024, 1, 20), 100, "[7]", 1),
        (3, "p3", "discount", "amount", 99.0, D(2024, 1, 1), D(2024, 1, 31), 0, "[]", 0),
    ], "id bigint, name string, type string, discount_type string, discount_value double, start_date date, "
       "end_date date, min_amount int, applicable_products string, is_active int")
    orders = spark.createDataFrame([(1, D(2024, 1, 15), 200), (2, D(2024, 1, 15), 50), (3, D(2024, 2, 1), 500)],
                                   "id bigint, order_date date, total_amount int")
    items = spark.createDataFrame([(1, 7, 1, 20), (1, 8, 1, 80), (2, 7, 1, 50), (3, 7, 1, 500)],
                                  "order_id bigint, product_id bigint, quantity int, line_total int")
    t = Tables.from_frames(spark, {"promotions": promos, "sales_orders": orders, "sales_order_items": items})
    got = {(r.order_id, r.product_id): (r.promotion_id, r.discount) for r in insights.promotion_match(t).collect()}
    assert got == {(1, 7): (2, 5.0), (1, 8): (1, 8.0), (2, 7): (1, 5.0)}


def test_group_quantiles_equal_percentile(spark):
    """A group with a third of all rows, decimals, ties, a null key, null values, a key without values, one row, no rows."""
    rng = random.Random(11)
    rows = [(rng.choice(["hot", None, *"abcdef"]) if i % 3 else "hot", None if rng.random() < 0.05 else f"{rng.choice([1, 2, 2, rng.random() * 99]):.2f}")
            for i in range(5000)] + [("none", None), ("none", None), ("one", "7.25")]
    df = spark.createDataFrame(rows, "who string, v string").select("who", F.col("v").cast("decimal(12,2)").alias("v"))
    wanted = {"low": 0.0, "half": 0.5, "most": 0.9, "top": 1.0}
    got = {r.who: r[1:] for r in group_quantiles(df, "who", "v", wanted).collect()}
    plain = df.groupBy("who").agg(*[F.percentile("v", q).alias(n) for n, q in wanted.items()]).where("low IS NOT NULL").collect()
    assert set(got) == {r.who for r in plain} and "none" not in got and None in got
    for r in plain:
        assert got[r.who] == pytest.approx(tuple(r[1:]))
    assert group_quantiles(df.limit(0), "who", "v", wanted).count() == 0


def test_promotion_match_against_brute_force(spark):
    """Open ends, ties, lists, null and equal values, minimum amounts met exactly, negative and zero lines."""
    rng = random.Random(7)
    day = lambda: D(2023, 11, 20) + dt.timedelta(days=rng.randrange(200))
    promos = []
    for i in range(1, 301):
        start = day()
        end = rng.choice([None, start, start + dt.timedelta(days=rng.randrange(-2, 90))])
        promos.append((i, rng.choice(["percentage", "amount", None]), rng.choice([None, 0.0, 5.0, 7.5, 10.0, 33.33, -3.0]), start, end,
                       rng.choice([None, 0, 50, 100, 100, 250]), rng.choice(["[]", None, "[1]", "[2,3,3]", "[null,4]", "broken"]), rng.choice([1, 1, 1, None, 0])))
    orders = [(o, day(), rng.choice([0, 50, 99, 100, 250, 251])) for o in range(120)]
    items = [(o, rng.randrange(1, 7), 1, rng.choice([0, 1, 20, 75, 400, -30])) for o in range(120) for _ in range(3)]
    t = Tables.from_frames(spark, {
        "promotions": spark.createDataFrame(promos, "id bigint, discount_type string, discount_value double, start_date date, end_date date, "
                                                    "min_amount int, applicable_products string, is_active int"),
        "sales_orders": spark.createDataFrame(orders, "id bigint, order_date date, total_amount int"),
        "sales_order_items": spark.createDataFrame(items, "order_id bigint, product_id bigint, quantity int, line_total int")})
    last, heads, want = max(o[1] for o in orders), {o[0]: o for o in orders}, []
    for o, product, _, total in items:
        _, d, amount = heads[o]
        found = []
        for i, kind, value, start, end, least, listed, active in promos:
            products = {"[1]": [1], "[2,3,3]": [2, 3], "[null,4]": [4]}.get(listed)
            if active != 0 and start <= d <= (end or last) and amount >= (least or 0) and (products is None or product in products):
                gain = None if value is None else round(total * value / 100, 6) if kind == "percentage" else value
                found.append((gain is not None, gain or 0, -i))
        if found:
            known, gain, i = max(found)
            want.append((o, product, total, -i, gain if known else None))
    got = [(r.order_id, r.product_id, r.line_total, r.promotion_id, r.discount) for r in insights.promotion_match(t).collect()]
    key = lambda r: (*r[:4], r[4] is not None, r[4] or 0)
    assert len(want) > 200 and sorted(got, key=key) == sorted(want, key=key)


def test_promotion_match_does_not_pair_lines_and_promotions(spark):
    """20,000 open-ended promotions and 5,000 lines of one day: 100 million pairs, which would not end in the time."""
    promos = spark.range(20_000).select(
        F.col("id"), F.lit("percentage").alias("discount_type"), (F.col("id") % 90).cast("double").alias("discount_value"),
        F.lit(D(2024, 1, 1)).alias("start_date"), F.lit(None).cast("date").alias("end_date"), (F.col("id") % 1000).cast("int").alias("min_amount"),
        F.lit("[]").alias("applicable_products"), F.lit(1).alias("is_active"))
    orders = spark.range(5_000).select("id", F.lit(D(2024, 3, 1)).alias("order_date"), (F.col("id") % 1000).cast("int").alias("total_amount"))
    items = spark.range(5_000).select(F.col("id").alias("order_id"), F.lit(1).cast("long").alias("product_id"), F.lit(1).alias("quantity"), F.lit(100).alias("line_total"))
    t = Tables.from_frames(spark, {"promotions": promos, "sales_orders": orders, "sales_order_items": items})
    got = {r.order_id: (r.promotion_id, r.discount) for r in insights.promotion_match(t).collect()}
    assert len(got) == 5_000
    for o, answer in got.items():
        best = max((i % 90, -i) for i in range(20_000) if i % 1000 <= o % 1000) if o < 200 else None
        assert best is None or answer == (-best[1], float(best[0]))


def test_churn_mean_gap_equals_mean_of_consecutive_gaps(spark):
    rows = [(i, None, c, D(2024, 1, 1) + dt.timedelta(days=d)) for i, (c, d) in
            enumerate([(1, 0), (1, 3), (1, 10), (2, 5), (2, 5), (3, 1)])]
    so = spark.createDataFrame(rows, "id bigint, order_no string, customer_id bigint, order_date date") \
        .withColumn("total_amount", F.lit(10).cast("decimal(18,2)"))
    got = {r.id: r.mean_gap_days for r in insights.churn_risk(Tables.from_frames(spark, {"sales_orders": so}),
                                                              as_of="2024-02-01").collect()}
    assert got == {1: 5.0, 2: 0.0}


def _write_parquet(spark, df, path):
    df.write.mode("append").parquet(path)


def test_hourly_error_stream_matches_batch_on_closed_windows(spark, tmpdir_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    errors = events.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"),
                           F.when(F.col("value") >= 100, "high").otherwise("medium").alias("severity"), "ts")
    src = os.path.join(tmpdir_path, "errors")
    _write_parquet(spark, errors, src)
    out = os.path.join(tmpdir_path, "out")
    feeds.start_hourly_errors(spark, src, errors.schema, out,
                              checkpoint=os.path.join(tmpdir_path, "ck")).awaitTermination(300)
    got = spark.read.parquet(out)
    batch = (errors.withColumn("ts", F.col("ts").cast("timestamp"))
             .groupBy(F.window("ts", "1 hour").alias("w"), "type", "severity").count())
    max_ts = errors.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    closed = batch.where(F.col("w.end") <= F.lit(max_ts) - F.expr("INTERVAL 1 HOUR"))
    exp = sorted((r.w.start, r.type, r.severity, r["count"]) for r in closed.collect())
    g = sorted((r.window_start, r.type, r.severity, r.errors) for r in got.collect())
    assert exp and set(exp) <= set(g) and len(g) <= len(exp) + 10


def test_hourly_performance_stream_complete_mode_matches_batch(spark, tmpdir_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    metrics = events.select(F.when(F.col("event_type") == "view", "page_load").otherwise("api_call").alias("type"),
                            (F.col("value") * 20).cast("decimal(18,2)").alias("duration"),
                            F.when(F.col("event_id") % 10 == 0, 500).otherwise(200).alias("status"), "ts")
    src = os.path.join(tmpdir_path, "metrics")
    _write_parquet(spark, metrics, src)
    stream = spark.readStream.schema(metrics.schema).parquet(src)
    collected = []
    q = (feeds.hourly_performance(stream).writeStream.outputMode("complete")
         .foreachBatch(lambda df, _id: collected.append(df.collect()))
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.window_start: (r.page_load_ms, r.api_slow, r.api_failed) for r in collected[-1]}
    m = metrics.withColumn("ts", F.col("ts").cast("timestamp"))
    exp = m.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.sum(F.when(F.col("type") == "page_load", F.col("duration"))).cast("double").alias("p"),
        F.count_if((F.col("type") == "api_call") & (F.col("duration") > 2000)).alias("s"),
        F.count_if((F.col("type") == "api_call") & (F.col("status") >= 400)).alias("f"))
    assert {r.w.start: (r.p, r.s, r.f) for r in exp.collect()} == got


def test_latest_tracking_stream_two_batches(spark, tmpdir_path):
    schema = "id bigint, shipping_order_id bigint, timestamp timestamp, status string"
    src, snap = os.path.join(tmpdir_path, "scans"), os.path.join(tmpdir_path, "snap")
    ck = os.path.join(tmpdir_path, "ck")
    first = spark.createDataFrame([(1, 10, TS(2024, 1, 1), "picked"), (2, 11, TS(2024, 1, 1), "picked"),
                                   (3, 10, TS(2024, 1, 2), "shipped")], schema)
    _write_parquet(spark, first, src)
    feeds.start_latest_tracking(spark, src, first.schema, snap, checkpoint=ck).awaitTermination(300)
    second = spark.createDataFrame([(4, 11, TS(2024, 1, 3), "delivered"), (5, 10, TS(2023, 12, 1), "late scan")], schema)
    _write_parquet(spark, second, src)
    feeds.start_latest_tracking(spark, src, first.schema, snap, checkpoint=ck).awaitTermination(300)
    got = {r.shipping_order_id: r.last_status for r in feeds.read_latest_tracking(spark, snap).collect()}
    assert got == {10: "shipped", 11: "delivered"}


@pytest.mark.parametrize("fn", [insights.exception_cost, insights.finance_summary, insights.member_loyalty])
def test_cube_and_rollup_reports_run_on_empty_tables(spark, fn):
    names = ["exception_records", "financial_transactions", "sales_orders", "customers"]
    t = Tables.from_frames(spark, {n: spark.createDataFrame([], SCHEMAS[n]) for n in names})
    rows = fn(t).collect()
    assert len(rows) <= 1


def test_global_running_matches_single_window_with_heavy_ties(spark):
    from ledgerloom.operators import global_running
    rnd = random.Random(3)
    rows = [(i, 0 if i % 3 else rnd.randint(1, 50)) for i in range(1, 5001)]  # two thirds tie at 0
    df = spark.createDataFrame(rows, "id bigint, v bigint")
    got = global_running(df, [F.col("v").desc(), F.col("id").asc()], "v", partitions=7).toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "v"]).sort_values(["v", "id"], ascending=[False, True])
    pdf["rs"], pdf["rc"] = pdf["v"].cumsum(), range(1, len(pdf) + 1)
    m = got.merge(pdf, on="id")
    assert len(m) == 5000 and (m["running_sum"] == m["rs"]).all() and (m["running_count"] == m["rc"]).all()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
def test_exact_quantile_matches_linear_interpolation(spark, q):
    import numpy as np
    rnd = random.Random(11)
    vals = [float(rnd.randint(0, 40)) for _ in range(997)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id bigint, v double")
    got = spark.range(1).select(insights.exact_quantile(df, "v", q, tie="id").alias("p")).first().p
    assert got == pytest.approx(float(np.quantile(vals, q)), rel=1e-12)


def test_stock_ledger_stock_before_check(spark):
    rows = [(1, 5, "in", 3, 0, 3, TS(2024, 1, 1, 8)),
            (2, 5, "out", -1, 3, 2, TS(2024, 1, 1, 9)),
            (3, 5, "out", -1, 5, 4, TS(2024, 1, 2, 9)),    # stock_before does not continue the chain
            (4, 5, "in", 2, 4, 7, TS(2024, 1, 3, 9))]      # after != before + change
    tx = spark.createDataFrame(rows, SCHEMAS["inventory_transactions"])
    t = Tables.from_frames(spark, {"inventory_transactions": tx})
    got = {r.id: (r.running_balance, r.is_break) for r in insights.stock_ledger(t, check_before=True).collect()}
    assert got == {1: (3, False), 2: (2, False), 3: (1, True), 4: (3, True)}


def test_freight_quote_breakpoint_path_matches_array_path(spark):
    rnd = random.Random(5)
    carriers = [(f"C{i:02d}", "n", 1.0, rnd.randint(0, 12), rnd.randint(5, 60), 1 if i % 7 else 0) for i in range(30)]
    carriers.append(("Z00", "n", 1.0, 6, 20, 1))    # same offer as another carrier: tie by code
    carriers.append(("A00", "n", 1.0, 6, 20, 1))
    car = spark.createDataFrame(carriers, "code string, name string, rating double, price_per_kg int, "
                                          "min_charge int, is_active int")
    weights = [0.0, 0.5, 1.0, 2.5, 3.0, 3.333, 5.0, 7.5, 10.0, 12.0, 40.0] + [float(rnd.randint(0, 30)) for _ in range(40)]
    ship = spark.createDataFrame([(i, f"S{i}", w) for i, w in enumerate(weights)] + [(999, "S999", None)],
                                 "id bigint, shipping_no string, weight double")
    t = Tables.from_frames(spark, {"carriers": car, "shipping_orders": ship})
    arr = {r.id: (r.carrier_code, r.quote) for r in insights.freight_quote(t).collect()}
    brk = {r.id: (r.carrier_code, r.quote) for r in insights.freight_quote(t, max_carriers=3).collect()}
    assert arr == brk
    for i, w in enumerate(weights):
        from decimal import Decimal
        best = min((max(Decimal(str(w)) * p, Decimal(m)), code) for code, _, _, p, m, act in carriers if act == 1)
        assert arr[i] == (best[1], float(best[0]))
