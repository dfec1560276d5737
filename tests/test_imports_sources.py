"""Imports (W17, D3, D4, D9, D10), normalisation and seeds (W18-W20), sources and sinks."""

import datetime as dt
import glob
from decimal import Decimal
import os

from pyspark.sql import functions as F

from ledgerloom.operators import get_or_create
from ledgerloom.plans import exports, imports, normalise
from ledgerloom.schemas import SCHEMAS
from ledgerloom.sources import files, snapshot
from ledgerloom.tables import Tables

TS = dt.datetime


def _products(spark, rows):
    cols = [f.name for f in SCHEMAS["products"].fields]
    full = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(full, SCHEMAS["products"])


def test_import_products_validation_defaults_and_dims(spark):
    rows = spark.createDataFrame([
        (1, "Pen", "5", "电子产品", "Acme", None, "2.5"),
        (2, "", "1", "x", None, None, None),          # missing name
        (3, "Ink", "abc", "新分类", None, None, None),   # D10: not a number
        (4, "Pen", "0", "电子产品", None, "盒", "12abc"),  # D3: later row wins; D9: 0 is valid; prefix number
        (5, "Pad", "", "", "Acme", None, None),         # defaults
    ], "line_no bigint, name string, current_stock string, category string, supplier string, unit string, "
       "cost_price string")
    cats = spark.createDataFrame([(1, "电子产品", None, None, None)], SCHEMAS["categories"])
    sups = spark.createDataFrame([], SCHEMAS["suppliers"])
    prods = _products(spark, [{"id": 7, "name": "Pad", "current_stock": 99}])
    res = imports.import_products(prods, cats, sups, rows)
    acc = {r.name: r for r in res.accepted.collect()}
    assert set(acc) == {"Pen", "Pad"}
    assert acc["Pen"].current_stock == 0 and acc["Pen"].unit == "盒" and acc["Pen"].cost_price == 12.0
    assert acc["Pen"].category_id == 1 and acc["Pad"].category_id is None
    assert acc["Pad"].min_stock == 10 and acc["Pad"].max_stock == 1000 and acc["Pad"].unit == "件"
    rej = {r.line_no: r.message for r in res.rejects.collect()}
    assert rej == {2: "第2行: 缺少必填字段: 商品名称", 3: "第3行: invalid number: 当前库存"}
    table = {r.name: r for r in res.table.collect()}
    assert table["Pad"].id == 7 and table["Pad"].current_stock == 0  # replaced, id kept
    assert {r.name for r in res.dims["suppliers"].collect()} == {"Acme"}
    s = res.summary().first()
    assert s.success + s.failed == rows.count() and (s.success, s.failed) == (3, 2)


def test_import_inventory_updates_every_product_with_the_name(spark):
    prods = _products(spark, [{"id": 1, "name": "Pen", "current_stock": 1}, {"id": 2, "name": "Pen", "current_stock": 2},
                              {"id": 3, "name": "Ink", "current_stock": 3}])
    rows = spark.createDataFrame([(1, "Pen", "5"), (2, "Pen", "0"), (3, "Nope", "1"), (4, "Ink", ""), (5, "Ink", "x")],
                                 "line_no bigint, name string, stock string")
    res = imports.import_inventory(prods, rows, run_ts="2024-01-01 00:00:00")
    got = {r.id: r.current_stock for r in res.table.collect()}
    assert got == {1: 0, 2: 0, 3: 3}  # D4 + later rows win
    msgs = {r.line_no: r.error for r in res.rejects.collect()}
    assert msgs == {3: "商品不存在", 4: "缺少必填字段: 库存数量", 5: "invalid number: 库存数量"}


def test_import_customers_defaults(spark):
    cust = spark.createDataFrame([], SCHEMAS["customers"])
    rows = spark.createDataFrame([(1, "Ann", None, ""), (2, None, "x", "gold")],
                                 "line_no bigint, name string, phone string, member_level string")
    res = imports.import_customers(cust, rows)
    r = res.table.first()
    assert (r.name, r.phone, r.customer_type, r.member_level, r.is_active) == ("Ann", "", "retail", "bronze", 1)
    assert res.rejects.count() == 1


def test_get_or_create_is_deterministic_and_unique(spark):
    dim = spark.createDataFrame([(5, "a", None, None, None)], SCHEMAS["categories"])
    names = spark.createDataFrame([("a",), ("b",), ("b",), (" ",), (None,)], "name string")
    new1, look1 = get_or_create(dim, names)
    new2, _ = get_or_create(dim, names)
    assert sorted(r.name for r in new1.collect()) == [" ", "a", "b"]  # names as given; only null and '' are left out
    assert sorted(map(tuple, new1.collect())) == sorted(map(tuple, new2.collect()))
    assert {r.name: r.id for r in look1.collect()}["a"] == 5


def test_template_and_header_rename(spark):
    tpl = imports.template(spark, "products")
    renamed = imports.rename_headers(tpl, "products")
    r = renamed.first()
    assert r.name == "示例商品" and r.current_stock == "50" and len(renamed.columns) == 12


def test_normalise_inventory_markup_and_defaults(spark):
    inv = spark.createDataFrame([(1, "A", None, 5, 0, None, 10, "s", None), (2, "B", "食品", 5, 3, 50, 0, "s", None)],
                                "id bigint, product_name string, category string, current_stock int, min_stock int, "
                                "max_stock int, unit_cost int, supplier string, last_updated timestamp") \
        .withColumn("unit_cost", F.col("unit_cost").cast("decimal(18,2)"))
    cats = normalise.seed_if_absent(spark.createDataFrame([], SCHEMAS["categories"]),
                                    normalise.seed_frame(spark, "categories"), "name")
    out = {r.name: r for r in normalise.normalise_inventory(inv, cats, run_ts="2024-01-01 00:00:00").collect()}
    assert float(out["A"].selling_price) == 13.0 and out["A"].min_stock == 10 and out["A"].max_stock == 1000
    assert out["A"].category_id is not None  # missing category falls to the default, which is seeded first
    assert float(out["B"].selling_price) == 0.0 and out["B"].min_stock == 3


def test_seed_if_absent_keeps_existing(spark):
    cur = spark.createDataFrame([(1, "食品", "mine", None, None)], SCHEMAS["categories"])
    out = normalise.seed_if_absent(cur, normalise.seed_frame(spark, "categories"), "name")
    rows = {r.name: r for r in out.collect()}
    assert len(rows) == 5 and rows["食品"].id == 1 and rows["食品"].description == "mine"
    for kind in ("accounts", "carriers", "system_settings", "suppliers"):
        assert normalise.seed_frame(spark, kind).count() in (4, 5, 7, 8)


def test_normalise_sales_one_line_per_sale(spark):
    s = spark.createDataFrame([(None, dt.date(2024, 1, 1), "P", "c", 2, 1.5, Decimal("3.00"), "Ann", TS(2024, 1, 1)),
                               (None, dt.date(2024, 1, 1), "P", "c", 2, 1.5, Decimal("3.00"), "Ann", TS(2024, 1, 1)),
                               (None, dt.date(2024, 1, 2), "Q", "c", 1, 9.0, Decimal("9.00"), None, TS(2024, 1, 2))],
                              SCHEMAS["sales"])
    n = normalise.normalise_sales(s, spark.createDataFrame([], SCHEMAS["customers"]),
                                  spark.createDataFrame([], SCHEMAS["products"]))
    assert n.lines.count() == 3 and n.customers.count() == 1 and n.products.count() == 2
    assert n.orders.count() == 3 and n.orders.select("id").distinct().count() == 3  # one order per sale, equal ones too
    assert sorted(float(r.total_amount) for r in n.orders.collect()) == [3.0, 3.0, 9.0]
    assert n.lines.join(n.orders, n.lines.order_id == n.orders.id).count() == 3


def test_csv_import_line_numbers_across_blocks(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "big.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("﻿商品名称,库存数量\n")
        for i in range(1, 20001):
            f.write(f"item{i},{i}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = files.read_import_csv(spark, path)
        assert df.rdd.getNumPartitions() > 1
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert "商品名称" in df.columns  # BOM dropped
    assert all(r["line_no"] == int(r["库存数量"]) for r in rows) and len(rows) == 20000


def test_csv_writer_quotes_and_zeros(spark, tmpdir_path):
    df = spark.createDataFrame([("a,b", 'q"q', 0, "line1\nline2")], "x string, y string, z int, w string")
    out = os.path.join(tmpdir_path, "out")
    files.write_report(df, out, "csv")
    parts = [open(p, encoding="utf-8").read() for p in sorted(glob.glob(os.path.join(out, "part-*.csv")))]
    assert all(p.startswith("x,y,z,w\n") for p in parts)
    assert any('"a,b","q""q",0,"line1\nline2"' in p for p in parts)
    assert not any(p.startswith("﻿") for p in parts)


def test_export_dispatch_and_headers(spark, tmpdir_path):
    ft = spark.createDataFrame(
        [(1, "income", "sales", Decimal("5.00"), "cash", "d", dt.date(2024, 1, 1))],
        "id bigint, transaction_type string, category string, amount decimal(18,2), payment_method string, "
        "description string, transaction_date date")
    t = Tables.from_frames(spark, {"financial_transactions": ft})
    df = exports.export_report(t, "financial", {"startDate": "2024-01-01", "endDate": None})
    assert df.count() == 1  # a one-sided range is ignored (P7)
    out = os.path.join(tmpdir_path, "fin")
    files.write_report(df, out, "csv", headers=exports.HEADERS["financial"])
    head = open(glob.glob(os.path.join(out, "part-*.csv"))[0], encoding="utf-8").readline()
    assert head.startswith("交易日期,交易类型")
    try:
        exports.export_report(t, "nope")
        raise AssertionError("unknown export type accepted")
    except ValueError:
        pass


def test_read_telemetry_logs(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "errors.json")
    with open(p, "w") as f:
        f.write('[{"id":"e1","type":"javascript","timestamp":1704067200000,"severity":"high",'
                '"context":{"page":"/x"},"processed":false},'
                '{"id":"e2","type":"network","timestamp":1704070800000,"severity":"critical"}]')
    e = files.read_error_log(spark, p).collect()
    assert [r.severity for r in e] == ["high", "critical"] and e[0].ts == TS(2024, 1, 1)
    m = os.path.join(tmpdir_path, "metrics.json")
    with open(m, "w") as f:
        f.write('[{"type":"api_call","duration":2500,"timestamp":1704067200000,"additionalData":{"status":500}},'
                '{"type":"page_load","duration":800,"timestamp":1704067200000}]')
    rows = files.read_metric_log(spark, m).collect()
    assert rows[0].status == 500 and rows[1].status is None  # optional nested field


def test_backup_and_materialize(spark, tmpdir_path):
    t = Tables.from_frames(spark, {"alerts": spark.createDataFrame([(1, "t", "m", "info", 0, TS(2024, 1, 1))],
                                                                   SCHEMAS["alerts"])})
    counts = snapshot.backup(t, tmpdir_path, "20240101T000000")
    assert counts == {"alerts": 1}
    assert spark.read.parquet(os.path.join(tmpdir_path, "backup_20240101T000000", "alerts")).count() == 1
    m = snapshot.materialize(spark, t["alerts"], "alerts_copy")
    assert m.count() == 1


def test_write_fact_prunes_partitions(spark, tmpdir_path):
    import contextlib
    import io

    from ledgerloom.sources import read_fact, write_fact
    df = spark.createDataFrame([(i, dt.date(2024, 1 + i % 3, 1 + i % 28), i * 10) for i in range(300)],
                               "order_id bigint, order_date date, amount int")

    def plan(q):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            q.explain("formatted")
        return buf.getvalue()

    daily = os.path.join(tmpdir_path, "daily")
    write_fact(df, daily, date_col="order_date", sort_by=["order_id"])
    q = read_fact(spark, daily).where(F.col("order_date") >= F.lit(dt.date(2024, 3, 1)))
    assert "PartitionFilters: [isnotnull(order_date" in plan(q) and q.count() == 100
    assert dict(q.dtypes)["order_date"] == "date"

    monthly = os.path.join(tmpdir_path, "monthly")
    write_fact(df, monthly, date_col="order_date", sort_by=["order_id"], grain="month")
    assert sorted(d for d in os.listdir(monthly) if d.startswith("_part=")) == \
        ["_part=2024-01", "_part=2024-02", "_part=2024-03"]
    m = read_fact(spark, monthly).where(F.col("_part") == "2024-02")
    assert "PartitionFilters: [isnotnull(_part" in plan(m) and m.count() == 100


def test_csv_import_multiline_fields(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "ml.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('客户名称,地址\nAnn,"line1\nline2"\n"Bo ""B""",x\n')
    rows = files.read_import_csv(spark, path, multiline=True).orderBy("line_no").collect()
    assert [(r.line_no, r["客户名称"], r["地址"]) for r in rows] == [(1, "Ann", "line1\nline2"), (2, 'Bo "B"', "x")]


def test_jdbc_helpers_validate_without_a_database(spark):
    import pytest

    from ledgerloom.sources import jdbc_url, read_table
    assert jdbc_url("sqlite", "/data/shop.db") == "jdbc:sqlite:/data/shop.db"
    assert jdbc_url("postgresql", "db:5432/shop") == "jdbc:postgresql://db:5432/shop"
    with pytest.raises(ValueError):
        jdbc_url("oracle", "x")
    with pytest.raises(ValueError):  # a partitioned read needs both bounds and a partition count
        read_table(spark, "jdbc:sqlite:/nonexistent.db", "sales", partition_column="id", lower=0)
