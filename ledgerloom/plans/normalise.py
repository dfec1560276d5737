"""Flat model -> normalised model, and seed rows.

Keys are derived from natural keys (D14): a customer or product id is a
hash of its name, an order id is the flat row's id (or a hash of the row
when the flat table carries none).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import MONEY, as_ts_col, markup_price
from ..operators.dims import name_key

# Seed rows of the reference (settings, accounts, carriers from the schema; categories
# and suppliers from the migration), and the migration's defaults.
SEED_SETTINGS = [
    ("company_name", "", "公司名称"),  # value left blank: set by the deployment
    ("default_tax_rate", "0.13", "默认税率"),
    ("low_stock_threshold", "10", "低库存预警阈值"),
    ("currency", "CNY", "默认货币"),
    ("date_format", "YYYY-MM-DD", "日期格式"),
    ("backup_frequency", "daily", "备份频率"),
    ("auto_order_no", "1", "是否自动生成订单号"),
]
SEED_ACCOUNTS = [
    ("CASH001", "现金账户", "cash", 0),
    ("BANK001", "银行基本户", "bank", 0),
    ("CARD001", "微信支付", "card", 0),
    ("CARD002", "支付宝", "card", 0),
]
SEED_CARRIERS = [  # name, code, contact_phone, service_area, price_per_kg, delivery_time_avg, is_active
    ("顺丰速运", "SF", "95338", '["全国"]', 12.0, 1, 1),
    ("圆通速递", "YTO", "95554", '["全国"]', 8.0, 2, 1),
    ("申通快递", "STO", "95543", '["全国"]', 7.5, 2, 1),
    ("韵达快递", "YD", "95546", '["全国"]', 8.5, 2, 1),
    ("中通快递", "ZTO", "95311", '["全国"]', 8.0, 2, 1),
    ("德邦物流", "DB", "95353", '["华北","华东","华南"]', 6.0, 3, 1),
    ("京东物流", "JD", "950616", '["一线城市"]', 10.0, 1, 1),
    ("百世快递", "BEST", "95320", '["全国"]', 7.0, 2, 1),
]
SEED_CATEGORIES = ["电子产品", "服装", "食品", "日用品", "其他"]
SEED_SUPPLIERS = [  # name, contact_person, phone
    ("苹果公司", "库克", "400-123-4567"),
    ("华为公司", "任正非", "400-234-5678"),
    ("小米公司", "雷军", "400-345-6789"),
    ("联想公司", "杨元庆", "400-456-7890"),
    ("其他供应商", "联系人", ""),
]
# column defaults of the schema for seeded rows (suppliers: credit_rating 5, is_active 1)
SEED_DEFAULTS = {"suppliers": {"credit_rating": 5, "is_active": 1}, "categories": {},
                 "accounts": {"currency": "CNY", "is_active": 1}, "carriers": {}, "system_settings": {}}
DEFAULT_CATEGORY = "其他"
MIGRATED_STOCK = 100
MIGRATED_MIN_STOCK = 10
DEFAULT_MIN_STOCK = 10
DEFAULT_MAX_STOCK = 1000
MIGRATED_CUSTOMER_TYPE = "retail"
# schema defaults of a sales order created by the migration
ORDER_DEFAULTS = {"payment_method": "cash", "payment_status": "paid", "order_status": "completed"}

SLICE = 10_000  # equal rows that one task tells out at once


def seed_frame(spark: SparkSession, kind: str) -> DataFrame:
    """The seed rows of one table as a DataFrame (small fixed input)."""
    if kind == "categories":
        return spark.createDataFrame([(n,) for n in SEED_CATEGORIES], "name string")
    if kind == "suppliers":
        return spark.createDataFrame(SEED_SUPPLIERS, "name string, contact_person string, phone string")
    if kind == "accounts":
        return spark.createDataFrame(SEED_ACCOUNTS, "account_code string, account_name string, account_type string, "
                                                    "balance int").withColumn("balance", F.col("balance").cast(MONEY))
    if kind == "carriers":
        return spark.createDataFrame(SEED_CARRIERS, "name string, code string, contact_phone string, "
                                                    "service_area string, price_per_kg double, "
                                                    "delivery_time_avg int, is_active int")
    if kind == "system_settings":
        return spark.createDataFrame(SEED_SETTINGS, "key string, value string, description string")
    raise ValueError(f"no seed rows for {kind!r}")


SEED_KEYS = {"categories": "name", "suppliers": "name", "accounts": "account_code", "carriers": "code",
             "system_settings": "key"}


def seed_if_absent(current: DataFrame, seeds: DataFrame, key: str, id_col: str | None = "id",
                   defaults: dict | None = None) -> DataFrame:
    """Add seed rows whose natural key is absent (INSERT OR IGNORE); existing rows win.

    Seeds for tables keyed by name (D3: names are not unique in the schema)
    are matched on the name, which is the evident intent. Columns the seed
    does not give take ``defaults`` (the schema's column defaults), else null.
    """
    defaults = defaults or {}
    fresh = seeds.join(current.select(key).distinct(), on=key, how="left_anti")
    sch = current.schema
    cols = []
    for f in sch.fields:
        if f.name in fresh.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == id_col:
            cols.append(name_key(F.col(key)).cast(f.dataType).alias(f.name))
        elif f.name in defaults:
            cols.append(F.lit(defaults[f.name]).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return current.unionByName(fresh.select(*cols))


def _numbered(rows: DataFrame, columns: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: the number (int, from 1) of each row among those equal to it.

    Equal rows are counted (combined map-side) and told out again from their count; a group of more than ``SLICE`` rows in
    slices that are dealt to tasks apart, so no task holds a hot group.
    """
    counted = rows.groupBy(*columns).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    few = counted.where(F.col("_n") <= SLICE).select(*columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias(out))
    slices = counted.where(F.col("_n") > SLICE).withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(SLICE))))
    many = slices.repartition(*columns, "_s").select(
        *columns, F.explode(F.sequence(F.col("_s"), F.least(F.col("_n"), F.col("_s") + F.lit(SLICE - 1)))).alias(out))
    return few.unionByName(many)


@dataclass
class NormalisedSales:
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    lines: DataFrame


def normalise_sales(sales: DataFrame, customers: DataFrame, products: DataFrame) -> NormalisedSales:
    """Each flat sale becomes an order with one line; customers and products are created by
    name when absent (first seen sale sets a new product's price)."""
    cust_new = (sales.where(F.col("customer_name").isNotNull())
                .groupBy(F.col("customer_name").alias("name"))
                .agg(F.min("created_at").alias("created_at"))
                .join(customers.select("name"), on="name", how="left_anti"))
    cust_rows = cust_new.select(
        *[(name_key(F.col("name")) if f.name == "id" else
           F.col("name") if f.name == "name" else
           F.lit(MIGRATED_CUSTOMER_TYPE) if f.name == "customer_type" else
           F.col("created_at") if f.name == "created_at" else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in customers.schema.fields])
    new_customers = customers.unionByName(cust_rows)
    first_price = (sales.groupBy(F.col("product_name").alias("name"))
                   .agg(F.min_by(F.struct("unit_price", "created_at"),
                                 F.struct("created_at", "date", "unit_price")).alias("_first")))
    prod_new = first_price.join(products.select("name"), on="name", how="left_anti")
    prod_vals = {"id": name_key(F.col("name")), "name": F.col("name"),
                 "selling_price": F.col("_first.unit_price"), "current_stock": F.lit(MIGRATED_STOCK),
                 "min_stock": F.lit(MIGRATED_MIN_STOCK), "created_at": F.col("_first.created_at")}
    prod_rows = prod_new.select(*[(prod_vals.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
                                  for f in products.schema.fields])
    new_products = products.unionByName(prod_rows)
    # a name resolves to its existing (smallest) id, else to the key its new row was given above;
    # looking up only the existing dimension keeps the flat table out of the lookup side
    cust_ids = customers.groupBy(F.col("name").alias("customer_name")).agg(F.min("id").alias("_cid"))
    prod_ids = products.groupBy(F.col("name").alias("product_name")).agg(F.min("id").alias("_pid"))
    # without an id, equal sales are told apart by their number among themselves: each is its own order
    content = [F.col(c) for c in sales.columns if c != "id"]
    unnamed = _numbered(sales.where(F.col("id").isNull()), sales.columns, "_same")
    keyed = (sales.where(F.col("id").isNotNull()).withColumn("order_id", F.col("id"))
             .unionByName(unnamed.withColumn("order_id", F.xxhash64(*content, F.col("_same"))).drop("_same")))
    customer_id = F.when(F.col("customer_name").isNotNull(), F.coalesce(
        F.col("_cid"), name_key(F.col("customer_name")).cast(customers.schema["id"].dataType)))
    total = F.col("total_amount").cast(MONEY)
    orders = (keyed.join(cust_ids, on="customer_name", how="left")
              .select(F.col("order_id").alias("id"), F.concat(F.lit("SO"), F.col("order_id").cast("string")).alias("order_no"),
                      customer_id.alias("customer_id"), F.col("date").alias("order_date"), total.alias("subtotal"),
                      total.alias("total_amount"), total.alias("paid_amount"), "created_at",
                      *[F.lit(v).alias(k) for k, v in ORDER_DEFAULTS.items()]))
    product_id = F.coalesce(F.col("_pid"), name_key(F.col("product_name")).cast(products.schema["id"].dataType))
    lines = (keyed.join(prod_ids, on="product_name", how="left")
             .select("order_id", product_id.alias("product_id"), "quantity", "unit_price",
                     F.col("total_amount").cast(MONEY).alias("line_total")))
    return NormalisedSales(new_customers, new_products, orders, lines)


def normalise_inventory(inventory: DataFrame, categories: DataFrame, *, run_ts) -> DataFrame:
    """Flat stock rows -> product rows: category by name (missing -> default, D15), min/max
    defaults for missing or 0 values (JavaScript ``||``), selling price = cost x 1.3 (F14)."""
    cat_ids = categories.groupBy(F.col("name").alias("_cat")).agg(F.min("id").alias("category_id"))
    src = inventory.withColumn("_cat", F.coalesce(F.when(F.col("category") != "", F.col("category")),
                                                  F.lit(DEFAULT_CATEGORY)))
    j = src.join(cat_ids, on="_cat", how="left")
    cost = F.coalesce(F.when(F.col("unit_cost") != 0, F.col("unit_cost")), F.lit(0)).cast(MONEY)
    return j.select(
        name_key(F.col("product_name")).alias("id"),
        F.col("product_name").alias("name"),
        "category_id",
        "current_stock",
        F.coalesce(F.when(F.col("min_stock") != 0, F.col("min_stock")), F.lit(DEFAULT_MIN_STOCK)).alias("min_stock"),
        F.coalesce(F.when(F.col("max_stock") != 0, F.col("max_stock")), F.lit(DEFAULT_MAX_STOCK)).alias("max_stock"),
        cost.alias("cost_price"),
        markup_price(cost).alias("selling_price"),
        F.coalesce(F.col("last_updated"), as_ts_col(run_ts)).alias("updated_at"),
    )
