"""Bulk imports with row-level rejects.

The reference loops over rows, validating and writing one at a time. Here a
whole file is one DataFrame of text fields plus ``line_no``: each row gets
an ``error`` (first failing rule, or null), good rows are resolved against
the dimensions by joins, the last good row per name wins (D3), and the
target table comes back as a new snapshot together with the rejects.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import MONEY, as_ts_col, falsy_default, numeric_prefix_float, numeric_prefix_int
from ..operators.dims import get_or_create, name_key
from ..operators.latest import latest_per_key

# The import contract (report header -> field), defaults and messages.
PRODUCT_HEADERS = {
    "商品名称": "name", "条形码": "barcode", "分类": "category", "品牌": "brand", "单位": "unit",
    "成本价": "cost_price", "销售价": "selling_price", "批发价": "wholesale_price", "当前库存": "current_stock",
    "最低库存": "min_stock", "最高库存": "max_stock", "供应商": "supplier",
}
CUSTOMER_HEADERS = {
    "客户名称": "name", "电话": "phone", "邮箱": "email", "地址": "address", "客户类型": "customer_type",
    "会员等级": "member_level",
}
STOCK_HEADERS = {"商品名称": "name", "库存数量": "stock"}
HEADERS = {"products": PRODUCT_HEADERS, "customers": CUSTOMER_HEADERS, "inventory": STOCK_HEADERS}
TEMPLATES = {
    "products": {"商品名称": "示例商品", "条形码": "1234567890", "分类": "电子产品", "品牌": "示例品牌", "单位": "件",
                 "成本价": 100, "销售价": 150, "批发价": 120, "当前库存": 50, "最低库存": 10, "最高库存": 200,
                 "供应商": "示例供应商"},
    "customers": {"客户名称": "示例客户", "电话": "13800138000", "邮箱": "example@email.com", "地址": "示例地址",
                  "客户类型": "retail", "会员等级": "bronze"},
    "inventory": {"商品名称": "示例商品", "库存数量": 100},
}
DEFAULT_UNIT = "件"
DEFAULT_CUSTOMER_TYPE = "retail"
DEFAULT_MEMBER_LEVEL = "bronze"
MISSING_FIELD = "缺少必填字段: "
PRODUCT_NOT_FOUND = "商品不存在"
LINE_PREFIX = ("第", "行: ")
# our own message for D10 (the reference let NaN through)
BAD_NUMBER = "invalid number: "


@dataclass
class ImportResult:
    table: DataFrame                      # new snapshot of the target table
    accepted: DataFrame                   # good rows, one per name after "later rows win"
    rejects: DataFrame                    # line_no, error, message
    good_rows: DataFrame                  # every row that passed validation (before dedup)
    dims: dict[str, DataFrame] = field(default_factory=dict)

    def summary(self) -> DataFrame:
        """Success and failure counts (errors stay rows in ``rejects``, ordered by line)."""
        bad = self.rejects.agg(F.count(F.lit(1))).scalar()
        return self.good_rows.agg(F.count(F.lit(1)).alias("success")).select("success", bad.alias("failed"))


def rename_headers(raw: DataFrame, kind: str) -> DataFrame:
    """Map the report headers of an import file to field names (unknown columns dropped)."""
    mapping = HEADERS[kind]
    cols = [F.col(f"`{h}`").alias(f) for h, f in mapping.items() if h in raw.columns]
    keep = [c for c in ("line_no",) if c in raw.columns]
    return raw.select(*keep, *cols)


def template(spark: SparkSession, kind: str) -> DataFrame:
    """The one-row example file of an import type, all text."""
    if kind not in TEMPLATES:
        raise ValueError(f"unsupported template type: {kind!r}")
    row = {k: str(v) for k, v in TEMPLATES[kind].items()}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"`{k}` string" for k in row))


def _text(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def _missing(c: Column) -> Column:
    """Only null or empty text is missing (0 and '0' are values)."""
    return c.isNull() | (c == "")


def _first_error(checks: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        out = F.when(cond, F.lit(msg)).otherwise(out)
    return out


def _rejects(checked: DataFrame) -> DataFrame:
    bad = checked.where(F.col("error").isNotNull())
    return bad.select("line_no", "error", F.concat(F.lit(LINE_PREFIX[0]), F.col("line_no").cast("string"),
                                                  F.lit(LINE_PREFIX[1]), F.col("error")).alias("message"))


def _header_of(kind: str, fld: str) -> str:
    return {v: k for k, v in HEADERS[kind].items()}[fld]


def import_products(products: DataFrame, categories: DataFrame, suppliers: DataFrame, rows: DataFrame
                    ) -> ImportResult:
    """W17 products: name required; numbers parsed by prefix with defaults; categories and suppliers
    looked up or created by name; the last good row per name replaces the product row."""
    ints = {"current_stock": "0", "min_stock": "10", "max_stock": "1000"}
    floats = {"cost_price": "0", "selling_price": "0", "wholesale_price": "0"}
    parsed = rows.select(
        "line_no", _text(rows, "name").alias("name"),
        falsy_default(_text(rows, "barcode"), "").alias("barcode"),
        _text(rows, "category").alias("category"),
        falsy_default(_text(rows, "brand"), "").alias("brand"),
        falsy_default(_text(rows, "unit"), DEFAULT_UNIT).alias("unit"),
        *[numeric_prefix_int(falsy_default(_text(rows, f), d)).alias(f) for f, d in ints.items()],
        *[numeric_prefix_float(falsy_default(_text(rows, f), d)).alias(f) for f, d in floats.items()],
        _text(rows, "supplier").alias("supplier"))
    checks = [(_missing(F.col("name")), MISSING_FIELD + _header_of("products", "name"))]
    checks += [(F.col(f).isNull(), BAD_NUMBER + _header_of("products", f)) for f in list(ints) + list(floats)]
    checked = parsed.withColumn("error", _first_error(checks))
    good = checked.where(F.col("error").isNull()).drop("error")
    accepted = latest_per_key(good, ["name"], ["line_no"])
    new_cats, cat_ids = get_or_create(categories, accepted.select(F.col("category").alias("name")))
    new_sups, sup_ids = get_or_create(suppliers, accepted.select(F.col("supplier").alias("name")))
    resolved = (accepted
                .join(cat_ids.select(F.col("name").alias("category"), F.col("id").alias("category_id")),
                      on="category", how="left")
                .join(sup_ids.select(F.col("name").alias("supplier"), F.col("id").alias("supplier_id")),
                      on="supplier", how="left"))
    old_ids = products.groupBy("name").agg(F.min("id").alias("_old_id"))
    with_id = resolved.join(old_ids, on="name", how="left")
    sch = products.schema
    values = {
        "id": F.coalesce(F.col("_old_id"), name_key(F.col("name")).cast(sch["id"].dataType)),
        "name": F.col("name"), "barcode": F.col("barcode"), "brand": F.col("brand"), "unit": F.col("unit"),
        "category_id": F.col("category_id"), "supplier_id": F.col("supplier_id"),
        "cost_price": F.col("cost_price").cast(MONEY), "selling_price": F.col("selling_price").cast(MONEY),
        "wholesale_price": F.col("wholesale_price").cast(MONEY),
        "current_stock": F.col("current_stock"), "min_stock": F.col("min_stock"), "max_stock": F.col("max_stock"),
        "reserved_stock": F.lit(0), "is_active": F.lit(1),
    }
    new_rows = with_id.select(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
                                for f in sch.fields])
    kept = products.join(accepted.select("name"), on="name", how="left_anti").select(*products.columns)
    return ImportResult(kept.unionByName(new_rows), resolved, _rejects(checked), good,
                        {"categories": new_cats, "suppliers": new_sups})


def import_customers(customers: DataFrame, rows: DataFrame) -> ImportResult:
    """W17 customers: name required; text defaults; the last good row per name replaces the customer."""
    parsed = rows.select(
        "line_no", _text(rows, "name").alias("name"),
        falsy_default(_text(rows, "phone"), "").alias("phone"),
        falsy_default(_text(rows, "email"), "").alias("email"),
        falsy_default(_text(rows, "address"), "").alias("address"),
        falsy_default(_text(rows, "customer_type"), DEFAULT_CUSTOMER_TYPE).alias("customer_type"),
        falsy_default(_text(rows, "member_level"), DEFAULT_MEMBER_LEVEL).alias("member_level"))
    checked = parsed.withColumn("error", _first_error(
        [(_missing(F.col("name")), MISSING_FIELD + _header_of("customers", "name"))]))
    good = checked.where(F.col("error").isNull()).drop("error")
    accepted = latest_per_key(good, ["name"], ["line_no"])
    old_ids = customers.groupBy("name").agg(F.min("id").alias("_old_id"))
    with_id = accepted.join(old_ids, on="name", how="left")
    sch = customers.schema
    values = {"id": F.coalesce(F.col("_old_id"), name_key(F.col("name")).cast(sch["id"].dataType)),
              "is_active": F.lit(1)}
    for c in ("name", "phone", "email", "address", "customer_type", "member_level"):
        values[c] = F.col(c)
    new_rows = with_id.select(*[(values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
                                for f in sch.fields])
    kept = customers.join(accepted.select("name"), on="name", how="left_anti").select(*customers.columns)
    return ImportResult(kept.unionByName(new_rows), accepted, _rejects(checked), good)


def import_inventory(products: DataFrame, rows: DataFrame, *, run_ts) -> ImportResult:
    """W17 stock: name and quantity required; quantity parsed by prefix; unknown names rejected;
    the last good row per name sets the stock of *every* product with that name (D4)."""
    parsed = rows.select("line_no", _text(rows, "name").alias("name"), _text(rows, "stock").alias("stock_text"),
                         numeric_prefix_int(_text(rows, "stock")).alias("stock"))
    known = products.select("name").distinct().withColumn("_known", F.lit(True))
    joined = parsed.join(known, on="name", how="left")
    checks = [(_missing(F.col("name")), MISSING_FIELD + _header_of("inventory", "name")),
              (_missing(F.col("stock_text")), MISSING_FIELD + _header_of("inventory", "stock")),
              (F.col("stock").isNull(), BAD_NUMBER + _header_of("inventory", "stock")),
              (F.col("_known").isNull(), PRODUCT_NOT_FOUND)]
    checked = joined.withColumn("error", _first_error(checks))
    good = checked.where(F.col("error").isNull()).select("line_no", "name", "stock")
    accepted = latest_per_key(good, ["name"], ["line_no"])
    upd = products.join(accepted.select("name", F.col("stock").alias("_new")), on="name", how="left")
    sch = products.schema
    new = upd.select(*[
        F.coalesce(F.col("_new").cast(sch[c].dataType), F.col(c)).alias(c) if c == "current_stock" else
        F.when(F.col("_new").isNotNull(), as_ts_col(run_ts).cast(sch[c].dataType)).otherwise(F.col(c)).alias(c)
        if c == "updated_at" else F.col(c) for c in products.columns])
    return ImportResult(new, accepted, _rejects(checked), good)
