"""The five export reports and the export dispatcher.

Columns carry English names; ``HEADERS`` maps them to the reference's
report headers for a sink that wants them (``sources.files.write_report``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MONEY, as_date_col, stock_status
from ..tables import Tables

# Labels and report headers of the reference's exports.
ACTIVE_LABEL = "启用"
INACTIVE_LABEL = "停用"
STOCK_LOW_LABEL = "库存不足"
STOCK_HIGH_LABEL = "库存过多"
STOCK_OK_LABEL = "正常"
HEADERS = {
    "products": {
        "product_code": "商品编码", "barcode": "条形码", "name": "商品名称", "category": "分类", "brand": "品牌",
        "unit": "单位", "cost_price": "成本价", "selling_price": "销售价", "wholesale_price": "批发价",
        "current_stock": "当前库存", "min_stock": "最低库存", "max_stock": "最高库存", "supplier": "供应商",
        "status": "状态", "created_at": "创建时间",
    },
    "customers": {
        "customer_code": "客户编号", "name": "客户名称", "phone": "电话", "email": "邮箱", "address": "地址",
        "customer_type": "客户类型", "member_level": "会员等级", "total_purchases": "累计消费",
        "current_balance": "当前余额", "points": "积分", "status": "状态", "created_at": "创建时间",
    },
    "sales": {
        "order_no": "订单号", "order_date": "销售日期", "customer_name": "客户名称", "product_name": "商品名称",
        "quantity": "数量", "unit_price": "单价", "line_total": "小计", "payment_method": "支付方式",
        "order_status": "订单状态",
    },
    "inventory": {
        "name": "商品名称", "category": "分类", "current_stock": "当前库存", "min_stock": "最低库存",
        "cost_price": "成本价", "stock_value": "库存价值", "stock_status": "库存状态", "updated_at": "最后更新",
    },
    "financial": {
        "transaction_date": "交易日期", "transaction_type": "交易类型", "category": "分类", "amount": "金额",
        "payment_method": "支付方式", "description": "描述", "created_at": "创建时间",
    },
}


def _active_label(c):
    return F.when(c == 1, ACTIVE_LABEL).otherwise(INACTIVE_LABEL)


def _date_range(df: DataFrame, col: str, start, end) -> DataFrame:
    """Inclusive BETWEEN, applied only when both ends are given."""
    if start is None or end is None:
        return df
    return df.where(F.col(col).between(as_date_col(start), as_date_col(end)))


def export_products(t: Tables, filters: dict | None = None) -> DataFrame:
    """Products with category and supplier names, by id (filters ignored, as in the reference)."""
    p = t["products"].alias("p")
    c = t["categories"].select(F.col("id").alias("_cid"), F.col("name").alias("category"))
    s = t["suppliers"].select(F.col("id").alias("_sid"), F.col("name").alias("supplier"))
    j = (p.join(c, F.col("p.category_id") == F.col("_cid"), "left")
         .join(s, F.col("p.supplier_id") == F.col("_sid"), "left"))
    return j.select("p.product_code", "p.barcode", "p.name", "category", "p.brand", "p.unit", "p.cost_price",
                    "p.selling_price", "p.wholesale_price", "p.current_stock", "p.min_stock", "p.max_stock",
                    "supplier", _active_label(F.col("p.is_active")).alias("status"), "p.created_at",
                    F.col("p.id").alias("_id")).orderBy("_id").drop("_id")


def export_customers(t: Tables, filters: dict | None = None) -> DataFrame:
    """Customers, by id (filters ignored)."""
    c = t["customers"]
    return c.select("customer_code", "name", "phone", "email", "address", "customer_type", "member_level",
                    "total_purchases", "current_balance", "points", _active_label(F.col("is_active")).alias("status"),
                    "created_at", F.col("id").alias("_id")).orderBy("_id").drop("_id")


def export_sales(t: Tables, filters: dict | None = None) -> DataFrame:
    """One row per order line (orders without lines give one row of nulls), newest first."""
    f = filters or {}
    so = _date_range(t["sales_orders"], "order_date", f.get("startDate"), f.get("endDate")).alias("so")
    cu = t["customers"].select(F.col("id").alias("_cid"), F.col("name").alias("customer_name"))
    it = t["sales_order_items"].alias("i")
    pr = t["products"].select(F.col("id").alias("_pid"), F.col("name").alias("product_name"))
    j = (so.join(cu, F.col("so.customer_id") == F.col("_cid"), "left")
         .join(it, F.col("so.id") == F.col("i.order_id"), "left")
         .join(pr, F.col("i.product_id") == F.col("_pid"), "left"))
    return j.select("so.order_no", "so.order_date", "customer_name", "product_name", "i.quantity", "i.unit_price",
                    "i.line_total", "so.payment_method", "so.order_status").orderBy(
                        F.col("order_date").desc(), F.col("order_no").asc(), F.col("product_name").asc())


def export_inventory(t: Tables, filters: dict | None = None) -> DataFrame:
    """Active products with stock value and status label, lowest stock first."""
    p = t["products"].where(F.col("is_active") == 1).alias("p")
    c = t["categories"].select(F.col("id").alias("_cid"), F.col("name").alias("category"))
    j = p.join(c, F.col("p.category_id") == F.col("_cid"), "left")
    status = stock_status(F.col("p.current_stock"), F.col("p.min_stock"), F.col("p.max_stock"),
                          STOCK_LOW_LABEL, STOCK_HIGH_LABEL, STOCK_OK_LABEL)
    return j.select("p.name", "category", "p.current_stock", "p.min_stock", "p.cost_price",
                    (F.col("p.current_stock") * F.col("p.cost_price")).cast(MONEY).alias("stock_value"),
                    status.alias("stock_status"), "p.updated_at").orderBy(F.col("current_stock").asc(), F.col("name").asc())


def export_financial(t: Tables, filters: dict | None = None) -> DataFrame:
    """E5: money moves, newest first, optional inclusive date range."""
    f = filters or {}
    ft = _date_range(t["financial_transactions"], "transaction_date", f.get("startDate"), f.get("endDate"))
    return ft.select("transaction_date", "transaction_type", "category", "amount", "payment_method", "description",
                     "created_at", F.col("id").alias("_id")).orderBy(F.col("transaction_date").desc(), "_id").drop("_id")


EXPORTS = {
    "products": export_products,
    "customers": export_customers,
    "sales": export_sales,
    "inventory": export_inventory,
    "financial": export_financial,
}


def export_report(t: Tables, kind: str, filters: dict | None = None) -> DataFrame:
    """Choose the report by type; unknown types are rejected."""
    if kind not in EXPORTS:
        raise ValueError(f"unsupported export type: {kind!r}")
    return EXPORTS[kind](t, filters)
