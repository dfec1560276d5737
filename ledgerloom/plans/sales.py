"""Flat-model sales jobs: dashboard, trend, listing, recording sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_date_col, as_ts_col, check_days, exact_sum, int_sum, trailing_days
from ..tables import Tables


def sales_trend(t: Tables, *, as_of, days: int = 30) -> DataFrame:
    """A2: daily sales total over the trailing ``days`` (inclusive); days without sales are absent."""
    check_days(days)
    s = t["sales"]
    return (s.where(trailing_days("date", as_of, days))
            .groupBy("date")
            .agg(exact_sum("total_amount").alias("daily_total"))
            .orderBy("date"))


def dashboard_overview(t: Tables, *, as_of, days: int = 30) -> DataFrame:
    """A1: one row: trailing-window total, distinct products, low-stock count, today's total.

    Both sales figures come from one filtered scan (today is inside the
    window); null sums read 0 (D20). The two single-row results are joined.
    """
    check_days(days)
    day = as_date_col(as_of)
    s = t["sales"].where(trailing_days("date", day, days))
    sales = s.agg(
        F.coalesce(exact_sum("total_amount"), F.lit(0.0)).alias("total_sales"),
        F.coalesce(exact_sum(F.when(F.col("date") == day, F.col("total_amount"))), F.lit(0.0)).alias("today_sales"),
    )
    inv = t["inventory"].agg(F.struct(
        F.countDistinct("product_name").alias("total_products"),
        F.count_if(F.col("current_stock") <= F.col("min_stock")).alias("low_stock_count"),
    ).alias("s")).scalar()  # one-row aggregate as a scalar subquery
    return sales.select("total_sales", inv["total_products"].alias("total_products"),
                        inv["low_stock_count"].alias("low_stock_count"), "today_sales")


def sales_list(t: Tables) -> DataFrame:
    """All sales, newest first."""
    return t["sales"].orderBy(F.col("date").desc(), F.col("created_at").desc(), F.col("customer_name").asc(),
                              F.col("product_name").asc())


def record_sales(batch: DataFrame, *, run_ts) -> DataFrame:
    """Sale rows to append: ``total_amount = quantity * unit_price``, ``created_at`` = run time."""
    return batch.select(
        "date", "product_name", "category", "quantity", "unit_price",
        (F.col("quantity") * F.col("unit_price")).alias("total_amount"),
        "customer_name",
        as_ts_col(run_ts).alias("created_at"),
    )


def apply_sales_to_stock(inventory: DataFrame, sales: DataFrame) -> DataFrame:
    """Stock minus sold quantity per product name; may go negative; unknown names ignored.

    Sales are aggregated per product before the join, so the join input is
    one row per product whatever the sales volume or skew.
    """
    sold = sales.groupBy("product_name").agg(int_sum("quantity").alias("_sold"))
    joined = inventory.join(sold, on="product_name", how="left")
    stock_type = inventory.schema["current_stock"].dataType
    return joined.select(*[
        (F.col(c) - F.coalesce(F.col("_sold"), F.lit(0))).cast(stock_type).alias(c) if c == "current_stock" else F.col(c)
        for c in inventory.columns
    ])
