"""Analytics the schema implies (T2) and the docs claim (T3): SURVEY 2.8.

The reference has no code for these; the rules are the survey's definitions
(all thresholds are arguments). Skew-aware choices:

* running balances (``stock_ledger``) are split by product *and hour*: chunk
  totals give per-chunk offsets, and the in-chunk running sum adds them, so a
  product holding a third of all moves is spread over its hours;
* mean gaps between orders (``churn_risk``) use ``(last - first) / (n - 1)``,
  an aggregate, instead of a ``lag`` window per customer;
* "latest"/"best" per key are aggregates (``max_by`` / ``max(struct)``);
* date-range matching (``promotion_match``) reads running maxima over offers by
  block of days and minimum amount, instead of pairing lines and promotions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MONEY, as_date_col, check_days, exact_sum, int_sum
from ..operators.cumulative import global_running, global_running_max, global_running_min
from ..operators.json_diff import json_diff
from ..operators.quantiles import group_quantiles
from ..sources.snapshot import materialize, remove_table
from ..tables import Tables

# The survey's thresholds and labels for these reports.
LEVEL_THRESHOLDS = [("vip", 1_000_000), ("gold", 500_000), ("silver", 100_000)]
LEVEL_DEFAULT = "bronze"
PAID, PENDING, PARTIAL = "paid", "pending", "partial"
AGE_BUCKETS = [(30, "0-30"), (60, "31-60"), (90, "61-90")]
AGE_LAST = "90+"
OVERDUE_DAYS = 30
QUALITY_PASS = 80
ABC_A, ABC_B = 0.80, 0.95
MAX_CARRIERS = 100_000   # size bound checked before carriers are attached to every shipment; beyond it, same answers
EXACT_COST = "decimal(30,5)"  # weight (3 decimals) x price (2): carriers compare by the unrounded cost


def _lines_with_dates(t: Tables) -> DataFrame:
    so = t["sales_orders"].select(F.col("id").alias("order_id"), "order_date", "customer_id",
                                  F.col("total_amount").alias("order_total"), "order_status")
    return t["sales_order_items"].join(so, on="order_id", how="inner")


# ------------------------------------------------------------------ M1
def stock_ledger(t: Tables, *, check_before: bool = False, grain: str = "hour") -> DataFrame:
    """M1: running balance per product and rows breaking the chain
    ``stock_after <> previous stock_after + quantity_change`` (first row per product never breaks).

    Work is split by (product, time chunk of ``grain``): the in-chunk window
    is bounded by one product-hour, and the carry into each chunk (running
    total, previous stock) comes from a window over chunk summaries, whose
    count per product is bounded by the calendar. Moves without a date come
    first, as one chunk.
    """
    if grain not in ("minute", "hour", "day", "week", "month"):
        raise ValueError(f"unsupported grain: {grain!r}")
    tx = t["inventory_transactions"].withColumn(
        "_chunk", F.date_trunc(grain, F.col("transaction_date").cast("timestamp")))
    order = [F.col("transaction_date"), F.col("id")]
    chunks = (tx.groupBy("product_id", "_chunk")
              .agg(F.sum("quantity_change").cast("bigint").alias("_chunk_change"),
                   F.max_by("stock_after", F.struct(*order)).alias("_chunk_last_after")))
    wd = Window.partitionBy("product_id").orderBy("_chunk")
    chunks = chunks.select("product_id", "_chunk",
                           F.coalesce(F.sum("_chunk_change").over(wd.rowsBetween(Window.unboundedPreceding, -1)),
                                      F.lit(0)).cast("bigint").alias("_carry"),
                           F.lag("_chunk_last_after").over(wd).alias("_prev_chunk_after"))
    wi = Window.partitionBy("product_id", "_chunk").orderBy(*order)
    # null-safe, so that moves without a date (the first chunk) and without a product stay
    carried = chunks.withColumnsRenamed({"product_id": "_product", "_chunk": "_at"})
    rows = tx.join(carried, tx["product_id"].eqNullSafe(carried["_product"]) & tx["_chunk"].eqNullSafe(carried["_at"]))
    prev_after = F.coalesce(F.lag("stock_after").over(wi), F.col("_prev_chunk_after"))
    running = (F.col("_carry") + F.sum("quantity_change").over(wi.rowsBetween(Window.unboundedPreceding, 0))
               ).cast("bigint")
    with_before = check_before and "stock_before" in tx.columns
    out = rows.select("id", "product_id", "transaction_date", "quantity_change", "stock_after",
                      running.alias("running_balance"), prev_after.alias("prev_stock_after"),
                      *(["stock_before"] if with_before else []))
    out = out.withColumn("is_break", F.coalesce(
        F.col("stock_after") != F.col("prev_stock_after") + F.col("quantity_change"), F.lit(False)))
    if with_before:
        out = out.withColumn(
            "is_break", F.col("is_break") | F.coalesce(
                (F.col("stock_after") != F.col("stock_before") + F.col("quantity_change"))
                | (F.col("stock_before") != F.col("prev_stock_after")), F.lit(False)))
    return out


# ------------------------------------------------------------------ M2
def _climb(cats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finished, endless): nodes whose chain of parents ends at a root, with depth and path; the others that have all
    their parents, whose chain runs into a cycle.

    Pointer doubling: each node knows an ancestor and the names from below that ancestor down to itself. A round joins
    every unfinished node with its ancestor's row, which doubles both, so a tree of depth d takes log2(d) + 1 rounds. A
    parent of many children is one row on one side of the join, so skewed partitions can be split. No side is broadcast: files
    of ids and paths are small enough for that long after their rows are not, and every round would gather them on the
    driver. Every round is written; nodes finish level by level, so a round in which none finishes leaves only nodes that never will.
    """
    spark = cats.sparkSession
    now = materialize(spark, cats.select("id", "name", "parent_id", F.col("parent_id").alias("above"),
                                         F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.col("name").cast("string").alias("path")))
    done = now.where("above IS NULL").count()
    while done:
        up = now.select(F.col("id").alias("_id"), F.col("above").alias("_above"), F.col("depth").alias("_depth"), F.col("path").alias("_path")).hint("merge")
        climbed = now.where("above IS NOT NULL").join(up, F.col("above") == F.col("_id")).select(
            "id", "name", "parent_id", F.col("_above").alias("above"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat("_path", F.lit(" > "), "path").alias("path"))
        then = materialize(spark, now.where("above IS NULL").unionByName(climbed))
        remove_table(spark, now)
        now, before = then, done
        done = now.where("above IS NULL").count()
        if done == before:
            break
    return now.where("above IS NULL").select("id", "name", "parent_id", "depth", "path"), now.where("above IS NOT NULL").select("id", "name", "parent_id")


def category_tree(t: Tables) -> DataFrame:
    """M2: depth and root-to-node path of every category, at any depth.

    Categories whose chain of parents does not end at a root (a parent is missing, or the chain runs in a circle) are
    left out; ``category_cycles`` names the circles. Runs log2(depth) + 1 small jobs while the DataFrame is built.
    """
    return _climb(t["categories"].select("id", "name", "parent_id"))[0]


def category_cycles(t: Tables) -> DataFrame:
    """M2: categories that are their own ancestor: id, name, parent_id and ``cycle_id``, the smallest id of their circle.

    Pointer doubling again: every node knows the one some steps above it and the smallest id on the way. A round doubles the
    steps and drops the nodes that no pointer meets, which stand on no circle; once none is dropped, the rest are circles,
    and once no smallest id changes, each has been round its own. So rounds follow the longest branch or circle, and
    twice as many steps as there are nodes are always enough. No side of a join is broadcast, as in ``_climb``.
    """
    cats = t["categories"].select("id", "name", "parent_id")
    spark = cats.sparkSession
    left = materialize(spark, _climb(cats)[1])
    now = materialize(spark, left.select("id", F.col("parent_id").alias("above"), F.col("id").alias("least")).distinct())
    steps, n = 1, now.agg(F.count_distinct("id")).first()[0]
    most = 2 * n
    while n and steps < most:
        up = now.select(F.col("id").alias("_id"), F.col("above").alias("_above"), F.col("least").alias("_least")).hint("merge")
        met = now.select(F.col("above").alias("_met")).distinct().hint("merge")
        then = materialize(spark, now.join(met, F.col("id") == F.col("_met"), "left_semi").join(up, F.col("above") == F.col("_id"))
                           .select("id", F.col("_above").alias("above"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("moved")))
        remove_table(spark, now)
        now, steps, before = then, 2 * steps, n
        n, moved = now.agg(F.count_distinct("id"), F.count_if("moved")).first()
        if n == before and not moved:
            break
    named = now.select("id", F.col("least").alias("cycle_id")).hint("merge")
    return left.join(named, "id").select("id", "name", "parent_id", "cycle_id")


# ------------------------------------------------------------------ M3
def order_total_check(t: Tables, *, tolerance: float = 0.01) -> DataFrame:
    """M3: orders whose total differs from lines - discount + tax by more than ``tolerance``."""
    lines = t["sales_order_items"].groupBy("order_id").agg(
        F.sum(F.col("line_total").cast(MONEY)).alias("_lines"))
    so = t["sales_orders"].join(lines.withColumnRenamed("order_id", "id"), on="id", how="left")
    expected = (F.coalesce(F.col("_lines"), F.lit(0).cast(MONEY)) - F.coalesce(F.col("discount_amount"), F.lit(0))
                + F.coalesce(F.col("tax_amount"), F.lit(0)))
    diff = F.col("total_amount").cast(MONEY) - expected
    return (so.select("id", "order_no", F.col("total_amount").cast("double").alias("total_amount"),
                      F.coalesce(F.col("_lines"), F.lit(0)).cast("double").alias("lines_total"),
                      diff.cast("double").alias("difference"))
            .where(F.abs(F.col("difference")) > tolerance))


# ------------------------------------------------------------------ M4
def gross_margin(t: Tables) -> DataFrame:
    """M4: revenue, cost, margin and margin rate per product, with category subtotals and a total
    (ROLLUP over category, product)."""
    items = t["sales_order_items"]
    prod = t["products"].select(F.col("id").alias("product_id"), "category_id")
    j = items.join(prod, on="product_id", how="left")
    fine = j.groupBy("category_id", "product_id").agg(  # finest grain first, then the ROLLUP
        F.sum(F.col("line_total").cast(MONEY)).alias("_r"),
        F.sum((F.col("quantity") * F.col("cost_price")).cast(MONEY)).alias("_c"))
    g = fine.rollup("category_id", "product_id").agg(
        F.sum("_r").alias("_rev"), F.sum("_c").alias("_cost"), F.grouping_id().alias("level"))
    margin = F.col("_rev") - F.col("_cost")
    return g.select("category_id", "product_id", "level", F.col("_rev").cast("double").alias("revenue"),
                    F.col("_cost").cast("double").alias("cost"), margin.cast("double").alias("margin"),
                    F.try_divide(margin.cast("double"), F.col("_rev").cast("double")).alias("margin_rate"))


# ------------------------------------------------------------------ M5
def customer_level(total: Column) -> Column:
    out = None
    for name, threshold in LEVEL_THRESHOLDS:
        out = F.when(total >= threshold, name) if out is None else out.when(total >= threshold, name)
    return out.otherwise(LEVEL_DEFAULT)


def customer_rollup(t: Tables, *, statuses=("confirmed", "completed")) -> DataFrame:
    """M5: per customer: orders, total purchases, last purchase, balance due and level by total."""
    so = t["sales_orders"].where(F.col("order_status").isin(*statuses))
    agg = so.groupBy(F.col("customer_id").alias("id")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("total_amount").cast(MONEY)).alias("_total"),
        F.max("order_date").alias("last_purchase_date"),
        F.sum(F.greatest(F.col("total_amount").cast(MONEY) - F.coalesce(F.col("paid_amount"), F.lit(0)).cast(MONEY),
                         F.lit(0).cast(MONEY))).alias("_due"))
    c = t["customers"].select("id", "name").join(agg, on="id", how="left")
    total = F.coalesce(F.col("_total"), F.lit(0).cast(MONEY))
    return c.select("id", "name", F.coalesce(F.col("orders"), F.lit(0)).alias("orders"),
                    total.cast("double").alias("total_purchases"), "last_purchase_date",
                    F.coalesce(F.col("_due"), F.lit(0)).cast("double").alias("balance_due"),
                    customer_level(total).alias("level"))


# ------------------------------------------------------------------ M6
def receivables_aging(t: Tables, *, as_of) -> DataFrame:
    """M6: payment status (paid / pending / partial), age in days, age bucket and overdue flag."""
    so = t["sales_orders"]
    paid = F.coalesce(F.col("paid_amount"), F.lit(0))
    status = (F.when(paid >= F.col("total_amount"), PAID).when(paid == 0, PENDING).otherwise(PARTIAL))
    age = F.datediff(as_date_col(as_of), F.col("order_date"))
    bucket = None
    for limit, label in AGE_BUCKETS:
        bucket = F.when(age <= limit, label) if bucket is None else bucket.when(age <= limit, label)
    bucket = bucket.otherwise(AGE_LAST)
    return so.select("id", "order_no", "order_date", F.col("total_amount").cast("double").alias("total_amount"),
                     paid.cast("double").alias("paid_amount"),
                     F.greatest(F.col("total_amount") - paid, F.lit(0)).cast("double").alias("outstanding"),
                     status.alias("payment_status"), age.alias("age_days"), bucket.alias("age_bucket"),
                     ((status != PAID) & (age > OVERDUE_DAYS)).alias("overdue"))


# ------------------------------------------------------------------ M7
def purchase_progress(t: Tables) -> DataFrame:
    """M7: ordered vs received quantity per purchase order and a receipt status."""
    lines = t["purchase_order_items"].groupBy(F.col("order_id").alias("id")).agg(
        int_sum("quantity").alias("ordered"), int_sum("received_quantity").alias("received"))
    po = t["purchase_orders"].select("id", "order_no", "supplier_id").join(lines, on="id", how="left")
    progress = F.try_divide(F.col("received").cast("double"), F.col("ordered").cast("double"))
    status = (F.when(F.col("ordered").isNull(), "no_lines").when(F.col("received") >= F.col("ordered"), "received")
              .when(F.col("received") > 0, "partial").otherwise("pending"))
    return po.select("id", "order_no", "supplier_id", "ordered", "received", progress.alias("progress"),
                     status.alias("receipt_status"))


# ------------------------------------------------------------------ M8
def finance_summary(t: Tables) -> DataFrame:
    """M8: amounts by month, type and category with subtotals (ROLLUP)."""
    ft = t["financial_transactions"].withColumn("month", F.date_format("transaction_date", "yyyy-MM"))
    fine = ft.groupBy("month", "transaction_type", "category").agg(  # finest grain first, then the ROLLUP
        F.sum(F.col("amount").cast(MONEY)).alias("_a"), F.count(F.lit(1)).alias("_n"))
    return fine.rollup("month", "transaction_type", "category").agg(
        F.sum("_a").cast("double").alias("amount"), F.sum("_n").cast("bigint").alias("transactions"),
        F.grouping_id().alias("level"))


# ------------------------------------------------------------------ M9
def account_balance(t: Tables) -> DataFrame:
    """M9: per account: money in, money out and net, from both legs of every transaction."""
    ft = t["financial_transactions"]
    legs = (ft.where(F.col("account_to").isNotNull())
            .select(F.col("account_to").alias("account"), F.col("amount").cast(MONEY).alias("inflow"),
                    F.lit(0).cast(MONEY).alias("outflow"))
            .unionByName(ft.where(F.col("account_from").isNotNull())
                         .select(F.col("account_from").alias("account"), F.lit(0).cast(MONEY).alias("inflow"),
                                 F.col("amount").cast(MONEY).alias("outflow"))))
    g = legs.groupBy("account").agg(F.sum("inflow").alias("_in"), F.sum("outflow").alias("_out"))
    return g.select("account", F.col("_in").cast("double").alias("inflow"),
                    F.col("_out").cast("double").alias("outflow"),
                    (F.col("_in") - F.col("_out")).cast("double").alias("balance"))


# ------------------------------------------------------------------ M10
_DAY_BITS, _DAY_SHIFT = 22, 1 << 20  # day numbers of the years 1 to 9999 fit these bits after the shift


def _day_number(day: Column) -> Column:
    return F.unix_date(day).cast("long") + _DAY_SHIFT


def _day_blocks(start: Column, end: Column) -> Column:
    """The aligned power-of-two blocks of days (array of struct<lvl, blk>) that make up start..end: two a level at most.

    At level k the blocks between the first one that starts in the interval and the last one that ends in it
    are left; an odd one at either edge has no sibling to merge with and is taken.
    """
    def at_level(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = F.floor((_day_number(start) + size - 1) / size), F.floor((_day_number(end) + 1) / size)
        left = F.when((low < high) & (low % 2 == 1), low)
        right = F.when((low + low % 2 < high) & (high % 2 == 1), high - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda b: F.struct(k.alias("lvl"), b.alias("blk")))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_DAY_BITS)), at_level))


def promotion_match(t: Tables) -> DataFrame:
    """Best promotion per order line: active, order day inside the promotion's dates, order
    total >= minimum (none = 0), product in the JSON list (empty or no list = all products); a
    promotion without an end runs on. Best = largest discount, then lowest promotion id. Lines
    without a match are left out.

    Lines and promotions are never paired. A promotion becomes offers at the few blocks of days that make up its
    dates; for each block and product (or all products) the best percentage and the best flat offer up to every minimum
    amount are running maxima, and each distinct (day, product, order total) reads them in the same ordered pass at the
    blocks its day lies in. Work grows with lines plus promotions, each times the levels (at most 23) that have offers,
    however many promotions a day has. A negative line takes its smallest percentage, a zero line the lowest id.
    """
    node = ["lvl", "blk", "all_products", "product"]
    promo = t["promotions"].where(F.coalesce(F.col("is_active"), F.lit(1)) == 1)
    lines = _lines_with_dates(t).where(F.col("line_total").isNotNull())
    last_day = t["sales_orders"].agg(F.max("order_date")).scalar()
    pct = F.when(F.col("discount_type") == "percentage", (F.col("discount_value") / 100).cast("decimal(9,4)"))
    flat = F.when(F.coalesce(F.col("discount_type") != "percentage", F.lit(True)), F.col("discount_value").cast(MONEY))
    low_id = -F.col("id")
    offers = promo.withColumn("_end", F.coalesce("end_date", last_day)).where(F.col("start_date") <= F.col("_end")).select(
        F.coalesce("min_amount", F.lit(0)).alias("amount"),
        F.when(pct.isNotNull(), F.struct(pct.alias("v"), low_id.alias("i"))).alias("high_pct"),
        F.when(pct.isNotNull(), F.struct((-pct).alias("v"), low_id.alias("i"))).alias("low_pct"),
        F.when(pct.isNotNull(), low_id).alias("any_pct"),
        F.when(flat.isNotNull(), F.struct(flat.alias("v"), low_id.alias("i"))).alias("high_flat"),
        F.when(F.col("discount_value").isNull(), low_id).alias("no_value"),
        F.coalesce(F.from_json("applicable_products", "array<bigint>"), F.array().cast("array<bigint>")).alias("_products"),
        F.explode(_day_blocks(F.col("start_date"), F.col("_end"))).alias("_block"))
    kinds = ["high_pct", "low_pct", "any_pct", "high_flat", "no_value"]
    offers = offers.withColumn("all_products", F.size("_products") == 0).withColumn(
        "product", F.explode(F.when(F.col("all_products"), F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct("_products")))
    ).where(F.col("product").isNotNull()).select("_block.*", "all_products", "product", "amount", *kinds)
    offers = materialize(t.spark, offers.groupBy(*node, "amount").agg(*[F.max(k).alias(k) for k in kinds]))

    # only days and totals that some offer may reach, at the levels that have offers (at most 2 x 23 entries)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("lvl"))
    reach = offers.agg(F.min(F.col("blk") * size).alias("first"), F.max((F.col("blk") + 1) * size).alias("end"), F.min("amount").alias("least"),
                       F.collect_set(F.struct("lvl", "all_products")).alias("levels"))
    asked = lines.select("order_date", "product_id", "order_total").dropna().where(
        (_day_number(F.col("order_date")) >= reach.select("first").scalar()) & (_day_number(F.col("order_date")) < reach.select("end").scalar())
        & (F.col("order_total") >= reach.select("least").scalar())).distinct()
    reads = (asked.withColumn("_levels", reach.select("levels").scalar()).withColumn("_level", F.explode("_levels"))
             .select(*asked.columns, "_level.*").withColumn("blk", F.floor(_day_number(F.col("order_date")) / size))
             .withColumn("product", F.when(F.col("all_products"), F.lit(0)).otherwise(F.col("product_id")).cast("long"))
             .join(offers.select(*node).distinct(), on=node, how="left_semi"))
    rows = offers.withColumn("is_read", F.lit(False)).unionByName(
        reads.withColumn("is_read", F.lit(True)).withColumn("amount", F.col("order_total")), allowMissingColumns=True)
    group = F.struct(*node)
    seen = global_running_max(rows.withColumnsRenamed({k: f"o_{k}" for k in kinds}),
                              [F.col(c) for c in (*node, "amount", "is_read", "order_date", "product_id")],
                              {k: F.when(F.col(f"o_{k}").isNotNull(), F.struct(group.alias("g"), F.col(f"o_{k}").alias("best"))) for k in kinds})
    best = seen.where("is_read").groupBy("order_date", "product_id", "order_total").agg(
        *[F.max(F.when(F.col(k)["g"] == group, F.col(k)["best"])).alias(k) for k in kinds])

    m = F.col("line_total").cast(MONEY)
    offer = lambda d, i: F.struct(d.cast("decimal(28,6)").alias("d"), i.alias("neg_id"))
    by_pct = F.when(F.col("any_pct").isNotNull(), F.when(m > 0, offer(m * F.col("high_pct.v"), F.col("high_pct.i"))).when(
        m < 0, offer(m * -F.col("low_pct.v"), F.col("low_pct.i"))).otherwise(offer(F.lit(0), F.col("any_pct"))))
    by_flat = F.when(F.col("high_flat").isNotNull(), offer(F.col("high_flat.v"), F.col("high_flat.i")))
    unpriced = F.when(F.col("no_value").isNotNull(), offer(F.lit(None), F.col("no_value")))
    return (lines.join(best, on=["order_date", "product_id", "order_total"], how="inner")
            .withColumn("_b", F.greatest(by_pct, by_flat, unpriced)).where(F.col("_b").isNotNull())
            .select("order_id", "product_id", "order_date", "quantity", "line_total",
                    (-F.col("_b.neg_id")).alias("promotion_id"), F.col("_b.d").cast("double").alias("discount")))


# ------------------------------------------------------------------ M11
def freight_quote(t: Tables, *, max_carriers: int = MAX_CARRIERS) -> DataFrame:
    """Cheapest active carrier per shipment: ``greatest(weight * price_per_kg, min_charge)``,
    ties by carrier code. Each distinct weight is priced once and joined back.

    Up to ``max_carriers`` active carriers (counted first) the carrier list is
    attached to each distinct weight as one scalar-subquery array (no join)
    and the minimum found with ``transform`` + ``array_min``. Beyond the
    bound nothing is broadcast: ``_freight_by_breakpoints`` gives the same
    answer from running minima over weights and carrier breakpoints.
    """
    carriers = t["carriers"].where(F.col("is_active") == 1).select(
        "code", F.col("price_per_kg").cast(MONEY).alias("p"), F.col("min_charge").cast(MONEY).alias("m"))
    so = t["shipping_orders"].select("id", "shipping_no", "weight")
    weights = so.select(F.col("weight").alias("_w")).where(F.col("_w").isNotNull()).distinct()  # no weight, no quote
    if carriers.count() <= max_carriers:
        arr = carriers.agg(F.collect_list(F.struct("code", "p", "m")).alias("c")).scalar()
        # the array is attached as a column first (subqueries may not sit inside a lambda)
        priced = weights.select("_w", arr.alias("_carriers"))
        w = F.col("_w").cast("decimal(12,3)")
        cost = F.transform(F.col("_carriers"), lambda c: F.struct(
            F.greatest((w * c["p"]).cast(EXACT_COST), c["m"].cast(EXACT_COST)).alias("cost"),
            c["code"].alias("code")))
        best = F.array_min(cost)
        quotes = priced.select("_w", best["code"].alias("carrier_code"), best["cost"].cast("double").alias("quote"))
    else:
        quotes = _freight_by_breakpoints(weights, carriers)
    return so.join(quotes, on=F.col("weight").eqNullSafe(F.col("_w")), how="left").select(
        "id", "shipping_no", "weight", "carrier_code", "quote")


def _freight_by_breakpoints(weights: DataFrame, carriers: DataFrame) -> DataFrame:
    """Exact quotes without pairing weights and carriers.

    A carrier costs its flat ``m`` up to its breakpoint ``b = m / p`` and
    ``p * w`` beyond it. For weight ``w`` the best flat offer is the least
    ``(m, code)`` over carriers with ``b >= w`` and the best linear offer is
    ``w`` times the least ``(p, code)`` over carriers with ``b < w``. Putting
    weights and breakpoints in one order (key, weights first on ties), these
    are a suffix and a prefix minimum, computed range-partitioned.
    """
    # breakpoints at 18 decimals: m and p have 2 decimals and w 3, so a breakpoint that is not equal to
    # a weight differs from it by at least 1e-5 / p, far above the rounding; the weight is the same
    # 3-decimal value the cost uses
    big = F.lit(10 ** 12).cast("decimal(38,18)")
    brk = F.when(F.col("p") > 0, (F.col("m") / F.col("p")).cast("decimal(38,18)")).otherwise(big)
    w_dec = F.col("_w").cast("decimal(12,3)").cast("decimal(38,18)")
    events = (weights
              .select(w_dec.alias("_key"), F.lit(0).alias("_kind"), "_w",
                      F.lit(None).cast("string").alias("code"), F.lit(None).cast(MONEY).alias("p"),
                      F.lit(None).cast(MONEY).alias("m"))
              .unionByName(carriers.select(brk.alias("_key"), F.lit(1).alias("_kind"),
                                           F.lit(None).cast("double").alias("_w"), "code", "p", "m")))
    asc = [F.col("_key").asc(), F.col("_kind").asc(), F.col("code").asc_nulls_first(), F.col("_w").asc()]
    desc = [F.col("_key").desc(), F.col("_kind").desc(), F.col("code").desc_nulls_last(), F.col("_w").desc()]
    lin = global_running_min(events, asc, F.when(F.col("_kind") == 1, F.struct("p", "code")), "_lin")
    both = global_running_min(lin, desc, F.when(F.col("_kind") == 1, F.struct("m", "code")), "_flat")
    w = F.col("_w").cast("decimal(12,3)")
    lin_offer = F.when(F.col("_lin").isNotNull(), F.struct(
        (w * F.col("_lin.p")).cast(EXACT_COST).alias("cost"), F.col("_lin.code").alias("code")))
    flat_offer = F.when(F.col("_flat").isNotNull(), F.struct(
        F.col("_flat.m").cast(EXACT_COST).alias("cost"), F.col("_flat.code").alias("code")))
    best = F.least(lin_offer, flat_offer)
    return both.where(F.col("_kind") == 0).select(
        "_w", best["code"].alias("carrier_code"), best["cost"].cast("double").alias("quote"))


# ------------------------------------------------------------------ M12
def delivery_performance(t: Tables) -> DataFrame:
    """Per carrier, over delivered shipments: count, average days taken, on-time count and rate."""
    so = t["shipping_orders"].where(F.col("actual_delivery").isNotNull())
    days = F.datediff("actual_delivery", "shipping_date")
    g = so.groupBy("carrier_code").agg(
        F.count(F.lit(1)).alias("delivered"),
        F.try_divide(F.sum(days).cast("double"), F.count(days).cast("double")).alias("avg_days"),
        F.count_if(F.col("actual_delivery") <= F.col("expected_delivery")).alias("on_time"))
    car = t["carriers"].select(F.col("code").alias("carrier_code"), F.col("name").alias("carrier_name"))
    return g.join(car, on="carrier_code", how="left").select(
        "carrier_code", "carrier_name", "delivered", "avg_days", "on_time",
        (F.col("on_time") / F.col("delivered")).alias("on_time_rate"))


# ------------------------------------------------------------------ M13
def supplier_scorecard(t: Tables) -> DataFrame:
    """Per supplier: receipts, on-time receipts, quality passes (score >= 80) and issues
    (exceptions on its receipts)."""
    ex = (t["exception_records"].where(F.col("receiving_order_id").isNotNull())
          .groupBy(F.col("receiving_order_id").alias("id")).agg(F.count(F.lit(1)).alias("_issues")))
    ro = t["receiving_orders"].join(ex, on="id", how="left")
    g = ro.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("receipts"),
        F.count_if(F.col("receiving_date") <= F.col("planned_date")).alias("on_time"),
        F.count_if(F.col("quality_score") >= QUALITY_PASS).alias("quality_pass"),
        F.coalesce(F.sum("_issues"), F.lit(0)).cast("bigint").alias("issues"))
    return g.select("*", (F.col("on_time") / F.col("receipts")).alias("on_time_rate"),
                    (F.col("quality_pass") / F.col("receipts")).alias("quality_pass_rate"))


# ------------------------------------------------------------------ M14
def receipt_quality(t: Tables) -> DataFrame:
    """Per receipt: ordered, received, rejected, shortage, shortage rate and reject rate."""
    g = t["receiving_items"].groupBy("receiving_order_id").agg(
        int_sum("ordered_quantity").alias("ordered"), int_sum("received_quantity").alias("received"),
        int_sum("rejected_quantity").alias("rejected"))
    shortage = F.greatest(F.col("ordered") - F.col("received"), F.lit(0)).cast("bigint")
    return g.select("*", shortage.alias("shortage"),
                    F.try_divide(shortage.cast("double"), F.col("ordered").cast("double")).alias("shortage_rate"),
                    F.try_divide(F.col("rejected").cast("double"), F.col("received").cast("double")).alias("reject_rate"))


# ------------------------------------------------------------------ M15
def packing_performance(t: Tables, *, distributed: bool = False) -> DataFrame:
    """Per packer: tasks, completed tasks, average actual and estimated minutes, average overrun,
    median and 90th percentile of actual minutes (exact, interpolated).

    Whole minutes have few different values, which ``percentile`` counts in one buffer a packer. ``distributed``
    gives the same rows by ``group_quantiles``, without that buffer, for times with unbounded many values."""
    pt = t["packing_tasks"]
    done = F.col("actual_time").isNotNull()
    buffered = [] if distributed else [F.percentile("actual_time", 0.5).alias("p50_actual"), F.percentile("actual_time", 0.9).alias("p90_actual")]
    totals = pt.groupBy("assigned_to").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(done).alias("completed"),
        F.try_divide(F.sum("actual_time").cast("double"), F.count("actual_time").cast("double")).alias("avg_actual"),
        F.try_divide(F.sum("estimated_time").cast("double"), F.count("estimated_time").cast("double"))
        .alias("avg_estimated"),
        F.try_divide(F.sum(F.col("actual_time") - F.col("estimated_time")).cast("double"),
                     F.count(F.col("actual_time") - F.col("estimated_time")).cast("double")).alias("avg_overrun"), *buffered)
    if not distributed:
        return totals
    actual = group_quantiles(pt, "assigned_to", "actual_time", {"p50_actual": 0.5, "p90_actual": 0.9})
    actual = actual.withColumnRenamed("assigned_to", "_who")
    return totals.join(actual, F.col("assigned_to").eqNullSafe(F.col("_who")), "left").drop("_who")


# ------------------------------------------------------------------ M16
def exception_cost(t: Tables) -> DataFrame:
    """Exception count and cost by type x responsible party with all subtotals (CUBE)."""
    fine = t["exception_records"].groupBy("exception_type", "responsible_party").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("financial_impact").cast(MONEY)).alias("_c"))
    return fine.cube("exception_type", "responsible_party").agg(  # CUBE over the pre-aggregated grain
        F.sum("_n").cast("bigint").alias("exceptions"), F.sum("_c").cast("double").alias("cost"),
        F.grouping_id().alias("level"))


# ------------------------------------------------------------------ M18
def expiry_watch(t: Tables, *, as_of, days: int = 30) -> DataFrame:
    """Received lots with stock left whose expiry is within ``days`` of ``as_of`` (either side);
    expired lots are flagged."""
    check_days(days)
    d = as_date_col(as_of)
    ri = t["receiving_items"].where(
        (F.col("expiry_date") <= F.date_add(d, days)) & (F.col("expiry_date") >= F.date_sub(d, days))
        & ((F.col("received_quantity") - F.coalesce(F.col("rejected_quantity"), F.lit(0))) > 0))
    return ri.select("receiving_order_id", "product_id", "expiry_date",
                     (F.col("received_quantity") - F.coalesce(F.col("rejected_quantity"), F.lit(0))).alias("quantity"),
                     F.datediff("expiry_date", d).alias("days_left"), (F.col("expiry_date") < d).alias("expired"))


# ------------------------------------------------------------------ M19
def audit_diff(t: Tables) -> DataFrame:
    """Per audit row, each key whose value differs between the old and new JSON objects."""
    logs = t["operation_logs"]
    m = logs.select("id", "table_name", "record_id",
                    F.from_json("old_data", "map<string,string>").alias("o"),
                    F.from_json("new_data", "map<string,string>").alias("n"))
    keys = m.select("*", F.explode(F.array_union(F.coalesce(F.map_keys("o"), F.array().cast("array<string>")),
                                                 F.coalesce(F.map_keys("n"), F.array().cast("array<string>"))))
                    .alias("key"))
    old_v, new_v = F.col("o")[F.col("key")], F.col("n")[F.col("key")]
    return keys.where(~old_v.eqNullSafe(new_v)).select("id", "table_name", "record_id", "key",
                                                       old_v.alias("old_value"), new_v.alias("new_value"))


def audit_diff_paths(t: Tables) -> DataFrame:
    """M19 for nested data: per audit row, each path at which the old and new JSON differ by value (``operators.json_diff``)."""
    return json_diff(t["operation_logs"], "old_data", "new_data", ["id", "table_name", "record_id"])


# ------------------------------------------------------------------ K1
def _daily_series(t: Tables, as_of, days: int) -> DataFrame:
    """Dense daily revenue for the ``days`` days ending at ``as_of`` (missing days are 0)."""
    d = as_date_col(as_of)
    lines = _lines_with_dates(t).where(
        (F.col("order_date") > F.date_sub(d, days)) & (F.col("order_date") <= d))
    daily = lines.groupBy(F.col("order_date").alias("date")).agg(
        F.sum(F.col("line_total").cast(MONEY)).alias("revenue"))
    cal = t.spark.range(1).select(F.explode(F.sequence(F.date_sub(d, days - 1), d)).alias("date"))
    return cal.join(daily, on="date", how="left").select(
        "date", F.coalesce("revenue", F.lit(0).cast(MONEY)).alias("revenue"))


def sales_forecast(t: Tables, *, as_of, history: int = 90, horizon: int = 7) -> DataFrame:
    """K1: least-squares line through the last ``history`` days (x = day offset to ``as_of``),
    projected ``horizon`` days ahead, floored at 0, rounded to 4 places.

    Sums are exact decimals; slope and intercept are computed from them in
    double, so the fit does not depend on summation order.
    """
    d = as_date_col(as_of)
    s = _daily_series(t, d, history).select(F.datediff("date", d).cast("bigint").alias("x"), "revenue")
    fit = s.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").cast("double").alias("sx"),
                F.sum(F.col("x") * F.col("x")).cast("double").alias("sxx"),
                F.sum("revenue").alias("_sy"), F.sum(F.col("x") * F.col("revenue")).alias("_sxy"))
    fit = fit.select("n", "sx", "sxx", F.col("_sy").cast("double").alias("sy"),
                     F.col("_sxy").cast("double").alias("sxy"))
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = fit.select("*", slope.alias("slope")).select(F.struct(
        "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept")).alias("f")).scalar()
    ahead = t.spark.range(1, horizon + 1).select(F.col("id").cast("int").alias("k"))
    line = fit["intercept"] + fit["slope"] * F.col("k")
    return ahead.select(F.date_add(d, F.col("k")).alias("date"),
                        F.round(F.greatest(line, F.lit(0.0)), 4).alias("forecast"))


# ------------------------------------------------------------------ K2
def churn_risk(t: Tables, *, as_of, factor: float = 2.0) -> DataFrame:
    """K2: customers with 2+ orders: recency, mean gap, spend; at risk when recency > factor x mean gap;
    high value when spend is in the top quartile (spend >= exact 75th percentile)."""
    d = as_date_col(as_of)
    so = t["sales_orders"]
    g = so.groupBy(F.col("customer_id").alias("id")).agg(
        F.count(F.lit(1)).alias("orders"), F.min("order_date").alias("first_order"),
        F.max("order_date").alias("last_order"), F.sum(F.col("total_amount").cast(MONEY)).alias("_spend"))
    g = g.where(F.col("orders") >= 2)
    p75 = exact_quantile(g.select(F.col("_spend").cast("double").alias("v"), "id"), "v", 0.75, tie="id")
    mean_gap = F.datediff("last_order", "first_order") / (F.col("orders") - 1)
    recency = F.datediff(d, F.col("last_order"))
    return g.select("id", "orders", "first_order", "last_order", mean_gap.alias("mean_gap_days"),
                    recency.alias("recency_days"), F.col("_spend").cast("double").alias("spend"),
                    (recency > F.lit(factor) * mean_gap).alias("churn_risk"),
                    (F.col("_spend").cast("double") >= p75).alias("high_value"))


def exact_quantile(df: DataFrame, value: str, q: float, *, tie: str) -> Column:
    """Exact interpolated quantile of ``value`` (same rule as ``percentile`` / ``quantile_cont``) as a
    scalar Column, without gathering all values into one task: the two order statistics around
    ``q * (n - 1)`` are found by a distributed running count (``global_running``)."""
    n = df.agg(F.count(value).alias("n")).scalar()
    pos = (n - 1).cast("double") * F.lit(q)
    ranked = global_running(df.where(F.col(value).isNotNull()), [F.col(value).asc(), F.col(tie).asc()],
                            count_col="_rn")
    lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
    picked = ranked.where((F.col("_rn") == lo) | (F.col("_rn") == hi)).agg(
        F.min(value).alias("a"), F.max(value).alias("b"))
    frac = pos - F.floor(pos)
    return picked.select((F.col("a") + (F.col("b") - F.col("a")) * frac).alias("p")).scalar()


# ------------------------------------------------------------------ K3
def replenishment(t: Tables, *, as_of, days: int = 30, cover_days: float = 7.0) -> DataFrame:
    """available = stock - reserved; mean daily sales over ``days``; flag when cover < ``cover_days``
    or stock <= min; suggest ``greatest(max - available, 0)``. Only flagged products are returned."""
    check_days(days)
    d = as_date_col(as_of)
    sold = (_lines_with_dates(t).where((F.col("order_date") > F.date_sub(d, days)) & (F.col("order_date") <= d))
            .groupBy(F.col("product_id").alias("id")).agg(int_sum("quantity").alias("_sold")))
    p = t["products"].join(sold, on="id", how="left")
    available = (F.col("current_stock") - F.coalesce(F.col("reserved_stock"), F.lit(0))).cast("bigint")
    mean_daily = F.coalesce(F.col("_sold"), F.lit(0)).cast("double") / F.lit(float(days))
    cover = F.when(mean_daily > 0, available.cast("double") / mean_daily)
    flag = F.coalesce(cover < cover_days, F.lit(False)) | F.coalesce(F.col("current_stock") <= F.col("min_stock"),
                                                                      F.lit(False))
    return p.select("id", "name", "current_stock", "min_stock", "max_stock", available.alias("available"),
                    mean_daily.alias("mean_daily_sales"), cover.alias("cover_days"),
                    F.greatest(F.col("max_stock") - available, F.lit(0)).cast("bigint").alias("suggested_qty"),
                    flag.alias("_flag")).where("_flag").drop("_flag")


# ------------------------------------------------------------------ K4
def sales_anomaly(t: Tables, *, window: int = 30, min_prior: int = 7, z: float = 3.0) -> DataFrame:
    """K4: daily revenue z-score against the previous ``window`` days that had sales (rows), for days
    with at least ``min_prior`` prior rows; flagged when |z| > ``z``. Rounded to 4 places.

    The window runs over daily totals (one row per calendar day), whose count
    is bounded by the calendar, not by the data volume.
    """
    daily = (_lines_with_dates(t).groupBy(F.col("order_date").alias("date"))
             .agg(F.sum(F.col("line_total").cast(MONEY)).alias("revenue")))
    w = Window.orderBy("date").rowsBetween(-window, -1)
    x = F.col("revenue").cast(MONEY)
    s = daily.select("date", x.cast("double").alias("revenue"),
                     F.count(x).over(w).alias("n"), F.sum(x).over(w).alias("_s"),
                     F.sum(x * x).over(w).alias("_ss"))
    n = F.col("n").cast("double")
    mean = F.col("_s").cast("double") / n
    var = (F.col("_ss").cast("double") - F.col("_s").cast("double") * F.col("_s").cast("double") / n) / (n - 1)
    zc = F.when(var > 0, (F.col("revenue") - mean) / F.sqrt(var))
    return (s.where(F.col("n") >= min_prior)
            .select("date", "revenue", F.round(mean, 4).alias("mean_prior"), F.round(zc, 4).alias("z_score"),
                    F.coalesce(F.abs(zc) > z, F.lit(False)).alias("is_anomaly")))


# ------------------------------------------------------------------ K5
def promotion_candidates(t: Tables, *, as_of, days: int = 30, share: float = 0.10) -> DataFrame:
    """K5: overstocked (stock >= max) and slow (sales in ``days`` < ``share`` of stock) products."""
    check_days(days)
    d = as_date_col(as_of)
    sold = (_lines_with_dates(t).where((F.col("order_date") > F.date_sub(d, days)) & (F.col("order_date") <= d))
            .groupBy(F.col("product_id").alias("id")).agg(int_sum("quantity").alias("_sold")))
    p = t["products"].join(sold, on="id", how="left").withColumn("sold", F.coalesce("_sold", F.lit(0)).cast("bigint"))
    limit = F.lit(share).cast("decimal(9,4)") * F.col("current_stock")  # exact: no binary-fraction rounding
    return p.where((F.col("current_stock") >= F.col("max_stock"))
                   & (F.col("sold") < limit)).select(
        "id", "name", "current_stock", "max_stock", "sold")


# ------------------------------------------------------------------ K6
def abc_analysis(t: Tables) -> DataFrame:
    """K6: products ranked by revenue (ties by id): A while the cumulative share <= 0.80, B <= 0.95, else C.

    Revenue is aggregated per product first; the cumulative sum over the
    global order is computed range-partitioned (``operators.global_running``),
    not in one task.
    """
    rev = t["sales_order_items"].groupBy("product_id").agg(F.sum(F.col("line_total").cast(MONEY)).alias("_rev"))
    total = rev.agg(F.sum("_rev").alias("t")).scalar()
    ranked = global_running(rev, [F.col("_rev").desc(), F.col("product_id").asc()], "_rev", sum_col="_cum")
    share = F.col("_cum").cast("double") / total.cast("double")
    out = ranked.select("product_id", F.col("_rev").cast("double").alias("revenue"),
                        F.col("_cum").cast("double").alias("cumulative_revenue"), share.alias("cumulative_share"))
    return out.withColumn("abc_class", F.when(F.col("cumulative_share") <= ABC_A, "A")
                          .when(F.col("cumulative_share") <= ABC_B, "B").otherwise("C"))


# ------------------------------------------------------------------ K7
def stock_turnover(t: Tables, *, as_of, days: int = 365) -> DataFrame:
    """K7: cost of goods sold over ``days`` / current stock value, per product."""
    check_days(days)
    d = as_date_col(as_of)
    cogs = (_lines_with_dates(t).where((F.col("order_date") > F.date_sub(d, days)) & (F.col("order_date") <= d))
            .groupBy(F.col("product_id").alias("id"))
            .agg(F.sum((F.col("quantity") * F.col("cost_price")).cast(MONEY)).alias("_cogs")))
    p = t["products"].join(cogs, on="id", how="left")
    value = (F.col("current_stock") * F.col("cost_price")).cast(MONEY)
    c = F.coalesce(F.col("_cogs"), F.lit(0).cast(MONEY))
    return p.select("id", "name", c.cast("double").alias("cogs"), value.cast("double").alias("stock_value"),
                    F.try_divide(c.cast("double"), value.cast("double")).alias("turnover"))


# ------------------------------------------------------------------ K8
SEVERITY = {"stock_out": 1, "churn": 2, "anomaly": 3, "overstock": 4}


def action_list(t: Tables, *, as_of) -> DataFrame:
    """K8: one ranked list of findings: stock-outs (replenishment), churn risks, sales anomalies and
    overstock (promotion candidates), by severity then amount (desc), subject."""
    rep = replenishment(t, as_of=as_of).select(
        F.lit("stock_out").alias("kind"), F.col("id").cast("string").alias("subject"),
        F.col("suggested_qty").cast("double").alias("amount"))
    churn = churn_risk(t, as_of=as_of).where("churn_risk").select(
        F.lit("churn").alias("kind"), F.col("id").cast("string").alias("subject"), F.col("spend").alias("amount"))
    anom = sales_anomaly(t).where("is_anomaly").select(
        F.lit("anomaly").alias("kind"), F.col("date").cast("string").alias("subject"), F.col("revenue").alias("amount"))
    over = promotion_candidates(t, as_of=as_of).select(
        F.lit("overstock").alias("kind"), F.col("id").cast("string").alias("subject"),
        F.col("current_stock").cast("double").alias("amount"))
    allf = rep.unionByName(churn).unionByName(anom).unionByName(over)
    sev = F.when(F.col("kind") == "stock_out", 1).when(F.col("kind") == "churn", 2).when(
        F.col("kind") == "anomaly", 3).otherwise(4)
    allf = allf.withColumn("severity", sev)
    order = [F.col("severity").asc(), F.col("amount").desc(), F.col("subject").asc()]
    ranked = global_running(allf, order, count_col="rank")  # range-partitioned, not one task
    return ranked.withColumn("rank", F.col("rank").cast("int"))


# ------------------------------------------------------------------ K9
def sales_cube(t: Tables) -> DataFrame:
    """K9: revenue and lines by month x category x customer segment with all subtotals (CUBE)."""
    lines = _lines_with_dates(t)
    prod = t["products"].select(F.col("id").alias("product_id"), "category_id")
    cust = t["customers"].select(F.col("id").alias("customer_id"), F.col("customer_type").alias("segment"))
    j = (lines.join(prod, on="product_id", how="left").join(cust, on="customer_id", how="left")
         .withColumn("month", F.date_format("order_date", "yyyy-MM")))
    # aggregate to the finest grain first: CUBE expands each input row 2^3 times, so it runs on the
    # (month, category, segment) totals instead of on every order line
    fine = j.groupBy("month", "category_id", "segment").agg(
        F.sum(F.col("line_total").cast(MONEY)).alias("_rev"), F.count(F.lit(1)).alias("_n"))
    return fine.cube("month", "category_id", "segment").agg(
        F.sum("_rev").cast("double").alias("revenue"), F.sum("_n").cast("bigint").alias("lines"),
        F.grouping_id().alias("level"))


# ------------------------------------------------------------------ K10
def member_loyalty(t: Tables) -> DataFrame:
    """Per member level: customers, buyers, spend, share of all spend and repeat rate (2+ orders)."""
    per = t["sales_orders"].groupBy(F.col("customer_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_orders"), F.sum(F.col("total_amount").cast(MONEY)).alias("_spend"))
    c = t["customers"].select("id", "member_level").join(per, on="id", how="left")
    g = c.groupBy("member_level").agg(
        F.count(F.lit(1)).alias("customers"), F.count("_orders").alias("buyers"),
        F.coalesce(F.sum("_spend"), F.lit(0).cast(MONEY)).alias("_spend"),
        F.count_if(F.col("_orders") >= 2).alias("repeat_buyers"))
    total = c.agg(F.sum("_spend")).scalar()  # spend over all levels, as a scalar subquery
    return g.select("member_level", "customers", "buyers", F.col("_spend").cast("double").alias("spend"),
                    F.try_divide(F.col("_spend").cast("double"), total.cast("double")).alias("spend_share"),
                    F.try_divide(F.col("repeat_buyers").cast("double"), F.col("buyers").cast("double"))
                    .alias("repeat_rate"))
