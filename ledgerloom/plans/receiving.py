"""Goods receiving: lists, KPIs, daily series, exceptions, inspections, supplier ratings.

Reference behaviour kept (SURVEY A3, A6-A8, J4, J6, J7, J9, O4, W5, W7, W10-W12, W14, W15):
sums over no rows stay null here (unlike the dashboard, D20), the daily
series covers ``as_of - days`` onward with no upper bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_ts_col, check_days, exact_avg, exact_sum, int_sum, mean_of_three, trailing_days
from ..operators.changes import Rule, apply_changes
from ..operators.documents import child_lines, json_text, opened, parent_lines
from ..operators.latest import latest_per_key
from ..operators.rollup import child_rollup, nest_children
from ..tables import Tables

# Statuses the reference writes or counts.
NEW_RECEIPT_STATUS = "pending"
OPEN_RECEIPT_STATUSES = ("pending", "inspecting")
DONE_RECEIPT_STATUS = "completed"
OPEN_EXCEPTION_STATUSES = ("reported", "investigating")
NEW_EXCEPTION_STATUS = "reported"
REPORT_FIELDS = ["id", "receiving_order_id", "inspector", "inspection_date", "overall_rating", "defect_summary",
                 "recommendation", "photos", "certificates"]
CHECK_FIELDS = ["id", "check_item", "standard", "result", "actual_value", "notes"]


def _ids_filter(df: DataFrame, ids, col: str = "id") -> DataFrame:
    """Restrict to the given ids (list or single-column DataFrame); None keeps all."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), on=col, how="left_semi")
    return df.where(F.col(col).isin(list(ids)))


def receiving_order_list(t: Tables) -> DataFrame:
    """Each receipt with item count (0 when none) and ordered/received sums (null when none)."""
    out = child_rollup(
        t["receiving_orders"], "id", t["receiving_items"], "receiving_order_id",
        [F.count(F.lit(1)).alias("item_count"),
         int_sum("ordered_quantity").alias("total_ordered"),
         int_sum("received_quantity").alias("total_received")],
        fill={"item_count": 0})
    return out.orderBy(F.col("created_at").desc(), F.col("id").desc())


def receiving_stats(t: Tables) -> DataFrame:
    """One-row KPIs in one pass over receipts plus one over exceptions."""
    ro = t["receiving_orders"]
    kpi = ro.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(F.col("status") == DONE_RECEIPT_STATUS).alias("completed_orders"),
        F.count_if(F.col("status").isin(*OPEN_RECEIPT_STATUSES)).alias("pending_orders"),
        exact_sum("total_amount").alias("total_amount"),
        exact_sum("received_amount").alias("received_amount"),
        exact_avg("quality_score").alias("avg_quality_score"),
    )
    open_exc = t["exception_records"].agg(F.count_if(F.col("status").isin(*OPEN_EXCEPTION_STATUSES))).scalar()
    return kpi.select("*", open_exc.alias("open_exceptions"))


def receiving_daily(t: Tables, *, as_of, days: int = 30) -> DataFrame:
    """Receipts per day since ``as_of - days``: orders, amounts, average quality (non-null)."""
    check_days(days)
    ro = t["receiving_orders"].where(trailing_days(F.to_date("receiving_date"), as_of, days))
    return (ro.groupBy(F.to_date("receiving_date").alias("date"))
            .agg(F.count(F.lit(1)).alias("orders"),
                 exact_sum("total_amount").alias("total_amount"),
                 exact_sum("received_amount").alias("received_amount"),
                 exact_avg("quality_score").alias("avg_quality"))
            .orderBy("date"))


def exception_list(t: Tables) -> DataFrame:
    """Receipt exceptions (receipt id set) with the receipt's supplier name, newest first."""
    er = t["exception_records"].where(F.col("receiving_order_id").isNotNull())
    ro = t["receiving_orders"].select(F.col("id").alias("receiving_order_id"),
                                      F.col("supplier_name").alias("supplier_name_from_order"))
    return er.join(ro, on="receiving_order_id", how="left").select(*er.columns, "supplier_name_from_order") \
        .orderBy(F.col("created_at").desc(), F.col("id").desc())


def supplier_evaluation_list(t: Tables) -> DataFrame:
    """Evaluations by period desc, overall rating desc (rating = mean of three when not stored)."""
    ev = t["supplier_evaluations"]
    overall = F.coalesce(F.col("overall_rating"),
                         mean_of_three(F.col("delivery_rating"), F.col("quality_rating"), F.col("service_rating")))
    return (ev.withColumn("overall_rating", overall)
            .orderBy(F.col("evaluation_period").desc(), F.col("overall_rating").desc(), F.col("supplier_id").asc()))


def _checks_per_report(t: Tables) -> DataFrame:
    qc = t["quality_checks"].where(F.col("inspection_report_id").isNotNull())
    return nest_children(qc, "inspection_report_id", CHECK_FIELDS, "quality_checks", sort_fields=["id"])


def inspection_report_detail(t: Tables, *, ids=None, as_json: bool = False) -> DataFrame:
    """Each report with its checks as an array sorted by check id (empty when none, D5).

    One row a report at every size; ``page`` is always 0.
    """
    ir = _ids_filter(t["inspection_reports"], ids)
    checks = _checks_per_report(t).drop("page").withColumnRenamed("inspection_report_id", "id")
    out = (ir.join(checks, on="id", how="left")
           .withColumn("page", F.lit(0))
           .withColumn("quality_checks", F.coalesce(F.col("quality_checks"),
                                                    F.array().cast(checks.schema["quality_checks"].dataType))))
    if as_json:
        out = out.withColumn("quality_checks", _json(F.col("quality_checks")))
    return out


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _stringify_ts(df: DataFrame) -> DataFrame:
    """Timestamps inside nested JSON are written as text (``yyyy-MM-dd HH:mm:ss[.f]``)."""
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName().startswith("timestamp")
                       else F.col(f.name) for f in df.schema.fields])


def receiving_order_detail(t: Tables, *, ids=None, as_json: bool = False) -> DataFrame:
    """Each receipt with ``items`` and its ``inspection_report`` (lowest report id, D6) with checks.

    One row a receipt at every size; ``page`` is always 0.
    """
    ro = _ids_filter(t["receiving_orders"], ids)
    items_src = t["receiving_items"]
    item_fields = [c for c in items_src.columns if c != "receiving_order_id"]
    items = nest_children(_stringify_ts(items_src), "receiving_order_id", item_fields, "items",
                          sort_fields=item_fields).drop("page")
    first_ids = t["inspection_reports"].groupBy("receiving_order_id").agg(F.min("id").alias("id"))
    reports = inspection_report_detail(t).join(first_ids, on=["receiving_order_id", "id"], how="left_semi")
    rep_fields = [c for c in reports.columns if c not in ("receiving_order_id", "page")]
    rep = reports.select(F.col("receiving_order_id").alias("id"),
                         F.struct(*[F.col(c) for c in rep_fields]).alias("inspection_report"))
    out = (ro.join(items.withColumnRenamed("receiving_order_id", "id"), on="id", how="left")
           .join(rep, on="id", how="left")
           .withColumn("page", F.lit(0))
           .withColumn("items", F.coalesce(F.col("items"), F.array().cast(items.schema["items"].dataType))))
    if as_json:
        out = out.withColumn("items", _json(F.col("items"))).withColumn(
            "inspection_report", _json(F.col("inspection_report")))
    return out


def inspection_report_lines(t: Tables, *, ids=None) -> DataFrame:
    """A6/J6 as document lines (id, section, position, line): ``inspection_report_detail``'s documents with no array in a row.

    Put together in order, a report's lines are its JSON with ``quality_checks`` inside. Checks of unknown reports, or of
    none, have no document. The number of checks of one report is not bounded by a row or a task.
    """
    ir = _stringify_ts(_ids_filter(t["inspection_reports"], ids))
    checks = (t["quality_checks"].withColumnRenamed("id", "_id").withColumnRenamed("inspection_report_id", "id")
              .join(ir.select("id"), "id", "left_semi").select(F.col("id").alias("report"), F.col("_id").alias("id"), *CHECK_FIELDS[1:]))
    return (parent_lines(ir, "id", 0, opened(json_text("id", *[c for c in ir.columns if c != "id"]), "quality_checks"))
            .unionByName(child_lines(checks, "report", CHECK_FIELDS, [F.col(c) for c in CHECK_FIELDS], 1).withColumnRenamed("report", "id"))
            .unionByName(parent_lines(ir, "id", 2, F.lit("]}"))))


def receiving_order_lines(t: Tables, *, ids=None) -> DataFrame:
    """J9 as document lines (id, section, position, line): ``receiving_order_detail``'s documents with no array in a row.

    Sections: the receipt, its items, its lowest report (D6), that report's checks, the end.
    """
    ro = _stringify_ts(_ids_filter(t["receiving_orders"], ids))
    items = _stringify_ts(t["receiving_items"])
    item_fields = [c for c in items.columns if c != "receiving_order_id"]
    items = items.join(ro.select(F.col("id").alias("receiving_order_id")), "receiving_order_id", "left_semi")
    ir = _stringify_ts(t["inspection_reports"])
    lowest = ir.groupBy("receiving_order_id").agg(F.min("id").alias("id"))
    fields = ["id", *[c for c in ir.columns if c not in ("id", "receiving_order_id")]]
    report = ir.join(lowest, ["receiving_order_id", "id"], "left_semi").select(
        F.col("receiving_order_id").alias("_order"), F.col("id").alias("_report"), opened(json_text(*fields), "quality_checks").alias("_text"))
    with_report = ro.select("id").join(report, F.col("id") == F.col("_order"), "left")
    checks = t["quality_checks"].join(
        report.join(ro.select("id"), F.col("_order") == F.col("id"), "left_semi").select("_order", "_report"), F.col("inspection_report_id") == F.col("_report"))
    middle = F.concat(F.lit('],"inspection_report":'), F.coalesce("_text", F.lit("null}")))
    return (parent_lines(ro, "id", 0, opened(json_text("id", *[c for c in ro.columns if c != "id"]), "items"))
            .unionByName(child_lines(items, "receiving_order_id", item_fields, [F.col(c) for c in item_fields], 1).withColumnRenamed("receiving_order_id", "id"))
            .unionByName(parent_lines(with_report, "id", 2, middle))
            .unionByName(child_lines(checks.select("_order", *CHECK_FIELDS), "_order", CHECK_FIELDS, [F.col(c) for c in CHECK_FIELDS], 3)
                         .withColumnRenamed("_order", "id"))
            .unionByName(parent_lines(with_report.where("_report IS NOT NULL"), "id", 4, F.lit("]}}"))))


# ------------------------------------------------------------------ writes
def split_receiving_orders(requests: DataFrame, *, run_ts) -> tuple[DataFrame, DataFrame]:
    """Nested receipt requests -> (header rows with status 'pending', item rows).

    ``requests`` has the header fields plus ``items: array<struct>``; the
    receipt key is ``receiving_no`` (natural key) turned into an id.
    """
    from ..operators.dims import name_key
    header_cols = [c for c in requests.columns if c != "items"]
    keyed = requests.withColumn("id", name_key(F.col("receiving_no")))
    headers = keyed.select("id", *[c for c in header_cols if c not in ("id", "status")],
                           F.lit(NEW_RECEIPT_STATUS).alias("status"), as_ts_col(run_ts).alias("created_at"))
    items = (keyed.select(F.col("id").alias("receiving_order_id"), F.posexplode("items").alias("item_index", "item"))
             .select("receiving_order_id", "item_index", "item.*"))
    return headers, items


def apply_receiving_status(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Status always; received amount and quality score only when supplied."""
    return apply_changes(orders, changes, ["id"], {
        "status": Rule(F.col("status")),
        "received_amount": Rule(F.col("received_amount")),
        "quality_score": Rule(F.col("quality_score")),
    })


def apply_exception_status(exceptions: DataFrame, changes: DataFrame) -> DataFrame:
    """Status always; responsible party when supplied; resolved date only with status 'resolved'."""
    rules = {"status": Rule(F.col("status"))}
    if "responsible_party" in changes.columns:
        rules["responsible_party"] = Rule(F.col("responsible_party"))
    rules["resolved_date"] = Rule(F.col("resolved_date"), guard=F.col("status") == "resolved")
    return apply_changes(exceptions, changes, ["id"], rules)


def apply_receiving_items(items: DataFrame, changes: DataFrame,
                          fields=("received_quantity", "accepted_quantity", "rejected_quantity",
                                  "quality_status", "inspection_notes"),
                          keys=("id", "receiving_order_id"),
                          order: tuple[str, ...] = ("change_ts", "seq")) -> DataFrame:
    """Receipt line results matched on line id and receipt id; all fields overwritten (nulls too).

    The last change per line wins as a whole row.
    """
    keys = list(keys)
    fields = [f for f in fields if f in items.columns and f in changes.columns]
    last = latest_per_key(changes.select(*keys, *fields, *order), keys, list(order))
    hit = last.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields]).withColumn("_hit", F.lit(True))
    joined = items.join(hit, on=keys, how="left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}").cast(items.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in fields else F.col(c) for c in items.columns])


def apply_inspection_reports(reports: DataFrame, orders: DataFrame, *, run_ts=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split nested reports into (report rows, check rows) and copy ``overall_rating`` to the
    receipt's ``quality_score`` (the latest report per receipt wins: greatest report id).

    ``reports`` has report fields plus ``quality_checks: array<struct>``.
    Returns (new orders snapshot, report rows, check rows). A report without checks has its row; photo and
    certificate lists are stored as JSON text (null stays null), and fields the reports lack are null.
    A receipt that has a report is ``updated_at`` ``run_ts``, if that is given.
    """
    rows = reports.select(*[_stored(reports, c) for c in REPORT_FIELDS])
    checks = (reports.select(F.col("id").alias("inspection_report_id"), F.explode("quality_checks").alias("c"))
              .select("inspection_report_id", "c.*"))
    latest = (reports.groupBy("receiving_order_id")
              .agg(F.max_by("overall_rating", "id").alias("_rating"), F.lit(True).alias("_hit"))
              .withColumnRenamed("receiving_order_id", "id"))
    joined = orders.join(latest, on="id", how="left")
    typ = orders.schema["quality_score"].dataType
    new_orders = joined.select(*[
        F.coalesce(F.col("_rating").cast(typ), F.col(c)).alias(c) if c == "quality_score"
        else F.when(F.col("_hit"), as_ts_col(run_ts)).otherwise(F.col(c)).alias(c) if c == "updated_at" and run_ts is not None
        else F.col(c) for c in orders.columns])
    return new_orders, rows, checks


def _stored(reports: DataFrame, name: str) -> Column:
    """A report field as its column stores it: lists and structs as JSON text."""
    if name not in reports.columns:
        return F.lit(None).cast("string").alias(name)
    nested = reports.schema[name].dataType.typeName() in ("array", "struct", "map")
    return (_json(F.col(name)) if nested else F.col(name)).alias(name)


def append_exceptions(batch: DataFrame, *, run_ts) -> DataFrame:
    """New exception rows: status 'reported', evidence list stored as JSON text."""
    cols = [c for c in batch.columns if c not in ("evidence_files", "status", "created_at")]
    evidence = (F.to_json(F.col("evidence_files")) if "evidence_files" in batch.columns
                else F.lit(None).cast("string"))
    return batch.select(*cols, evidence.alias("evidence_files"), F.lit(NEW_EXCEPTION_STATUS).alias("status"),
                        as_ts_col(run_ts).alias("created_at"))


def supplier_rating(evaluations: DataFrame) -> DataFrame:
    """Evaluation rows with ``overall_rating`` = mean of the three ratings (null if any is null)."""
    return evaluations.withColumn("overall_rating", mean_of_three(
        F.col("delivery_rating"), F.col("quality_rating"), F.col("service_rating")))
