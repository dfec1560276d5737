"""Declared schemas of the retail data model.

Two generations of tables exist (see SURVEY 1.4): the flat ``sales`` /
``inventory`` / ``alerts`` model and the normalised model (products,
sales_orders, ...). Each schema lists the columns the jobs read or write.
``Tables`` conforms an input frame to its schema by adding any missing
column as a typed null, so a report never fails on an optional column.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "boolean": T.BooleanType(),
    "money": T.DecimalType(18, 2),
}


def struct(spec: str) -> T.StructType:
    """Build a StructType from ``"name type, name type"`` (types from ``_TYPES``)."""
    fields = []
    for part in spec.split(","):
        part = part.strip()
        if not part:
            continue
        name, typ = part.split()
        fields.append(T.StructField(name, _TYPES[typ], True))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    # flat model (server start tables)
    "sales": struct("id bigint, date date, product_name string, category string, quantity int, unit_price double, "
                    "total_amount money, customer_name string, created_at timestamp"),
    "inventory": struct("id bigint, product_name string, category string, current_stock int, min_stock int, "
                        "max_stock int, unit_cost money, supplier string, last_updated timestamp"),
    "alerts": struct("id bigint, type string, message string, severity string, is_read int, created_at timestamp"),
    # normalised model
    "categories": struct("id bigint, name string, description string, parent_id bigint, created_at timestamp"),
    "suppliers": struct("id bigint, name string, contact_person string, phone string, email string, address string, "
                        "credit_rating int, is_active int, created_at timestamp"),
    "customers": struct("id bigint, customer_code string, name string, phone string, email string, address string, "
                        "customer_type string, credit_limit money, current_balance money, total_purchases money, "
                        "last_purchase_date date, member_level string, points int, is_active int, created_at timestamp"),
    "products": struct("id bigint, product_code string, barcode string, name string, category_id bigint, brand string, "
                       "unit string, cost_price money, selling_price money, wholesale_price money, current_stock int, "
                       "min_stock int, max_stock int, reserved_stock int, supplier_id bigint, is_active int, "
                       "created_at timestamp, updated_at timestamp"),
    "sales_orders": struct("id bigint, order_no string, customer_id bigint, order_date date, payment_method string, "
                           "payment_status string, order_status string, subtotal money, discount_amount money, "
                           "tax_amount money, total_amount money, paid_amount money, created_at timestamp"),
    "sales_order_items": struct("order_id bigint, product_id bigint, quantity int, unit_price double, line_total money, "
                                "cost_price money"),
    "purchase_orders": struct("id bigint, order_no string, supplier_id bigint, order_date date, expected_date date, "
                              "received_date date, order_status string, total_amount money"),
    "purchase_order_items": struct("order_id bigint, product_id bigint, quantity int, received_quantity int"),
    "inventory_transactions": struct("id bigint, product_id bigint, transaction_type string, quantity_change int, "
                                     "stock_before bigint, stock_after bigint, transaction_date timestamp"),
    "financial_transactions": struct("id bigint, transaction_no string, transaction_type string, category string, "
                                     "amount money, payment_method string, account_from string, account_to string, "
                                     "description string, transaction_date date, created_at timestamp"),
    "accounts": struct("id bigint, account_code string, account_name string, account_type string, balance money, "
                       "currency string, is_active int"),
    "system_settings": struct("key string, value string, description string"),
    "operation_logs": struct("id bigint, table_name string, record_id bigint, old_data string, new_data string, "
                             "created_at timestamp"),
    "promotions": struct("id bigint, name string, type string, discount_type string, discount_value double, "
                         "start_date date, end_date date, min_amount money, applicable_products string, "
                         "is_active int"),
    "shipping_orders": struct("id bigint, shipping_no string, sales_order_id bigint, customer_name string, "
                              "shipping_address string, carrier_code string, shipping_date date, "
                              "expected_delivery date, actual_delivery date, status string, shipping_cost money, "
                              "weight double, created_at timestamp, updated_at timestamp"),
    "shipping_items": struct("shipping_order_id bigint, product_id bigint, line_no int, quantity int"),
    "carriers": struct("code string, name string, rating double, price_per_kg money, min_charge money, "
                       "is_active int"),
    "tracking_records": struct("id bigint, shipping_order_id bigint, tracking_no string, timestamp timestamp, "
                               "location string, status string, description string, operator string"),
    "receiving_orders": struct("id bigint, receiving_no string, purchase_order_id bigint, supplier_id bigint, "
                               "supplier_name string, planned_date date, receiving_date date, status string, "
                               "total_amount money, received_amount money, quality_score double, "
                               "created_at timestamp, updated_at timestamp"),
    "receiving_items": struct("receiving_order_id bigint, product_id bigint, ordered_quantity int, "
                              "received_quantity int, rejected_quantity int, expiry_date date"),
    "inspection_reports": struct("id bigint, receiving_order_id bigint, inspector string, inspection_date date, "
                                 "overall_rating double"),
    "quality_checks": struct("id bigint, inspection_report_id bigint, check_item string, standard string, "
                             "result string, actual_value string, notes string"),
    "exception_records": struct("id bigint, receiving_order_id bigint, supplier_name string, exception_type string, "
                                "responsible_party string, status string, financial_impact money, "
                                "resolved_date date, created_at timestamp, updated_at timestamp"),
    "supplier_evaluations": struct("supplier_id bigint, supplier_name string, evaluation_period string, "
                                   "delivery_rating double, quality_rating double, service_rating double, "
                                   "overall_rating double"),
    "packing_tasks": struct("id bigint, shipping_order_id bigint, customer_name string, priority string, "
                            "status string, assigned_to string, estimated_time int, actual_time int, "
                            "completed_at timestamp, created_at timestamp, updated_at timestamp"),
    "packing_items": struct("packing_task_id bigint, product_id bigint, quantity int"),
    # telemetry logs (flattened: one row per report)
    "error_log": struct("id bigint, type string, severity string, ts timestamp"),
    "metric_log": struct("id bigint, type string, duration money, status int, ts timestamp"),
}
