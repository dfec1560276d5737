"""Retail views over the driver's TPC-H-like tables.

Each entry maps one retail table of the library's data model onto the
driver tables (region nation customer supplier part orders lineitem events).
The SQL text runs unchanged on Spark and DuckDB (FIXTURES.md section 2), so
the same text feeds the Spark temp views and the oracle CTEs.
"""

VIEWS: dict[str, str] = {
    "as_of": """
SELECT CAST(max(o_orderdate) AS DATE) AS d, CAST(max(o_orderdate) AS DATE) - 30 AS d30 FROM orders
""",
    "inventory": """
SELECT p_partkey AS id, p_name || ' #' || CAST(p_partkey AS STRING) AS product_name, p_type AS category,
  CAST((p_partkey * 37) % 121 AS INT) AS current_stock,
  CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE 10 + p_size % 20 END AS min_stock, 80 + p_size % 40 AS max_stock,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 0.7 AS DECIMAL(18,2)) AS unit_cost,
  'Supplier ' || CAST(p_partkey % 10 AS STRING) AS supplier FROM part
""",
    "sales": """
SELECT CAST(o_orderdate AS DATE) AS date, p_name || ' #' || CAST(p_partkey AS STRING) AS product_name, p_type AS category,
  CAST(l_quantity AS INT) AS quantity, l_extendedprice / l_quantity AS unit_price,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount, c_name AS customer_name, o_orderdate AS created_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
""",
    "alerts": """
SELECT event_id AS id, event_type AS type, event_type || ' ' || CAST(user_id AS STRING) AS message,
  CASE WHEN value >= 100 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS is_read,
  date_trunc('minute', ts) AS created_at FROM events
""",
    "categories": """
SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id FROM region
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), n_name, CAST(n_regionkey + 1 AS BIGINT) FROM nation
""",
    "suppliers": """
SELECT s_suppkey AS id, s_name AS name, CAST(s_suppkey % 10 + 1 AS INT) AS credit_rating FROM supplier
""",
    "customers": """
SELECT c_custkey AS id, 'C' || CAST(c_custkey AS STRING) AS customer_code, c_name AS name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'wholesale' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'member' ELSE 'retail' END AS customer_type,
  CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'vip' WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' ELSE 'bronze' END AS member_level,
  CAST(c_acctbal AS DECIMAL(18,2)) AS current_balance, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1 END AS is_active FROM customer
""",
    "products": """
SELECT p_partkey AS id, 'P' || CAST(p_partkey AS STRING) AS product_code, p_name || ' #' || CAST(p_partkey AS STRING) AS name,
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE 100 + p_partkey % 25 END AS category_id, p_brand AS brand,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 0.7 AS DECIMAL(18,2)) AS cost_price, CAST(p_retailprice AS DECIMAL(18,2)) AS selling_price,
  CAST((p_partkey * 37) % 121 AS INT) AS current_stock, 10 + p_size % 20 AS min_stock, 80 + p_size % 40 AS max_stock,
  p_size % 7 AS reserved_stock, p_partkey % 120 AS supplier_id, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 1 END AS is_active FROM part
""",
    "sales_orders": """
SELECT o_orderkey AS id, 'SO' || CAST(o_orderkey AS STRING) AS order_no, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'cash' WHEN 1 THEN 'card' WHEN 2 THEN 'transfer' ELSE 'credit' END AS payment_method,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'confirmed' ELSE 'draft' END AS order_status,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN 1 THEN CAST(100 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS paid_amount FROM orders
""",
    "sales_order_items": """
SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity, l_extendedprice / l_quantity AS unit_price,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 0.7 AS DECIMAL(18,2)) AS cost_price
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
    "purchase_orders": """
SELECT o_orderkey AS id, 'PO' || CAST(o_orderkey AS STRING) AS order_no, o_orderkey % 100 AS supplier_id, CAST(o_orderdate AS DATE) AS order_date,
  CAST(o_orderdate AS DATE) + 7 AS expected_date, CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount FROM orders
""",
    "purchase_order_items": """
SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INT) ELSE CAST(floor(l_quantity / 2) AS INT) END AS received_quantity FROM lineitem
""",
    "shipping_orders": """
SELECT o_orderkey AS id, 'SH' || CAST(o_orderkey AS STRING) AS shipping_no, c_name AS customer_name, 'Addr ' || CAST(c_nationkey AS STRING) AS shipping_address,
  'K' || CAST(o_orderkey % 25 AS STRING) AS carrier_code, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS shipping_date,
  CAST(o_orderdate AS DATE) + 7 AS expected_delivery,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(5 + o_orderkey % 5 AS INT) END AS actual_delivery,
  CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'P' THEN 'shipped' WHEN o_orderkey % 2 = 0 THEN 'in_transit' ELSE 'preparing' END AS status,
  CAST(8 + o_orderkey % 40 AS DECIMAL(18,2)) AS shipping_cost, CAST(o_orderkey % 30 AS DOUBLE) AS weight, o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "shipping_items": """
SELECT l_orderkey AS shipping_order_id, l_partkey AS product_id, l_linenumber AS line_no, CAST(l_quantity AS INT) AS quantity FROM lineitem
""",
    "carriers": """
SELECT 'K' || CAST(n_nationkey AS STRING) AS code, n_name AS name, CAST(n_nationkey % 5 AS DOUBLE) AS rating,
  CAST(6 + n_nationkey % 7 AS DECIMAL(18,2)) AS price_per_kg, CAST(10 + n_nationkey AS DECIMAL(18,2)) AS min_charge,
  CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE 1 END AS is_active FROM nation
""",
    "tracking_records": """
SELECT event_id AS id, user_id AS shipping_order_id, ts AS timestamp, event_type AS status FROM events
""",
    "packing_tasks": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_orderkey END AS shipping_order_id, 'old name' AS customer_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE 'other' END AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'packing' END AS status, 'Packer ' || CAST(o_orderkey % 9 AS STRING) AS assigned_to,
  30 AS estimated_time, CASE WHEN o_orderstatus = 'F' THEN CAST(20 + o_orderkey % 25 AS INT) END AS actual_time, o_orderdate AS created_at FROM orders
""",
    "packing_items": """
SELECT l_orderkey AS packing_task_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity FROM lineitem
""",
    "receiving_orders": """
SELECT o_orderkey AS id, 'RC' || CAST(o_orderkey AS STRING) AS receiving_no, o_orderkey % 100 AS supplier_id,
  'Supplier ' || CAST(o_orderkey % 100 AS STRING) AS supplier_name, CAST(o_orderdate AS DATE) + 2 AS planned_date,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS receiving_date,
  CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'pending' WHEN 1 THEN 'inspecting' WHEN 2 THEN 'partial' WHEN 3 THEN 'rejected' ELSE 'completed' END AS status,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS received_amount,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(60 + o_orderkey % 41 AS DOUBLE) END AS quality_score, o_orderdate AS created_at FROM orders
""",
    "receiving_items": """
SELECT l_orderkey AS receiving_order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS ordered_quantity,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INT) ELSE CAST(floor(l_quantity / 2) AS INT) END AS received_quantity,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS rejected_quantity, CAST(l_shipdate AS DATE) + 90 AS expiry_date FROM lineitem
""",
    "inspection_reports": """
SELECT o_orderkey + 1000000 AS id, o_orderkey AS receiving_order_id, 'Inspector ' || CAST(o_orderkey % 7 AS STRING) AS inspector,
  CAST(o_orderdate AS DATE) AS inspection_date, CAST(60 + o_orderkey % 41 AS DOUBLE) AS overall_rating FROM orders WHERE o_orderkey % 3 = 0
""",
    "quality_checks": """
SELECT event_id AS id, event_id * 3 % 600 + 1000000 AS inspection_report_id, event_type AS check_item,
  CASE WHEN value < 50 THEN 'pass' WHEN value < 100 THEN 'warning' ELSE 'fail' END AS result FROM events
""",
    "exception_records": """
SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS receiving_order_id, 'own name' AS supplier_name,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'shortage' WHEN 1 THEN 'damage' WHEN 2 THEN 'quality' WHEN 3 THEN 'delay' ELSE 'specification' END AS exception_type,
  CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'supplier' WHEN 1 THEN 'carrier' WHEN 2 THEN 'warehouse' ELSE 'unknown' END AS responsible_party,
  CASE CAST(user_id % 3 AS INT) WHEN 0 THEN 'reported' WHEN 1 THEN 'investigating' ELSE 'closed' END AS status,
  CAST(value AS DECIMAL(18,2)) AS financial_impact, ts AS created_at FROM events WHERE event_type = 'error'
""",
    "supplier_evaluations": """
SELECT s_suppkey AS supplier_id, s_name AS supplier_name, '2001-0' || CAST(r_regionkey + 1 AS STRING) AS evaluation_period,
  CAST(s_suppkey % 5 + 1 AS DOUBLE) AS delivery_rating, CAST(r_regionkey + 1 AS DOUBLE) AS quality_rating,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST((s_suppkey + r_regionkey) % 5 + 1 AS DOUBLE) END AS service_rating FROM supplier CROSS JOIN region
""",
    "financial_transactions": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'expense' ELSE 'income' END AS transaction_type,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'purchase' WHEN 1 THEN 'sales' ELSE 'other' END AS category, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CASE WHEN o_orderkey % 3 = 0 THEN 'CASH001' END AS account_from, CASE WHEN o_orderkey % 3 <> 0 THEN 'BANK001' END AS account_to,
  CAST(o_orderdate AS DATE) AS transaction_date, o_orderdate AS created_at FROM orders
""",
    "inventory_transactions": """
SELECT event_id AS id, user_id AS product_id, CASE WHEN event_type = 'purchase' THEN -2 ELSE 1 END AS quantity_change,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN -2 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN event_id % 500 = 0 THEN 1 ELSE 0 END AS BIGINT) AS stock_after,
  ts AS transaction_date FROM events
""",
    "promotions": """
SELECT CAST(r_regionkey AS BIGINT) AS id, 'percentage' AS discount_type, CAST(5 + r_regionkey * 5 AS DOUBLE) AS discount_value,
  DATE '2001-01-01' + 30 * r_regionkey AS start_date, DATE '2001-02-15' + 30 * r_regionkey AS end_date, CAST(1000 * r_regionkey AS DECIMAL(18,2)) AS min_amount,
  CASE WHEN r_regionkey % 2 = 0 THEN '[]' ELSE '[1,2,3,4,5,6,7,8,9,10]' END AS applicable_products FROM region
""",
    "operation_logs": """
SELECT o_orderkey AS id, 'sales_orders' AS table_name, o_orderkey AS record_id, '{"status":"draft","method":"cash"}' AS old_data,
  CASE WHEN o_orderkey % 2 = 0 THEN '{"status":"draft","method":"card"}' ELSE '{"status":"completed","note":"x"}' END AS new_data FROM orders
""",
    "error_log": """
SELECT event_id AS id, event_type AS type, CASE WHEN value >= 200 THEN 'critical' WHEN value >= 100 THEN 'high' ELSE 'medium' END AS severity, ts FROM events
""",
    "metric_log": """
SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'page_load' WHEN event_type IN ('click','purchase') THEN 'api_call' ELSE 'other' END AS type,
  CAST(value * 20 AS DECIMAL(18,2)) AS duration, CASE WHEN event_id % 10 = 0 THEN 500 ELSE 200 END AS status, ts FROM events
""",
    "status_changes": """
SELECT event_id AS seq, user_id AS id, ts AS change_ts,
  CASE event_type WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'resolved' WHEN 'view' THEN 'completed' ELSE 'in_transit' END AS status,
  CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS actual_delivery,
  CASE WHEN event_id % 4 = 0 THEN CAST(value AS DECIMAL(18,2)) END AS received_amount,
  CASE WHEN event_id % 5 = 0 THEN value END AS quality_score FROM events
""",
    "import_rows": """
SELECT p_partkey + 1 AS line_no, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN p_partkey % 19 = 0 THEN 'abc' WHEN p_partkey % 23 = 0 THEN '12abc' WHEN p_partkey % 29 = 0 THEN '' ELSE CAST(p_size AS STRING) END AS stock,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS category, 'Supplier ' || CAST(p_partkey % 10 AS STRING) AS supplier FROM part
""",
}

# Output columns of each view, in order.
VIEW_COLUMNS: dict[str, list[str]] = {
    "as_of": ['d', 'd30'],
    "inventory": ['id', 'product_name', 'category', 'current_stock', 'min_stock', 'max_stock', 'unit_cost', 'supplier'],
    "sales": ['date', 'product_name', 'category', 'quantity', 'unit_price', 'total_amount', 'customer_name', 'created_at'],
    "alerts": ['id', 'type', 'message', 'severity', 'is_read', 'created_at'],
    "categories": ['id', 'name', 'parent_id'],
    "suppliers": ['id', 'name', 'credit_rating'],
    "customers": ['id', 'customer_code', 'name', 'customer_type', 'member_level', 'current_balance', 'is_active'],
    "products": ['id', 'product_code', 'name', 'category_id', 'brand', 'cost_price', 'selling_price', 'current_stock', 'min_stock', 'max_stock', 'reserved_stock', 'supplier_id', 'is_active'],
    "sales_orders": ['id', 'order_no', 'customer_id', 'order_date', 'payment_method', 'order_status', 'total_amount', 'paid_amount'],
    "sales_order_items": ['order_id', 'product_id', 'quantity', 'unit_price', 'line_total', 'cost_price'],
    "purchase_orders": ['id', 'order_no', 'supplier_id', 'order_date', 'expected_date', 'total_amount'],
    "purchase_order_items": ['order_id', 'product_id', 'quantity', 'received_quantity'],
    "shipping_orders": ['id', 'shipping_no', 'customer_name', 'shipping_address', 'carrier_code', 'shipping_date', 'expected_delivery', 'actual_delivery', 'status', 'shipping_cost', 'weight', 'created_at'],
    "shipping_items": ['shipping_order_id', 'product_id', 'line_no', 'quantity'],
    "carriers": ['code', 'name', 'rating', 'price_per_kg', 'min_charge', 'is_active'],
    "tracking_records": ['id', 'shipping_order_id', 'timestamp', 'status'],
    "packing_tasks": ['id', 'shipping_order_id', 'customer_name', 'priority', 'status', 'assigned_to', 'estimated_time', 'actual_time', 'created_at'],
    "packing_items": ['packing_task_id', 'product_id', 'quantity'],
    "receiving_orders": ['id', 'receiving_no', 'supplier_id', 'supplier_name', 'planned_date', 'receiving_date', 'status', 'total_amount', 'received_amount', 'quality_score', 'created_at'],
    "receiving_items": ['receiving_order_id', 'product_id', 'ordered_quantity', 'received_quantity', 'rejected_quantity', 'expiry_date'],
    "inspection_reports": ['id', 'receiving_order_id', 'inspector', 'inspection_date', 'overall_rating'],
    "quality_checks": ['id', 'inspection_report_id', 'check_item', 'result'],
    "exception_records": ['id', 'receiving_order_id', 'supplier_name', 'exception_type', 'responsible_party', 'status', 'financial_impact', 'created_at'],
    "supplier_evaluations": ['supplier_id', 'supplier_name', 'evaluation_period', 'delivery_rating', 'quality_rating', 'service_rating'],
    "financial_transactions": ['id', 'transaction_type', 'category', 'amount', 'account_from', 'account_to', 'transaction_date', 'created_at'],
    "inventory_transactions": ['id', 'product_id', 'quantity_change', 'stock_after', 'transaction_date'],
    "promotions": ['id', 'discount_type', 'discount_value', 'start_date', 'end_date', 'min_amount', 'applicable_products'],
    "operation_logs": ['id', 'table_name', 'record_id', 'old_data', 'new_data'],
    "error_log": ['id', 'type', 'severity', 'ts'],
    "metric_log": ['id', 'type', 'duration', 'status', 'ts'],
    "status_changes": ['seq', 'id', 'change_ts', 'status', 'actual_delivery', 'received_amount', 'quality_score'],
    "import_rows": ['line_no', 'name', 'stock', 'category', 'supplier'],
}
