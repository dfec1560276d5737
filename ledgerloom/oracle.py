"""DuckDB oracle SQL, one statement per catalog key.

Written independently of the DataFrame code, over the same retail views
(``fx_<view>`` CTEs are added by ``fixtures.with_views``). Money sums are
exact decimal sums cast to double and integer sums are cast to BIGINT on
both sides (SURVEY 4.3), so results hash identically across engines.
"""

from __future__ import annotations

from .fixtures import with_views

ASOF = "(SELECT d FROM fx_as_of)"
MONEY_SUM = "CAST(SUM(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def msum(expr: str) -> str:
    return MONEY_SUM.format(expr)


BODIES: dict[str, str] = {}

BODIES["sales_trend"] = f"""
SELECT date, {msum('total_amount')} AS daily_total
FROM fx_sales WHERE date >= {ASOF} - 30 GROUP BY date ORDER BY date
"""

BODIES["sales_trend_7"] = f"""
SELECT date, {msum('total_amount')} AS daily_total
FROM fx_sales WHERE date >= {ASOF} - 7 GROUP BY date ORDER BY date
"""

BODIES["dashboard_overview"] = f"""
SELECT
  COALESCE((SELECT {msum('total_amount')} FROM fx_sales WHERE date >= {ASOF} - 30), 0.0) AS total_sales,
  (SELECT COUNT(DISTINCT product_name) FROM fx_inventory) AS total_products,
  (SELECT COUNT(*) FROM fx_inventory WHERE current_stock <= min_stock) AS low_stock_count,
  COALESCE((SELECT {msum('total_amount')} FROM fx_sales WHERE date = {ASOF}), 0.0) AS today_sales
"""

BODIES["sales_list"] = """
SELECT CAST(NULL AS BIGINT) AS id, * FROM fx_sales ORDER BY date DESC, created_at DESC
"""

BODIES["record_sales"] = f"""
SELECT date, product_name, category, quantity, unit_price, quantity * unit_price AS total_amount,
  customer_name, CAST({ASOF} AS TIMESTAMP) AS created_at
FROM fx_sales
"""

BODIES["apply_sales_to_stock"] = """
SELECT i.id, i.product_name, i.category, CAST(i.current_stock - COALESCE(s.sold, 0) AS INTEGER) AS current_stock,
  i.min_stock, i.max_stock, i.unit_cost, i.supplier, CAST(NULL AS TIMESTAMP) AS last_updated
FROM fx_inventory i
LEFT JOIN (SELECT product_name, CAST(SUM(quantity) AS BIGINT) AS sold FROM fx_sales GROUP BY product_name) s
  ON i.product_name = s.product_name
"""

BODIES["inventory_status"] = """
SELECT product_name, current_stock, min_stock, max_stock,
  CASE WHEN current_stock <= min_stock THEN 'low' WHEN current_stock >= max_stock THEN 'high' ELSE 'normal' END AS status
FROM fx_inventory ORDER BY current_stock
"""

BODIES["low_stock_items"] = """
SELECT product_name, current_stock, min_stock FROM fx_inventory WHERE current_stock <= min_stock
"""

BODIES["low_stock_alerts"] = f"""
SELECT 'low_stock' AS type,
  product_name || ' 库存不足，当前: ' || CAST(current_stock AS VARCHAR) || '，最低: ' || CAST(min_stock AS VARCHAR) AS message,
  'warning' AS severity, 0 AS is_read, CAST({ASOF} AS TIMESTAMP) AS created_at
FROM fx_inventory WHERE current_stock <= min_stock
"""

BODIES["alert_inbox"] = """
SELECT * FROM fx_alerts ORDER BY is_read ASC NULLS FIRST, created_at DESC NULLS LAST, id DESC LIMIT 50
"""

BODIES["mark_alerts_read"] = """
SELECT a.id, a.type, a.message, a.severity,
  CASE WHEN a.id IN (SELECT seq FROM fx_status_changes WHERE status = 'resolved') THEN 1 ELSE a.is_read END AS is_read,
  a.created_at
FROM fx_alerts a
"""

BODIES["upsert_inventory"] = f"""
WITH ch AS (
  SELECT name || ' #' || CAST(line_no - 1 AS VARCHAR) AS product_name,
    CASE WHEN category <> '' THEN category END AS category,
    TRY_CAST(regexp_extract(trim(stock), '^[+-]?[0-9]+', 0) AS INTEGER) AS current_stock,
    supplier
  FROM fx_import_rows WHERE name <> ''
)
SELECT id, product_name, category, current_stock, min_stock, max_stock, unit_cost, supplier,
  CAST(NULL AS TIMESTAMP) AS last_updated
FROM fx_inventory WHERE product_name NOT IN (SELECT product_name FROM ch)
UNION ALL
SELECT i.id, c.product_name, c.category, c.current_stock, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER),
  CAST(NULL AS DECIMAL(18,2)), c.supplier, CAST({ASOF} AS TIMESTAMP)
FROM ch c LEFT JOIN fx_inventory i ON i.product_name = c.product_name
"""


# ---------------------------------------------------------------- receiving
BODIES["receiving_order_list"] = """
SELECT ro.*, COALESCE(c.item_count, 0) AS item_count, c.total_ordered, c.total_received
FROM fxc_receiving_orders ro LEFT JOIN (
  SELECT receiving_order_id, COUNT(*) AS item_count, CAST(SUM(ordered_quantity) AS BIGINT) AS total_ordered,
    CAST(SUM(received_quantity) AS BIGINT) AS total_received
  FROM fx_receiving_items GROUP BY receiving_order_id) c ON ro.id = c.receiving_order_id
ORDER BY ro.created_at DESC
"""

BODIES["receiving_stats"] = f"""
SELECT COUNT(*) AS total_orders,
  COUNT(*) FILTER (WHERE status = 'completed') AS completed_orders,
  COUNT(*) FILTER (WHERE status IN ('pending', 'inspecting')) AS pending_orders,
  {msum('total_amount')} AS total_amount, {msum('received_amount')} AS received_amount,
  CAST(SUM(CAST(quality_score AS DECIMAL(18,2))) AS DOUBLE) / COUNT(quality_score) AS avg_quality_score,
  (SELECT COUNT(*) FROM fx_exception_records WHERE status IN ('reported', 'investigating')) AS open_exceptions
FROM fx_receiving_orders
"""

BODIES["receiving_daily"] = f"""
SELECT CAST(receiving_date AS DATE) AS date, COUNT(*) AS orders, {msum('total_amount')} AS total_amount,
  {msum('received_amount')} AS received_amount, CAST(SUM(CAST(quality_score AS DECIMAL(18,2))) AS DOUBLE) / COUNT(quality_score) AS avg_quality
FROM fx_receiving_orders WHERE CAST(receiving_date AS DATE) >= {ASOF} - 30
GROUP BY CAST(receiving_date AS DATE) ORDER BY date
"""

BODIES["exception_list"] = """
SELECT er.*, ro.supplier_name AS supplier_name_from_order
FROM fxc_exception_records er LEFT JOIN fx_receiving_orders ro ON er.receiving_order_id = ro.id
WHERE er.receiving_order_id IS NOT NULL ORDER BY er.created_at DESC
"""

BODIES["supplier_evaluation_list"] = """
SELECT supplier_id, supplier_name, evaluation_period, delivery_rating, quality_rating, service_rating,
  COALESCE(overall_rating, (delivery_rating + quality_rating + service_rating) / CAST(3 AS DOUBLE)) AS overall_rating
FROM fxc_supplier_evaluations ORDER BY evaluation_period DESC, overall_rating DESC
"""

QC_LIST = """list({'id': id, 'check_item': check_item, 'standard': standard, 'result': result,
    'actual_value': actual_value, 'notes': notes} ORDER BY id)"""
QC_TYPE = ("STRUCT(id BIGINT, check_item VARCHAR, standard VARCHAR, result VARCHAR, actual_value VARCHAR, "
           "notes VARCHAR)[]")

BODIES["inspection_report_detail"] = f"""
SELECT ir.*, 0 AS page, CAST(COALESCE(to_json(c.qc), '[]') AS VARCHAR) AS quality_checks
FROM fx_inspection_reports ir LEFT JOIN (
  SELECT inspection_report_id, {QC_LIST} AS qc
  FROM fxc_quality_checks WHERE inspection_report_id IS NOT NULL GROUP BY inspection_report_id) c
  ON ir.id = c.inspection_report_id
"""

BODIES["receiving_order_detail"] = f"""
WITH items AS (
  SELECT receiving_order_id, list({{'product_id': product_id, 'ordered_quantity': ordered_quantity,
      'received_quantity': received_quantity, 'rejected_quantity': rejected_quantity, 'expiry_date': expiry_date}}
    ORDER BY product_id, ordered_quantity, received_quantity, rejected_quantity, expiry_date) AS items
  FROM fx_receiving_items GROUP BY receiving_order_id),
checks AS (
  SELECT inspection_report_id, {QC_LIST} AS qc
  FROM fxc_quality_checks WHERE inspection_report_id IS NOT NULL GROUP BY inspection_report_id),
rep AS (
  SELECT ir.receiving_order_id,
    arg_min({{'id': ir.id, 'inspector': ir.inspector, 'inspection_date': ir.inspection_date,
      'overall_rating': ir.overall_rating, 'quality_checks': COALESCE(c.qc, CAST([] AS {QC_TYPE}))}}, ir.id) AS r
  FROM fx_inspection_reports ir LEFT JOIN checks c ON ir.id = c.inspection_report_id
  GROUP BY ir.receiving_order_id)
SELECT ro.*, 0 AS page, CAST(COALESCE(to_json(i.items), '[]') AS VARCHAR) AS items,
  CAST(to_json(rep.r) AS VARCHAR) AS inspection_report
FROM fxc_receiving_orders ro LEFT JOIN items i ON ro.id = i.receiving_order_id
LEFT JOIN rep ON ro.id = rep.receiving_order_id
"""

FOLD = "arg_max({v}, (change_ts, seq)) FILTER (WHERE {v} IS NOT NULL{g})"


def fold(v: str, guard: str = "") -> str:
    return FOLD.format(v=v, g=f" AND {guard}" if guard else "")


BODIES["apply_receiving_status"] = f"""
WITH f AS (
  SELECT id, {fold('status')} AS n_status, {fold('received_amount')} AS n_ra, {fold('quality_score')} AS n_qs, MAX(change_ts) AS n_at
  FROM fx_status_changes GROUP BY id)
SELECT r.id, r.receiving_no, r.supplier_id, r.supplier_name, r.planned_date, r.receiving_date,
  COALESCE(f.n_status, r.status) AS status, r.total_amount, COALESCE(f.n_ra, r.received_amount) AS received_amount,
  COALESCE(f.n_qs, r.quality_score) AS quality_score, r.created_at, r.purchase_order_id, COALESCE(f.n_at, r.updated_at) AS updated_at
FROM fxc_receiving_orders r LEFT JOIN f ON r.id = f.id
"""

BODIES["apply_exception_status"] = f"""
WITH f AS (
  SELECT id, {fold('status')} AS n_status, {fold('actual_delivery', "status = 'resolved'")} AS n_rd, MAX(change_ts) AS n_at
  FROM fx_status_changes GROUP BY id)
SELECT e.id, e.receiving_order_id, e.supplier_name, e.exception_type, e.responsible_party,
  COALESCE(f.n_status, e.status) AS status, e.financial_impact, COALESCE(f.n_rd, e.resolved_date) AS resolved_date,
  e.created_at, COALESCE(f.n_at, e.updated_at) AS updated_at
FROM fxc_exception_records e LEFT JOIN f ON e.id = f.id
"""

BODIES["apply_receiving_items"] = """
WITH ch AS (
  SELECT product_id AS id, receiving_order_id, ordered_quantity - rejected_quantity AS received_quantity,
    rejected_quantity, CAST(expiry_date AS TIMESTAMP) AS change_ts, CAST(ordered_quantity AS BIGINT) AS seq
  FROM fx_receiving_items),
l AS (
  SELECT id, receiving_order_id,
    arg_max({'rq': received_quantity, 'rj': rejected_quantity},
            (change_ts, seq, received_quantity, rejected_quantity)) AS v
  FROM ch GROUP BY id, receiving_order_id)
SELECT i.receiving_order_id, i.product_id AS id, i.ordered_quantity,
  CASE WHEN l.id IS NOT NULL THEN l.v.rq ELSE i.received_quantity END AS received_quantity,
  CASE WHEN l.id IS NOT NULL THEN l.v.rj ELSE i.rejected_quantity END AS rejected_quantity,
  i.expiry_date
FROM fx_receiving_items i LEFT JOIN l ON i.product_id = l.id AND i.receiving_order_id = l.receiving_order_id
"""

BODIES["apply_inspection_reports"] = f"""
SELECT r.id, r.receiving_no, r.supplier_id, r.supplier_name, r.planned_date, r.receiving_date, r.status,
  r.total_amount, r.received_amount, COALESCE(l.rating, r.quality_score) AS quality_score, r.created_at,
  r.purchase_order_id, CASE WHEN l.receiving_order_id IS NOT NULL THEN CAST({ASOF} AS TIMESTAMP) ELSE r.updated_at END AS updated_at
FROM fxc_receiving_orders r LEFT JOIN (
  SELECT receiving_order_id, arg_max(overall_rating, id) AS rating FROM fx_inspection_reports
  GROUP BY receiving_order_id) l ON r.id = l.receiving_order_id
"""

BODIES["inspection_report_rows"] = """
SELECT id, receiving_order_id, inspector, inspection_date, overall_rating, CAST(NULL AS VARCHAR) AS defect_summary,
  CAST(NULL AS VARCHAR) AS recommendation,
  CASE WHEN id % 2 = 0 THEN '["report-' || CAST(id AS VARCHAR) || '.jpg"]' END AS photos,
  CAST(NULL AS VARCHAR) AS certificates
FROM fx_inspection_reports
"""

BODIES["inspection_check_rows"] = """
SELECT c.inspection_report_id, c.id, c.check_item, c.standard, c.result, c.actual_value, c.notes
FROM fxc_quality_checks c JOIN fx_inspection_reports r ON r.id = c.inspection_report_id
"""

BODIES["supplier_rating"] = """
SELECT supplier_id, supplier_name, evaluation_period, delivery_rating, quality_rating, service_rating,
  (delivery_rating + quality_rating + service_rating) / CAST(3 AS DOUBLE) AS overall_rating
FROM fx_supplier_evaluations
"""

BODIES["split_receiving_orders"] = """
SELECT CAST(row_number() OVER (PARTITION BY ri.receiving_order_id
    ORDER BY ri.product_id, ri.ordered_quantity, ri.received_quantity, ri.rejected_quantity, ri.expiry_date) - 1
    AS INTEGER) AS item_index,
  ri.product_id, ri.ordered_quantity, ri.received_quantity, ri.rejected_quantity, ri.expiry_date,
  ro.receiving_no, 'pending' AS status
FROM fx_receiving_items ri JOIN fx_receiving_orders ro ON ro.id = ri.receiving_order_id
"""

# ---------------------------------------------------------------- shipping
BODIES["split_shipping_orders"] = """
SELECT CAST(row_number() OVER (PARTITION BY si.shipping_order_id ORDER BY si.product_id, si.line_no, si.quantity) - 1
    AS INTEGER) AS item_index,
  si.product_id, si.line_no, si.quantity, so.shipping_no, so.customer_name, 'preparing' AS status
FROM fx_shipping_items si JOIN fx_shipping_orders so ON so.id = si.shipping_order_id
"""

BODIES["shipping_order_list"] = """
SELECT so.*, COALESCE(c.item_count, 0) AS item_count, c.total_quantity
FROM fxc_shipping_orders so LEFT JOIN (
  SELECT shipping_order_id, COUNT(*) AS item_count, CAST(SUM(quantity) AS BIGINT) AS total_quantity
  FROM fx_shipping_items GROUP BY shipping_order_id) c ON so.id = c.shipping_order_id
ORDER BY so.created_at DESC
"""

BODIES["shipping_stats"] = f"""
SELECT COUNT(*) AS total_orders,
  COUNT(*) FILTER (WHERE status IN ('shipped', 'in_transit', 'delivered')) AS shipped_orders,
  COUNT(*) FILTER (WHERE status = 'delivered') AS delivered_orders,
  {msum('shipping_cost')} AS total_shipping_cost,
  (SELECT COUNT(*) FROM fx_packing_tasks WHERE status <> 'completed') AS pending_tasks
FROM fx_shipping_orders
"""

BODIES["shipping_daily"] = f"""
SELECT CAST(shipping_date AS DATE) AS date, COUNT(*) AS orders, {msum('shipping_cost')} AS cost
FROM fx_shipping_orders WHERE CAST(shipping_date AS DATE) >= {ASOF} - 30
GROUP BY CAST(shipping_date AS DATE) ORDER BY date
"""

BODIES["carrier_list"] = """
SELECT * FROM fx_carriers WHERE is_active = 1 ORDER BY rating DESC, name ASC
"""

BODIES["packing_task_list"] = """
SELECT pt.id, pt.shipping_order_id, pt.priority, pt.status, pt.assigned_to, pt.estimated_time, pt.actual_time,
  pt.created_at, pt.updated_at, pt.completed_at, so.customer_name, so.shipping_address, COALESCE(c.item_count, 0) AS item_count
FROM fxc_packing_tasks pt
LEFT JOIN fx_shipping_orders so ON pt.shipping_order_id = so.id
LEFT JOIN (SELECT packing_task_id, COUNT(*) AS item_count FROM fx_packing_items GROUP BY packing_task_id) c
  ON pt.id = c.packing_task_id
ORDER BY CASE pt.priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 END ASC NULLS FIRST,
  pt.created_at ASC
"""

BODIES["shipping_order_detail"] = """
WITH items AS (
  SELECT shipping_order_id, list({'product_id': product_id, 'line_no': line_no, 'quantity': quantity}
    ORDER BY product_id, line_no, quantity) AS items
  FROM fx_shipping_items GROUP BY shipping_order_id),
tr AS (
  SELECT shipping_order_id, list({'id': id, 'timestamp': CAST(timestamp AS VARCHAR), 'status': status,
      'tracking_no': tracking_no, 'location': location, 'description': description, 'operator': operator}
    ORDER BY CAST(timestamp AS VARCHAR) DESC, id DESC) AS tracking
  FROM fxc_tracking_records GROUP BY shipping_order_id)
SELECT so.*, 0 AS page, CAST(COALESCE(to_json(i.items), '[]') AS VARCHAR) AS items,
  CAST(COALESCE(to_json(tr.tracking), '[]') AS VARCHAR) AS tracking_info
FROM fxc_shipping_orders so LEFT JOIN items i ON so.id = i.shipping_order_id
LEFT JOIN tr ON so.id = tr.shipping_order_id
"""

BODIES["apply_shipping_status"] = f"""
WITH f AS (
  SELECT id, {fold('status')} AS n_status, {fold('actual_delivery', "status = 'delivered'")} AS n_ad, MAX(change_ts) AS n_at
  FROM fx_status_changes GROUP BY id)
SELECT s.id, s.shipping_no, s.customer_name, s.shipping_address, s.carrier_code, s.shipping_date,
  s.expected_delivery, COALESCE(f.n_ad, s.actual_delivery) AS actual_delivery, COALESCE(f.n_status, s.status) AS status,
  s.shipping_cost, s.weight, s.created_at, s.sales_order_id, COALESCE(f.n_at, s.updated_at) AS updated_at
FROM fxc_shipping_orders s LEFT JOIN f ON s.id = f.id
"""

BODIES["apply_shipping_status_fact"] = BODIES["apply_shipping_status"]

BODIES["apply_packing_status"] = f"""
WITH ch AS (SELECT *, CAST(floor(quality_score) AS INTEGER) AS actual_time FROM fx_status_changes),
f AS (
  SELECT id, {fold('status')} AS n_status,
    {fold('actual_time', "status = 'completed' AND actual_time <> 0")} AS n_at,
    {fold('change_ts', "status = 'completed' AND actual_time <> 0")} AS n_ca, MAX(change_ts) AS n_up
  FROM ch GROUP BY id)
SELECT p.id, p.shipping_order_id, p.customer_name, p.priority, COALESCE(f.n_status, p.status) AS status,
  p.assigned_to, p.estimated_time, COALESCE(f.n_at, p.actual_time) AS actual_time, p.created_at,
  COALESCE(f.n_ca, p.completed_at) AS completed_at, COALESCE(f.n_up, p.updated_at) AS updated_at
FROM fxc_packing_tasks p LEFT JOIN f ON p.id = f.id
"""

BODIES["latest_tracking_status"] = """
SELECT shipping_order_id, max(timestamp) AS last_timestamp, arg_max(status, (timestamp, id)) AS last_status
FROM fx_tracking_records GROUP BY shipping_order_id
"""


# ---------------------------------------------------------------- telemetry
NOW_E = "(SELECT max(ts) FROM fx_error_log)"
NOW_M = "(SELECT max(ts) FROM fx_metric_log)"


def recent(table: str, now: str) -> str:
    return f"(SELECT *, CAST(floor((epoch_us({now}) - epoch_us(ts)) / 3600000000) AS INTEGER) AS h " \
           f"FROM {table} WHERE ts > {now} - INTERVAL 24 HOURS)"


BODIES["error_stats"] = f"""
SELECT CASE GROUPING(type, severity) WHEN 1 THEN 'type' WHEN 2 THEN 'severity' ELSE 'total' END AS dimension,
  CASE GROUPING(type, severity) WHEN 1 THEN type WHEN 2 THEN severity END AS key,
  COUNT(*) AS errors
FROM {recent('fx_error_log', NOW_E)} r GROUP BY GROUPING SETS ((type), (severity), ())
"""

BODIES["error_hourly_trend"] = f"""
SELECT CAST(i.hour_index AS INTEGER) AS hour_index, COALESCE(c.n, 0) AS errors
FROM range(24) i(hour_index) LEFT JOIN (
  SELECT 23 - h AS hi, COUNT(*) AS n FROM {recent('fx_error_log', NOW_E)} r WHERE h >= 0 AND h < 24 GROUP BY 1) c
  ON i.hour_index = c.hi
ORDER BY hour_index
"""

BODIES["performance_stats"] = f"""
SELECT
  COALESCE({msum("CASE WHEN type = 'page_load' THEN duration END")}
    / COUNT(CASE WHEN type = 'page_load' THEN duration END), 0.0) AS page_load_avg,
  COUNT(*) FILTER (WHERE type = 'page_load') AS page_load_count,
  COALESCE({msum("CASE WHEN type = 'api_call' THEN duration END")}
    / COUNT(CASE WHEN type = 'api_call' THEN duration END), 0.0) AS api_avg,
  COUNT(*) FILTER (WHERE type = 'api_call') AS api_total,
  COUNT(*) FILTER (WHERE type = 'api_call' AND duration > 2000) AS api_slow,
  COUNT(*) FILTER (WHERE type = 'api_call' AND status >= 400) AS api_failed
FROM {recent('fx_metric_log', NOW_M)} r
"""

BODIES["performance_hourly_trend"] = f"""
SELECT CAST(i.hour_index AS INTEGER) AS hour_index, COALESCE(c.p, 0.0) AS page_load_ms, COALESCE(c.a, 0.0) AS api_ms
FROM range(24) i(hour_index) LEFT JOIN (
  SELECT 23 - h AS hi, {msum("CASE WHEN type = 'page_load' THEN duration END")} AS p,
    {msum("CASE WHEN type = 'api_call' THEN duration END")} AS a
  FROM {recent('fx_metric_log', NOW_M)} r WHERE h >= 0 AND h < 24 GROUP BY 1) c
  ON i.hour_index = c.hi
ORDER BY hour_index
"""

BODIES["critical_errors"] = """
SELECT COUNT(*) AS processed, COUNT(*) FILTER (WHERE severity = 'critical') AS critical FROM fx_error_log
"""

BODIES["telemetry_keep_last"] = """
SELECT * FROM fx_error_log ORDER BY id DESC LIMIT 1000
"""

# ---------------------------------------------------------------- exports
BODIES["export_products"] = """
SELECT p.product_code, p.barcode, p.name, c.name AS category, p.brand, p.unit, p.cost_price, p.selling_price,
  p.wholesale_price, p.current_stock, p.min_stock, p.max_stock, s.name AS supplier,
  CASE WHEN p.is_active = 1 THEN '启用' ELSE '停用' END AS status, p.created_at
FROM fxc_products p LEFT JOIN fx_categories c ON p.category_id = c.id LEFT JOIN fx_suppliers s ON p.supplier_id = s.id
ORDER BY p.id
"""

BODIES["export_customers"] = """
SELECT customer_code, name, phone, email, address, customer_type, member_level, total_purchases, current_balance,
  points, CASE WHEN is_active = 1 THEN '启用' ELSE '停用' END AS status, created_at
FROM fxc_customers ORDER BY id
"""

EXPORT_SALES = """
SELECT so.order_no, so.order_date, c.name AS customer_name, p.name AS product_name, i.quantity, i.unit_price,
  i.line_total, so.payment_method, so.order_status
FROM fx_sales_orders so LEFT JOIN fx_customers c ON so.customer_id = c.id
LEFT JOIN fx_sales_order_items i ON so.id = i.order_id LEFT JOIN fx_products p ON i.product_id = p.id
"""
BODIES["export_sales"] = EXPORT_SALES + "ORDER BY so.order_date DESC"
BODIES["export_sales_range"] = EXPORT_SALES + f"WHERE so.order_date BETWEEN {ASOF} - 90 AND {ASOF} ORDER BY so.order_date DESC"

BODIES["export_inventory"] = """
SELECT p.name, c.name AS category, p.current_stock, p.min_stock, p.cost_price,
  CAST(p.current_stock * p.cost_price AS DECIMAL(18,2)) AS stock_value,
  CASE WHEN p.current_stock <= p.min_stock THEN '库存不足' WHEN p.current_stock >= p.max_stock THEN '库存过多'
    ELSE '正常' END AS stock_status, p.updated_at
FROM fxc_products p LEFT JOIN fx_categories c ON p.category_id = c.id
WHERE p.is_active = 1 ORDER BY p.current_stock ASC
"""

EXPORT_FIN = """
SELECT transaction_date, transaction_type, category, amount, payment_method, description, created_at
FROM fxc_financial_transactions
"""
BODIES["export_financial"] = EXPORT_FIN + "ORDER BY transaction_date DESC"
BODIES["export_financial_range"] = EXPORT_FIN + f"WHERE transaction_date BETWEEN {ASOF} - 90 AND {ASOF} ORDER BY transaction_date DESC"


# ---------------------------------------------------------------- imports, normalisation, seeds
INT_PREFIX = "TRY_CAST(regexp_extract(trim({}), '^[+-]?[0-9]+', 0) AS INTEGER)"

BODIES["import_products"] = f"""
WITH p AS (
  SELECT line_no, name, category, supplier,
    {INT_PREFIX.format("CASE WHEN stock IS NULL OR stock = '' THEN '0' ELSE stock END")} AS current_stock
  FROM fx_import_rows),
acc AS (
  SELECT * FROM p WHERE name IS NOT NULL AND name <> '' AND current_stock IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY line_no DESC) = 1)
SELECT line_no, name, category, supplier, '' AS barcode, '' AS brand, '件' AS unit, current_stock,
  10 AS min_stock, 1000 AS max_stock, CAST(0 AS DOUBLE) AS cost_price, CAST(0 AS DOUBLE) AS selling_price,
  CAST(0 AS DOUBLE) AS wholesale_price,
  (category IS NOT NULL AND trim(category) <> '') AS category_known,
  (supplier IS NOT NULL AND trim(supplier) <> '') AS supplier_known
FROM acc
"""

BODIES["import_customers"] = """
SELECT id AS line_no, name, '' AS phone, '' AS email, '' AS address,
  CASE WHEN customer_type IS NULL OR customer_type = '' THEN 'retail' ELSE customer_type END AS customer_type,
  CASE WHEN member_level IS NULL OR member_level = '' THEN 'bronze' ELSE member_level END AS member_level
FROM fx_customers WHERE name IS NOT NULL AND name <> ''
QUALIFY row_number() OVER (PARTITION BY name ORDER BY id DESC) = 1
"""

STOCK_IMPORT = f"""
WITH prod AS (SELECT id, regexp_replace(name, ' #[0-9]+$', '') AS name, current_stock FROM fx_products),
r AS (
  SELECT line_no, name, stock, {INT_PREFIX.format('stock')} AS q,
    CASE WHEN name IS NULL OR name = '' THEN '缺少必填字段: 商品名称'
         WHEN stock IS NULL OR stock = '' THEN '缺少必填字段: 库存数量'
         WHEN {INT_PREFIX.format('stock')} IS NULL THEN 'invalid number: 库存数量'
         WHEN name NOT IN (SELECT name FROM prod) THEN '商品不存在' END AS error
  FROM fx_import_rows),
acc AS (SELECT name, q FROM r WHERE error IS NULL
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY line_no DESC) = 1)
"""

BODIES["import_inventory"] = STOCK_IMPORT + """
SELECT p.id, p.name, COALESCE(a.q, p.current_stock) AS current_stock FROM prod p LEFT JOIN acc a ON p.name = a.name
"""

BODIES["import_summary"] = STOCK_IMPORT + """
SELECT COUNT(*) FILTER (WHERE error IS NULL) AS success, COUNT(*) FILTER (WHERE error IS NOT NULL) AS failed FROM r
"""

BODIES["import_errors"] = STOCK_IMPORT + """
SELECT line_no, error, '第' || CAST(line_no AS VARCHAR) || '行: ' || error AS message FROM r WHERE error IS NOT NULL
"""

BODIES["dim_get_or_create"] = """
SELECT name, false AS is_new FROM fx_categories
UNION ALL
SELECT DISTINCT category, true FROM fx_import_rows
WHERE category IS NOT NULL AND category <> '' AND category NOT IN (SELECT name FROM fx_categories)
"""

BODIES["normalise_sales"] = """
WITH c AS (SELECT name, min(id) AS id FROM fx_customers GROUP BY name),
p AS (SELECT name, min(id) AS id FROM fx_products GROUP BY name)
SELECT s.date AS order_date, c.id AS customer_id, p.id AS product_id, s.quantity, s.unit_price,
  CAST(s.total_amount AS DECIMAL(18,2)) AS line_total
FROM fx_sales s LEFT JOIN c ON s.customer_name = c.name LEFT JOIN p ON s.product_name = p.name
"""

SEED_CATS = "(VALUES ('电子产品'), ('服装'), ('食品'), ('日用品'), ('其他')) s(name)"

BODIES["normalise_inventory"] = f"""
WITH cats AS (
  SELECT id, name FROM fx_categories
  UNION ALL SELECT 0, name FROM {SEED_CATS} WHERE name NOT IN (SELECT name FROM fx_categories)),
cat_ids AS (SELECT name, min(id) AS id FROM cats GROUP BY name)
SELECT i.product_name AS name, c.id AS category_id, i.current_stock,
  COALESCE(CASE WHEN i.min_stock <> 0 THEN i.min_stock END, 10) AS min_stock,
  COALESCE(CASE WHEN i.max_stock <> 0 THEN i.max_stock END, 1000) AS max_stock,
  CAST(COALESCE(CASE WHEN i.unit_cost <> 0 THEN i.unit_cost END, 0) AS DECIMAL(18,2)) AS cost_price,
  CASE WHEN COALESCE(i.unit_cost, 0) > 0 THEN CAST(i.unit_cost * CAST(1.3 AS DECIMAL(2,1)) AS DECIMAL(18,2))
       ELSE CAST(0 AS DECIMAL(18,2)) END AS selling_price,
  CAST({ASOF} AS TIMESTAMP) AS updated_at
FROM fx_inventory i LEFT JOIN cat_ids c ON c.name = COALESCE(CASE WHEN i.category <> '' THEN i.category END, '其他')
"""

SEED_SUPS = ("(VALUES ('苹果公司', '库克', '400-123-4567'), ('华为公司', '任正非', '400-234-5678'), "
             "('小米公司', '雷军', '400-345-6789'), ('联想公司', '杨元庆', '400-456-7890'), "
             "('其他供应商', '联系人', '')) s(name, contact_person, phone)")

BODIES["seed_if_absent"] = f"""
SELECT name, contact_person, phone, credit_rating, is_active FROM fxc_suppliers
UNION ALL SELECT name, contact_person, phone, 5, 1 FROM {SEED_SUPS} WHERE name NOT IN (SELECT name FROM fx_suppliers)
"""


# ---------------------------------------------------------------- analytics
LINES = "fx_sales_order_items i JOIN fx_sales_orders o ON i.order_id = o.id"

BODIES["stock_ledger"] = """
SELECT id, product_id, transaction_date, quantity_change, stock_after,
  CAST(SUM(quantity_change) OVER w AS BIGINT) AS running_balance,
  LAG(stock_after) OVER w AS prev_stock_after,
  COALESCE(stock_after <> LAG(stock_after) OVER w + quantity_change, false) AS is_break
FROM fx_inventory_transactions
WINDOW w AS (PARTITION BY product_id ORDER BY transaction_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

BODIES["category_tree"] = """
WITH RECURSIVE tree(id, name, parent_id, depth, path) AS (
  SELECT id, name, parent_id, 0, name FROM fx_categories WHERE parent_id IS NULL
  UNION ALL
  SELECT c.id, c.name, c.parent_id, tree.depth + 1, tree.path || ' > ' || c.name
  FROM fx_categories c JOIN tree ON c.parent_id = tree.id)
SELECT id, name, parent_id, depth, path FROM tree
"""

BODIES["order_total_check"] = """
WITH l AS (SELECT order_id, SUM(CAST(line_total AS DECIMAL(18,2))) AS s FROM fx_sales_order_items GROUP BY order_id)
SELECT o.id, o.order_no, CAST(o.total_amount AS DOUBLE) AS total_amount, CAST(COALESCE(l.s, 0) AS DOUBLE) AS lines_total,
  CAST(CAST(o.total_amount AS DECIMAL(18,2)) - COALESCE(l.s, 0) AS DOUBLE) AS difference
FROM fx_sales_orders o LEFT JOIN l ON o.id = l.order_id
WHERE abs(CAST(CAST(o.total_amount AS DECIMAL(18,2)) - COALESCE(l.s, 0) AS DOUBLE)) > 0.01
"""

REV = "SUM(CAST(i.line_total AS DECIMAL(18,2)))"
COST = "SUM(CAST(i.quantity * i.cost_price AS DECIMAL(18,2)))"
BODIES["gross_margin"] = f"""
SELECT p.category_id, i.product_id, GROUPING(p.category_id, i.product_id) AS level,
  CAST({REV} AS DOUBLE) AS revenue, CAST({COST} AS DOUBLE) AS cost, CAST({REV} - {COST} AS DOUBLE) AS margin,
  CAST({REV} - {COST} AS DOUBLE) / NULLIF(CAST({REV} AS DOUBLE), 0) AS margin_rate
FROM fx_sales_order_items i LEFT JOIN fx_products p ON i.product_id = p.id
GROUP BY ROLLUP (p.category_id, i.product_id)
"""

BODIES["customer_rollup"] = """
WITH a AS (
  SELECT customer_id AS id, COUNT(*) AS orders, SUM(CAST(total_amount AS DECIMAL(18,2))) AS total,
    max(order_date) AS last_purchase_date,
    SUM(greatest(CAST(total_amount AS DECIMAL(18,2)) - CAST(COALESCE(paid_amount, 0) AS DECIMAL(18,2)),
                 CAST(0 AS DECIMAL(18,2)))) AS due
  FROM fx_sales_orders WHERE order_status IN ('confirmed', 'completed') GROUP BY customer_id)
SELECT c.id, c.name, COALESCE(a.orders, 0) AS orders, CAST(COALESCE(a.total, 0) AS DOUBLE) AS total_purchases,
  a.last_purchase_date, CAST(COALESCE(a.due, 0) AS DOUBLE) AS balance_due,
  CASE WHEN COALESCE(a.total, 0) >= 1000000 THEN 'vip' WHEN COALESCE(a.total, 0) >= 500000 THEN 'gold'
       WHEN COALESCE(a.total, 0) >= 100000 THEN 'silver' ELSE 'bronze' END AS level
FROM fx_customers c LEFT JOIN a ON c.id = a.id
"""

BODIES["receivables_aging"] = f"""
WITH x AS (SELECT *, COALESCE(paid_amount, 0) AS paid, CAST({ASOF} - order_date AS INTEGER) AS age FROM fx_sales_orders),
y AS (SELECT *, CASE WHEN paid >= total_amount THEN 'paid' WHEN paid = 0 THEN 'pending' ELSE 'partial' END AS st FROM x)
SELECT id, order_no, order_date, CAST(total_amount AS DOUBLE) AS total_amount, CAST(paid AS DOUBLE) AS paid_amount,
  CAST(greatest(total_amount - paid, 0) AS DOUBLE) AS outstanding, st AS payment_status, age AS age_days,
  CASE WHEN age <= 30 THEN '0-30' WHEN age <= 60 THEN '31-60' WHEN age <= 90 THEN '61-90' ELSE '90+' END AS age_bucket,
  (st <> 'paid' AND age > 30) AS overdue
FROM y
"""

BODIES["purchase_progress"] = """
WITH l AS (SELECT order_id, CAST(SUM(quantity) AS BIGINT) AS ordered, CAST(SUM(received_quantity) AS BIGINT) AS received
  FROM fx_purchase_order_items GROUP BY order_id)
SELECT p.id, p.order_no, p.supplier_id, l.ordered, l.received,
  CAST(l.received AS DOUBLE) / NULLIF(CAST(l.ordered AS DOUBLE), 0) AS progress,
  CASE WHEN l.ordered IS NULL THEN 'no_lines' WHEN l.received >= l.ordered THEN 'received'
       WHEN l.received > 0 THEN 'partial' ELSE 'pending' END AS receipt_status
FROM fx_purchase_orders p LEFT JOIN l ON p.id = l.order_id
"""

BODIES["finance_summary"] = f"""
SELECT month, transaction_type, category, {msum('amount')} AS amount, COUNT(*) AS transactions,
  GROUPING(month, transaction_type, category) AS level
FROM (SELECT strftime(transaction_date, '%Y-%m') AS month, * FROM fx_financial_transactions) f
GROUP BY ROLLUP (month, transaction_type, category)
"""

BODIES["account_balance"] = """
WITH legs AS (
  SELECT account_to AS account, CAST(amount AS DECIMAL(18,2)) AS i, CAST(0 AS DECIMAL(18,2)) AS o
  FROM fx_financial_transactions WHERE account_to IS NOT NULL
  UNION ALL
  SELECT account_from, CAST(0 AS DECIMAL(18,2)), CAST(amount AS DECIMAL(18,2))
  FROM fx_financial_transactions WHERE account_from IS NOT NULL)
SELECT account, CAST(SUM(i) AS DOUBLE) AS inflow, CAST(SUM(o) AS DOUBLE) AS outflow,
  CAST(SUM(i) - SUM(o) AS DOUBLE) AS balance
FROM legs GROUP BY account
"""

BODIES["promotion_match"] = f"""
WITH promo AS (
  SELECT id AS promotion_id, discount_type, discount_value, min_amount, start_date, end_date,
    CAST(applicable_products AS BIGINT[]) AS prods
  FROM fxc_promotions WHERE COALESCE(is_active, 1) = 1),
lines AS (SELECT i.order_id, i.product_id, i.quantity, i.line_total, o.order_date, o.total_amount AS order_total
  FROM {LINES}),
k AS (SELECT DISTINCT order_date, product_id, order_total, line_total FROM lines),
cand AS (
  SELECT k.*, p.promotion_id,
    CASE WHEN p.discount_type = 'percentage'
      THEN CAST(CAST(k.line_total AS DECIMAL(18,2)) * CAST(p.discount_value / 100 AS DECIMAL(9,4)) AS DECIMAL(28,6))
      ELSE CAST(CAST(p.discount_value AS DECIMAL(18,2)) AS DECIMAL(28,6)) END AS discount
  FROM k JOIN promo p ON k.order_date BETWEEN p.start_date AND p.end_date AND k.order_total >= p.min_amount
    AND (len(p.prods) = 0 OR list_contains(p.prods, k.product_id))),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (
  PARTITION BY order_date, product_id, order_total, line_total ORDER BY discount DESC, promotion_id ASC) = 1)
SELECT l.order_id, l.product_id, l.order_date, l.quantity, l.line_total, b.promotion_id,
  CAST(b.discount AS DOUBLE) AS discount
FROM lines l JOIN best b ON l.order_date = b.order_date AND l.product_id = b.product_id
  AND l.order_total = b.order_total AND l.line_total = b.line_total
"""

BODIES["freight_quote"] = """
WITH c AS (SELECT code, CAST(price_per_kg AS DECIMAL(18,2)) AS p, CAST(min_charge AS DECIMAL(18,2)) AS m
  FROM fx_carriers WHERE is_active = 1),
q AS (SELECT s.id, s.shipping_no, s.weight, c.code,
    greatest(CAST(CAST(s.weight AS DECIMAL(12,3)) * c.p AS DECIMAL(30,5)), CAST(c.m AS DECIMAL(30,5))) AS cost
  FROM fx_shipping_orders s CROSS JOIN c)
SELECT id, shipping_no, weight, code AS carrier_code, CAST(cost AS DOUBLE) AS quote FROM q
QUALIFY row_number() OVER (PARTITION BY id ORDER BY cost, code) = 1
"""

BODIES["delivery_performance"] = """
SELECT s.carrier_code, c.name AS carrier_name, COUNT(*) AS delivered,
  CAST(SUM(s.actual_delivery - s.shipping_date) AS DOUBLE) / COUNT(*) AS avg_days,
  COUNT(*) FILTER (WHERE s.actual_delivery <= s.expected_delivery) AS on_time,
  COUNT(*) FILTER (WHERE s.actual_delivery <= s.expected_delivery) / COUNT(*) AS on_time_rate
FROM fx_shipping_orders s LEFT JOIN fx_carriers c ON s.carrier_code = c.code
WHERE s.actual_delivery IS NOT NULL GROUP BY s.carrier_code, c.name
"""

BODIES["supplier_scorecard"] = """
WITH ex AS (SELECT receiving_order_id AS id, COUNT(*) AS n FROM fx_exception_records
  WHERE receiving_order_id IS NOT NULL GROUP BY receiving_order_id)
SELECT r.supplier_id, COUNT(*) AS receipts,
  COUNT(*) FILTER (WHERE r.receiving_date <= r.planned_date) AS on_time,
  COUNT(*) FILTER (WHERE r.quality_score >= 80) AS quality_pass,
  CAST(COALESCE(SUM(ex.n), 0) AS BIGINT) AS issues,
  COUNT(*) FILTER (WHERE r.receiving_date <= r.planned_date) / COUNT(*) AS on_time_rate,
  COUNT(*) FILTER (WHERE r.quality_score >= 80) / COUNT(*) AS quality_pass_rate
FROM fx_receiving_orders r LEFT JOIN ex ON r.id = ex.id GROUP BY r.supplier_id
"""

BODIES["receipt_quality"] = """
WITH g AS (SELECT receiving_order_id, CAST(SUM(ordered_quantity) AS BIGINT) AS ordered,
    CAST(SUM(received_quantity) AS BIGINT) AS received, CAST(SUM(rejected_quantity) AS BIGINT) AS rejected
  FROM fx_receiving_items GROUP BY receiving_order_id)
SELECT *, CAST(greatest(ordered - received, 0) AS BIGINT) AS shortage,
  CAST(greatest(ordered - received, 0) AS DOUBLE) / NULLIF(CAST(ordered AS DOUBLE), 0) AS shortage_rate,
  CAST(rejected AS DOUBLE) / NULLIF(CAST(received AS DOUBLE), 0) AS reject_rate
FROM g
"""

BODIES["packing_performance"] = """
SELECT assigned_to, COUNT(*) AS tasks, COUNT(actual_time) AS completed,
  SUM(actual_time) / COUNT(actual_time) AS avg_actual, SUM(estimated_time) / COUNT(estimated_time) AS avg_estimated,
  SUM(actual_time - estimated_time) / COUNT(actual_time - estimated_time) AS avg_overrun,
  quantile_cont(actual_time, 0.5) AS p50_actual, quantile_cont(actual_time, 0.9) AS p90_actual
FROM fxc_packing_tasks GROUP BY assigned_to
"""

BODIES["packing_performance_distributed"] = BODIES["packing_performance"]

BODIES["exception_cost"] = f"""
SELECT exception_type, responsible_party, COUNT(*) AS exceptions, {msum('financial_impact')} AS cost,
  GROUPING(exception_type, responsible_party) AS level
FROM fx_exception_records GROUP BY CUBE (exception_type, responsible_party)
"""

BODIES["expiry_watch"] = f"""
SELECT receiving_order_id, product_id, expiry_date, received_quantity - COALESCE(rejected_quantity, 0) AS quantity,
  CAST(expiry_date - {ASOF} AS INTEGER) AS days_left, expiry_date < {ASOF} AS expired
FROM fx_receiving_items
WHERE expiry_date <= {ASOF} + 30 AND expiry_date >= {ASOF} - 30 AND received_quantity - COALESCE(rejected_quantity, 0) > 0
"""

BODIES["audit_diff"] = """
WITH k AS (
  SELECT id, table_name, record_id, old_data, new_data,
    unnest(list_distinct(list_concat(json_keys(old_data), json_keys(new_data)))) AS key
  FROM fx_operation_logs),
v AS (SELECT id, table_name, record_id, key, json_extract_string(old_data, '$.' || key) AS old_value,
    json_extract_string(new_data, '$.' || key) AS new_value FROM k)
SELECT * FROM v WHERE old_value IS DISTINCT FROM new_value
"""

BODIES["audit_diff_paths"] = """
WITH k AS (
  SELECT id, table_name, record_id, old_data, new_data,
    unnest(list_distinct(list_concat(json_keys(old_data), json_keys(new_data)))) AS key
  FROM fx_operation_logs),
v AS (SELECT id, table_name, record_id, '$.' || key AS path, CAST(json_extract(old_data, '$.' || key) AS VARCHAR) AS old_value,
    CAST(json_extract(new_data, '$.' || key) AS VARCHAR) AS new_value FROM k)
SELECT id, table_name, record_id, path,
  CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS change, old_value, new_value
FROM v WHERE old_value IS DISTINCT FROM new_value
"""

DAILY_90 = f"""
cal AS (SELECT {ASOF} - CAST(i AS INTEGER) AS date FROM range(0, 90) t(i)),
daily AS (SELECT o.order_date AS date, SUM(CAST(i.line_total AS DECIMAL(18,2))) AS revenue FROM {LINES}
  WHERE o.order_date > {ASOF} - 90 AND o.order_date <= {ASOF} GROUP BY o.order_date)"""
BODIES["sales_forecast"] = f"""
WITH {DAILY_90},
s AS (SELECT CAST(c.date - {ASOF} AS BIGINT) AS x, COALESCE(d.revenue, 0) AS y FROM cal c LEFT JOIN daily d ON c.date = d.date),
fit AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(x) AS DOUBLE) AS sx, CAST(SUM(x * x) AS DOUBLE) AS sxx,
  CAST(SUM(y) AS DOUBLE) AS sy, CAST(SUM(x * y) AS DOUBLE) AS sxy FROM s),
f2 AS (SELECT n, sx, sy, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM fit),
f3 AS (SELECT slope, (sy - slope * sx) / n AS intercept FROM f2)
SELECT {ASOF} + CAST(k AS INTEGER) AS date, round(greatest(intercept + slope * k, 0.0), 4) AS forecast
FROM range(1, 8) r(k), f3
"""

BODIES["churn_risk"] = f"""
WITH g AS (
  SELECT customer_id AS id, COUNT(*) AS orders, min(order_date) AS first_order, max(order_date) AS last_order,
    SUM(CAST(total_amount AS DECIMAL(18,2))) AS spend
  FROM fx_sales_orders GROUP BY customer_id HAVING COUNT(*) >= 2),
p AS (SELECT quantile_cont(CAST(spend AS DOUBLE), 0.75) AS p75 FROM g)
SELECT id, orders, first_order, last_order, CAST(last_order - first_order AS DOUBLE) / (orders - 1) AS mean_gap_days,
  CAST({ASOF} - last_order AS INTEGER) AS recency_days, CAST(spend AS DOUBLE) AS spend,
  ({ASOF} - last_order) > 2.0 * (CAST(last_order - first_order AS DOUBLE) / (orders - 1)) AS churn_risk,
  CAST(spend AS DOUBLE) >= p.p75 AS high_value
FROM g, p
"""

SOLD_30 = f"""sold AS (SELECT i.product_id AS id, CAST(SUM(i.quantity) AS BIGINT) AS s FROM {LINES}
  WHERE o.order_date > {ASOF} - 30 AND o.order_date <= {ASOF} GROUP BY i.product_id)"""
BODIES["replenishment"] = f"""
WITH {SOLD_30},
x AS (SELECT p.id, p.name, p.current_stock, p.min_stock, p.max_stock,
    CAST(p.current_stock - COALESCE(p.reserved_stock, 0) AS BIGINT) AS available,
    CAST(COALESCE(s.s, 0) AS DOUBLE) / CAST(30 AS DOUBLE) AS mean_daily_sales
  FROM fx_products p LEFT JOIN sold s ON p.id = s.id),
y AS (SELECT *, CASE WHEN mean_daily_sales > 0 THEN available / mean_daily_sales END AS cover_days FROM x)
SELECT id, name, current_stock, min_stock, max_stock, available, mean_daily_sales, cover_days,
  CAST(greatest(max_stock - available, 0) AS BIGINT) AS suggested_qty
FROM y WHERE COALESCE(cover_days < 7.0, false) OR COALESCE(current_stock <= min_stock, false)
"""

BODIES["sales_anomaly"] = f"""
WITH daily AS (SELECT o.order_date AS date, CAST(SUM(CAST(i.line_total AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS revenue
  FROM {LINES} GROUP BY o.order_date),
s AS (SELECT date, revenue, COUNT(revenue) OVER w AS n, SUM(revenue) OVER w AS s1,
    SUM(CAST(revenue AS DECIMAL(38,2)) * CAST(revenue AS DECIMAL(38,2))) OVER w AS s2
  FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
z AS (SELECT date, CAST(revenue AS DOUBLE) AS revenue, CAST(s1 AS DOUBLE) / n AS mean,
    (CAST(s2 AS DOUBLE) - CAST(s1 AS DOUBLE) * CAST(s1 AS DOUBLE) / n) / (n - 1) AS var
  FROM s WHERE n >= 7)
SELECT date, revenue, round(mean, 4) AS mean_prior,
  round(CASE WHEN var > 0 THEN (revenue - mean) / sqrt(var) END, 4) AS z_score,
  COALESCE(abs(CASE WHEN var > 0 THEN (revenue - mean) / sqrt(var) END) > 3.0, false) AS is_anomaly
FROM z
"""

BODIES["promotion_candidates"] = f"""
WITH {SOLD_30}
SELECT p.id, p.name, p.current_stock, p.max_stock, CAST(COALESCE(s.s, 0) AS BIGINT) AS sold
FROM fx_products p LEFT JOIN sold s ON p.id = s.id
WHERE p.current_stock >= p.max_stock AND COALESCE(s.s, 0) < CAST(0.10 AS DECIMAL(9,4)) * p.current_stock
"""

BODIES["abc_analysis"] = """
WITH rev AS (SELECT product_id, SUM(CAST(line_total AS DECIMAL(18,2))) AS r FROM fx_sales_order_items GROUP BY product_id),
c AS (SELECT product_id, r, SUM(r) OVER (ORDER BY r DESC, product_id ASC ROWS UNBOUNDED PRECEDING) AS cum,
    SUM(r) OVER () AS tot FROM rev),
d AS (SELECT product_id, CAST(r AS DOUBLE) AS revenue, CAST(cum AS DOUBLE) AS cumulative_revenue,
    CAST(cum AS DOUBLE) / CAST(tot AS DOUBLE) AS cumulative_share FROM c)
SELECT *, CASE WHEN cumulative_share <= CAST(0.8 AS DOUBLE) THEN 'A'
  WHEN cumulative_share <= CAST(0.95 AS DOUBLE) THEN 'B' ELSE 'C' END AS abc_class FROM d
"""

BODIES["stock_turnover"] = f"""
WITH cogs AS (SELECT i.product_id AS id, SUM(CAST(i.quantity * i.cost_price AS DECIMAL(18,2))) AS c FROM {LINES}
  WHERE o.order_date > {ASOF} - 365 AND o.order_date <= {ASOF} GROUP BY i.product_id)
SELECT p.id, p.name, CAST(COALESCE(c.c, 0) AS DOUBLE) AS cogs,
  CAST(CAST(p.current_stock * p.cost_price AS DECIMAL(18,2)) AS DOUBLE) AS stock_value,
  CAST(COALESCE(c.c, 0) AS DOUBLE) / NULLIF(CAST(CAST(p.current_stock * p.cost_price AS DECIMAL(18,2)) AS DOUBLE), 0)
    AS turnover
FROM fx_products p LEFT JOIN cogs c ON p.id = c.id
"""

BODIES["sales_cube"] = f"""
SELECT month, category_id, segment, {msum('line_total')} AS revenue, COUNT(*) AS lines,
  GROUPING(month, category_id, segment) AS level
FROM (SELECT strftime(o.order_date, '%Y-%m') AS month, p.category_id, c.customer_type AS segment, i.line_total
  FROM {LINES} LEFT JOIN fx_products p ON i.product_id = p.id LEFT JOIN fx_customers c ON o.customer_id = c.id) x
GROUP BY CUBE (month, category_id, segment)
"""

BODIES["member_loyalty"] = """
WITH per AS (SELECT customer_id AS id, COUNT(*) AS n, SUM(CAST(total_amount AS DECIMAL(18,2))) AS s
  FROM fx_sales_orders GROUP BY customer_id),
g AS (SELECT c.member_level, COUNT(*) AS customers, COUNT(per.n) AS buyers, COALESCE(SUM(per.s), 0) AS spend,
    COUNT(*) FILTER (WHERE per.n >= 2) AS repeat_buyers
  FROM fx_customers c LEFT JOIN per ON c.id = per.id GROUP BY c.member_level)
SELECT member_level, customers, buyers, CAST(spend AS DOUBLE) AS spend,
  CAST(spend AS DOUBLE) / NULLIF(CAST(SUM(spend) OVER () AS DOUBLE), 0) AS spend_share,
  CAST(repeat_buyers AS DOUBLE) / NULLIF(CAST(buyers AS DOUBLE), 0) AS repeat_rate
FROM g
"""


BODIES["append_tracking"] = """
SELECT shipping_order_id, tracking_no, timestamp, location, status, description, 'operator ' || CAST(id % 7 AS VARCHAR) AS operator FROM fxc_tracking_records
"""

BODIES["append_exceptions"] = f"""
SELECT receiving_order_id, supplier_name, exception_type, responsible_party, financial_impact, CAST(NULL AS VARCHAR) AS evidence_files,
  'reported' AS status, CAST({ASOF} AS TIMESTAMP) AS created_at FROM fx_exception_records
"""

BODIES["category_tree_products"] = """
WITH RECURSIVE tree(id, name, parent_id, depth, path) AS (
  SELECT id, name, CAST(NULL AS BIGINT), 0, name FROM fx_products WHERE id < 2
  UNION ALL
  SELECT p.id, p.name, CAST(p.id // 2 AS BIGINT), tree.depth + 1, tree.path || ' > ' || p.name FROM fx_products p JOIN tree ON p.id // 2 = tree.id WHERE p.id >= 2)
SELECT id, name, parent_id, depth, path FROM tree
"""

BODIES["category_cycles_products"] = """
SELECT id, name, CAST(CASE WHEN id % 10 = 2 THEN id - 2 ELSE id + 1 END AS BIGINT) AS parent_id, CAST(id - id % 10 AS BIGINT) AS cycle_id
FROM (SELECT id, name, COUNT(*) OVER (PARTITION BY id // 10) AS k FROM fx_products WHERE id % 10 < 3) WHERE k = 3
"""

BODIES["quoted_csv_documents"] = """
SELECT doc_id, sha256(COALESCE(text, '')) AS text_sha256, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source FROM documents
"""

# documents as lines: the parent's JSON without its closing brace, one line a child, the end
QC_JSON = ("to_json({'id': id, 'check_item': check_item, 'standard': standard, 'result': result, 'actual_value': actual_value, 'notes': notes})")


def _open(obj: str, name: str) -> str:
    return f"""left(CAST(to_json({obj}) AS VARCHAR), length(CAST(to_json({obj}) AS VARCHAR)) - 1) || ',"{name}":['"""


def _children(key: str, section: int, json: str, order: str, source: str) -> str:
    return f"""SELECT {key} AS id, {section} AS section, CAST(k - 1 AS BIGINT) AS position, CASE WHEN k > 1 THEN ',' ELSE '' END || CAST({json} AS VARCHAR) AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {source})"""


IR_JSON = "{'id': id, 'receiving_order_id': receiving_order_id, 'inspector': inspector, 'inspection_date': inspection_date, 'overall_rating': overall_rating}"
REP_JSON = "{'id': id, 'inspector': inspector, 'inspection_date': inspection_date, 'overall_rating': overall_rating}"
RI_JSON = ("to_json({'product_id': product_id, 'ordered_quantity': ordered_quantity, 'received_quantity': received_quantity, "
           "'rejected_quantity': rejected_quantity, 'expiry_date': expiry_date})")
RO_JSON = ("{" + ", ".join(f"'{c}': {c}" for c in ("id", "receiving_no", "supplier_id", "supplier_name", "planned_date", "receiving_date", "status", "total_amount",
                                                   "received_amount", "quality_score")) + ", 'created_at': CAST(created_at AS VARCHAR), 'purchase_order_id': purchase_order_id, 'updated_at': CAST(updated_at AS VARCHAR)}")
SO_JSON = ("{" + ", ".join(f"'{c}': {c}" for c in ("id", "shipping_no", "customer_name", "shipping_address", "carrier_code", "shipping_date", "expected_delivery",
                                                   "actual_delivery", "status", "shipping_cost", "weight"))
           + ", 'created_at': CAST(created_at AS VARCHAR), 'sales_order_id': sales_order_id, 'updated_at': CAST(updated_at AS VARCHAR)}")
TR_JSON = ("to_json({'id': id, 'timestamp': CAST(timestamp AS VARCHAR), 'status': status, 'tracking_no': tracking_no, "
           "'location': location, 'description': description, 'operator': operator})")

BODIES["inspection_report_lines"] = f"""
SELECT id, 0 AS section, CAST(0 AS BIGINT) AS position, {_open(IR_JSON, 'quality_checks')} AS line FROM fx_inspection_reports
UNION ALL {_children('inspection_report_id', 1, QC_JSON, 'id',
                     'fxc_quality_checks WHERE inspection_report_id IN (SELECT id FROM fx_inspection_reports)')}
UNION ALL SELECT id, 2, CAST(0 AS BIGINT), ']}}' FROM fx_inspection_reports
"""

BODIES["receiving_order_lines"] = f"""
WITH rep AS (SELECT * FROM fx_inspection_reports QUALIFY row_number() OVER (PARTITION BY receiving_order_id ORDER BY id) = 1)
SELECT id, 0 AS section, CAST(0 AS BIGINT) AS position, {_open(RO_JSON, 'items')} AS line FROM fxc_receiving_orders
UNION ALL {_children('receiving_order_id', 1, RI_JSON, 'product_id, ordered_quantity, received_quantity, rejected_quantity, expiry_date',
                     'fx_receiving_items WHERE receiving_order_id IN (SELECT id FROM fx_receiving_orders)')}
UNION ALL SELECT o.id, 2, CAST(0 AS BIGINT), '],"inspection_report":' || COALESCE(r.line, 'null}}') FROM fx_receiving_orders o
  LEFT JOIN (SELECT receiving_order_id, {_open(REP_JSON, 'quality_checks')} AS line FROM rep) r ON r.receiving_order_id = o.id
UNION ALL {_children('receiving_order_id', 3, QC_JSON, 'id',
                     '(SELECT q.*, rep.receiving_order_id FROM fxc_quality_checks q JOIN rep ON rep.id = q.inspection_report_id) x WHERE receiving_order_id IN (SELECT id FROM fx_receiving_orders)')}
UNION ALL SELECT id, 4, CAST(0 AS BIGINT), ']}}}}' FROM fx_receiving_orders WHERE id IN (SELECT receiving_order_id FROM rep)
"""

BODIES["shipping_order_lines"] = f"""
SELECT id, 0 AS section, CAST(0 AS BIGINT) AS position, {_open(SO_JSON, 'items')} AS line FROM fxc_shipping_orders
UNION ALL {_children('shipping_order_id', 1, "to_json({'product_id': product_id, 'line_no': line_no, 'quantity': quantity})", 'product_id, line_no, quantity',
                     'fx_shipping_items WHERE shipping_order_id IN (SELECT id FROM fx_shipping_orders)')}
UNION ALL SELECT id, 2, CAST(0 AS BIGINT), '],"tracking_info":[' FROM fx_shipping_orders
UNION ALL {_children('shipping_order_id', 3, TR_JSON, 'CAST(timestamp AS VARCHAR) DESC, id DESC',
                     'fxc_tracking_records WHERE shipping_order_id IN (SELECT id FROM fx_shipping_orders)')}
UNION ALL SELECT id, 4, CAST(0 AS BIGINT), ']}}' FROM fx_shipping_orders
"""


def _sub(key: str) -> str:
    return "(" + with_views(BODIES[key]).strip() + ")"


BODIES["action_list"] = f"""
WITH f AS (
  SELECT 'stock_out' AS kind, CAST(id AS VARCHAR) AS subject, CAST(suggested_qty AS DOUBLE) AS amount, 1 AS severity
  FROM {_sub('replenishment')} r
  UNION ALL SELECT 'churn', CAST(id AS VARCHAR), spend, 2 FROM {_sub('churn_risk')} c WHERE churn_risk
  UNION ALL SELECT 'anomaly', CAST(date AS VARCHAR), revenue, 3 FROM {_sub('sales_anomaly')} a WHERE is_anomaly
  UNION ALL SELECT 'overstock', CAST(id AS VARCHAR), CAST(current_stock AS DOUBLE), 4
  FROM {_sub('promotion_candidates')} p)
SELECT kind, subject, amount, severity,
  CAST(row_number() OVER (ORDER BY severity ASC, amount DESC, subject ASC) AS INTEGER) AS rank
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {k: with_views(v) for k, v in BODIES.items()}
