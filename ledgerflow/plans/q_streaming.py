"""Registered streaming queries (S1–S8): streaming runs read back, and batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.constants import SALE
from ledgerflow.operators import lifecycle as lc
from ledgerflow.operators import sales
from ledgerflow.plans.q_ingest import fingerprint_sql
from ledgerflow.plans.q_lifecycle import _DS, _DS_OUT, _ORD
from ledgerflow.plans.registry import query
from ledgerflow.sources.views import MONEY, Views, osql
from ledgerflow.streaming import jobs as sj


@query("S3", osql(f"""
SELECT CAST(CAST(date_trunc('month', transaction_date) AS DATE) AS VARCHAR) AS month, product_id,
       CAST(SUM(quantity) AS DOUBLE) AS month_quantity
FROM order_tx WHERE document_type = '{SALE}' GROUP BY 1, 2"""))
def s3_month_sales(spark, sf_dir):
    """S3: running month sales per product from the streamed order lines: totals per
    micro-batch, merged when read."""
    return sj.run_month_sales(spark, sf_dir)


def _pred(v):
    """Active repurchase predictions: every pair ever bought, expected 30 days after its
    last purchase, in the pair's largest quantity.

    Pairs hardly repeat within a partition of orders, so the lines move before they are
    counted: the table of pairs lies in other, smaller tasks than the sorts of the join."""
    t = v.order_tx().filter(F.col("document_type") == SALE).select("customer_id", "product_id", "transaction_date", "quantity")
    t = t.repartition(4 * int(v.spark.conf.get("spark.sql.shuffle.partitions")), "customer_id", "product_id")
    return t.groupBy("customer_id", "product_id").agg(
        F.date_add(F.max("transaction_date"), 30).alias("prediction_date"),
        F.max("quantity").alias("estimated_quantity")).withColumn("prediction_status", F.lit("active")).withColumn(
        "will_purchase_anything", F.col("estimated_quantity") >= 10)


_PRED_SQL = f"""pred AS (SELECT customer_id, product_id, CAST(MAX(transaction_date) + 30 AS DATE) AS prediction_date,
                 MAX(quantity) AS estimated_quantity, 'active' AS prediction_status, MAX(quantity) >= 10 AS will_purchase_anything
             FROM order_tx WHERE document_type = '{SALE}' GROUP BY 1, 2),
conf AS (SELECT o.customer_id, pm.subcategory, o.product_id, o.id,
                COALESCE(o.confirmed_at, o.updated_at, o.created_at) AS changed_at
         FROM incoming_orders o JOIN product_master pm ON o.product_id = pm.product_id
         WHERE o.status = '1' AND o.customer_id IS NOT NULL AND trim(COALESCE(pm.subcategory, '')) <> ''),
found AS (SELECT p.customer_id, p.product_id, p.prediction_date, arg_min(c.id, (c.changed_at, c.id)) AS order_id
          FROM pred p JOIN product_master pm ON p.product_id = pm.product_id
          JOIN conf c ON c.customer_id = p.customer_id AND c.subcategory = pm.subcategory
               AND p.prediction_date <= CAST(c.changed_at AS DATE)
          WHERE p.prediction_status = 'active' GROUP BY 1, 2, 3),
audit AS (SELECT c.customer_id, c.product_id, CAST(c.changed_at AS DATE) AS prediction_date, 'fulfilled' AS action_type,
                 'active' AS old_status, 'fulfilled' AS new_status, f.order_id AS related_transaction_id,
                 CAST(c.changed_at AS DATE) AS related_transaction_date, f.n AS affected_predictions
          FROM (SELECT order_id, COUNT(*) AS n FROM found GROUP BY 1) f JOIN conf c ON c.id = f.order_id)"""

_AUDIT_OUT = """customer_id, product_id, CAST(prediction_date AS VARCHAR) AS prediction_date, action_type, old_status, new_status,
       related_transaction_id, CAST(related_transaction_date AS VARCHAR) AS related_transaction_date, affected_predictions"""

_FULFILLED = """SELECT p.customer_id, p.product_id, CAST(p.prediction_date AS VARCHAR) AS prediction_date,
       CASE WHEN f.order_id IS NULL THEN p.prediction_status ELSE 'fulfilled' END AS prediction_status
FROM pred p LEFT JOIN found f USING (customer_id, product_id, prediction_date)"""


@query("S1_batch", osql(f"SELECT {_AUDIT_OUT} FROM audit", ctes=_PRED_SQL))
def s1_fulfil_batch(spark, sf_dir):
    """S1 (batch twin): audit rows of the confirmed orders that fulfilled predictions."""
    v = Views(spark, sf_dir)
    return sj.fulfil(sj.status_changes(v.incoming_orders), _pred(v), v.product_master)[1]


@query("S1_predictions", osql(_FULFILLED, ctes=_PRED_SQL))
def s1_predictions(spark, sf_dir):
    """S1 (batch twin): every prediction with its status after the confirmations."""
    v = Views(spark, sf_dir)
    updated = sj.fulfil(sj.status_changes(v.incoming_orders), _pred(v), v.product_master)[0]
    return updated.select("customer_id", "product_id", "prediction_date", "prediction_status")


@query("S1", osql(f"SELECT {_AUDIT_OUT} FROM audit", ctes=_PRED_SQL))
def s1_fulfil_stream(spark, sf_dir):
    """The same audit rows from a stream of order status changes."""
    v = Views(spark, sf_dir)
    changes = sj.status_changes(v.incoming_from(sj.stream_table(spark, sf_dir, "orders")))
    return sj.run_fulfil(spark, changes, _pred(v), v.product_master)[1]


@query("S2", osql(f"""
SELECT customer_id, CAST(MIN(t.transaction_date) AS VARCHAR) AS reactivated_date FROM (
  SELECT l.customer_id, l.last_order_date FROM (
    SELECT customer_id, MAX(transaction_date) AS last_order_date FROM order_tx
    WHERE document_type = '{SALE}' AND transaction_date <= DATE '2001-01-01' GROUP BY 1) l
  WHERE date_diff('day', l.last_order_date, DATE '2001-01-01') >= 60) i
JOIN order_tx t USING (customer_id)
WHERE t.document_type = '{SALE}' AND t.transaction_date <= DATE '2001-08-01' AND t.transaction_date > i.last_order_date
GROUP BY 1"""))
def s2_reactivate_stream(spark, sf_dir):
    """Lapsed customers (60+ days on 2001-01-01) reactivated by streamed order lines."""
    return _reactivation(spark, sf_dir)[0]


def _reactivation(spark, sf_dir):
    v = Views(spark, sf_dir)
    lapsed = lc.inactive_customers(v.order_tx(), v.customers, "2001-01-01", 60).select("customer_id", "last_order_date")
    return sj.run_reactivation(spark, sj.order_line_events(spark, sf_dir), lapsed, "2001-08-01")


@query("S2_last", osql(f"""
SELECT customer_id, CAST(MAX(transaction_date) AS VARCHAR) AS last_order_date FROM order_tx WHERE document_type = '{SALE}' GROUP BY 1"""))
def s2_last_orders(spark, sf_dir):
    """The maintained table of last order dates after the stream."""
    return _reactivation(spark, sf_dir)[1]


@query("S4", osql("""
SELECT product_id, warehouse_id, CAST(total_quantity - borrowed_out + borrowed_in AS DOUBLE) AS stock_quantity FROM inventory"""))
def s4_stock_on_write(spark, sf_dir):
    """Stock computed on every streamed stock row (stateless)."""
    p = sj.stream_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    inv = p.select(k.alias("product_id"), (k % 3).alias("warehouse_id"),
                   (F.col("p_size") * 20).cast(MONEY).alias("total_quantity"), (k % 7).cast(MONEY).alias("borrowed_out"),
                   (k % 3).cast(MONEY).alias("borrowed_in"))
    out, ckpt = sj.run_dir(spark, "stock")
    sj.run_available(sj.stock_on_write(inv).select("product_id", "warehouse_id", "stock_quantity"), out, ckpt)
    return sj.read_output(spark, out).drop("batch_id")


@query("S5", osql(f"SELECT {_DS_OUT} FROM ds", ctes=_ORD + "," + _DS))
def s5_delivery_stream(spark, sf_dir):
    """Delivery rows from a stream of orders (stream-static joins)."""
    v = Views(spark, sf_dir)
    orders = sj.stream_table(spark, sf_dir, "orders")
    out, ckpt = sj.run_dir(spark, "delivery")
    sj.run_available(sj.delivery_stream(v.incoming_from(orders), v.customers, v.product_master), out, ckpt)
    return sj.read_output(spark, out).drop("batch_id")


_PRED_DELIVERY = """SELECT 'P-' || CAST(p.customer_id AS VARCHAR) || '-' || CAST(p.product_id AS VARCHAR) || '-'
         || CAST(p.prediction_date AS VARCHAR) AS delivery_id, p.customer_id, d.cname AS customer_name,
       CAST(p.product_id AS VARCHAR) AS product_id, CAST(NULL AS VARCHAR) AS product_name,
       CASE WHEN len(d.days) > 0 THEN CAST(CAST(list_filter(
            generate_series(p.prediction_date + INTERVAL 0 DAY, p.prediction_date + INTERVAL 6 DAY, INTERVAL 1 DAY),
            lambda x: list_contains(d.days, isodow(x)))[1] AS DATE) AS VARCHAR) END AS delivery_date,
       CAST(NULL AS DOUBLE) AS amount, CAST(p.estimated_quantity AS DOUBLE) AS quantity, 'prediction' AS status,
       CAST(NULL AS VARCHAR) AS source_order_id
FROM pred p JOIN days_of d ON p.customer_id = d.customer_id WHERE p.will_purchase_anything"""


@query("S5_predictions", osql(_PRED_DELIVERY, ctes=_ORD + "," + _DS + "," + _PRED_SQL))
def s5_prediction_deliveries(spark, sf_dir):
    """Delivery rows from a stream of predictions (the prediction table of a run,
    written and then read as a stream)."""
    v = Views(spark, sf_dir)
    out, ckpt = sj.run_dir(spark, "prediction-delivery")
    table = f"{out}-predictions"
    _pred(v).write.parquet(table)
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(table)
    sj.run_available(sj.prediction_delivery_stream(stream, v.customers), out, ckpt)
    return sj.read_output(spark, out).drop("batch_id")


@query("S6_batch", osql("""
SELECT CAST(time_bucket(INTERVAL 1 DAY, updated_at) AS VARCHAR) AS window_start, COUNT(*) AS changed_rows,
       CAST(MAX(updated_at) AS VARCHAR) AS last_change FROM incoming_orders GROUP BY 1"""))
def s6_change_summary(spark, sf_dir):
    """S6 (batch twin): changed rows and last change per day of the incoming orders."""
    v = Views(spark, sf_dir)
    return sj.change_summary(v.incoming_orders, "updated_at", ["id", "updated_at", "status"]).drop("fingerprint")


@query("S6_changed", osql(f"""
SELECT CAST(n.window_start AS VARCHAR) AS window_start, n.row_count AS changed_rows, CAST(n.last_change AS VARCHAR) AS last_change,
       n.fingerprint
FROM (SELECT {fingerprint_sql("time_bucket(INTERVAL 1 DAY, updated_at) AS window_start")}, MAX(updated_at) AS last_change
      FROM incoming_orders GROUP BY 1) n
LEFT JOIN (SELECT {fingerprint_sql("time_bucket(INTERVAL 1 DAY, updated_at) AS window_start")} FROM incoming_orders
           WHERE created_at < TIMESTAMP '1998-01-01' GROUP BY 1) b ON n.window_start = b.window_start
WHERE b.fingerprint IS NULL OR b.fingerprint <> n.fingerprint"""))
def s6_changed(spark, sf_dir):
    """Days whose fingerprint differs from an earlier snapshot (orders before 1998)."""
    v = Views(spark, sf_dir)
    o = v.incoming_orders
    cols = ["id", "updated_at", "status"]
    now = sj.change_summary(o, "updated_at", cols)
    before = sj.change_summary(o.filter(F.col("created_at") < F.lit("1998-01-01").cast("timestamp")), "updated_at", cols)
    return sj.changed_since(now, before)


@query("S6", osql(f"""
SELECT CAST(window_start AS VARCHAR) AS window_start, row_count AS changed_rows, CAST(last_change AS VARCHAR) AS last_change, fingerprint
FROM (SELECT {fingerprint_sql("time_bucket(INTERVAL 1 DAY, updated_at) AS window_start")}, MAX(updated_at) AS last_change
      FROM incoming_orders GROUP BY 1)"""))
def s6_change_stream(spark, sf_dir):
    """S6 streaming form: rows, last change and fingerprint per day, as last told."""
    v = Views(spark, sf_dir)
    return sj.run_changes(spark, v.incoming_from(sj.stream_table(spark, sf_dir, "orders")), "id", "updated_at", ["id", "updated_at", "status"])


@query("S7", osql("""
SELECT customer_id, product_id, CAST(prediction_date AS VARCHAR) AS prediction_date,
       CASE WHEN prediction_status = 'active' AND prediction_date < DATE '1998-03-01' - 14 THEN 'expired'
            ELSE prediction_status END AS prediction_status FROM pred""", ctes=_PRED_SQL))
def s7_expire(spark, sf_dir):
    """Active predictions older than 14 days expire on 1998-03-01."""
    return sj.expire(_pred(Views(spark, sf_dir)), "1998-03-01", 14).select(
        "customer_id", "product_id", "prediction_date", "prediction_status")


@query("S8", osql("""
SELECT product_id, CAST(current_month_sales AS DOUBLE) AS last_month_sales, CAST(0.0 AS DOUBLE) AS current_month_sales,
       CAST(0.0 AS DOUBLE) AS change_amount, CAST(0.0 AS DOUBLE) AS change_percentage, CAST(stock_quantity AS DOUBLE) AS stock_quantity FROM chg0""",
    ctes="""chg0 AS (
  SELECT p.product_id, COALESCE(a.cur, 0) AS current_month_sales, COALESCE(s.stock_quantity, 0) AS stock_quantity
  FROM (SELECT DISTINCT product_id FROM product_master WHERE is_active = 'active') p
  LEFT JOIN (SELECT product_id, SUM(quantity) AS cur FROM order_tx
             WHERE transaction_date >= DATE '2001-07-01' AND transaction_date < DATE '2001-08-01' GROUP BY 1) a
    ON p.product_id = a.product_id
  LEFT JOIN (SELECT product_id, SUM(stock_quantity) AS stock_quantity FROM inventory GROUP BY 1) s
    ON p.product_id = s.product_id)"""))
def s8_rollover(spark, sf_dir):
    """Month rollover of the change table on 2001-08-01."""
    v = Views(spark, sf_dir)
    chg = sales.sales_change(v.order_tx(), v.product_master, v.inventory, None, "2001-07-15")
    return sj.rollover(chg, v.product_master, "2001-08-01")
