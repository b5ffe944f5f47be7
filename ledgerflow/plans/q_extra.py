"""Registered queries for the remaining list / dedup / write operators (J5, A33, A34, W10,
W11, SNK1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.constants import SALE
from ledgerflow.functions import text as ft
from ledgerflow.operators import catalog as cat
from ledgerflow.operators import lists as ls
from ledgerflow.operators import recommend as rc
from ledgerflow.operators import replenish as rp
from ledgerflow.plans.registry import query
from ledgerflow.session import sub_checkpoint
from ledgerflow.sources import ingest as ig
from ledgerflow.sources.views import Views, osql


def _pred(v):
    t = v.order_tx().filter(F.col("document_type") == SALE)
    return t.groupBy("customer_id", "product_id").agg(F.date_add(F.max("transaction_date"), 30).alias("prediction_date"))


@query("J5", osql(f"""
SELECT p.customer_id, p.product_id, CAST(p.prediction_date AS VARCHAR) AS prediction_date,
       COALESCE(c.customer_name, 'Unknown') AS customer_name, COALESCE(pm.name_zh, 'Unknown') AS product_name,
       c.phone_number
FROM (SELECT customer_id, product_id, MAX(transaction_date) + 30 AS prediction_date FROM order_tx
      WHERE document_type = '{SALE}'
      GROUP BY 1, 2) p
LEFT JOIN customers c ON p.customer_id = c.customer_id
LEFT JOIN (SELECT product_id, arg_min(name_zh, (CASE WHEN is_active = 'active' THEN 0 ELSE 1 END, warehouse_id)) AS name_zh
           FROM product_master GROUP BY 1) pm ON p.product_id = pm.product_id"""))
def j5_reminder_list(spark, sf_dir):
    """Predictions with customer and product names (fallback 'Unknown')."""
    v = Views(spark, sf_dir)
    return ls.reminder_list(_pred(v), v.customers, v.product_master).select(
        "customer_id", "product_id", "prediction_date", "customer_name", "product_name", "phone_number")


@query("A33", osql("""
SELECT group_key, COUNT(*) OVER (PARTITION BY group_key) AS group_orders,
       count_if(status = '0') OVER (PARTITION BY group_key) AS group_open, id, customer_id, product_id,
       CAST(quantity AS DOUBLE) AS quantity, status, CAST(created_at AS VARCHAR) AS created_at
FROM (SELECT *, COALESCE(NULLIF(trim(customer_name), ''), 'Line用戶: ' || NULLIF(trim(line_id), ''), '未知客戶') AS group_key
      FROM incoming_orders)"""))
def a33_group_orders(spark, sf_dir):
    """Every incoming order under its group, with the group's counts."""
    return ls.group_orders(Views(spark, sf_dir).incoming_orders).select(
        "group_key", "group_orders", "group_open", "id", "customer_id", "product_id", "quantity", "status", "created_at")


@query("A34", osql("""
SELECT DISTINCT category, subcategory, name_zh AS product_name FROM product_master
WHERE is_active = 'active' AND category IS NOT NULL AND subcategory IS NOT NULL"""))
def a34_hierarchy(spark, sf_dir):
    """Category → subcategory → names of the active products (long form)."""
    return ls.hierarchy(Views(spark, sf_dir).product_master)


def _w10_sql():
    from ledgerflow.plans.q_replenish import _m10_sql_sfx
    return _m10_sql_sfx("2024-01-20", "_a") + ",\n" + _m10_sql_sfx("2024-01-22", "_b")


@query("W10", osql("""
SELECT customer_id, product_id, CAST(prediction_date AS VARCHAR) AS prediction_date, purchase_probability FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, product_id, prediction_date
                               ORDER BY purchase_probability DESC, src) AS r FROM (
    SELECT customer_id, product_id, prediction_date, purchase_probability, 1 AS src FROM preds_a WHERE will_purchase_anything
    UNION ALL
    SELECT customer_id, product_id, prediction_date, purchase_probability, 2 AS src FROM preds_b WHERE will_purchase_anything))
WHERE r = 1""", ctes=_w10_sql()))
def w10_dedup_best(spark, sf_dir):
    """Predictions of two runs with overlapping days, one row per (customer, product,
    day) keeping the highest probability (earlier run on ties)."""
    v = Views(spark, sf_dir)
    a = rp.predict_orders(v.replen_tx, "2024-01-20").filter("will_purchase_anything").withColumn("src", F.lit(1))
    b = rp.predict_orders(v.replen_tx, "2024-01-22").filter("will_purchase_anything").withColumn("src", F.lit(2))
    return ls.dedup_best(a.unionByName(b)).select("customer_id", "product_id", "prediction_date", "purchase_probability")


@query("W11", osql("""
SELECT customer_id, id, CAST(created_at AS VARCHAR) AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at, id) AS r FROM incoming_orders
  WHERE customer_id IS NOT NULL) WHERE r = 1"""))
def w11_first_seen(spark, sf_dir):
    """First incoming order per customer (first-seen dedup)."""
    o = Views(spark, sf_dir).incoming_orders.filter(F.col("customer_id").isNotNull())
    return cat.distinct_on(o, ["customer_id"], [F.col("created_at"), F.col("id")]).select("customer_id", "id", "created_at")


@query("SNK1", osql("""
SELECT subcategory, CAST(SUM(quantity) AS DOUBLE) AS quantity FROM order_tx t JOIN product_master pm
  ON t.product_id = pm.product_id WHERE t.document_type = '銷貨' GROUP BY 1"""))
def snk1_write_csv(spark, sf_dir):
    """SNK1: a report written as CSV with header and BOM, read back from the written files."""
    import uuid

    v = Views(spark, sf_dir)
    t = v.order_tx().filter(F.col("document_type") == SALE).join(v.product_master.select("product_id", "subcategory"),
                                                                  "product_id")
    rep = t.groupBy("subcategory").agg(F.sum("quantity").cast("double").alias("quantity"))
    path = sub_checkpoint(spark, f"reports/subcategory-{uuid.uuid4().hex[:12]}")
    ig.write_csv(rep, path)
    back = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    first = back.columns[0]
    return back.select(F.col(first).alias("subcategory"), F.col("quantity").cast("double").alias("quantity"))


@query("W9", osql(f"""
SELECT customer_id, subcategory, product_id, purchases, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY purchases DESC, product_id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id, subcategory ORDER BY purchases DESC, product_id) AS r FROM (
      SELECT t.customer_id, p.subcategory, t.product_id, COUNT(*) AS purchases
      FROM order_tx t JOIN product_master p ON t.product_id = p.product_id WHERE t.document_type = '{SALE}' GROUP BY 1, 2, 3))
  WHERE r = 1) WHERE rank <= 7"""))
def w9_best_then_top(spark, sf_dir):
    """Each customer's most bought product of every subcategory, then the 7 best of those."""
    v = Views(spark, sf_dir)
    bought = v.order_tx().filter(F.col("document_type") == SALE).join(v.product_master.select("product_id", "subcategory"), "product_id")
    counts = bought.groupBy("customer_id", "subcategory", "product_id").agg(F.count("*").alias("purchases"))
    best = rc.best_per_subcategory(counts.withColumn("rank_score", F.col("purchases")))
    top = cat.top_k_per(best, ["customer_id"], [F.col("purchases").desc(), F.col("product_id")], 7)
    return top.select("customer_id", "subcategory", "product_id", "purchases", "rank")


@query("X10_percent", osql("""
SELECT customer_id, format('{:,.1f}', abs(acctbal)) || '%' AS percent_text FROM customers"""))
def x10_percent(spark, sf_dir):
    """Absolute percentage with one decimal (account balances stand in for the change)."""
    return Views(spark, sf_dir).customers.select("customer_id", ft.fmt_percent("acctbal").alias("percent_text"))
