"""Direct queries for operators otherwise exercised inside composite queries (J1, J12,
J13, A9, W1, W4, W5, W6, W8, M2, M3, M4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow.constants import SALE
from ledgerflow.operators import catalog as cat
from ledgerflow.operators import forecast as fc
from ledgerflow.operators import lifecycle as lc
from ledgerflow.operators import replenish as rp
from ledgerflow.operators import sales
from ledgerflow.plans.q_forecast import FC_CTES, PRED
from ledgerflow.plans.q_lifecycle import REM_AS_OF, _ORD, _rem_sql
from ledgerflow.plans.q_replenish import PRED_AS_OF, _m10_sql
from ledgerflow.plans.registry import query
from ledgerflow.sources.views import Views, osql


@query("J1", osql(f"""
SELECT pm.category, COUNT(*) AS lines, CAST(SUM(t.amount) AS DOUBLE) AS amount
FROM order_tx t JOIN product_master pm ON t.product_id = pm.product_id WHERE t.document_type = '{SALE}' GROUP BY 1"""))
def j1_sales_with_product(spark, sf_dir):
    """Sale lines with product attributes (inner join), per category."""
    v = Views(spark, sf_dir)
    t = sales.sales_with_product(v.order_tx().filter(F.col("document_type") == SALE), v.product_master)
    return t.groupBy("category").agg(F.count("*").alias("lines"), F.sum("amount").alias("amount"))


@query("J12", osql("""
SELECT DISTINCT customer_id, product_name FROM op
WHERE is_new_product AND customer_id IS NOT NULL AND product_name IS NOT NULL
  AND (customer_id, product_name) NOT IN (SELECT (customer_id, product_name) FROM rem1)""",
    ctes=_ORD + "," + _rem_sql("rem1", REM_AS_OF)))
def j12_no_reminder_yet(spark, sf_dir):
    """New-product purchase pairs that have no reminder yet (two-column anti join)."""
    v = Views(spark, sf_dir)
    o = lc.order_products(v.incoming_orders, v.product_master).filter(
        F.col("is_new_product") & F.col("customer_id").isNotNull() & F.col("product_name").isNotNull())
    rem = lc.create_reminders(lc.order_products(v.incoming_orders, v.product_master), None, REM_AS_OF)
    return o.select("customer_id", "product_name").distinct().join(
        rem.select("customer_id", "product_name"), ["customer_id", "product_name"], "left_anti")


@query("J13", osql("""
SELECT DISTINCT r.customer_id, r.product_name FROM rem1 r JOIN op o
  ON o.customer_id = r.customer_id AND o.product_name = r.product_name AND o.created_at > r.last_purchase_date""",
    ctes=_ORD + "," + _rem_sql("rem1", REM_AS_OF)))
def j13_repurchased(spark, sf_dir):
    """Reminder pairs bought again after the reminder's purchase date (per-pair max,
    then an equi-join)."""
    v = Views(spark, sf_dir)
    o = lc.order_products(v.incoming_orders, v.product_master)
    rem = lc.create_reminders(o, None, REM_AS_OF)
    return lc.close_reminders(rem, o).filter("repurchased").select("customer_id", "product_name")


@query("A9", osql("""
SELECT subcategory, CAST(SUM(CASE WHEN month = DATE '2001-05-01' THEN quantity ELSE 0 END) AS DOUBLE) AS month_minus_3,
       CAST(SUM(CASE WHEN month = DATE '2001-06-01' THEN quantity ELSE 0 END) AS DOUBLE) AS month_minus_2,
       CAST(SUM(CASE WHEN month = DATE '2001-07-01' THEN quantity ELSE 0 END) AS DOUBLE) AS month_minus_1
FROM monthly WHERE month >= DATE '2001-04-01' GROUP BY 1""", ctes=FC_CTES))
def a9_recent_months(spark, sf_dir):
    """Quantities of the three months before the prediction month (conditional sums)."""
    v = Views(spark, sf_dir)
    m = fc.monthly_quantity(v.order_tx(), v.product_master, PRED, months=4)
    p = F.lit(PRED).cast("date")
    return m.groupBy("subcategory").agg(*[
        F.sum(F.when(F.col("month") == F.add_months(p, -k), F.col("quantity")).otherwise(F.lit(0))).alias(
            f"month_minus_{k}") for k in (3, 2, 1)])


@query("W1", osql("""
SELECT customer_id, transaction_id, CAST(transaction_date AS VARCHAR) AS transaction_date FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY transaction_date DESC, transaction_id DESC) AS r
  FROM order_tx) WHERE r = 1"""))
def w1_latest_per_customer(spark, sf_dir):
    """The latest transaction per customer (row_number, full tie-break)."""
    v = Views(spark, sf_dir)
    return cat.latest_per(v.order_tx(), ["customer_id"], "transaction_date", ["transaction_id"]).select(
        "customer_id", "transaction_id", "transaction_date")


_DAILY = f"""d AS (SELECT customer_id, product_id, transaction_date, SUM(quantity) AS quantity FROM replen_tx
               WHERE document_type = '{SALE}' GROUP BY 1, 2, 3),
g AS (SELECT *, date_diff('day', lag(transaction_date) OVER w, transaction_date) AS gap,
             row_number() OVER w AS rn, COUNT(*) OVER (PARTITION BY customer_id, product_id) AS n
      FROM d WINDOW w AS (PARTITION BY customer_id, product_id ORDER BY transaction_date))"""


@query("W4", osql("""SELECT customer_id, product_id, CAST(transaction_date AS VARCHAR) AS transaction_date, gap FROM g""",
                  ctes=_DAILY))
def w4_intervals(spark, sf_dir):
    """Day gaps between consecutive purchase days of each pair."""
    d = rp.daily_purchases(Views(spark, sf_dir).replen_tx)
    w = Window.partitionBy("customer_id", "product_id").orderBy("transaction_date")
    return d.select("customer_id", "product_id", "transaction_date",
                    F.datediff("transaction_date", F.lag("transaction_date").over(w)).alias("gap"))


@query("W5", osql("""
SELECT customer_id, product_id, round(AVG(CASE WHEN rn >= n - 2 AND gap IS NOT NULL THEN CAST(gap AS DOUBLE) END), 6) AS recent3_gap,
       round(AVG(CASE WHEN rn >= 2 AND rn <= 1 + greatest(1, n - 4) THEN CAST(gap AS DOUBLE) END), 6) AS early_gap,
       CAST(MIN(CASE WHEN rn >= n - 2 THEN quantity END) AS DOUBLE) AS min_recent_quantity
FROM g GROUP BY 1, 2""", ctes=_DAILY))
def w5_tail_stats(spark, sf_dir):
    """Mean of the last 3 gaps, mean of the first max(1, n−3) gaps, min of the last 3
    quantities, per pair."""
    d = rp.daily_purchases(Views(spark, sf_dir).replen_tx)
    w = Window.partitionBy("customer_id", "product_id").orderBy("transaction_date")
    h = (d.withColumn("gap", F.datediff("transaction_date", F.lag("transaction_date").over(w)))
         .withColumn("rn", F.row_number().over(w))
         .withColumn("n", F.count("*").over(Window.partitionBy("customer_id", "product_id"))))
    rn, n, gap = F.col("rn"), F.col("n"), F.col("gap").cast("double")
    return h.groupBy("customer_id", "product_id").agg(
        F.round(F.avg(F.when((rn >= n - 2) & gap.isNotNull(), gap)), 6).alias("recent3_gap"),
        F.round(F.avg(F.when((rn >= 2) & (rn <= 1 + F.greatest(F.lit(1), n - 4)), gap)), 6).alias("early_gap"),
        F.min(F.when(rn >= n - 2, F.col("quantity"))).alias("min_recent_quantity"))


def _stats(v):
    m = fc.monthly_quantity(v.order_tx(), v.product_master, PRED)
    keys = fc.volatility(m, PRED).select("subcategory")
    return fc.forecast_stats(fc.monthly_history(m, keys, PRED))


@query("W6", osql("SELECT subcategory, n, round(ewma, 6) AS ewma FROM st", ctes=FC_CTES))
def w6_ewma(spark, sf_dir):
    """EWMA (α 0.3, adjust=False) of every subcategory's non-zero months."""
    return _stats(Views(spark, sf_dir)).select("subcategory", "n", F.round("ewma", 6).alias("ewma"))


@query("M2", osql("""
SELECT subcategory, n, round(CASE WHEN n < 2 THEN mean * 0.8 WHEN n >= 4 THEN median ELSE mean END, 4) AS prediction FROM st""",
    ctes=FC_CTES))
def m2_fc_high(spark, sf_dir):
    """M2: the high-volatility method applied to every subcategory."""
    st = _stats(Views(spark, sf_dir))
    return st.select("subcategory", "n", F.round(fc.fc_high(st), 4).alias("prediction"))


@query("M3", osql("""
SELECT subcategory, n, round(CASE WHEN n < 3 THEN mean
                              WHEN n >= 4 THEN greatest(least(ewma, recent3 * 1.05), least(greatest(ewma, recent3 * 1.05), median))
                              ELSE (ewma + median) / 2 END, 4) AS prediction FROM st""", ctes=FC_CTES))
def m3_fc_medium(spark, sf_dir):
    """M3: the medium-volatility method applied to every subcategory."""
    st = _stats(Views(spark, sf_dir))
    return st.select("subcategory", "n", F.round(fc.fc_medium(st), 4).alias("prediction"))


@query("M4", osql("""
SELECT subcategory, n, round(CASE WHEN n >= 6 THEN least(greatest(intercept + slope * 18.0, mean * 0.5), mean * 1.5)
                              ELSE mean END, 4) AS prediction FROM st""", ctes=FC_CTES))
def m4_fc_low(spark, sf_dir):
    """M4: the low-volatility (trend) method applied to every subcategory."""
    st = _stats(Views(spark, sf_dir))
    return st.select("subcategory", "n", F.round(fc.fc_low(st), 4).alias("prediction"))


@query("W8", osql("""
SELECT customer_id, product_id, CAST(prediction_date AS VARCHAR) AS prediction_date, purchase_probability FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, product_id ORDER BY purchase_probability DESC, prediction_date) AS r
  FROM preds WHERE will_purchase_anything) WHERE r = 1""", ctes=_m10_sql(PRED_AS_OF)))
def w8_best_day(spark, sf_dir):
    """Each pair's best day over the horizon (highest probability, first on ties)."""
    p = rp.predict_orders(Views(spark, sf_dir).replen_tx, PRED_AS_OF).filter("will_purchase_anything")
    w = Window.partitionBy("customer_id", "product_id").orderBy(F.col("purchase_probability").desc(),
                                                                F.col("prediction_date").asc())
    return p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select(
        "customer_id", "product_id", "prediction_date", "purchase_probability")
