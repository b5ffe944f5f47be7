"""Registered sales queries (A1–A7, A19–A21, F1, F15, J1–J3, J9) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.constants import AS_OF_MONTHLY, SALE
from ledgerflow.operators import sales
from ledgerflow.plans.registry import query
from ledgerflow.sources.views import Views, osql

CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
CITIES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
FULL_START, FULL_END = "1995-01-01", "2001-08-01"
_cats = ", ".join(f"'{c}'" for c in CATEGORIES)
_cities = ", ".join(f"'{c}'" for c in CITIES)


@query("A1", osql(f"""
SELECT CAST(t.transaction_date AS VARCHAR) AS sales_date, pm.category AS filter_value, CAST(SUM(t.amount) AS DOUBLE) AS total_amount
FROM order_tx t JOIN product_master pm ON t.product_id = pm.product_id
WHERE t.document_type = '{SALE}' AND t.transaction_date BETWEEN DATE '{FULL_START}' AND DATE '{FULL_END}'
  AND pm.category IN ({_cats})
GROUP BY 1, 2"""))
def a1_sales_by_day_category(spark, sf_dir):
    """A1: daily sale amount per product category over the whole history."""
    v = Views(spark, sf_dir)
    return sales.sales_series(v.order_tx(), v.product_master, v.customers, "category", CATEGORIES,
                              FULL_START, FULL_END)


@query("A1_city", osql(f"""
SELECT CAST(t.transaction_date AS VARCHAR) AS sales_date, c.city AS filter_value, CAST(SUM(t.amount) AS DOUBLE) AS total_amount
FROM order_tx t JOIN customers c ON t.customer_id = c.customer_id
WHERE t.document_type = '{SALE}' AND t.transaction_date BETWEEN DATE '{FULL_START}' AND DATE '{FULL_END}'
  AND c.city IN ({_cities})
GROUP BY 1, 2"""))
def a1_sales_by_day_city(spark, sf_dir):
    """A1: daily sale amount per city (customer geography)."""
    v = Views(spark, sf_dir)
    return sales.sales_series(v.order_tx(), v.product_master, v.customers, "city", CITIES, FULL_START, FULL_END)


@query("A2", osql(f"""
SELECT filter_value, CAST(sales_month AS VARCHAR) AS sales_month, CAST(SUM(amount) AS DOUBLE) AS total_amount
FROM (SELECT pm.subcategory AS filter_value, CAST(date_trunc('month', t.transaction_date) AS DATE) AS sales_month, t.amount
      FROM order_tx t JOIN product_master pm ON t.product_id = pm.product_id
      WHERE t.document_type = '{SALE}' AND t.transaction_date BETWEEN DATE '{FULL_START}' AND DATE '{FULL_END}') x
GROUP BY ROLLUP (filter_value, sales_month)"""))
def a2_monthly_sales(spark, sf_dir):
    """A2: monthly amount per subcategory with per-member and overall totals (rollup)."""
    v = Views(spark, sf_dir)
    return sales.monthly_sales(v.order_tx(), v.product_master, v.customers, "subcategory", None,
                               FULL_START, FULL_END)


@query("A3", osql(f"""
SELECT g.filter_value, CAST(g.period AS VARCHAR) AS period, CAST(COALESCE(s.total_amount, 0) AS DOUBLE) AS total_amount,
       'month' AS grain
FROM grid g LEFT JOIN s ON g.filter_value = s.filter_value AND g.period = s.period""", ctes=f"""
grid AS (SELECT m.filter_value, CAST(p.period AS DATE) AS period
         FROM (VALUES {", ".join(f"('{c}')" for c in CITIES)}, ('ATLANTIS')) m(filter_value),
              (SELECT unnest(generate_series(DATE '{FULL_START}', DATE '2001-08-01', INTERVAL 1 MONTH)) AS period) p),
s AS (SELECT c.city AS filter_value, CAST(date_trunc('month', t.transaction_date) AS DATE) AS period,
             SUM(t.amount) AS total_amount
      FROM order_tx t JOIN customers c ON t.customer_id = c.customer_id
      WHERE t.document_type = '{SALE}' AND t.transaction_date BETWEEN DATE '{FULL_START}' AND DATE '2001-08-31'
        AND c.city IN ({_cities}, 'ATLANTIS')
      GROUP BY 1, 2)"""))
def a3_filled_series(spark, sf_dir):
    """A3: city × month grid over the whole history, zero-filled (one member has no data)."""
    v = Views(spark, sf_dir)
    return sales.filled_series(v.order_tx(), v.product_master, v.customers, "city",
                               list(CITIES) + ["ATLANTIS"], FULL_START, "2001-08-31")


@query("A3_missing", osql("""
SELECT m.filter_value FROM (VALUES ('AFRICA'), ('ATLANTIS')) m(filter_value)
WHERE m.filter_value NOT IN (SELECT c.city FROM order_tx t JOIN customers c ON t.customer_id = c.customer_id
                             WHERE t.document_type = '銷貨')"""))
def a3_members_without_data(spark, sf_dir):
    """Selected members with no sales in the range."""
    v = Views(spark, sf_dir)
    return sales.members_without_data(v.order_tx(), v.product_master, v.customers, "city",
                                      ["AFRICA", "ATLANTIS"], FULL_START, "2001-08-31")


@query("A4", osql("""
SELECT pm.category, pm.subcategory, CAST(SUM(COALESCE(i.stock_quantity, 0)) AS DOUBLE) AS total_stock,
       CAST(MAX(i.updated_at) AS VARCHAR) AS last_updated
FROM product_master pm LEFT JOIN inventory i ON pm.product_id = i.product_id AND pm.warehouse_id = i.warehouse_id
WHERE pm.is_active = 'active'
GROUP BY 1, 2"""))
def a4_stock_summary(spark, sf_dir):
    """A4 + J3: stock per category / subcategory of active products."""
    v = Views(spark, sf_dir)
    return sales.stock_summary(v.product_master, v.inventory)


@query("J3", osql("""
SELECT pm.product_id, pm.warehouse_id, CAST(COALESCE(i.stock_quantity, 0) AS DOUBLE) AS stock_quantity
FROM product_master pm LEFT JOIN inventory i ON pm.product_id = i.product_id AND pm.warehouse_id = i.warehouse_id"""))
def j3_product_stock(spark, sf_dir):
    """Product ⟕ stock on two keys, missing → 0."""
    v = Views(spark, sf_dir)
    return sales.product_stock(v.product_master, v.inventory).select("product_id", "warehouse_id", "stock_quantity")


@query("A5", osql("""
SELECT customer_id, product_name, CAST(transaction_date AS VARCHAR) AS transaction_date,
       CAST(quantity AS DOUBLE) AS quantity, doc_types,
       CASE WHEN quantity > 0 THEN '銷貨' WHEN quantity < 0 THEN '銷退' ELSE '抵銷' END AS document_type
FROM (SELECT t.customer_id, pm.name_zh AS product_name, t.transaction_date, SUM(t.quantity) AS quantity,
             string_agg(DISTINCT t.document_type, ',' ORDER BY t.document_type) AS doc_types
      FROM order_tx t JOIN product_master pm ON t.product_id = pm.product_id
      GROUP BY 1, 2, 3) g
WHERE quantity <> 0"""))
def a5_net_transactions(spark, sf_dir):
    """A5: net quantity per customer, product name and day, labelled."""
    v = Views(spark, sf_dir)
    return sales.net_transactions(v.order_tx(), v.product_master)


@query("A6", osql("""
SELECT customer_id, month, CAST(monthly_amount AS DOUBLE) AS monthly_amount,
       CAST(SUM(monthly_amount) OVER (PARTITION BY customer_id) AS DOUBLE)
             / COUNT(*) OVER (PARTITION BY customer_id) AS avg_monthly_amount
FROM (SELECT customer_id, strftime(transaction_date, '%Y-%m') AS month, SUM(amount) AS monthly_amount
      FROM order_tx GROUP BY 1, 2) m"""))
def a6_monthly_spend(spark, sf_dir):
    """Spend per customer and month with the customer's monthly average."""
    v = Views(spark, sf_dir)
    return sales.monthly_spend(v.order_tx())


@query("A7", osql(f"""
SELECT customer_id, product_id, CAST(MIN(transaction_date) AS VARCHAR) AS first_purchase,
       CAST(MAX(transaction_date) AS VARCHAR) AS last_purchase, COUNT(*) AS purchase_count
FROM order_tx WHERE document_type = '{SALE}' GROUP BY 1, 2"""))
def a7_purchase_history(spark, sf_dir):
    """First / last purchase and count per customer and product."""
    v = Views(spark, sf_dir)
    return sales.purchase_history(v.order_tx())


def _top_buyers(v):
    """Long (product_id, rank, customer_id): customers by bought quantity per product."""
    from ledgerflow.operators.catalog import top_k_per
    t = v.order_tx().filter(F.col("document_type") == SALE)
    g = t.groupBy("product_id", "customer_id").agg(F.sum("quantity").alias("q"))
    return top_k_per(g, ["product_id"], [F.col("q").desc(), F.col("customer_id").asc()], 3)


_TOP_BUYERS_SQL = f"""
buyers AS (SELECT product_id, customer_id, rank FROM (
  SELECT product_id, customer_id, row_number() OVER (PARTITION BY product_id ORDER BY SUM(quantity) DESC, customer_id) AS rank
  FROM order_tx WHERE document_type = '{SALE}' GROUP BY product_id, customer_id) WHERE rank <= 3),
piv AS (SELECT product_id, MAX(CASE WHEN rank = 1 THEN customer_id END) AS recommended_customer_id_rank1,
               MAX(CASE WHEN rank = 2 THEN customer_id END) AS recommended_customer_id_rank2,
               MAX(CASE WHEN rank = 3 THEN customer_id END) AS recommended_customer_id_rank3
        FROM buyers GROUP BY product_id),
chg AS (
  SELECT p.product_id, COALESCE(a.last_month_sales, 0) AS last_month_sales,
         COALESCE(a.current_month_sales, 0) AS current_month_sales, COALESCE(s.stock_quantity, 0) AS stock_quantity
  FROM (SELECT DISTINCT product_id FROM product_master WHERE is_active = 'active') p
  LEFT JOIN (SELECT product_id,
                    SUM(CASE WHEN date_trunc('month', transaction_date) = DATE '2001-07-01' THEN quantity ELSE 0 END) AS current_month_sales,
                    SUM(CASE WHEN date_trunc('month', transaction_date) = DATE '2001-06-01' THEN quantity ELSE 0 END) AS last_month_sales
             FROM order_tx WHERE transaction_date >= DATE '2001-06-01' AND transaction_date < DATE '2001-08-01'
             GROUP BY product_id) a ON p.product_id = a.product_id
  LEFT JOIN (SELECT product_id, SUM(stock_quantity) AS stock_quantity FROM inventory GROUP BY 1) s ON p.product_id = s.product_id),
chg2 AS (SELECT *, current_month_sales - last_month_sales AS change_amount,
                CASE WHEN last_month_sales > 0
                     THEN round(CAST(current_month_sales - last_month_sales AS DOUBLE) / CAST(last_month_sales AS DOUBLE) * 100, 2)
                     ELSE 0.0 END AS change_percentage FROM chg)"""


@query("A19", osql("""
SELECT c.product_id, CAST(c.last_month_sales AS DOUBLE) AS last_month_sales,
       CAST(c.current_month_sales AS DOUBLE) AS current_month_sales, CAST(c.stock_quantity AS DOUBLE) AS stock_quantity,
       CAST(c.change_amount AS DOUBLE) AS change_amount, c.change_percentage,
       p.recommended_customer_id_rank1, p.recommended_customer_id_rank2, p.recommended_customer_id_rank3
FROM chg2 c LEFT JOIN piv p ON c.product_id = p.product_id""", ctes=_TOP_BUYERS_SQL))
def a19_sales_change(spark, sf_dir):
    """A19 + A20: month-over-month change for 2001-07 vs 2001-06 with top-3 customers."""
    v = Views(spark, sf_dir)
    return sales.sales_change(v.order_tx(), v.product_master, v.inventory, _top_buyers(v), "2001-07-15")


@query("A20", osql("SELECT * FROM piv", ctes=_TOP_BUYERS_SQL))
def a20_pivot_ranks(spark, sf_dir):
    """Long ranks → rank1..3 columns."""
    v = Views(spark, sf_dir)
    return sales.pivot_ranks(_top_buyers(v), "product_id", "customer_id", 3, "recommended_customer_id_rank")


@query("A21", osql("""
SELECT COUNT(*) AS total_products, count_if(u.product_id IS NOT NULL) AS processed, count_if(u.product_id IS NULL) AS unprocessed,
       count_if(change_amount > 0) AS increased, count_if(change_amount < 0) AS decreased,
       count_if(change_amount = 0) AS unchanged, count_if(abs(change_percentage) >= 100) AS change_ge_100,
       count_if(abs(change_percentage) >= 50 AND abs(change_percentage) < 100) AS change_50_100,
       count_if(abs(change_percentage) >= 20 AND abs(change_percentage) < 50) AS change_20_50,
       count_if(abs(change_percentage) < 20) AS change_lt_20, count_if(stock_quantity = 0) AS zero_stock,
       count_if(stock_quantity > 0 AND stock_quantity < 10) AS low_stock,
       round(AVG(CAST(stock_quantity AS DOUBLE)), 6) AS avg_stock
FROM chg2 LEFT JOIN (SELECT DISTINCT product_id FROM inventory WHERE updated_at >= TIMESTAMP '2001-07-15') u
  ON chg2.product_id = u.product_id""", ctes=_TOP_BUYERS_SQL))
def a21_change_stats(spark, sf_dir):
    """Change report statistics; a product counts as processed once its stock was updated after the report day."""
    v = Views(spark, sf_dir)
    change = sales.sales_change(v.order_tx(), v.product_master, v.inventory, None, "2001-07-15")
    done = (v.inventory.filter(F.col("updated_at") >= F.lit("2001-07-15").cast("timestamp")).select("product_id").distinct()
            .withColumn("_done", F.lit(True)))
    change = change.join(done, "product_id", "left").withColumn("processed", F.coalesce("_done", F.lit(False))).drop("_done")
    return sales.change_stats(change)


@query("F15", osql("""
SELECT product_id, change_percentage, CAST(current_month_sales AS DOUBLE) AS current_month_sales,
       CAST(last_month_sales AS DOUBLE) AS last_month_sales
FROM chg2 WHERE abs(change_percentage) > 500 OR (current_month_sales > 1000 AND last_month_sales = 0)
ORDER BY abs(change_percentage) DESC, product_id LIMIT 10""", ctes=_TOP_BUYERS_SQL))
def f15_sales_anomalies(spark, sf_dir):
    """extreme month-over-month changes, top 10 (the limit is the report)."""
    v = Views(spark, sf_dir)
    chg = sales.sales_change(v.order_tx(), v.product_master, v.inventory, None, "2001-07-15")
    return sales.sales_anomalies(chg, pct=50.0, jump_from_zero=100.0)


@query("F1", osql(f"""
SELECT pm.subcategory, COUNT(*) AS lines, CAST(SUM(t.quantity) AS DOUBLE) AS quantity
FROM order_tx t JOIN product_master pm ON t.product_id = pm.product_id
WHERE t.document_type = '{SALE}' AND t.quantity > 0 AND pm.is_active = 'active'
  AND t.transaction_date >= DATE '2000-02-01' AND t.transaction_date < DATE '{AS_OF_MONTHLY}'
GROUP BY 1"""))
def f1_valid_sales(spark, sf_dir):
    """F1 + J1: valid sales of active products in the 18-month window, per subcategory."""
    v = Views(spark, sf_dir)
    t = sales.valid_sales(v.order_tx(), v.product_master, "2000-02-01", AS_OF_MONTHLY)
    return t.groupBy("subcategory").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))


@query("J2", osql(f"""
SELECT c.city, c.district, COUNT(*) AS lines, CAST(SUM(t.amount) AS DOUBLE) AS amount
FROM order_tx t JOIN customers c ON t.customer_id = c.customer_id
WHERE t.document_type = '{SALE}' GROUP BY 1, 2"""))
def j2_sales_with_customer(spark, sf_dir):
    """Sales ⋈ customer geography, amount per city and district."""
    v = Views(spark, sf_dir)
    t = sales.sales_with_customer(v.order_tx().filter(F.col("document_type") == SALE), v.customers)
    return t.groupBy("city", "district").agg(F.count("*").alias("lines"), F.sum("amount").alias("amount"))


@query("J9", osql("""
SELECT product_id, arg_min(name_zh, (CASE WHEN is_active = 'active' THEN 0 ELSE 1 END, warehouse_id)) AS name_zh,
       arg_min(subcategory, (CASE WHEN is_active = 'active' THEN 0 ELSE 1 END, warehouse_id)) AS subcategory
FROM product_master GROUP BY product_id"""))
def j9_dedup_product(spark, sf_dir):
    """One row per product before dimension joins."""
    v = Views(spark, sf_dir)
    return sales.dedup_product(v.product_master).select("product_id", "name_zh", "subcategory")
