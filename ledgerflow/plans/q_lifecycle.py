"""Registered lifecycle queries (C1–C7, A22–A24, F14, J7, J8, S5 batch, SNK9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.constants import SALE
from ledgerflow.operators import catalog as cat
from ledgerflow.operators import lifecycle as lc
from ledgerflow.plans.registry import query
from ledgerflow.sources.views import Views, osql

AS_OF = "2001-08-01"
REM_AS_OF = "2000-01-01 00:00:00"
NOW = "2001-08-01 12:00:00"

_INACTIVE = f"""
lastbuy AS (SELECT customer_id, MAX(transaction_date) AS last_order_date,
                   arg_max(product_id, (transaction_date, transaction_id)) AS last_product
            FROM order_tx WHERE document_type = '{SALE}' AND transaction_date <= DATE '{{as_of}}' GROUP BY 1),
{{name}} AS (SELECT l.customer_id, l.last_order_date, l.last_product,
                  date_diff('day', l.last_order_date, DATE '{{as_of}}') AS inactive_days, c.customer_name,
                  DATE '{{as_of}}' AS last_check_date, DATE '{{as_of}}' AS first_inactive_date, FALSE AS processed,
                  CAST(NULL AS DATE) AS reactivated_date
           FROM lastbuy l LEFT JOIN customers c ON l.customer_id = c.customer_id
           WHERE date_diff('day', l.last_order_date, DATE '{{as_of}}') >= {{days}})"""


def _inactive_sql(name, as_of, days):
    return _INACTIVE.format(name=name, as_of=as_of, days=days).replace("lastbuy", f"lastbuy_{name}")


_OUT = """customer_id, CAST(last_order_date AS VARCHAR) AS last_order_date, last_product, inactive_days, customer_name,
       CAST(first_inactive_date AS VARCHAR) AS first_inactive_date, CAST(reactivated_date AS VARCHAR) AS reactivated_date"""


@query("C1", osql(f"SELECT {_OUT} FROM ina", ctes=_inactive_sql("ina", AS_OF, 90)))
def c1_inactive_customers(spark, sf_dir):
    """Customers without a sale for 90+ days on 2001-08-01."""
    v = Views(spark, sf_dir)
    return lc.inactive_customers(v.order_tx(), v.customers, AS_OF, 90).select(
        "customer_id", "last_order_date", "last_product", "inactive_days", "customer_name", "first_inactive_date",
        "reactivated_date")


@query("C1_merge", osql(f"""
SELECT {_OUT} FROM (
  SELECT c.customer_id, c.last_order_date, c.last_product, c.inactive_days, c.customer_name,
         COALESCE(p.first_inactive_date, c.first_inactive_date) AS first_inactive_date, p.reactivated_date
  FROM cur c LEFT JOIN prev p ON c.customer_id = p.customer_id
  UNION ALL
  SELECT p.customer_id, p.last_order_date, p.last_product, p.inactive_days, p.customer_name, p.first_inactive_date,
         p.reactivated_date
  FROM prev p WHERE p.customer_id NOT IN (SELECT customer_id FROM cur))""",
    ctes=_inactive_sql("prev", "2001-05-01", 90) + "," + _inactive_sql("cur", AS_OF, 90)))
def c1_merge(spark, sf_dir):
    """Refresh of an earlier lapsed-customer table (first date kept, days refreshed)."""
    v = Views(spark, sf_dir)
    prev = lc.inactive_customers(v.order_tx(), v.customers, "2001-05-01", 90)
    return lc.inactive_customers(v.order_tx(), v.customers, AS_OF, 90, prev=prev).select(
        "customer_id", "last_order_date", "last_product", "inactive_days", "customer_name", "first_inactive_date",
        "reactivated_date")


_C2_CTES = _inactive_sql("ina0", "2001-01-01", 60) + f""",
ina2 AS (SELECT i.*, r.new_date FROM ina0 i LEFT JOIN (
           SELECT i2.customer_id, MIN(t.transaction_date) AS new_date
           FROM ina0 i2 JOIN order_tx t ON t.customer_id = i2.customer_id
           WHERE t.document_type = '{SALE}' AND t.transaction_date <= DATE '{AS_OF}'
             AND t.transaction_date > i2.last_order_date GROUP BY 1) r ON i.customer_id = r.customer_id)"""


@query("C2", osql("""
SELECT customer_id, CAST(last_order_date AS VARCHAR) AS last_order_date, CAST(new_date AS VARCHAR) AS reactivated_date
FROM ina2""", ctes=_C2_CTES))
def c2_reactivated(spark, sf_dir):
    """Customers lapsed (60+ days) on 2001-01-01 that ordered again by 2001-08-01."""
    v = Views(spark, sf_dir)
    ina = lc.inactive_customers(v.order_tx(), v.customers, "2001-01-01", 60)
    return lc.reactivated(ina, v.order_tx(), AS_OF).select("customer_id", "last_order_date", "reactivated_date")


@query("A23", osql("""
SELECT COUNT(*) AS total, count_if(first_inactive_date = DATE '2001-08-01') AS created_today,
       count_if(new_date >= DATE '2001-08-01') AS reactivated_this_month, count_if(processed) AS processed,
       count_if(NOT processed) AS unprocessed, count_if(inactive_days <= 60) AS days_le_60,
       count_if(inactive_days > 60 AND inactive_days <= 90) AS days_61_90,
       count_if(inactive_days > 90 AND inactive_days <= 180) AS days_91_180, count_if(inactive_days > 180) AS days_gt_180
FROM ina2""", ctes=_C2_CTES))
def a23_inactive_stats(spark, sf_dir):
    """Lapse statistics of the C2 table on 2001-08-01."""
    v = Views(spark, sf_dir)
    ina = lc.reactivated(lc.inactive_customers(v.order_tx(), v.customers, "2001-01-01", 60), v.order_tx(), AS_OF)
    return lc.inactive_stats(ina, AS_OF)


_ORD = """op AS (SELECT o.*, pm.name_zh AS product_name FROM incoming_orders o
               LEFT JOIN product_master pm ON o.product_id = pm.product_id)"""

_REM = """{name} AS (
  SELECT customer_id, product_name,
         arg_max_null(customer_name, (created_at, id)) AS customer_name, arg_max_null(line_id, (created_at, id)) AS line_id,
         MAX(created_at) AS last_purchase_date,
         CAST(floor((epoch(TIMESTAMP '{now}') - epoch(MAX(created_at))) / 86400) AS BIGINT) AS days_since_purchase,
         FALSE AS reminder_sent, TIMESTAMP '{now}' AS created_at
  FROM op WHERE is_new_product AND customer_id IS NOT NULL AND product_name IS NOT NULL
    AND created_at <= TIMESTAMP '{now}' - INTERVAL 1 DAY {extra}
  GROUP BY customer_id, product_name)"""

_REM_OUT = """customer_id, customer_name, line_id, product_name, CAST(last_purchase_date AS VARCHAR) AS last_purchase_date,
       days_since_purchase, reminder_sent"""


def _rem_sql(name, now, extra=""):
    return _REM.format(name=name, now=now, extra=extra)


def _orders(v):
    return lc.order_products(v.incoming_orders, v.product_master)


def _old_reminders(v):
    return lc.create_reminders(_orders(v), None, REM_AS_OF)


@query("C3", osql(f"SELECT {_REM_OUT} FROM rem", ctes=_ORD + "," + _rem_sql("rem", NOW)))
def c3_create_reminders(spark, sf_dir):
    """Reminders for new-product purchases older than a day, newest per pair."""
    v = Views(spark, sf_dir)
    return lc.create_reminders(_orders(v), None, NOW).select(
        "customer_id", "customer_name", "line_id", "product_name", "last_purchase_date", "days_since_purchase",
        "reminder_sent")


@query("C3_incremental", osql(f"SELECT {_REM_OUT} FROM rem2", ctes=_ORD + "," + _rem_sql("rem1", REM_AS_OF) + ","
                             + _rem_sql("rem2", NOW, "AND (customer_id, product_name) NOT IN "
                                                     "(SELECT (customer_id, product_name) FROM rem1)")))
def c3_incremental(spark, sf_dir):
    """C3 + J12: only pairs without an existing reminder get a new one."""
    v = Views(spark, sf_dir)
    return lc.create_reminders(_orders(v), _old_reminders(v), NOW).select(
        "customer_id", "customer_name", "line_id", "product_name", "last_purchase_date", "days_since_purchase",
        "reminder_sent")


_AGED = _ORD + "," + _rem_sql("rem1", REM_AS_OF) + f""",
aged AS (SELECT * REPLACE (CASE WHEN NOT reminder_sent AND last_purchase_date IS NOT NULL
                                THEN CAST(round((epoch(TIMESTAMP '{NOW}') - epoch(last_purchase_date)) / 86400) AS BIGINT)
                                ELSE days_since_purchase END AS days_since_purchase) FROM rem1)"""


@query("C4", osql(f"SELECT {_REM_OUT} FROM aged", ctes=_AGED))
def c4_age_reminders(spark, sf_dir):
    """C4: unsent reminders aged to the as-of time."""
    v = Views(spark, sf_dir)
    return lc.age_reminders(_old_reminders(v), NOW).select(
        "customer_id", "customer_name", "line_id", "product_name", "last_purchase_date", "days_since_purchase",
        "reminder_sent")


@query("C5", osql("""
SELECT r.customer_id, r.product_name, (NOT r.reminder_sent AND COALESCE(l.lo > r.last_purchase_date, FALSE)) AS repurchased,
       (r.reminder_sent OR COALESCE(l.lo > r.last_purchase_date, FALSE)) AS reminder_sent
FROM rem1 r LEFT JOIN (SELECT customer_id, product_name, MAX(created_at) AS lo FROM op WHERE customer_id IS NOT NULL
                       GROUP BY 1, 2) l
  ON r.customer_id = l.customer_id AND r.product_name = l.product_name""", ctes=_ORD + "," + _rem_sql("rem1", REM_AS_OF)))
def c5_close_reminders(spark, sf_dir):
    """Reminders closed by a later order of the same pair."""
    v = Views(spark, sf_dir)
    return lc.close_reminders(_old_reminders(v), _orders(v)).select(
        "customer_id", "product_name", "repurchased", "reminder_sent")


@query("A22", osql("""
SELECT day_range, COUNT(*) AS count, MIN(days_since_purchase) AS min_days FROM (
  SELECT *, CASE WHEN days_since_purchase BETWEEN 1 AND 7 THEN '1-7天' WHEN days_since_purchase BETWEEN 8 AND 15 THEN '8-15天'
                 WHEN days_since_purchase BETWEEN 16 AND 30 THEN '16-30天' WHEN days_since_purchase > 30 THEN '30天以上' END
              AS day_range
  FROM aged WHERE NOT reminder_sent AND days_since_purchase > 0) GROUP BY 1""", ctes=_AGED))
def a22_reminder_stats(spark, sf_dir):
    """Open reminders per day range."""
    v = Views(spark, sf_dir)
    return lc.reminder_stats(lc.age_reminders(_old_reminders(v), NOW))


@query("A22_totals", osql(f"""
SELECT count_if(NOT reminder_sent) AS open_total,
       count_if(CAST(created_at + INTERVAL 8 HOUR AS DATE) = DATE '{AS_OF}') AS created_today FROM rem""",
    ctes=_ORD + "," + _rem_sql("rem", NOW)))
def a22_totals(spark, sf_dir):
    """Open reminders and those created today (business clock)."""
    v = Views(spark, sf_dir)
    return lc.reminder_totals(lc.create_reminders(_orders(v), None, NOW), AS_OF)


@query("SNK9", osql(f"SELECT {_REM_OUT} FROM rem WHERE last_purchase_date > TIMESTAMP '{NOW}' - INTERVAL 365 DAY",
                    ctes=_ORD + "," + _rem_sql("rem", NOW)))
def snk9_purge(spark, sf_dir):
    """SNK9: reminders whose purchase is older than a year are purged."""
    v = Views(spark, sf_dir)
    r = lc.create_reminders(_orders(v), None, NOW)
    return lc.purge(r, "last_purchase_date", NOW, 365).select(
        "customer_id", "customer_name", "line_id", "product_name", "last_purchase_date", "days_since_purchase",
        "reminder_sent")


@query("C6", osql(f"""
SELECT o.id, CASE WHEN o.status = '1' THEN (f.fd IS NULL OR f.fd >= CAST(o.created_at AS DATE)) ELSE FALSE END
       AS is_new_product
FROM incoming_orders o LEFT JOIN (SELECT customer_id, product_id, MIN(transaction_date) AS fd FROM order_tx
                                  WHERE document_type = '{SALE}' GROUP BY 1, 2) f
  ON o.customer_id = f.customer_id AND o.product_id = f.product_id"""))
def c6_flag_new_product(spark, sf_dir):
    """Confirmed orders flagged new when the pair was never bought before."""
    v = Views(spark, sf_dir)
    return lc.flag_new_product(v.incoming_orders, v.order_tx()).select("id", "is_new_product")


@query("C7", osql(f"""
SELECT * EXCLUDE (h, n8, n16, n32), substr(h, 1, CASE WHEN n8 = 1 THEN 8 WHEN n16 = 1 THEN 16 WHEN n32 = 1 THEN 32 ELSE 64 END) AS transaction_id,
       n8 > 1 AS id_collision FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY substr(h, 1, 8)) AS n8, COUNT(*) OVER (PARTITION BY substr(h, 1, 16)) AS n16,
         COUNT(*) OVER (PARTITION BY substr(h, 1, 32)) AS n32 FROM (
  SELECT sha256(CAST(o.id AS VARCHAR) || '|1') AS h, o.id AS source_order_id, o.customer_id,
         o.product_id, CAST(CAST(o.created_at AS DATE) AS VARCHAR) AS transaction_date, '{SALE}' AS document_type,
         CAST(o.quantity AS DOUBLE) AS quantity, o.unit_price, CAST(o.amount AS DOUBLE) AS amount
  FROM incoming_orders o WHERE o.status = '1' AND o.customer_id IN (SELECT customer_id FROM customers)))"""))
def c7_confirm_orders(spark, sf_dir):
    """Confirmed orders of known customers as transaction rows."""
    v = Views(spark, sf_dir)
    return lc.confirm_orders(v.incoming_orders, v.customers)[0]


@query("C7_unknown", osql("""
SELECT id FROM incoming_orders o WHERE o.status = '1'
  AND NOT EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = o.customer_id)"""))
def c7_unknown(spark, sf_dir):
    """Confirmed orders whose customer is unknown (set aside)."""
    v = Views(spark, sf_dir)
    return lc.confirm_orders(v.incoming_orders, v.customers)[1].select("id")


_DS = """days_of AS (SELECT customer_id, customer_name AS cname,
        list_sort(list_distinct(list_filter(list_transform(string_split(delivery_schedule, ','),
              lambda x: TRY_CAST(trim(x) AS INTEGER)), lambda x: x BETWEEN 1 AND 7))) AS days FROM customers),
ds AS (SELECT 'O' || CAST(o.id AS VARCHAR) AS delivery_id, o.customer_id, COALESCE(o.customer_name, d.cname) AS customer_name,
              o.product_id, o.product_name,
              CASE WHEN len(d.days) > 0 THEN CAST(list_filter(
                   generate_series(CAST(COALESCE(o.confirmed_at, o.created_at) AS DATE) + INTERVAL 1 DAY,
                                   CAST(COALESCE(o.confirmed_at, o.created_at) AS DATE) + INTERVAL 7 DAY, INTERVAL 1 DAY),
                   lambda x: list_contains(d.days, isodow(x)))[1] AS DATE) END AS delivery_date,
              o.amount, o.quantity, 'order' AS status, CAST(o.id AS VARCHAR) AS source_order_id
       FROM op o JOIN days_of d ON o.customer_id = d.customer_id WHERE o.status = '1')"""

_DS_OUT = """delivery_id, customer_id, customer_name, product_id, product_name, CAST(delivery_date AS VARCHAR) AS delivery_date,
       CAST(amount AS DOUBLE) AS amount, CAST(quantity AS DOUBLE) AS quantity, status, source_order_id"""


def _ds(v):
    return lc.schedule_delivery(_orders(v), v.customers)


@query("S5_batch", osql(f"SELECT {_DS_OUT} FROM ds", ctes=_ORD + "," + _DS))
def s5_schedule_delivery(spark, sf_dir):
    """S5 (batch form): confirmed orders → delivery rows on the next scheduled weekday."""
    return _ds(Views(spark, sf_dir))


@query("F14", osql(f"""
SELECT {_DS_OUT} FROM ds WHERE status = 'order' AND delivery_date >= DATE '2001-01-01' AND delivery_date <= DATE '2001-03-31'""",
    ctes=_ORD + "," + _DS))
def f14_deliveries(spark, sf_dir):
    """deliveries of orders in Q1 2001, ordered."""
    return lc.deliveries(_ds(Views(spark, sf_dir)), status="order", start="2001-01-01", end="2001-03-31")


@query("J7", osql(f"""
SELECT d.delivery_id, COALESCE(o.customer_name, 'N/A') AS order_customer_name, COALESCE(o.status, 'N/A') AS order_status
FROM ds d LEFT JOIN incoming_orders o ON d.source_order_id = CAST(o.id AS VARCHAR)""", ctes=_ORD + "," + _DS))
def j7_delivery_orders(spark, sf_dir):
    """Deliveries joined to their source order through the id as text."""
    v = Views(spark, sf_dir)
    return cat.delivery_orders(_ds(v), v.incoming_orders).select("delivery_id", "order_customer_name", "order_status")


@query("J8", osql("""
SELECT d.delivery_id, n.category
FROM ds d LEFT JOIN (SELECT DISTINCT name_zh, category FROM product_master) n ON d.product_name = n.name_zh
WHERE n.category = 'PROMO'""", ctes=_ORD + "," + _DS))
def j8_delivery_category(spark, sf_dir):
    """Deliveries joined to products through the product name, one category."""
    v = Views(spark, sf_dir)
    return cat.delivery_category(_ds(v), v.product_master, "PROMO").select("delivery_id", "category")


@query("A24", osql("""
SELECT COUNT(DISTINCT customer_id) AS customers,
       SUM(CASE WHEN quantity = floor(quantity) THEN CAST(quantity AS BIGINT) ELSE 0 END) AS total_quantity
FROM ds WHERE delivery_date = DATE '1998-06-02'""".replace("SUM(CASE", "CAST(SUM(CASE").replace(
    "ELSE 0 END) AS total_quantity", "ELSE 0 END) AS BIGINT) AS total_quantity"), ctes=_ORD + "," + _DS))
def a24_delivery_card(spark, sf_dir):
    """One day's delivery card: customers and total quantity."""
    return lc.delivery_stats(_ds(Views(spark, sf_dir)), "1998-06-02")[0]


@query("A24_products", osql("""
SELECT product_name, CAST(SUM(CASE WHEN quantity = floor(quantity) THEN CAST(quantity AS BIGINT) ELSE 0 END) AS BIGINT)
       AS quantity
FROM ds WHERE delivery_date = DATE '1998-06-02' AND trim(COALESCE(product_name, '')) <> '' GROUP BY 1""",
    ctes=_ORD + "," + _DS))
def a24_delivery_products(spark, sf_dir):
    """One day's quantity per product."""
    return lc.delivery_stats(_ds(Views(spark, sf_dir)), "1998-06-02")[1]
