"""Registered filter / join / ordering / set queries (F*, J*, T*, W1–W2, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.constants import ALL_CATEGORIES, AS_OF_REPLEN, SALE
from ledgerflow.operators import catalog as cat
from ledgerflow.plans.registry import query
from ledgerflow.sources.views import Views, osql


@query("F2", osql("""
SELECT product_id, category, subcategory FROM product_master WHERE category IN ('PROMO', 'SMALL')"""))
def f2_filter_level(spark, sf_dir):
    """products of chosen categories."""
    v = Views(spark, sf_dir)
    return cat.filter_level(v.product_master, "category", ["PROMO", "SMALL"]).select("product_id", "category", "subcategory")


@query("F3", osql("""
SELECT customer_id, customer_name, city FROM customers WHERE city = 'ASIA'"""))
def f3_optional_filters(spark, sf_dir):
    """only the given filters apply ('all categories' and None are no filter)."""
    v = Views(spark, sf_dir)
    return cat.optional_filters(v.customers, city="ASIA", notes=ALL_CATEGORIES, customer_id=None).select(
        "customer_id", "customer_name", "city")


@query("F4", osql("""
SELECT id, CAST(created_at AS VARCHAR) AS created_at FROM incoming_orders
WHERE created_at >= TIMESTAMP '1998-01-01' AND created_at < TIMESTAMP '1998-02-01'"""))
def f4_between_days(spark, sf_dir):
    """orders created in January 1998, whole end day included."""
    v = Views(spark, sf_dir)
    return cat.between_days(v.incoming_orders, "created_at", "1998-01-01", "1998-01-31").select("id", "created_at")


@query("F5", osql("""
SELECT id, status FROM incoming_orders
WHERE status = '0'
   OR (status = '1' AND (confirmed_at IS NULL OR TIMESTAMP '2001-07-20 12:00:00' < confirmed_at + INTERVAL 1 DAY))
   OR (status = '2' AND (updated_at IS NULL OR TIMESTAMP '2001-07-20 12:00:00' < updated_at + INTERVAL 1 DAY))"""))
def f5_visible_orders(spark, sf_dir):
    """status-dependent 1-day visibility of incoming orders."""
    v = Views(spark, sf_dir)
    return cat.visible_orders(v.incoming_orders, "2001-07-20 12:00:00").select("id", "status")


@query("F6", osql(f"""
SELECT customer_id, product_id, days_since FROM (
  SELECT customer_id, product_id, date_diff('day', MAX(transaction_date), DATE '2001-08-01') AS days_since
  FROM order_tx WHERE document_type = '{SALE}' GROUP BY 1, 2) WHERE days_since >= 30 AND days_since <= 90"""))
def f6_min_days(spark, sf_dir):
    """pairs whose last purchase was 30 to 90 days before the as-of date."""
    v = Views(spark, sf_dir)
    from ledgerflow.operators.sales import purchase_history
    h = purchase_history(v.order_tx()).select(
        "customer_id", "product_id", F.datediff(F.lit("2001-08-01").cast("date"), "last_purchase").alias("days_since"))
    return cat.min_days(h, "days_since", 30, 90)


@query("F7", osql("""
SELECT product_id, CAST(change_amount AS DOUBLE) AS change_amount FROM (
  SELECT product_id, SUM(CASE WHEN transaction_date >= DATE '2001-07-01' THEN quantity ELSE 0 END)
                   - SUM(CASE WHEN transaction_date < DATE '2001-07-01' THEN quantity ELSE 0 END) AS change_amount
  FROM order_tx WHERE transaction_date >= DATE '2001-06-01' AND transaction_date < DATE '2001-08-01' GROUP BY 1)
WHERE change_amount < 0"""))
def f7_filter_change(spark, sf_dir):
    """products whose July 2001 quantity fell against June."""
    v = Views(spark, sf_dir)
    t = v.order_tx(start="2001-06-01", end="2001-08-01")
    ch = t.groupBy("product_id").agg(
        (F.sum(F.when(F.col("transaction_date") >= F.lit("2001-07-01").cast("date"), F.col("quantity")).otherwise(0))
         - F.sum(F.when(F.col("transaction_date") < F.lit("2001-07-01").cast("date"), F.col("quantity")).otherwise(0)))
        .alias("change_amount"))
    return cat.filter_change(ch, "decrease").select("product_id", "change_amount")


@query("F8", osql("""
SELECT customer_id, missing_phone, missing_address,
       concat_ws(', ', CASE WHEN missing_phone THEN 'missing phone' END,
                       CASE WHEN missing_address THEN 'missing address' END) AS warning
FROM (SELECT customer_id,
             (phone_number IS NULL OR trim(phone_number) IN ('', 'None')) AS missing_phone,
             (address IS NULL OR trim(address) IN ('', 'None')) AS missing_address FROM customers)
WHERE missing_phone OR missing_address"""))
def f8_missing_contact(spark, sf_dir):
    """F8: customers with incomplete contact data and a warning text."""
    v = Views(spark, sf_dir)
    return cat.missing_contact(v.customers, only_missing=True).select(
        "customer_id", "missing_phone", "missing_address", "warning")


@query("F9", osql("""
SELECT id, list_filter([CASE WHEN customer_id IS NULL THEN 'customer_id' END,
                        CASE WHEN customer_name IS NULL OR trim(customer_name) IN ('', 'None') THEN 'customer_name' END,
                        CASE WHEN line_id IS NULL OR trim(line_id) IN ('', 'None') THEN 'line_id' END,
                        CASE WHEN product_id IS NULL THEN 'product_id' END], lambda x: x IS NOT NULL) AS missing_fields
FROM incoming_orders"""))
def f9_missing_required(spark, sf_dir):
    """which required fields are empty, per incoming order."""
    v = Views(spark, sf_dir)
    return cat.missing_required(v.incoming_orders, ["customer_id", "customer_name", "line_id", "product_id"]).select(
        "id", "missing_fields")


_F10_CTES = """
hist AS (SELECT t.customer_id, t.product_id, pm.name_zh AS product_name, t.transaction_id
         FROM order_tx t JOIN product_master pm ON t.product_id = pm.product_id),
tgt AS (SELECT customer_id, arg_max(product_id, (created_at, id)) AS target_product_id,
               arg_max(pm_name, (created_at, id)) AS target_name
        FROM (SELECT o.*, p.name_zh AS pm_name FROM incoming_orders o JOIN product_master p ON o.product_id = p.product_id
              WHERE o.customer_id IS NOT NULL) GROUP BY customer_id),
j AS (SELECT h.*, g.target_product_id, g.target_name,
        CASE WHEN lower(trim(CAST(h.product_id AS VARCHAR))) = lower(trim(CAST(g.target_product_id AS VARCHAR))) THEN 1
             WHEN h.product_name = g.target_name THEN 2
             WHEN instr(lower(h.product_name), lower(g.target_name)) > 0 THEN 3
             WHEN instr(lower(g.target_name), lower(h.product_name)) > 0
               OR (trim(regexp_replace(g.target_name, '^\\S+\\s*', '')) <> ''
                   AND instr(lower(trim(regexp_replace(g.target_name, '^\\S+\\s*', ''))), lower(h.product_name)) > 0) THEN 4
             ELSE 5 END AS tier
      FROM hist h JOIN tgt g ON h.customer_id = g.customer_id)"""


def _f10_targets(v):
    o = v.incoming_orders.filter(F.col("customer_id").isNotNull()).join(
        v.product_master.select("product_id", F.col("name_zh").alias("pm_name")), "product_id")
    return o.groupBy("customer_id").agg(
        F.max_by(F.struct(F.col("product_id").alias("target_product_id"), F.col("pm_name").alias("target_name")),
                 F.struct("created_at", "id")).alias("t")).select("customer_id", "t.*")


@query("F10", osql("""
SELECT customer_id, transaction_id, tier FROM j
WHERE tier = (SELECT MIN(tier) FROM j j2 WHERE j2.customer_id = j.customer_id)""", ctes=_F10_CTES))
def f10_match_history(spark, sf_dir):
    """each customer's history matched to its latest incoming order by tiers."""
    v = Views(spark, sf_dir)
    hist = v.order_tx().join(v.product_master.select("product_id", F.col("name_zh").alias("product_name")), "product_id")
    return cat.match_history(hist, _f10_targets(v)).select("customer_id", "transaction_id", "tier")


@query("F11", osql("""
SELECT customer_id, customer_name FROM customers WHERE instr(lower(customer_name), '00001') > 0"""))
def f11_name_contains(spark, sf_dir):
    """case-insensitive name search."""
    v = Views(spark, sf_dir)
    return cat.name_contains(v.customers, "customer_name", "00001").select("customer_id", "customer_name")


@query("F12", osql("""
SELECT DISTINCT subcategory FROM product_master
WHERE is_active = 'active' AND subcategory IS NOT NULL AND trim(subcategory) NOT IN ('', 'None')"""))
def f12_distinct_values(spark, sf_dir):
    """selectable subcategories of active products."""
    v = Views(spark, sf_dir)
    return cat.distinct_values(v.product_master, "subcategory", F.col("is_active") == "active")


@query("F13", osql("""
SELECT id, customer_id, product_id FROM incoming_orders WHERE is_new_product AND status = '1'"""))
def f13_new_item_orders(spark, sf_dir):
    """confirmed new-product orders."""
    v = Views(spark, sf_dir)
    return cat.new_item_orders(v.incoming_orders).select("id", "customer_id", "product_id")


@query("F16", osql("""
SELECT id, CASE status WHEN '0' THEN 'open' WHEN '1' THEN 'confirmed' WHEN '2' THEN 'deleted' END AS status_text,
       CASE WHEN is_new_product THEN 'yes' ELSE 'no' END AS new_product_text
FROM incoming_orders"""))
def f16_decode_labels(spark, sf_dir):
    """F16: status code and boolean → text."""
    from ledgerflow.functions.misc import decode_labels
    v = Views(spark, sf_dir)
    return v.incoming_orders.select(
        "id", decode_labels("status", {"0": "open", "1": "confirmed", "2": "deleted"}).alias("status_text"),
        F.when(F.col("is_new_product"), F.lit("yes")).otherwise(F.lit("no")).alias("new_product_text"))


@query("F17", osql("""
SELECT customer_id, transaction_id, CAST(transaction_date AS VARCHAR) AS transaction_date, product_id,
       CAST(quantity AS DOUBLE) AS quantity
FROM order_tx WHERE strftime(transaction_date, '%Y-%m') = '2001-07'"""))
def f17_timeline(spark, sf_dir):
    """every customer's July 2001 purchase timeline, oldest first."""
    v = Views(spark, sf_dir)
    return cat.timeline(v.order_tx(), month="2001-07").select(
        "customer_id", "transaction_id", "transaction_date", "product_id", "quantity")


@query("J4", osql("""
SELECT c.customer_id, c.customer_name, CAST(l.d AS VARCHAR) AS last_transaction_date, l.p AS last_product_id
FROM customers c LEFT JOIN (
  SELECT customer_id, arg_max(transaction_date, (transaction_date, transaction_id)) AS d,
         arg_max(product_id, (transaction_date, transaction_id)) AS p
  FROM order_tx GROUP BY 1) l ON c.customer_id = l.customer_id"""))
def j4_customer_latest(spark, sf_dir):
    """J4 + W1: every customer with its latest transaction."""
    v = Views(spark, sf_dir)
    return cat.customer_latest(v.customers, v.order_tx()).select(
        "customer_id", "customer_name", "last_transaction_date", "last_product_id")


@query("J6", osql(f"""
SELECT p.product_id, p.r1 AS recommended_customer_id_rank1, p.r2 AS recommended_customer_id_rank2,
       c1.customer_name AS customer_name_rank1, c1.phone_number AS phone_number_rank1,
       c2.customer_name AS customer_name_rank2, c2.phone_number AS phone_number_rank2
FROM (SELECT product_id, MAX(CASE WHEN rank = 1 THEN customer_id END) AS r1, MAX(CASE WHEN rank = 2 THEN customer_id END) AS r2
      FROM (SELECT product_id, customer_id,
                   row_number() OVER (PARTITION BY product_id ORDER BY SUM(quantity) DESC, customer_id) AS rank
            FROM order_tx WHERE document_type = '{SALE}' GROUP BY 1, 2) WHERE rank <= 2 GROUP BY 1) p
LEFT JOIN customers c1 ON p.r1 = c1.customer_id LEFT JOIN customers c2 ON p.r2 = c2.customer_id"""))
def j6_attach_ranked(spark, sf_dir):
    """Names and phones of the rank-1 and rank-2 buyers per product (one join)."""
    from ledgerflow.operators.sales import pivot_ranks
    v = Views(spark, sf_dir)
    t = v.order_tx().filter(F.col("document_type") == SALE)
    g = t.groupBy("product_id", "customer_id").agg(F.sum("quantity").alias("q"))
    top = cat.top_k_per(g, ["product_id"], [F.col("q").desc(), F.col("customer_id").asc()], 2)
    wide = pivot_ranks(top, "product_id", "customer_id", 2, "recommended_customer_id_rank")
    return cat.attach_ranked(wide, "product_id", "recommended_customer_id_rank", 2, v.customers, "customer_id",
                             ["customer_name", "phone_number"])


@query("J10", osql("""
SELECT o.id, (c.customer_id IS NOT NULL) AS customer_known, (p.product_id IS NOT NULL) AS product_known,
       (c.customer_id IS NOT NULL AND p.product_id IS NOT NULL) AS valid
FROM incoming_orders o LEFT JOIN (SELECT DISTINCT customer_id FROM customers) c ON o.customer_id = c.customer_id
LEFT JOIN (SELECT DISTINCT product_id FROM product_master) p ON o.product_id = p.product_id"""))
def j10_split_known(spark, sf_dir):
    """Incoming orders flagged by known customer / product."""
    v = Views(spark, sf_dir)
    return cat.split_known(v.incoming_orders, v.customers, v.product_master).select(
        "id", "customer_known", "product_known", "valid")


@query("J10_counts", osql("""
SELECT COUNT(*) AS input_rows, count_if(valid) AS valid_rows, count_if(NOT valid) AS skipped_rows,
       count_if(NOT ck) AS unknown_customer_rows, count_if(NOT pk) AS unknown_product_rows
FROM (SELECT (c.customer_id IS NOT NULL) AS ck, (p.product_id IS NOT NULL) AS pk,
             (c.customer_id IS NOT NULL AND p.product_id IS NOT NULL) AS valid
      FROM incoming_orders o LEFT JOIN (SELECT DISTINCT customer_id FROM customers) c ON o.customer_id = c.customer_id
      LEFT JOIN (SELECT DISTINCT product_id FROM product_master) p ON o.product_id = p.product_id)"""))
def j10_counts(spark, sf_dir):
    """Valid + skipped = input."""
    v = Views(spark, sf_dir)
    return cat.split_counts(cat.split_known(v.incoming_orders, v.customers, v.product_master))


@query("J11", osql("""
SELECT line_id, arg_min_null(customer_name, (created_at, id)) AS customer_name, arg_min_null(id, (created_at, id)) AS id
FROM incoming_orders o WHERE line_id IS NOT NULL
  AND line_id NOT IN (SELECT line_id FROM customers WHERE line_id IS NOT NULL
                        AND customer_id IN (SELECT customer_id FROM chat_messages WHERE customer_id IS NOT NULL))
GROUP BY line_id"""))
def j11_missing_members(spark, sf_dir):
    """Chat ids seen in incoming orders that the chat-id map (customers who wrote
    in a chat) lacks, with first-seen attributes."""
    v = Views(spark, sf_dir)
    dim = v.customers.filter(F.col("line_id").isNotNull()).join(v.chat_messages.select("customer_id"), "customer_id", "left_semi")
    return cat.missing_members(v.incoming_orders, dim, "line_id", ["customer_name", "id"], ["created_at", "id"])


@query("J14", osql("""
SELECT p.product_id, p.subcategory, c.sibling_count
FROM (SELECT DISTINCT product_id, subcategory FROM product_master WHERE subcategory IS NOT NULL AND trim(subcategory) NOT IN ('', 'None')) p
JOIN (SELECT subcategory, COUNT(*) AS sibling_count FROM (SELECT DISTINCT product_id, subcategory FROM product_master) GROUP BY 1) c
  ON p.subcategory = c.subcategory"""))
def j14_sibling_products(spark, sf_dir):
    """Product → subcategory (siblings reached through the key, no pair list)."""
    v = Views(spark, sf_dir)
    return cat.sibling_products(v.product_master)


@query("J15", osql("""
SELECT o.id, o.customer_id, o.product_id, pm.subcategory
FROM incoming_orders o JOIN product_master pm ON o.product_id = pm.product_id
WHERE EXISTS (SELECT 1 FROM order_tx t JOIN product_master p2 ON t.product_id = p2.product_id
              WHERE t.customer_id = o.customer_id AND p2.subcategory = pm.subcategory AND t.document_type = '銷貨')"""))
def j15_purchased_by_subcategory(spark, sf_dir):
    """Incoming orders whose customer bought the product's subcategory."""
    v = Views(spark, sf_dir)
    c = v.incoming_orders.select("id", "customer_id", "product_id")
    bought = v.order_tx().filter(F.col("document_type") == SALE)
    return cat.purchased_by_subcategory(c, bought, v.product_master).select(
        "id", "customer_id", "product_id", "subcategory")


@query("J17", osql(f"""
SELECT p.customer_id, p.product_id, CAST(d.target_date AS VARCHAR) AS target_date
FROM (SELECT DISTINCT customer_id, product_id FROM replen_tx) p,
     (SELECT CAST(unnest(generate_series(DATE '{AS_OF_REPLEN}', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS target_date) d
WHERE isodow(d.target_date) <> 7"""))
def j17_pair_days(spark, sf_dir):
    """Pairs × the next 7 target days without Sundays."""
    v = Views(spark, sf_dir)
    pairs = v.replen_tx.select("customer_id", "product_id").distinct()
    return cat.pair_days(pairs, AS_OF_REPLEN, "2024-02-05")


@query("J18", osql("""
SELECT CAST(s.sample_date AS VARCHAR) AS sample_date, role, COUNT(*) AS rows_in_window,
       CAST(SUM(t.quantity) AS DOUBLE) AS quantity
FROM replen_tx_long t,
     (SELECT CAST(unnest(generate_series(DATE '2000-01-01', DATE '2001-07-01', INTERVAL 15 DAY)) AS DATE) AS sample_date) s,
     (VALUES ('history'), ('label')) r(role)
WHERE (role = 'history' AND t.transaction_date >= s.sample_date - 90 AND t.transaction_date < s.sample_date)
   OR (role = 'label' AND t.transaction_date >= s.sample_date AND t.transaction_date < s.sample_date + 7)
GROUP BY 1, 2"""))
def j18_sample_windows(spark, sf_dir):
    """Rows per sample date (every 15 days) in the 90-day history and 7-day label
    windows."""
    v = Views(spark, sf_dir)
    s = cat.sample_windows(v.replen_tx_long(), "2000-01-01", "2001-07-01", 15)
    return s.groupBy("sample_date", "role").agg(F.count("*").alias("rows_in_window"),
                                                F.sum("quantity").alias("quantity"))


@query("J19", osql("""
SELECT o.id, COALESCE(c.notes, '') AS customer_notes FROM incoming_orders o LEFT JOIN customers c ON o.customer_id = c.customer_id"""))
def j19_attach_notes(spark, sf_dir):
    """Customer notes on every incoming order ('' if none)."""
    v = Views(spark, sf_dir)
    return cat.attach_notes(v.incoming_orders, v.customers).select("id", "customer_notes")


@query("J20", osql("""
SELECT pp.customer_id, pp.product_id, CAST(d.target_date AS VARCHAR) AS target_date
FROM (SELECT DISTINCT customer_id, product_id FROM replen_tx) pp,
     (SELECT CAST(unnest(generate_series(DATE '2024-01-10', DATE '2024-01-16', INTERVAL 1 DAY)) AS DATE) AS target_date) d
WHERE EXISTS (SELECT 1 FROM replen_tx t WHERE t.customer_id = pp.customer_id AND t.product_id = pp.product_id
              AND abs(date_diff('day', t.transaction_date, d.target_date)) <= 2)"""))
def j20_hits_within(spark, sf_dir):
    """Pair-days that have a purchase of the pair within ±2 days."""
    v = Views(spark, sf_dir)
    pairs = v.replen_tx.select("customer_id", "product_id").distinct()
    pred = cat.pair_days(pairs, "2024-01-10", "2024-01-16", skip_sunday=False)
    return cat.hits_within(pred, v.replen_tx, 2, "target_date")


@query("J21", osql("""
SELECT o.id, o.line_id, m.customer_id AS mapped_customer_id, (m.customer_id IS NOT NULL) AS mapped
FROM incoming_orders o LEFT JOIN (SELECT line_id, customer_id FROM customers WHERE line_id IS NOT NULL) m ON o.line_id = m.line_id"""))
def j21_line_map(spark, sf_dir):
    """Chat id → customer id with existence flag."""
    v = Views(spark, sf_dir)
    return cat.line_map(v.incoming_orders.select("id", "line_id"), v.customers).select(
        "id", "line_id", "mapped_customer_id", "mapped")


@query("T1", osql("""
SELECT r.customer_id, r.customer_name, t.total_count, CAST(ceil(t.total_count / 20.0) AS BIGINT) AS pages,
       (3 * 20 < t.total_count) AS has_next, TRUE AS has_prev
FROM (SELECT customer_id, customer_name FROM customers ORDER BY customer_name DESC, customer_id LIMIT 20 OFFSET 40) r,
     (SELECT COUNT(*) AS total_count FROM customers) t"""))
def t1_page(spark, sf_dir):
    """Third page of 20 customers by name desc, with totals."""
    v = Views(spark, sf_dir)
    return cat.page(v.customers.select("customer_id", "customer_name"),
                    [F.col("customer_name").desc(), F.col("customer_id")], 3, 20)


@query("T2", osql("""
SELECT customer_id, product_id, purchase_count, rank FROM (
  SELECT customer_id, product_id, COUNT(*) AS purchase_count,
         row_number() OVER (PARTITION BY customer_id ORDER BY COUNT(*) DESC, product_id) AS rank
  FROM replen_tx_long GROUP BY 1, 2) WHERE rank <= 3"""))
def t2_top_products(spark, sf_dir):
    """Three most bought categories per customer."""
    v = Views(spark, sf_dir)
    return cat.top_products_by_count(v.replen_tx_long(), 3)


@query("T3", osql("""
SELECT customer_id, product_id, COUNT(*) AS purchase_count FROM replen_tx_long GROUP BY 1, 2
ORDER BY purchase_count DESC, customer_id, product_id LIMIT 500"""))
def t3_cap_pairs(spark, sf_dir):
    """The 500 most active pairs."""
    v = Views(spark, sf_dir)
    return cat.cap_pairs(v.replen_tx_long(), 500)


@query("T4", osql("""
SELECT id, status, CAST(created_at AS VARCHAR) AS created_at FROM incoming_orders"""))
def t4_ordered(spark, sf_dir):
    """T4: incoming orders by status, newest first, id."""
    v = Views(spark, sf_dir)
    return cat.ordered(v.incoming_orders.select("id", "status", "created_at"),
                       ["status", F.col("created_at").desc(), "id"])


@query("T5", osql("""
SELECT customer_id, CAST(last_purchase AS VARCHAR) AS last_purchase FROM (
  SELECT customer_id, MAX(transaction_date) AS last_purchase FROM order_tx GROUP BY 1)"""))
def t5_sort_by(spark, sf_dir):
    """T5: customers sorted by last purchase date (text sorted as date), descending."""
    v = Views(spark, sf_dir)
    d = v.order_tx().groupBy("customer_id").agg(F.max("transaction_date").cast("string").alias("last_purchase"))
    return cat.sort_by(d, "last_purchase", ascending=False, as_date=True)


@query("W2", osql("""
SELECT customer_id, product_id, id, CAST(created_at AS VARCHAR) AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id, product_id ORDER BY created_at DESC, id DESC) AS rn
  FROM incoming_orders WHERE customer_id IS NOT NULL) WHERE rn = 1"""))
def w2_distinct_on(spark, sf_dir):
    """Newest incoming order per (customer, product)."""
    v = Views(spark, sf_dir)
    o = v.incoming_orders.filter(F.col("customer_id").isNotNull())
    return cat.latest_per(o, ["customer_id", "product_id"], "created_at", ["id"]).select(
        "customer_id", "product_id", "id", "created_at")


@query("U1", osql("""
SELECT DISTINCT customer_id, product_id FROM replen_tx_long WHERE transaction_date < DATE '2001-01-01'
EXCEPT SELECT customer_id, product_id FROM replen_tx_long WHERE transaction_date >= DATE '2001-01-01'"""))
def u1_pair_diff(spark, sf_dir):
    """Pairs bought before 2001 but not since."""
    v = Views(spark, sf_dir)
    t = v.replen_tx_long()
    a = t.filter(F.col("transaction_date") < F.lit("2001-01-01").cast("date"))
    b = t.filter(F.col("transaction_date") >= F.lit("2001-01-01").cast("date"))
    return cat.pair_diff(a, b, ["customer_id", "product_id"])


@query("U2", osql("""
SELECT DISTINCT customer_id, product_id FROM replen_tx_long WHERE transaction_date < DATE '2001-01-01'
INTERSECT SELECT customer_id, product_id FROM replen_tx_long WHERE transaction_date >= DATE '2001-01-01'"""))
def u2_pair_intersect(spark, sf_dir):
    """Pairs bought both before 2001 and since."""
    v = Views(spark, sf_dir)
    t = v.replen_tx_long()
    a = t.filter(F.col("transaction_date") < F.lit("2001-01-01").cast("date"))
    b = t.filter(F.col("transaction_date") >= F.lit("2001-01-01").cast("date"))
    return cat.pair_intersect(a, b, ["customer_id", "product_id"])


@query("U3", osql("""
SELECT customer_id, 'inquiry' AS source, NULL AS product_id FROM chat_messages WHERE sender_type = 'User' AND customer_id IS NOT NULL
UNION ALL SELECT customer_id, 'order' AS source, product_id FROM incoming_orders WHERE customer_id IS NOT NULL"""))
def u3_union_sources(spark, sf_dir):
    """Union by name with missing columns as null."""
    v = Views(spark, sf_dir)
    a = v.chat_messages.filter((F.col("sender_type") == "User") & F.col("customer_id").isNotNull()).select(
        "customer_id", F.lit("inquiry").alias("source"))
    b = v.incoming_orders.filter(F.col("customer_id").isNotNull()).select(
        "customer_id", F.lit("order").alias("source"), "product_id")
    return cat.union_sources(a, b)
