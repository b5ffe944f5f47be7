"""Registered import / merge queries (SRC1, SRC2, SRC6, SNK3–SNK8) and scalar functions (X*)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow.constants import RETURN, SALE
from ledgerflow.functions import calendar as cal
from ledgerflow.functions import misc as fm
from ledgerflow.functions import text as ft
from ledgerflow.operators import replenish as rp
from ledgerflow.plans.registry import query
from ledgerflow.session import sub_checkpoint
from ledgerflow.sources import ingest as ig
from ledgerflow.sources.versions import VersionedTable
from ledgerflow.sources.views import Views, osql


# ----------------------------------------------------------------- sheet adapters
def sales_sheet(v):
    """Test adapter: order lines laid out as ERP sales-sheet rows (text cells).  The
    customer and currency are written on the first line of an order only ('same as
    above' below); some dates / quantities / prices are blank."""
    li = v.raw("lineitem")
    o = v.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    j = li.withColumn("rn", F.row_number().over(w)).join(o, li.l_orderkey == o.o_orderkey)
    k, rn = F.col("l_orderkey"), F.col("rn")
    first = rn == 1
    date = F.when((k % 11 == 0) & (rn == 2), F.lit("")).when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")) \
            .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return j.select(
        F.concat(F.lit("sheet_"), (k % 4).cast("string")).alias("file"),
        F.when(k == 0, rn).otherwise(F.lit(8) + k * 16 + rn).alias("row_no"),
        F.when(first, F.col("o_custkey").cast("string")).otherwise(F.lit("")).alias("A"),
        F.col("l_partkey").cast("string").alias("F"),
        F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("K"),
        date.alias("N"),
        F.when(F.col("l_returnflag") == "R", F.lit(RETURN)).otherwise(F.lit(SALE)).alias("Q"),
        F.when((k % 13 == 0) & first, F.lit("")).otherwise(F.col("l_quantity").cast("decimal(18,0)").cast("string"))
         .alias("S"),
        F.when(rn == 2, F.lit("")).otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("V"),
        F.when(first, F.lit("TWD")).otherwise(F.lit("")).alias("Y"),
        F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2).alias("Z"))


_SHEET = f"""
li AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem l),
sheet AS (SELECT 'sheet_' || CAST(l_orderkey % 4 AS VARCHAR) AS file,
                 CASE WHEN l_orderkey = 0 THEN rn ELSE 8 + l_orderkey * 16 + rn END AS row_no,
                 CASE WHEN rn = 1 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS A, CAST(l_partkey AS VARCHAR) AS F,
                 'item ' || CAST(l_partkey AS VARCHAR) AS K,
                 CASE WHEN l_orderkey % 11 = 0 AND rn = 2 THEN '' WHEN l_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                      ELSE strftime(o_orderdate, '%Y/%m/%d') END AS N,
                 CASE WHEN l_returnflag = 'R' THEN '{RETURN}' ELSE '{SALE}' END AS Q,
                 CASE WHEN l_orderkey % 13 = 0 AND rn = 1 THEN '' ELSE CAST(CAST(l_quantity AS DECIMAL(18,0)) AS VARCHAR) END AS S,
                 CASE WHEN rn = 2 THEN '' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS V,
                 CASE WHEN rn = 1 THEN 'TWD' ELSE '' END AS Y,
                 format('{{:,.2f}}', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE)) AS Z
          FROM li JOIN orders o ON li.l_orderkey = o.o_orderkey),
s8 AS (SELECT file, row_no, NULLIF(trim(A), '') AS customer_id, NULLIF(trim(F), '') AS product_id,
              NULLIF(trim(K), '') AS product_name, N, Q AS document_type, S, V, NULLIF(trim(Y), '') AS currency, Z
       FROM sheet WHERE row_no >= 8),
filled AS (SELECT file, row_no,
                  last_value(customer_id IGNORE NULLS) OVER w AS customer_id, last_value(product_id IGNORE NULLS) OVER w AS product_id,
                  last_value(product_name IGNORE NULLS) OVER w AS product_name, last_value(currency IGNORE NULLS) OVER w AS currency,
                  COALESCE(TRY_STRPTIME(trim(N), '%Y-%m-%d'), TRY_STRPTIME(trim(N), '%Y/%m/%d')) AS ts, document_type,
                  CASE WHEN trim(S) IN ('', '---') THEN NULL ELSE TRY_CAST(replace(trim(S), ',', '') AS DECIMAL(18,4)) END AS quantity,
                  CASE WHEN trim(V) IN ('', '---') THEN NULL ELSE TRY_CAST(replace(trim(V), ',', '') AS DECIMAL(18,4)) END AS unit_price,
                  CASE WHEN trim(Z) IN ('', '---') THEN NULL ELSE TRY_CAST(replace(trim(Z), ',', '') AS DECIMAL(18,4)) END AS amount
           FROM s8 WINDOW w AS (PARTITION BY file ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("SRC1", osql("""
SELECT file, row_no, customer_id, product_id, product_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS transaction_date,
       document_type, CAST(quantity AS DOUBLE) AS quantity, CAST(COALESCE(unit_price, 0) AS DOUBLE) AS unit_price,
       currency, CAST(COALESCE(amount, 0) AS DOUBLE) AS amount
FROM filled WHERE ts IS NOT NULL AND quantity IS NOT NULL""", ctes=_SHEET))
def src1_clean_sales(spark, sf_dir):
    """SRC1: sales sheet rows cleaned (forward fill, required date and quantity)."""
    v = Views(spark, sf_dir)
    return ig.clean_sales(sales_sheet(v), block_rows=4096).select(
        "file", "row_no", "customer_id", "product_id", "product_name", "transaction_date", "document_type", "quantity",
        "unit_price", "currency", "amount")


def stock_sheet(v):
    """Test adapter: parts as stock-sheet rows with '1,234', '---', blank and 'abc' cells."""
    p = v.raw("part")
    k = F.col("p_partkey")
    total = F.col("p_size") * 200
    return p.select(
        F.concat(F.lit("stock_"), (k % 2).cast("string")).alias("file"),
        F.when(k < 3, k + 1).otherwise(k + 8).alias("row_no"),
        F.when(k % 50 == 7, F.lit("")).otherwise(k.cast("string")).alias("A"),
        F.col("p_name").alias("D"), F.col("p_type").alias("H"), (k % 3).cast("string").alias("J"),
        F.when(k % 9 == 0, F.lit("---")).when(k % 23 == 0, F.lit("abc")).otherwise(F.format_number(total, 0)).alias("M"),
        F.when(k % 5 == 0, F.lit("")).otherwise((k % 7).cast("string")).alias("O"),
        (k % 3).cast("string").alias("R"),
        (total - k % 7 + k % 3).cast("string").alias("T"), F.lit("box").alias("W"))


_STOCK = """
st AS (SELECT 'stock_' || CAST(p_partkey % 2 AS VARCHAR) AS file,
              CASE WHEN p_partkey < 3 THEN p_partkey + 1 ELSE p_partkey + 8 END AS row_no,
              CASE WHEN p_partkey % 50 = 7 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS A, p_name AS D, p_type AS H,
              CAST(p_partkey % 3 AS VARCHAR) AS J,
              CASE WHEN p_partkey % 9 = 0 THEN '---' WHEN p_partkey % 23 = 0 THEN 'abc' ELSE format('{:,}', p_size * 200) END AS M,
              CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey % 7 AS VARCHAR) END AS O,
              CAST(p_partkey % 3 AS VARCHAR) AS R, CAST(p_size * 200 - p_partkey % 7 + p_partkey % 3 AS VARCHAR) AS T, 'box' AS W
       FROM part),
stn AS (SELECT file, row_no, NULLIF(trim(A), '') AS product_id, D, H, J, W,
               replace(trim(M), ',', '') AS m, replace(trim(O), ',', '') AS o, replace(trim(R), ',', '') AS r,
               replace(trim(T), ',', '') AS t FROM st WHERE row_no >= 8)"""


def _numsql(c):
    return f"CASE WHEN {c} IS NULL OR {c} = '' OR {c} = '---' THEN CAST(0 AS DECIMAL(18,4)) ELSE TRY_CAST({c} AS DECIMAL(18,4)) END"


def _badsql(c):
    return f"(NOT ({c} IS NULL OR {c} = '' OR {c} = '---') AND TRY_CAST({c} AS DECIMAL(18,4)) IS NULL)"


@query("SRC2", osql(f"""
SELECT file, row_no, product_id, D AS product_name, H AS category, J AS warehouse_id,
       CAST({_numsql('m')} AS DOUBLE) AS total_quantity, CAST({_numsql('o')} AS DOUBLE) AS borrowed_out,
       CAST({_numsql('r')} AS DOUBLE) AS borrowed_in, CAST({_numsql('t')} AS DOUBLE) AS stock_quantity, W AS unit
FROM stn WHERE product_id IS NOT NULL AND NOT ({_badsql('m')} OR {_badsql('o')} OR {_badsql('r')} OR {_badsql('t')})""",
    ctes=_STOCK))
def src2_clean_stock(spark, sf_dir):
    """SRC2: stock sheet rows cleaned (numbers parsed, bad rows dropped)."""
    return ig.clean_stock(stock_sheet(Views(spark, sf_dir)))


def _src6_sql():
    parts = []
    for table, kind, letters in (("sheet", "sales", ig.SALES_COLUMNS), ("st", "inventory", ig.STOCK_COLUMNS)):
        required = ig.CONTRACTS[kind]
        cells = {name: f"count_if(trim(COALESCE({letter}, '')) <> '')" for letter, name in letters.items()}
        for name in [*cells, *[c for c in required if c not in cells]]:
            parts.append(f"""SELECT file, '{kind}' AS kind, COUNT(*) AS rows, '{name}' AS column_name,
       CAST({cells.get(name, "0")} AS BIGINT) AS filled_rows, {name in required} AS required FROM {table} GROUP BY file""")
    return osql("SELECT *, CASE WHEN required AND filled_rows = 0 THEN 'missing' WHEN NOT required AND filled_rows > 0 "
                "THEN 'extra' ELSE 'ok' END AS status FROM (" + "\nUNION ALL\n".join(parts) + ")", ctes=_SHEET + "," + _STOCK)


@query("SRC6", _src6_sql())
def src6_check_columns(spark, sf_dir):
    """SRC6: the columns of every sales and stock sheet against their contracts."""
    v = Views(spark, sf_dir)
    return ig.check_columns(sales_sheet(v), "sales", ig.SALES_COLUMNS).unionByName(
        ig.check_columns(stock_sheet(v), "inventory", ig.STOCK_COLUMNS))


# ------------------------------------------------------------------------------ sinks
_SNK3 = """
SELECT transaction_id, CAST(transaction_date AS VARCHAR) AS transaction_date, CAST(amount AS DOUBLE) AS amount FROM (
  SELECT * FROM order_tx WHERE date_trunc('month', transaction_date) NOT IN (
      SELECT DISTINCT date_trunc('month', transaction_date) FROM order_tx
      WHERE transaction_date >= DATE '2001-06-15' AND transaction_date < DATE '2001-08-02')
  UNION ALL
  SELECT * FROM order_tx WHERE transaction_date >= DATE '2001-06-15' AND transaction_date < DATE '2001-08-02')"""


@query("SNK3", osql(_SNK3))
def snk3_replace_months(spark, sf_dir):
    """SNK3: the history with the months of a new batch (mid-June 2001 on) replaced."""
    v = Views(spark, sf_dir)
    t = v.order_tx()
    b = v.order_tx(start="2001-06-15", end="2001-08-02")
    return ig.replace_months(t, b).select("transaction_id", "transaction_date", "amount")


@query("SNK3_write", osql(_SNK3))
def snk3_write_months(spark, sf_dir):
    """SNK3: the same on a stored table: its month partitions are written, those of the
    batch overwritten, and the table read back."""
    v = Views(spark, sf_dir)
    path = sub_checkpoint(spark, f"tables/transactions-{uuid.uuid4().hex[:12]}")
    ig.write_replace_months(v.order_tx(), path)
    ig.write_replace_months(v.order_tx(start="2001-06-15", end="2001-08-02"), path)
    return spark.read.parquet(path).select("transaction_id", "transaction_date", "amount")


_INV_BATCH = """ib AS (SELECT * REPLACE (stock_quantity * 2 AS stock_quantity) FROM inventory
               WHERE product_id IN (SELECT product_id FROM product_master WHERE specification IN ('41', '42', '43')))"""


def _stored(spark, name, target):
    """A new stored table that holds ``target`` as version 0."""
    table = VersionedTable(spark, sub_checkpoint(spark, f"tables/{name}-{uuid.uuid4().hex[:12]}"))
    table.write(target, 0)
    return table


def _twice(*writes):
    """Apply a batch and then the same batch again, which must not change anything."""
    for write in writes:
        write()
        assert not write(), "a replayed batch was applied"


_SNK4 = osql("""
SELECT product_id, warehouse_id, CAST(stock_quantity AS DOUBLE) AS stock_quantity FROM (
  SELECT * FROM inventory WHERE NOT (product_id IN (SELECT product_id FROM ib) AND warehouse_id IN (SELECT warehouse_id FROM ib))
  UNION ALL SELECT * FROM ib)""", ctes=_INV_BATCH)


def _stock_batch(v):
    sizes = v.product_master.filter(F.col("specification").isin("41", "42", "43")).select("product_id")
    b = v.inventory.join(sizes, "product_id", "left_semi").withColumn("stock_quantity", F.col("stock_quantity") * 2)
    return b.withColumn("stock_quantity", F.col("stock_quantity").cast("decimal(18,4)"))


@query("SNK4", _SNK4)
def snk4_replace_stock(spark, sf_dir):
    """SNK4: stock rows replaced by a batch (product set × warehouse set, as the source)."""
    v = Views(spark, sf_dir)
    return ig.replace_stock(v.inventory, _stock_batch(v)).select("product_id", "warehouse_id", "stock_quantity")


@query("SNK4_write", _SNK4)
def snk4_write_stock(spark, sf_dir):
    """SNK4: the same on a stored table, applied twice, and read back."""
    v = Views(spark, sf_dir)
    table = _stored(spark, "stock", v.inventory)
    _twice(lambda: ig.stored_stock(table, _stock_batch(v), 1))
    return table.read().select("product_id", "warehouse_id", "stock_quantity")


_SNK6 = osql("""
SELECT customer_id, line_id FROM (
  SELECT customer_id, line_id FROM customers WHERE line_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT o.customer_id, 'L' || CAST(o.customer_id AS VARCHAR) AS line_id FROM incoming_orders o
  WHERE o.customer_id IS NOT NULL AND o.is_new_product
    AND o.customer_id NOT IN (SELECT customer_id FROM customers WHERE line_id IS NOT NULL))""")


def _chat_ids(v):
    target = v.customers.filter(F.col("line_id").isNotNull()).select("customer_id", "line_id")
    new = (v.incoming_orders.filter(F.col("customer_id").isNotNull() & F.col("is_new_product"))
           .select("customer_id", F.concat(F.lit("L"), F.col("customer_id").cast("string")).alias("line_id")).distinct())
    return target, new


@query("SNK6", _SNK6)
def snk6_insert_missing(spark, sf_dir):
    """SNK6: chat-id map rows added only for customers without one (insert if absent)."""
    return ig.insert_missing(*_chat_ids(Views(spark, sf_dir)), ["customer_id"])


@query("SNK6_write", _SNK6)
def snk6_write_missing(spark, sf_dir):
    """SNK6: the same on a stored table; a later batch of the same rows adds none."""
    target, new = _chat_ids(Views(spark, sf_dir))
    table = _stored(spark, "chat-ids", target)
    _twice(lambda: ig.stored_insert_missing(table, new, ["customer_id"], 1))
    ig.stored_insert_missing(table, new, ["customer_id"], 2)
    return table.read()


_SNK7 = osql("""
SELECT c.customer_id, COALESCE(p.customer_name, c.customer_name) AS customer_name, COALESCE(p.notes, c.notes) AS notes,
       CASE WHEN p.customer_id IS NOT NULL THEN '2001-08-01 00:00:00' END AS updated_at
FROM customers c LEFT JOIN (
  SELECT customer_id, arg_max_null(customer_name, (created_at, id)) AS customer_name, arg_max_null(order_note, (created_at, id)) AS notes
  FROM incoming_orders WHERE customer_id IS NOT NULL GROUP BY 1) p ON c.customer_id = p.customer_id""")


def _patches(v):
    target = v.customers.select("customer_id", "customer_name", "notes")
    patches = v.incoming_orders.filter(F.col("customer_id").isNotNull()).select(
        "customer_id", "customer_name", F.col("order_note").alias("notes"), F.struct("created_at", "id").alias("_o"))
    return target, patches


@query("SNK7", _SNK7)
def snk7_apply_patches(spark, sf_dir):
    """SNK7: each customer's latest incoming order patches name and notes (non-null
    fields only) and stamps updated_at."""
    return ig.apply_patches(*_patches(Views(spark, sf_dir)), ["customer_id"], "_o", "2001-08-01 00:00:00")


@query("SNK7_write", _SNK7)
def snk7_write_patches(spark, sf_dir):
    """SNK7: the same on a stored table, applied twice, and read back."""
    target, patches = _patches(Views(spark, sf_dir))
    table = _stored(spark, "customers", target)
    _twice(lambda: ig.stored_patches(table, patches, ["customer_id"], "_o", "2001-08-01 00:00:00", 1))
    return table.read()


_SNK8 = osql("""
SELECT product_id, warehouse_id FROM inventory
WHERE product_id NOT IN (SELECT product_id FROM product_master WHERE is_active = 'inactive')""")


@query("SNK8_write", _SNK8)
def snk8_write_cascade(spark, sf_dir):
    """SNK8: the cascade on stored stock and product tables; the stock that stays."""
    v = Views(spark, sf_dir)
    stock = _stored(spark, "stock", v.inventory.select("product_id", "warehouse_id"))
    products = _stored(spark, "products", v.product_master.select("product_id", "warehouse_id", "is_active"))
    gone = products.read().filter(F.col("is_active") == "inactive").select("product_id")
    for expected in (True, False):
        done = ig.stored_delete([(stock, ["product_id"]), (products, ["product_id"])], gone, 1)
        assert done == [expected, expected], "a replayed cascade was applied"
    return stock.read().join(products.read().select("product_id").distinct(), "product_id", "left_semi")


@query("SNK8", _SNK8)
def snk8_delete_keys(spark, sf_dir):
    """SNK8: stock rows of deleted (inactive) products removed."""
    v = Views(spark, sf_dir)
    gone = v.product_master.filter(F.col("is_active") == "inactive").select("product_id")
    return ig.delete_products(v.product_master, v.inventory, gone)[1].select("product_id", "warehouse_id")


@query("SNK8_products", osql("SELECT product_id, warehouse_id FROM product_master WHERE is_active <> 'inactive' OR is_active IS NULL"))
def snk8_delete_products(spark, sf_dir):
    """SNK8: the product rows that stay when inactive products are deleted."""
    v = Views(spark, sf_dir)
    gone = v.product_master.filter(F.col("is_active") == "inactive").select("product_id")
    return ig.delete_products(v.product_master, v.inventory, gone)[0].select("product_id", "warehouse_id")


@query("SNK8_customers", osql("SELECT customer_id FROM customers WHERE customer_id IN (SELECT customer_id FROM order_tx)"))
def snk8_delete_customers(spark, sf_dir):
    """SNK8: customers left when those who never ordered are deleted."""
    v = Views(spark, sf_dir)
    gone = v.customers.select("customer_id").join(v.order_tx().select("customer_id"), "customer_id", "left_anti")
    return ig.delete_keys(v.customers, gone, ["customer_id"]).select("customer_id")


_PRED = """pr AS (SELECT customer_id, product_id, prediction_date, purchase_probability,
                  CASE WHEN prediction_date <= DATE '{cut}' THEN 'fulfilled' ELSE 'active' END AS prediction_status
           FROM preds{sfx} WHERE will_purchase_anything)"""


def _snk5_sql():
    from ledgerflow.plans.q_replenish import _m10_sql_sfx
    ctes = _m10_sql_sfx("2024-01-20", "_o") + ",\n" + _m10_sql_sfx("2024-01-22", "_n") + """,
old AS (SELECT customer_id, product_id, prediction_date, purchase_probability,
               CASE WHEN prediction_date <= DATE '2024-01-22' THEN 'fulfilled' ELSE 'active' END AS prediction_status
        FROM preds_o WHERE will_purchase_anything),
new AS (SELECT customer_id, product_id, prediction_date, purchase_probability, 'active' AS prediction_status
        FROM preds_n WHERE will_purchase_anything)"""
    return osql("""
SELECT COALESCE(o.customer_id, n.customer_id) AS customer_id, COALESCE(o.product_id, n.product_id) AS product_id,
       CAST(COALESCE(o.prediction_date, n.prediction_date) AS VARCHAR) AS prediction_date,
       CASE WHEN n.customer_id IS NOT NULL AND (o.customer_id IS NULL OR o.prediction_status = 'active')
            THEN n.purchase_probability ELSE o.purchase_probability END AS purchase_probability,
       CASE WHEN n.customer_id IS NOT NULL AND (o.customer_id IS NULL OR o.prediction_status = 'active')
            THEN n.prediction_status ELSE o.prediction_status END AS prediction_status
FROM old o FULL OUTER JOIN new n
  ON o.customer_id = n.customer_id AND o.product_id = n.product_id AND o.prediction_date = n.prediction_date""", ctes=ctes)


def _predictions(v):
    old = rp.predict_orders(v.replen_tx, "2024-01-20").filter("will_purchase_anything")
    old = old.withColumn("prediction_status", F.when(F.col("prediction_date") <= F.lit("2024-01-22").cast("date"),
                                                     F.lit("fulfilled")).otherwise(F.lit("active")))
    new = rp.predict_orders(v.replen_tx, "2024-01-22").filter("will_purchase_anything").withColumn(
        "prediction_status", F.lit("active"))
    cols = ["customer_id", "product_id", "prediction_date", "purchase_probability", "prediction_status"]
    return old.select(*cols), new.select(*cols)


@query("SNK5", _snk5_sql())
def snk5_upsert(spark, sf_dir):
    """SNK5: predictions of 2024-01-22 upserted into those of 2024-01-20 (only rows still
    active take new values)."""
    return ig.upsert(*_predictions(Views(spark, sf_dir)), ["customer_id", "product_id", "prediction_date"])


@query("SNK5_write", _snk5_sql())
def snk5_write_upsert(spark, sf_dir):
    """SNK5: the same on a stored table, applied twice, and read back."""
    old, new = _predictions(Views(spark, sf_dir))
    table = _stored(spark, "predictions", old)
    _twice(lambda: ig.stored_upsert(table, new, ["customer_id", "product_id", "prediction_date"], 1))
    return table.read()


# --------------------------------------------------------------- scalar functions (X*)
@query("X_calendar", osql("""
SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_start,
       CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + INTERVAL 2 MONTH AS DATE)::VARCHAR AS plus_2_months,
       CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR) AS month_end,
       CAST(floor((epoch(TIMESTAMP '2001-08-01 12:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS elapsed_days,
       isodow(o_orderdate) - 1 AS day_of_week, dayname(o_orderdate) AS weekday_name, dayofmonth(o_orderdate) AS day_of_month,
       month(o_orderdate) AS month, quarter(o_orderdate) AS quarter, isodow(o_orderdate) >= 6 AS is_weekend,
       isodow(o_orderdate) = 7 AS is_sunday
FROM orders"""))
def x_calendar(spark, sf_dir):
    """Month arithmetic, elapsed whole days and calendar parts of order dates."""
    o = Views(spark, sf_dir).raw("orders")
    d = F.to_date("o_orderdate")
    parts = cal.calendar_parts(d)
    return o.select("o_orderkey", cal.month_start(d).alias("month_start"), cal.add_months(d, 2).alias("plus_2_months"),
                    cal.month_end(d).alias("month_end"),
                    cal.elapsed_days("o_orderdate", F.lit("2001-08-01 12:00:00").cast("timestamp")).alias("elapsed_days"),
                    *parts)


@query("X4", osql("""
SELECT batch_id, CAST(CASE WHEN regexp_matches(batch_id, '^monthly_\\d{8}_\\d{6}$')
                            THEN CAST(date_trunc('month', strptime(substr(batch_id, 9, 8), '%Y%m%d')) AS DATE)
                            ELSE DATE '2001-09-01' END AS VARCHAR) AS batch_month
FROM (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'manual_' || CAST(o_orderkey AS VARCHAR)
                           ELSE 'monthly_' || strftime(o_orderdate, '%Y%m%d') || '_020000' END AS batch_id FROM orders)"""))
def x4_batch_month(spark, sf_dir):
    """Month of a batch id ('monthly_YYYYMMDD_HHMMSS'), else the month after as-of."""
    o = Views(spark, sf_dir).raw("orders")
    b = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("manual_"), F.col("o_orderkey").cast("string"))).otherwise(
        F.concat(F.lit("monthly_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_020000")))
    d = o.select(b.alias("batch_id")).distinct()
    return d.select("batch_id", cal.batch_month("batch_id", F.lit("2001-08-15").cast("date")).alias("batch_month"))


@query("X_text", osql("""
SELECT customer_id,
       array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(delivery_schedule, ','),
           lambda x: TRY_CAST(trim(x) AS INTEGER)), lambda x: x BETWEEN 1 AND 7))), ',') AS schedule_sorted,
       CASE WHEN delivery_schedule IS NULL OR trim(delivery_schedule) = '' THEN ''
            ELSE array_to_string(list_transform(list_filter(list_transform(string_split(delivery_schedule, ','), lambda x: trim(x)),
                   lambda x: x <> ''), lambda x: COALESCE(map_extract_value(MAP {'1': '一', '2': '二', '3': '三', '4': '四',
                   '5': '五', '6': '六', '7': '日'}, x), x)), ',') END AS schedule_names,
       regexp_replace(trim(customer_name), '[\\\\/:*?"<>|\\s]+', '_', 'g') AS safe_name,
       CASE WHEN len(string_split(customer_name || '_a_b_c', '_')) >= 4
            THEN array_to_string(string_split(customer_name || '_a_b_c', '_')[3:], '_') ELSE customer_name || '_a_b_c' END
         AS trimmed_name,
       COALESCE(CASE WHEN phone_number IS NULL OR trim(phone_number) IN ('', 'None') THEN NULL ELSE phone_number END,
                'unknown') AS phone_or_default
FROM customers"""))
def x_text(spark, sf_dir):
    """Defaults, weekly schedule codec, safe names, display-name trim."""
    c = Views(spark, sf_dir).customers
    return c.select("customer_id", ft.schedule_sorted("delivery_schedule").alias("schedule_sorted"),
                    ft.schedule_names("delivery_schedule").alias("schedule_names"),
                    ft.safe_name("customer_name").alias("safe_name"),
                    ft.trim_name(F.concat(F.col("customer_name"), F.lit("_a_b_c"))).alias("trimmed_name"),
                    fm.default("phone_number", "unknown").alias("phone_or_default"))


@query("X_product", osql("""
SELECT product_id, trim(regexp_replace(regexp_replace(name_zh || ' (' || specification || ')', '[\\(（][^\\)）]*[\\)）]', '', 'g'),
                                      '[-_/]+', '', 'g')) AS core_name,
       CASE WHEN CAST(specification AS DOUBLE) = floor(CAST(specification AS DOUBLE))
            THEN CAST(CAST(specification AS DOUBLE) AS BIGINT) || unit ELSE specification || unit END AS quantity_text,
       CASE WHEN list_price <= 1000 THEN 'low' WHEN list_price <= 1500 THEN 'medium' ELSE 'high' END AS price_band
FROM product_master"""))
def x_product(spark, sf_dir):
    """Buckets, quantity with unit, product core name."""
    p = Views(spark, sf_dir).product_master
    return p.select("product_id", ft.core_name(F.concat(F.col("name_zh"), F.lit(" ("), F.col("specification"),
                                                         F.lit(")"))).alias("core_name"),
                    ft.fmt_quantity("specification", "unit").alias("quantity_text"),
                    fm.bucket("list_price", [1000, 1500], ["low", "medium", "high"]).alias("price_band"))


@query("X13", osql("""
SELECT event_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(props, '"([^"]*)"', 1), lambda x: trim(x)),
                                                     lambda x: x <> ''))) AS keywords FROM events"""))
def x13_keywords(spark, sf_dir):
    """Keyword payloads (JSON text; not lists here, so the quoted strings are taken)."""
    e = Views(spark, sf_dir).raw("events")
    return e.select("event_id", F.array_sort(ft.keywords_from_json("props")).alias("keywords"))


@query("X13_json", osql("""
SELECT event_id, list_sort(list_distinct([event_type, 'user ' || CAST(user_id AS VARCHAR)])) AS keywords FROM events"""))
def x13_json_keywords(spark, sf_dir):
    """Keyword payloads that are JSON objects of lists, in a code fence."""
    e = Views(spark, sf_dir).raw("events")
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    lists = F.to_json(F.struct(F.array("event_type", user).alias("exact"), F.array(user).alias("similar")))
    payload = F.concat(F.lit("```json\n"), lists, F.lit("\n```"))
    return e.select("event_id", F.array_sort(ft.keywords_from_json(payload)).alias("keywords"))


@query("X17_price", osql("""
SELECT id, CASE WHEN quantity <> 0 THEN CAST(amount AS DOUBLE) / CAST(quantity AS DOUBLE) END AS unit_price FROM incoming_orders"""))
def x17_unit_price(spark, sf_dir):
    """Unit price = amount / quantity."""
    return Views(spark, sf_dir).incoming_orders.select("id", fm.unit_price("amount", "quantity").alias("unit_price"))


@query("X17", osql("""
SELECT product_id, warehouse_id, CAST(total_quantity - borrowed_out + borrowed_in AS DOUBLE) AS net_stock,
       CAST(total_quantity - borrowed_out + borrowed_in AS DOUBLE) = CAST(stock_quantity AS DOUBLE) AS consistent
FROM inventory"""))
def x17_net_stock(spark, sf_dir):
    """Net stock = total − borrowed out + borrowed in (checked against stock)."""
    i = Views(spark, sf_dir).inventory
    n = fm.net_stock("total_quantity", "borrowed_out", "borrowed_in")
    return i.select("product_id", "warehouse_id", n.alias("net_stock"), (n == F.col("stock_quantity")).alias("consistent"))


@query("X2", osql("SELECT conv_id, row_no, TRUE AS round_trip_ok, TRUE AS clean_unchanged FROM chat_messages"))
def x2_repair_text(spark, sf_dir):
    """Mojibake repair of chat texts (unchanged when not Latin-1-decoded UTF-8)."""
    m = Views(spark, sf_dir).chat_messages
    broken = F.decode(F.encode("content", "UTF-8"), "ISO-8859-1")
    return m.select("conv_id", "row_no", (ft.repair_text(broken) == F.col("content")).alias("round_trip_ok"),
                    (ft.repair_text("content") == F.col("content")).alias("clean_unchanged"))


def fingerprint_sql(by: str) -> str:
    """The fingerprint of id, updated_at and status per ``by`` as SELECT items."""
    row = "concat_ws(chr(31), CAST(id AS VARCHAR), CAST(updated_at AS VARCHAR), status)"
    total = f"CAST(SUM(CAST('0x' || substr(md5({row}), 1, 15) AS HUGEINT)) AS VARCHAR)"
    return f"{by}, COUNT(*) AS row_count, md5({total} || ':' || CAST(COUNT(*) AS VARCHAR)) AS fingerprint"


@query("X16", osql(f"SELECT {fingerprint_sql('status')} FROM incoming_orders GROUP BY 1"))
def x16_fingerprint(spark, sf_dir):
    """Change fingerprint of the incoming orders per status."""
    o = Views(spark, sf_dir).incoming_orders
    return fm.fingerprint(o, ["id", "updated_at", "status"], ["status"])
