"""Business views over the driver's TPC-H-like tables (the test-table adapter).

Each view exists twice, built with the same expressions: as a lazy Spark DataFrame
(``Views``) and as a SQL common-table expression (``VIEW_SQL``) that the DuckDB oracle
runs.  Rules (decisions of this build, not facts about the source system):

* ``order_tx``        lineitem ⋈ orders.  id = orderkey-linenumber, customer = o_custkey,
                      product = l_partkey, date = date(o_orderdate), returns (flag R) are
                      the return document type with negated quantity and amount;
                      amount = extendedprice·(1−discount); unit price = extendedprice/quantity.
* ``product_master``  part.  category = p_type, subcategory = p_type/p_brand,
                      specification = p_size, process type = first word of p_name,
                      warehouse = key % 3, active when p_size ≤ 45.
* ``customers``       customer ⋈ nation ⋈ region; city = region, district = nation;
                      weekly schedule, phone, address and chat id follow key modulo rules
                      so that the missing-field operators have hits.
* ``inventory``       part.  total = size·20, out = key % 7, in = key % 3.
* ``incoming_orders`` orders + their first line item; status P→'0', F→'1', O→'2'.
* ``chat_messages``   conversations; role 'user' is the customer's side.
* ``replen_tx``       events as dense repeat purchases (user × event type × day).
* ``replen_tx_long``  order_tx at category grain, so that pairs repeat over years.
* ``task_log``        events as job runs / check results (status, duration).

Keys stay BIGINT (the source keys); money and quantities are DECIMAL(18,4) so that sums
are exact in every engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.constants import RETURN, SALE, TEST_KEYWORDS
from ledgerflow.sources.tables import read_table

MONEY = "decimal(18,4)"


def _sign(flag: Column) -> Column:
    return F.when(flag == "R", F.lit(-1)).otherwise(F.lit(1))


class Views:
    """Lazy business views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # -- sales -----------------------------------------------------------------------
    def order_tx(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Sales lines; optional [start, end) date window applied at the orders scan."""
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        if start is not None:
            o = o.filter(F.col("o_orderdate") >= F.to_timestamp(F.lit(start)))
        if end is not None:
            o = o.filter(F.col("o_orderdate") < F.to_timestamp(F.lit(end)))
        li = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                         "l_extendedprice", "l_discount", "l_returnflag")
        sign = _sign(F.col("l_returnflag"))
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in
                               ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("transaction_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("l_partkey").alias("product_id"),
            F.to_date("o_orderdate").alias("transaction_date"),
            F.when(F.col("l_returnflag") == "R", F.lit(RETURN)).otherwise(F.lit(SALE)).alias("document_type"),
            (F.col("l_quantity") * sign).cast(MONEY).alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            (sign * F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).cast(MONEY).alias("amount"),
        )

    @cached_property
    def product_master(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            (F.col("p_partkey") % 3).alias("warehouse_id"),
            F.col("p_name").alias("name_zh"),
            F.col("p_type").alias("category"),
            F.concat_ws("/", "p_type", "p_brand").alias("subcategory"),
            F.col("p_size").cast("string").alias("specification"),
            F.substring_index("p_name", " ", 1).alias("process_type"),
            F.lit("box").alias("unit"),
            F.when(F.col("p_size") <= 45, F.lit("active")).otherwise(F.lit("inactive")).alias("is_active"),
            F.col("p_retailprice").alias("list_price"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        c = self.raw("customer")
        n = self.raw("nation")
        r = self.raw("region")
        k = F.col("c_custkey")
        return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
                .join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                .select(
                    k.alias("customer_id"),
                    F.col("c_name").alias("customer_name"),
                    F.when(k % 7 == 0, F.lit(None).cast("string"))
                     .when(k % 7 == 1, F.lit(""))
                     .otherwise(F.concat(F.lit("09"), F.lpad(k.cast("string"), 8, "0"))).alias("phone_number"),
                    F.when(k % 11 == 0, F.lit("None"))
                     .when(k % 11 == 1, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.col("n_name"), F.lit(" road "), k.cast("string"))).alias("address"),
                    F.col("r_name").alias("city"),
                    F.col("n_name").alias("district"),
                    F.when(k % 5 == 0, F.lit("1,3,5")).when(k % 5 == 1, F.lit("2,4,6"))
                     .when(k % 5 == 2, F.lit("5,1,3")).when(k % 5 == 3, F.lit("7"))
                     .otherwise(F.lit(None).cast("string")).alias("delivery_schedule"),
                    F.col("c_mktsegment").alias("notes"),
                    F.when(k % 3 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("U"), k.cast("string"))).alias("line_id"),
                    F.col("c_acctbal").alias("acctbal"),
                ))

    @cached_property
    def inventory(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        return p.select(
            k.alias("product_id"),
            (k % 3).alias("warehouse_id"),
            (F.col("p_size") * 20).cast(MONEY).alias("total_quantity"),
            (k % 7).cast(MONEY).alias("borrowed_out"),
            (k % 3).cast(MONEY).alias("borrowed_in"),
            (F.col("p_size") * 20 - k % 7 + k % 3).cast(MONEY).alias("stock_quantity"),
            F.lit("box").alias("unit"),
            F.date_add(F.lit("2001-07-01").cast("date"), (k % 28).cast("int")).cast("timestamp").alias("updated_at"),
        )

    @cached_property
    def incoming_orders(self) -> DataFrame:
        """temp_customer_records: one row per order, product from its first line item."""
        return self.incoming_from(self.raw("orders"))

    def incoming_from(self, o: DataFrame) -> DataFrame:
        """incoming_orders built from a given orders DataFrame (batch or stream)."""
        li = self.raw("lineitem")
        first = li.groupBy("l_orderkey").agg(
            F.min_by(F.struct("l_partkey", "l_quantity", "l_extendedprice", "l_discount"),
                     F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("fl"))
        c = self.raw("customer").select("c_custkey", "c_name")
        k = F.col("o_orderkey")
        status = (F.when(F.col("o_orderstatus") == "P", F.lit("0"))
                  .when(F.col("o_orderstatus") == "F", F.lit("1")).otherwise(F.lit("2")))
        cust = F.when(k % 13 == 0, F.lit(None).cast("long")).otherwise(F.col("o_custkey"))
        return (o.join(first, o.o_orderkey == first.l_orderkey)
                .join(c, o.o_custkey == c.c_custkey, "left")
                .select(
                    k.alias("id"),
                    cust.alias("customer_id"),
                    F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("customer_name"),
                    F.when(F.col("o_custkey") % 3 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("U"), F.col("o_custkey").cast("string"))).alias("line_id"),
                    F.col("fl.l_partkey").alias("product_id"),
                    F.col("fl.l_quantity").cast(MONEY).alias("quantity"),
                    (F.col("fl.l_extendedprice") / F.col("fl.l_quantity")).alias("unit_price"),
                    (F.col("fl.l_extendedprice") * (F.lit(1) - F.col("fl.l_discount"))).cast(MONEY).alias("amount"),
                    F.col("o_orderpriority").alias("order_note"),
                    (k % 4 == 0).alias("is_new_product"),
                    status.alias("status"),
                    F.col("o_orderdate").cast("timestamp").alias("created_at"),
                    F.when((status == "1") & (k % 17 != 0),
                           F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("confirmed_at"),
                    (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("updated_at"),
                ))

    # -- chats -------------------------------------------------------------------------
    @cached_property
    def chat_messages(self) -> DataFrame:
        cv = self.raw("conversations")
        k = F.col("conv_id")
        ks = k.cast("string")
        fname = (F.when(k % 4 == 0, F.concat(ks, F.lit("_20240101_20240131_North_Shop "), ks, F.lit("("), ks, F.lit(").csv")))
                 .when(k % 4 == 1, F.concat(ks, F.lit("_20240101_20240131_Shop"), ks, F.lit(".csv")))
                 .when(k % 4 == 2, F.concat(ks, F.lit("_Shop"), ks, F.lit(".csv")))
                 .otherwise(F.concat(ks, F.lit("_20240101_20240131_South_Shop_"), ks, F.lit("(Unknown).csv"))))
        return cv.select(
            F.col("conv_id"),
            F.col("turn").alias("row_no"),
            fname.alias("file_name"),
            F.concat(F.lit("batch_"), (k % 3).cast("string")).alias("batch"),
            (F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_interval(hours=(k % 3).cast("int"))).alias("batch_time"),
            F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("message_date"),
            F.when(F.col("role") == "user", F.lit("User")).otherwise(F.lit("Account")).alias("sender_type"),
            F.when(F.col("conv_id") % 3 != 0, F.col("conv_id")).alias("customer_id"),
            F.col("text").alias("content"),
        )

    def keywords(self) -> DataFrame:
        """Keyword table (bounded: a handful of search terms)."""
        return self.spark.createDataFrame([(w,) for w in TEST_KEYWORDS], "keyword string")

    # -- replenishment -----------------------------------------------------------------
    @cached_property
    def replen_tx(self) -> DataFrame:
        ev = self.raw("events")
        return ev.select(
            F.col("user_id").alias("customer_id"),
            F.col("event_type").alias("product_id"),
            F.to_date("ts").alias("transaction_date"),
            F.lit(SALE).alias("document_type"),
            F.ceil("value").cast(MONEY).alias("quantity"),
            F.col("value").cast(MONEY).alias("amount"),
        )

    def replen_tx_long(self) -> DataFrame:
        t = self.order_tx()
        pm = self.product_master.select("product_id", "category")
        return t.join(pm, "product_id").select(
            "customer_id", F.col("category").alias("product_id"), "transaction_date",
            "document_type", "quantity", "amount")

    # -- monitoring --------------------------------------------------------------------
    @cached_property
    def task_log(self) -> DataFrame:
        ev = self.raw("events")
        return ev.select(
            F.col("event_id").alias("run_id"),
            F.concat(F.lit("task_"), (F.col("user_id") % 10).cast("string")).alias("task_id"),
            F.col("event_type").alias("status"),
            F.col("value").alias("duration"),
            F.col("ts").cast("timestamp").alias("ts"),
        )


# ------------------------------------------------------------------------------------------
# The same views as SQL common-table expressions, for the DuckDB oracle.
# ------------------------------------------------------------------------------------------
VIEW_SQL = {
    "order_tx": f"""order_tx AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) || '-'
         || CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR) AS transaction_id,
         o.o_custkey AS customer_id, l.l_partkey AS product_id,
         CAST(o.o_orderdate AS DATE) AS transaction_date,
         CASE WHEN l.l_returnflag = 'R' THEN '{RETURN}' ELSE '{SALE}' END AS document_type,
         CAST((CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END) * l.l_quantity AS DECIMAL(18,4)) AS quantity,
         l.l_extendedprice / l.l_quantity AS unit_price,
         CAST((CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END) * l.l_extendedprice * (1 - l.l_discount)
              AS DECIMAL(18,4)) AS amount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "product_master": """product_master AS (
  SELECT p_partkey AS product_id, p_partkey % 3 AS warehouse_id, p_name AS name_zh,
         p_type AS category, p_type || '/' || p_brand AS subcategory,
         CAST(p_size AS VARCHAR) AS specification, split_part(p_name, ' ', 1) AS process_type,
         'box' AS unit, CASE WHEN p_size <= 45 THEN 'active' ELSE 'inactive' END AS is_active,
         p_retailprice AS list_price
  FROM part)""",
    "customers": """customers AS (
  SELECT c.c_custkey AS customer_id, c.c_name AS customer_name,
         CASE WHEN c.c_custkey % 7 = 0 THEN NULL WHEN c.c_custkey % 7 = 1 THEN ''
              ELSE '09' || lpad(CAST(c.c_custkey AS VARCHAR), 8, '0') END AS phone_number,
         CASE WHEN c.c_custkey % 11 = 0 THEN 'None' WHEN c.c_custkey % 11 = 1 THEN NULL
              ELSE n.n_name || ' road ' || CAST(c.c_custkey AS VARCHAR) END AS address,
         r.r_name AS city, n.n_name AS district,
         CASE WHEN c.c_custkey % 5 = 0 THEN '1,3,5' WHEN c.c_custkey % 5 = 1 THEN '2,4,6'
              WHEN c.c_custkey % 5 = 2 THEN '5,1,3' WHEN c.c_custkey % 5 = 3 THEN '7' END AS delivery_schedule,
         c.c_mktsegment AS notes,
         CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE 'U' || CAST(c.c_custkey AS VARCHAR) END AS line_id,
         c.c_acctbal AS acctbal
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)""",
    "inventory": """inventory AS (
  SELECT p_partkey AS product_id, p_partkey % 3 AS warehouse_id,
         CAST(p_size * 20 AS DECIMAL(18,4)) AS total_quantity,
         CAST(p_partkey % 7 AS DECIMAL(18,4)) AS borrowed_out,
         CAST(p_partkey % 3 AS DECIMAL(18,4)) AS borrowed_in,
         CAST(p_size * 20 - p_partkey % 7 + p_partkey % 3 AS DECIMAL(18,4)) AS stock_quantity,
         'box' AS unit,
         CAST(DATE '2001-07-01' + CAST(p_partkey % 28 AS INTEGER) AS TIMESTAMP) AS updated_at
  FROM part)""",
    "incoming_orders": """first_line AS (
  SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS l_partkey,
         arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey)) AS l_quantity,
         arg_min(l_extendedprice, (l_linenumber, l_partkey, l_suppkey)) AS l_extendedprice,
         arg_min(l_discount, (l_linenumber, l_partkey, l_suppkey)) AS l_discount
  FROM lineitem GROUP BY l_orderkey),
incoming_orders AS (
  SELECT o.o_orderkey AS id,
         CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE o.o_custkey END AS customer_id,
         CASE WHEN o.o_orderkey % 10 = 0 THEN NULL ELSE c.c_name END AS customer_name,
         CASE WHEN o.o_custkey % 3 = 0 THEN NULL ELSE 'U' || CAST(o.o_custkey AS VARCHAR) END AS line_id,
         f.l_partkey AS product_id, CAST(f.l_quantity AS DECIMAL(18,4)) AS quantity,
         f.l_extendedprice / f.l_quantity AS unit_price,
         CAST(f.l_extendedprice * (1 - f.l_discount) AS DECIMAL(18,4)) AS amount,
         o.o_orderpriority AS order_note, (o.o_orderkey % 4 = 0) AS is_new_product,
         CASE o.o_orderstatus WHEN 'P' THEN '0' WHEN 'F' THEN '1' ELSE '2' END AS status,
         CAST(o.o_orderdate AS TIMESTAMP) AS created_at,
         CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 17 <> 0
              THEN CAST(o.o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY END AS confirmed_at,
         CAST(o.o_orderdate AS TIMESTAMP) + INTERVAL 2 DAY AS updated_at
  FROM orders o JOIN first_line f ON o.o_orderkey = f.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey)""",
    "chat_messages": """chat_messages AS (
  SELECT conv_id, turn AS row_no,
         CASE conv_id % 4
           WHEN 0 THEN CAST(conv_id AS VARCHAR) || '_20240101_20240131_North_Shop ' || CAST(conv_id AS VARCHAR) || '(' || CAST(conv_id AS VARCHAR) || ').csv'
           WHEN 1 THEN CAST(conv_id AS VARCHAR) || '_20240101_20240131_Shop' || CAST(conv_id AS VARCHAR) || '.csv'
           WHEN 2 THEN CAST(conv_id AS VARCHAR) || '_Shop' || CAST(conv_id AS VARCHAR) || '.csv'
           ELSE CAST(conv_id AS VARCHAR) || '_20240101_20240131_South_Shop_' || CAST(conv_id AS VARCHAR) || '(Unknown).csv' END
           AS file_name,
         'batch_' || CAST(conv_id % 3 AS VARCHAR) AS batch,
         TIMESTAMP '2024-02-01 00:00:00' + to_hours(CAST(conv_id % 3 AS INTEGER)) AS batch_time,
         DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS message_date,
         CASE WHEN role = 'user' THEN 'User' ELSE 'Account' END AS sender_type,
         CASE WHEN conv_id % 3 <> 0 THEN conv_id END AS customer_id, text AS content
  FROM conversations)""",
    "keywords": "keywords AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for w in TEST_KEYWORDS)
                + ") AS k(keyword))",
    "replen_tx": f"""replen_tx AS (
  SELECT user_id AS customer_id, event_type AS product_id, CAST(ts AS DATE) AS transaction_date,
         '{SALE}' AS document_type, CAST(ceil(value) AS DECIMAL(18,4)) AS quantity,
         CAST(value AS DECIMAL(18,4)) AS amount
  FROM events)""",
    "replen_tx_long": """replen_tx_long AS (
  SELECT t.customer_id, pm.category AS product_id, t.transaction_date, t.document_type, t.quantity, t.amount
  FROM order_tx t JOIN product_master pm ON t.product_id = pm.product_id)""",
    "task_log": """task_log AS (
  SELECT event_id AS run_id, 'task_' || CAST(user_id % 10 AS VARCHAR) AS task_id, event_type AS status,
         value AS duration, CAST(ts AS TIMESTAMP) AS ts
  FROM events)""",
}

_VIEW_ORDER = ("order_tx", "product_master", "customers", "inventory", "incoming_orders", "chat_messages",
               "keywords", "replen_tx", "replen_tx_long", "task_log")


def osql(body: str, ctes: str = "") -> str:
    """Oracle SQL: the business views as CTEs, then optional extra CTEs, then ``body``."""
    parts = [VIEW_SQL[v] for v in _VIEW_ORDER]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n" + body
