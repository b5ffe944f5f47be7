"""Sales series, stock summaries and month-over-month change.

Inputs are the business views (``order_tx``, ``product_master``, ``customers``,
``inventory``).  All functions are lazy; group-bys use partial (map-side) aggregation,
and dimension joins are left to the planner, which broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerflow.constants import RETURN, SALE
from ledgerflow.functions.calendar import month_start

NET_SALE = SALE
NET_RETURN = RETURN
NET_CANCEL = "抵銷"   # FIXED VALUE: label of a day whose sales and returns cancel out

PRODUCT_LEVELS = ("category", "subcategory", "name_zh")
CUSTOMER_LEVELS = ("city", "district")


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


def valid_sales(tx: DataFrame, pm: DataFrame, start=None, end=None, active_only: bool = True) -> DataFrame:
    """F1 + J1: sale lines with positive quantity of active products in [start, end), with
    the product attributes attached (inner join drops unknown products)."""
    t = tx.filter((F.col("document_type") == SALE) & (F.col("quantity") > 0))
    if start is not None:
        t = t.filter(F.col("transaction_date") >= _d(start))
    if end is not None:
        t = t.filter(F.col("transaction_date") < _d(end))
    p = pm.filter(F.col("is_active") == "active") if active_only else pm
    return sales_with_product(t, p)


def sales_with_product(tx: DataFrame, pm: DataFrame) -> DataFrame:
    """Attach category attributes; unknown products drop out (inner equi join).

    ``pm`` is first reduced to one row per product (J9) so that a product held in two
    warehouses cannot double-count."""
    return tx.join(dedup_product(pm), "product_id")


def sales_with_customer(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Attach city / district (inner equi join)."""
    return tx.join(customers.select("customer_id", "city", "district"), "customer_id")


def dedup_product(pm: DataFrame) -> DataFrame:
    """One row per product, active rows first, lowest warehouse id."""
    cols = [c for c in pm.columns if c != "warehouse_id"]
    if "warehouse_id" not in pm.columns:
        return pm
    prio = F.when(F.col("is_active") == "active", 0).otherwise(1) if "is_active" in pm.columns else F.lit(0)
    best = F.min_by(F.struct(*[F.col(c) for c in cols if c != "product_id"]),
                    F.struct(prio, F.col("warehouse_id")))
    return pm.groupBy("product_id").agg(best.alias("_r")).select("product_id", "_r.*")


def sales_series(tx: DataFrame, pm: DataFrame, customers: DataFrame, level: str,
                 values: Sequence[str] | None, start, end) -> DataFrame:
    """A1: SUM(amount) of sale documents by day and member of ``level`` within
    [start, end] (whole end day).  Levels: category, subcategory, name_zh, city, district."""
    t = tx.filter((F.col("document_type") == SALE)
                  & F.col("transaction_date").between(_d(start), _d(end)))
    if level in PRODUCT_LEVELS:
        t = t.join(dedup_product(pm).select("product_id", level), "product_id")
    elif level in CUSTOMER_LEVELS:
        t = t.join(customers.select("customer_id", level), "customer_id")
    else:
        raise ValueError(f"unknown level {level!r}")
    if values is not None:
        t = t.filter(F.col(level).isin(list(values)))
    return (t.groupBy(F.col("transaction_date").alias("sales_date"), F.col(level).alias("filter_value"))
            .agg(F.sum("amount").alias("total_amount")))


def monthly_sales(tx: DataFrame, pm: DataFrame, customers: DataFrame, level: str,
                  values: Sequence[str] | None, start, end) -> DataFrame:
    """A2: monthly SUM(amount) per member, plus per-member totals (month null) and the
    overall total (both null) from one grouping-sets aggregation."""
    daily = sales_series(tx, pm, customers, level, values, start, end)
    m = daily.withColumn("sales_month", month_start("sales_date"))
    return (m.rollup("filter_value", "sales_month")
            .agg(F.sum("total_amount").alias("total_amount")))


def filled_series(tx: DataFrame, pm: DataFrame, customers: DataFrame, level: str,
                  members: Sequence[str], start: str, end: str, daily_max_days: int = 31) -> DataFrame:
    """A3: every selected member × every period in [start, end], missing = 0.

    Up to ``daily_max_days`` days the period is the day, else the calendar month.  The
    grid is generated per member with ``sequence`` (bounded by the date range), not by a
    cross join, and left-joined to the aggregated sales."""
    import datetime as _dt

    n_days = (_dt.date.fromisoformat(end) - _dt.date.fromisoformat(start)).days + 1
    daily = n_days <= daily_max_days
    sales = sales_series(tx, pm, customers, level, members, start, end)
    spark = tx.sparkSession
    grid = spark.createDataFrame([(m,) for m in members], "filter_value string")
    if daily:
        seq = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))
        sales = sales.withColumnRenamed("sales_date", "period")
    else:
        seq = F.sequence(month_start(F.lit(start).cast("date")), month_start(F.lit(end).cast("date")),
                         F.expr("INTERVAL 1 MONTH"))
        sales = (sales.groupBy(month_start("sales_date").alias("period"), "filter_value")
                 .agg(F.sum("total_amount").alias("total_amount")))
    grid = grid.select("filter_value", F.explode(seq).alias("period"))
    return (grid.join(sales, ["filter_value", "period"], "left")
            .select("filter_value", "period",
                    F.coalesce("total_amount", F.lit(0).cast("decimal(28,4)")).alias("total_amount"),
                    F.lit("day" if daily else "month").alias("grain")))


def members_without_data(tx: DataFrame, pm: DataFrame, customers: DataFrame, level: str,
                         members: Sequence[str], start: str, end: str) -> DataFrame:
    """A3 (second output) / U1: selected members that have no sales in the range."""
    sales = sales_series(tx, pm, customers, level, members, start, end).select("filter_value")
    sel = tx.sparkSession.createDataFrame([(m,) for m in members], "filter_value string")
    return sel.join(sales, "filter_value", "left_anti")


def stock_summary(pm: DataFrame, inv: DataFrame, by: Sequence[str] = ("category", "subcategory")) -> DataFrame:
    """A4 + J3: active products ⟕ stock on (product, warehouse); SUM(stock) null → 0 and
    MAX(updated_at) per category / subcategory."""
    p = pm.filter(F.col("is_active") == "active")
    j = product_stock(p, inv)
    return (j.groupBy(*by).agg(F.sum("stock_quantity").alias("total_stock"),
                               F.max("stock_updated_at").alias("last_updated")))


def product_stock(pm: DataFrame, inv: DataFrame) -> DataFrame:
    """Product ⟕ inventory on (product_id, warehouse_id), missing stock → 0."""
    i = inv.select("product_id", "warehouse_id", "stock_quantity",
                   F.col("updated_at").alias("stock_updated_at"))
    return (pm.join(i, ["product_id", "warehouse_id"], "left")
            .withColumn("stock_quantity", F.coalesce("stock_quantity", F.lit(0).cast("decimal(18,4)"))))


def net_transactions(tx: DataFrame, pm: DataFrame, customer_id=None) -> DataFrame:
    """A5: net quantity per (customer, product, day) with the distinct document types
    joined by ','; relabelled sale / return / cancel-out; zero nets dropped."""
    t = tx if customer_id is None else tx.filter(F.col("customer_id") == F.lit(customer_id))
    t = t.join(dedup_product(pm).select("product_id", F.col("name_zh").alias("product_name")),
               "product_id")
    g = t.groupBy("customer_id", "product_name", "transaction_date").agg(
        F.sum("quantity").alias("quantity"),
        F.array_join(F.array_sort(F.collect_set("document_type")), ",").alias("doc_types"))
    label = (F.when(F.col("quantity") > 0, F.lit(NET_SALE)).when(F.col("quantity") < 0, F.lit(NET_RETURN))
             .otherwise(F.lit(NET_CANCEL)))
    return g.withColumn("document_type", label).filter(F.col("quantity") != 0)


def monthly_spend(tx: DataFrame, customer_id=None) -> DataFrame:
    """SUM(amount) per customer and 'YYYY-MM', with the customer's average over months."""
    t = tx if customer_id is None else tx.filter(F.col("customer_id") == F.lit(customer_id))
    m = (t.groupBy("customer_id", F.date_format("transaction_date", "yyyy-MM").alias("month"))
         .agg(F.sum("amount").alias("monthly_amount")))
    w = Window.partitionBy("customer_id")
    return m.withColumn("avg_monthly_amount",
                        F.sum("monthly_amount").over(w).cast("double") / F.count("*").over(w))


def purchase_history(tx: DataFrame, customer_id=None) -> DataFrame:
    """First / last purchase date and purchase count per (customer, product)."""
    t = tx.filter(F.col("document_type") == SALE)
    if customer_id is not None:
        t = t.filter(F.col("customer_id") == F.lit(customer_id))
    return t.groupBy("customer_id", "product_id").agg(
        F.min("transaction_date").alias("first_purchase"),
        F.max("transaction_date").alias("last_purchase"),
        F.count("*").alias("purchase_count"))


def sales_change(tx: DataFrame, pm: DataFrame, inv: DataFrame, recs: DataFrame | None, as_of) -> DataFrame:
    """Per active product, net quantity of the as-of month and of the month before,
    change amount, change % (0 when last month ≤ 0), stock and the top-3 recommended
    customers (A20 pivot of a long (product_id, rank, customer_id) table)."""
    cur = month_start(_d(as_of))
    prev = F.add_months(cur, -1)
    nxt = F.add_months(cur, 1)
    t = tx.filter((F.col("transaction_date") >= prev) & (F.col("transaction_date") < nxt))
    m = month_start("transaction_date")
    agg = t.groupBy("product_id").agg(
        F.sum(F.when(m == cur, F.col("quantity")).otherwise(F.lit(0))).alias("current_month_sales"),
        F.sum(F.when(m == prev, F.col("quantity")).otherwise(F.lit(0))).alias("last_month_sales"))
    stock = inv.groupBy("product_id").agg(F.sum("stock_quantity").alias("stock_quantity"))
    zero = F.lit(0).cast("decimal(28,4)")
    out = (pm.filter(F.col("is_active") == "active").select("product_id").distinct()
           .join(agg, "product_id", "left").join(stock, "product_id", "left")
           .select("product_id",
                   F.coalesce("last_month_sales", zero).alias("last_month_sales"),
                   F.coalesce("current_month_sales", zero).alias("current_month_sales"),
                   F.coalesce("stock_quantity", F.lit(0).cast("decimal(28,4)")).alias("stock_quantity")))
    out = out.withColumn("change_amount", F.col("current_month_sales") - F.col("last_month_sales"))
    pct = F.when(F.col("last_month_sales") > 0,
                 F.round(F.col("change_amount").cast("double") / F.col("last_month_sales").cast("double") * 100, 2)
                 ).otherwise(F.lit(0.0))
    out = out.withColumn("change_percentage", pct)
    if recs is not None:
        out = out.join(pivot_ranks(recs, "product_id", "customer_id", 3, "recommended_customer_id_rank"),
                       "product_id", "left")
    return out


def pivot_ranks(recs: DataFrame, key: str, value: str, n: int, prefix: str) -> DataFrame:
    """Long (key, rank, value) → key, prefix1..prefixN by conditional aggregate."""
    r = recs.filter(F.col("rank").between(1, n))
    return r.groupBy(key).agg(*[F.max(F.when(F.col("rank") == k, F.col(value))).alias(f"{prefix}{k}")
                                for k in range(1, n + 1)])


def change_stats(change: DataFrame) -> DataFrame:
    """One row: product count, increases / decreases / unchanged, distribution by
    change range, zero and low (< 10) stock counts, average stock, processed and
    unprocessed products (``processed``)."""
    p = F.col("change_percentage")
    return change.agg(
        F.count("*").alias("total_products"),
        F.count_if(F.col("processed")).alias("processed"),
        F.count_if(~F.col("processed")).alias("unprocessed"),
        F.count_if(F.col("change_amount") > 0).alias("increased"),
        F.count_if(F.col("change_amount") < 0).alias("decreased"),
        F.count_if(F.col("change_amount") == 0).alias("unchanged"),
        F.count_if(F.abs(p) >= 100).alias("change_ge_100"),
        F.count_if((F.abs(p) >= 50) & (F.abs(p) < 100)).alias("change_50_100"),
        F.count_if((F.abs(p) >= 20) & (F.abs(p) < 50)).alias("change_20_50"),
        F.count_if(F.abs(p) < 20).alias("change_lt_20"),
        F.count_if(F.col("stock_quantity") == 0).alias("zero_stock"),
        F.count_if((F.col("stock_quantity") > 0) & (F.col("stock_quantity") < 10)).alias("low_stock"),
        F.round(F.avg(F.col("stock_quantity").cast("double")), 6).alias("avg_stock"))


def sales_anomalies(change: DataFrame, pct: float = 500.0, jump_from_zero: float = 1000.0, k: int = 10) -> DataFrame:
    """abs(change %) > 500 or (current > 1000 and last = 0); top 10 by abs change %
    (ties by product id).  The limit is the feature: a top-k report."""
    c = change.filter((F.abs("change_percentage") > pct)
                      | ((F.col("current_month_sales") > jump_from_zero) & (F.col("last_month_sales") == 0)))
    return (c.select("product_id", "change_percentage", "current_month_sales", "last_month_sales")
            .orderBy(F.abs("change_percentage").desc(), F.col("product_id").asc()).limit(k))
