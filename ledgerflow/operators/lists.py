"""List views used by the dashboard pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.misc import blank_to_null
from ledgerflow.operators.sales import dedup_product

# FIXED VALUES: group labels of the order list.
CHAT_GROUP_PREFIX = "Line用戶: "
UNKNOWN_GROUP = "未知客戶"


def reminder_list(pred: DataFrame, customers: DataFrame, pm: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """Predictions ⟕ customer ⟕ product (one row per product), names with fallback."""
    c = customers.select("customer_id", "customer_name", "phone_number")
    p = dedup_product(pm).select("product_id", F.col("name_zh").alias("product_name"))
    j = pred.join(c, "customer_id", "left").join(p, "product_id", "left")
    return (j.withColumn("customer_name", F.coalesce("customer_name", F.lit(unknown)))
            .withColumn("product_name", F.coalesce("product_name", F.lit(unknown))))


def group_orders(orders: DataFrame) -> DataFrame:
    """Every order with its group (customer name, else the marked chat id, else one
    group of unknown customers) and the group's number of orders and open orders.  Long
    rows: a group of any size is never gathered into one list."""
    name, line = blank_to_null(F.col("customer_name")), blank_to_null(F.col("line_id"))
    key = F.coalesce(name, F.concat(F.lit(CHAT_GROUP_PREFIX), line), F.lit(UNKNOWN_GROUP))
    o = orders.withColumn("group_key", key)
    cnt = o.groupBy("group_key").agg(F.count("*").alias("group_orders"), F.count_if(F.col("status") == "0").alias("group_open"))
    return o.join(cnt, "group_key")


def hierarchy(pm: DataFrame) -> DataFrame:
    """The hierarchy of the active products in long form: one row per category,
    subcategory and product name."""
    p = pm.filter((F.col("is_active") == "active") & F.col("category").isNotNull() & F.col("subcategory").isNotNull())
    return p.select("category", "subcategory", F.col("name_zh").alias("product_name")).distinct()


def dedup_best(pred: DataFrame, order_tie: str = "src") -> DataFrame:
    """One row per (customer, product, day): the highest probability wins."""
    from ledgerflow.operators.catalog import distinct_on
    return distinct_on(pred, ["customer_id", "product_id", "prediction_date"],
                       [F.col("purchase_probability").desc(), F.col(order_tie).asc()])
