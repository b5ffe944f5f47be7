"""Customer lifecycle: lapsed customers, reactivation, repurchase reminders, new-product
flags, order confirmation and delivery rows (C1–C7, A22–A24, F14, S5 batch form).

Inequality conditions between a key's rows (order after a reminder, first scheduled day
after an order) are evaluated after aggregating one side to one row per key, so each
join is an equi-join with at most one partner per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.constants import (DELIVERY_FROM_ORDER, DELIVERY_FROM_PREDICTION, SALE, STATUS_CONFIRMED)
from ledgerflow.functions.calendar import elapsed_days, elapsed_days_fraction
from ledgerflow.functions.misc import transaction_id
from ledgerflow.functions.text import schedule_days
from ledgerflow.operators.sales import dedup_product

# FIXED VALUES: day-range labels of the reminder statistics.
REMINDER_RANGES = ("1-7天", "8-15天", "16-30天", "30天以上")
BUSINESS_TZ_HOURS = 8  # business clock is UTC+8


def _ts(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp")


def _date(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


# ----------------------------------------------------------------- lapsed customers
def inactive_customers(tx: DataFrame, customers: DataFrame, as_of: str, min_days: int = 30,
                       prev: DataFrame | None = None) -> DataFrame:
    """Customers whose last sale is ≥ ``min_days`` before ``as_of``: inactive days,
    last order date, last product.  With ``prev`` (the earlier table) known customers keep
    their first_inactive_date and get refreshed days; others start today.  Rows of
    ``prev`` that are no longer current stay as they were."""
    t = tx.filter((F.col("document_type") == SALE) & (F.col("transaction_date") <= _date(as_of)))
    last = t.groupBy("customer_id").agg(
        F.max("transaction_date").alias("last_order_date"),
        F.max_by("product_id", F.struct("transaction_date", "transaction_id")).alias("last_product"))
    cur = (last.withColumn("inactive_days", F.datediff(_date(as_of), "last_order_date"))
           .filter(F.col("inactive_days") >= min_days)
           .join(customers.select("customer_id", "customer_name"), "customer_id", "left")
           .withColumn("last_check_date", _date(as_of)))
    if prev is None:
        return cur.withColumn("first_inactive_date", _date(as_of)).withColumn("processed", F.lit(False)) \
                  .withColumn("reactivated_date", F.lit(None).cast("date"))
    p = prev.select("customer_id", F.col("first_inactive_date").alias("_first"), F.col("processed").alias("_proc"),
                    F.col("reactivated_date").alias("_react"))
    merged = (cur.join(p, "customer_id", "left")
              .withColumn("first_inactive_date", F.coalesce("_first", _date(as_of)))
              .withColumn("processed", F.coalesce("_proc", F.lit(False)))
              .withColumn("reactivated_date", F.col("_react")).drop("_first", "_proc", "_react"))
    kept = prev.join(cur.select("customer_id"), "customer_id", "left_anti")
    return merged.unionByName(kept.select(*merged.columns))


def reactivated(inactive: DataFrame, tx: DataFrame, as_of: str) -> DataFrame:
    """Inactive customers without a reactivated_date that ordered again after their
    last order date (up to ``as_of``) get the first such date."""
    t = tx.filter((F.col("document_type") == SALE) & (F.col("transaction_date") <= _date(as_of)))
    open_ = inactive.filter(F.col("reactivated_date").isNull())
    j = (t.select("customer_id", "transaction_date")
         .join(open_.select("customer_id", "last_order_date"), "customer_id")
         .filter(F.col("transaction_date") > F.col("last_order_date"))
         .groupBy("customer_id").agg(F.min("transaction_date").alias("_new")))
    return (inactive.join(j, "customer_id", "left")
            .withColumn("reactivated_date", F.coalesce("reactivated_date", "_new")).drop("_new"))


# -------------------------------------------------------------------------- reminders
def order_products(orders: DataFrame, pm: DataFrame) -> DataFrame:
    """Incoming orders with the purchased product's name (purchase_record)."""
    names = dedup_product(pm).select("product_id", F.col("name_zh").alias("product_name"))
    return orders.join(names, "product_id", "left")


def create_reminders(orders: DataFrame, rem: DataFrame | None, as_of: str, after_days: int = 1) -> DataFrame:
    """C3 (+ W2, J12, X5): newest new-product purchase per (customer, product name) that
    is at least ``after_days`` old and has no reminder yet → a reminder row."""
    now = _ts(as_of)
    o = orders.filter(F.col("is_new_product") & F.col("customer_id").isNotNull() & F.col("product_name").isNotNull()
                      & (F.col("created_at") <= now - F.expr(f"INTERVAL {after_days} DAYS")))
    if rem is not None:
        o = o.join(rem.select("customer_id", "product_name"), ["customer_id", "product_name"], "left_anti")
    newest = o.groupBy("customer_id", "product_name").agg(
        F.max_by(F.struct("id", "customer_name", "line_id", "created_at"), F.struct("created_at", "id")).alias("r"))
    return newest.select(
        "customer_id", F.col("r.customer_name").alias("customer_name"), F.col("r.line_id").alias("line_id"),
        "product_name", F.col("r.created_at").alias("last_purchase_date"),
        elapsed_days("r.created_at", now).alias("days_since_purchase"),
        F.lit(False).alias("reminder_sent"), now.alias("created_at"))


def age_reminders(rem: DataFrame, as_of: str) -> DataFrame:
    """C4: unsent reminders get days = elapsed seconds / 86400, rounded to whole days."""
    d = F.round(elapsed_days_fraction("last_purchase_date", _ts(as_of))).cast("long")
    upd = (~F.col("reminder_sent")) & F.col("last_purchase_date").isNotNull()
    return rem.withColumn("days_since_purchase", F.when(upd, d).otherwise(F.col("days_since_purchase")))


def close_reminders(rem: DataFrame, orders: DataFrame) -> DataFrame:
    """C5 + J13: unsent reminders are marked sent when the pair was ordered again after
    the reminder's purchase date."""
    last = orders.filter(F.col("customer_id").isNotNull()).groupBy("customer_id", "product_name").agg(
        F.max("created_at").alias("_last_order"))
    j = rem.join(last, ["customer_id", "product_name"], "left")
    bought = F.coalesce(F.col("_last_order") > F.col("last_purchase_date"), F.lit(False))
    return (j.withColumn("repurchased", (~F.col("reminder_sent")) & bought)
            .withColumn("reminder_sent", F.col("reminder_sent") | bought).drop("_last_order"))


def reminder_stats(rem: DataFrame) -> DataFrame:
    """Unsent reminders with days > 0 per day range, with the minimum days of the
    range (ranges are ordered by it)."""
    d = F.col("days_since_purchase")
    rng = (F.when(d.between(1, 7), F.lit(REMINDER_RANGES[0])).when(d.between(8, 15), F.lit(REMINDER_RANGES[1]))
           .when(d.between(16, 30), F.lit(REMINDER_RANGES[2])).when(d > 30, F.lit(REMINDER_RANGES[3])))
    r = rem.filter((~F.col("reminder_sent")) & (d > 0))
    return r.groupBy(rng.alias("day_range")).agg(F.count("*").alias("count"), F.min(d).alias("min_days")) \
            .orderBy("min_days")


def reminder_totals(rem: DataFrame, as_of: str) -> DataFrame:
    """Open total and reminders created on the as-of day (business clock UTC+8)."""
    local_day = F.to_date(F.col("created_at") + F.expr(f"INTERVAL {BUSINESS_TZ_HOURS} HOURS"))
    return rem.agg(F.count_if(~F.col("reminder_sent")).alias("open_total"),
                   F.count_if(local_day == _date(as_of)).alias("created_today"))


# ------------------------------------------------------------------ incoming orders
def flag_new_product(orders: DataFrame, tx: DataFrame) -> DataFrame:
    """A confirmed order is new when its customer had not bought the product before
    the order's day (first purchase per pair, then an equi-join)."""
    first = tx.filter(F.col("document_type") == SALE).groupBy("customer_id", "product_id").agg(
        F.min("transaction_date").alias("_first"))
    j = orders.join(first, ["customer_id", "product_id"], "left")
    new = F.col("_first").isNull() | (F.col("_first") >= F.to_date("created_at"))
    return j.withColumn("is_new_product", F.when(F.col("status") == STATUS_CONFIRMED, new).otherwise(F.lit(False))) \
            .drop("_first")


def confirm_orders(orders: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C7 (+ J10): confirmed orders of known customers → sale transaction rows (date =
    order creation day, deterministic 8-character id); orders of unknown customers are
    returned separately."""
    conf = orders.filter(F.col("status") == STATUS_CONFIRMED)
    known = conf.join(customers.select("customer_id"), "customer_id", "left_semi")
    unknown = conf.join(customers.select("customer_id"), "customer_id", "left_anti")
    tx = known.select(F.col("id").alias("source_order_id"), "customer_id", "product_id",
                      F.to_date("created_at").alias("transaction_date"), F.lit(SALE).alias("document_type"),
                      "quantity", "unit_price", "amount")
    return transaction_id(tx, ["source_order_id"], ["product_id"]), unknown


# ------------------------------------------------------------------------ deliveries
def next_scheduled_day(base: Column, schedule: Column) -> Column:
    """First day strictly after ``base`` whose weekday (1 = Monday … 7 = Sunday) is in
    the weekly schedule; null when there is no schedule."""
    days = schedule_days(schedule)
    cand = F.sequence(F.date_add(base, 1), F.date_add(base, 7))
    hit = F.filter(cand, lambda d: F.array_contains(days, F.weekday(d) + 1))
    return F.when(F.size(days) > 0, F.try_element_at(hit, F.lit(1)))


def schedule_delivery(orders: DataFrame, customers: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """S5 (batch form): confirmed orders → delivery rows with status 'order' on the next
    scheduled weekday after confirmation, and those of ``predictions``."""
    c = customers.select("customer_id", F.col("customer_name").alias("_cname"), "delivery_schedule")
    o = orders.filter((F.col("status") == STATUS_CONFIRMED) & F.col("customer_id").isNotNull()).join(c, "customer_id")
    base = F.to_date(F.coalesce("confirmed_at", "created_at"))
    rows = o.select(
        F.concat(F.lit("O"), F.col("id").cast("string")).alias("delivery_id"), "customer_id",
        F.coalesce("customer_name", "_cname").alias("customer_name"), "product_id", "product_name",
        next_scheduled_day(base, F.col("delivery_schedule")).alias("delivery_date"),
        "amount", "quantity", F.lit(DELIVERY_FROM_ORDER).alias("status"),
        F.col("id").cast("string").alias("source_order_id"))
    if predictions is not None:
        rows = rows.withColumn("product_id", F.col("product_id").cast("string")).unionByName(
            prediction_deliveries(predictions, customers))
    return rows


def prediction_deliveries(predictions: DataFrame, customers: DataFrame) -> DataFrame:
    """Positive purchase predictions → delivery rows with status 'prediction' on the
    next scheduled weekday on or after the predicted day; product ids as text."""
    c = customers.select("customer_id", F.col("customer_name").alias("_cname"), "delivery_schedule")
    p = predictions.filter(F.col("will_purchase_anything")).join(c, "customer_id")
    return p.select(
        F.concat_ws("-", F.lit("P"), F.col("customer_id").cast("string"), F.col("product_id").cast("string"),
                    F.col("prediction_date").cast("string")).alias("delivery_id"),
        "customer_id", F.col("_cname").alias("customer_name"), F.col("product_id").cast("string").alias("product_id"),
        F.lit(None).cast("string").alias("product_name"),
        next_scheduled_day(F.date_sub("prediction_date", 1), F.col("delivery_schedule")).alias("delivery_date"),
        F.lit(None).cast("decimal(18,4)").alias("amount"),
        F.col("estimated_quantity").cast("decimal(18,4)").alias("quantity"),
        F.lit(DELIVERY_FROM_PREDICTION).alias("status"), F.lit(None).cast("string").alias("source_order_id"))


def deliveries(ds: DataFrame, customer_id=None, product_id=None, status=None, date=None,
               start=None, end=None) -> DataFrame:
    """delivery lookups by customer, product, status, day or day range, ordered by
    date, customer, id."""
    d = ds
    for col, val in (("customer_id", customer_id), ("product_id", product_id), ("status", status)):
        if val is not None:
            d = d.filter(F.col(col) == F.lit(val))
    if date is not None:
        d = d.filter(F.col("delivery_date") == _date(date))
    if start is not None:
        d = d.filter(F.col("delivery_date") >= _date(start))
    if end is not None:
        d = d.filter(F.col("delivery_date") <= _date(end))
    return d.orderBy("delivery_date", "customer_id", "delivery_id")


def delivery_stats(ds: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """For one day: distinct customers and total quantity (a non-whole quantity
    counts 0), and quantity per product (blank product skipped)."""
    d = ds.filter(F.col("delivery_date") == _date(date))
    q = F.col("quantity").cast("double")
    qty = F.when(q == F.floor(q), q.cast("long")).otherwise(F.lit(0))
    card = d.agg(F.count_distinct("customer_id").alias("customers"), F.sum(qty).alias("total_quantity"))
    per = (d.filter(F.trim(F.coalesce(F.col("product_name"), F.lit(""))) != "")
           .groupBy("product_name").agg(F.sum(qty).alias("quantity")))
    return card, per


def inactive_stats(df: DataFrame, as_of: str) -> DataFrame:
    """Totals, created on the as-of day, reactivated in the as-of month, processed /
    unprocessed, and day buckets."""
    d = F.col("inactive_days")
    month = F.trunc(_date(as_of), "month")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("first_inactive_date") == _date(as_of)).alias("created_today"),
        F.count_if(F.col("reactivated_date") >= month).alias("reactivated_this_month"),
        F.count_if(F.col("processed")).alias("processed"),
        F.count_if(~F.col("processed")).alias("unprocessed"),
        F.count_if(d <= 60).alias("days_le_60"),
        F.count_if((d > 60) & (d <= 90)).alias("days_61_90"),
        F.count_if((d > 90) & (d <= 180)).alias("days_91_180"),
        F.count_if(d > 180).alias("days_gt_180"))


def purge(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """SNK9: keep rows newer than ``days`` before ``as_of`` (null time is kept)."""
    cut = _ts(as_of) - F.expr(f"INTERVAL {days} DAYS")
    return df.filter(F.col(ts).isNull() | (F.col(ts).cast("timestamp") > cut))
