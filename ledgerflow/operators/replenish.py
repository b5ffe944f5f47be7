"""Replenishment: who re-orders what, and when.

Design for scale:

* Purchases are first reduced to one row per (customer, product, day).  Everything
  per pair then works on at most ``window`` rows per pair, whatever the data size.
* The 28 purchase-cycle features (M12) are aggregated ONCE per pair from its history;
  terms that depend on the target day (days since last, expected-date deviation,
  preferred weekday, 7/14/30-day counts) are column expressions after the target days
  are exploded — the history is never rescanned per target day.
* Order-rate expectations per weekday (M10) use the number of such weekdays in the
  customer's span (arithmetic), not a materialised day grid.
* Samples are thinned by a seeded 64-bit hash (reproducible, no shuffle), not by a
  global sort.

The source fits per-customer Prophet models (M10) and a CatBoost classifier (M16);
neither library is available.  M10 uses the weekday mean of the gap-filled daily order
count (the source model is trend + weekly seasonality) and M16 uses Spark ML's
gradient-boosted trees.  Numbers differ from the source's; the decision rules around
them are the source's.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.constants import (ORDER_RATE_THRESHOLD_DEFAULT, ORDER_RATE_THRESHOLD_HIGH_VALUE,
                                  ORDER_RATE_THRESHOLD_NEW, SALE, SEGMENT_ACTIVE, SEGMENT_IMPORTANT,
                                  SEGMENT_NEW, SEGMENT_PLANNED, SEGMENT_VIP)
from ledgerflow.functions.misc import bucket_ge
from ledgerflow.session import checkpoint_dir

R = 6
PAIR = ["customer_id", "product_id"]


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


def _r(c: Column) -> Column:
    return F.round(c.cast("double"), R)


# ---------------------------------------------------------------- daily purchases
def daily_purchases(tx: DataFrame, start=None, end=None, sales_only: bool = True) -> DataFrame:
    """One row per (customer, product, day) in [start, end] with summed quantity and amount
    (the load step of the prediction jobs)."""
    t = tx.filter(F.col("document_type") == SALE) if sales_only else tx
    if start is not None:
        t = t.filter(F.col("transaction_date") >= _d(start))
    if end is not None:
        t = t.filter(F.col("transaction_date") <= _d(end))
    return t.groupBy("customer_id", "product_id", "transaction_date").agg(
        F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount"))


# ------------------------------------------------------------ customer statistics
def customer_stats(tx: DataFrame) -> DataFrame:
    """Per customer: transactions, distinct days, total / mean amount (2 decimals),
    total quantity, span days, weekly frequency = distinct days / (span / 7) (0 if the
    span is 0)."""
    g = tx.groupBy("customer_id").agg(
        F.count("*").alias("total_orders"),
        F.count_distinct("transaction_date").alias("unique_days"),
        F.round(F.sum("amount"), 2).cast("double").alias("total_amount"),
        (F.sum("amount").cast("double") / F.count("*")).alias("avg_amount"),
        F.sum("quantity").alias("total_quantity"),
        F.datediff(F.max("transaction_date"), F.min("transaction_date")).alias("span_days"))
    freq = F.when(F.col("span_days") > 0, F.col("unique_days") / (F.col("span_days") / 7.0)).otherwise(F.lit(0.0))
    return g.withColumn("weekly_frequency", _r(freq))


def daily_orders(tx: DataFrame) -> DataFrame:
    """Amount, quantity and order count per customer per day."""
    return tx.groupBy("customer_id", "transaction_date").agg(
        F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"), F.count("*").alias("order_count"))


def segment_customers(stats: DataFrame) -> DataFrame:
    """M7: VIP (amount ≥ 5000, freq ≥ 1.5), important (≥ 2000, ≥ 0.8), active (freq ≥ 0.5),
    planned (≥ 3 orders), else new."""
    a, f = F.col("total_amount"), F.col("weekly_frequency")
    seg = (F.when((a >= 5000) & (f >= 1.5), F.lit(SEGMENT_VIP)).when((a >= 2000) & (f >= 0.8), F.lit(SEGMENT_IMPORTANT))
           .when(f >= 0.5, F.lit(SEGMENT_ACTIVE)).when(F.col("total_orders") >= 3, F.lit(SEGMENT_PLANNED))
           .otherwise(F.lit(SEGMENT_NEW)))
    return stats.withColumn("segment", seg)


def eligible_customers(stats: DataFrame) -> DataFrame:
    """M8: ≥ 5 transactions and score ≥ 2 where score = 2·(≥3 days) + 2·(span ≥ 14) +
    1·(≥ 8 transactions)."""
    score = (F.when(F.col("unique_days") >= 3, 2).otherwise(0) + F.when(F.col("span_days") >= 14, 2).otherwise(0)
             + F.when(F.col("total_orders") >= 8, 1).otherwise(0))
    return stats.withColumn("model_score", score).filter((F.col("total_orders") >= 5) & (F.col("model_score") >= 2))


def daily_series(tx: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """M9: every day from a customer's first to last order, amount / quantity / order count
    (0 where none).  The grid is a per-customer ``sequence``."""
    d = daily_orders(tx)
    if customers is not None:
        d = d.join(customers.select("customer_id"), "customer_id", "left_semi")
    span = d.groupBy("customer_id").agg(F.min("transaction_date").alias("a"), F.max("transaction_date").alias("b"))
    grid = span.select("customer_id", F.explode(F.sequence("a", "b")).alias("transaction_date"))
    return (grid.join(d, ["customer_id", "transaction_date"], "left")
            .select("customer_id", "transaction_date",
                    F.coalesce("amount", F.lit(0).cast("decimal(28,4)")).alias("amount"),
                    F.coalesce("quantity", F.lit(0).cast("decimal(28,4)")).alias("quantity"),
                    F.coalesce("order_count", F.lit(0).cast("long")).alias("order_count")))


def _weekday_count(a: Column, b: Column, wd: int) -> Column:
    """Number of days d in [a, b] with weekday(d) = wd (Mon = 0)."""
    total = F.datediff(b, a) + 1
    off = F.pmod(F.lit(wd) - F.weekday(a), F.lit(7))
    return F.floor(total / 7) + F.when(off < F.pmod(total, F.lit(7)), 1).otherwise(0)


def order_rate_by_weekday(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Expected orders per day for each (customer, weekday): the weekday mean of the M9
    series, i.e. orders on that weekday / number of that weekday in the customer's span."""
    d = daily_orders(tx).join(customers.select("customer_id"), "customer_id", "left_semi")
    span = d.groupBy("customer_id").agg(F.min("transaction_date").alias("a"), F.max("transaction_date").alias("b"))
    per = d.groupBy("customer_id", F.weekday("transaction_date").alias("weekday")).agg(
        F.sum("order_count").alias("orders"))
    days = span.select("customer_id", F.explode(F.array(*[F.struct(F.lit(w).alias("weekday"),
                                                                    _weekday_count(F.col("a"), F.col("b"), w).alias("n"))
                                                          for w in range(7)])).alias("x")).select(
        "customer_id", "x.weekday", "x.n")
    j = days.join(per, ["customer_id", "weekday"], "left")
    return j.select("customer_id", "weekday",
                    F.when(F.col("n") > 0, F.coalesce("orders", F.lit(0)) / F.col("n")).otherwise(F.lit(0.0))
                    .alias("expected_orders"))


def top_products(tx: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent products per customer (ties by product id)."""
    from ledgerflow.operators.catalog import top_k_per
    g = tx.groupBy("customer_id", "product_id").agg(F.count("*").alias("frequency"))
    return top_k_per(g, ["customer_id"], [F.col("frequency").desc(), F.col("product_id").asc()], k, "product_rank")


def predict_orders(tx: DataFrame, as_of: str, days: int = 7, history_days: int = 180) -> DataFrame:
    """For every eligible customer (M8) and each of the next ``days`` days: expected
    orders (weekday mean), threshold by segment (0.15 VIP / important, 0.4 new, 0.25
    other); at or above it one row per top-3 product with probability min(1, x/thr),
    quantity max(1, int(x)), confidence 'high' above 1.5·thr else 'medium'; otherwise one
    negative row (product '', probability 0, quantity 0, 'low')."""
    hist = tx.filter((F.col("document_type") == SALE) & (F.col("transaction_date") <= _d(as_of)))
    seg = segment_customers(customer_stats(hist))
    elig = eligible_customers(seg).select("customer_id", "segment")
    rate = order_rate_by_weekday(hist, elig)
    targets = elig.select("customer_id", "segment", F.explode(
        F.sequence(F.date_add(_d(as_of), 1), F.date_add(_d(as_of), days))).alias("prediction_date"))
    t = targets.join(rate, (targets.customer_id == rate.customer_id)
                     & (F.weekday(targets.prediction_date) == rate.weekday), "left").drop(rate.customer_id)
    x = F.greatest(F.coalesce(F.col("expected_orders"), F.lit(0.0)), F.lit(0.0))
    seg_c = F.col("segment")
    thr = (F.when(seg_c.isin(SEGMENT_VIP, SEGMENT_IMPORTANT), F.lit(ORDER_RATE_THRESHOLD_HIGH_VALUE))
           .when(seg_c == SEGMENT_NEW, F.lit(ORDER_RATE_THRESHOLD_NEW)).otherwise(F.lit(ORDER_RATE_THRESHOLD_DEFAULT)))
    t = t.select("customer_id", "segment", "prediction_date", x.alias("x"), thr.alias("thr"))
    recent = hist.filter(F.col("transaction_date") >= F.date_sub(_d(as_of), history_days))
    tops = top_products(recent, 3).select("customer_id", F.col("product_id").cast("string").alias("top_product"))
    has_top = tops.select("customer_id").distinct().withColumn("_has", F.lit(True))
    t = t.join(has_top, "customer_id", "left").withColumn("will", (F.col("x") >= F.col("thr")) & F.col("_has").isNotNull())
    pos = t.filter("will").join(tops, "customer_id").select(
        "customer_id", F.col("top_product").alias("product_id"), "prediction_date",
        F.lit(True).alias("will_purchase_anything"),
        _r(F.least(F.lit(1.0), F.col("x") / F.col("thr"))).alias("purchase_probability"),
        F.greatest(F.lit(1), F.floor("x").cast("long")).alias("estimated_quantity"),
        F.when(F.col("x") > F.col("thr") * 1.5, F.lit("high")).otherwise(F.lit("medium")).alias("confidence_level"),
        F.col("segment").alias("original_segment"))
    neg = t.filter(~F.col("will")).select(
        "customer_id", F.lit("").alias("product_id"), "prediction_date", F.lit(False).alias("will_purchase_anything"),
        F.lit(0.0).alias("purchase_probability"), F.lit(0).cast("long").alias("estimated_quantity"),
        F.lit("low").alias("confidence_level"), F.col("segment").alias("original_segment"))
    return pos.unionByName(neg)


# ------------------------------------------------------------------ qualified pairs
def qualified_pairs(daily: DataFrame, reference_date: str, min_purchases: int = 3, max_inactive_days: int = 30,
                    min_pair_history: int = 2) -> DataFrame:
    """Pairs whose customer has ≥ 3 purchase days in the window and bought within 30
    days of the reference date, and which themselves have ≥ 2 purchase days."""
    cust = daily.groupBy("customer_id").agg(F.count("*").alias("total_purchases"),
                                            F.max("transaction_date").alias("last_purchase"))
    cust = cust.filter((F.col("total_purchases") >= min_purchases)
                       & (F.datediff(_d(reference_date), "last_purchase") <= max_inactive_days))
    pairs = daily.join(cust.select("customer_id"), "customer_id", "left_semi").groupBy(*PAIR).agg(
        F.count("*").alias("cp_purchases"))
    return pairs.filter(F.col("cp_purchases") >= min_pair_history)


# --------------------------------------------------------------- cycle features
FEATURES_M12 = [
    "day_of_week", "day_of_month", "is_weekend", "preferred_weekday", "is_preferred_weekday",
    "preferred_weekday_strength", "weekday_entropy", "days_since_last", "time_decay_factor", "time_decay_squared",
    "time_decay_log", "avg_interval", "interval_std", "interval_cv", "regularity_score",
    "expected_purchase_deviation", "is_expected_date", "purchase_acceleration", "interval_stability",
    "recent_interval_trend", "recent_avg_interval", "recent_interval_stability", "recent_vs_overall_ratio",
    "cp_total_purchases", "cp_total_quantity", "cp_avg_quantity", "cp_quantity_trend", "cp_recent_7d",
    "cp_recent_14d", "cp_recent_30d", "purchase_density"]


def pair_history_stats(daily: DataFrame, pairs: DataFrame, cut: str, targets: Sequence[str]) -> DataFrame:
    """Per pair aggregates of its purchase days strictly before ``cut`` (W4, W5).  For the
    target days, the 7/14/30-day counts are arrays aligned with ``targets``."""
    h = daily.filter(F.col("transaction_date") < _d(cut)).join(pairs.select(*PAIR), PAIR, "left_semi")
    w = Window.partitionBy(*PAIR).orderBy("transaction_date")
    h = (h.withColumn("g", F.datediff("transaction_date", F.lag("transaction_date").over(w)))
         .withColumn("rn", F.row_number().over(w))
         .withColumn("n_", F.count("*").over(Window.partitionBy(*PAIR))))
    rn, n, g, d = F.col("rn"), F.col("n_"), F.col("g"), F.col("transaction_date")
    wd = F.weekday(d)
    counts = []
    for days in (7, 14, 30):
        counts.append(F.array(*[F.sum(F.when(d >= F.date_sub(_d(t), days), 1).otherwise(0)) for t in targets])
                      .alias(f"r{days}"))
    return h.groupBy(*PAIR).agg(
        F.count("*").alias("n"), F.min(d).alias("first_date"), F.max(d).alias("last_date"),
        F.sum("quantity").alias("sum_q"),
        F.max(F.when(rn == 1, F.col("quantity"))).alias("q_first"),
        F.max(F.when(rn == n, F.col("quantity"))).alias("q_last"),
        F.stddev_samp(g.cast("double")).alias("std_g"),
        F.avg(F.when(rn >= n - 2, g.cast("double"))).alias("recent3_g"),
        F.avg(F.when((rn >= 2) & (rn <= 1 + F.greatest(F.lit(1), n - 4)), g.cast("double"))).alias("early_g"),
        F.max(F.when(rn == n, g)).alias("g_last"), F.max(F.when(rn == n - 1, g)).alias("g_prev"),
        *[F.sum(F.when(wd == k, 1).otherwise(0)).alias(f"c{k}") for k in range(7)],
        *counts)


def cycle_features(daily: DataFrame, pairs: DataFrame, cut: str, targets: Sequence[str]) -> DataFrame:
    """The 28 purchase-cycle features for every pair × target day, from the pair's
    purchase days strictly before ``cut`` (cut ≤ every target day).  Pairs without history
    get the documented defaults."""
    st = pair_history_stats(daily, pairs, cut, targets)
    tg = F.explode(F.arrays_zip(F.array(*[_d(t) for t in targets]).alias("t"),
                                F.sequence(F.lit(0), F.lit(len(targets) - 1)).alias("i")))
    base = pairs.select(*PAIR).distinct().select(*PAIR, tg.alias("x")).select(*PAIR, F.col("x.t").alias("target_date"),
                                                                              F.col("x.i").alias("ti"))
    j = base.join(st, PAIR, "left")
    t = F.col("target_date")
    n = F.coalesce(F.col("n"), F.lit(0))
    has = n > 0
    twd = F.weekday(t)
    cs = [F.col(f"c{k}") for k in range(7)]
    cmax = F.greatest(*cs)
    pref = None
    for k in range(7):
        pref = F.when(cs[k] == cmax, F.lit(k)) if pref is None else pref.when(cs[k] == cmax, F.lit(k))
    ent_terms = [F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(F.lit(0.0)) for c in cs]
    n_wd = sum(F.when(c > 0, 1).otherwise(0) for c in cs)
    entropy = F.when(n_wd > 1, sum(ent_terms) / F.lit(math.log2(7))).otherwise(F.lit(0.0))
    dsl = F.datediff(t, "last_date")
    avg = F.when(n >= 2, F.datediff("last_date", "first_date") / (n - 1)).otherwise(F.lit(0.0))
    std = F.when(n >= 3, F.col("std_g")).otherwise(F.lit(0.0))
    cv = F.when(avg > 0, std / avg).otherwise(F.lit(0.0))
    dev = F.abs(F.floor(dsl - avg))
    accel = F.when((n >= 4) & (F.col("early_g") > 0), (F.col("early_g") - F.col("recent3_g")) / F.col("early_g")) \
             .otherwise(F.lit(0.0))
    g1, g2 = F.col("g_prev").cast("double"), F.col("g_last").cast("double")
    std2 = F.abs(g2 - g1) / F.lit(math.sqrt(2.0))
    span = F.datediff("last_date", "first_date")
    q = F.col("sum_q").cast("double")
    ti = F.col("ti") + 1
    feats = {
        "day_of_week": twd,
        "day_of_month": F.dayofmonth(t),
        "is_weekend": F.when(twd >= 5, 1).otherwise(0),
        "preferred_weekday": F.when(has, pref).otherwise(twd),
        "is_preferred_weekday": F.when(has & (pref == twd), 1).otherwise(0),
        "preferred_weekday_strength": F.when(has, cmax / n).otherwise(F.lit(0.0)),
        "weekday_entropy": F.when(has, entropy).otherwise(F.lit(0.0)),
        "days_since_last": F.when(has, dsl).otherwise(F.lit(999)),
        "time_decay_factor": F.when(has, F.exp(-dsl / 30.0)).otherwise(F.lit(0.0)),
        "time_decay_squared": F.when(has, F.exp(-(dsl * dsl) / 900.0)).otherwise(F.lit(0.0)),
        "time_decay_log": F.when(has, F.exp(-F.log1p(dsl) / 3.0)).otherwise(F.lit(0.0)),
        "avg_interval": avg,
        "interval_std": std,
        "interval_cv": cv,
        "regularity_score": F.when(n >= 2, F.when(cv > 0, 1 / (1 + cv)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)),
        "expected_purchase_deviation": F.when(n >= 2, dev).otherwise(F.lit(999)),
        "is_expected_date": F.when((n >= 2) & (dev <= 1), 1).otherwise(0),
        "purchase_acceleration": accel,
        "interval_stability": F.when(n >= 2, F.when(std > 0, 1 / (1 + std)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0)),
        "recent_interval_trend": F.when(n >= 3, g2 - g1).otherwise(F.lit(0.0)),
        "recent_avg_interval": F.when(n >= 3, (g1 + g2) / 2).otherwise(F.lit(0.0)),
        "recent_interval_stability": F.when(n >= 3, F.when(std2 > 0, 1 / (1 + std2)).otherwise(F.lit(1.0)))
                                      .otherwise(F.lit(0.0)),
        "recent_vs_overall_ratio": F.when((n >= 3) & (avg > 0), ((g1 + g2) / 2) / avg).otherwise(F.lit(1.0)),
        "cp_total_purchases": n,
        "cp_total_quantity": F.coalesce(q, F.lit(0.0)),
        "cp_avg_quantity": F.when(has, q / n).otherwise(F.lit(0.0)),
        "cp_quantity_trend": F.when(n > 1, (F.col("q_last") - F.col("q_first")).cast("double") / (n - 1))
                              .otherwise(F.lit(0.0)),
        "cp_recent_7d": F.coalesce(F.element_at("r7", ti), F.lit(0)),
        "cp_recent_14d": F.coalesce(F.element_at("r14", ti), F.lit(0)),
        "cp_recent_30d": F.coalesce(F.element_at("r30", ti), F.lit(0)),
        "purchase_density": F.when(n > 1, n / F.greatest(span, F.lit(1))).otherwise(F.lit(0.0)),
    }
    ints = {"day_of_week", "day_of_month", "is_weekend", "preferred_weekday", "is_preferred_weekday",
            "days_since_last", "expected_purchase_deviation", "is_expected_date", "cp_total_purchases",
            "cp_recent_7d", "cp_recent_14d", "cp_recent_30d"}
    cols = [(feats[k].cast("long") if k in ints else _r(feats[k])).alias(k) for k in FEATURES_M12]
    return j.select(*PAIR, "target_date", F.date_format(t, "EEEE").alias("weekday_name"), *cols)


# ---------------------------------------------------------- activity features
FEATURES_M13 = [
    "prediction_day_of_week", "prediction_day_of_month", "prediction_month", "prediction_quarter",
    "customer_purchase_days_90d", "customer_total_amount_90d", "customer_avg_amount_90d",
    "customer_total_quantity_90d", "customer_unique_products_90d", "days_since_customer_last_purchase",
    "product_sale_days_90d", "product_total_quantity_90d", "product_unique_customers_90d",
    "product_avg_quantity_per_sale_90d", "cp_purchase_count_90d", "cp_total_quantity_90d", "cp_avg_quantity_90d",
    "cp_total_amount_90d", "days_since_cp_last_purchase"]


def activity_features(daily: DataFrame, pairs: DataFrame, targets: Sequence[str], window_days: int = 90) -> DataFrame:
    """19 features per (pair, target day) from the ``window_days`` days of daily rows
    before the target: customer, product and pair aggregates plus calendar; 999 days if
    never bought.

    Each daily row is exploded into the (few, listed) target days whose window holds it,
    so the windows are filled without a join; pairs × targets come from exploding the
    literal target list."""
    tarr = F.array(*[_d(t) for t in targets])
    d = F.col("transaction_date")
    rows = daily.select("*", F.explode(F.filter(tarr, lambda t: (d >= F.date_sub(t, window_days)) & (d < t)))
                        .alias("target_date"))
    keys = pairs.select(*PAIR).distinct().select(*PAIR, F.explode(tarr).alias("target_date"))
    return _activity_from_windows(rows, keys.withColumn("label", F.lit(None).cast("int"))
                                  .withColumn("has_history", F.lit(None).cast("boolean"))) \
        .drop("label", "has_history").withColumnRenamed("sample_date", "target_date")


# -------------------------------------------------------------------------- samples
def hash_unit(cols: Sequence[str], seed: int) -> Column:
    """A reproducible uniform number in [0, 1) from the row's keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def thin_negatives(samples: DataFrame, ratio: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Keep all positives and about ``ratio`` negatives per positive: a negative stays when
    its key hash is below ratio·P / N (both counts from one scalar aggregate)."""
    cnt = samples.agg(F.struct(F.count_if(F.col("label") == 1).alias("p"),
                               F.count_if(F.col("label") == 0).alias("n")).alias("c")).scalar()
    rate = F.least(F.lit(1.0), F.lit(ratio) * cnt["p"] / F.greatest(cnt["n"], F.lit(1)))
    return samples.filter((F.col("label") == 1) | (hash_unit(keys, seed) < rate))


def rolling_samples(daily: DataFrame, end: str, window_days: int = 90, label_days: int = 7, ratio: float | None = None) -> DataFrame:
    """Qualified pairs (M11, window ending ``end``) × the non-Sunday days of the last
    ``label_days`` days; label = a purchase of the pair that day; features (M12) only from
    days before the label window (leak guard).  With ``ratio`` the negatives are thinned, on
    the bare keys, before any feature is computed."""
    import datetime as _dt

    e = _dt.date.fromisoformat(end)
    start = e - _dt.timedelta(days=window_days)
    val_start = e - _dt.timedelta(days=label_days - 1)
    targets = [(val_start + _dt.timedelta(days=i)).isoformat() for i in range(label_days)
               if (val_start + _dt.timedelta(days=i)).weekday() != 6]
    win = daily.filter((F.col("transaction_date") >= F.lit(start.isoformat()).cast("date"))
                       & (F.col("transaction_date") <= F.lit(end).cast("date")))
    pairs = qualified_pairs(win, end)
    lab = win.select(*PAIR, F.col("transaction_date").alias("target_date")).distinct().withColumn("label", F.lit(1))
    if ratio is None:
        feats = cycle_features(win, pairs, val_start.isoformat(), targets)
        return feats.join(lab, [*PAIR, "target_date"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    days = F.explode(F.array(*[_d(t) for t in targets])).alias("target_date")
    keys = (pairs.select(*PAIR).distinct().select(*PAIR, days).join(lab, [*PAIR, "target_date"], "left")
            .withColumn("label", F.coalesce("label", F.lit(0))))
    keys = thin_negatives(keys, ratio, [*PAIR, "target_date"])
    feats = cycle_features(win, keys.select(*PAIR).distinct(), val_start.isoformat(), targets)
    return feats.join(keys, [*PAIR, "target_date"])


def training_samples(daily: DataFrame, first: str, last: str, step_days: int = 15, history_days: int = 90,
                     label_days: int = 7, only_with_history: bool = False, ratio: float | None = None) -> DataFrame:
    """Every ``step_days`` sample date: pairs with history in the
    previous 90 days or a purchase in the next 7; label = bought within the next 7 days;
    activity features (M13) from the 90 days before.  ``only_with_history`` drops positives
    without history (one trainer's rule).  With ``ratio`` the negatives are thinned, on the
    bare keys, before any feature is computed."""
    from ledgerflow.operators.catalog import sample_windows

    sw = sample_windows(daily, first, last, step_days, history_days, label_days)
    hist = sw.filter(F.col("role") == "history").select("sample_date", *PAIR).distinct().withColumn("_h", F.lit(True))
    lab = sw.filter(F.col("role") == "label").select("sample_date", *PAIR).distinct().withColumn("label", F.lit(1))
    keys = hist.join(lab, ["sample_date", *PAIR], "full")
    keys = keys.withColumn("label", F.coalesce("label", F.lit(0))).withColumn("has_history", F.coalesce("_h", F.lit(False)))
    if only_with_history:
        keys = keys.filter("has_history")
    keys = keys.drop("_h")
    if ratio is not None:
        keys = thin_negatives(keys, ratio, [*PAIR, "sample_date"])
    hist_rows = sw.filter(F.col("role") == "history").withColumnRenamed("sample_date", "target_date")
    feats = _activity_from_windows(hist_rows, keys.withColumnRenamed("sample_date", "target_date"))
    return feats


def _activity_from_windows(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """M13 features for (target_date, pair) keys, given rows already tagged with the target
    date of the 90-day window that holds them."""
    cust = rows.groupBy("target_date", "customer_id").agg(
        F.count_distinct("transaction_date").alias("customer_purchase_days_90d"),
        F.sum("amount").cast("double").alias("customer_total_amount_90d"),
        _r(F.sum("amount").cast("double") / F.count("*")).alias("customer_avg_amount_90d"),
        F.sum("quantity").cast("double").alias("customer_total_quantity_90d"),
        F.count_distinct("product_id").alias("customer_unique_products_90d"),
        F.max("transaction_date").alias("_cl"))
    prod = rows.groupBy("target_date", "product_id").agg(
        F.count_distinct("transaction_date").alias("product_sale_days_90d"),
        F.sum("quantity").cast("double").alias("product_total_quantity_90d"),
        F.count_distinct("customer_id").alias("product_unique_customers_90d"),
        _r(F.sum("quantity").cast("double") / F.count("*")).alias("product_avg_quantity_per_sale_90d"))
    cp = rows.groupBy("target_date", *PAIR).agg(
        F.count("*").alias("cp_purchase_count_90d"), F.sum("quantity").cast("double").alias("cp_total_quantity_90d"),
        _r(F.sum("quantity").cast("double") / F.count("*")).alias("cp_avg_quantity_90d"),
        F.sum("amount").cast("double").alias("cp_total_amount_90d"),
        F.max("transaction_date").alias("_pl"))
    j = (keys.join(cust, ["target_date", "customer_id"], "left").join(prod, ["target_date", "product_id"], "left")
         .join(cp, ["target_date", *PAIR], "left"))
    t = F.col("target_date")
    z = F.lit(0)
    return j.select(
        *PAIR, F.col("target_date").alias("sample_date"), "label", "has_history",
        F.weekday(t).alias("prediction_day_of_week"), F.dayofmonth(t).alias("prediction_day_of_month"),
        F.month(t).alias("prediction_month"), F.quarter(t).alias("prediction_quarter"),
        F.coalesce("customer_purchase_days_90d", z).alias("customer_purchase_days_90d"),
        F.coalesce("customer_total_amount_90d", F.lit(0.0)).alias("customer_total_amount_90d"),
        F.coalesce("customer_avg_amount_90d", F.lit(0.0)).alias("customer_avg_amount_90d"),
        F.coalesce("customer_total_quantity_90d", F.lit(0.0)).alias("customer_total_quantity_90d"),
        F.coalesce("customer_unique_products_90d", z).alias("customer_unique_products_90d"),
        F.coalesce(F.least(F.datediff(t, "_cl"), F.lit(999)), F.lit(999)).alias("days_since_customer_last_purchase"),
        F.coalesce("product_sale_days_90d", z).alias("product_sale_days_90d"),
        F.coalesce("product_total_quantity_90d", F.lit(0.0)).alias("product_total_quantity_90d"),
        F.coalesce("product_unique_customers_90d", z).alias("product_unique_customers_90d"),
        F.coalesce("product_avg_quantity_per_sale_90d", F.lit(0.0)).alias("product_avg_quantity_per_sale_90d"),
        F.coalesce("cp_purchase_count_90d", z).alias("cp_purchase_count_90d"),
        F.coalesce("cp_total_quantity_90d", F.lit(0.0)).alias("cp_total_quantity_90d"),
        F.coalesce("cp_avg_quantity_90d", F.lit(0.0)).alias("cp_avg_quantity_90d"),
        F.coalesce("cp_total_amount_90d", F.lit(0.0)).alias("cp_total_amount_90d"),
        F.coalesce(F.least(F.datediff(t, "_pl"), F.lit(999)), F.lit(999)).alias("days_since_cp_last_purchase"))


# ------------------------------------------- model metrics and scoring (M16–M18; training: boosting.py)
def evaluate(scored: DataFrame, threshold: float) -> DataFrame:
    """AUC (Spark evaluator, computed distributed) plus accuracy / precision / recall / F1
    at ``threshold`` from one aggregate."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import vector_to_array

    p = scored.withColumn("p1", vector_to_array("probability")[1])
    auc = BinaryClassificationEvaluator(labelCol="label_d", rawPredictionCol="rawPrediction",
                                        metricName="areaUnderROC").evaluate(p)
    yhat = F.col("p1") >= threshold
    y = F.col("label") == 1
    m = p.agg(F.count("*").alias("n"), F.count_if(yhat & y).alias("tp"), F.count_if(yhat & ~y).alias("fp"),
              F.count_if(~yhat & y).alias("fn"), F.count_if(~yhat & ~y).alias("tn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    return m.select("n", "tp", "fp", "fn", "tn", F.lit(float(auc)).alias("auc"),
                    ((F.col("tp") + F.col("tn")) / F.greatest(F.col("n"), F.lit(1))).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"),
                    F.lit(threshold).alias("threshold"))


def score(model, daily: DataFrame, pairs: DataFrame, as_of: str, days: int = 7, threshold: float = 0.5) -> DataFrame:
    """M17 (+ W8): score every pair × the next ``days`` days; keep each pair's best day
    (highest probability, earliest on ties) when ≥ ``threshold``; quantity = max(1, min of
    the last 3 purchase quantities)."""
    import datetime as _dt
    from pyspark.ml.functions import vector_to_array

    a = _dt.date.fromisoformat(as_of)
    targets = [(a + _dt.timedelta(days=i)).isoformat() for i in range(1, days + 1)]
    cut = (a + _dt.timedelta(days=1)).isoformat()
    feats = cycle_features(daily, pairs, cut, targets)
    p = model.transform(feats).withColumn("purchase_probability", F.round(vector_to_array("probability")[1], R))
    w = Window.partitionBy(*PAIR).orderBy(F.col("purchase_probability").desc(), F.col("target_date").asc())
    best = p.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") == 1)
                                                             & (F.col("purchase_probability") >= threshold))
    lastq = _last_quantities(daily.filter(F.col("transaction_date") <= _d(as_of)), 3)
    return best.join(lastq, PAIR, "left").select(
        *PAIR, F.col("target_date").alias("prediction_date"), "purchase_probability",
        F.greatest(F.lit(1), F.coalesce(F.floor("min_recent_q"), F.lit(1)).cast("long")).alias("estimated_quantity"),
        F.lit(True).alias("will_purchase_anything"))


def _last_quantities(daily: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(*PAIR).orderBy(F.col("transaction_date").desc())
    return (daily.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
            .groupBy(*PAIR).agg(F.min("quantity").alias("min_recent_q")))


def find_val_week(daily: DataFrame, as_of: str, min_sales: int = 50) -> DataFrame:
    """Newest full Monday–Sunday week 3 to 7 weeks back with ≥ ``min_sales`` sale
    rows; else the 7 days ending 14 days back.  Rows are keyed by their week's Monday and
    counted for the 5 candidate weeks in one grouped count (equi-join on the Monday)."""
    a = _d(as_of)
    this_monday = F.date_sub(a, F.weekday(a))
    d = F.col("transaction_date")
    wk = daily.select(F.date_sub(d, F.weekday(d)).alias("week_start"))
    cands = daily.sparkSession.range(3, 8).select(F.col("id").cast("int").alias("weeks_back")).select(
        "weeks_back", F.date_sub(this_monday, F.col("weeks_back") * 7).alias("week_start"))
    cnt = wk.join(F.broadcast(cands), "week_start").groupBy("weeks_back", "week_start").agg(F.count("*").alias("sales"))
    best = cnt.filter(F.col("sales") >= min_sales).agg(F.min_by(F.col("week_start"), F.col("weeks_back")).alias("ws"))
    ws = best.select("ws").scalar()
    return daily.sparkSession.range(1).select(
        F.coalesce(ws, F.date_sub(a, 20)).alias("val_start"),
        F.coalesce(F.date_add(ws, 6), F.date_sub(a, 14)).alias("val_end"),
        ws.isNull().alias("fallback"))


# --------------------------------------------------------- predictions bookkeeping
def prediction_status(pred: DataFrame, daily: DataFrame, eval_date: str, tolerance: int = 2) -> DataFrame:
    """Status of positive predictions at ``eval_date``: 'fulfilled' when a purchase of the
    pair lies within ±tolerance days (J20); 'expired' when its day + tolerance has passed;
    else 'active'.  Negative predictions stay 'active'."""
    from ledgerflow.operators.catalog import hits_within

    p = pred.withColumn("product_id", F.col("product_id").cast("string"))
    dd = daily.filter(F.col("transaction_date") <= _d(eval_date)).withColumn("product_id",
                                                                             F.col("product_id").cast("string"))
    pos = p.filter("will_purchase_anything")
    hits = hits_within(pos.select(*PAIR, "prediction_date"), dd, tolerance).withColumn("_hit", F.lit(True))
    j = p.join(hits, [*PAIR, "prediction_date"], "left")
    st = (F.when(F.col("_hit"), F.lit("fulfilled"))
          .when(F.col("will_purchase_anything") & (F.date_add("prediction_date", tolerance) < _d(eval_date)),
                F.lit("expired")).otherwise(F.lit("active")))
    return j.withColumn("prediction_status", st).drop("_hit")


def status_shares(pred: DataFrame) -> DataFrame:
    """Count and percent of all rows per status (total as a scalar subquery)."""
    total = pred.agg(F.count("*")).scalar()
    g = pred.groupBy("prediction_status").agg(F.count("*").alias("count"))
    return g.select("prediction_status", "count", F.round(F.col("count") * 100.0 / total, 2).alias("percent"))


def daily_accuracy(pred: DataFrame, date: str) -> DataFrame:
    """Fulfilled / total among positive predictions of a day (0 if none)."""
    p = pred.filter(F.col("will_purchase_anything") & (F.col("prediction_date") == _d(date)))
    return p.agg(F.count("*").alias("total"), F.count_if(F.col("prediction_status") == "fulfilled").alias("fulfilled")) \
            .withColumn("accuracy", F.when(F.col("total") > 0, _r(F.col("fulfilled") / F.col("total")))
                        .otherwise(F.lit(0.0)))


def upcoming(pred: DataFrame, as_of: str, k: int = 7) -> DataFrame:
    """Per future day: predictions and positive ones; the first k days."""
    p = pred.filter(F.col("prediction_date") > _d(as_of))
    return (p.groupBy("prediction_date").agg(F.count("*").alias("total"),
                                             F.count_if("will_purchase_anything").alias("purchases"))
            .orderBy("prediction_date").limit(k))


def pair_metrics(pred: DataFrame, act: DataFrame) -> DataFrame:
    """TP, FP, FN, precision, recall, F1 of predicted vs actual pair sets (full outer
    join on the key)."""
    a = pred.select(*PAIR).distinct().withColumn("_p", F.lit(True))
    b = act.select(*PAIR).distinct().withColumn("_a", F.lit(True))
    j = a.join(b, PAIR, "full")
    m = j.agg(F.count_if(F.col("_p") & F.col("_a")).alias("tp"),
              F.count_if(F.col("_p") & F.col("_a").isNull()).alias("fp"),
              F.count_if(F.col("_p").isNull() & F.col("_a")).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    return m.select("tp", "fp", "fn", _r(prec).alias("precision"), _r(rec).alias("recall"),
                    _r(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))).alias("f1"))


def last_events(pred: DataFrame, daily: DataFrame) -> DataFrame:
    """Per pair the last prediction time among active predictions and the last
    purchase day (full outer join of the two maps)."""
    lp = pred.filter(F.col("prediction_status") == "active").groupBy(*PAIR).agg(
        F.max(F.coalesce("updated_at", "created_at")).alias("last_prediction_at"))
    lb = daily.withColumn("product_id", F.col("product_id").cast("string")).groupBy(*PAIR).agg(
        F.max("transaction_date").alias("last_purchase_date"))
    return lp.join(lb, PAIR, "full")


def eligible_for_prediction(hist_pred: DataFrame, daily: DataFrame, pairs: DataFrame, as_of: str,
                            horizon: int = 7) -> DataFrame:
    """Per candidate pair: 'new' (never predicted), 'fulfilled' (a prediction was
    fulfilled), 'expired' (no active prediction within the next ``horizon`` days) → eligible;
    else 'wait'."""
    p = hist_pred.filter("will_purchase_anything")
    agg = p.groupBy(*PAIR).agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("prediction_status") == "fulfilled").alias("_f"),
        F.count_if((F.col("prediction_status") == "active") & (F.col("prediction_date") > _d(as_of))
                   & (F.col("prediction_date") <= F.date_add(_d(as_of), horizon))).alias("_a"))
    j = pairs.select(*PAIR).distinct().join(agg, PAIR, "left")
    reason = (F.when(F.col("_n").isNull(), F.lit("new")).when(F.col("_f") > 0, F.lit("fulfilled"))
              .when(F.col("_a") == 0, F.lit("expired")).otherwise(F.lit("wait")))
    return j.select(*PAIR, reason.alias("reason"), (reason != "wait").alias("eligible"))


def refresh_filter(new_pred: DataFrame, events: DataFrame) -> DataFrame:
    """Write a new prediction only if the pair was never predicted, or bought on or
    after the day of its last prediction."""
    j = new_pred.join(events, PAIR, "left")
    ok = F.col("last_prediction_at").isNull() | (F.col("last_purchase_date") >= F.to_date("last_prediction_at"))
    return j.filter(ok).drop("last_prediction_at", "last_purchase_date")


def convert(pred: DataFrame, min_probability: float = 0.5) -> DataFrame:
    """Keep probability ≥ 0.5; confidence high ≥ .9 / medium ≥ .8 / low; regularity
    high ≥ .8 / medium ≥ .6 / low ≥ .3 / irregular."""
    p = pred.filter(F.col("purchase_probability") >= min_probability)
    p = p.withColumn("confidence_level", bucket_ge("purchase_probability", [0.9, 0.8], ["high", "medium", "low"]))
    if "regularity_score" in p.columns:
        p = p.withColumn("regularity", bucket_ge("regularity_score", [0.8, 0.6, 0.3],
                                                 ["high", "medium", "low", "irregular"]))
    return p


def drop_bought(pending: DataFrame, daily: DataFrame, since: str) -> DataFrame:
    """Pending pairs that were bought since ``since`` are removed (anti join)."""
    b = daily.filter(F.col("transaction_date") >= _d(since)).select(*PAIR).distinct()
    return pending.join(b, PAIR, "left_anti")
