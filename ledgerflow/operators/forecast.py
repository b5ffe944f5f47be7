"""Two-stage monthly demand forecast.

Stage 1 forecasts every subcategory at once from an 18-month, zero-filled history; the
method depends on the volatility (CV) of its monthly sales.  Stage 2 allocates each
subcategory forecast to its SKUs by recent (else long-run) sales share.

Everything derives from ONE monthly aggregate of the valid sales (partial aggregation
per executor); the per-subcategory methods are plain aggregates over ≤ 18 rows per key:

* EWMA (α, adjust=False) of the non-zero months y_0..y_{n-1} is the weighted sum
  Σ w_t·y_t with w_0 = (1−α)^{n−1} and w_t = α(1−α)^{n−1−t}.
* The low-volatility trend model (the source fits a trend-only Prophet model: all
  seasonalities are off) is an OLS line over the month index — ``regr_slope`` /
  ``regr_intercept`` — evaluated at the prediction month and clipped to
  [0.5, 1.5] × mean.  This substitution is a decision of this build; its numbers are not
  comparable with the source's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.constants import (APE_SENTINEL, CV_LOW_MAX, CV_MEDIUM_MAX, CV_SENTINEL, EWMA_ALPHA,
                                  HISTORY_MONTHS, RECENT_SHARE_MONTHS, VOL_HIGH, VOL_LOW, VOL_MEDIUM)
from ledgerflow.functions.calendar import month_start
from ledgerflow.functions.misc import method_of
from ledgerflow.operators.sales import valid_sales

R = 6  # decimals kept on derived doubles


def _pm(month: str) -> Column:
    return month_start(F.lit(month).cast("date"))


def monthly_quantity(tx: DataFrame, pm: DataFrame, pred_month: str, months: int = HISTORY_MONTHS,
                     by: str = "subcategory") -> DataFrame:
    """Valid sales (F1) of the ``months`` months before the prediction month, summed per
    (key, month).  The date window reaches the scan as a pushed filter."""
    p = _pm(pred_month)
    vs = valid_sales(tx, pm, F.add_months(p, -months), p)
    return vs.groupBy(by, month_start("transaction_date").alias("month")).agg(F.sum("quantity").alias("quantity"))


def volatility(monthly: DataFrame, pred_month: str) -> DataFrame:
    """A8 + A9: per subcategory: months with sales, mean, sample std, CV (999 when the
    mean ≤ 0), total, the three months before the prediction month, volatility group.
    At least 3 months with sales and a positive mean."""
    p = _pm(pred_month)
    q = F.col("quantity")
    g = monthly.groupBy("subcategory").agg(
        F.count("month").alias("month_count"),
        F.sum(q).alias("total_quantity"),
        F.stddev_samp(q.cast("double")).alias("_std"),
        *[F.sum(F.when(F.col("month") == F.add_months(p, -k), q).otherwise(F.lit(0))).alias(f"month_minus_{k}")
          for k in (3, 2, 1)])
    g = g.filter(F.col("month_count") >= 3)
    avg = F.col("total_quantity").cast("double") / F.col("month_count")
    g = g.withColumn("avg_quantity", avg).filter(F.col("avg_quantity") > 0)
    g = g.withColumn("std_quantity", F.round("_std", R)).drop("_std")
    g = g.withColumn("cv", F.when(F.col("avg_quantity") > 0, F.round(F.col("std_quantity") / F.col("avg_quantity"), R))
                     .otherwise(F.lit(CV_SENTINEL)))
    grp = (F.when(F.col("cv") <= CV_LOW_MAX, F.lit(VOL_LOW)).when(F.col("cv") <= CV_MEDIUM_MAX, F.lit(VOL_MEDIUM))
           .otherwise(F.lit(VOL_HIGH)))
    return g.withColumn("volatility_group", grp)


def monthly_history(monthly: DataFrame, keys: DataFrame, pred_month: str, months: int = HISTORY_MONTHS,
                    by: str = "subcategory") -> DataFrame:
    """M1: every key × each of the ``months`` months before the prediction month, 0 where
    no sales.  The month grid is a per-key ``sequence`` (bounded by ``months``)."""
    p = _pm(pred_month)
    grid = keys.select(by, F.explode(F.sequence(F.add_months(p, -months), F.add_months(p, -1),
                                                F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return (grid.join(monthly, [by, "month"], "left")
            .select(by, "month", F.coalesce("quantity", F.lit(0).cast("decimal(28,4)")).alias("y"))
            .withColumn("month_index", F.months_between("month", F.add_months(p, -months)).cast("int")))


def _med3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def forecast_stats(hist: DataFrame, months: int = HISTORY_MONTHS, alpha: float = EWMA_ALPHA,
                   by: str = "subcategory") -> DataFrame:
    """Per key statistics of the non-zero months used by M2–M4."""
    clean = hist.filter(F.col("y") > 0)
    w = Window.partitionBy(by).orderBy("month")
    clean = (clean.withColumn("pos", F.row_number().over(w) - 1)
             .withColumn("n_", F.count("*").over(Window.partitionBy(by))))
    y = F.col("y").cast("double")
    n, pos = F.col("n_"), F.col("pos")
    wt = F.when(pos == 0, F.pow(F.lit(1 - alpha), n - 1)).otherwise(F.lit(alpha) * F.pow(F.lit(1 - alpha), n - 1 - pos))
    return clean.groupBy(by).agg(
        F.count("*").alias("n"),
        (F.sum("y").cast("double") / F.count("*")).alias("mean"),
        F.median(y).alias("median"),
        F.sum(wt * y).alias("ewma"),
        F.avg(F.when(pos >= n - 3, y)).alias("recent3"),
        F.regr_slope(y, F.col("month_index").cast("double")).alias("slope"),
        F.regr_intercept(y, F.col("month_index").cast("double")).alias("intercept"))


def fc_high(st: DataFrame) -> Column:
    """M2: n<2 → mean·0.8 (0 if none); n≥4 → median; else mean."""
    n = F.col("n")
    return (F.when(n.isNull() | (n == 0), F.lit(0.0)).when(n < 2, F.col("mean") * 0.8)
            .when(n >= 4, F.col("median")).otherwise(F.col("mean")))


def fc_medium(st: DataFrame) -> Column:
    """M3: n<3 → mean (0 if none); else median of {EWMA, mean(last 3)·1.05 if n≥4, median}."""
    n = F.col("n")
    two = (F.col("ewma") + F.col("median")) / 2
    three = _med3(F.col("ewma"), F.col("recent3") * 1.05, F.col("median"))
    return (F.when(n.isNull() | (n == 0), F.lit(0.0)).when(n < 3, F.col("mean"))
            .when(n >= 4, three).otherwise(two))


def fc_low(st: DataFrame, months: int = HISTORY_MONTHS) -> Column:
    """M4: n≥6 → OLS trend at the prediction month clipped to [0.5, 1.5]·mean; else the
    mean of the (at most 5) non-zero months."""
    n = F.col("n")
    trend = F.col("intercept") + F.col("slope") * F.lit(float(months))
    clipped = F.least(F.greatest(trend, F.col("mean") * 0.5), F.col("mean") * 1.5)
    return F.when(n.isNull() | (n == 0), F.lit(0.0)).when(n >= 6, clipped).otherwise(F.col("mean"))


def forecast_subcategory(tx: DataFrame, pm: DataFrame, pred_month: str) -> DataFrame:
    """M5 (with A8, A9, M1–M4): one forecast row per subcategory.

    Months −2 and −1 both 0 → 0; no positive history → the 18-month mean; else by
    volatility group (low → trend, medium → EWMA blend, high → median)."""
    monthly = monthly_quantity(tx, pm, pred_month)
    vol = volatility(monthly, pred_month)
    hist = monthly_history(monthly, vol.select("subcategory"), pred_month)
    st = forecast_stats(hist)
    j = vol.join(st, "subcategory", "left")
    g = F.col("volatility_group")
    by_group = (F.when(g == VOL_LOW, fc_low(j)).when(g == VOL_MEDIUM, fc_medium(j)).otherwise(fc_high(j)))
    pred = (F.when((F.col("month_minus_2") == 0) & (F.col("month_minus_1") == 0), F.lit(0.0))
            .when(F.col("n").isNull(), F.col("avg_quantity"))
            .otherwise(by_group))
    return j.select(
        "subcategory", "month_count", "avg_quantity", "std_quantity", "cv", "total_quantity", "volatility_group",
        "month_minus_3", "month_minus_2", "month_minus_1",
        F.round(pred, 4).alias("prediction"),
        method_of(g).alias("prediction_method"),
        F.lit(pred_month).cast("date").alias("prediction_month"))


def sku_shares(tx: DataFrame, pm: DataFrame, pred_month: str, months: int = HISTORY_MONTHS,
               recent_months: int = RECENT_SHARE_MONTHS) -> DataFrame:
    """Per SKU of each subcategory: name (max), total, active months, mean
    line quantity, recent quantity (last 5 months), months −3..−1 and the allocation ratio
    (share of recent sales, else of 18-month sales).  Subcategory totals come from a
    group-by joined back (no window over a possibly huge subcategory)."""
    p = _pm(pred_month)
    vs = valid_sales(tx, pm, F.add_months(p, -months), p)
    m = month_start("transaction_date")
    q = F.col("quantity")
    sku = vs.groupBy("subcategory", "product_id").agg(
        F.max("name_zh").alias("product_name"),
        F.sum(q).alias("total_quantity"),
        F.count_distinct(m).alias("active_months"),
        (F.sum(q).cast("double") / F.count("*")).alias("avg_quantity"),
        F.sum(F.when(F.col("transaction_date") >= F.add_months(p, -recent_months), q).otherwise(F.lit(0)))
         .alias("recent_quantity"),
        *[F.sum(F.when(m == F.add_months(p, -k), q).otherwise(F.lit(0))).alias(f"month_minus_{k}") for k in (3, 2, 1)])
    sku = sku.filter(F.col("total_quantity") > 0)
    tot = sku.groupBy("subcategory").agg(F.sum("recent_quantity").alias("_sr"), F.sum("total_quantity").alias("_st"))
    j = sku.join(tot, "subcategory")
    ratio = F.when(F.col("_sr") > 0, F.col("recent_quantity").cast("double") / F.col("_sr").cast("double")).otherwise(
        F.col("total_quantity").cast("double") / F.col("_st").cast("double"))
    return j.withColumn("allocation_ratio", ratio).drop("_sr", "_st")


def allocate_sku(sub: DataFrame, shares: DataFrame) -> DataFrame:
    """M6: SKU forecast = subcategory forecast × share; SKU months −2 and −1 both 0 → 0."""
    s = sub.select("subcategory", F.col("prediction").alias("subcategory_prediction"), "volatility_group",
                   "prediction_month")
    j = shares.join(s, "subcategory")
    pred = F.when((F.col("month_minus_2") == 0) & (F.col("month_minus_1") == 0), F.lit(0.0)).otherwise(
        F.col("subcategory_prediction") * F.col("allocation_ratio"))
    return j.select("product_id", "product_name", "subcategory", "month_minus_3", "month_minus_2", "month_minus_1",
                    F.round(pred, 4).alias("prediction"), F.round("allocation_ratio", R).alias("allocation_ratio"),
                    F.col("avg_quantity").alias("historical_avg"), "volatility_group", "prediction_month")


def two_stage_forecast(tx: DataFrame, pm: DataFrame, pred_month: str) -> tuple[DataFrame, DataFrame]:
    """M5 + M6: (subcategory forecasts, SKU forecasts)."""
    sub = forecast_subcategory(tx, pm, pred_month)
    return sub, allocate_sku(sub, sku_shares(tx, pm, pred_month))


def actuals(tx: DataFrame, pm: DataFrame, pred_month: str) -> DataFrame:
    """Actual valid quantity in the prediction month per SKU, per subcategory and in
    total, from one rollup (level = 'sku' / 'subcategory' / 'total')."""
    p = _pm(pred_month)
    vs = valid_sales(tx, pm, p, F.add_months(p, 1))
    r = vs.rollup("subcategory", "product_id").agg(F.sum("quantity").alias("actual"))
    lvl = (F.when(F.col("product_id").isNotNull(), F.lit("sku"))
           .when(F.col("subcategory").isNotNull(), F.lit("subcategory")).otherwise(F.lit("total")))
    return r.withColumn("level", lvl)


def ape(pred: Column, actual: Column) -> Column:
    """|pred − actual| / actual; 0 when both are 0; 999 when actual is 0 and pred > 0."""
    a = actual.cast("double")
    return (F.when(a > 0, F.round(F.abs(pred - a) / a, R)).when(pred == 0, F.lit(0.0))
            .otherwise(F.lit(APE_SENTINEL)))


def with_errors(fc: DataFrame, act: DataFrame, key: str) -> DataFrame:
    """Forecast rows with actual (0 if none) and APE."""
    a = act.select(key, F.col("actual"))
    j = fc.join(a, key, "left").withColumn("actual", F.coalesce(F.col("actual").cast("double"), F.lit(0.0)))
    return j.withColumn("ape", ape(F.col("prediction"), F.col("actual")))


def forecast_errors(errs: DataFrame) -> DataFrame:
    """A12 report: per volatility group and overall (rollup): rows, valid rows (APE not
    the sentinel), mean / median APE over valid rows, share below 0.2 and 0.3, total
    absolute error, totals of actual and forecast.  The medians come from grouped exact
    quantiles, so that the total needs no buffer of all rows."""
    from ledgerflow.operators.recommend import exact_quantiles

    valid = F.col("ape") < APE_SENTINEL
    va = F.when(valid, F.col("ape"))
    n_valid = F.count_if(valid)
    report = errs.rollup("volatility_group").agg(
        F.grouping("volatility_group").alias("_all"),
        F.count("*").alias("n_rows"),
        n_valid.alias("valid_rows"),
        F.round(F.avg(va), R).alias("mean_ape"),
        F.round(F.count_if(valid & (F.col("ape") < 0.2)) / F.greatest(n_valid, F.lit(1)), R).alias("share_lt_20"),
        F.round(F.count_if(valid & (F.col("ape") < 0.3)) / F.greatest(n_valid, F.lit(1)), R).alias("share_lt_30"),
        F.round(F.sum(F.abs(F.col("prediction") - F.col("actual"))), 4).alias("total_abs_error"),
        F.round(F.sum("actual"), 4).alias("total_actual"),
        F.round(F.sum("prediction"), 4).alias("total_prediction"))
    group = F.concat(F.lit("="), F.coalesce(F.col("volatility_group"), F.lit("")))
    levels = errs.filter(valid).select("ape", F.explode(F.array(F.lit("all"), group)).alias("_level"))
    medians = exact_quantiles(levels, "ape", [0.5], ["_level"]).select("_level", F.round("q0", R).alias("median_ape"))
    report = report.withColumn("_level", F.when(F.col("_all") == 1, F.lit("all")).otherwise(group))
    return report.join(medians, "_level", "left").drop("_level", "_all")


def prediction_rows(sub: DataFrame, sku: DataFrame, batch_id: str, created_at: str) -> DataFrame:
    """SNK2 rows: both levels in one long table with level tag, batch id and time;
    prediction values rounded to whole units."""
    s = sub.select(F.lit("subcategory").alias("prediction_level"), "prediction_month", "subcategory",
                   F.round("prediction").cast("long").alias("prediction_value"), F.col("cv").alias("cv_value"),
                   "volatility_group", "prediction_method", "month_minus_3", "month_minus_2", "month_minus_1")
    k = sku.select(F.lit("sku").alias("prediction_level"), "prediction_month", "subcategory", "product_id",
                   "product_name", F.round("prediction").cast("long").alias("prediction_value"),
                   "allocation_ratio", "volatility_group", "month_minus_3", "month_minus_2", "month_minus_1")
    out = s.unionByName(k, allowMissingColumns=True)
    return out.withColumn("batch_id", F.lit(batch_id)).withColumn("created_at", F.lit(created_at).cast("timestamp"))


def prediction_batches(rows: DataFrame) -> DataFrame:
    """Per batch and prediction month: rows in all and per level, predicted total,
    first and last time."""
    return rows.groupBy("batch_id", "prediction_month").agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("prediction_level") == "subcategory").alias("subcategory_count"),
        F.count_if(F.col("prediction_level") == "sku").alias("sku_count"),
        F.sum("prediction_value").alias("total_predicted_value"),
        F.min("created_at").alias("batch_start_time"), F.max("created_at").alias("batch_end_time"))


def prediction_summary(rows: DataFrame, month: str | None = None) -> DataFrame:
    """Count, sum, avg, min, max of prediction values per level (optionally one
    month), with batch count and first / last batch time."""
    r = rows if month is None else rows.filter(F.col("prediction_month") == F.lit(month).cast("date"))
    return r.groupBy("prediction_level").agg(
        F.count("*").alias("n_rows"), F.sum("prediction_value").alias("total_prediction"),
        F.round(F.avg("prediction_value"), R).alias("avg_prediction"),
        F.min("prediction_value").alias("min_prediction"), F.max("prediction_value").alias("max_prediction"),
        F.count_distinct("batch_id").alias("batches"), F.min("created_at").alias("first_created"),
        F.max("created_at").alias("last_created"))


def forecast_tree(rows: DataFrame) -> DataFrame:
    """Per subcategory: the sum of its SKU forecasts if it has SKU rows, else its
    own subcategory forecast; the volatility label of the latest row that has one."""
    is_sku = F.col("prediction_level") == "sku"
    label = F.when(F.trim(F.coalesce("volatility_group", F.lit(""))) != "", F.col("volatility_group"))
    g = rows.groupBy("prediction_month", "subcategory").agg(
        F.count_if(is_sku).alias("sku_rows"),
        F.sum(F.when(is_sku, F.col("prediction_value"))).alias("_sku_total"),
        F.max(F.when(~is_sku, F.col("prediction_value"))).alias("_sub_value"),
        F.max_by(label, F.when(label.isNotNull(), F.struct("created_at", "prediction_level"))).alias("volatility_group"))
    val = F.when(F.col("sku_rows") > 0, F.col("_sku_total")).otherwise(F.col("_sub_value"))
    return g.withColumn("prediction_value", val).drop("_sku_total", "_sub_value")


def forecasts(rows: DataFrame, month: str | None = None, level: str | None = None) -> DataFrame:
    """forecast rows of one month (all months if none), optional level, ordered by
    subcategory and product."""
    r = rows
    if month:
        r = r.filter(F.col("prediction_month") == F.lit(month).cast("date"))
    if level:
        r = r.filter(F.col("prediction_level") == level)
    return r.orderBy("subcategory", F.col("product_id").asc_nulls_first())
