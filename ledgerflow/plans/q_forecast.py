"""Registered forecast queries (A8–A14, M1–M6, F18, SNK2) with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerflow.constants import AS_OF_MONTHLY, SALE, VOL_HIGH, VOL_LOW, VOL_MEDIUM
from ledgerflow.operators import forecast as fc
from ledgerflow.plans.registry import query
from ledgerflow.session import sub_checkpoint
from ledgerflow.sources.ingest import append_partitioned
from ledgerflow.sources.views import Views, osql

PRED = AS_OF_MONTHLY              # predict 2001-08
HIST_START = "2000-02-01"         # 18 months before
RECENT_START = "2001-03-01"       # 5 months before
M3, M2, M1 = "2001-05-01", "2001-06-01", "2001-07-01"
BATCH = "monthly_20010801_020000"
CREATED = "2001-08-01 02:00:00"

FC_CTES = f"""
vs AS (SELECT t.*, pm.subcategory, pm.name_zh FROM order_tx t JOIN product_master pm ON t.product_id = pm.product_id
       WHERE t.document_type = '{SALE}' AND t.quantity > 0 AND pm.is_active = 'active'
         AND t.transaction_date >= DATE '{HIST_START}' AND t.transaction_date < DATE '{PRED}'),
monthly AS (SELECT subcategory, CAST(date_trunc('month', transaction_date) AS DATE) AS month, SUM(quantity) AS quantity
            FROM vs GROUP BY 1, 2),
vol0 AS (SELECT subcategory, COUNT(month) AS month_count, SUM(quantity) AS total_quantity,
                stddev_samp(CAST(quantity AS DOUBLE)) AS std_raw,
                SUM(CASE WHEN month = DATE '{M3}' THEN quantity ELSE 0 END) AS month_minus_3,
                SUM(CASE WHEN month = DATE '{M2}' THEN quantity ELSE 0 END) AS month_minus_2,
                SUM(CASE WHEN month = DATE '{M1}' THEN quantity ELSE 0 END) AS month_minus_1
         FROM monthly GROUP BY 1 HAVING COUNT(month) >= 3),
vol1 AS (SELECT *, CAST(total_quantity AS DOUBLE) / month_count AS avg_quantity, round(std_raw, 6) AS std_quantity
         FROM vol0 WHERE CAST(total_quantity AS DOUBLE) / month_count > 0),
vol2 AS (SELECT *, CASE WHEN avg_quantity > 0 THEN round(std_quantity / avg_quantity, 6) ELSE 999.0 END AS cv FROM vol1),
vol AS (SELECT *, CASE WHEN cv <= 0.4 THEN '{VOL_LOW}' WHEN cv <= 0.8 THEN '{VOL_MEDIUM}' ELSE '{VOL_HIGH}' END
                  AS volatility_group FROM vol2),
grid AS (SELECT v.subcategory, CAST(g.month AS DATE) AS month
         FROM vol v, (SELECT unnest(generate_series(DATE '{HIST_START}', DATE '{M1}', INTERVAL 1 MONTH)) AS month) g),
hist AS (SELECT g.subcategory, g.month, COALESCE(m.quantity, 0) AS y,
                date_diff('month', DATE '{HIST_START}', g.month) AS month_index
         FROM grid g LEFT JOIN monthly m ON g.subcategory = m.subcategory AND g.month = m.month),
clean AS (SELECT *, row_number() OVER (PARTITION BY subcategory ORDER BY month) - 1 AS pos,
                 COUNT(*) OVER (PARTITION BY subcategory) AS n_ FROM hist WHERE y > 0),
st AS (SELECT subcategory, COUNT(*) AS n, CAST(SUM(y) AS DOUBLE) / COUNT(*) AS mean, median(CAST(y AS DOUBLE)) AS median,
              SUM(CASE WHEN pos = 0 THEN power(0.7, n_ - 1) ELSE 0.3 * power(0.7, n_ - 1 - pos) END * CAST(y AS DOUBLE)) AS ewma,
              AVG(CASE WHEN pos >= n_ - 3 THEN CAST(y AS DOUBLE) END) AS recent3,
              regr_slope(CAST(y AS DOUBLE), CAST(month_index AS DOUBLE)) AS slope,
              regr_intercept(CAST(y AS DOUBLE), CAST(month_index AS DOUBLE)) AS intercept
       FROM clean GROUP BY 1),
fcs AS (SELECT v.*, s.n,
          round(CASE WHEN v.month_minus_2 = 0 AND v.month_minus_1 = 0 THEN 0.0
               WHEN s.n IS NULL THEN v.avg_quantity
               WHEN v.volatility_group = '{VOL_LOW}' THEN
                 CASE WHEN s.n >= 6 THEN least(greatest(s.intercept + s.slope * 18.0, s.mean * 0.5), s.mean * 1.5) ELSE s.mean END
               WHEN v.volatility_group = '{VOL_MEDIUM}' THEN
                 CASE WHEN s.n < 3 THEN s.mean
                      WHEN s.n >= 4 THEN greatest(least(s.ewma, s.recent3 * 1.05), least(greatest(s.ewma, s.recent3 * 1.05), s.median))
                      ELSE (s.ewma + s.median) / 2 END
               ELSE CASE WHEN s.n < 2 THEN s.mean * 0.8 WHEN s.n >= 4 THEN s.median ELSE s.mean END END, 4) AS prediction,
          CASE v.volatility_group WHEN '{VOL_LOW}' THEN 'trend' WHEN '{VOL_MEDIUM}' THEN 'ewma' WHEN '{VOL_HIGH}' THEN 'median'
               ELSE 'unknown' END AS prediction_method
        FROM vol v LEFT JOIN st s ON v.subcategory = s.subcategory),
sku AS (SELECT subcategory, product_id, MAX(name_zh) AS product_name, SUM(quantity) AS total_quantity,
               COUNT(DISTINCT date_trunc('month', transaction_date)) AS active_months,
               CAST(SUM(quantity) AS DOUBLE) / COUNT(*) AS avg_quantity,
               SUM(CASE WHEN transaction_date >= DATE '{RECENT_START}' THEN quantity ELSE 0 END) AS recent_quantity,
               SUM(CASE WHEN date_trunc('month', transaction_date) = DATE '{M3}' THEN quantity ELSE 0 END) AS month_minus_3,
               SUM(CASE WHEN date_trunc('month', transaction_date) = DATE '{M2}' THEN quantity ELSE 0 END) AS month_minus_2,
               SUM(CASE WHEN date_trunc('month', transaction_date) = DATE '{M1}' THEN quantity ELSE 0 END) AS month_minus_1
        FROM vs GROUP BY 1, 2 HAVING SUM(quantity) > 0),
tot AS (SELECT subcategory, SUM(recent_quantity) AS sr, SUM(total_quantity) AS st FROM sku GROUP BY 1),
shares AS (SELECT s.*, CASE WHEN t.sr > 0 THEN CAST(s.recent_quantity AS DOUBLE) / CAST(t.sr AS DOUBLE)
                            ELSE CAST(s.total_quantity AS DOUBLE) / CAST(t.st AS DOUBLE) END AS allocation_ratio
           FROM sku s JOIN tot t ON s.subcategory = t.subcategory),
skufc AS (SELECT sh.product_id, sh.product_name, sh.subcategory, sh.month_minus_3, sh.month_minus_2, sh.month_minus_1,
                 round(CASE WHEN sh.month_minus_2 = 0 AND sh.month_minus_1 = 0 THEN 0.0
                            ELSE f.prediction * sh.allocation_ratio END, 4) AS prediction,
                 round(sh.allocation_ratio, 6) AS allocation_ratio, sh.avg_quantity AS historical_avg, f.volatility_group
          FROM shares sh JOIN fcs f ON sh.subcategory = f.subcategory),
vnext AS (SELECT t.*, pm.subcategory FROM order_tx t JOIN product_master pm ON t.product_id = pm.product_id
          WHERE t.document_type = '{SALE}' AND t.quantity > 0 AND pm.is_active = 'active'
            AND t.transaction_date >= DATE '{PRED}' AND t.transaction_date < DATE '{PRED}' + INTERVAL 1 MONTH),
act_sub AS (SELECT subcategory, SUM(quantity) AS actual FROM vnext GROUP BY 1),
errs AS (SELECT f.*, COALESCE(CAST(a.actual AS DOUBLE), 0.0) AS actual FROM fcs f LEFT JOIN act_sub a ON f.subcategory = a.subcategory),
errs2 AS (SELECT *, CASE WHEN actual > 0 THEN round(abs(prediction - actual) / actual, 6) WHEN prediction = 0 THEN 0.0
                        ELSE 999.0 END AS ape FROM errs),
prows AS (SELECT 'subcategory' AS prediction_level, DATE '{PRED}' AS prediction_month, subcategory, NULL::BIGINT AS product_id,
                 NULL::VARCHAR AS product_name, CAST(round(prediction) AS BIGINT) AS prediction_value, cv AS cv_value,
                 NULL::DOUBLE AS allocation_ratio, volatility_group, prediction_method,
                 month_minus_3, month_minus_2, month_minus_1 FROM fcs
          UNION ALL
          SELECT 'sku', DATE '{PRED}', subcategory, product_id, product_name, CAST(round(prediction) AS BIGINT), NULL,
                 allocation_ratio, volatility_group, NULL, month_minus_3, month_minus_2, month_minus_1 FROM skufc),
prows2 AS (SELECT *, '{BATCH}' AS batch_id, TIMESTAMP '{CREATED}' AS created_at FROM prows)"""


def _sub(v):
    return fc.forecast_subcategory(v.order_tx(), v.product_master, PRED)


def _both(v):
    return fc.two_stage_forecast(v.order_tx(), v.product_master, PRED)


def _rows(v):
    sub, sku = _both(v)
    return fc.prediction_rows(sub, sku, BATCH, CREATED)


@query("A8", osql("""
SELECT subcategory, month_count, CAST(total_quantity AS DOUBLE) AS total_quantity, avg_quantity, std_quantity, cv,
       volatility_group, CAST(month_minus_3 AS DOUBLE) AS month_minus_3, CAST(month_minus_2 AS DOUBLE) AS month_minus_2,
       CAST(month_minus_1 AS DOUBLE) AS month_minus_1
FROM vol""", ctes=FC_CTES))
def a8_volatility(spark, sf_dir):
    """A8 + A9: volatility statistics and recent months per subcategory."""
    v = Views(spark, sf_dir)
    m = fc.monthly_quantity(v.order_tx(), v.product_master, PRED)
    return fc.volatility(m, PRED)


@query("M1", osql("SELECT subcategory, CAST(month AS VARCHAR) AS month, CAST(y AS DOUBLE) AS y, month_index FROM hist",
                  ctes=FC_CTES))
def m1_monthly_history(spark, sf_dir):
    """M1: 18 zero-filled months per forecast subcategory."""
    v = Views(spark, sf_dir)
    m = fc.monthly_quantity(v.order_tx(), v.product_master, PRED)
    keys = fc.volatility(m, PRED).select("subcategory")
    return fc.monthly_history(m, keys, PRED)


@query("M5", osql("""
SELECT subcategory, month_count, avg_quantity, std_quantity, cv, CAST(total_quantity AS DOUBLE) AS total_quantity,
       volatility_group, CAST(month_minus_3 AS DOUBLE) AS month_minus_3, CAST(month_minus_2 AS DOUBLE) AS month_minus_2,
       CAST(month_minus_1 AS DOUBLE) AS month_minus_1, prediction, prediction_method,
       '2001-08-01' AS prediction_month
FROM fcs""", ctes=FC_CTES))
def m5_forecast_subcategory(spark, sf_dir):
    """M2–M5: subcategory forecasts for 2001-08 by volatility group."""
    return _sub(Views(spark, sf_dir))


@query("M6", osql("""
SELECT product_id, product_name, subcategory, CAST(month_minus_3 AS DOUBLE) AS month_minus_3,
       CAST(month_minus_2 AS DOUBLE) AS month_minus_2, CAST(month_minus_1 AS DOUBLE) AS month_minus_1, prediction,
       allocation_ratio, historical_avg, volatility_group, '2001-08-01' AS prediction_month
FROM skufc""", ctes=FC_CTES))
def m6_allocate_sku(spark, sf_dir):
    """M6: subcategory forecasts allocated to SKUs (the flagship)."""
    return _both(Views(spark, sf_dir))[1]


@query("A10", osql("""
SELECT subcategory, product_id, product_name, CAST(total_quantity AS DOUBLE) AS total_quantity, active_months,
       avg_quantity, CAST(recent_quantity AS DOUBLE) AS recent_quantity, allocation_ratio
FROM shares""", ctes=FC_CTES))
def a10_sku_stats(spark, sf_dir):
    """A10 + W3: SKU statistics and allocation shares."""
    v = Views(spark, sf_dir)
    return fc.sku_shares(v.order_tx(), v.product_master, PRED).select(
        "subcategory", "product_id", "product_name", "total_quantity", "active_months", "avg_quantity",
        "recent_quantity", "allocation_ratio")


@query("A11", osql("""
SELECT subcategory, product_id, CAST(SUM(quantity) AS DOUBLE) AS actual,
       CASE WHEN product_id IS NOT NULL THEN 'sku' WHEN subcategory IS NOT NULL THEN 'subcategory' ELSE 'total' END AS level
FROM vnext GROUP BY ROLLUP (subcategory, product_id)""", ctes=FC_CTES))
def a11_actuals(spark, sf_dir):
    """Actual quantity of the predicted month per SKU / subcategory / total."""
    v = Views(spark, sf_dir)
    return fc.actuals(v.order_tx(), v.product_master, PRED)


@query("A12", osql("""
SELECT volatility_group, COUNT(*) AS n_rows, count_if(ape < 999) AS valid_rows,
       round(AVG(CASE WHEN ape < 999 THEN ape END), 6) AS mean_ape,
       round(median(CASE WHEN ape < 999 THEN ape END), 6) AS median_ape,
       round(count_if(ape < 999 AND ape < 0.2) / greatest(count_if(ape < 999), 1), 6) AS share_lt_20,
       round(count_if(ape < 999 AND ape < 0.3) / greatest(count_if(ape < 999), 1), 6) AS share_lt_30,
       round(SUM(abs(prediction - actual)), 4) AS total_abs_error, round(SUM(actual), 4) AS total_actual,
       round(SUM(prediction), 4) AS total_prediction
FROM errs2 GROUP BY ROLLUP (volatility_group)""", ctes=FC_CTES))
def a12_forecast_errors(spark, sf_dir):
    """APE report per volatility group and overall."""
    v = Views(spark, sf_dir)
    sub = _sub(v)
    act = fc.actuals(v.order_tx(), v.product_master, PRED).filter(F.col("level") == "subcategory")
    return fc.forecast_errors(fc.with_errors(sub, act.select("subcategory", "actual"), "subcategory"))


_SNK2 = """
SELECT prediction_level, CAST(prediction_month AS VARCHAR) AS prediction_month, subcategory, product_id, product_name,
       prediction_value, cv_value, allocation_ratio, volatility_group, prediction_method,
       CAST(month_minus_3 AS DOUBLE) AS month_minus_3, CAST(month_minus_2 AS DOUBLE) AS month_minus_2,
       CAST(month_minus_1 AS DOUBLE) AS month_minus_1, batch_id, CAST(created_at AS VARCHAR) AS created_at
FROM prows2"""


@query("SNK2", osql(_SNK2, ctes=FC_CTES))
def snk2_prediction_rows(spark, sf_dir):
    """SNK2: batch-stamped rows of both levels, ready to append."""
    return _rows(Views(spark, sf_dir))


@query("SNK2_write", osql(_SNK2, ctes=FC_CTES))
def snk2_append_rows(spark, sf_dir):
    """SNK2: both levels appended, one after the other, to a table by month, and read back."""
    rows = _rows(Views(spark, sf_dir))
    path = sub_checkpoint(spark, f"tables/predictions-{uuid.uuid4().hex[:12]}")
    for level in ("subcategory", "sku"):
        append_partitioned(rows.filter(F.col("prediction_level") == level), path, ["prediction_month"])
    return spark.read.parquet(path).select(*rows.columns)


@query("A13", osql("""
SELECT prediction_level, COUNT(*) AS n_rows, SUM(prediction_value) AS total_prediction,
       round(AVG(prediction_value), 6) AS avg_prediction, MIN(prediction_value) AS min_prediction,
       MAX(prediction_value) AS max_prediction, COUNT(DISTINCT batch_id) AS batches,
       CAST(MIN(created_at) AS VARCHAR) AS first_created, CAST(MAX(created_at) AS VARCHAR) AS last_created
FROM prows2 GROUP BY 1""".replace("SUM(prediction_value) AS total", "CAST(SUM(prediction_value) AS BIGINT) AS total"),
    ctes=FC_CTES))
def a13_prediction_summary(spark, sf_dir):
    """Prediction summary per level."""
    return fc.prediction_summary(_rows(Views(spark, sf_dir)), PRED)


@query("A13_batches", osql("""
SELECT batch_id, CAST(prediction_month AS VARCHAR) AS prediction_month, COUNT(*) AS total_records,
       count_if(prediction_level = 'subcategory') AS subcategory_count, count_if(prediction_level = 'sku') AS sku_count,
       CAST(SUM(prediction_value) AS BIGINT) AS total_predicted_value, CAST(MIN(created_at) AS VARCHAR) AS batch_start_time,
       CAST(MAX(created_at) AS VARCHAR) AS batch_end_time
FROM prows2 GROUP BY batch_id, prediction_month""", ctes=FC_CTES))
def a13_prediction_batches(spark, sf_dir):
    """Figures of every prediction batch."""
    return fc.prediction_batches(_rows(Views(spark, sf_dir)))


@query("A14", osql("""
SELECT CAST(prediction_month AS VARCHAR) AS prediction_month, subcategory, count_if(prediction_level = 'sku') AS sku_rows,
       arg_max(volatility_group, (created_at, prediction_level)) FILTER (WHERE trim(COALESCE(volatility_group, '')) <> '')
         AS volatility_group,
       CASE WHEN count_if(prediction_level = 'sku') > 0
            THEN CAST(SUM(CASE WHEN prediction_level = 'sku' THEN prediction_value END) AS BIGINT)
            ELSE MAX(CASE WHEN prediction_level <> 'sku' THEN prediction_value END) END AS prediction_value
FROM prows2 GROUP BY 1, 2""", ctes=FC_CTES))
def a14_forecast_tree(spark, sf_dir):
    """Per subcategory the SKU total when SKUs exist, else its own forecast."""
    return fc.forecast_tree(_rows(Views(spark, sf_dir)))


@query("F18", osql("""
SELECT subcategory, product_id, prediction_value FROM prows2 WHERE prediction_level = 'sku'""", ctes=FC_CTES))
def f18_forecasts(spark, sf_dir):
    """SKU forecasts of one month, ordered."""
    r = fc.forecasts(_rows(Views(spark, sf_dir)), PRED, "sku")
    return r.select("subcategory", "product_id", "prediction_value")
