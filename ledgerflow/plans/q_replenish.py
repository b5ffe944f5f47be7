"""Registered replenishment queries."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from ledgerflow.constants import (SALE, SEGMENT_ACTIVE, SEGMENT_IMPORTANT, SEGMENT_NEW, SEGMENT_PLANNED,
                                  SEGMENT_VIP)
from ledgerflow.operators import boosting as bo
from ledgerflow.operators import replenish as rp
from ledgerflow.plans.registry import query
from ledgerflow.session import cut, sub_checkpoint
from ledgerflow.sources.views import Views, osql

END = "2024-01-30"
WIN_START = "2023-11-01"              # END − 90 days
CUT = "2024-01-24"                    # label window start (END − 6)
TARGETS = [d for d in ("2024-01-24", "2024-01-25", "2024-01-26", "2024-01-27", "2024-01-29", "2024-01-30")]
PRED_AS_OF = "2024-01-20"
PRED_CREATED = "2024-01-20 06:00:00"
LONG_TARGETS = ["2001-04-01", "2001-07-01"]


def _daily(v):
    return rp.daily_purchases(v.replen_tx, WIN_START, END)


def _pairs(v):
    return rp.qualified_pairs(_daily(v), END)


# ------------------------------------------------------------------ SQL building blocks
_STATS = f"""
cstats AS (SELECT customer_id, COUNT(*) AS total_orders, COUNT(DISTINCT transaction_date) AS unique_days,
                  CAST(round(SUM(amount), 2) AS DOUBLE) AS total_amount,
                  CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS avg_amount, SUM(quantity) AS total_quantity,
                  date_diff('day', MIN(transaction_date), MAX(transaction_date)) AS span_days
           FROM {{src}} GROUP BY 1),
cstats2 AS (SELECT *, CASE WHEN span_days > 0 THEN round(CAST(unique_days AS DOUBLE) / (CAST(span_days AS DOUBLE) / 7.0), 6)
                          ELSE 0.0 END AS weekly_frequency FROM cstats),
cseg AS (SELECT *, CASE WHEN total_amount >= 5000 AND weekly_frequency >= 1.5 THEN '{SEGMENT_VIP}'
                        WHEN total_amount >= 2000 AND weekly_frequency >= 0.8 THEN '{SEGMENT_IMPORTANT}'
                        WHEN weekly_frequency >= 0.5 THEN '{SEGMENT_ACTIVE}'
                        WHEN total_orders >= 3 THEN '{SEGMENT_PLANNED}' ELSE '{SEGMENT_NEW}' END AS segment FROM cstats2),
celig AS (SELECT *, (CASE WHEN unique_days >= 3 THEN 2 ELSE 0 END) + (CASE WHEN span_days >= 14 THEN 2 ELSE 0 END)
                    + (CASE WHEN total_orders >= 8 THEN 1 ELSE 0 END) AS model_score FROM cseg)"""


def _stats_sql(src):
    return _STATS.format(src=src)


_CSTAT_OUT = """customer_id, total_orders, unique_days, total_amount, avg_amount, CAST(total_quantity AS DOUBLE) AS total_quantity,
       span_days, weekly_frequency"""


@query("A15", osql(f"SELECT {_CSTAT_OUT} FROM cstats2", ctes=_stats_sql("replen_tx")))
def a15_customer_stats(spark, sf_dir):
    """Customer purchase statistics over the event purchases."""
    return rp.customer_stats(Views(spark, sf_dir).replen_tx)


@query("A16", osql("""
SELECT customer_id, CAST(transaction_date AS VARCHAR) AS transaction_date, CAST(SUM(amount) AS DOUBLE) AS amount,
       CAST(SUM(quantity) AS DOUBLE) AS quantity, COUNT(*) AS order_count FROM replen_tx GROUP BY 1, 2"""))
def a16_daily_orders(spark, sf_dir):
    """Daily order aggregation per customer."""
    return rp.daily_orders(Views(spark, sf_dir).replen_tx)


@query("M7", osql(f"SELECT {_CSTAT_OUT}, segment FROM cseg", ctes=_stats_sql("replen_tx")))
def m7_segments(spark, sf_dir):
    """M7: customer segments."""
    return rp.segment_customers(rp.customer_stats(Views(spark, sf_dir).replen_tx))


@query("M7_long", osql(f"SELECT {_CSTAT_OUT}, segment FROM cseg", ctes=_stats_sql(
    f"(SELECT * FROM order_tx WHERE document_type = '{SALE}')")))
def m7_segments_long(spark, sf_dir):
    """M7 on the order history (amount thresholds matter there)."""
    t = Views(spark, sf_dir).order_tx().filter(F.col("document_type") == SALE)
    return rp.segment_customers(rp.customer_stats(t))


@query("M8", osql(f"SELECT {_CSTAT_OUT}, model_score FROM celig WHERE total_orders >= 5 AND model_score >= 2",
                  ctes=_stats_sql(f"(SELECT * FROM order_tx WHERE document_type = '{SALE}')")))
def m8_eligible(spark, sf_dir):
    """M8: customers suited to per-customer modelling."""
    t = Views(spark, sf_dir).order_tx().filter(F.col("document_type") == SALE)
    return rp.eligible_customers(rp.customer_stats(t))


@query("M9", osql("""
SELECT g.customer_id, CAST(g.d AS VARCHAR) AS transaction_date, CAST(COALESCE(o.amount, 0) AS DOUBLE) AS amount,
       CAST(COALESCE(o.quantity, 0) AS DOUBLE) AS quantity, COALESCE(o.order_count, 0) AS order_count
FROM (SELECT customer_id, CAST(unnest(generate_series(MIN(transaction_date), MAX(transaction_date), INTERVAL 1 DAY)) AS DATE) AS d
      FROM replen_tx GROUP BY 1) g
LEFT JOIN (SELECT customer_id, transaction_date, SUM(amount) AS amount, SUM(quantity) AS quantity, COUNT(*) AS order_count
           FROM replen_tx GROUP BY 1, 2) o ON g.customer_id = o.customer_id AND g.d = o.transaction_date"""))
def m9_daily_series(spark, sf_dir):
    """M9: gap-filled daily series per customer."""
    return rp.daily_series(Views(spark, sf_dir).replen_tx)


def _m10_sql(as_of, days=7):
    return _stats_sql(f"(SELECT * FROM replen_tx WHERE transaction_date <= DATE '{as_of}')") + f""",
elig AS (SELECT customer_id, segment FROM celig WHERE total_orders >= 5 AND model_score >= 2),
hist AS (SELECT * FROM replen_tx WHERE transaction_date <= DATE '{as_of}' AND customer_id IN (SELECT customer_id FROM elig)),
dord AS (SELECT customer_id, transaction_date, COUNT(*) AS order_count FROM hist GROUP BY 1, 2),
span AS (SELECT customer_id, MIN(transaction_date) AS a, MAX(transaction_date) AS b FROM dord GROUP BY 1),
wdays AS (SELECT s.customer_id, w.wd AS weekday,
                 (date_diff('day', s.a, s.b) + 1) // 7
                 + CASE WHEN (((w.wd - (isodow(s.a) - 1)) % 7) + 7) % 7 < (date_diff('day', s.a, s.b) + 1) % 7 THEN 1 ELSE 0 END AS n
          FROM span s, (SELECT unnest(range(7)) AS wd) w),
per AS (SELECT customer_id, isodow(transaction_date) - 1 AS weekday, SUM(order_count) AS orders FROM dord GROUP BY 1, 2),
rate AS (SELECT w.customer_id, w.weekday, CASE WHEN w.n > 0 THEN COALESCE(p.orders, 0) / w.n ELSE 0.0 END AS expected_orders
         FROM wdays w LEFT JOIN per p ON w.customer_id = p.customer_id AND w.weekday = p.weekday),
tgt AS (SELECT e.customer_id, e.segment, CAST(d.d AS DATE) AS prediction_date
        FROM elig e, (SELECT unnest(generate_series(DATE '{as_of}' + 1, DATE '{as_of}' + {days}, INTERVAL 1 DAY)) AS d) d),
tx AS (SELECT t.customer_id, t.segment, t.prediction_date, greatest(COALESCE(r.expected_orders, 0.0), 0.0) AS x,
              CASE WHEN t.segment IN ('{SEGMENT_VIP}', '{SEGMENT_IMPORTANT}') THEN CAST(0.15 AS DOUBLE)
                   WHEN t.segment = '{SEGMENT_NEW}' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS thr
       FROM tgt t LEFT JOIN rate r ON t.customer_id = r.customer_id AND isodow(t.prediction_date) - 1 = r.weekday),
tops AS (SELECT customer_id, product_id FROM (
           SELECT customer_id, product_id, row_number() OVER (PARTITION BY customer_id ORDER BY COUNT(*) DESC, product_id) AS r
           FROM replen_tx WHERE transaction_date <= DATE '{as_of}' AND transaction_date >= DATE '{as_of}' - 180 GROUP BY 1, 2)
         WHERE r <= 3),
tw AS (SELECT tx.*, (tx.x >= tx.thr AND tx.customer_id IN (SELECT customer_id FROM tops)) AS will FROM tx),
preds AS (
  SELECT tw.customer_id, CAST(tp.product_id AS VARCHAR) AS product_id, tw.prediction_date, TRUE AS will_purchase_anything,
         round(least(1.0, tw.x / tw.thr), 6) AS purchase_probability,
         CAST(greatest(1, floor(tw.x)) AS BIGINT) AS estimated_quantity,
         CASE WHEN tw.x > tw.thr * 1.5 THEN 'high' ELSE 'medium' END AS confidence_level, tw.segment AS original_segment
  FROM tw JOIN tops tp ON tw.customer_id = tp.customer_id WHERE tw.will
  UNION ALL
  SELECT customer_id, '', prediction_date, FALSE, 0.0, CAST(0 AS BIGINT), 'low', segment FROM tw WHERE NOT will)"""


_PRED_OUT = """customer_id, product_id, CAST(prediction_date AS VARCHAR) AS prediction_date, will_purchase_anything,
       purchase_probability, estimated_quantity, confidence_level, original_segment"""


@query("M10", osql(f"SELECT {_PRED_OUT} FROM preds", ctes=_m10_sql(PRED_AS_OF)))
def m10_predict_orders(spark, sf_dir):
    """Order-rate predictions for the 7 days after 2024-01-20."""
    return rp.predict_orders(Views(spark, sf_dir).replen_tx, PRED_AS_OF)


_WIN = f"""
win AS (SELECT customer_id, product_id, transaction_date, SUM(quantity) AS quantity, SUM(amount) AS amount FROM replen_tx
        WHERE document_type = '{SALE}' AND transaction_date >= DATE '{WIN_START}' AND transaction_date <= DATE '{END}'
        GROUP BY 1, 2, 3),
qcust AS (SELECT customer_id FROM win GROUP BY 1
          HAVING COUNT(*) >= 3 AND date_diff('day', MAX(transaction_date), DATE '{END}') <= 30),
qpairs AS (SELECT customer_id, product_id, COUNT(*) AS cp_purchases FROM win
           WHERE customer_id IN (SELECT customer_id FROM qcust) GROUP BY 1, 2 HAVING COUNT(*) >= 2)"""


@query("M11", osql("SELECT customer_id, product_id, cp_purchases FROM qpairs", ctes=_WIN))
def m11_qualified_pairs(spark, sf_dir):
    """Qualified customer-product pairs of the 90-day window ending 2024-01-30."""
    return _pairs(Views(spark, sf_dir))


def _m12_sql(cut, targets):
    tl = ", ".join(f"(DATE '{t}')" for t in targets)
    cs = ",\n".join(f"SUM(CASE WHEN isodow(transaction_date) - 1 = {k} THEN 1 ELSE 0 END) AS c{k}" for k in range(7))
    cmax = "greatest(" + ", ".join(f"c{k}" for k in range(7)) + ")"
    pref = "CASE " + " ".join(f"WHEN c{k} = {cmax} THEN {k}" for k in range(7)) + " END"
    ent = " + ".join(f"(CASE WHEN c{k} > 0 THEN -(c{k} / n) * log2(c{k} / n) ELSE 0.0 END)" for k in range(7))
    nwd = " + ".join(f"(CASE WHEN c{k} > 0 THEN 1 ELSE 0 END)" for k in range(7))
    return _WIN + f""",
tg AS (SELECT * FROM (VALUES {tl}) t(target_date)),
h AS (SELECT w.*, date_diff('day', lag(transaction_date) OVER (PARTITION BY customer_id, product_id ORDER BY transaction_date),
                            transaction_date) AS g,
             row_number() OVER (PARTITION BY customer_id, product_id ORDER BY transaction_date) AS rn,
             COUNT(*) OVER (PARTITION BY customer_id, product_id) AS n_
      FROM win w WHERE transaction_date < DATE '{cut}'
        AND EXISTS (SELECT 1 FROM qpairs q WHERE q.customer_id = w.customer_id AND q.product_id = w.product_id)),
st AS (SELECT customer_id, product_id, COUNT(*) AS n, MIN(transaction_date) AS first_date, MAX(transaction_date) AS last_date,
              SUM(quantity) AS sum_q, MAX(CASE WHEN rn = 1 THEN quantity END) AS q_first,
              MAX(CASE WHEN rn = n_ THEN quantity END) AS q_last, stddev_samp(CAST(g AS DOUBLE)) AS std_g,
              AVG(CASE WHEN rn >= n_ - 2 THEN CAST(g AS DOUBLE) END) AS recent3_g,
              AVG(CASE WHEN rn >= 2 AND rn <= 1 + greatest(1, n_ - 4) THEN CAST(g AS DOUBLE) END) AS early_g,
              MAX(CASE WHEN rn = n_ THEN g END) AS g_last, MAX(CASE WHEN rn = n_ - 1 THEN g END) AS g_prev,
              {cs}
       FROM h GROUP BY 1, 2),
rc AS (SELECT h.customer_id, h.product_id, tg.target_date,
              SUM(CASE WHEN h.transaction_date >= tg.target_date - 7 THEN 1 ELSE 0 END) AS r7,
              SUM(CASE WHEN h.transaction_date >= tg.target_date - 14 THEN 1 ELSE 0 END) AS r14,
              SUM(CASE WHEN h.transaction_date >= tg.target_date - 30 THEN 1 ELSE 0 END) AS r30
       FROM h, tg GROUP BY 1, 2, 3),
b AS (SELECT q.customer_id, q.product_id, tg.target_date, COALESCE(st.n, 0) AS nn, st.*,
             rc.r7, rc.r14, rc.r30, isodow(tg.target_date) - 1 AS twd,
             date_diff('day', st.last_date, tg.target_date) AS dsl
      FROM qpairs q CROSS JOIN tg
      LEFT JOIN st ON q.customer_id = st.customer_id AND q.product_id = st.product_id
      LEFT JOIN rc ON q.customer_id = rc.customer_id AND q.product_id = rc.product_id AND tg.target_date = rc.target_date),
b2 AS (SELECT *, CASE WHEN nn >= 2 THEN date_diff('day', first_date, last_date) / (nn - 1) ELSE 0.0 END AS avg_i,
              CASE WHEN nn >= 3 THEN std_g ELSE 0.0 END AS std_i, {pref} AS pref, {cmax} AS cmax,
              CASE WHEN ({nwd}) > 1 THEN ({ent}) / log2(7) ELSE 0.0 END AS ent,
              abs(CAST(g_last AS DOUBLE) - CAST(g_prev AS DOUBLE)) / sqrt(2.0) AS std2 FROM b),
b3 AS (SELECT *, CASE WHEN avg_i > 0 THEN std_i / avg_i ELSE 0.0 END AS cv_i, abs(floor(dsl - avg_i)) AS dev FROM b2),
feat AS (
  SELECT customer_id, product_id, target_date, dayname(target_date) AS weekday_name,
    CAST(twd AS BIGINT) AS day_of_week, CAST(dayofmonth(target_date) AS BIGINT) AS day_of_month,
    CAST(CASE WHEN twd >= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
    CAST(CASE WHEN nn > 0 THEN pref ELSE twd END AS BIGINT) AS preferred_weekday,
    CAST(CASE WHEN nn > 0 AND pref = twd THEN 1 ELSE 0 END AS BIGINT) AS is_preferred_weekday,
    round(CASE WHEN nn > 0 THEN cmax / nn ELSE 0.0 END, 6) AS preferred_weekday_strength,
    round(CASE WHEN nn > 0 THEN ent ELSE 0.0 END, 6) AS weekday_entropy,
    CAST(CASE WHEN nn > 0 THEN dsl ELSE 999 END AS BIGINT) AS days_since_last,
    round(CASE WHEN nn > 0 THEN exp(-dsl / CAST(30.0 AS DOUBLE)) ELSE 0.0 END, 6) AS time_decay_factor,
    round(CASE WHEN nn > 0 THEN exp(-(dsl * dsl) / CAST(900.0 AS DOUBLE)) ELSE 0.0 END, 6) AS time_decay_squared,
    round(CASE WHEN nn > 0 THEN exp(-ln(1 + dsl) / CAST(3.0 AS DOUBLE)) ELSE 0.0 END, 6) AS time_decay_log,
    round(avg_i, 6) AS avg_interval, round(std_i, 6) AS interval_std, round(cv_i, 6) AS interval_cv,
    round(CASE WHEN nn >= 2 THEN CASE WHEN cv_i > 0 THEN 1 / (1 + cv_i) ELSE 1.0 END ELSE 0.0 END, 6) AS regularity_score,
    CAST(CASE WHEN nn >= 2 THEN dev ELSE 999 END AS BIGINT) AS expected_purchase_deviation,
    CAST(CASE WHEN nn >= 2 AND dev <= 1 THEN 1 ELSE 0 END AS BIGINT) AS is_expected_date,
    round(CASE WHEN nn >= 4 AND early_g > 0 THEN (early_g - recent3_g) / early_g ELSE 0.0 END, 6) AS purchase_acceleration,
    round(CASE WHEN nn >= 2 THEN CASE WHEN std_i > 0 THEN 1 / (1 + std_i) ELSE 1.0 END ELSE 0.0 END, 6) AS interval_stability,
    round(CASE WHEN nn >= 3 THEN CAST(g_last AS DOUBLE) - CAST(g_prev AS DOUBLE) ELSE 0.0 END, 6) AS recent_interval_trend,
    round(CASE WHEN nn >= 3 THEN (CAST(g_prev AS DOUBLE) + CAST(g_last AS DOUBLE)) / 2 ELSE 0.0 END, 6) AS recent_avg_interval,
    round(CASE WHEN nn >= 3 THEN CASE WHEN std2 > 0 THEN 1 / (1 + std2) ELSE 1.0 END ELSE 0.0 END, 6)
      AS recent_interval_stability,
    round(CASE WHEN nn >= 3 AND avg_i > 0 THEN ((CAST(g_prev AS DOUBLE) + CAST(g_last AS DOUBLE)) / 2) / avg_i ELSE 1.0 END, 6)
      AS recent_vs_overall_ratio,
    CAST(nn AS BIGINT) AS cp_total_purchases, round(COALESCE(CAST(sum_q AS DOUBLE), 0.0), 6) AS cp_total_quantity,
    round(CASE WHEN nn > 0 THEN CAST(sum_q AS DOUBLE) / nn ELSE 0.0 END, 6) AS cp_avg_quantity,
    round(CASE WHEN nn > 1 THEN CAST(q_last - q_first AS DOUBLE) / (nn - 1) ELSE 0.0 END, 6) AS cp_quantity_trend,
    CAST(COALESCE(r7, 0) AS BIGINT) AS cp_recent_7d, CAST(COALESCE(r14, 0) AS BIGINT) AS cp_recent_14d,
    CAST(COALESCE(r30, 0) AS BIGINT) AS cp_recent_30d,
    round(CASE WHEN nn > 1 THEN nn / greatest(date_diff('day', first_date, last_date), 1) ELSE 0.0 END, 6) AS purchase_density
  FROM b3)"""


_FEAT_COLS = ", ".join(rp.FEATURES_M12)


@query("M12", osql(f"SELECT customer_id, product_id, CAST(target_date AS VARCHAR) AS target_date, weekday_name, {_FEAT_COLS} "
                   "FROM feat", ctes=_m12_sql(CUT, TARGETS)))
def m12_cycle_features(spark, sf_dir):
    """28 purchase-cycle features of qualified pairs × the label days, history before
    the label window."""
    v = Views(spark, sf_dir)
    return rp.cycle_features(_daily(v), _pairs(v), CUT, TARGETS)


M14_DATES = [(_dt.date(2000, 7, 1) + _dt.timedelta(days=15 * i)).isoformat() for i in range(25)]


def _thin_sql(keys, ratio, cols):
    """Condition that keeps the positives and the thinned negatives of ``keys``."""
    text = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    unit = f"CAST('0x' || substr(md5(concat_ws('|', '42', {text})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
    rate = f"(SELECT least(1.0::DOUBLE, {ratio}::DOUBLE * count_if(label = 1) / greatest(count_if(label = 0), 1)) FROM {keys})"
    return f"(label = 1 OR {unit} < {rate})"


_M15 = f"""
SELECT f.customer_id, f.product_id, CAST(f.target_date AS VARCHAR) AS target_date, f.weekday_name, {", ".join("f." + c for c in rp.FEATURES_M12)},
       CASE WHEN w.customer_id IS NULL THEN 0 ELSE 1 END AS label
FROM feat f LEFT JOIN (SELECT DISTINCT customer_id, product_id, transaction_date FROM win) w
  ON f.customer_id = w.customer_id AND f.product_id = w.product_id AND f.target_date = w.transaction_date"""


@query("M15", osql(_M15, ctes=_m12_sql(CUT, TARGETS)))
def m15_rolling_samples(spark, sf_dir):
    """Labelled rolling samples (all negatives; the 3:1 thinning is M15_sampled)."""
    v = Views(spark, sf_dir)
    return rp.rolling_samples(v.replen_tx.transform(lambda t: rp.daily_purchases(t)), END)


@query("M15_sampled", osql("SELECT * FROM m15 WHERE " + _thin_sql("m15", 3.0, ["customer_id", "product_id", "target_date"]),
                           ctes=_m12_sql(CUT, TARGETS) + f",\nm15 AS ({_M15})"))
def m15_sampled(spark, sf_dir):
    """Positives plus about 3 hash-sampled negatives per positive."""
    v = Views(spark, sf_dir)
    return rp.rolling_samples(rp.daily_purchases(v.replen_tx), END, ratio=3.0)


_LONG = f"""
ld AS (SELECT customer_id, product_id, transaction_date, SUM(quantity) AS quantity, SUM(amount) AS amount
       FROM replen_tx_long WHERE document_type = '{SALE}' GROUP BY 1, 2, 3)"""


def _m13_sql(targets):
    tl = ", ".join(f"(DATE '{t}')" for t in targets)
    return _LONG + f""",
tg AS (SELECT * FROM (VALUES {tl}) t(target_date)),
rows AS (SELECT l.*, tg.target_date FROM ld l, tg
         WHERE l.transaction_date >= tg.target_date - 90 AND l.transaction_date < tg.target_date),
pairs AS (SELECT DISTINCT customer_id, product_id FROM ld),
cu AS (SELECT target_date, customer_id, COUNT(DISTINCT transaction_date) AS customer_purchase_days_90d,
              CAST(SUM(amount) AS DOUBLE) AS customer_total_amount_90d,
              round(CAST(SUM(amount) AS DOUBLE) / COUNT(*), 6) AS customer_avg_amount_90d,
              CAST(SUM(quantity) AS DOUBLE) AS customer_total_quantity_90d,
              COUNT(DISTINCT product_id) AS customer_unique_products_90d, MAX(transaction_date) AS cl
       FROM rows GROUP BY 1, 2),
pr AS (SELECT target_date, product_id, COUNT(DISTINCT transaction_date) AS product_sale_days_90d,
              CAST(SUM(quantity) AS DOUBLE) AS product_total_quantity_90d,
              COUNT(DISTINCT customer_id) AS product_unique_customers_90d,
              round(CAST(SUM(quantity) AS DOUBLE) / COUNT(*), 6) AS product_avg_quantity_per_sale_90d
       FROM rows GROUP BY 1, 2),
cp AS (SELECT target_date, customer_id, product_id, COUNT(*) AS cp_purchase_count_90d,
              CAST(SUM(quantity) AS DOUBLE) AS cp_total_quantity_90d,
              round(CAST(SUM(quantity) AS DOUBLE) / COUNT(*), 6) AS cp_avg_quantity_90d,
              CAST(SUM(amount) AS DOUBLE) AS cp_total_amount_90d, MAX(transaction_date) AS pl
       FROM rows GROUP BY 1, 2, 3),
m13 AS (
  SELECT p.customer_id, p.product_id, CAST(tg.target_date AS VARCHAR) AS target_date,
         isodow(tg.target_date) - 1 AS prediction_day_of_week, dayofmonth(tg.target_date) AS prediction_day_of_month,
         month(tg.target_date) AS prediction_month, quarter(tg.target_date) AS prediction_quarter,
         COALESCE(cu.customer_purchase_days_90d, 0) AS customer_purchase_days_90d,
         COALESCE(cu.customer_total_amount_90d, 0.0) AS customer_total_amount_90d,
         COALESCE(cu.customer_avg_amount_90d, 0.0) AS customer_avg_amount_90d,
         COALESCE(cu.customer_total_quantity_90d, 0.0) AS customer_total_quantity_90d,
         COALESCE(cu.customer_unique_products_90d, 0) AS customer_unique_products_90d,
         COALESCE(least(date_diff('day', cu.cl, tg.target_date), 999), 999) AS days_since_customer_last_purchase,
         COALESCE(pr.product_sale_days_90d, 0) AS product_sale_days_90d,
         COALESCE(pr.product_total_quantity_90d, 0.0) AS product_total_quantity_90d,
         COALESCE(pr.product_unique_customers_90d, 0) AS product_unique_customers_90d,
         COALESCE(pr.product_avg_quantity_per_sale_90d, 0.0) AS product_avg_quantity_per_sale_90d,
         COALESCE(cp.cp_purchase_count_90d, 0) AS cp_purchase_count_90d,
         COALESCE(cp.cp_total_quantity_90d, 0.0) AS cp_total_quantity_90d,
         COALESCE(cp.cp_avg_quantity_90d, 0.0) AS cp_avg_quantity_90d,
         COALESCE(cp.cp_total_amount_90d, 0.0) AS cp_total_amount_90d,
         COALESCE(least(date_diff('day', cp.pl, tg.target_date), 999), 999) AS days_since_cp_last_purchase
  FROM pairs p CROSS JOIN tg
  LEFT JOIN cu ON cu.target_date = tg.target_date AND cu.customer_id = p.customer_id
  LEFT JOIN pr ON pr.target_date = tg.target_date AND pr.product_id = p.product_id
  LEFT JOIN cp ON cp.target_date = tg.target_date AND cp.customer_id = p.customer_id AND cp.product_id = p.product_id)"""


@query("M13", osql("SELECT * FROM m13", ctes=_m13_sql(LONG_TARGETS)))
def m13_activity_features(spark, sf_dir):
    """90-day activity features of every pair at two target days (category grain)."""
    v = Views(spark, sf_dir)
    daily = rp.daily_purchases(v.replen_tx_long())
    pairs = daily.select("customer_id", "product_id").distinct()
    return rp.activity_features(daily, pairs, LONG_TARGETS)


def _m14_sql():
    """The M13 features for the thinned (sample date, pair) keys instead of all pairs."""
    head, feats = _m13_sql(M14_DATES).split("m13 AS (")
    keys = """keys AS (
  SELECT COALESCE(h.target_date, l.target_date) AS target_date, COALESCE(h.customer_id, l.customer_id) AS customer_id,
         COALESCE(h.product_id, l.product_id) AS product_id, CASE WHEN l.customer_id IS NULL THEN 0 ELSE 1 END AS label,
         h.customer_id IS NOT NULL AS has_history
  FROM (SELECT DISTINCT target_date, customer_id, product_id FROM rows) h
  FULL JOIN (SELECT DISTINCT tg.target_date, d.customer_id, d.product_id FROM ld d, tg
             WHERE d.transaction_date >= tg.target_date AND d.transaction_date < tg.target_date + 7) l
    ON h.target_date = l.target_date AND h.customer_id = l.customer_id AND h.product_id = l.product_id),
"""
    feats = feats.replace("FROM pairs p CROSS JOIN tg", "FROM (SELECT * FROM keys WHERE "
                          + _thin_sql("keys", 4.0, ["customer_id", "product_id", "target_date"]) + ") p")
    feats = feats.replace("tg.target_date", "p.target_date").replace("AS target_date,", "AS target_date, p.label, p.has_history,", 1)
    return head + keys + "m13 AS (" + feats


@query("M14", osql("SELECT * FROM m13", ctes=_m14_sql()))
def m14_training_samples(spark, sf_dir):
    """Labelled samples every 15 days (90-day features, 7-day labels), negatives
    thinned to 4 per positive by key hash."""
    daily = rp.daily_purchases(Views(spark, sf_dir).replen_tx_long())
    s = rp.training_samples(daily, M14_DATES[0], "2001-07-01", 15, ratio=4.0)
    return s.withColumnRenamed("sample_date", "target_date")


@query("M14_counts", osql("""
SELECT CAST(COALESCE(hk.s, lk.s) AS VARCHAR) AS sample_date, count_if(lk.s IS NOT NULL) AS positives,
       count_if(lk.s IS NULL) AS negatives, count_if(lk.s IS NOT NULL AND hk.s IS NULL) AS positives_without_history
FROM hk FULL OUTER JOIN lk ON hk.s = lk.s AND hk.customer_id = lk.customer_id AND hk.product_id = lk.product_id
GROUP BY 1""", ctes=_LONG + """,
sd AS (SELECT CAST(unnest(generate_series(DATE '2000-07-01', DATE '2001-07-01', INTERVAL 15 DAY)) AS DATE) AS s),
hk AS (SELECT DISTINCT sd.s, l.customer_id, l.product_id FROM ld l, sd
       WHERE l.transaction_date >= sd.s - 90 AND l.transaction_date < sd.s),
lk AS (SELECT DISTINCT sd.s, l.customer_id, l.product_id FROM ld l, sd
       WHERE l.transaction_date >= sd.s AND l.transaction_date < sd.s + 7)"""))
def m14_counts(spark, sf_dir):
    """Per sample date, positives / negatives before thinning (J18 + U1)."""
    v = Views(spark, sf_dir)
    daily = rp.daily_purchases(v.replen_tx_long())
    s = rp.training_samples(daily, "2000-07-01", "2001-07-01", 15)
    return s.groupBy("sample_date").agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"),
        F.count_if((F.col("label") == 1) & ~F.col("has_history")).alias("positives_without_history"))


def _samples(v, end=END):
    return rp.rolling_samples(rp.daily_purchases(v.replen_tx), end, ratio=3.0)


_MODELS: dict[tuple, str] = {}


def _trained(spark, sf_dir, anew=False):
    """(model, scored held-out rows) of the rolling samples.  A model is trained once per
    application and table folder, stored in the shared folder and loaded from there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _MODELS.get(key)
    if path is None or anew:
        path = sub_checkpoint(spark, f"models/purchase-{uuid.uuid4().hex[:12]}")
        model, scored = bo.train(_samples(Views(spark, sf_dir)))
        model.save(path)
        keep = scored.select(*bo.KEYS, "label", "label_d", "rawPrediction", "probability")
        keep.write.parquet(f"{path}/held_out")
        _MODELS[key] = path
    return bo.PurchaseModel.load(spark, path), spark.read.parquet(f"{path}/held_out")


def _hashed(seed, cols):
    text = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"concat_ws('|', '{seed}', {text})"


_SAMPLED = f""",
m15 AS ({_M15}),
sampled AS (SELECT *, CAST('0x' || substr(md5({_hashed(43, ["customer_id", "product_id", "target_date", "label"])}), 1, 8) AS BIGINT)
                      / 4294967296.0::DOUBLE >= 0.8 AS held_out
            FROM m15 WHERE """ + _thin_sql("m15", 3.0, ["customer_id", "product_id", "target_date"]) + ")"


def _stat_sql(c):
    h = f"md5({_hashed(44, ['customer_id', 'product_id', 'target_date'])}), customer_id, product_id, target_date"
    over = f"OVER (PARTITION BY {c} ORDER BY {h} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (f"round((COALESCE(SUM(label) {over}, 0) + (SELECT AVG(label) FROM sampled WHERE NOT held_out)) "
            f"/ (COUNT(*) {over} + 1.0::DOUBLE), 9) AS ts_{c}")


@query("M16_target_stats", osql(f"""
SELECT customer_id, product_id, target_date, {", ".join(_stat_sql(c) for c in bo.CATEGORIES)} FROM sampled WHERE NOT held_out""",
    ctes=_m12_sql(CUT, TARGETS) + _SAMPLED))
def m16_target_stats(spark, sf_dir):
    """Ordered target statistics of the five categories for the training rows."""
    rows = cut(_samples(Views(spark, sf_dir)).filter(~bo.held_out()))
    stats = bo.ordered_target_stats(rows)
    return stats.select(*bo.KEYS, *[F.round(f"ts_{c}", 9).alias(f"ts_{c}") for c in bo.CATEGORIES])


@query("M16", osql("""
SELECT count_if(held_out) AS held_out, count_if(held_out AND label = 1) AS positives, count_if(held_out AND label = 0) AS negatives,
       TRUE AS sums_agree, TRUE AS stopped_within_limit, TRUE AS auc_in_range FROM sampled""", ctes=_m12_sql(CUT, TARGETS) + _SAMPLED))
def m16_train(spark, sf_dir):
    """The classifier trained on the rolling samples: held-out rows of both classes, and
    that the confusion sums add up, at most 500 trees were grown and the AUC is one."""
    model, scored = _trained(spark, sf_dir, anew=True)
    m, rounds = rp.evaluate(scored, 0.5), model.facts["rounds"]
    return m.select(F.col("n").alias("held_out"), (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"),
                    (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") == F.col("n")).alias("sums_agree"),
                    F.lit(1 <= rounds <= bo.ROUNDS).alias("stopped_within_limit"), F.col("auc").between(0, 1).alias("auc_in_range"))


@query("M16_metrics")
def m16_metrics(spark, sf_dir):
    """Held-out metrics of the trained model and its number of trees (one row)."""
    model, scored = _trained(spark, sf_dir)
    return rp.evaluate(scored, 0.5).withColumn("trees", F.lit(model.facts["rounds"]))


@query("M17", osql(f"""
SELECT q.customer_id, q.product_id, greatest(1, CAST(floor(MIN(d.quantity)) AS BIGINT)) AS estimated_quantity, TRUE AS day_in_week,
       TRUE AS probability_in_range
FROM qpairs q JOIN (
  SELECT *, row_number() OVER (PARTITION BY customer_id, product_id ORDER BY transaction_date DESC) AS r FROM (
    SELECT customer_id, product_id, transaction_date, SUM(quantity) AS quantity FROM replen_tx
    WHERE document_type = '{SALE}' AND transaction_date <= DATE '{END}' GROUP BY 1, 2, 3)) d
  ON q.customer_id = d.customer_id AND q.product_id = d.product_id AND d.r <= 3
GROUP BY 1, 2""", ctes=_WIN))
def m17_score(spark, sf_dir):
    """Every qualified pair scored for the next 7 days: its best day lies in them, its
    probability is one, and its quantity is the least of its last three."""
    s = _scores(spark, sf_dir, 0.0)
    after = F.datediff("prediction_date", F.lit(END).cast("date"))
    return s.select("customer_id", "product_id", "estimated_quantity", after.between(1, 7).alias("day_in_week"),
                    F.col("purchase_probability").between(0, 1).alias("probability_in_range"))


def _scores(spark, sf_dir, threshold):
    v = Views(spark, sf_dir)
    return rp.score(_trained(spark, sf_dir)[0], rp.daily_purchases(v.replen_tx), _pairs(v), END, threshold=threshold)


@query("M17_predictions")
def m17_predictions(spark, sf_dir):
    """Best day per qualified pair in the next 7 days, probability ≥ 0.5."""
    return _scores(spark, sf_dir, 0.5)


VAL_TRAIN_END, VAL_CUT = "2024-01-16", "2024-01-23"


def _validated(spark, sf_dir):
    """(first model, metrics of the validation week, final model)."""
    v = Views(spark, sf_dir)
    daily = rp.daily_purchases(v.replen_tx)
    first, _ = bo.train(_samples(v, VAL_TRAIN_END))
    pairs = rp.qualified_pairs(daily.filter(F.col("transaction_date") <= F.lit(VAL_TRAIN_END).cast("date")), VAL_TRAIN_END)
    pred = rp.score(first, daily.filter(F.col("transaction_date") <= F.lit(VAL_CUT).cast("date")), pairs, VAL_CUT)
    act = daily.filter((F.col("transaction_date") > F.lit(VAL_CUT).cast("date")) & (F.col("transaction_date") <= F.lit(END).cast("date")))
    metrics = rp.pair_metrics(pred, act.join(pairs.select("customer_id", "product_id"), ["customer_id", "product_id"], "left_semi"))
    samples = cut(_samples(v))
    return first, metrics, bo.fit_all(samples, first.facts["rounds"]), samples


@query("M18", osql(f"""
SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT d.customer_id, d.product_id FROM replen_tx d JOIN vpairs p
          ON d.customer_id = p.customer_id AND d.product_id = p.product_id
        WHERE d.document_type = '{SALE}' AND d.transaction_date > DATE '{VAL_CUT}' AND d.transaction_date <= DATE '{END}')) AS actual_pairs,
       (SELECT COUNT(*) FROM sampled) AS final_samples, TRUE AS same_trees""",
    ctes=_m12_sql(CUT, TARGETS) + _SAMPLED + f""",
vcust AS (SELECT customer_id FROM (SELECT DISTINCT customer_id, product_id, transaction_date FROM replen_tx
            WHERE document_type = '{SALE}' AND transaction_date <= DATE '{VAL_TRAIN_END}') GROUP BY 1
          HAVING COUNT(*) >= 3 AND date_diff('day', MAX(transaction_date), DATE '{VAL_TRAIN_END}') <= 30),
vpairs AS (SELECT customer_id, product_id FROM (SELECT DISTINCT customer_id, product_id, transaction_date FROM replen_tx
             WHERE document_type = '{SALE}' AND transaction_date <= DATE '{VAL_TRAIN_END}')
           WHERE customer_id IN (SELECT customer_id FROM vcust) GROUP BY 1, 2 HAVING COUNT(*) >= 2)"""))
def m18_forward_validate(spark, sf_dir):
    """Train on history up to a week before the validation week (7-day buffer), predict
    that week, compare pair sets, then fit all rows with as many trees."""
    first, metrics, final, samples = _validated(spark, sf_dir)
    return metrics.select((F.col("tp") + F.col("fn")).alias("actual_pairs"), samples.agg(F.count("*")).scalar().alias("final_samples"),
                          F.lit(first.facts["rounds"] == final.facts["rounds"]).alias("same_trees"))


@query("M18_metrics")
def m18_metrics(spark, sf_dir):
    """TP, FP, FN, precision, recall and F1 of the validation week, and the trees of the final model."""
    _, metrics, final, _ = _validated(spark, sf_dir)
    return metrics.withColumn("trees", F.lit(final.facts["rounds"]))


@query("M19", osql(f"""
SELECT CAST(COALESCE(c.ws, DATE '2001-08-01' - 20) AS VARCHAR) AS val_start,
       CAST(COALESCE(c.ws + 6, DATE '2001-08-01' - 14) AS VARCHAR) AS val_end, c.ws IS NULL AS fallback
FROM (SELECT 1) one LEFT JOIN (
  SELECT MIN(k) AS k FROM (
    SELECT w.k, w.ws, (SELECT COUNT(*) FROM ld WHERE transaction_date >= w.ws AND transaction_date <= w.ws + 6) AS n
    FROM (SELECT k, (DATE '2001-08-01' - CAST(isodow(DATE '2001-08-01') - 1 AS INTEGER)) - 7 * CAST(k AS INTEGER) AS ws FROM (SELECT unnest(range(3, 8)) AS k)) w)
  WHERE n >= 50) b ON TRUE
LEFT JOIN (SELECT k, (DATE '2001-08-01' - CAST(isodow(DATE '2001-08-01') - 1 AS INTEGER)) - 7 * CAST(k AS INTEGER) AS ws FROM (SELECT unnest(range(3, 8)) AS k)) c
  ON c.k = b.k""", ctes=_LONG))
def m19_find_val_week(spark, sf_dir):
    """Validation week 3–7 weeks back with ≥ 50 sale days, else fallback."""
    v = Views(spark, sf_dir)
    return rp.find_val_week(rp.daily_purchases(v.replen_tx_long()), "2001-08-01", 50)


# ---------------------------------------------------------------- prediction book-keeping
def _pred_status(v):
    pred = rp.predict_orders(v.replen_tx, PRED_AS_OF).withColumn(
        "created_at", F.lit(PRED_CREATED).cast("timestamp")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    return rp.prediction_status(pred, rp.daily_purchases(v.replen_tx), END)


_STATUS = _m10_sql(PRED_AS_OF) + f""",
dd AS (SELECT DISTINCT customer_id, CAST(product_id AS VARCHAR) AS product_id, transaction_date FROM replen_tx
       WHERE transaction_date <= DATE '{END}'),
ps AS (SELECT p.*, TIMESTAMP '{PRED_CREATED}' AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at,
              CASE WHEN p.will_purchase_anything AND EXISTS (
                        SELECT 1 FROM dd WHERE dd.customer_id = p.customer_id AND dd.product_id = p.product_id
                          AND abs(date_diff('day', dd.transaction_date, p.prediction_date)) <= 2) THEN 'fulfilled'
                   WHEN p.will_purchase_anything AND p.prediction_date + 2 < DATE '{END}' THEN 'expired'
                   ELSE 'active' END AS prediction_status
       FROM preds p)"""


@query("A25", osql("""
SELECT prediction_status, COUNT(*) AS count, round(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM ps), 2) AS percent
FROM ps GROUP BY 1""", ctes=_STATUS))
def a25_status_shares(spark, sf_dir):
    """Prediction status shares."""
    return rp.status_shares(_pred_status(Views(spark, sf_dir)))


@query("A26", osql("""
SELECT COUNT(*) AS total, count_if(prediction_status = 'fulfilled') AS fulfilled,
       CASE WHEN COUNT(*) > 0 THEN round(count_if(prediction_status = 'fulfilled') / COUNT(*), 6) ELSE 0.0 END AS accuracy
FROM ps WHERE will_purchase_anything AND prediction_date = DATE '2024-01-22'""", ctes=_STATUS))
def a26_daily_accuracy(spark, sf_dir):
    """Accuracy of one day's positive predictions."""
    return rp.daily_accuracy(_pred_status(Views(spark, sf_dir)), "2024-01-22")


@query("A27", osql(f"""
SELECT CAST(prediction_date AS VARCHAR) AS prediction_date, COUNT(*) AS total, count_if(will_purchase_anything) AS purchases
FROM ps WHERE prediction_date > DATE '{PRED_AS_OF}' GROUP BY prediction_date ORDER BY prediction_date LIMIT 7""",
    ctes=_STATUS))
def a27_upcoming(spark, sf_dir):
    """Upcoming predictions per day, first 7 days."""
    return rp.upcoming(_pred_status(Views(spark, sf_dir)), PRED_AS_OF)


@query("A28", osql("""
SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn)))
                  ELSE 0.0 END, 6) AS f1
FROM (SELECT count_if(p AND a) AS tp, count_if(p AND a IS NULL) AS fp, count_if(p IS NULL AND a) AS fn
      FROM (SELECT DISTINCT customer_id, product_id, TRUE AS p FROM preds WHERE will_purchase_anything) x
      FULL OUTER JOIN (SELECT DISTINCT customer_id, CAST(product_id AS VARCHAR) AS product_id, TRUE AS a FROM replen_tx
                       WHERE transaction_date >= DATE '2024-01-21' AND transaction_date <= DATE '2024-01-27') y
      ON x.customer_id = y.customer_id AND x.product_id = y.product_id)""", ctes=_m10_sql(PRED_AS_OF)))
def a28_pair_metrics(spark, sf_dir):
    """Predicted positive pairs vs pairs bought in the predicted week."""
    v = Views(spark, sf_dir)
    pred = rp.predict_orders(v.replen_tx, PRED_AS_OF).filter("will_purchase_anything")
    act = v.replen_tx.filter(F.col("transaction_date").between(F.lit("2024-01-21").cast("date"),
                                                               F.lit("2024-01-27").cast("date")))
    return rp.pair_metrics(pred, act.withColumn("product_id", F.col("product_id").cast("string")))


@query("A35", osql(f"""
SELECT COALESCE(a.customer_id, b.customer_id) AS customer_id, COALESCE(a.product_id, b.product_id) AS product_id,
       CAST(a.lp AS VARCHAR) AS last_prediction_at, CAST(b.lb AS VARCHAR) AS last_purchase_date
FROM (SELECT customer_id, product_id, MAX(COALESCE(updated_at, created_at)) AS lp FROM ps
      WHERE prediction_status = 'active' GROUP BY 1, 2) a
FULL OUTER JOIN (SELECT customer_id, CAST(product_id AS VARCHAR) AS product_id, MAX(transaction_date) AS lb FROM replen_tx
                 WHERE transaction_date >= DATE '{WIN_START}' AND transaction_date <= DATE '{END}' GROUP BY 1, 2) b
  ON a.customer_id = b.customer_id AND a.product_id = b.product_id""", ctes=_STATUS))
def a35_last_events(spark, sf_dir):
    """Last active prediction and last purchase per pair."""
    v = Views(spark, sf_dir)
    return rp.last_events(_pred_status(v), _daily(v)).select(
        "customer_id", "product_id", "last_prediction_at", "last_purchase_date")


@query("M20", osql(f"""
SELECT q.customer_id, CAST(q.product_id AS VARCHAR) AS product_id,
       CASE WHEN a.n IS NULL THEN 'new' WHEN a.f > 0 THEN 'fulfilled' WHEN a.ac = 0 THEN 'expired' ELSE 'wait' END AS reason,
       CASE WHEN a.n IS NULL THEN 'new' WHEN a.f > 0 THEN 'fulfilled' WHEN a.ac = 0 THEN 'expired' ELSE 'wait' END <> 'wait'
         AS eligible
FROM (SELECT DISTINCT customer_id, CAST(product_id AS VARCHAR) AS product_id FROM qpairs) q
LEFT JOIN (SELECT customer_id, product_id, COUNT(*) AS n, count_if(prediction_status = 'fulfilled') AS f,
                  count_if(prediction_status = 'active' AND prediction_date > DATE '2024-01-23'
                           AND prediction_date <= DATE '2024-01-30') AS ac
           FROM ps WHERE will_purchase_anything GROUP BY 1, 2) a
  ON q.customer_id = a.customer_id AND q.product_id = a.product_id""", ctes=_STATUS + "," + _WIN))
def m20_eligible_for_prediction(spark, sf_dir):
    """Which qualified pairs may get a new prediction on 2024-01-23."""
    v = Views(spark, sf_dir)
    pairs = _pairs(v).withColumn("product_id", F.col("product_id").cast("string"))
    return rp.eligible_for_prediction(_pred_status(v), _daily(v), pairs, "2024-01-23")


_M10_NAMES = ("cstats2", "cstats", "cseg", "celig", "elig", "hist", "dord", "span", "wdays", "per", "rate", "tgt",
              "tx", "tops", "tw", "preds")


def _m10_sql_sfx(as_of, sfx):
    import re
    sql = _m10_sql(as_of)
    for name in _M10_NAMES:
        sql = re.sub(rf"\b{name}\b", name + sfx, sql)
    return sql


@query("M21", osql(f"""
SELECT n.customer_id, n.product_id, CAST(n.prediction_date AS VARCHAR) AS prediction_date, n.purchase_probability
FROM preds_n n LEFT JOIN ev ON n.customer_id = ev.customer_id AND n.product_id = ev.product_id
WHERE n.will_purchase_anything AND (ev.lp IS NULL OR ev.lb >= CAST(ev.lp AS DATE))""",
    ctes=_STATUS + "," + _m10_sql_sfx("2024-01-27", "_n") + f""",
ev AS (SELECT COALESCE(a.customer_id, b.customer_id) AS customer_id, COALESCE(a.product_id, b.product_id) AS product_id,
              a.lp, b.lb
       FROM (SELECT customer_id, product_id, MAX(COALESCE(updated_at, created_at)) AS lp FROM ps
             WHERE prediction_status = 'active' GROUP BY 1, 2) a
       FULL OUTER JOIN (SELECT customer_id, CAST(product_id AS VARCHAR) AS product_id, MAX(transaction_date) AS lb
                        FROM replen_tx WHERE transaction_date >= DATE '{WIN_START}' AND transaction_date <= DATE '{END}'
                        GROUP BY 1, 2) b
       ON a.customer_id = b.customer_id AND a.product_id = b.product_id)"""))
def m21_refresh_filter(spark, sf_dir):
    """New positive predictions of 2024-01-27 written only for pairs never predicted
    or bought since their last prediction."""
    v = Views(spark, sf_dir)
    new = rp.predict_orders(v.replen_tx, "2024-01-27").filter("will_purchase_anything")
    ev = rp.last_events(_pred_status(v), _daily(v))
    return rp.refresh_filter(new, ev).select("customer_id", "product_id", "prediction_date", "purchase_probability")


@query("M22", osql("""
SELECT customer_id, product_id, CAST(prediction_date AS VARCHAR) AS prediction_date, purchase_probability,
       CASE WHEN purchase_probability >= 0.9 THEN 'high' WHEN purchase_probability >= 0.8 THEN 'medium' ELSE 'low' END
         AS confidence_level
FROM preds WHERE purchase_probability >= 0.5""", ctes=_m10_sql(PRED_AS_OF)))
def m22_convert(spark, sf_dir):
    """Predictions with probability ≥ .5 and their confidence labels."""
    p = rp.convert(rp.predict_orders(Views(spark, sf_dir).replen_tx, PRED_AS_OF))
    return p.select("customer_id", "product_id", "prediction_date", "purchase_probability", "confidence_level")


@query("M23", osql("""
SELECT p.customer_id, p.product_id, CAST(p.prediction_date AS VARCHAR) AS prediction_date FROM preds p
WHERE p.will_purchase_anything AND NOT EXISTS (
  SELECT 1 FROM replen_tx t WHERE t.customer_id = p.customer_id AND CAST(t.product_id AS VARCHAR) = p.product_id
    AND t.transaction_date >= DATE '2024-01-21' AND t.transaction_date <= DATE '2024-01-30')""",
    ctes=_m10_sql(PRED_AS_OF)))
def m23_drop_bought(spark, sf_dir):
    """Pending positive predictions minus pairs bought since."""
    v = Views(spark, sf_dir)
    pend = rp.predict_orders(v.replen_tx, PRED_AS_OF).filter("will_purchase_anything").select(
        "customer_id", "product_id", "prediction_date")
    return rp.drop_bought(pend, rp.daily_purchases(v.replen_tx, None, END), "2024-01-21")
