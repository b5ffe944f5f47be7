"""Registered monitoring queries (A29–A31, C14, C15, W12, SRC7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import monitor as mo
from ledgerflow.plans.registry import query
from ledgerflow.sources.views import Views, osql

NOW = "2024-01-30 12:00:00"
FRESH_NOW = "2024-02-01 10:00:00"
CRITICAL_TASKS = ("task_0", "task_1", "task_2")
# Monitored "tables" of the adapter (one per event type) and their expected schedule.
FRESH_CONFIG = [("view", "daily", "22:00", 2, None), ("click", "daily", "02:00", 2, None),
                ("error", "daily", "08:00", 4, None), ("purchase", "weekly", "08:00", 4, None),
                ("signup", "monthly", "03:00", 2, 5), ("refund", "daily", "06:00", 2, None)]
_TABLES = ("view", "click", "error", "purchase", "signup")


def _checks(v):
    t = v.task_log
    return t.withColumn("status", F.when(F.col("status") == "error", F.lit("failure")).otherwise(F.lit("success")))


_CHK = """chk AS (SELECT run_id, task_id, CASE WHEN status = 'error' THEN 'failure' ELSE 'success' END AS status, duration, ts
               FROM task_log)"""


@query("A29", osql(f"""
SELECT task_id, COUNT(*) AS total_checks, count_if(status = 'success') AS successful_checks,
       count_if(status = 'failure') AS failed_checks, round(AVG(duration), 6) AS avg_execution_time,
       MAX(duration) AS max_execution_time, MIN(duration) AS min_execution_time,
       round(count_if(status = 'success') * 100.0 / COUNT(*), 2) AS success_rate
FROM chk WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND duration IS NOT NULL GROUP BY 1""", ctes=_CHK))
def a29_check_stats(spark, sf_dir):
    """Per-check statistics over the last 7 days."""
    return mo.check_stats(_checks(Views(spark, sf_dir)), NOW, 7)


@query("A30", osql(f"""
SELECT status, COUNT(*) AS runs FROM task_log WHERE CAST(ts AS DATE) = DATE '{NOW[:10]}' GROUP BY 1"""))
def a30_runs_today(spark, sf_dir):
    """today's runs by status."""
    return mo.run_stats(Views(spark, sf_dir).task_log, NOW)[0]


@query("A30_latest", osql("""
SELECT task_id, CAST(arg_max(ts, (ts, run_id)) AS VARCHAR) AS last_run, arg_max(status, (ts, run_id)) AS last_status,
       arg_max(run_id, (ts, run_id)) AS last_run_id FROM task_log GROUP BY 1"""))
def a30_latest_runs(spark, sf_dir):
    """The latest run of every task."""
    return mo.run_stats(Views(spark, sf_dir).task_log, NOW)[1]


@query("A30_schedules", osql(f"""
SELECT count_if(last_run >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS enabled_schedules, COUNT(*) AS total_schedules
FROM (SELECT task_id, MAX(ts) AS last_run FROM task_log GROUP BY 1)"""))
def a30_schedules(spark, sf_dir):
    """Enabled and all schedules; a task of the log counts as enabled when it ran within a day of now."""
    day_ago = F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 1 DAY")
    tasks = Views(spark, sf_dir).task_log.groupBy("task_id").agg((F.max("ts") >= day_ago).alias("enabled"))
    return mo.schedule_counts(tasks)


@query("C15", osql(f"""
SELECT f.failing_now, l.low_success_rate, r.critical_alerts_24h,
       CASE WHEN f.failing_now > 0 THEN 'critical' WHEN l.low_success_rate > 0 OR r.critical_alerts_24h > 0 THEN 'warning'
            ELSE 'healthy' END AS overall_status
FROM (SELECT count_if(s = 'failure') AS failing_now FROM (SELECT arg_max(status, (ts, run_id)) AS s FROM chk GROUP BY task_id)) f,
     (SELECT count_if(success_rate < 95) AS low_success_rate FROM (
        SELECT round(count_if(status = 'success') * 100.0 / COUNT(*), 2) AS success_rate FROM chk
        WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND duration IS NOT NULL GROUP BY task_id)) l,
     (SELECT COUNT(*) AS critical_alerts_24h FROM chk WHERE status = 'failure' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR
        AND task_id IN ({", ".join(f"'{t}'" for t in CRITICAL_TASKS)})) r""", ctes=_CHK))
def c15_overall_health(spark, sf_dir):
    """Overall health from the latest checks, success rates and critical failures."""
    v = Views(spark, sf_dir)
    chk = _checks(v)
    crit = spark.createDataFrame([(t,) for t in CRITICAL_TASKS], "task_id string")
    return mo.overall_health(chk, mo.check_stats(chk, NOW, 7), crit, NOW)


def _cfg(spark):
    return spark.createDataFrame(FRESH_CONFIG, "table_name string, frequency string, expected_time string, "
                                               "tolerance_hours int, expected_day int")


_CFG_SQL = "cfg AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{f}', '{e}', {tol}, {'NULL' if d is None else d})" for t, f, e, tol, d in FRESH_CONFIG) + \
    ") AS c(table_name, frequency, expected_time, tolerance_hours, expected_day))"

_FRESH = _CFG_SQL + f""",
lastu AS (SELECT event_type AS table_name, MAX(ts) AS last_update,
                 count_if(ts >= TIMESTAMP '{FRESH_NOW}' - INTERVAL 24 HOUR) AS recent_records FROM events GROUP BY 1),
fr0 AS (SELECT c.*, l.last_update, COALESCE(l.recent_records, 0) AS recent_records,
               make_timestamp(2024, 2, 1, CAST(split_part(c.expected_time, ':', 1) AS BIGINT),
                              CAST(split_part(c.expected_time, ':', 2) AS BIGINT), 0.0) AS exp_today
        FROM cfg c LEFT JOIN lastu l ON c.table_name = l.table_name),
fr AS (SELECT table_name, frequency, last_update, recent_records,
              CASE WHEN frequency = 'daily' AND TIMESTAMP '{FRESH_NOW}' >= exp_today
                        AND CAST(last_update AS DATE) < DATE '{FRESH_NOW[:10]}'
                   THEN round((epoch(TIMESTAMP '{FRESH_NOW}') - epoch(exp_today)) / 3600.0, 2) ELSE 0.0 END AS delay_hours,
              CASE WHEN last_update IS NULL THEN 'critical'
                   WHEN frequency = 'daily' THEN
                     CASE WHEN TIMESTAMP '{FRESH_NOW}' >= exp_today THEN
                            CASE WHEN CAST(last_update AS DATE) < DATE '{FRESH_NOW[:10]}' THEN
                                   CASE WHEN (epoch(TIMESTAMP '{FRESH_NOW}') - epoch(exp_today)) / 3600.0 > tolerance_hours
                                        THEN 'critical' ELSE 'warning' END
                                 ELSE 'healthy' END
                          ELSE CASE WHEN CAST(last_update AS DATE) = DATE '{FRESH_NOW[:10]}' - 1 THEN 'healthy' ELSE 'warning' END
                     END
                   WHEN frequency = 'weekly' THEN
                     CASE WHEN last_update < TIMESTAMP '{FRESH_NOW}' - to_days(CAST(isodow(TIMESTAMP '{FRESH_NOW}') - 1 AS INTEGER))
                          THEN 'warning' ELSE 'healthy' END
                   WHEN frequency = 'monthly' THEN
                     CASE WHEN last_update < CAST(date_trunc('month', TIMESTAMP '{FRESH_NOW}') AS TIMESTAMP)
                               AND dayofmonth(TIMESTAMP '{FRESH_NOW}') > expected_day THEN 'critical' ELSE 'healthy' END
                   ELSE 'unknown' END AS status
       FROM fr0)"""


def _fresh(v):
    ups = v.raw("events").select(F.col("event_type").alias("table_name"), F.col("ts").cast("timestamp").alias("ts"))
    return mo.freshness(ups, _cfg(v.spark), FRESH_NOW)


@query("C14", osql("""SELECT table_name, frequency, CAST(last_update AS VARCHAR) AS last_update, recent_records,
       delay_hours, status FROM fr""", ctes=_FRESH))
def c14_freshness(spark, sf_dir):
    """C14: freshness status of every monitored table."""
    return _fresh(Views(spark, sf_dir))


_HIST = f"""hist AS (SELECT CASE user_id % 5 {" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TABLES))} END AS job_id,
                  CAST(ts AS TIMESTAMP) + INTERVAL 2 DAY AS ts,
                  CASE WHEN user_id % 2 = 0 THEN 'warning' ELSE 'critical' END AS status
           FROM events WHERE event_type = 'error')"""


def _history(v):
    ev = v.raw("events")
    job = F.element_at(F.array(*[F.lit(t) for t in _TABLES]), (F.col("user_id") % 5 + 1).cast("int"))
    return ev.filter(F.col("event_type") == "error").select(
        job.alias("job_id"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("ts"),
        F.when(F.col("user_id") % 2 == 0, F.lit("warning")).otherwise(F.lit("critical")).alias("status"))


@query("W12", osql(f"""
SELECT f.table_name AS job_id, f.status, COALESCE(h.n, 0) AS alerts_sent, CAST(h.last_alert AS VARCHAR) AS last_alert,
       CASE WHEN COALESCE(h.n, 0) >= 5 THEN FALSE
            WHEN h.last_alert IS NOT NULL AND h.last_alert > TIMESTAMP '{FRESH_NOW}' - INTERVAL 4 HOUR THEN FALSE
            WHEN f.status = 'critical' THEN TRUE
            WHEN f.status = 'warning' THEN (h.first_warning IS NOT NULL AND h.first_warning < TIMESTAMP '{FRESH_NOW}' - INTERVAL 2 HOUR)
            ELSE FALSE END AS send_alert
FROM fr f LEFT JOIN (SELECT job_id, COUNT(*) AS n, MAX(ts) AS last_alert,
                            MIN(CASE WHEN status = 'warning' THEN ts END) AS first_warning FROM hist GROUP BY 1) h
  ON f.table_name = h.job_id""", ctes=_FRESH + ",\n" + _HIST))
def w12_alerts(spark, sf_dir):
    """Alert decisions for the freshness statuses given the alert history."""
    v = Views(spark, sf_dir)
    health = _fresh(v).select(F.col("table_name").alias("job_id"), "status")
    return mo.alerts(health, _history(v), FRESH_NOW)


def _job_checks(v, events=None):
    """Health checks of the monitored jobs, one per event: errors are problems, the rest is healthy."""
    ev = v.raw("events") if events is None else events
    job = F.element_at(F.array(*[F.lit(t) for t in _TABLES]), (F.col("user_id") % 5 + 1).cast("int"))
    bad = F.when(F.col("user_id") % 2 == 0, F.lit("warning")).otherwise(F.lit("critical"))
    return ev.select(job.alias("job_id"), F.col("ts").cast("timestamp").alias("ts"),
                     F.when(F.col("event_type") == "error", bad).otherwise(F.lit("healthy")).alias("status"))


def _decided(checks):
    """The checks that a stream's last watermark has passed."""
    last = checks.agg(F.max("ts")).scalar()
    return checks.filter(F.col("ts") < F.date_trunc("millisecond", last))


def _first_warnings(checks):
    """The alert history a stream starts with: each job's first warning."""
    return checks.filter(F.col("status") == "warning").groupBy("job_id").agg(F.min("ts").alias("ts")).withColumn("status", F.lit("warning"))


def _over_time_sql():
    jobs = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TABLES))
    ctes = f"""checks AS (SELECT CASE user_id % 5 {jobs} END AS job_id, CAST(ts AS TIMESTAMP) AS ts,
                 CASE WHEN user_id % 2 = 0 THEN 'warning' ELSE 'critical' END AS status FROM events
          WHERE event_type = 'error' AND ts < (SELECT date_trunc('millisecond', MAX(ts)) FROM events)),
s0 AS (SELECT job_id, 1 AS n, MIN(ts) AS last, MIN(ts) AS warned FROM (
         SELECT CASE user_id % 5 {jobs} END AS job_id, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'error' AND user_id % 2 = 0)
       GROUP BY 1)"""
    for k in range(1, 6):
        ctes += f""",
f{k} AS (SELECT c.job_id, MIN((c.ts, c.status)) AS a FROM checks c JOIN s{k - 1} s ON c.job_id = s.job_id
        WHERE s.n < 5 AND (s.last IS NULL OR c.ts >= s.last + INTERVAL 4 HOUR)
          AND (c.status = 'critical' OR s.warned < c.ts - INTERVAL 2 HOUR) GROUP BY 1),
s{k} AS (SELECT s.job_id, s.n + 1 AS n, f.a[1] AS last, COALESCE(s.warned, CASE WHEN f.a[2] = 'warning' THEN f.a[1] END) AS warned
        FROM s{k - 1} s JOIN f{k} f ON s.job_id = f.job_id)"""
    return osql(" UNION ALL ".join(f"SELECT job_id, CAST(a[1] AS VARCHAR) AS ts, a[2] AS status FROM f{k}" for k in range(1, 6)), ctes=ctes)


@query("W12_alerts", _over_time_sql())
def w12_alerts_over_time(spark, sf_dir):
    """The alerts sent over the whole history of health checks."""
    checks = _job_checks(Views(spark, sf_dir))
    return mo.alerts_over_time(_decided(checks), _first_warnings(checks))


@query("W12_stream", _over_time_sql())
def w12_alert_stream(spark, sf_dir):
    """The same alerts from a stream of health checks, with state keyed by job."""
    from ledgerflow.streaming import jobs as sj

    v = Views(spark, sf_dir)
    return sj.run_alerts(spark, _job_checks(v, sj.stream_table(spark, sf_dir, "events")), _first_warnings(_job_checks(v)))


_API = r"""lines AS (SELECT CASE WHEN value < 5 THEN 'garbage line' ELSE
   '[API] ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0')
   || ' - api_calls - INFO - 模型=model-' || CAST(user_id % 3 AS VARCHAR) || ' | 操作=' || event_type
   || ' | 輸入=' || CAST(user_id * 7 + 10 AS VARCHAR) || 'tokens | 輸出=' || CAST(CAST(round(value * 10) AS BIGINT) AS VARCHAR)
   || 'tokens | 成本=NT$' || printf('%.2f', value / 100) || ' | 耗時=' || printf('%.2f', value / 10) || 's' END AS value
   FROM events),
calls AS (SELECT CAST(regexp_extract(value, '^\[API\] (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})', 1) AS TIMESTAMP) AS ts,
                 trim(regexp_extract(value, '模型=([^|]+?) \|', 1)) AS model,
                 trim(regexp_extract(value, '操作=([^|]+?) \|', 1)) AS operation,
                 CAST(regexp_extract(value, '輸入=(\d+)tokens', 1) AS BIGINT) AS input_tokens,
                 CAST(regexp_extract(value, '輸出=(\d+)tokens', 1) AS BIGINT) AS output_tokens,
                 CAST(regexp_extract(value, '成本=NT\$([0-9.]+)', 1) AS DOUBLE) AS cost_twd_logged,
                 CAST(regexp_extract(value, '耗時=([0-9.]+)s', 1) AS DOUBLE) AS seconds
          FROM lines WHERE value LIKE '[API]%'),
prices AS (SELECT * FROM (VALUES ('model-0', 0.25, 2.0), ('model-1', 1.25, 10.0)) p(model, price_input, price_output)),
priced AS (SELECT c.*, c.input_tokens / 1000000 * COALESCE(CAST(p.price_input AS DOUBLE), 0.0)
                       + c.output_tokens / 1000000 * COALESCE(CAST(p.price_output AS DOUBLE), 0.0) AS cost_usd
           FROM calls c LEFT JOIN prices p ON c.model = p.model)"""


def _calls(v):
    return mo.parse_api_log(mo.api_log_lines(v.raw("events")))


@query("SRC7", osql("""SELECT CAST(ts AS VARCHAR) AS ts, model, operation, input_tokens, output_tokens, cost_twd_logged,
       seconds FROM calls""", ctes=_API))
def src7_parse_api_log(spark, sf_dir):
    """SRC7: API usage log lines parsed (malformed lines dropped)."""
    return _calls(Views(spark, sf_dir))


_USAGE = """SELECT {by}, COUNT(*) AS calls, SUM(input_tokens) AS input_tokens, SUM(output_tokens) AS output_tokens,
       round(SUM(cost_usd), 8) AS cost_usd, round(SUM(cost_usd) * 31.5, 8) AS cost_twd, round(SUM(seconds), 6) AS seconds
FROM priced GROUP BY 1"""


@query("A31", osql(_USAGE.format(by="model").replace("SUM(input_tokens) AS", "CAST(SUM(input_tokens) AS BIGINT) AS")
                   .replace("SUM(output_tokens) AS", "CAST(SUM(output_tokens) AS BIGINT) AS"), ctes=_API))
def a31_usage_by_model(spark, sf_dir):
    """API calls, tokens and cost per model."""
    v = Views(spark, sf_dir)
    return mo.usage_costs(_calls(v), mo.model_prices(spark), "model")


@query("A31_operation", osql(_USAGE.format(by="operation").replace("SUM(input_tokens) AS",
                                                                  "CAST(SUM(input_tokens) AS BIGINT) AS")
                             .replace("SUM(output_tokens) AS", "CAST(SUM(output_tokens) AS BIGINT) AS"), ctes=_API))
def a31_usage_by_operation(spark, sf_dir):
    """API calls, tokens and cost per operation."""
    v = Views(spark, sf_dir)
    return mo.usage_costs(_calls(v), mo.model_prices(spark), "operation")
