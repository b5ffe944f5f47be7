"""Job and data-freshness monitoring (A29–A31, C14, C15, W12, SRC7).

All rules are evaluated against an explicit ``now`` (never the wall clock).  Config
tables (expected schedule per output table, model prices) are small and bounded and are
broadcast; the logs they are joined with stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.session import cut, lookup

# FIXED VALUES: currency conversion of the API usage ledger.
USD_TO_TWD_RATE = 31.5
# FIXED VALUES: alert policy.
MAX_ALERTS_PER_JOB = 5
ALERT_COOLDOWN_HOURS = 4
WARNING_THRESHOLD_HOURS = 2
# Pattern of one API usage log line (model, operation, tokens in/out, cost, seconds).
API_LOG_PATTERN = (r"^\[API\] (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d+ - api_calls - INFO - 模型=([^|]+?) \| "
                   r"操作=([^|]+?) \| 輸入=(\d+)tokens \| 輸出=(\d+)tokens \| 成本=NT\$([0-9.]+) \| 耗時=([0-9.]+)s")


def _ts(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp")


# --------------------------------------------------------------------- check logs
def check_stats(log: DataFrame, now: str, days: int = 7, ok_status: str = "success",
                fail_status: str = "failure") -> DataFrame:
    """Per check (task): total, successes, failures, avg / max / min duration and
    success rate % (2 decimals) over the last ``days`` days."""
    l = log.filter((F.col("ts") >= _ts(now) - F.expr(f"INTERVAL {days} DAYS")) & F.col("duration").isNotNull())
    return l.groupBy("task_id").agg(
        F.count("*").alias("total_checks"),
        F.count_if(F.col("status") == ok_status).alias("successful_checks"),
        F.count_if(F.col("status") == fail_status).alias("failed_checks"),
        F.round(F.avg("duration"), 6).alias("avg_execution_time"),
        F.max("duration").alias("max_execution_time"), F.min("duration").alias("min_execution_time"),
        F.round(F.count_if(F.col("status") == ok_status) * 100.0 / F.count("*"), 2).alias("success_rate"))


def run_stats(hist: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """today's runs by status, and the latest run of every task."""
    today = hist.filter(F.to_date("ts") == F.to_date(_ts(now))).groupBy("status").agg(F.count("*").alias("runs"))
    latest = hist.groupBy("task_id").agg(F.max_by(F.struct("ts", "status", "run_id"), F.struct("ts", "run_id")).alias("l"))
    return today, latest.select("task_id", F.col("l.ts").alias("last_run"), F.col("l.status").alias("last_status"),
                                F.col("l.run_id").alias("last_run_id"))


def schedule_counts(settings: DataFrame) -> DataFrame:
    """Enabled and all schedules of a settings table (one row per schedule)."""
    return settings.agg(F.count_if(F.col("enabled")).alias("enabled_schedules"), F.count("*").alias("total_schedules"))


def overall_health(log: DataFrame, stats: DataFrame, critical_tasks: DataFrame, now: str,
                   fail_status: str = "failure", min_success_rate: float = 95.0) -> DataFrame:
    """One row: critical when the latest check of any task failed; warning when a
    success rate is under 95 % or critical tasks failed in the last 24 h; else healthy;
    with the number of such alerts."""
    latest = log.groupBy("task_id").agg(F.max_by("status", F.struct("ts", "run_id")).alias("last_status"))
    failing = latest.agg(F.count_if(F.col("last_status") == fail_status).alias("failing_now"))
    low = stats.agg(F.count_if(F.col("success_rate") < min_success_rate).alias("low_success_rate"))
    recent = (log.filter((F.col("status") == fail_status) & (F.col("ts") >= _ts(now) - F.expr("INTERVAL 24 HOURS")))
              .join(F.broadcast(critical_tasks.select("task_id")), "task_id")
              .agg(F.count("*").alias("critical_alerts_24h")))
    j = failing.select("failing_now", low.scalar().alias("low_success_rate"),
                       recent.scalar().alias("critical_alerts_24h"))
    st = (F.when(F.col("failing_now") > 0, F.lit("critical"))
          .when((F.col("low_success_rate") > 0) | (F.col("critical_alerts_24h") > 0), F.lit("warning"))
          .otherwise(F.lit("healthy")))
    return j.withColumn("overall_status", st)


# ------------------------------------------------------------------- freshness (C14)
def freshness(updates: DataFrame, config: DataFrame, now: str) -> DataFrame:
    """C14: per monitored table: last update, rows in the last 24 h, delay hours and
    status by frequency:

    * daily: past today's expected time and no update today → critical beyond the
      tolerance, else warning; before the expected time, healthy only if the last
      update was yesterday (else warning); updated today → healthy.
    * weekly: warning if the last update is before now − weekday days (same clock time).
    * monthly: critical if not updated this month and today is past the expected day.
    * never updated → critical.

    ``updates``: (table_name, ts).  ``config``: table_name, frequency, expected_time
    'HH:MM', tolerance_hours, expected_day."""
    n = _ts(now)
    last = updates.groupBy("table_name").agg(
        F.max("ts").alias("last_update"),
        F.count_if(F.col("ts") >= n - F.expr("INTERVAL 24 HOURS")).alias("recent_records"))
    j = F.broadcast(config).join(last, "table_name", "left")
    hh = F.split("expected_time", ":")
    exp_today = F.make_timestamp(F.year(n), F.month(n), F.dayofmonth(n), hh[0].cast("int"), hh[1].cast("int"),
                                 F.lit(0).cast("decimal(8,6)"))
    lu = F.col("last_update")
    delay = (F.unix_timestamp(n) - F.unix_timestamp(exp_today)) / 3600.0
    daily_late = (n >= exp_today) & (F.to_date(lu) < F.to_date(n))
    tol = F.col("tolerance_hours")
    daily = (F.when(n >= exp_today, F.when(F.to_date(lu) < F.to_date(n),
                                           F.when(delay > tol, F.lit("critical")).otherwise(F.lit("warning")))
                    .otherwise(F.lit("healthy")))
             .otherwise(F.when(F.to_date(lu) == F.date_sub(F.to_date(n), 1), F.lit("healthy")).otherwise(F.lit("warning"))))
    week_start = n - F.make_interval(days=F.weekday(n))
    weekly = F.when(lu < week_start, F.lit("warning")).otherwise(F.lit("healthy"))
    month_start = F.trunc(F.to_date(n), "month").cast("timestamp")
    monthly = F.when((lu < month_start) & (F.dayofmonth(n) > F.col("expected_day")), F.lit("critical")).otherwise(
        F.lit("healthy"))
    f = F.col("frequency")
    status = (F.when(lu.isNull(), F.lit("critical")).when(f == "daily", daily).when(f == "weekly", weekly)
              .when(f == "monthly", monthly).otherwise(F.lit("unknown")))
    return j.select("table_name", "frequency", "last_update", F.coalesce("recent_records", F.lit(0)).alias("recent_records"),
                    F.when(daily_late & (f == "daily"), F.round(delay, 2)).otherwise(F.lit(0.0)).alias("delay_hours"),
                    status.alias("status"))


# ------------------------------------------------------------------------ alerts
def alerts(health: DataFrame, history: DataFrame, now: str) -> DataFrame:
    """W12 (batch form): whether each job's current status raises an alert: not when the
    job already had 5 alerts or one within the last 4 h; critical at once; warning only
    when an earlier warning alert is older than 2 h.  ``health``: (job_id, status);
    ``history``: (job_id, ts, status)."""
    n = _ts(now)
    h = history.groupBy("job_id").agg(
        F.count("*").alias("alerts_sent"), F.max("ts").alias("last_alert"),
        F.min(F.when(F.col("status") == "warning", F.col("ts"))).alias("first_warning"))
    j = health.join(h, "job_id", "left")
    cnt = F.coalesce("alerts_sent", F.lit(0))
    cooling = F.col("last_alert").isNotNull() & (F.col("last_alert") > n - F.expr(f"INTERVAL {ALERT_COOLDOWN_HOURS} HOURS"))
    old_warn = F.col("first_warning").isNotNull() & (
        F.col("first_warning") < n - F.expr(f"INTERVAL {WARNING_THRESHOLD_HOURS} HOURS"))
    send = (F.when(cnt >= MAX_ALERTS_PER_JOB, F.lit(False)).when(cooling, F.lit(False))
            .when(F.col("status") == "critical", F.lit(True))
            .when(F.col("status") == "warning", old_warn).otherwise(F.lit(False)))
    return j.select("job_id", "status", cnt.alias("alerts_sent"), "last_alert", send.alias("send_alert"))


def alert_history(history: DataFrame) -> DataFrame:
    """What the rule needs of a job's alerts: their number, the last one and the first warning."""
    return history.groupBy("job_id").agg(F.count("*").cast("int").alias("n"), F.max("ts").alias("last"),
                                         F.min(F.when(F.col("status") == "warning", F.col("ts"))).alias("warned"))


def alerts_over_time(checks: DataFrame, history: DataFrame) -> DataFrame:
    """W12 over time (batch form): the alerts sent for health checks (job_id, ts, status) taken
    in the order of their times, each alert joining the history.

    A job has at most ``MAX_ALERTS_PER_JOB`` alerts, so that many rounds find them all: a
    round looks up each job's next check that may be sent, as a minimum that aggregates
    before any shuffle.  Checks at the same time go by status."""
    checks = cut(checks.filter(F.col("status").isin("critical", "warning")).select("job_id", "ts", "status").distinct())
    state = cut(checks.select("job_id").distinct().join(alert_history(history), "job_id", "left")
                .withColumn("n", F.coalesce("n", F.lit(0))))
    sent = []
    for _ in range(MAX_ALERTS_PER_JOB):
        cool = F.col("last").isNull() | (F.col("ts") >= F.col("last") + F.expr(f"INTERVAL {ALERT_COOLDOWN_HOURS} HOURS"))
        old = F.col("warned") < F.col("ts") - F.expr(f"INTERVAL {WARNING_THRESHOLD_HOURS} HOURS")
        ready = (F.col("n") < MAX_ALERTS_PER_JOB) & cool & ((F.col("status") == "critical") | F.coalesce(old, F.lit(False)))
        # a job's state is one row; checks of a busy job stay where they are
        found = cut(lookup(checks, state, ["job_id"]).filter(ready).groupBy("job_id").agg(F.min(F.struct("ts", "status")).alias("a")))
        sent.append(found.select("job_id", "a.ts", "a.status"))
        new_warning = F.when(F.col("a.status") == "warning", F.col("a.ts"))
        state = cut(state.join(found, "job_id").select(
            "job_id", (F.col("n") + 1).alias("n"), F.col("a.ts").alias("last"), F.coalesce("warned", new_warning).alias("warned")))
    out = sent[0]
    for more in sent[1:]:
        out = out.union(more)
    return out


# State of a job in the streaming form: alerts so far, the last one, the first warning (microseconds, -1: none), open checks.
ALERT_STATE = "n int, last long, warned long, times array<long>, kinds array<string>"
ALERT_OUT = "job_id string, us long, status string"
HOUR_US = 3_600_000_000


def alert_state(key, frames, state):
    """W12 streaming step: checks wait until the watermark passes them, then go in the order of their times.

    Each check brings its job's earlier alerts (n, last, warned), which count once, when the state begins."""
    import pandas as pd

    if state.exists:
        n, last, warned, times, kinds = state.get
        open_checks = set(zip(times, kinds, strict=True))
    else:
        n, last, warned, open_checks = None, -1, -1, set()
    for frame in frames:
        if n is None and len(frame):
            row = frame.iloc[0]
            n, last, warned = int(row["n"]), int(row["last"]), int(row["warned"])
        problems = frame[frame["status"].isin(["critical", "warning"])]
        open_checks |= set(zip(problems["us"].astype("int64").tolist(), problems["status"].tolist(), strict=True))
    n = n or 0
    passed = state.getCurrentWatermarkMs() * 1000
    sent = []
    for us, status in sorted(open_checks):
        if us >= passed:
            break
        open_checks.discard((us, status))
        if n >= MAX_ALERTS_PER_JOB or (last >= 0 and us < last + ALERT_COOLDOWN_HOURS * HOUR_US):
            continue
        if status == "critical" or 0 <= warned < us - WARNING_THRESHOLD_HOURS * HOUR_US:
            sent.append((key[0], us, status))
            n, last = n + 1, us
            warned = us if warned < 0 and status == "warning" else warned
    rest = sorted(open_checks) if n < MAX_ALERTS_PER_JOB else []
    state.update((n, last, warned, [r[0] for r in rest], [r[1] for r in rest]))
    if rest:
        state.setTimeoutTimestamp(max(rest[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
    yield pd.DataFrame(sent, columns=["job_id", "us", "status"]).astype({"us": "int64"})


# --------------------------------------------------------------------- API usage
def parse_api_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC7: API usage lines → time, model, operation, input / output tokens, cost (NT$)
    and seconds; lines that do not match are dropped."""
    v = F.col(col)
    ok = v.rlike(API_LOG_PATTERN)
    g = [F.regexp_extract(v, API_LOG_PATTERN, i) for i in range(1, 8)]
    return lines.filter(ok).select(
        F.to_timestamp(g[0]).alias("ts"), F.trim(g[1]).alias("model"), F.trim(g[2]).alias("operation"),
        g[3].cast("long").alias("input_tokens"), g[4].cast("long").alias("output_tokens"),
        g[5].cast("double").alias("cost_twd_logged"), g[6].cast("double").alias("seconds"))


def usage_costs(calls: DataFrame, prices: DataFrame, by: str = "model") -> DataFrame:
    """Calls, tokens and cost (USD from price per million tokens, TWD at the fixed
    rate) per model or operation; unknown models cost 0."""
    j = calls.join(F.broadcast(prices), "model", "left")
    usd = (F.col("input_tokens") / 1_000_000 * F.coalesce("price_input", F.lit(0.0))
           + F.col("output_tokens") / 1_000_000 * F.coalesce("price_output", F.lit(0.0)))
    j = j.withColumn("cost_usd", usd)
    return j.groupBy(by).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 8).alias("cost_usd"),
        F.round(F.sum("cost_usd") * USD_TO_TWD_RATE, 8).alias("cost_twd"),
        F.round(F.sum("seconds"), 6).alias("seconds"))


def api_log_lines(events: DataFrame) -> DataFrame:
    """Test adapter: API usage log lines in the source's format, one per event."""
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    ms = F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0")
    model = F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string"))
    tin = (F.col("user_id") * 7 + 10).cast("string")
    tout = F.round(F.col("value") * 10).cast("long").cast("string")
    cost = F.format_number(F.col("value") / 100, 2)
    secs = F.format_number(F.col("value") / 10, 2)
    line = F.concat(F.lit("[API] "), ts, F.lit(","), ms, F.lit(" - api_calls - INFO - 模型="), model,
                    F.lit(" | 操作="), F.col("event_type"), F.lit(" | 輸入="), tin, F.lit("tokens | 輸出="), tout,
                    F.lit("tokens | 成本=NT$"), F.regexp_replace(cost, ",", ""), F.lit(" | 耗時="),
                    F.regexp_replace(secs, ",", ""), F.lit("s"))
    return events.select(F.when(F.col("value") < 5, F.lit("garbage line")).otherwise(line).alias("value"))


def model_prices(spark: SparkSession) -> DataFrame:
    """Price per million tokens of the adapter's models (a bounded config table)."""
    return spark.createDataFrame([("model-0", 0.25, 2.0), ("model-1", 1.25, 10.0)],
                                 "model string, price_input double, price_output double")
