"""Structured Streaming jobs for the source system's row triggers.

Each job has a batch twin (a plain DataFrame function) and a streaming form:

* S1 writes partial results per micro-batch and merges them when read.
* S2, S3 and S6 keep maintained tables (``sources/versions.py``): what is known per key is
  stored, merged per micro-batch and compacted, and nothing is rescanned.
* S5 runs its batch twin on every micro-batch with ``foreachBatch``.
* W12 is a stateful operator keyed by job.
* S4 is stateless.
* S7 and S8 are periodic batch projections.

Sinks write one folder per micro-batch id (``batch_<id>``) with overwrite mode, so a
replayed batch after an executor or driver failure rewrites the same folder: the sink is
idempotent and, with the checkpoint, exactly-once.  Checkpoints and outputs live under
the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.constants import SALE, STATUS_CONFIRMED, STATUS_OPEN
from ledgerflow.functions.misc import fingerprint, fingerprint_of, row_hash
from ledgerflow.operators import lifecycle as lc
from ledgerflow.operators.sales import dedup_product
from ledgerflow.session import sub_checkpoint
from ledgerflow.sources.tables import is_file, read_table, table_path
from ledgerflow.sources.versions import MaintainedTable, VersionedTable, merged


# ------------------------------------------------------------------------- plumbing
def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """Streaming read of a table (a Parquet folder, or one Parquet file of a folder)."""
    schema = read_table(spark, sf_dir, name).schema
    path = table_path(sf_dir, name, spark)
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if path.endswith(".parquet") and is_file(spark, path):
        return r.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return r.parquet(path)


def run_dir(spark: SparkSession, job: str) -> tuple[str, str]:
    """(output folder, checkpoint folder) of a new run under the shared checkpoint dir."""
    base = sub_checkpoint(spark, f"streams/{job}-{uuid.uuid4().hex[:12]}")
    return f"{base}/out", f"{base}/checkpoint"


def batch_writer(out_dir: str, fn=None):
    """foreachBatch sink: ``fn(batch_df, batch_id)`` (default identity) written to
    ``out_dir/batch_<id>`` in overwrite mode (idempotent replays)."""

    def write(df: DataFrame, batch_id: int) -> None:
        res = fn(df, batch_id) if fn else df
        res.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_dir}/batch_{batch_id}")

    return write


def run_available(stream: DataFrame, out_dir: str, ckpt: str, mode: str = "append", fn=None) -> None:
    """Run a streaming query over everything available now, then stop."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(batch_writer(out_dir, fn))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def read_output(spark: SparkSession, out_dir: str, schema: str | None = None) -> DataFrame:
    """All micro-batch folders of a sink (an empty table of ``schema`` when no batch was written)."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/batch_*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if schema is not None and not found:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{out_dir}/batch_*")


def latest_per_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Current value per key of an update-mode log: the row of the highest batch id."""
    others = [c for c in df.columns if c not in key and c != "batch_id"]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), "batch_id").alias("_v")).select(*key, "_v.*")


# ------------------------------------------------------------- S1 fulfil predictions
PREDICTION_KEY = ["customer_id", "product_id", "prediction_date"]


def status_changes(orders: DataFrame) -> DataFrame:
    """Status changes of the incoming-order table: (id, customer_id, product_id, old_status,
    new_status, changed_at).  A settled order was open ('0') before; an open one has no
    earlier status."""
    return orders.select("id", "customer_id", "product_id",
                         F.when(F.col("status") != STATUS_OPEN, F.lit(STATUS_OPEN)).alias("old_status"),
                         F.col("status").alias("new_status"),
                         F.coalesce("confirmed_at", "updated_at", "created_at").alias("changed_at"))


def fulfilments(changes: DataFrame, pred: DataFrame, pm: DataFrame) -> DataFrame:
    """The active predictions that the changes fulfil, each with its earliest
    confirmation (changed_at, order id, ordered product).

    Only a change from '0' to '1' with customer and product counts; it fulfils the
    customer's predictions of any product of the ordered subcategory dated on or before
    the confirmation day.  Confirmations and predictions are first reduced to one row per
    (customer, subcategory, day), so that the window that looks up the next confirmation
    holds calendar days and never the lines of a busy customer."""
    sub = (dedup_product(pm).select("product_id", "subcategory")
           .filter(F.trim(F.coalesce("subcategory", F.lit(""))) != ""))
    conf = changes.filter((F.col("old_status") == STATUS_OPEN) & (F.col("new_status") == STATUS_CONFIRMED)
                          & F.col("customer_id").isNotNull() & F.col("changed_at").isNotNull())
    first = F.struct("changed_at", F.col("id").alias("order_id"), F.col("product_id").alias("order_product_id"))
    conf = conf.join(sub, "product_id").select("customer_id", "subcategory", F.to_date("changed_at").alias("day"),
                                               first.alias("first"))
    active = (pred.filter(F.col("prediction_status") == "active").select(*PREDICTION_KEY).distinct()
              .join(sub, "product_id"))
    asked = active.select("customer_id", "subcategory", F.col("prediction_date").alias("day"),
                          F.lit(None).cast(conf.schema["first"].dataType).alias("first"), F.lit(True).alias("asked"))
    days = (conf.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("customer_id", "subcategory", "day")
            .agg(F.min("first").alias("first"), F.max("asked").alias("asked")))
    later = (Window.partitionBy("customer_id", "subcategory").orderBy("day")
             .rowsBetween(Window.currentRow, Window.unboundedFollowing))
    hits = (days.withColumn("first", F.min("first").over(later)).filter(F.col("asked") & F.col("first").isNotNull())
            .select("customer_id", "subcategory", F.col("day").alias("prediction_date"), "first"))
    return active.join(hits, ["customer_id", "subcategory", "prediction_date"]).select(*PREDICTION_KEY, "first.*")


def merge_fulfilments(parts: DataFrame) -> DataFrame:
    """One row per prediction, the earliest of the confirmations found for it."""
    first = F.min(F.struct("changed_at", "order_id", "order_product_id")).alias("first")
    return parts.groupBy(*PREDICTION_KEY).agg(first).select(*PREDICTION_KEY, "first.*")


def fulfil_result(found: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions with those found set to 'fulfilled', one audit row per confirming
    order that changed any prediction)."""
    hit = found.select(*PREDICTION_KEY, F.lit(True).alias("_hit"))
    status = F.when(F.col("_hit") & (F.col("prediction_status") == "active"), F.lit("fulfilled")).otherwise(
        F.col("prediction_status"))
    updated = pred.join(hit, PREDICTION_KEY, "left").withColumn("prediction_status", status)
    audit = found.groupBy("order_id", "customer_id", F.col("order_product_id").alias("product_id"),
                          F.to_date("changed_at").alias("related_transaction_date")).agg(
        F.count("*").alias("affected_predictions"))
    return updated.select(*pred.columns), audit.select(
        "customer_id", "product_id", F.col("related_transaction_date").alias("prediction_date"),
        F.lit("fulfilled").alias("action_type"), F.lit("active").alias("old_status"),
        F.lit("fulfilled").alias("new_status"), F.col("order_id").alias("related_transaction_id"),
        "related_transaction_date", "affected_predictions")


def fulfil(changes: DataFrame, pred: DataFrame, pm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S1 (batch twin): (updated predictions, audit rows)."""
    return fulfil_result(merge_fulfilments(fulfilments(changes, pred, pm)), pred)


def run_fulfil(spark: SparkSession, changes_stream: DataFrame, pred: DataFrame,
               pm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S1 streaming form.  Each micro-batch writes what it fulfils; a prediction found by
    several batches keeps its earliest confirmation, so the result is that of the batch
    twin however the changes are dealt to micro-batches, and a replay repeats nothing."""
    out, ckpt = run_dir(spark, "fulfil")
    run_available(changes_stream, out, ckpt, fn=lambda df, _: fulfilments(df, pred, pm))
    schema = pred.select(*PREDICTION_KEY).schema.simpleString()[7:-1].replace(":", " ")
    parts = read_output(spark, out, schema + ", changed_at timestamp, order_id long, order_product_id long, batch_id int")
    return fulfil_result(merge_fulfilments(parts), pred)


# --------------------------------------------------- order lines that meet their orders
LINE = "l_orderkey long, product_id long, document_type string, quantity decimal(18,4)"
ORDER = "l_orderkey long, customer_id long, transaction_date date"


def order_line_events(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """Order lines and orders as one stream of rows (``is_line`` tells them apart)."""
    from ledgerflow.constants import RETURN

    li = stream_table(spark, sf_dir, "lineitem", max_files)
    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.lit(1))
    lines = li.select(F.lit(True).alias("is_line"), "l_orderkey", F.col("l_partkey").alias("product_id"),
                      F.when(F.col("l_returnflag") == "R", F.lit(RETURN)).otherwise(F.lit(SALE)).alias("document_type"),
                      (F.col("l_quantity") * sign).cast("decimal(18,4)").alias("quantity"),
                      F.lit(None).cast("long").alias("customer_id"), F.lit(None).cast("date").alias("transaction_date"))
    orders = stream_table(spark, sf_dir, "orders", max_files).select(
        F.lit(False).alias("is_line"), F.col("o_orderkey").alias("l_orderkey"), F.lit(None).cast("long").alias("product_id"),
        F.lit(None).cast("string").alias("document_type"), F.lit(None).cast("decimal(18,4)").alias("quantity"),
        F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("transaction_date"))
    return lines.unionByName(orders)


def run_order_lines(spark: SparkSession, events: DataFrame, base: str, handle, compact: int = 8) -> None:
    """Call ``handle(lines, batch)`` with the order lines whose order is known, once per line.

    Orders are kept as a maintained table of dates; a line that comes before its order
    waits in a stored table until it does.  A replayed batch starts from the tables as they
    were before it."""
    orders = MaintainedTable(spark, f"{base}/orders", ORDER, lambda rows: rows.groupBy("l_orderkey").agg(
        F.max(F.struct("transaction_date", "customer_id")).alias("_o")).select("l_orderkey", "_o.customer_id", "_o.transaction_date"), compact)
    waiting = VersionedTable(spark, f"{base}/waiting")
    columns = ["l_orderkey", "product_id", "document_type", "quantity"]

    def step(df: DataFrame, batch: int) -> None:
        df = df.persist()
        orders.add(df.filter("not is_line").select("l_orderkey", "customer_id", "transaction_date"), batch)
        lines = df.filter("is_line").select(*columns).unionByName(waiting.read(batch - 1, LINE))
        met = lines.join(orders.read(batch).withColumn("_known", F.lit(True)), "l_orderkey", "left").persist()
        waiting.write(met.filter("_known is null").select(*columns), batch)
        waiting.remove(batch - 1)
        handle(met.filter("_known").select("customer_id", "product_id", "transaction_date", "document_type", "quantity"), batch)
        met.unpersist()
        df.unpersist()

    q = (events.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------------------ S2 reactivation
def run_reactivation(spark: SparkSession, events: DataFrame, inactive: DataFrame, as_of: str, compact: int = 8) -> tuple[DataFrame, DataFrame]:
    """(customer_id, reactivated_date) of the lapsed customers that ordered after their
    last order date, and (customer_id, last_order_date) of every customer who ordered.

    The lapsed customers with their last order date are stored once; each micro-batch adds
    the first date it finds per customer, and the earliest one counts."""
    base = run_dir(spark, "reactivate")[0]
    stored = VersionedTable(spark, f"{base}/inactive")
    stored.write(inactive.select("customer_id", "last_order_date"), 0)
    found = MaintainedTable(spark, f"{base}/found", "customer_id long, reactivated_date date", merged(["customer_id"], reactivated_date=F.min), compact)
    last = MaintainedTable(spark, f"{base}/last", "customer_id long, last_order_date date", merged(["customer_id"], last_order_date=F.max), compact)

    def handle(lines: DataFrame, batch: int) -> None:
        sold = lines.filter(F.col("document_type") == SALE)
        last.add(sold.groupBy("customer_id").agg(F.max("transaction_date").alias("last_order_date")), batch)
        lapsed = stored.read().withColumn("reactivated_date", F.lit(None).cast("date"))
        hit = lc.reactivated(lapsed, lines, as_of).filter(F.col("reactivated_date").isNotNull())
        found.add(hit.select("customer_id", "reactivated_date"), batch)

    run_order_lines(spark, events, base, handle, compact)
    return found.read(), last.read()


# -------------------------------------------------------------- S3 running month sales
def month_totals(tx: DataFrame) -> DataFrame:
    """S3: quantity per (month, product) of one set of order lines."""
    return (tx.filter(F.col("document_type") == SALE)
            .groupBy(F.to_date(F.trunc("transaction_date", "month")).alias("month"), "product_id")
            .agg(F.sum("quantity").alias("month_quantity")))


def run_month_sales(spark: SparkSession, sf_dir: str, max_files: int | None = None, compact: int = 8) -> DataFrame:
    """Run S3 over everything available and return the totals.

    Each micro-batch adds its totals to a maintained table, which sums them per month and
    product, however late a line or its order arrives and however the files are dealt to
    batches."""
    base = run_dir(spark, "month_sales")[0]
    totals = MaintainedTable(spark, f"{base}/totals", "month date, product_id long, month_quantity decimal(28,4)",
                             lambda rows: rows.groupBy("month", "product_id").agg(F.sum("month_quantity").cast("decimal(28,4)").alias("month_quantity")), compact)
    run_order_lines(spark, order_line_events(spark, sf_dir, max_files), base, lambda lines, batch: totals.add(month_totals(lines), batch), compact)
    return totals.read()


# ----------------------------------------------------------------- S4 stock on write
def stock_on_write(inv_stream: DataFrame) -> DataFrame:
    """stock = total − borrowed out + borrowed in on every written row (stateless)."""
    return inv_stream.withColumn("stock_quantity", F.col("total_quantity") - F.col("borrowed_out")
                                 + F.col("borrowed_in"))


# ------------------------------------------------------------ S5 delivery scheduling
def delivery_stream(orders_stream: DataFrame, customers: DataFrame, pm: DataFrame) -> DataFrame:
    """Confirmed orders → delivery rows (stream-static joins)."""
    return lc.schedule_delivery(lc.order_products(orders_stream, pm), customers)


def prediction_delivery_stream(pred_stream: DataFrame, customers: DataFrame) -> DataFrame:
    """Positive purchase predictions → delivery rows (stream-static join)."""
    return lc.prediction_deliveries(pred_stream, customers)


# ---------------------------------------------------------------- S6 change detector
def change_summary(df: DataFrame, ts_col: str, cols: list[str], window: str = "1 day") -> DataFrame:
    """S6 (batch twin): per time window: rows changed, last change time and a fingerprint
    of the changed rows (X16)."""
    w = df.withColumn("window_start", F.window(ts_col, window).start)
    agg = w.groupBy("window_start").agg(F.count("*").alias("changed_rows"), F.max(ts_col).alias("last_change"))
    fp = fingerprint(w, cols, ["window_start"]).select("window_start", "fingerprint")
    return agg.join(fp, "window_start")


def changed_since(summary: DataFrame, last: DataFrame) -> DataFrame:
    """Windows whose fingerprint differs from the last one seen (or are new)."""
    prev = last.select("window_start", F.col("fingerprint").alias("_prev"))
    j = summary.join(prev, "window_start", "left")
    return j.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("fingerprint"))).drop("_prev")


STATE = "window_start timestamp, changed_rows long, last_change timestamp, fingerprint string, seq long"


def _newest(key: str) -> callable:
    """Merge: the row of the highest ``seq`` per key."""
    return lambda rows: rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "seq").alias("_v")).select(key, "_v.*")


class ChangeDetector:
    """Windows whose rows changed, by an order-free fingerprint kept per window.

    The detector stores the last version of every row (key, time, window, hash) and the last
    fingerprint it told per window.  A micro-batch replaces the rows that are new or differ
    (an older version of a row never replaces a newer one), sums the hashes of the windows
    they touch anew and tells a window only if its fingerprint differs.  A file that comes
    again changes nothing."""

    def __init__(self, spark: SparkSession, base: str, key: str, ts_col: str, cols: list[str], window: str = "1 day", compact: int = 8):
        self.key, self.ts, self.cols, self.window, self.out = key, ts_col, cols, window, f"{base}/events"
        # of two versions of a row the later one counts, on equal times the one that came later
        order = F.struct("ts", "seq", "hash")
        self.rows = MaintainedTable(spark, f"{base}/rows", f"{key} long, window_start timestamp, ts timestamp, hash decimal(38,0), seq long",
                                    lambda r: r.groupBy(key).agg(F.max_by(F.struct("window_start", "ts", "hash", "seq"), order).alias("_v")).select(key, "_v.*"), compact)
        self.state = MaintainedTable(spark, f"{base}/state", STATE, _newest("window_start"), compact)

    def step(self, df: DataFrame, batch: int) -> None:
        seq = F.lit(batch).cast("long").alias("seq")
        fresh = df.select(F.col(self.key).cast("long").alias(self.key), F.window(self.ts, self.window).start.alias("window_start"),
                          F.col(self.ts).alias("ts"), row_hash(self.cols).alias("hash"), seq)
        fresh = self.rows.merge(fresh)
        known = self.rows.read(batch - 1).select(self.key, F.col("window_start").alias("_w"), F.col("ts").alias("_ts"), F.col("hash").alias("_hash"))
        differ = F.col("_hash").isNull() | ((F.col("hash") != F.col("_hash")) & (F.col("ts") >= F.col("_ts")))
        changed = fresh.join(known, self.key, "left").filter(differ).persist()
        touched = changed.select("window_start").union(changed.select("_w")).filter("window_start is not null").distinct()
        self.rows.add(changed.select(self.key, "window_start", "ts", "hash", "seq"), batch)
        now = (self.rows.read(batch).join(touched, "window_start", "left_semi").groupBy("window_start")
               .agg(F.count("*").alias("changed_rows"), F.max("ts").alias("last_change"), F.sum("hash").alias("_sum")))
        now = touched.join(now, "window_start", "left").select(
            "window_start", F.coalesce("changed_rows", F.lit(0)).alias("changed_rows"), "last_change",
            F.when(F.col("changed_rows").isNotNull(), fingerprint_of(F.col("_sum"), F.col("changed_rows"))).alias("fingerprint"), seq)
        told = self.state.read(batch - 1).select("window_start", F.col("fingerprint").alias("_told"), F.lit(True).alias("_known"))
        tell = now.join(told, "window_start", "left").filter("_known is null or not (fingerprint <=> _told)").drop("_told", "_known").persist()
        self.state.add(tell, batch)
        tell.write.mode("overwrite").parquet(f"{self.out}/batch_{batch}")
        tell.unpersist()
        changed.unpersist()

    def run(self, updates: DataFrame, ckpt: str) -> None:
        updates.writeStream.foreachBatch(self.step).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()

    def windows(self) -> DataFrame:
        """The windows as last told."""
        return self.state.read().filter("changed_rows > 0").drop("seq")


def run_changes(spark: SparkSession, updates_stream: DataFrame, key: str, ts_col: str, cols: list[str], window: str = "1 day",
                compact: int = 8) -> DataFrame:
    """S6 streaming form: rows, last change and fingerprint per window, as last told."""
    out, ckpt = run_dir(spark, "changes")
    detector = ChangeDetector(spark, out, key, ts_col, cols, window, compact)
    detector.run(updates_stream, ckpt)
    return detector.windows()


# -------------------------------------------------------------- W12 alerts over time
def run_alerts(spark: SparkSession, checks: DataFrame, history: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """W12 streaming form: the alerts sent for a stream of health checks (job_id, ts, status).

    State is keyed by job: the alerts sent and the checks the watermark has not passed yet.
    Checks are decided in the order of their times once the watermark has passed them, so
    the result does not depend on how they are dealt to micro-batches."""
    from ledgerflow.operators import monitor as mo
    from ledgerflow.session import ship_package

    ship_package(spark)
    out, ckpt = run_dir(spark, "alerts")
    known = VersionedTable(spark, f"{out}-history")
    known.write(mo.alert_history(history), 0)
    us = [F.coalesce(F.unix_micros(c), F.lit(-1)).alias(c) for c in ("last", "warned")]
    past = known.read().select("job_id", F.col("n"), *us)
    stream = checks.withWatermark("ts", delay).select("job_id", "ts", F.unix_micros("ts").alias("us"), "status")
    stream = stream.join(past, "job_id", "left").fillna(0, ["n"]).fillna(-1, ["last", "warned"])
    sent = stream.groupBy("job_id").applyInPandasWithState(mo.alert_state, mo.ALERT_OUT, mo.ALERT_STATE, "append", "EventTimeTimeout")
    run_available(sent, out, ckpt)
    found = read_output(spark, out, mo.ALERT_OUT + ", batch_id int")
    return found.select("job_id", F.timestamp_micros("us").alias("ts"), "status")


# ----------------------------------------------------------------- S7 / S8 periodic
def expire(pred: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Active predictions whose day is more than ``days`` before ``as_of`` expire."""
    old = (F.col("prediction_status") == "active") & (
        F.col("prediction_date") < F.date_sub(F.lit(as_of).cast("date"), days))
    return pred.withColumn("prediction_status", F.when(old, F.lit("expired")).otherwise(F.col("prediction_status")))


def rollover(change: DataFrame, pm: DataFrame, as_of: str) -> DataFrame:
    """On the first of a month: current → last, current = 0, change 0; every active
    product has a row (missing ones inserted with zeros)."""
    import datetime as _dt

    if _dt.date.fromisoformat(as_of[:10]).day != 1:
        return change
    z = F.lit(0).cast("decimal(28,4)")
    rolled = change.select("product_id", F.col("current_month_sales").alias("last_month_sales"),
                           z.alias("current_month_sales"), z.alias("change_amount"),
                           F.lit(0.0).alias("change_percentage"), "stock_quantity")
    active = pm.filter(F.col("is_active") == "active").select("product_id").distinct()
    add = active.join(rolled.select("product_id"), "product_id", "left_anti").select(
        "product_id", z.alias("last_month_sales"), z.alias("current_month_sales"), z.alias("change_amount"),
        F.lit(0.0).alias("change_percentage"), F.lit(0).cast("decimal(28,4)").alias("stock_quantity"))
    return rolled.unionByName(add)
