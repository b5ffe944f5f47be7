"""File sources and streaming forms against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import lifecycle as lc
from ledgerflow.operators import monitor as mo
from ledgerflow.operators import prospects as pr
from ledgerflow.sources.versions import MaintainedTable, VersionedTable, merged
from ledgerflow.sources.views import Views
from ledgerflow.streaming import jobs as sj

SF = "/root/testdata/sf0.001"


def test_read_chat_csv_files(spark, tmp_path):
    d = tmp_path / "chats"
    d.mkdir()
    (d / "1_20240101_20240131_North_Shop A(42).csv").write_text(
        "sender type,sender name,date,time,content\n"
        "User,Ann,2024-01-02,10:00,\"Do you have rice, 5kg?\"\n"
        "Account,Shop,2024-01-02,10:01,Yes we do\n"
        "user,Ann,2024-01-02,10:02,x\n"
        "User,Ann,2024-01-03\n"
        "User,Ann,2024-01-04,10:00,\"first line\nsecond line\"\n"
        "User,Ann,2024-01-04,10:01,after\n", encoding="utf-8")
    (d / "2_Bob.csv").write_text("h1,h2,h3,h4,h5\nUser,Bob,2024-01-05,09:00,need noodles\n", encoding="utf-8")
    msgs = pr.user_messages(pr.with_file_key(pr.read_chats_csv(spark, str(d))))
    got = sorted((r["file_customer_name"], r["file_customer_id"], r["row_no"], r["content"]) for r in msgs.collect())
    assert got == [("Bob", None, 2, "need noodles"), ("Shop A", "42", 2, "Do you have rice, 5kg?"),
                   ("Shop A", "42", 6, "first line\nsecond line"), ("Shop A", "42", 7, "after")]


def test_month_sales_stream_equals_batch(spark):
    streamed = sj.run_month_sales(spark, SF)
    v = Views(spark, SF)
    t = v.order_tx().filter(F.col("document_type") == "銷貨")
    batch = t.groupBy(F.trunc("transaction_date", "month").alias("month"), "product_id").agg(
        F.sum("quantity").alias("month_quantity"))
    a = sorted(tuple(r) for r in streamed.select("month", "product_id", "month_quantity").collect())
    b = sorted(tuple(r) for r in batch.collect())
    assert a == b and len(a) > 0


def test_delivery_stream_equals_batch(spark):
    v = Views(spark, SF)
    out, ckpt = sj.run_dir(spark, "test-delivery")
    sj.run_available(sj.delivery_stream(v.incoming_from(sj.stream_table(spark, SF, "orders")), v.customers,
                                        v.product_master), out, ckpt)
    streamed = sj.read_output(spark, out).drop("batch_id")
    batch = lc.schedule_delivery(lc.order_products(v.incoming_orders, v.product_master), v.customers)
    cols = ["delivery_id", "delivery_date", "status"]
    assert sorted(tuple(r) for r in streamed.select(*cols).collect()) == sorted(tuple(r) for r in batch.select(*cols).collect())


def test_next_scheduled_day(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5), "1,3,5"), (dt.date(2024, 1, 5), "7"), (dt.date(2024, 1, 5), None)],
                               "d date, s string")     # 2024-01-05 is a Friday
    got = [r[0] for r in df.select(lc.next_scheduled_day(F.col("d"), F.col("s"))).collect()]
    assert got == [dt.date(2024, 1, 8), dt.date(2024, 1, 7), None]


@pytest.fixture(scope="module")
def six_files(spark, tmp_path_factory):
    """lineitem and orders in six files each, in an order of their own."""
    path = tmp_path_factory.mktemp("six")
    for name in ("lineitem", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").orderBy(F.rand(3)).repartition(6).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def same(got, want):
    assert got.count() == want.count() > 0 and got.select(want.columns).exceptAll(want).count() == 0


def test_streams_over_several_batches(spark, six_files):
    """S1, S3 and S6 with one file per micro-batch equal their batch forms; lines meet orders that come later."""
    same(sj.run_month_sales(spark, six_files, max_files=1, compact=2), sj.month_totals(Views(spark, SF).order_tx())
         .withColumn("month_quantity", F.col("month_quantity").cast("decimal(28,4)")))
    v = Views(spark, SF)
    stream = v.incoming_from(sj.stream_table(spark, six_files, "orders", 1))
    cols = ["id", "updated_at", "status"]
    same(sj.run_changes(spark, stream, "id", "updated_at", cols, compact=2), sj.change_summary(v.incoming_orders, "updated_at", cols))
    from ledgerflow.plans.q_streaming import _pred
    pred = _pred(v)
    streamed = sj.run_fulfil(spark, sj.status_changes(stream), pred, v.product_master)
    batch = sj.fulfil(sj.status_changes(v.incoming_orders), pred, v.product_master)
    for got, want in zip(streamed, batch):
        same(got, want)


def test_reactivation_over_several_batches(spark, six_files):
    v = Views(spark, SF)
    lapsed = lc.inactive_customers(v.order_tx(), v.customers, "2001-01-01", 60).select("customer_id", "last_order_date")
    found, last = sj.run_reactivation(spark, sj.order_line_events(spark, six_files, 1), lapsed, "2001-08-01", compact=2)
    want = lc.reactivated(lapsed.withColumn("reactivated_date", F.lit(None).cast("date")), v.order_tx(), "2001-08-01")
    same(found, want.filter("reactivated_date is not null").select("customer_id", "reactivated_date"))
    sold = v.order_tx().filter(F.col("document_type") == "銷貨")
    same(last, sold.groupBy("customer_id").agg(F.max("transaction_date").alias("last_order_date")))


def test_change_stream_tells_only_what_differs(spark, tmp_path):
    """A snapshot, then everything, then the same file again: the second batch tells the windows that
    differ from the snapshot, the third none."""
    v = Views(spark, SF)
    cols = ["id", "updated_at", "status"]
    o = v.incoming_orders.select(*cols, "created_at")
    o.filter("created_at < '1998-01-01'").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    detector = sj.ChangeDetector(spark, f"{tmp_path}/state", "id", "updated_at", cols, compact=2)

    def feed():
        detector.run(spark.readStream.schema(o.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), f"{tmp_path}/ckpt")

    feed()
    o.coalesce(1).write.parquet(f"{tmp_path}/in/2")
    feed()
    told = sj.read_output(spark, f"{tmp_path}/state/events").filter("seq = 1")
    before = sj.change_summary(o.filter("created_at < '1998-01-01'"), "updated_at", cols)
    same(told, sj.changed_since(sj.change_summary(o, "updated_at", cols), before))
    o.coalesce(1).write.parquet(f"{tmp_path}/in/3")
    feed()
    assert sj.read_output(spark, f"{tmp_path}/state/events").filter("seq = 2").count() == 0
    # a row that moves to another day changes both days, also the one it leaves empty
    row = o.orderBy(F.desc("updated_at"), "id").limit(1)
    row.withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 400 DAYS")).coalesce(1).write.parquet(f"{tmp_path}/in/4")
    feed()
    assert sj.read_output(spark, f"{tmp_path}/state/events").filter("seq = 3").count() == 2
    detector.step(o, 3)      # a replay of a batch that is stored tells nothing new
    assert detector.windows().count() == detector.state.read().filter("changed_rows > 0").count()


def test_maintained_table_stays_small(spark, tmp_path):
    t = MaintainedTable(spark, f"{tmp_path}/t", "k long, n long", merged(["k"], n=F.sum), compact=3)
    for batch in range(20):
        t.add(spark.createDataFrame([(batch % 4, 1), (0, 10)], "k long, n long"), batch)
        t.add(spark.createDataFrame([(99, 1)], "k long, n long"), batch)          # a replay
        assert len(t.parts.versions()) <= 6 and len(t.base.versions()) <= 2
    assert sorted(map(tuple, t.read().collect())) == [(0, 205), (1, 5), (2, 5), (3, 5)]
    assert sorted(map(tuple, t.read(18).collect())) == [(0, 195), (1, 5), (2, 5), (3, 4)]


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    assert t.read(schema="a int").count() == 0 and t.current() is None
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "a int")
    assert t.write(rows(1), 0) and not t.write(rows(2), 0)
    rows(9).write.parquet(t.folder(7))                      # a writer that died before the mark
    assert [r.a for r in t.read().collect()] == [1]
    assert t.change(lambda d: d.union(rows(3)), 7) and not t.change(lambda d: d.union(rows(4)), 7) and not t.change(lambda d: d, 5)
    assert sorted(r.a for r in t.read().collect()) == [1, 3] and [r.a for r in t.read(6).collect()] == [1]


def fold(checks, history):
    """W12 by hand: one check after the other."""
    sent, out = {}, []
    for job, ts, status in history:
        sent.setdefault(job, []).append((ts, status))
    for job, ts, status in sorted(set(checks), key=lambda c: (c[1], c[2], c[0])):
        mine = sent.setdefault(job, [])
        if status not in ("critical", "warning") or len(mine) >= 5 or any(ts - a < dt.timedelta(hours=4) for a, _ in mine):
            continue
        if status == "critical" or any(s == "warning" and ts - a > dt.timedelta(hours=2) for a, s in mine):
            mine.append((ts, status))
            out.append((job, ts, status))
    return sorted(out)


def test_alerts_over_time(spark, tmp_path):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    checks = [(f"j{rng.randrange(5)}", start + dt.timedelta(minutes=rng.randrange(4000)), rng.choice(["warning"] * 3 + ["critical", "healthy"])) for _ in range(400)]
    checks += [("quiet", start, "healthy"), ("j0", start, "critical"), ("j0", start, "critical"), ("j0", start, "warning")]
    history = [("j1", start - dt.timedelta(hours=3), "warning"), ("j2", start - dt.timedelta(days=9), "critical")] + [("j3", start, "critical")] * 5
    schema = "job_id string, ts timestamp, status string"
    df, past = spark.createDataFrame(checks, schema), spark.createDataFrame(history, schema)
    want = fold(checks, history)
    assert sorted(map(tuple, mo.alerts_over_time(df, past).collect())) == want
    # as a stream: four files in any order, a delay that covers them, and a last healthy check that closes it
    df.repartition(4).write.parquet(f"{tmp_path}/checks")
    end = spark.createDataFrame([("end", start + dt.timedelta(days=60), "healthy")], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/checks")
    end.write.mode("append").parquet(f"{tmp_path}/checks")
    got = sj.run_alerts(spark, stream, past, "10 days")
    assert sorted(map(tuple, got.collect())) == want


def test_core_name_deletes_marks(spark):
    from ledgerflow.functions.text import core_name
    rows = spark.createDataFrame([("A-B(x)",), ("[k] a_b/c",)], "n string").select(core_name("n").alias("c")).collect()
    assert [r["c"] for r in rows] == ["AB", "[k] abc"]


def test_tables_in_a_store_that_only_spark_opens(spark):
    """A mount of the test folder under another scheme: tables and streams are found through Spark."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.teststore.link./in", f"file://{SF}")
    assert Views(spark, "viewfs://teststore/in").order_tx().count() == Views(spark, SF).order_tx().count() > 0
    got = sj.run_month_sales(spark, "viewfs://teststore/in")
    assert got.count() == sj.month_totals(Views(spark, SF).order_tx()).count()


def test_predictions_are_counted_apart_from_the_join(spark, tmp_path):
    """The table of pairs lies in tasks of its own, after the lines have moved."""
    from ledgerflow.plans.q_streaming import _pred
    from ledgerflow.sources.views import Views

    day = dt.datetime(2001, 1, 2)
    spark.createDataFrame([(1, 7, day), (2, 7, day + dt.timedelta(days=3)), (3, 8, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(
        str(tmp_path / "orders.parquet"))
    lines = [(1, 5, 1, 1, 4.0, 8.0, 0.0, "N"), (2, 5, 1, 1, 12.0, 8.0, 0.0, "N"), (2, 5, 1, 2, 50.0, 8.0, 0.0, "R"), (3, 5, 1, 1, 1.0, 8.0, 0.0, "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    pred = _pred(Views(spark, str(tmp_path)))
    got = sorted((r.customer_id, r.product_id, str(r.prediction_date), float(r.estimated_quantity), r.will_purchase_anything) for r in pred.collect())
    assert got == [(7, 5, "2001-02-04", 12.0, True), (8, 5, "2001-02-01", 1.0, False)]
    plan = pred._jdf.queryExecution().sparkPlan().toString().splitlines()
    last_count = max(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert last_count < min(i for i, line in enumerate(plan) if "Exchange" in line) < min(i for i, line in enumerate(plan) if "Join" in line)
