"""Edge rules on tiny hand-made frames (zero gate, sentinels, branch limits, tie-breaks,
fallbacks, sheet parsing, join counts, fulfilment)."""

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerflow.constants import SALE, VOL_HIGH, VOL_LOW, VOL_MEDIUM
from ledgerflow.operators import catalog as cat
from ledgerflow.operators import forecast as fc
from ledgerflow.operators import recommend as rc
from ledgerflow.operators import replenish as rp
from ledgerflow.sources import ingest as ig
from ledgerflow.streaming import jobs as sj

D = dt.date


def _tx(spark, rows):
    """rows: (customer, product, date, quantity)."""
    data = [(f"t{i}", c, p, d, SALE, Decimal(q), Decimal(q)) for i, (c, p, d, q) in enumerate(rows)]
    return spark.createDataFrame(data, "transaction_id string, customer_id long, product_id long, transaction_date date, "
                                       "document_type string, quantity decimal(18,4), amount decimal(18,4)")


def _pm(spark, rows):
    """rows: (product, subcategory, category)."""
    data = [(p, 0, f"name{p}", c, s, "10", "proc", "active") for p, s, c in rows]
    return spark.createDataFrame(data, "product_id long, warehouse_id long, name_zh string, category string, "
                                       "subcategory string, specification string, process_type string, is_active string")


# --------------------------------------------------------------------------- forecast
def test_zero_gate_when_last_two_months_are_zero(spark):
    pm = _pm(spark, [(1, "S/a", "S")])
    rows = [(1, 1, D(2001, m, 5), q) for m, q in ((2, 10), (3, 12), (4, 11), (5, 9))]
    out = fc.forecast_subcategory(_tx(spark, rows), pm, "2001-08-01").collect()
    assert len(out) == 1 and out[0]["prediction"] == 0.0
    assert out[0]["month_minus_2"] == 0 and out[0]["month_minus_1"] == 0


def test_branch_limits_of_the_three_methods(spark):
    rows = [(n, 10.0, 9.0, 11.0, 12.0, 1.0, 5.0) for n in (0, 1, 2, 3, 4, 6)]
    st = spark.createDataFrame(rows, "n long, mean double, median double, ewma double, recent3 double, "
                                     "slope double, intercept double")
    got = {r["n"]: r for r in st.select("n", fc.fc_high(st).alias("h"), fc.fc_medium(st).alias("m"),
                                        fc.fc_low(st).alias("l")).collect()}
    assert got[0]["h"] == 0.0 and got[1]["h"] == 8.0 and got[2]["h"] == 10.0 and got[3]["h"] == 10.0
    assert got[4]["h"] == 9.0
    assert got[0]["m"] == 0.0 and got[2]["m"] == 10.0 and got[3]["m"] == (11.0 + 9.0) / 2
    assert got[4]["m"] == sorted([11.0, 12.0 * 1.05, 9.0])[1]
    assert got[4]["l"] == 10.0 and got[6]["l"] == 15.0   # trend 5 + 18 = 23 clipped to 1.5 × mean


def test_ewma_matches_pandas(spark):
    ys = [5.0, 0.0, 7.0, 3.0, 0.0, 9.0, 4.0]
    months = [D(2000, 2 + i, 1) for i in range(len(ys))]
    hist = spark.createDataFrame([("s", m, Decimal(y), i) for i, (m, y) in enumerate(zip(months, ys))],
                                 "subcategory string, month date, y decimal(28,4), month_index int")
    got = fc.forecast_stats(hist).collect()[0]
    clean = pd.Series([y for y in ys if y > 0])
    assert math.isclose(got["ewma"], clean.ewm(alpha=0.3, adjust=False).mean().iloc[-1], rel_tol=1e-12)
    assert math.isclose(got["median"], clean.median())
    assert math.isclose(got["recent3"], clean.tail(3).mean())


def test_ape_zero_and_sentinel(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 0.0), (5.0, 4.0)], "prediction double, actual double")
    got = [r[0] for r in df.select(fc.ape(F.col("prediction"), F.col("actual"))).collect()]
    assert got == [0.0, 999.0, 0.25]


# ----------------------------------------------------------------- cycle features
def _daily(spark, days, pair=(1, "p")):
    base = D(2024, 1, 1)
    data = [(pair[0], pair[1], base + dt.timedelta(days=d), Decimal(q), Decimal(q)) for d, q in days]
    return spark.createDataFrame(data, "customer_id long, product_id string, transaction_date date, "
                                       "quantity decimal(28,4), amount decimal(28,4)")


def test_cycle_defaults_and_single_gap(spark):
    pairs = spark.createDataFrame([(1, "p")], "customer_id long, product_id string")
    # one purchase day: n=1 → deviation 999, regularity 0
    one = rp.cycle_features(_daily(spark, [(0, 2)]), pairs, "2024-01-10", ["2024-01-10"]).collect()[0]
    assert one["cp_total_purchases"] == 1 and one["expected_purchase_deviation"] == 999
    assert one["regularity_score"] == 0.0 and one["recent_vs_overall_ratio"] == 1.0
    # two purchase days: one gap → std 0, regularity 1, stability 1
    two = rp.cycle_features(_daily(spark, [(0, 2), (4, 3)]), pairs, "2024-01-10", ["2024-01-10"]).collect()[0]
    assert two["interval_std"] == 0.0 and two["regularity_score"] == 1.0 and two["interval_stability"] == 1.0
    assert two["avg_interval"] == 4.0 and two["cp_quantity_trend"] == 1.0
    # no history at all → defaults with the target's weekday
    none = rp.cycle_features(_daily(spark, [(20, 1)]), pairs, "2024-01-10", ["2024-01-10"]).collect()[0]
    assert none["days_since_last"] == 999 and none["preferred_weekday"] == D(2024, 1, 10).weekday()


def test_deviation_floors_before_abs(spark):
    pairs = spark.createDataFrame([(1, "p")], "customer_id long, product_id string")
    # days 0, 2, 5 → gaps 2, 3 → avg 2.5; last = day 5; target day 6 → 1 − 2.5 = −1.5 → floor −2 → 2
    f = rp.cycle_features(_daily(spark, [(0, 1), (2, 1), (5, 1)]), pairs, "2024-01-07", ["2024-01-07"]).collect()[0]
    assert f["avg_interval"] == 2.5 and f["expected_purchase_deviation"] == 2 and f["is_expected_date"] == 0
    assert f["recent_interval_trend"] == 1.0 and f["recent_avg_interval"] == 2.5


def test_four_purchases_acceleration(spark):
    pairs = spark.createDataFrame([(1, "p")], "customer_id long, product_id string")
    # days 0, 4, 6, 7 → gaps 4, 2, 1: recent = mean(4,2,1), early = mean(first 1 gap) = 4
    f = rp.cycle_features(_daily(spark, [(0, 1), (4, 1), (6, 1), (7, 1)]), pairs, "2024-01-09",
                          ["2024-01-09"]).collect()[0]
    assert math.isclose(f["purchase_acceleration"], round((4 - 7 / 3) / 4, 6))


# ------------------------------------------------------------------- recommendation
def test_price_fallbacks(spark):
    df = spark.createDataFrame([(10.0, 10.0, None), (10.0, 12.0, None), (None, 3.0, 2.0), (10.0, 12.0, 2.0)],
                               "a double, b double, sd double")
    got = [r[0] for r in df.select(rc._gauss(F.col("a"), F.col("b"), F.col("sd"))).collect()]
    assert got[0] == 1.0 and got[1] == 0.5 and got[2] == 0.5
    assert math.isclose(got[3], math.exp(-0.5))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 50, 400).astype(float), np.full(300, 17.0)])   # a hot value
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = rc.exact_quantiles(df, "x", [0.05, 0.5, 0.95]).collect()[0]
    for i, q in enumerate((0.05, 0.5, 0.95)):
        assert math.isclose(got[f"q{i}"], float(np.quantile(vals, q)), rel_tol=1e-12)


def test_top_k_tie_broken_by_id(spark):
    df = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 5, 0.7)], "customer_id long, product_id long, s double")
    got = cat.top_k_per(df, ["customer_id"], [F.col("s").desc(), F.col("product_id").asc()], 2).orderBy("rank").collect()
    assert [r["product_id"] for r in got] == [5, 3]


# ------------------------------------------------------------------------ ingest
def test_sheet_fill_and_stock_parse(spark):
    cols = "file string, row_no long, A string, F string, K string, N string, Q string, S string, V string, Y string, Z string"
    raw = spark.createDataFrame([
        ("f", 3, "junk", "", "", "", "", "", "", "", ""),
        ("f", 8, "C1", "P1", "n1", "2024-01-02", SALE, "2", "1,234.5", "TWD", "2,469"),
        ("f", 9, "", "", "", "2024/01/03", SALE, "3", "", "", ""),
        ("f", 10, " ", "P2", "n2", "", SALE, "1", "5", "", "5"),
        ("f", 11, "", "", "", "2024-01-04", SALE, "---", "5", "", "5"),
        ("f", 12, "C2", "P3", "n3", "2024-01-05", SALE, "4", "", "", "")], cols)
    out = {r["row_no"]: r for r in ig.clean_sales(raw, block_rows=2).collect()}
    assert sorted(out) == [8, 9, 12]                     # no date (10) / no quantity (11) dropped, junk row 3 skipped
    assert out[9]["customer_id"] == "C1" and out[9]["product_id"] == "P1" and out[9]["currency"] == "TWD"
    assert out[8]["unit_price"] == Decimal("1234.5000") and out[9]["unit_price"] == 0 and out[12]["amount"] == 0
    scols = "file string, row_no long, A string, D string, H string, J string, M string, O string, R string, T string, W string"
    st = spark.createDataFrame([
        ("s", 8, "1", "a", "c", "0", "1,234", "---", "", "1,234", "box"),
        ("s", 9, "2", "b", "c", "0", "abc", "1", "1", "1", "box"),
        ("s", 10, "", "c", "c", "0", "5", "1", "1", "5", "box")], scols)
    got = ig.clean_stock(st).collect()
    assert len(got) == 1 and got[0]["total_quantity"] == Decimal("1234") and got[0]["borrowed_out"] == 0


def test_forward_fill_crosses_blocks(spark):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(["a", None, None, "", None, "b", None])],
                               "file string, row_no long, x string")
    got = [r["x"] for r in ig.forward_fill(df, "file", "row_no", ["x"], block_rows=2).orderBy("row_no").collect()]
    assert got == ["a", "a", "a", "a", "a", "b", "b"]


def test_split_known_counts_add_up(spark):
    recs = spark.createDataFrame([(1, 10), (2, 10), (1, 99), (3, 11)], "customer_id long, product_id long")
    customers = spark.createDataFrame([(1,), (2,)], "customer_id long")
    pm = _pm(spark, [(10, "S/a", "S"), (11, "S/b", "S")])
    c = cat.split_counts(cat.split_known(recs, customers, pm)).collect()[0]
    assert c["valid_rows"] + c["skipped_rows"] == c["input_rows"] == 4
    assert c["valid_rows"] == 2 and c["unknown_customer_rows"] == 1 and c["unknown_product_rows"] == 1


# ------------------------------------------------------------------------ streaming twin
def test_fulfil_rules(spark):
    pm = _pm(spark, [(1, "S/a", "S"), (2, "S/a", "S"), (3, "S/b", "S")])
    pred = spark.createDataFrame([(7, 1, D(2024, 1, 10), "active"), (7, 3, D(2024, 1, 10), "active"),
                                  (8, 1, D(2024, 1, 10), "active"), (9, 1, D(2024, 1, 10), "expired")],
                                 "customer_id long, product_id long, prediction_date date, prediction_status string")
    ts = dt.datetime
    changes = spark.createDataFrame([
        (99, 7, 3, "1", "1", ts(2024, 1, 11, 9)),        # not a change from open to confirmed → no
        (100, 7, 2, "0", "1", ts(2024, 1, 10, 9)),       # sibling of product 1, on the day → fulfils (7,1) only
        (103, 7, 1, "0", "1", ts(2024, 1, 11, 9)),       # later: nothing left to fulfil, no audit row
        (101, 8, 1, "0", "1", ts(2024, 1, 9, 9)),        # before the prediction day → no
        (102, 9, 1, "0", "1", ts(2024, 1, 12, 9))],      # prediction not active → no
        "id long, customer_id long, product_id long, old_status string, new_status string, changed_at timestamp")
    upd, audit = sj.fulfil(changes, pred, pm)
    got = [(r["customer_id"], r["product_id"], r["related_transaction_id"], r["affected_predictions"]) for r in audit.collect()]
    assert got == [(7, 2, 100, 1)]
    st = {(r["customer_id"], r["product_id"]): r["prediction_status"] for r in upd.collect()}
    assert st[(7, 1)] == "fulfilled" and st[(7, 3)] == "active" and st[(8, 1)] == "active" and st[(9, 1)] == "expired"


def test_chat_file_names(spark):
    from ledgerflow.functions.text import chat_file_key
    names = ["1_a_b_North_Shop X(123).csv", "2_a_b_Shop Y.csv", "3_Shop Z.csv", "4_a_b_c_Shop(Unknown).csv", "solo.csv"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    n, c = chat_file_key(F.col("f"))
    got = [(r[0], r[1]) for r in df.select(n, c).collect()]
    assert got == [("Shop X", "123"), ("Shop Y", None), ("Shop Z", None), ("Shop", None), ("Unknown", None)]


def test_fingerprint_is_order_free(spark):
    from ledgerflow.functions.misc import fingerprint
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id long, s string").repartition(2)
    c = spark.createDataFrame([(2, "y"), (1, "z")], "id long, s string")
    fa, fb, fcc = (fingerprint(d, ["id", "s"]).collect()[0]["fingerprint"] for d in (a, b, c))
    assert fa == fb != fcc


@pytest.mark.parametrize("label", [VOL_LOW, VOL_MEDIUM, VOL_HIGH])
def test_method_map(spark, label):
    from ledgerflow.functions.misc import method_of
    got = spark.createDataFrame([(label,)], "g string").select(method_of("g")).collect()[0][0]
    assert got in ("trend", "ewma", "median")


def test_thinning_keeps_both_classes_in_both_parts(spark):
    n = 20_000
    s = spark.range(n).select(F.col("id").alias("customer_id"), F.lit(1).alias("product_id"), F.lit("2024-01-01").alias("target_date"),
                              F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("label"))
    keys = ["customer_id", "product_id", "target_date"]
    thin = rp.thin_negatives(s, 3.0, keys)
    count = {r["label"]: r["count"] for r in thin.groupBy("label").count().collect()}
    assert count[1] == n // 50 and abs(count[0] - 3 * count[1]) < 0.15 * 3 * count[1]
    part = thin.withColumn("held", rp.hash_unit([*keys, "label"], 43) >= 0.8).groupBy("label").agg(F.avg(F.col("held").cast("int")).alias("share"))
    assert all(0.13 < r["share"] < 0.27 for r in part.collect())


def test_recommendation_attributes_of_a_product_in_two_warehouses(spark):
    pm = _pm(spark, [(1, "S/b", "B"), (1, "S/a", "A")]).withColumn("warehouse_id", F.when(F.col("category") == "A", 0).otherwise(1).cast("long"))
    got = rc.active_products(pm).collect()
    assert [(r["product_id"], r["category"]) for r in got] == [(1, "A")]


def test_recommendations_are_filled_with_products_that_score_zero(spark):
    pm = spark.createDataFrame([(p, 0, f"n{p}", f"C{p}", f"S{p}", f"sp{p}", f"pr{p}", "active") for p in range(1, 13)],
                               "product_id long, warehouse_id long, name_zh string, category string, subcategory string, "
                               "specification string, process_type string, is_active string")
    tx = _tx(spark, [(1, 2, D(2001, 1, 5), 3), (2, 5, D(2001, 1, 5), 4), (2, 1, D(2001, 1, 6), 4)])
    rows = rc.recommend_products(tx, pm, k=7, trim=False).orderBy("customer_id", "rank").collect()
    got = {c: [r["recommended_product_id"] for r in rows if r["customer_id"] == c] for c in (1, 2)}
    assert got == {1: [1, 3, 4, 5, 6, 7, 8], 2: [2, 3, 4, 6, 7, 8, 9]}
    assert all(r["final_score"] == 0.0 and r["price_match_score"] == 0.5 for r in rows)


def test_sheet_columns_missing_and_extra(spark):
    names = list(ig.SALES_COLUMNS)
    raw = spark.createDataFrame([("f", *["" if c in ("F", "Y") else "x" for c in names]), ("f", *["" if c == "F" else "y" for c in names])],
                                "file string, " + ", ".join(f"{c} string" for c in names))
    got = {r["column_name"]: (r["rows"], r["filled_rows"], r["status"]) for r in ig.check_columns(raw, "sales", ig.SALES_COLUMNS).collect()}
    assert got["product_id"] == (2, 0, "missing") and got["currency"] == (2, 1, "extra") and got["quantity"] == (2, 2, "ok")


def test_grouped_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", 3.0)] * 50 + [("hot", float(x)) for x in rng.normal(0, 9, 201)] + [("two", 1.0), ("two", 4.0), ("one", -2.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = rc.exact_quantiles(df, "x", [0.5, 0.9], ["g"])
    assert "median" not in out._jdf.queryExecution().toString().lower()
    got = {r.g: (r.q0, r.q1) for r in out.collect()}
    for g in ("hot", "two", "one"):
        v = [x for h, x in rows if h == g]
        assert np.allclose(got[g], np.quantile(v, [0.5, 0.9]), rtol=1e-12)
    assert set(got) == {"hot", "two", "one"}


def test_colliding_ids_are_lengthened(spark):
    """One hex digit for 60 rows must collide; ids end unique, the same on a second run, and unlike those taken."""
    from ledgerflow.functions.misc import transaction_id

    df = spark.createDataFrame([(i % 50, i) for i in range(60)], "k long, o long").repartition(5)
    once = sorted(map(tuple, transaction_id(df, ["k"], ["o"], length=1).collect()))
    ids = [r[2] for r in once]
    assert len(set(ids)) == 60 and any(len(i) > 1 for i in ids)
    assert once == sorted(map(tuple, transaction_id(df.repartition(3), ["k"], ["o"], length=1).collect()))
    assert all((len(i) > 1) == flag for _, _, i, flag in once)
    taken = spark.createDataFrame([(i,) for i in ids], "transaction_id string")
    again = [r.transaction_id for r in transaction_id(df, ["k"], ["o"], length=1, taken=taken).collect()]
    assert len(set(again)) == 60 and not set(again) & set(ids)
    plain = transaction_id(df, ["k"], ["o"]).collect()
    assert all(len(r.transaction_id) == 8 and not r.id_collision for r in plain)
