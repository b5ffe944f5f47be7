"""Target statistics by hand, and a classifier that has to learn from categories."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import boosting as bo, replenish as rp
from ledgerflow.operators.prefix import exclusive_sums

SCHEMA = "customer_id long, product_id string, target_date date, day_of_week long, weekday_name string, preferred_weekday long, x double, label int"


def samples(spark, n, seed=1):
    """Labels depend on the customer and, less, on x."""
    import datetime as dt

    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c, wd = rng.randrange(40), rng.randrange(7)
        x = rng.random()
        p = (0.9 if c % 2 else 0.05) * (0.6 + 0.4 * x)
        rows.append((c if rng.random() < 0.98 else None, f"p{rng.randrange(6)}", dt.date(2024, 1, 1) + dt.timedelta(days=i), wd, f"w{wd}", wd, x, int(rng.random() < p)))
    return spark.createDataFrame(rows, SCHEMA), rows


def test_ordered_statistics(spark):
    df, rows = samples(spark, 300)
    got = {(r.customer_id, r.product_id, r.target_date): r for r in bo.ordered_target_stats(df).collect()}
    prior = sum(r[7] for r in rows) / len(rows)
    names = ["customer_id", "product_id", "target_date", "day_of_week", "weekday_name", "preferred_weekday"]

    def place(r):
        return hashlib.md5("|".join(["44", *[str(v) for v in r[:3] if v is not None]]).encode()).hexdigest()

    for cat in bo.CATEGORIES:
        k, seen = names.index(cat), {}
        for r in sorted(rows, key=place):
            s, n = seen.get(r[k], (0, 0))
            assert abs(got[r[:3]][f"ts_{cat}"] - (s + prior) / (n + 1)) < 1e-12
            seen[r[k]] = (s + r[7], n + 1)


def test_statistics_of_unseen_categories(spark):
    df, rows = samples(spark, 100)
    stats = bo.target_stats(df)
    new = spark.createDataFrame([(10_000, "new", None, 3, "w3", None)], "customer_id long, product_id string, target_date date, day_of_week long, weekday_name string, preferred_weekday long")
    r = bo.with_target_stats(new, stats).collect()[0]
    prior = sum(x[7] for x in rows) / len(rows)
    mine = [x[7] for x in rows if x[4] == "w3"]
    assert abs(r.ts_customer_id - prior) < 1e-12 and abs(r.ts_product_id - prior) < 1e-12 and abs(r.ts_preferred_weekday - prior) < 1e-12
    assert abs(r.ts_weekday_name - (sum(mine) + prior) / (len(mine) + 1)) < 1e-12


def test_learns_from_categories_stops_and_stores(spark, tmp_path):
    df, _ = samples(spark, 1500)
    model, scored = bo.train(df, ["x"], rounds=25)
    m = rp.evaluate(scored, 0.5).collect()[0]
    assert 1 <= model.facts["rounds"] <= 25 and m.auc > 0.8 and m.tp + m.fp + m.fn + m.tn == m.n == scored.count()
    assert m.n == df.filter(bo.held_out()).count()
    model.save(f"{tmp_path}/m")
    again = bo.PurchaseModel.load(spark, f"{tmp_path}/m")
    one = scored.select("target_date", F.col("rawPrediction").cast("string").alias("r"))
    two = again.transform(df.filter(bo.held_out())).select("target_date", F.col("rawPrediction").cast("string").alias("r"))
    assert one.exceptAll(two).count() == 0
    whole = bo.fit_all(df, model.facts["rounds"], ["x"])
    assert whole.facts["rounds"] == model.facts["rounds"]


@pytest.mark.parametrize("classes, want", [("balanced", (50 / 80, 50 / 20)), ((1.0, 8.0), (1.0, 8.0))])
def test_class_weights(spark, classes, want):
    df = spark.createDataFrame([(int(i < 10),) for i in range(50)], "label int")
    got = {r.label: r.w for r in df.withColumn("w", bo._weights(df, classes)).distinct().collect()}
    assert abs(got[0] - want[0]) < 1e-12 and abs(got[1] - want[1]) < 1e-12


def test_exclusive_sums(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(9)}", i, rng.randrange(5)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = sorted(map(tuple, exclusive_sums(df, ["g"], ["o"], {"s": "v"}).collect()))
    want = sorted((g, o, v, sum(w for h, p, w in rows if h == g and p < o)) for g, o, v in rows)
    assert got == want


def test_training_rows_lie_evenly(spark, monkeypatch):
    df, _ = samples(spark, 2000)
    cores, seen = spark.sparkContext.defaultParallelism, []
    apart = df.filter(~bo.held_out()).repartition(40).unionByName(df.filter(bo.held_out()).repartition(40)).withColumn("held_out", bo.held_out())
    assert bo._spread(apart) is apart
    monkeypatch.setattr(bo, "ROWS_PER_TASK", 1000)
    cut = bo.cut
    monkeypatch.setattr(bo, "cut", lambda rows: seen.append(cut(rows)) or seen[-1])
    bo._fit(apart, ["x"], 2, "balanced", True, 1e-4, 42)
    ready = seen[-1]
    kinds = ready.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("held_out").alias("n")).collect()
    assert ready.rdd.getNumPartitions() == len(kinds) == cores and all(r.n == 2 for r in kinds) and ready.count() == 2000
    monkeypatch.setattr(bo, "ROWS_PER_TASK", 50)
    assert bo._spread(apart).rdd.getNumPartitions() == -(-40 // cores) * cores
