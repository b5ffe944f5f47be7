"""Bounded recommendation search against plain scoring of every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import bounded, recommend as rc

PM = ("product_id long, warehouse_id long, name_zh string, category string, subcategory string, specification string, "
      "process_type string, is_active string")
SALES = "customer_id long, product_id long, category string, subcategory string, specification string, process_type string, unit_price double"


def market(seed, n_products=90, n_customers=60, unknown=True):
    rng = random.Random(seed)
    products = []
    for p in range(1, n_products + 1):
        sub = "unknown" if unknown and rng.random() < 0.1 else f"S{rng.randrange(25)}"
        products.append((p, 0, f"n{p}", f"C{rng.randrange(5)}", sub, f"sp{rng.randrange(12)}", f"pr{rng.randrange(4)}", "active"))
    sold = products[:-15]          # the last ones are never sold
    sales = []
    for c in range(1, n_customers + 1):
        for _ in range(rng.choice([1, 1, 2, 3, 8, 30])):
            p = rng.choice(sold)
            sales.append((c, p[0], p[3], p[4], p[5], p[6], 10.0 + p[0] % 7 + rng.randrange(4)))
    return products, sales


def mean(xs):
    return sum(xs) / len(xs)


def close(a, b, sd):
    if a is None or b is None:
        return 0.5
    if sd:
        return math.exp(-0.5 * ((a - b) / sd) ** 2)
    return 1.0 if a == b else 0.5


def plain(products, sales):
    """(customer, product) -> (base, match) for every allowed pair."""
    info = {p[0]: p for p in products}
    by_cat, by_product, by_customer, profile = {}, {}, {}, {}
    for c, p, cat, *_, price in sales:
        by_cat.setdefault(cat, []).append(price)
        by_product.setdefault(p, []).append(price)
        by_customer.setdefault(c, set()).add(p)
        profile.setdefault((c, cat), []).append(price)
    sd = {k: math.sqrt(sum((x - mean(v)) ** 2 for x in v) / (len(v) - 1)) if len(v) > 1 else None for k, v in by_cat.items()}
    price = {k: mean(v) for k, v in by_product.items()}
    out = {}
    for c, mine in by_customer.items():
        subs = {info[p][4] for p in mine} - {"unknown"}
        for p, _, _, cat, sub, spec, proc, _ in products:
            if p in mine or sub in subs:
                continue
            total = sum((info[b][3] == cat) + (info[b][4] == sub) + (info[b][5] == spec) + (info[b][6] == proc)
                        + (close(price.get(p), price[b], sd.get(cat)) if info[b][3] == cat else 0) for b in mine)
            own = profile.get((c, cat), [])
            match = close(price.get(p), mean(own) if len(own) >= 2 else None, sd.get(cat))
            out[c, p] = (total / 5 / len(mine), match, sub)
    return out, set(price)


@pytest.mark.parametrize("hot, shard, lead", [(2048, 7, 2), (5, 2048, 1024)])
def test_both_directions(spark, monkeypatch, hot, shard, lead):
    products, sales = market(hot + shard)
    monkeypatch.setattr(rc, "HOT", hot)
    plain_init, plain_search = bounded.Scoring.__init__, bounded.Scoring.customers_for_products
    monkeypatch.setattr(bounded.Scoring, "__init__", lambda s, *a: plain_init(s, *a, shard=shard))
    monkeypatch.setattr(bounded.Scoring, "customers_for_products", lambda s, w, k: plain_search(s, w, k, sample=lead))
    pm, df = spark.createDataFrame(products, PM), rc.cut(spark.createDataFrame(sales, SALES))
    scores, sold = plain(products, sales)

    got = {}
    for r in rc.recommend_products(None, pm, k=7, sales=df).collect():
        got.setdefault(r.customer_id, []).append((r["rank"], r.recommended_product_id, r.final_score))
    for c in {s[0] for s in sales}:
        best = {}
        for (who, p), (base, match, sub) in scores.items():
            if who == c:
                key = (-round(base * match, 10), p)
                best[sub] = min(best.get(sub, key), key)
        want = sorted(best.values())[:7]
        assert [x[1] for x in sorted(got[c])] == [p for _, p in want], c
        assert all(abs(x[2] + s) < 1e-4 for x, (s, _) in zip(sorted(got[c]), want))

    got = {}
    for r in rc.recommend_customers(None, pm, k=7, sales=df).collect():
        got.setdefault(r.product_id, []).append((r["rank"], r.recommended_customer_id, r.final_score))
    for p in sold:
        want = sorted((-round(base * match, 10), who) for (who, q), (base, match, _) in scores.items() if q == p)[:7]
        assert [x[1] for x in sorted(got.get(p, []))] == [who for _, who in want], p
        assert all(abs(x[2] + s) < 1e-4 for x, (s, _) in zip(sorted(got.get(p, [])), want))
    assert set(got) <= sold


def test_customers_who_score_zero_fill_short_lists(spark):
    """Product 1 shares nothing with anyone: the first customers that did not buy its subcategory, by id."""
    products = [(p, 0, f"n{p}", f"C{p}", "S1" if p < 3 else f"S{p}", f"sp{p}", f"pr{p}", "active") for p in range(1, 30)]
    sales = [(1, 1, "C1", "S1", "sp1", "pr1", 5.0), (2, 2, "C2", "S1", "sp2", "pr2", 5.0)]
    sales += [(c, c, f"C{c}", f"S{c}", f"sp{c}", f"pr{c}", 5.0) for c in range(3, 20)]
    pm, df = spark.createDataFrame(products, PM), rc.cut(spark.createDataFrame(sales, SALES))
    only = spark.createDataFrame([(1,), (4,), (29,)], "product_id long")
    rows = rc.recommend_customers(None, pm, k=7, sales=df, wanted=only).orderBy("product_id", "rank").collect()
    assert [r.recommended_customer_id for r in rows if r.product_id == 1] == [3, 4, 5, 6, 7, 8, 9]
    assert [r.recommended_customer_id for r in rows if r.product_id == 4] == [1, 2, 3, 5, 6, 7, 8]
    assert {r.product_id for r in rows} == {1, 4} and all(r.final_score == 0 for r in rows)


def test_no_sales(spark):
    pm = spark.createDataFrame(market(1)[0], PM)
    none = spark.createDataFrame([], SALES)
    assert rc.recommend_products(None, pm, sales=none).collect() == []
    assert rc.recommend_customers(None, pm, sales=none).collect() == []
    assert rc.best_per_subcategory(none.select("customer_id", "product_id", "subcategory", F.lit(1.0).alias("rank_score"))).count() == 0


def test_wide_shards(spark, monkeypatch):
    """Several wide shards and bins of few products give the same lists, and a customer's row meets few shards."""
    products, sales = market(5, n_products=240)
    pm, df = spark.createDataFrame(products, PM), rc.cut(spark.createDataFrame(sales, SALES))
    want = sorted(map(tuple, rc.recommend_products(None, pm, sales=df).collect()))
    asked = []
    plain_ask = bounded._ask_wide
    monkeypatch.setattr(bounded, "_ask_wide", lambda stock, rows, k: asked.append(rows.count()) or plain_ask(stock, rows, k))
    rc.recommend_products(None, pm, sales=df).collect()
    customers = len({s[0] for s in sales})
    assert asked[0] <= 2 * customers
    monkeypatch.setattr(bounded, "SHELF", 9)
    monkeypatch.setattr(bounded, "BINS", 3)
    monkeypatch.setattr(bounded, "CROWD", 4)
    assert sorted(map(tuple, rc.recommend_products(None, pm, sales=df).collect())) == want


def test_customers_meet_categories_they_never_bought_not_every_shard(spark):
    """Of categories nobody lacks no row is made, however many shards and shared attributes there are."""
    products = [(p, 0, f"n{p}", f"C{p % 2}", f"S{p}", "sp", "pr", "active") for p in range(1, 41)]
    sales = [(c, p, f"C{p % 2}", f"S{p}", "sp", "pr", 5.0 + p) for c in range(1, 31) for p in (2 * c % 40 + 1, 2 * c % 40 + 2)]
    sales.append((99, 1, "C1", "S1", "sp", "pr", 6.0))
    pm, df = spark.createDataFrame(products, PM), rc.cut(spark.createDataFrame(sales, SALES))
    search = bounded.Scoring(df, rc.active_products(pm), rc.product_prices(df), rc.category_price_stats(df), rc.HOT, shard=2)
    shards = search.stock.select("category", "slot", "piece").distinct().withColumn("least", F.lit(0.0))
    assert shards.count() > 10
    far = search.who.withColumn("bound", F.lit(1.0))
    assert [tuple(r) for r in search._absent(far, shards).select("customer_id", "category").collect()] == [(99, "C0")]
    assert search._absent(far.withColumn("bound", F.lit(-1.0)), shards).count() == 0
    guests = search._strangers(search.stock, 50)
    assert {r.customer_id for r in guests.collect()} == {99} and {r.category for r in guests.collect()} == {"C0"}


def test_first_round_asks_customers_of_every_price_level(spark):
    rows = [(c, "C", 1.0 - c / 1000, 10.0, 4.0) for c in range(1, 41)] + [(50, "C", 0.1, 90.0, 4.0), (60, "C", 0.1, None, 4.0), (61, "C", 0.05, None, 4.0)]
    parts = spark.createDataFrame(rows, "customer_id long, category string, bound double, avg_price double, cat_std double")
    got = sorted(r.customer_id for r in bounded.Scoring._leaders(None, parts, 4).collect())
    assert got == [1, 2, 3, 4, 50, 60]


def shelf(rng, n, sd, spread, unknown=0.0, priceless=0.0):
    """A wide shard of ``n`` products."""
    odd = rng.random(n) < unknown
    return bounded.Rack({"product_id": rng.permutation(n) + 1000, "price": np.where(rng.random(n) < priceless, np.nan, rng.normal(30, spread, n).round(2)),
                         "sub": np.where(odd, 5, rng.integers(10, 35, n)), "unknown": odd, "specification": rng.integers(0, 9, n), "process_type": rng.integers(0, 4, n)}, sd)


def crowd(rng, rack, m, free=0.0):
    """Customers of a wide shard as columns: lists as offsets and values."""
    def lists(make):
        rows = [make() for _ in range(m)]
        return np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate([np.array(r) for r in rows])

    c = {"customer_id": np.arange(m), "n_bought": rng.integers(20, 60, m).astype(float), "n_unknown": rng.integers(0, 4, m).astype(float),
         "need": np.zeros(m), "avg_price": np.where(rng.random(m) < free, np.nan, rng.normal(30, 5, m))}
    for a, values in (("specification", 11), ("process_type", 5)):
        at, codes = lists(lambda v=values: rng.permutation(v)[:rng.integers(1, v)])
        c |= {f"{a}_codes": (at, codes), f"{a}_ns": (at, rng.integers(1, 6, len(codes)))}
    c["subs"] = lists(lambda: rng.permutation(np.arange(8, 36))[:rng.integers(0, 12)].astype(np.int64))
    c["odd"] = lists(lambda: rng.permutation(rack.id)[:rng.integers(0, 3)].astype(np.int64))
    c["prices"] = lists(lambda: rng.normal(30, 5, rng.integers(0, 9)))
    c["n_category"] = np.diff(c["prices"][0]).astype(float)
    return c


@pytest.mark.parametrize("sd, unknown, priceless, free", [(6.0, 0.1, 0.1, 0.3), (80.0, 0.0, 0.0, 0.0), (0.0, 0.2, 0.3, 0.2), (None, 0.0, 1.0, 0.5)])
@pytest.mark.parametrize("grid", [1 << 20, 300])
def test_search_of_a_wide_shard_finds_what_plain_scoring_finds(monkeypatch, sd, unknown, priceless, free, grid):
    monkeypatch.setattr(bounded, "GRID", grid)
    rng = np.random.default_rng(7)
    rack = shelf(rng, 700, sd, 5, unknown, priceless)
    c = crowd(rng, rack, 40, free)
    got = {}
    for who, what, base, match in zip(*rack.best(c, 7), strict=True):
        got.setdefault(who, []).append((-round(base * match, 10), rack.id[what]))
    cells = {a: rack.values[a][rack.cell_of[a]][rack.cell] for a in bounded.ATTRS}
    for i in range(40):
        def mine(name, i=i):
            return c[name][1][c[name][0][i]:c[name][0][i + 1]]
        counts = {a: dict(zip(mine(f"{a}_codes"), mine(f"{a}_ns"), strict=True)) for a in bounded.ATTRS}
        best = {}
        for p in range(len(rack.id)):
            sub = rack.values["sub"][rack.sub[p]]
            if sub in mine("subs") or rack.id[p] in mine("odd"):
                continue
            price = None if math.isnan(rack.price[p]) else rack.price[p]
            total = c["n_category"][i] + sum(counts[a].get(cells[a][p], 0) for a in bounded.ATTRS) + c["n_unknown"][i] * rack.cell_unknown[rack.cell[p]]
            total += sum(close(price, b, sd) for b in mine("prices"))
            score = round(total / 5 / c["n_bought"][i] * close(price, None if math.isnan(c["avg_price"][i]) else c["avg_price"][i], sd), 10)
            if score > 0:
                best[sub] = min(best.get(sub, (0, 0)), (-score, rack.id[p]))
        assert sorted(got.get(i, [])) == [pytest.approx(x, abs=1e-9) for x in sorted(best.values())[:7]], i


def test_work_of_a_customer_does_not_grow_with_its_wide_shard(monkeypatch):
    """Sixteen times the products of a shard, all near one price: not four times as many are scored for a customer."""
    scored = []
    plain_scores = bounded.Rack._scores
    monkeypatch.setattr(bounded.Rack, "_scores", lambda self, *a: scored.append(len(a[-1])) or plain_scores(self, *a))
    each = []
    for n in (8000, 128000):
        rng = np.random.default_rng(3)
        rack = shelf(rng, n, 60.0, 5)
        c = crowd(rng, rack, 100)
        c["odd"] = (np.zeros(101, np.int64), np.empty(0, np.int64))
        scored.clear()
        rack.best(c, 7)
        each.append(sum(scored) / 100)
    assert each[1] < 4 * each[0] < 800, each


def test_sales_are_written_once_before_the_price_cut(spark, monkeypatch):
    """The sales are written before the price cut; nobody short of scoring subcategories means no second read for zeros."""
    products, sales = market(3)
    pm = spark.createDataFrame(products, PM)
    tx = spark.createDataFrame([(c, p, 1.0, price) for c, p, *_, price in sales], "customer_id long, product_id long, quantity double, amount double")
    written = []
    plain_cut = rc.cut
    monkeypatch.setattr(rc, "cut", lambda df: written.append(df.columns) or plain_cut(df))
    got = rc.scoring_sales(tx, pm)
    assert len(written) == 1 and "unit_price" in written[0]
    want = rc.trim_prices(rc.priced_sales(tx, pm)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() < len(sales)
    empty = spark.createDataFrame([], tx.schema)
    assert rc.scoring_sales(empty, pm).count() == 0
    scoring = spark.createDataFrame([(1, 1, f"S{k}", 0.5, 0.5, 0.25) for k in range(7)], "customer_id long, product_id long, subcategory string, base_similarity double, price_match double, rank_score double")
    assert rc._zero_scores(scoring, scoring.select("customer_id").distinct(), got.filter("1 / 0 = customer_id"), pm, 7).count() == 0


def test_product_rows_of_wide_shards_hold_no_null_list(spark):
    row = bounded._listless(spark.range(1)).first()
    assert all(row[n] == [] for n in bounded.LISTS)
