"""Nearest products against all pairs."""

import math
import random

import pytest

from ledgerflow.operators import recommend as rc
from ledgerflow.operators import neighbours
from ledgerflow.operators.neighbours import nearest_products


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 7)])
def test_nearest_products(spark, seed, k):
    rng = random.Random(seed)
    products = [(p, f"c{rng.randrange(4)}", f"s{rng.randrange(9)}", f"x{rng.randrange(6)}", "unknown" if rng.random() < 0.3 else f"y{rng.randrange(3)}")
                for p in rng.sample(range(1000), 120)]
    prices = [(p[0], rng.choice([5.0, 5.0, 5.0, 7.25, rng.random() * 20])) for p in products if rng.random() < 0.8]
    sd = {"c0": 2.5, "c1": 0.0, "c2": None}          # c3 has no statistics
    got = nearest_products(spark.createDataFrame(products, "product_id long, category string, subcategory string, specification string, process_type string"),
                           spark.createDataFrame(prices, "product_id long, product_price double"),
                           spark.createDataFrame(list(sd.items()), "category string, cat_std double"), k).collect()
    price, want = {p: round(x, 6) for p, x in prices}, set()
    for a in products:
        rows = []
        for b in products:
            if a[0] == b[0]:
                continue
            close, far = 0.0, None
            pa, pb = price.get(a[0]), price.get(b[0])
            if a[1] == b[1]:
                far = None if pa is None or pb is None else round(abs(pa - pb), 6)
                s = sd.get(a[1])
                close = 0.5 if far is None else math.exp(-0.5 * (abs(pa - pb) / s) ** 2) if s else (1.0 if pa == pb else 0.5)
            sim = round((sum(x == y for x, y in zip(a[1:], b[1:])) + close) / 5, 9)
            rows.append((-sim, far is None, far or 0.0, b[0]))
        want |= {(a[0], i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:k])}
    assert {(r.product_id_a, r["rank"], r.product_id_b, r.similarity) for r in got} == want


def test_bought_together(spark):
    lines = spark.createDataFrame([(1, 5), (1, 3), (1, 5), (2, 3), (2, 5), (2, 9), (3, 4), (None, 1), (None, 2)], "o long, p long")
    assert sorted(map(tuple, rc.bought_together(lines, "o", "p").collect())) == [(3, 5), (3, 9), (5, 9)]


def test_candidates_stay_few(spark):
    """Who is told of a product by one round of sets: at most k + 1 a set, where prices differ, and done products ask no more."""
    k = 3
    rows = [(p, f"c{p % 2}", f"c{p % 2}/s{p % 4}", f"x{p % 3}", "y", float(p * p)) for p in range(400)]
    products = spark.createDataFrame(rows, "product_id long, category string, subcategory string, specification string, process_type string, price double")
    sets = neighbours.rounds()[0][1]
    ids = {r.product_id: len(r.ids) for r in neighbours.candidates(products, k, sets).collect()}
    assert len(ids) == 400 and max(ids.values()) <= len(sets) * (k + 1)
    few = neighbours.candidates(products, k, sets, spark.createDataFrame([(7,), (8,)], "product_id long")).collect()
    assert {r.product_id for r in few} == {7, 8}


def test_similarity_moves_pairs_once_to_each_product(spark):
    pairs = spark.createDataFrame([(1, 2)], "product_id_a long, product_id_b long")
    products = spark.createDataFrame([(1, "c", "s", "x", "y"), (2, "c", "s", "x", "z")], "product_id long, category string, subcategory string, specification string, process_type string")
    prices = spark.createDataFrame([(1, 5.0), (2, 5.0)], "product_id long, product_price double")
    out = rc.product_similarity(pairs, products, prices, spark.createDataFrame([("c", 1.0)], "category string, cat_std double"))
    assert [(r.similarity, r.price_similarity) for r in out.collect()] == [(0.8, 1.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Join") for line in plan.splitlines()) == 2
