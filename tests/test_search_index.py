"""Keyword search by rarest pieces against a plain scan of every message and keyword."""

import random

import pytest

from ledgerflow.operators import prospects as pr

MSGS = "conv_id long, customer_id long, content string"


def chat():
    rng = random.Random(2)
    words = ["red", "Bolt", "gear", "a+b", "(x)", "日本語", "🙂🙂", "Ünder", "the", "  ", "a", "bc", "^.*"]
    rows = [(i, i % 9 or None, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    return rows + [(900, 1, None), (901, None, ""), (902, 2, "x" * 50_000 + "needle"), (903, 3, "ab"), (904, 3, "\n\nred\nbolt")]


KEYWORDS = ["red", "BOLT", "bolt", "d b", "a", "日本", "🙂", "ünder", "needle", "(x)", ".*", "^", "  ", "", "absent", "red\nb", "bc", "🙂🙂 the"]


@pytest.mark.parametrize("few", [4096, 0])
def test_every_hit(spark, monkeypatch, few):
    monkeypatch.setattr(pr, "FEW_GRAMS", few)
    msgs, kw = spark.createDataFrame(chat(), MSGS), spark.createDataFrame([(k,) for k in KEYWORDS * 2], "keyword string")
    df = pr.search_messages(msgs, kw)
    assert "NestedLoop" not in df._jdf.queryExecution().toString()
    got = sorted((r.conv_id, r.keyword, r.position) for r in df.collect())
    want = sorted((i, k, t.lower().find(k.lower())) for i, _, t in chat() if t for k in KEYWORDS if k.strip() and k.lower() in t.lower())
    assert got == want


def test_runs_of_all_products(spark):
    msgs = spark.createDataFrame(chat(), MSGS)
    words = {1: ["red", "bolt"], 2: ["red", "bolt"], 3: ["red", "absent"], 4: ["red"], 5: ["red", "a", "日本"]}
    kw = spark.createDataFrame([(p, k) for p, ks in words.items() for k in ks], "product_id long, keyword string")
    subs = {1: ["S1"], 2: ["S2"], 3: ["S1", "S3"], 4: ["S9"], 5: ["S2"], 6: ["S3"]}
    pm = spark.createDataFrame([(p, s) for p, ss in subs.items() for s in ss], "product_id long, subcategory string")
    sold = [(c, p) for c in range(1, 9) for p in range(1, 7) if (c * p) % 3 == 0]
    got = {r.product_id: (r.keywords, r.matches, r.customers, r.purchased_customers)
           for r in pr.search_runs(msgs, kw, spark.createDataFrame(sold, "customer_id long, product_id long"), pm).collect()}
    want = {}
    for p, ks in words.items():
        hits = [c for _, c, t in chat() if t for k in ks if k in t.lower()]
        reached = {c for c in hits if c is not None}
        buyers = {c for c, q in sold if set(subs[q]) & set(subs[p])}
        want[p] = (len(ks), len(hits), len(reached), len(reached & buyers))
    assert got == want


def test_no_messages_no_keywords(spark):
    none, kw = spark.createDataFrame([], MSGS), spark.createDataFrame([], "keyword string")
    assert pr.search_messages(none, spark.createDataFrame([("red",)], "keyword string")).collect() == []
    assert pr.search_messages(spark.createDataFrame(chat(), MSGS), kw).collect() == []
