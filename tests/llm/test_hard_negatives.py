"""Hard negatives against all scores on small tables (the SQL is compared in test_sql)."""

import math
import random

import pytest

from ledgerflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, rid string, score int"


def shifted(v, label):
    return label if v is None or v % 7 else (label + 1) % 10


def brute(rows, positives=5, negatives=10, label_of=shifted):
    sound = [(v, label_of(v, lab), [math.floor(256 * x) for x in e]) for v, e, lab, *_ in rows
             if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (a, la, ea) in enumerate(sound):
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(ea, e)), v, lab) for j, (v, lab, e) in enumerate(sound) if j != i and len(e) == len(ea)]
        scored.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        for ps, p, _ in [r for r in scored if r[2] == la][:positives]:
            fit = [r for r in scored if r[2] != la and 30 * ps <= 100 * r[0] <= 90 * ps][:negatives]
            out += [(a, p, k + 1, r[1], ps, r[0]) for k, r in enumerate(fit)]
    return sorted(out, key=str)


def rows_of(n, dim, seed, hot=0.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        m = middles[0] if rng.random() < hot else [c + rng.gauss(0, 0.7) for c in rng.choice(middles)]
        rows.append((i, m, rng.randrange(3) if rng.random() < 0.5 else 1, "x", 1))
    return rows


def odd_rows():
    rows = rows_of(900, 6, 1, 0.3)
    rows += [(100, rows[5][1], 1, "x", 1), (100, rows[6][1], 2, "x", 1), (None, rows[7][1], 0, "x", 1), (None, rows[8][1], 1, "x", 1)]
    rows += [(1000, None, 1, None, None), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "x", 1), (1200, [float("nan")] * 6, 1, "x", 1),
             (1300, [float("inf")] * 6, 1, "x", 1), (1400, [1.0] * 6, None, "x", 1), (1500, [0.0] * 6, 1, "x", 1), (1501, [0.0] * 6, 2, "x", 1),
             (1600, [1.0, 2.0], 1, "x", 1), (1601, [2.0, 1.0], 1, "x", 1), (1602, [1.0, 1.0], 2, "x", 1), (1603, [1.0, 0.5], 2, "x", 1),
             (1700, [], 1, "x", 1), (1701, [], 1, "x", 1), (1702, [], 2, "x", 1), (-100, rows[9][1], 1, "x", 1), (-7, rows[10][1], 9, "x", 1)]
    return rows


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


LABEL = "IF(vec_id % 7 = 0, (label + 1) % 10, label)"


@pytest.mark.parametrize("shard, block, members", [(8192, 8192, 64), (50, 3, 2)])
def test_against_all_scores(make, shard, block, members):
    df = make(odd_rows(), SCHEMA)
    assert found(hn.hard_negatives(df, label=LABEL, shard=shard, block=block, members=members)) == brute(odd_rows())


def test_big_numbers(make):
    rows = [(v, [x * 3e5 for x in e], lab, *r) for v, e, lab, *r in rows_of(260, 5, 2)]
    assert found(hn.hard_negatives(make(rows, SCHEMA), label=LABEL, shard=64)) == brute(rows)


def test_many_labels(make):
    rows = [(v, e, v // 3, *r) for v, e, lab, *r in rows_of(400, 4, 3)]
    assert found(hn.hard_negatives(make(rows, SCHEMA), label="label")) == brute(rows, label_of=lambda v, lab: lab)


def test_walk_stops_early():
    """Members near their centre leave the list before its end, and lose nothing."""
    import numpy as np

    rng = np.random.default_rng(5)
    middles = rng.normal(0, 200, (20, 16))
    points = np.floor(np.repeat(middles, 200, axis=0) + rng.normal(0, 10, (4000, 16)))
    shard = hn.Shard([(i, i, 0, p.tolist()) for i, p in enumerate(points)], 1)
    queries = points[:50]
    asked = []
    plain = shard.scores
    shard.scores = lambda q, r: asked.append(len(q) * len(r)) or plain(q, r)
    centre = hn._unit(queries.mean(axis=0, keepdims=True))[0]
    theta = float(np.arccos(np.clip(hn._unit(queries) @ centre, -1, 1)).max()) + 1e-6
    low = np.full((50, 1), hn.BOTTOM)
    slot, row, score = hn.walk(shard, (16, 0), centre, theta, queries, np.arange(50), np.zeros(50, np.int64), low, np.full((50, 1), hn.TOP), True, 5)
    every = (queries @ points.T).astype(np.int64)
    every[np.arange(50), np.arange(50)] = hn.BOTTOM
    want = np.sort(every, axis=1)[:, ::-1][:, :5]
    assert (np.sort(score.reshape(50, 5), axis=1)[:, ::-1] == want).all()
    assert sum(asked) < 50 * 4000 / 4


def test_empty_table(make):
    assert hn.hard_negatives(make([], SCHEMA)).collect() == []
