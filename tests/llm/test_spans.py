"""Span helpers against plain loops, the added spans of op3 and op10, and very many matches."""

import random
import re
import time

from pyspark.sql import functions as F

from ledgerflow.llm import pii, secret_scan, spans

SPANS = "array<struct<kind:int,s:bigint,e:bigint>>"


def random_spans(rnd, n, reach):
    out = []
    for _ in range(n):
        s = rnd.randrange(reach)
        out.append((rnd.randrange(3), s, s + rnd.randrange(1, 9)))
    return out


def test_apart_and_merged_against_loops(make):
    rnd = random.Random(5)
    rows = [(i, random_spans(rnd, rnd.choice((0, 1, 2, 7, 40)), 120), random_spans(rnd, rnd.choice((0, 1, 3, 12)), 120)) for i in range(120)]
    df = make(rows, f"id long, a {SPANS}, b {SPANS}")
    got = df.select("id", spans.apart(F.col("a"), F.col("b")).alias("free"), spans.merged(F.col("a")).alias("one")).collect()
    by_id = {r[0]: r for r in rows}
    assert len(got) == len(rows)
    for r in got:
        _, a, b = by_id[r["id"]]
        assert [tuple(x) for x in r["free"]] == [x for x in a if not any(y[1] < x[2] and x[1] < y[2] for y in b)]
        one = []
        for _, s, e in sorted(a, key=lambda x: x[1:]):
            if one and one[-1][1] > s:
                one[-1] = (one[-1][0], max(one[-1][1], e))
            else:
                one.append((s, e))
        assert [tuple(x) for x in r["one"]] == one


def test_places_with_context(make):
    rnd = random.Random(6)
    texts = ["", "a", "ab ab", "éab" * 50 + "𝄞", "ab" * 90] + [
        "".join(rnd.choice("ab é𝄞\n") for _ in range(rnd.randrange(150))) for _ in range(60)]
    df = make(list(enumerate(texts)), "id long, text string")
    got = df.select("id", spans.places(F.col("text"), "ab?", 2, context=32).alias("x")).collect()
    for r in got:
        t = texts[r["id"]]
        expect = [(2, m.start(), m.end(), m.group(), t[max(0, m.start() - 32):m.start()], t[m.end():m.end() + 1])
                  for m in re.finditer("ab?", t)]
        assert [tuple(x) for x in r["x"]] == expect


def test_luhn(make):
    def valid(d):
        back = [int(c) for c in reversed(d)]
        return bool(d) and sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(back)) % 10 == 0

    rnd = random.Random(7)
    numbers = ["", "0", "18", "4111111111111111"] + ["".join(rnd.choice("0123456789") for _ in range(rnd.randrange(1, 22))) for _ in range(300)]
    got = make(list(enumerate(numbers)), "id long, d string").select("id", spans.luhn(F.col("d")).alias("ok")).collect()
    assert {r["id"]: r["ok"] for r in got} == {i: valid(d) for i, d in enumerate(numbers)}


def test_very_many_matches_in_one_text(make):
    n = 40_000
    mails = " ".join(f"u{i}@x.org" for i in range(n))
    began = time.time()
    row = pii.candidates(make([(1, mails)], "doc_id long, text string")).select(
        F.size("base").alias("n"), F.element_at("base", -1)["e"].alias("e")).collect()[0]
    assert (row["n"], row["e"]) == (n, len(mails))
    rnd = random.Random(8)
    mixed = " ".join(f"u{i}@x.org bob(at)site.org" for i in range(n // 2))
    assert pii.candidates(make([(1, mixed)], "doc_id long, text string")).select(F.size("loose")).collect()[0][0] == n // 2
    keys = " ".join("".join(rnd.choice("0123456789abcdef") for _ in range(32)) + " token=abcdefgh1" for _ in range(n // 2))
    row = secret_scan.scan(make([(1, keys)], "doc_id long, text string")).select(F.size("base"), F.size("added")).collect()[0]
    assert tuple(row) == (n, 0)
    assert time.time() - began < 90


def test_votes_and_classifier_keep_planted_finds(make):
    """Loose finds with the cue and form of addresses are added; look-alikes in doubt are not."""
    rows = []
    for i in range(100, 400):
        rows.append((i, f"please e-mail bob{i}(at)site.org today"))
        rows.append((1000 + i, f"please e-mail ann{i}@site.org today"))
        rows.append((2000 + i, f"see release +x{i}%_(at)b.q1x now"))
        rows.append((3000 + i, f"see release {i}_@b.q1"))
    out = {r["doc_id"]: [tuple(x) for x in r["added"]] for r in pii.find(make(rows, "doc_id long, text string")).collect()}
    for i in range(100, 400):
        assert out[i] == [(0, 14, 14 + len(f"bob{i}(at)site.org"))]
        assert out[1000 + i] == out[2000 + i] == out[3000 + i] == []


def test_expectation_maximisation_against_a_loop(spark, make):
    """Priors and reliabilities equal those of a plain loop over the same vote patterns."""
    import math

    rnd = random.Random(9)
    patterns = [(k, code, rnd.randrange(1, 50)) for k in (0, 3) for code in rnd.sample(range(3 ** 5), 30)]
    got = pii.fit_votes(make(patterns, "kind int, votes int, n long"), rounds=4)
    for k in (0, 3):
        rows = [(c, n) for kk, c, n in patterns if kk == k]
        prior = tables = None
        for step in range(4):
            weights = []
            for c, _ in rows:
                v = [c // 3 ** j % 3 for j in range(5)]
                if step == 0:
                    logit = sum((x == 1) - (x == 2) for x in v)
                else:
                    logit = math.log(prior / (1 - prior)) + sum(math.log(tables[j][1][x] / tables[j][0][x]) for j, x in enumerate(v))
                weights.append(1 / (1 + math.exp(-logit)))
            total, yes = sum(n for _, n in rows), sum(n * w for (_, n), w in zip(rows, weights))
            prior = (yes + 1) / (total + 2)
            tables = []
            for j in range(5):
                sums = [[0.0] * 3, [0.0] * 3]
                for (c, n), w in zip(rows, weights):
                    sums[0][c // 3 ** j % 3] += n * (1 - w)
                    sums[1][c // 3 ** j % 3] += n * w
                tables.append([[(s[v] + 1) / (sum(s) + 3) for v in range(3)] for s in sums])
        assert math.isclose(got[k][0], prior, rel_tol=1e-9)
        for j in range(5):
            for c in (0, 1):
                assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[k][1][j][c], tables[j][c]))
