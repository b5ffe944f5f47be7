"""Conversation repair against a plain shortest-path search over whole conversations."""

import collections
import hashlib
import random
import zlib

import pytest

from ledgerflow.llm import conversation_repair as cr

BLANK = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def digest(t):
    return hashlib.sha256(t.encode()).digest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """conv_id -> the row of the report, by dynamic programming over (row, state) with whole strings as ties."""
    convs = {r[0]: [] for r in rows}
    for r in damage(rows):
        convs[r[0]].append(r)
    report = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), digest(r[3])))
        seen, faults, count = set(), [], collections.Counter()
        for _, _, role, text in mine:
            end = text.rstrip(BLANK)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            count[fault] += 1
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        best = {"": (0, "", ())}          # state -> (cost, audit, lines)

        def better(table, state, option):
            if state not in table or option[:2] < table[state][:2]:
                table[state] = option

        def insert(table):
            for _ in range(3):
                for state, (cost, audit, lines) in list(table.items()):
                    for role in ("user", "assistant"):
                        if (state, role[0]) in STEP:
                            better(table, STEP[state, role[0]], (cost + 5, audit + "I", (*lines, role + ":")))

        for (_, _, role, text), fault in zip(mine, faults):
            insert(best)
            after = {}
            for state, (cost, audit, lines) in best.items():
                better(after, state, (cost + 2, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 if fault == "truncated" else 0
                if (state, role[:1]) in STEP:
                    better(after, STEP[state, role[:1]], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in STEP:
                        better(after, STEP[state, new[0]], (cost + 1 + more, audit + "R", (*lines, f"{new}:{text}")))
            best = after
        insert(best)
        cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
        report[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                        hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return report


def collect(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def odd_rows():
    rng = random.Random(11)
    rows = []
    roles = ["system", "user", "assistant", "tool", "user", "assistant", None, "", "sys", "User"]
    texts = ["fine.", "so?", "cut off", "well !  ", " ", "", None, "é…", "ok.", "yes.\n\t", "line ", "a.b"]
    for conv in range(120):
        for k in range(rng.randrange(0, 14)):
            rows.append((conv, None if rng.random() < 0.05 else k + rng.randrange(3), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{k}."))
    rows += [(None, k, "user" if k % 2 else "assistant", f"n{k}.") for k in range(5)] + [(500, 1, "user", "x."), (500, 1, "user", "x."), (500, 1, "user", "x.")]
    rows += [(501, None, None, None), (502, 3, "assistant", "long " * 20000 + "."), (503, 0, "system", "only.")]
    rows += [(504, k, "tool", f"t{k}.") for k in range(41)] + [(505, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(1, 60)]
    rows += [(506, k, "user", "again.") for k in range(50)] + [(507, k, rng.choice(roles[:4]), f"t{k}" + rng.choice([".", ""])) for k in range(80)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk, passes", [(4096, 8), (3, 8), (2, 0), (5, 1)])
def test_against_brute_force(make, chunk, passes):
    df = make([(*r, "k", 1) for r in odd_rows()], SCHEMA + ", pos string, conv int")
    assert collect(cr.audits(df, chunk=chunk, passes=passes)) == brute(odd_rows())


def test_repaired_rows(make):
    """The operator's own rows give the digest and follow the roles."""
    want = brute(odd_rows())
    rows = cr.repair(make(odd_rows(), SCHEMA), chunk=7).collect()
    by_conv = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.pos, r.sub)):
        by_conv[r.conv_id].append(r)
    for conv, mine in by_conv.items():
        assert "".join(r.edit for r in mine) == want[conv][6]
        lines = [f"{r.role}:{r.text}" for r in mine if r.edit != "D"]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[conv][7]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collect(cr.op11_conversation_repair(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_empty_table(make):
    assert cr.audits(make([], SCHEMA)).collect() == []


def test_string_ids(make):
    rows = [("a:b", 0, "user", "x."), ("", 0, "user", "x."), (" ", 1, "assistant", "y."), (None, 1, "assistant", "z.")]
    got = cr.audits(make(rows, "conv_id string, turn int, role string, text string")).collect()
    assert {r.conv_id for r in got} == {"a:b", "", " ", None}
