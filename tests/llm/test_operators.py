"""Operators against brute-force versions on small tables with nulls, ties, repeats and clashing names."""

import base64
import collections
import hashlib
import math
import random
import re
import sys
import zlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from ledgerflow.llm import bpe, exact_dedup, lm, minhash, mixing, pii, quality, secret_scan, suffix_dedup, tokens, topk

sys.set_int_max_str_digits(0)
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, kept string, source string"


def low(t):
    return re.sub("[A-Z]", lambda x: x[0].lower(), t or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def odd_rows():
    """Null ids and texts, empty and blank texts, a very long text, copies, repeated rows."""
    random.seed(4)
    words = ["alpha", "Beta", "gamma", "dé", "the", "of", "and", "x1", "y,", "z."]
    base = [" ".join(random.choice(words) for _ in range(random.randrange(1, 60))) for _ in range(40)]
    rows = [(i, t, "k", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, t.upper() if i % 2 else t, "k", None) for i, t in enumerate(base[:10])]
    rows += [(200 + i, t + " tail", None, "s1") for i, t in enumerate(base[:10])]
    rows += [(300, None, "a", None), (301, "", "b", "s0"), (302, " \t\n", "c", "s0"), (None, base[3], "d", "s2"), (None, None, None, None)]
    rows += [(303, "long " * 30000, "e", "s1"), rows[5], rows[5]]
    return rows


@pytest.fixture(scope="module")
def docs(make):
    return make(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def nothing(make):
    return make([], DOCS)


def test_exact_dedup(docs, nothing):
    groups = collections.defaultdict(list)
    for d, t, *_ in odd_rows():
        groups[low(t)].append(d)
    want = []
    for d, t, *_ in odd_rows():
        ids = groups[low(t)]
        top = max((i for i in ids if i is not None), default=None)
        want.append((d, top if len(ids) > 1 else d, len(ids), d == top if len(ids) > 1 else True, sha(low(t))))
    got = [tuple(r) for r in exact_dedup.decisions(docs, carry={"text_sha256": exact_dedup.full_hash()}).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)          # repeated rows leave one
    assert exact_dedup.decisions(nothing).count() == 0


def test_mixing_budgets(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd_rows())
    total = sum(r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[(r["source_size"], r["target"])].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6
    for (size, target), own in by.items():
        assert target <= 2 * size + 1e-9 and abs(sum(r["taken"] for r in own) - target) <= 0.5
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_rows(docs).columns == docs.columns


def test_secrets(make, docs, nothing):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    random.seed(1)
    bits = ["Password = ", "token:'", "AKIA", "api_key==", "abcdef0123456789", "Z9", " ", "é😀", "SECRET=", "short", "AKIAQWERTYUIOP12", "\n", "0" * 31]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randrange(0, 14)))) for i in range(300)] + [(900, None), (901, "f" * 100000)]
    texts = dict(rows)
    out = secret_scan.scan(make(rows, "doc_id long, text string")).collect()
    for r in out:
        t = texts[r["doc_id"]] or ""
        want = [(0, x.start(), x.end()) for x in assign.finditer(t) if len(x[2]) >= 8]
        want += [(1, x.start(), x.end()) for x in re.finditer("AKIA[A-Z0-9]+", t) if len(x[0]) >= 16]
        want += [(2, x.start(), x.end()) for x in re.finditer("[0-9a-f]+", t) if len(x[0]) >= 32]
        assert sorted(map(tuple, r["base"])) == sorted(want)
    assert len(out) == len(rows) and secret_scan.scan(nothing).count() == 0 and secret_scan.scan(docs).count() == len(odd_rows())


def test_secrets_finds_random_tokens(make):
    random.seed(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    planted = [(i, "see " + "".join(random.choice(letters) for _ in range(44)) + " here") for i in range(30)]
    plain = [(100 + i, "internationalizationofthings and counterrevolutionaries " + "abcabcabc" * 5) for i in range(200)]
    added = {r["doc_id"]: len(r["added"]) for r in secret_scan.scan(make(planted + plain, "doc_id long, text string")).collect()}
    assert sum(added[i] for i in range(30)) >= 27 and not any(added[100 + i] for i in range(200))


def test_secrets_finds_tokens_in_assignments_and_urls(make):
    random.seed(8)
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    frames = [("SESSION=", "+/", ""), ("auth_key=", "+/", "= end"), ("http://x.org/a?sig=", "_-", "&b=1"), ("http://x.org/api-v1/files_of/", "_-", "/raw"), ("my-own_", "+/", " end")]
    planted = {}
    for i in range(150):
        before, marks, after = frames[i % 5]
        planted[i] = (before, "".join(random.choice(plain + marks) for _ in range(43)) + random.choice(plain), after)
    rows = [(i, "see " + "".join(t)) for i, t in planted.items()]
    rows += [(1000 + i, "see /usr/share/doc-base/some_package/internationalization-guide and name_of_the_setting=internationalization") for i in range(100)]
    out = {r["doc_id"]: [(x["s"], x["e"]) for x in r["added"]] for r in secret_scan.scan(make(rows, "doc_id long, text string")).collect()}
    for k in range(5):
        whole = [any(s <= 4 + len(b) and 4 + len(b) + len(t) <= e <= 4 + len(b + t + after) for s, e in out[i]) for i, (b, t, after) in planted.items() if i % 5 == k]
        assert sum(whole) >= 24, frames[k]
    assert not any(out[1000 + i] for i in range(100))


def luhn(d):
    return sum(v * (1 + i % 2) - 9 * (v * (1 + i % 2) > 9) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def test_pii(make, docs, nothing):
    only = lambda x: re.sub("[^0-9]", "", x)
    random.seed(5)
    bits = [*"a1b2.@-+ ()0123456789%_é😀\n4444", "4111 1111 1111 1111", "a@b.co", "1.2.3.4", "+1 (555) 123-4567", "0001.02.3.255", "1 " * 40]
    rows = [(i, "".join(random.choice(bits) for _ in range(random.randrange(0, 60)))) for i in range(400)]
    rows += [(900, None), (901, "1 " * 50000), (902, "1" * 50000 + ".1.1.1")]
    texts = dict(rows)
    out = pii.find(make(rows, "doc_id long, text string")).collect()
    for r in out:
        t = texts[r["doc_id"]] or ""
        want = [(0, x.start(), x.end()) for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(1, x.start(), x.end()) for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in x[0].split("."))]
        want += [(2, x.start(), x.end()) for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(only(x[0])) <= 19 and luhn(only(x[0]))]
        want += [(3, x.start(), x.end()) for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(only(x[0])) <= 15]
        assert sorted(map(tuple, r["base"])) == sorted(want)
    assert len(out) == len(rows) and pii.find(nothing).count() == 0 and pii.find(docs).count() == len(odd_rows())


def test_bpe_round_trip(make, docs, nothing):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    bits = ["a", "é", "😀", " ", "  ", "\n", "1", "'s", "'re", "!", "日本", "\t", "　", " and", "‍"]
    rows = [(i % 90, "".join(random.choice(bits) * random.choice([1, 1, 2, 30]) for _ in range(random.randrange(0, 90)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, " " * 3000), (903, "a" * 5000)]
    small = make(rows, "doc_id long, text string")
    for chunk, overlap in ((40, 12), (64, 8)):
        back = bpe.decode(bpe.encode(small, path, pattern, chunk, overlap), path, pattern)
        got = sorted((r["doc_id"], tuple(r["ids"]), bytes(r["data"])) for r in back.collect())
        assert got == sorted((d, tuple(plain.encode_ordinary(t or "")), (t or "").encode()) for d, t in rows)
    got = sorted(map(str, bpe.digests(docs).collect()))
    want = []
    for d, t, *_ in odd_rows():
        ids = plain.encode_ordinary(t or "")
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    assert len(got) == len(want) and sorted(str(tuple(r)) for r in bpe.digests(docs).collect()) == sorted(map(str, want))
    assert bpe.digests(nothing).count() == 0


def brute_components(rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    out = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root[k] == root[i] and rows[k][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    return out


@pytest.mark.parametrize("run", [" ", "\n", " \t\n\u3000"])
def test_bpe_long_blank_runs(make, run):
    """Runs beyond the pattern engine's stack: one pre-token, the last blank of an inner run apart."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    blanks = (run * 5_000_000)[:5_000_000] if run == " " else (run * 1_200_000)[:1_200_000]
    texts = [blanks, "word" + blanks + "next " + blanks[:60_000] + "\nend"]
    got = {r.doc_id: r for r in bpe.digests(make(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def pieces(text):
        at, ids = 0, []
        for m in re.finditer("[ \t\n\u3000]{1000,}", text):
            end = m.end() - (m.end() < len(text))
            ids += library.encode_ordinary(text[at:m.start()]) + list(library._encode_single_piece(text[m.start():end]))
            at = end
        return ids + library.encode_ordinary(text[at:])

    for i, t in enumerate(texts):
        want = pieces(t)
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == sha(" ".join(map(str, want))) and got[i].decoded_sha256 == sha(t)


def test_repeated_rows_leave_one(make):
    """Four equal rows: each dedup stage keeps one, and the mix takes as many as it takes of each."""
    text = "one two three four five six seven eight nine"
    rows = [(1, text, "k", "s")] * 4 + [(None, text + " ten", "k", "s")] * 3 + [(5, "", "k", "s")] * 2 + [(6, "other words here", "k", None)]
    docs = make(rows, DOCS)
    exact = sorted(map(tuple, exact_dedup.keep_one(docs).collect()), key=str)
    assert exact == sorted(set(rows), key=str)
    near = sorted(map(tuple, minhash.keep_one(make(rows[:4] + rows[7:], DOCS)).collect()), key=str)
    assert near == sorted([rows[0], rows[9], *rows[7:9]], key=str)          # texts without words are linked with nothing
    plan = mixing.mix(docs).collect()
    assert mixing.mixed_rows(docs).count() == sum(r.copies for r in plan)


def test_minhash(docs, nothing, make):
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, brute_components(odd_rows(), 3, 85)))
    random.seed(9)  # one large chain of near copies, over several blocks
    text, rows = [f"w{i}" for i in range(80)], []
    for i in range(300):
        text[random.randrange(80)] = f"v{random.randrange(10 ** 6)}"
        rows.append((i, " ".join(text)))
    chain = minhash.near_duplicates(make(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in chain) == sorted(brute_components(rows, 3, 85))
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.keep_one(docs).columns == docs.columns


def test_topk(make):
    random.seed(2)
    vector = lambda: [random.choice([-1.5, 0.25, 0.5, 1e-3]) for _ in range(6)]
    rows = [(i, vector(), "x") for i in range(300)] + [(300, [0.5] * 3, "x"), (400, [1e30] * 6, "x"), (401, None, "x"), (402, [float("nan")] * 6, "x"),
                                                       (403, [None] * 6, "x"), (None, vector(), "x"), (500, vector(), "x")]
    rows += [(100, vector(), "x"), (100, rows[7][1], "x"), (1, vector(), "x"), (1, rows[1][1], "x"), (None, rows[9][1], "x")]
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, a) in enumerate(sound):
        if q is not None and q % 100 == 0:
            scored = [(-max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(a, b)))), i is None, i) for m, (i, b) in enumerate(sound) if m != n and len(b) == len(a)]
            best = sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:10]
            want += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(best)]
    table = make(rows, "vec_id long, embedding array<double>, rank string")
    assert sorted(map(tuple, topk.top_k(table, "vec_id % 100 = 0", shard=40, queries=2).collect()), key=str) == sorted(want, key=str)
    assert topk.top_k(make([], "vec_id long, embedding array<float>"), "true").count() == 0


def test_lm(docs, nothing):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    words = lambda t: [*WORD.findall(low(t)), None]
    count = collections.Counter(w for d, t, *_ in odd_rows() if not held(d) for w in words(t))
    total, distinct = sum(count.values()), len(count)
    want = sorted(((d is None, d or 0, held(d), len(words(t)), sum(count[w] > 0 for w in words(t)), total),
                   sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words(t))) for d, t, *_ in odd_rows())
    got = sorted(((r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4]), r[5]) for r in lm.score_documents(docs).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-6 * max(1, abs(w[1])) for g, w in zip(got, want))
    assert lm.score_documents(nothing).count() == 0


def test_lm_beats_base_on_held_out_text(spark):
    rows = lm.op7_lm(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_lm_moves_texts_once_and_keeps_slices_apart(make, spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    noise = np.random.default_rng(3).integers(33, 127, 40000, dtype=np.uint8).tobytes().decode()  # one word that does not compress
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "held_out": [False], "text": [noise], "part": pa.array([0], pa.int32())})
    asked = list(lm._ask(8, 8)(iter([batch])))
    assert sum(len(b) for b in asked) and sum(b.nbytes for b in asked) < 4000
    make([(i, f"w{i % 7} w{i % 11} w{i}") for i in range(500)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    assert sorted(lm.score_documents(stored, steady=True).collect()) == sorted(lm.score_documents(stored).collect())


def test_cut_clean_removes_its_shuffle_files(spark):
    import glob
    import time

    from ledgerflow.llm.common import SHUFFLE_CLEANUP, cut_clean

    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*.data"))
    before, setting = files(), spark.conf.get(SHUFFLE_CLEANUP, None)
    stored = cut_clean(spark.range(99999).repartition(3, "id"))
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.5)
    assert files() <= before and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    assert stored.count() == 99999


def test_log_bloom_counts():
    import numpy as np

    grams = tokens.mix(np.arange(1, 5001, dtype=np.uint64))
    counts = np.random.default_rng(1).integers(1, 3000, 5000)
    bloom = lm.LogBloom(1, 5000 * 12 * 12, 2)
    bloom.bits = bloom.segment(grams, counts)
    got = bloom.count(grams)
    assert ((got >= counts * 0.6) & (got <= counts * 1.6) | (counts < 4)).mean() > 0.97
    assert (bloom.count(tokens.mix(np.arange(10 ** 6, 10 ** 6 + 5000, dtype=np.uint64))) > 0).mean() < 0.03


def test_lm_keeps_words_and_pairs_seen_once(make):
    # half the documents are one text of words that occur nowhere else, half are the same words in another order
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    seen = [(i, f"ant{i} bee{i} cat{i} dog{i} elk{i} fox{i}") for i in train]
    held = [i for i in range(400, 4000) if zlib.crc32(str(i).encode()) % 10 == 0][:len(train)]
    known = [(h, t) for h, (_, t) in zip(held, seen)]
    mixed = [(h + 10 ** 6, " ".join(reversed(t.split()))) for h, t in known]
    mixed = [(d, t) for d, t in mixed if zlib.crc32(str(d).encode()) % 10 == 0]
    new = [(d, " ".join(f"new{d}x{k}" for k in range(6))) for d in range(2 * 10 ** 6, 2 * 10 ** 6 + 300) if zlib.crc32(str(d).encode()) % 10 == 0]
    score = {r["doc_id"]: r["score"] for r in lm.score_documents(make(seen + known + mixed + new, "doc_id long, text string")).collect()}
    mean = lambda rows: sum(score[d] for d, _ in rows) / len(rows)
    assert mean(known) > mean(mixed) + 5 and mean(mixed) > mean(new) + 2


def test_lm_filter_holds_every_count(make):
    import numpy as np

    assert lm.MIN_COUNT == 1 and not hasattr(lm, "MAX_BITS")
    grams = tokens.mix(np.arange(1, 5001, dtype=np.uint64))
    bloom = lm.LogBloom(1, 5000 * 14, lm.MIN_COUNT)
    bloom.bits = bloom.segment(grams, np.ones(5000, np.int64))
    assert (bloom.count(grams) >= 1).all()


def test_suffix_dedup(make, docs, nothing):
    def brute(rows, length):
        bodies = [(d, (t or "").encode()) for d, t, *_ in rows]
        seen = collections.Counter(b[i:i + length] for _, b in bodies for i in range(len(b) - length + 1))
        for d, b in bodies:
            gone = bytearray(len(b))
            for i in range(len(b) - length + 1):
                if seen[b[i:i + length]] > 1:
                    gone[i:i + length] = b"\1" * length
            spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
            yield str((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))

    random.seed(2)
    passages = ["".join(random.choice("abé") for _ in range(random.randrange(20, 80))) for _ in range(8)]
    rows = [(i % 100, "".join(random.choice(passages) if random.random() < 0.3 else "".join(random.choice("abcdé ") for _ in range(random.randrange(1, 30)))
                              for _ in range(random.randrange(0, 12)))) for i in range(110)] + [(900, None), (901, "a" * 300), (None, "ab" * 60)]
    table = make(rows, "doc_id long, text string")
    want = sorted(brute(rows, 24))
    limit, suffix_dedup.GROUP = suffix_dedup.GROUP, 4
    try:  # owners are split
        assert sorted(str(tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r))) for r in suffix_dedup.remove_repeats(table, 24, 8).collect()) == want
    finally:
        suffix_dedup.GROUP = limit
    assert sorted(str(tuple(map(lambda x: bytes(x) if isinstance(x, bytearray) else x, r))) for r in suffix_dedup.remove_repeats(table, 24, 8).collect()) == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0 and suffix_dedup.remove_repeats(docs).count() == len(odd_rows())


def test_quality_against_labels(spark, docs, nothing):
    folder = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality.op4_quality(spark, folder).collect() if r["doc_id"] in label]
    assert sum(r["kept"] == bool(label[r["doc_id"]]) for r in rows) >= 0.98 * len(rows)
    assert all(r["kept"] for r in rows if label[r["doc_id"]])
    odd = quality.classify(docs).collect()
    assert len(odd) == len(odd_rows()) and all(not r["kept"] for r in odd if r["n_words"] == 0)
    assert quality.classify(nothing).count() == 0 and quality.keep_good(docs).columns == docs.columns


def test_quality_sees_repeated_sentences_of_any_length(make):
    random.seed(9)
    words = ["".join(random.choice("abcdefghiklmnoprstu") for _ in range(random.randrange(2, 9))) for _ in range(3000)]
    sentence = lambda: " ".join(random.choice(words) for _ in range(random.randrange(6, 14))).capitalize() + "."
    clean = [(i, " ".join(sentence() for _ in range(random.choice([8, 30, 120, 700])))) for i in range(400)]
    again = [(1000 + i, " ".join([sentence()] * random.choice([30, 200, 900]))) for i in range(80)]
    rows = {r["doc_id"]: r for r in quality.classify(make(clean + again, "doc_id long, text string")).collect()}
    assert max(rows[d]["n_words"] for d, _ in again) > 5000 and max(rows[d]["n_words"] for d, _ in clean) > 5000
    assert all(rows[d]["kept"] for d, _ in clean) and not any(rows[d]["kept"] for d, _ in again)


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns, name
        assert kept.exceptAll(docs).count() == 0 and kept.count() > 0
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    texts = {r["doc_id"]: sha(r["text"] or "") for r in docs.collect()}
    rows = out.collect()
    assert rows and all(texts[r["doc_id"]] == r["decoded_sha256"] for r in rows)
