"""Token counts against the sentencepiece library."""

import random

import public_tokenizers
import pytest
import sentencepiece

from ledgerflow.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(3)
    out = [None, "", " ", "\0a\0", "<unk><s></s>", "▁x ▁▁ y", "the the the", "�", "🙂🙂 é"]
    out += ["".join(rng.choice("  \t\nabcdeéß中文ทя🙂▁<s>/thein0123456789") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    for n in (1, 2, 16, 17, 31, 33, 600):
        out += [" " * n, "x" + " " * n + "the", "a" * n, "ab" * n, "\n" * n, " the" * n]
    out += ["".join(rng.choice("etaoinshrdlu") for _ in range(3000)), "long words " * 30000, " " * 50001, "z" * 70000]
    return out


@pytest.mark.parametrize("window", [token_counts.WINDOW, 256])
def test_counts(make, library, window):
    texts = odd_texts() if window > 256 else [t for t in odd_texts() if t is None or len(t) < 5000]
    rows = [(None if i == 5 else i % 250, t, "n_tokens?", i) for i, t in enumerate(texts)] + [(7, "twice", "a", 1)] * 2
    docs = make(rows, "doc_id long, text string, id string, n_tokens int")
    got = sorted(map(tuple, token_counts.token_counts(docs, MODEL, limit=50, window=window).collect()), key=str)
    want = []
    for d, t, *_ in rows:
        n = len(library.encode(t or ""))
        want.append((d, len((t or "").encode()), n, n > 50))
    assert got == sorted(want, key=str)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts.op13_token_counts(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == {r.doc_id: len(library.encode(r.text or "")) for r in rows}


def test_empty_table(make):
    docs = make([], "doc_id long, text string")
    assert token_counts.token_counts(docs, MODEL).collect() == []
    assert token_counts.token_counts(docs, MODEL).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
