"""The corpus pipeline: quality filter, exact and near deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  The stages before the
last return rows of ``documents``; their result is written as Parquet and read again as
the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from ledgerflow.llm import bpe, exact_dedup, minhash, mixing, quality
from ledgerflow.session import sub_checkpoint


def quality_filter(spark, docs, sf_dir):
    """Documents that the quality classifier (operator 4) rejects go."""
    return quality.keep_good(docs)


def exact_copies(spark, docs, sf_dir):
    """Of equal texts the one with the largest id stays (operator 9)."""
    return exact_dedup.keep_one(docs)


def near_copies(spark, docs, sf_dir):
    """One document of each group of near duplicates stays (operator 5): five-word shingles, similarity 0.8 or more."""
    return minhash.keep_one(docs, n=5, percent=80)


def mix_sources(spark, docs, sf_dir):
    """Sources are mixed to their target weights (operator 6); a document taken twice is two rows."""
    return mixing.mixed_rows(docs)


def encode(spark, docs, sf_dir):
    """Token counts and digests of the byte-level BPE ids and of the decoded bytes (operator 2)."""
    return bpe.digests(docs)


STAGES = [
    ("quality", quality_filter),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# The quality classifier is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage for the table ``documents``."""
    folder = sub_checkpoint(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
