"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each level looks closer at the rows that the level before could not tell apart.  The
survivors of a level are handed on as a bitmap of fixed size, so a scan can decide per
row whether the next, dearer fingerprint is needed, and no text is ever shuffled: only
(length, hash) rows are grouped.  A false positive of a bitmap costs one more hash and
never changes a result, because rows are grouped by the full hash in the end.

Defined results: a null text is the empty text; the empty texts form one group; a null id
never wins against an id, and a group whose ids are all null keeps all its rows; rows that
repeat an id are rows of their own, and all rows that carry the winning id of a group are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerflow.llm.common import bitmap, cut, lower_ascii, may_hold, spread_join, text_of

PREFIX_CHARS = 64


def full_hash(text: str = "text") -> Column:
    return F.sha2(lower_ascii(text_of(text)), 256)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, and the ``carry`` columns.

    ``carry`` maps a column name to an expression over ``docs`` that is evaluated in the
    last scan and travels with the row.
    """
    twin = _twin(docs, text_col)
    groups = (docs.filter(twin).select(F.col(f"`{id_col}`").alias("i"), full_hash(text_col).alias("h"))
              .groupBy("h").agg(F.max("i").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .filter("group_size > 1"))
    return _decided(docs, twin, groups, id_col, text_col, carry or {}).drop("h")


def _twin(docs: DataFrame, text_col: str) -> Column:
    """True for every text that another one equals, by length and by a hash of its prefix, and for a few others."""
    length = F.octet_length(text_of(text_col))  # folding A-Z keeps the length
    prefix = F.xxhash64(length, lower_ascii(F.substring(text_of(text_col), 1, PREFIX_CHARS)))

    lengths = docs.select(length.alias("n")).groupBy("n").count().filter("count > 1")
    same_length = bitmap(lengths, "n")

    prefixes = (docs.filter(may_hold(same_length, length)).select(prefix.alias("p"))
                .groupBy("p").count().filter("count > 1"))
    same_prefix = bitmap(prefixes, "p")

    return may_hold(same_length, length) & may_hold(same_prefix, prefix)


def _decided(docs: DataFrame, twin: Column, groups: DataFrame, id_col: str, text_col: str, carry: dict[str, Column]) -> DataFrame:
    # rows without a twin get a key of their own, so that they spread over the join's tasks
    alone = F.concat(F.lit("alone "), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.when(twin, full_hash(text_col)).otherwise(alone).alias("h"),
                       F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("carried"))
    out = spread_join(rows, groups, ["h"], "left")
    found = F.col("group_size").isNotNull()
    return out.select(
        "h", "doc_id",
        F.when(found, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(found, F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        *[F.col(f"carried.`{k}`").alias(k) for k in carry])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were: one row of each group of
    equal texts, also where rows repeat with their id or have none."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    twin = _twin(docs, text_col)
    ids = (docs.filter(twin).select(F.col(f"`{id_col}`").alias("i"), full_hash(text_col).alias("h"))
           .groupBy("h", "i").agg(F.count(F.lit(1)).alias("n")))
    best = F.max_by("n", F.struct(F.col("i").isNotNull(), "i")).alias("n_kept")
    groups = cut(ids.groupBy("h").agg(F.max("i").alias("keep_id"), F.sum("n").alias("group_size"), best).filter("group_size > 1"))
    kept = _decided(docs, twin, groups.drop("n_kept"), id_col, text_col, {"whole_row": whole}).filter("kept")
    again = groups.filter("n_kept > 1").select("h")          # the row that stays is there more than once
    if again.isEmpty():
        return kept.select("whole_row.*")
    first = W.partitionBy("h").orderBy(F.xxhash64("whole_row"))
    one = kept.join(again, "h", "left_semi").withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return kept.join(again, "h", "left_anti").select("whole_row.*").unionByName(one.select("whole_row.*"))


def op9_exact_dedup(spark, sf_dir):
    from ledgerflow.llm.common import table

    return decisions(table(spark, sf_dir, "documents"), carry={"text_sha256": full_hash()})


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256
      FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents))
"""
