"""Mixing sources to target weights by exact word budgets.

1. Every document gets a hash-random key (a digest of its id and a seed).
2. Sources are ranked by code point (null last); the ranks give the weights.  The targets
   share ``budget`` times all words by weight, none above ``cap`` times its source's words;
   what a capped source cannot take is shared again by weight among the others.
3. Documents are range-sorted by (source, key) and get the number of words of their source
   that come before them (a distributed prefix sum, see ``ordered_prefix``).
4. A source is read in epochs: whole passes first, then the documents up to the exact rest.
   ``taken`` counts the words, so the sum per source is its target to the word; the last
   document of a source may be taken in part.

Defined results: a null text has size 0; a null source is a source of its own, ranked
last; documents of equal key are ordered by id, then size; an empty table gives an empty
result; a source without words has target 0.  A rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerflow.llm.common import WORD, cut, ordered_prefix, text_of

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
                   cap: int = CAP) -> DataFrame:
    """source, source_rank, source_size, target for ``totals`` (source, source_size).

    In the order of cap per weight, the capped sources come first.  Source i is capped if
    its cap per weight is at most the level that the sources from i on would share, and the
    last level of that kind is the level of all sources that are not capped.
    """
    ranked = ordered_prefix(totals.withColumn("_null", F.col("source").isNull().cast("int"))
                            .withColumn("_one", F.lit(1)), [], ["_null", "source"], {"source_rank": "_one"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = (ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
              .withColumn("level_cap", F.col("most") / F.col("weight")).drop("_null", "_one"))
    ranked = cut(ranked)
    whole = ranked.agg((F.sum("source_size") * F.lit(budget)).alias("all_words"), F.sum("weight").alias("all_weight"))
    whole = whole.select(F.struct("all_words", "all_weight").alias("x")).scalar()
    steps = ordered_prefix(ranked, [], ["level_cap", "source_rank"], {"most_before": "most", "weight_before": "weight"})
    level = (whole["all_words"] - F.col("most_before")) / (whole["all_weight"] - F.col("weight_before"))
    steps = cut(steps.withColumn("capped", F.col("level_cap") <= level))
    left = steps.filter("capped").agg(F.coalesce(F.sum("most"), F.lit(0)).alias("m"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w"))
    left = left.select(F.struct("m", "w").alias("x")).scalar()
    shared = (whole["all_words"] - left["m"]) / F.nullif(whole["all_weight"] - left["w"], F.lit(0))
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("weight") * shared))
    return steps.select("source", "source_rank", "source_size", target.alias("target"))


def mix(docs: DataFrame, carry: dict[str, Column] | None = None, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS,
        budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, and the ``carry`` columns, per document.

    ``taken`` are the words the mix takes.  ``copies`` are whole documents: the epochs, plus
    one if the rest takes at least half of the document.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = cut(docs.select("doc_id", "source", word_count().alias("size"), key.alias("_key"),
                            F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in (carry or {}).items()]).alias("_carried")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, budget, cap).withColumnRenamed("source", "_source")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    rows = ordered_prefix(rows, ["source_rank"], ["_key", "doc_id", "size"], {"before": "size"})
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round("target").cast("long") - epochs * F.col("source_size")
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    copies = epochs + F.when((extra > 0) & (extra * 2 >= F.col("size")), 1).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + extra).alias("taken"),
                       copies.alias("copies"), *[F.col(f"_carried.`{k}`").alias(k) for k in (carry or {})])


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of the mix, whole documents only, each as often as it is taken.

    Rows that repeat in all columns are taken one by one; together they appear as often as
    the mix takes each of them."""
    row_key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    plan = mix(docs, {"row_key": row_key}).groupBy("doc_id", "row_key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    plan = plan.filter("copies > 0").select(F.col("doc_id").alias("_mix_id"), F.col("row_key").alias("_mix_key"),
                                            F.col("copies").alias("_mix_copies"), F.col("rows").alias("_mix_rows"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_mix_row"), row_key.alias("_mix_own"))
    taken = packed.join(plan, (F.col("_mix_own") == F.col("_mix_key")) & F.col("_mix_row.doc_id").eqNullSafe(F.col("_mix_id")))
    first = W.partitionBy("_mix_own", "_mix_id").orderBy("_mix_copies")
    again = taken.filter("_mix_rows > 1").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    every = taken.filter("_mix_rows = 1").unionByName(again)
    return every.select(F.explode(F.array_repeat("_mix_row", F.col("_mix_copies").cast("int"))).alias("r")).select("r.*")


def op6_mixing(spark, sf_dir):
    from ledgerflow.llm.common import table

    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
rk AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM tot),
w AS (SELECT *, [3, 1, 2][(r % 3 + 1)::INT] AS weight, source_size * 2 AS most FROM rk),
lv AS (SELECT *, most::DOUBLE / weight AS level_cap, (SELECT sum(source_size) * 1.5::DOUBLE FROM w) AS t,
              (SELECT sum(weight) FROM w) AS ws FROM w),
st AS (SELECT *, coalesce(sum(most) OVER q, 0) AS mb, coalesce(sum(weight) OVER q, 0) AS wb FROM lv
       WINDOW q AS (ORDER BY level_cap, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cp AS (SELECT *, level_cap <= (t - mb)::DOUBLE / (ws - wb) AS capped FROM st),
sh AS (SELECT max(t) - coalesce(sum(most) FILTER (capped), 0) AS words,
              max(ws) - coalesce(sum(weight) FILTER (capped), 0) AS weights FROM cp),
tg AS (SELECT source, source_size,
              CASE WHEN capped THEN most::DOUBLE
                   ELSE least(most::DOUBLE, weight * (sh.words::DOUBLE / nullif(sh.weights, 0)::DOUBLE)) END AS target
       FROM cp, sh),
pos AS (SELECT s.doc_id, s.size, g.source_size, g.target,
               coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
               CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END AS epochs
        FROM sized s JOIN tg g ON s.source IS NOT DISTINCT FROM g.source),
cut AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before))::BIGINT AS extra FROM pos)
SELECT doc_id, size, source_size, target, (epochs * size + extra)::BIGINT AS taken,
       (epochs + CASE WHEN extra > 0 AND extra * 2 >= size THEN 1 ELSE 0 END)::BIGINT AS copies
FROM cut
"""
