"""Exact top-k inner-product search: a ball tree per shard, branch and bound.

* Vectors are hashed to shards of about ``SHARD`` rows.  A task reads a shard's vectors,
  builds a ball tree (centre and radius per node) and then streams the queries sent to it.
* For a node with centre c and radius r no vector scores above q.c + r|q|.  The search
  descends into the child with the larger bound first and leaves out a node whose bound is
  below the current k-th score.  Queries that agree on the order go together.
* The k-th score is shared: first each query is searched in its home shard only, and the
  k-th score found there goes with the query to all other shards as its starting limit.
* A shard returns at most k rows a query, and none below the limit.  Ties are kept: a node
  is left out only if its bound is strictly below the limit.

Queries go to the shards in blocks of bounded size.  Components are scaled to integers;
scores are exact (float64 products while they stay below 2^53, Python integers beyond).

Rows are numbered in the order of their ids, so the search itself never compares ids.

Defined results: vectors that are null or hold a null or non-finite component take no
part; rows that repeat an id are rows of their own, and a query leaves out only its own
row; a row without an id is no query and, on ties, comes behind those with one; vectors
meet only vectors of their own length; fewer than k candidates are all returned; scores
beyond 64 bits count as the nearest 64-bit number; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerflow.llm.common import cut, ship, shuffle_parts, table

SHARD, QUERIES, LEAF, K, SCALE = 1024, 16384, 64, 10, 1024
EXACT = float(1 << 53)
TOP, LOW = (1 << 63) - 1, -(1 << 63)


class BallTree:
    """Balls over the rows of an integer-valued matrix; leaves are index arrays."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows, self.centres, self.radii, self.children, self.leaves = rows, [], [], [], []
        self._grow(np.arange(len(rows)), leaf)
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def _grow(self, index: np.ndarray, leaf: int) -> int:
        node, points = len(self.children), self.rows[index]
        centre = points.mean(axis=0)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())))
        self.children.append(None)
        self.leaves.append(index)
        if len(index) > leaf and self.radii[node] > 0:
            axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            order = np.argsort(points[:, axis], kind="stable")
            half = len(index) // 2
            self.children[node] = (self._grow(index[order[:half]], leaf), self._grow(index[order[half:]], leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, nodes x queries, with room for rounding."""
        norm = np.sqrt((queries ** 2).sum(axis=1))
        reach = np.sqrt((self.centres ** 2).sum(axis=1)) + self.radii
        return self.centres @ queries.T + np.outer(self.radii, norm) + 1e-9 * np.outer(reach, norm) + 1e-6


class Best:
    """The k best (score, id) of each query so far, larger scores and smaller ids first."""

    def __init__(self, limits: np.ndarray, k: int):
        self.scores = np.full((len(limits), k), -np.inf)
        self.ids = np.full((len(limits), k), np.iinfo(np.int64).max)
        self.limits = limits.copy()

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = (scores >= self.limits[who][:, None]).any(axis=1) & np.isfinite(scores).any(axis=1)
        if not some.any():
            return
        who, scores = who[some], scores[some]
        s = np.hstack([self.scores[who], scores])
        i = np.hstack([self.ids[who], np.broadcast_to(ids, scores.shape)])
        order = np.lexsort((i, -s), axis=1)[:, :self.scores.shape[1]]
        self.scores[who] = np.take_along_axis(s, order, axis=1)
        self.ids[who] = np.take_along_axis(i, order, axis=1)
        self.limits[who] = np.maximum(self.limits[who], self.scores[who][:, -1])


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
    bound = tree.bounds(queries)

    def visit(node: int, who: np.ndarray) -> None:
        who = who[bound[node, who] >= best.limits[who]]
        if not len(who):
            return
        if tree.children[node] is None:
            rows = tree.leaves[node]
            scores = queries[who] @ tree.rows[rows].T
            scores[query_ids[who][:, None] == ids[rows][None, :]] = -np.inf
            best.add(who, scores, ids[rows])
            return
        left, right = tree.children[node]
        first = bound[left, who] >= bound[right, who]
        for near, far, part in ((left, right, who[first]), (right, left, who[~first])):
            if len(part):
                visit(near, part)
                visit(far, part)

    visit(0, np.arange(len(queries)))


def big_search(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, limit: float, k: int) -> list[tuple[int, int]]:
    """The k best by whole numbers of any size, for vectors whose products pass 2^53."""
    q = [int(x) for x in query]
    scored = [(min(max(sum(a * int(b) for a, b in zip(q, r, strict=True)), LOW), TOP), int(i)) for r, i in zip(rows, ids, strict=True) if i != query_id]
    return sorted(((s, i) for s, i in scored if s >= limit), key=lambda x: (-x[0], x[1]))[:k]


def _shard_task(k: int, scale: int):
    def answer(vectors: list, ids: list, batch: list[tuple]) -> pa.RecordBatch:
        q_ids = np.array([r[0] for r in batch], np.int64)
        queries = np.floor(np.array([r[1] for r in batch], np.float64).reshape(len(batch), -1) * scale)
        limits = np.array([-np.inf if r[2] is None else float(r[2]) for r in batch])
        rows, row_ids, tree = vectors
        out: list[tuple[int, int, int]] = []
        most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
        if most < EXACT:
            best = Best(limits, k)
            search(tree, row_ids, queries, q_ids, best)
            for a in range(len(batch)):
                for s, i in zip(best.scores[a], best.ids[a], strict=True):
                    if s > -np.inf and s >= limits[a]:
                        out.append((int(q_ids[a]), int(i), int(s)))
        else:
            for a in range(len(batch)):
                out += [(int(q_ids[a]), i, s) for s, i in big_search(rows, row_ids, queries[a], q_ids[a], limits[a], k)]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, shard, waiting = None, [], [], None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("dim", "shard", "block", "is_query", "vec_id", "vec", "least")]
            for dim, number, block, is_query, vec_id, vec, least in zip(*columns, strict=True):
                if (dim, number, block) != key:
                    if waiting:
                        yield answer(shard, ids, waiting)
                    key, ids, rows, shard, waiting = (dim, number, block), [], [], None, []
                if not is_query:
                    ids.append(vec_id)
                    rows.append(vec)
                    continue
                if shard is None and ids:
                    matrix = np.floor(np.array(rows, np.float64).reshape(len(rows), -1) * scale)
                    shard = (matrix, np.array(ids, np.int64), BallTree(matrix))
                    rows = []
                if shard is not None:
                    waiting.append((vec_id, vec, least))
                    if len(waiting) >= 1024:
                        yield answer(shard, ids, waiting)
                        waiting = []
            if waiting:
                yield answer(shard, ids, waiting)
                waiting = []
    return run


def _ask(vectors: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    """Query rows (dim, shard, block, vec_id, vec, least) against the vectors of their shard."""
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    stored = vectors.select("dim", "shard", F.explode(blocks).alias("block"), F.lit(False).alias("is_query"), "vec_id", "vec", F.lit(None).cast("long").alias("least"))
    rows = stored.union(queries.select("dim", "shard", "block", F.lit(True), "vec_id", "vec", "least"))
    keys = ["dim", "shard", "block"]
    rows = rows.repartition(shuffle_parts(vectors.sparkSession), *keys).sortWithinPartitions(*keys, "is_query")
    return rows.mapInArrow(_shard_task(k, scale), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          scale: int = SCALE, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row of ``vectors`` that meets
    the SQL condition ``is_query`` over vec_id, the row itself left out."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec").isNotNull() & sound).withColumn("asks", F.coalesce(F.expr(is_query), F.lit(False)) & F.col("vec_id").isNotNull())
    # numbers that rise with the id (nulls last); stored, so that no task can number the rows anew
    order = [F.asc_nulls_last("vec_id"), F.xxhash64("vec")]
    rows = rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    names = rows.select("row", "vec_id")
    rows = rows.drop("vec_id").withColumnRenamed("row", "vec_id")      # from here on a row's number stands for its id
    # one entry per vector length: its shards and its blocks of queries
    plan = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"),
                                   F.ceil((F.count_if("asks") + 1) / queries).cast("int").alias("blocks"))
    plan = plan.agg(F.map_from_entries(F.collect_list(F.struct("dim", F.struct("shards", "blocks")))).alias("m")).scalar()
    rows = rows.withColumn("plan", F.element_at(plan, F.col("dim"))).select("vec_id", "vec", "dim", "asks", "plan.*")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    asked = rows.filter("asks").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"))

    home = cut(_ask(rows, asked.withColumn("least", F.lit(None).cast("long")), k, scale))
    limit = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    others = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != F.col("shard"))
    again = asked.join(limit, asked["vec_id"] == limit["query_id"], "left").withColumn("shard", F.explode(others))
    away = _ask(rows, again, k, scale)

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = home.union(away).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    best = best.join(names.select(F.col("row").alias("vec_id"), F.col("vec_id").alias("_found")), "vec_id")
    best = best.join(names.select(F.col("row").alias("query_id"), F.col("vec_id").alias("_asked")), "query_id")
    return best.select(F.col("_asked").alias("query_id"), "rank", F.col("_found").alias("vec_id"), "score")


def op1_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS e, len(embedding) AS n
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id,
         CASE WHEN q.n = 0 THEN 0
              ELSE list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) END::BIGINT AS score
  FROM v q JOIN v c ON q.n = c.n AND q.id <> c.id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
