"""Hard-negative mining: anchors in clusters share one sorted candidate list.

* Anchors are clustered by angle.  Up to ``SAMPLE`` anchors give the centres (spherical
  k-means, about ``MEMBERS`` anchors a centre); then every anchor is assigned, and each
  cluster knows the widest angle ``theta`` between its centre and a member.
* Candidates lie in hash shards of about ``SHARD`` rows.  A shard that meets a cluster
  sorts its rows once by what they can score against any unit vector of the cluster:
  |x| cos(max(0, angle(x, centre) - theta)).  All members walk this list block by block.
* A member stops as soon as the next row's bound times the member's length is below the
  last score it still needs (its k-th best so far, or the least score it accepts).  The
  bound has room for rounding and ties go on, so stopping loses nothing.
* Two rounds: the best rows of the same label (shards by label), then, for each positive,
  the best rows of other labels inside the band of scores that the positive allows.

Stored rows go to the shards once per block of anchors, anchors once per shard, in blocks
of bounded size; a cluster larger than a block is split.  Scores are exact: float64
products while they stay below 2^53, Python integers beyond, on the same walk.

Defined results: rows with a null label or vector or a null or non-finite component take
no part; rows are told apart by a number of their own, so repeated ids are rows of their
own, a row without an id is no anchor, and on ties comes behind those with one; vectors
meet only vectors of their own length; with fewer rows than asked for all are returned;
scores beyond 64 bits count as the nearest 64-bit number; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerflow.llm.common import cut, ship, shuffle_parts, spread_join, table

SHARD, BLOCK, SAMPLE, MEMBERS, ROUNDS, SMALL = 8192, 8192, 8192, 64, 8, 1 << 16
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
EXACT, SLACK = float(1 << 53), 1e-6
TOP, BOTTOM = (1 << 63) - 1, -(1 << 63)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows ** 2).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=(size > 0) & np.isfinite(size))


def _scaled(vectors: list, scale: int) -> np.ndarray:
    return np.floor(np.array(vectors, np.float64).reshape(len(vectors), -1) * scale)


def centres(vectors: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means, started from rows far from each other."""
    points = _unit(vectors)
    chosen, near = [0], points @ points[0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, points @ points[chosen[-1]])
    middle = points[chosen]
    for _ in range(rounds):
        nearest = np.argmax(points @ middle.T, axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, nearest, points)
        middle = np.where((sums != 0).any(axis=1, keepdims=True), _unit(sums), middle)
    return middle


class Shard:
    """Stored rows in the order that breaks ties, and one sorted list per cluster."""

    def __init__(self, rows: list[tuple], scale: int):
        rows.sort(key=lambda r: (r[1] is None, r[1] or 0, r[0]))
        self.rid = np.array([r[0] for r in rows], np.int64)
        self.vec_id = [r[1] for r in rows]
        self.label = np.array([r[2] for r in rows], np.int64)
        self.vectors = _scaled([r[3] for r in rows], scale)
        self.size = np.sqrt((self.vectors ** 2).sum(axis=1))
        self.units = _unit(self.vectors)
        self.most = np.abs(self.vectors).max(initial=0) * max(1, self.vectors.shape[1])
        self.lists: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, key: tuple, centre: np.ndarray | None, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows by falling bound, their bounds and -inf behind the last)."""
        if key not in self.lists:
            cosine = np.ones(len(self.size))
            if centre is not None:
                angle = np.arccos(np.clip(self.units @ centre, -1, 1))
                cosine = np.cos(np.maximum(0, angle - theta))
            with np.errstate(invalid="ignore"):
                bound = self.size * (cosine + SLACK)
            bound[np.isnan(bound)] = np.inf
            order = np.argsort(-bound, kind="stable")
            self.lists = {key: (order, np.append(bound[order], -np.inf))}   # clusters come one after the other
        return self.lists[key]

    def scores(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if np.abs(queries).max(initial=0) * self.most < EXACT:
            return (queries @ self.vectors[rows].T).astype(np.int64)
        whole = [[[int(x) for x in r] for r in m] for m in (queries, self.vectors[rows])]
        return np.array([[min(max(sum(a * b for a, b in zip(q, r, strict=True)), BOTTOM), TOP) for r in whole[1]] for q in whole[0]],
                        np.int64).reshape(len(queries), len(rows))


def walk(shard: Shard, key: tuple, centre: np.ndarray | None, theta: float, queries: np.ndarray, rids: np.ndarray, labels: np.ndarray,
         low: np.ndarray, high: np.ndarray, same: bool, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, row, score): the k best rows of each slot of each query; ``low`` and ``high`` are queries x slots."""
    order, bound = shard.sorted_list(key, centre, theta)
    slots = low.shape[1]
    length = np.sqrt((queries ** 2).sum(axis=1))
    need = low.copy()                                    # the least score a slot still takes
    slot, row, score = (np.zeros(0, np.int64) for _ in range(3))
    live, at = np.arange(len(queries)), 0
    while len(live) and at < len(order):
        rows = order[at:at + block]
        s = shard.scores(queries[live], rows)
        fits = (shard.label[rows][None, :] == labels[live][:, None]) == same
        fits &= shard.rid[rows][None, :] != rids[live][:, None]
        found = [(slot, row, score)]
        for j in range(slots):
            q, c = np.nonzero(fits & (s >= need[live, j][:, None]) & (s <= high[live, j][:, None]))
            found.append((live[q] * slots + j, rows[c], s[q, c]))
        if any(len(f[0]) for f in found[1:]):
            slot, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((row, -score.astype(np.float64) if abs(score).max() < EXACT else _falling(score), slot))
            slot, row, score = slot[by], row[by], score[by]
            start = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
            rank = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
            slot, row, score, rank = (x[rank < k] for x in (slot, row, score, rank))
            full = rank == k - 1
            need[slot[full] // slots, slot[full] % slots] = score[full]
        at += block
        with np.errstate(invalid="ignore"):
            reach = length[live] * bound[min(at, len(order))] + 1
        live = live[~(reach[:, None] < need[live].astype(np.float64)).all(axis=1)]
    return slot, row, score


def _falling(score: np.ndarray) -> np.ndarray:
    """Ranks by falling score for whole numbers beyond float64."""
    return np.unique(~score, return_inverse=True)[1]


def _search(middle, same: bool, k: int, scale: int):
    """Task over the rows of shards, stored ones first, then the anchors by cluster."""
    names = ["anchor", "slot_score", "rid", "vec_id", "score"]

    def answer(shard: Shard, key: tuple, members: list[tuple]) -> pa.RecordBatch:
        dim, cluster = key
        centre = middle.value.get((dim, cluster))
        queries = _scaled([m[3] for m in members], scale)
        rids, labels = np.array([m[0] for m in members], np.int64), np.array([m[2] for m in members], np.int64)
        theta = members[0][4]
        bands = [m[5] if m[5] is not None else [None] for m in members]
        width = max(len(b) for b in bands)
        low, high = np.full((len(members), width), TOP), np.full((len(members), width), BOTTOM)   # accepts nothing
        for i, band in enumerate(bands):
            for j, positive in enumerate(band):
                low[i, j] = BOTTOM if positive is None else -(-LOW * positive // 100)
                high[i, j] = TOP if positive is None else HIGH * positive // 100
        slot, row, score = walk(shard, key, centre, theta, queries, rids, labels, low, high, same, k)
        who = slot // width
        return pa.RecordBatch.from_arrays([
            pa.array(rids[who]), pa.array([bands[w][j] for w, j in zip(who.tolist(), (slot % width).tolist(), strict=True)], pa.int64()),
            pa.array(shard.rid[row]), pa.array([shard.vec_id[r] for r in row.tolist()], pa.int64()), pa.array(score)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, cluster, stored, shard, members = None, None, [], None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("dim", "bucket", "shard", "block", "is_query", "cluster", "rid", "vec_id", "label", "vec", "theta", "bands")]
            for dim, bucket, number, block, is_query, group, rid, vec_id, label, vec, theta, bands in zip(*columns, strict=True):
                if members and ((dim, bucket, number, block) != place or group != cluster or len(members) >= 1024):
                    yield answer(shard, (place[0], cluster), members)
                    members = []
                if (dim, bucket, number, block) != place:
                    place, stored, shard = (dim, bucket, number, block), [], None
                if not is_query:
                    stored.append((rid, vec_id, label, vec))
                    continue
                if shard is None and stored:
                    shard, stored = Shard(stored, scale), []
                if shard is not None:
                    cluster = group
                    members.append((rid, vec_id, label, vec, theta, bands))
        if members:
            yield answer(shard, (place[0], cluster), members)
    return run


def _lookup(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Join to a grouped table whose keys may be very frequent in ``rows``: by broadcast if it is
    counted to be small, so that no row moves; else by a join that splits frequent keys."""
    few = cut(few)
    return rows.join(F.broadcast(few), on) if few.count() <= SMALL else spread_join(rows, few, on)


def _shards(rows: DataFrame, bucket: Column, shard: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their bucket and shard, and the number of shards of each bucket."""
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    placed = _lookup(rows, counts, ["dim", "bucket"]).withColumn("shard", F.pmod(F.xxhash64("rid"), F.col("shards")).cast("int"))
    return placed.drop("shards"), counts


def _ask(rows: DataFrame, anchors: DataFrame, bucket: str | None, middle, k: int, scale: int, shard: int) -> DataFrame:
    """anchor, slot_score, rid, vec_id, score: the best rows of each shard.

    ``bucket`` names the column that shards are kept apart by; with it rows of the same
    label are searched, without it rows of other labels.
    """
    key = F.col(bucket) if bucket else F.lit(0).cast("long")
    stored, counts = _shards(rows, key, shard)
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    used = anchors.withColumn("bucket", key).groupBy("dim", "bucket").agg(F.max("blocks").alias("blocks"))
    stored = _lookup(stored, used, ["dim", "bucket"]).select(
        "dim", "bucket", "shard", blocks, F.lit(False).alias("is_query"), F.lit(None).cast("int").alias("cluster"), "rid", "vec_id", "label", "vec",
        F.lit(None).cast("double").alias("theta"), F.lit(None).cast("array<long>").alias("bands"))
    asked = _lookup(anchors.withColumn("bucket", key), counts, ["dim", "bucket"]).select(
        "dim", "bucket", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", F.lit(True).alias("is_query"), "cluster", "rid",
        "vec_id", "label", "vec", "theta", "bands")
    keys = ["dim", "bucket", "shard", "block"]
    both = stored.union(asked).repartition(shuffle_parts(rows.sparkSession), *keys).sortWithinPartitions(*keys, "is_query", "cluster")
    return both.mapInArrow(_search(middle, bucket is not None, k, scale), "anchor long, slot_score long, rid long, vec_id long, score long")


def _fit(members: int, sample: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for dim, vec in zip(batch.column("dim").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                rows.setdefault(dim, []).append(vec)
        for dim, vectors in rows.items():
            if dim:
                found = centres(_scaled(vectors, scale), -(-len(vectors) // members))
                yield pa.RecordBatch.from_pylist([{"dim": dim, "cluster": i, "centre": c.tolist()} for i, c in enumerate(found)],
                                                 pa.schema([("dim", pa.int32()), ("cluster", pa.int32()), ("centre", pa.list_(pa.float64()))]))
    return run


def _assign(middle, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, tuple[list[int], np.ndarray]] = {}
        for (dim, cluster), centre in middle.value.items():
            packed.setdefault(dim, ([], []))
            packed[dim][0].append(cluster)
            packed[dim][1].append(centre)
        for batch in batches:
            dims, vectors = batch.column("dim").to_pylist(), batch.column("vec").to_pylist()
            cluster, angle = np.full(len(dims), -1, np.int32), np.full(len(dims), np.pi)
            for dim in set(dims) & set(packed):
                mine = np.flatnonzero(np.array(dims) == dim)
                cosine = _unit(_scaled([vectors[i] for i in mine], scale)) @ np.array(packed[dim][1]).T
                best = np.argmax(cosine, axis=1)
                cluster[mine] = np.array(packed[dim][0])[best]
                angle[mine] = np.arccos(np.clip(cosine[np.arange(len(mine)), best], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(cluster), pa.array(angle)], ["rid", "cluster", "angle"])
    return run


def clustered(anchors: DataFrame, members: int = MEMBERS, sample: int = SAMPLE, block: int = BLOCK, scale: int = SCALE):
    """Anchors with cluster, theta, block and blocks, and the broadcast centres (at most one per ``members`` sampled anchors)."""
    spark = anchors.sparkSession
    some = anchors.select("dim", "vec", "rid").orderBy(F.xxhash64("rid"), "rid").limit(sample)
    found = some.repartition(1).mapInArrow(_fit(members, sample, scale), "dim int, cluster int, centre array<double>").collect()
    middle = spark.sparkContext.broadcast({(r.dim, r.cluster): np.array(r.centre) for r in found})
    placed = anchors.join(anchors.select("rid", "dim", "vec").mapInArrow(_assign(middle, scale), "rid long, cluster int, angle double"), "rid")
    placed = cut(placed)
    sizes = placed.groupBy("dim", "cluster").agg((F.max("angle") + 1e-6).alias("theta"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    blocks = placed.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = _lookup(_lookup(placed, sizes, ["dim", "cluster"]), blocks, ["dim"])
    part = F.pmod(F.xxhash64("rid", F.lit(1)), F.col("parts"))
    return cut(placed.withColumn("block", F.pmod(F.xxhash64("cluster", part), F.col("blocks")).cast("int")).drop("angle", "parts")), middle


def hard_negatives(vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", id_col: str = "vec_id", vec_col: str = "embedding", label: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK,
                   members: int = MEMBERS, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label`` is an SQL expression, ``is_anchor`` an SQL condition over vec_id.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"),
                          F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & sound)
    # numbers of partitions and rows are stored, so that no task can number the rows anew
    rows = cut(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    anchors, middle = clustered(rows.filter(F.expr(is_anchor)), members, sample, block, scale)
    anchors = anchors.withColumn("bands", F.lit(None).cast("array<long>"))

    near = _ask(rows, anchors, "label", middle, positives, scale, shard)
    best = W.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    near = cut(near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives)
               .select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    bands = near.groupBy("anchor").agg(F.array_sort(F.collect_set("positive_score")).alias("bands"))   # at most ``positives`` numbers
    asked = anchors.drop("bands").join(bands, anchors["rid"] == bands["anchor"]).drop("anchor")
    far = _ask(rows, asked, None, middle, negatives, scale, shard)
    best = W.partitionBy("anchor", "slot_score").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    far = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives).select(
        "anchor", F.col("slot_score").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (near.join(far, ["anchor", "positive_score"]).join(names, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_hard_negatives(spark, sf_dir):
    """Anchors are the ids divisible by 100; ids divisible by 7 have the next label."""
    return hard_negatives(table(spark, sf_dir, "embeddings"), label="IF(vec_id % 7 = 0, (label + 1) % 10, label)")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e, len(embedding) AS n
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS anchor_id, c.rid AS other, c.vec_id, q.label = c.label AS same,
         CASE WHEN q.n = 0 THEN 0
              ELSE list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) END::HUGEINT AS score
  FROM v q JOIN v c ON q.n = c.n AND q.rid <> c.rid WHERE q.vec_id % 100 = 0),
p AS (
  SELECT rid, anchor_id, other AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) <= 5),
g AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.rid, p.positive ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other) AS rank
  FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score::BIGINT AS positive_score, negative_score::BIGINT AS negative_score
FROM g WHERE rank <= 10
"""
