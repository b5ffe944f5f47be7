"""Near duplicates: circulant MinHash, banding, exact Jaccard.

* Shingles are runs of ``n`` words (a shorter text is one shingle), kept as 64-bit hashes.
* Circulant MinHash: a first permutation of the 32-bit hash space spreads the shingles, a
  second one, circularly shifted by k, gives coordinate k of the signature.  Two
  permutations make all coordinates.
* Texts with equal shingle sets are one class (128-bit digest of the set); only classes
  are banded.  With 24 bands of 4 coordinates a pair at similarity 0.85 is missed with
  probability 2e-8.
* A bucket links its classes to its smallest one only, so a bucket of any size costs one
  row per member.  The components of these links are clusters: every pair that shares a
  bucket lies in one cluster, so no candidate is lost.
* Each cluster is checked exactly on full sets.  Large clusters are split into blocks and
  pairs of blocks go to different tasks; a task counts intersections by matrix products
  and returns one row per member, not per pair.
* The verified links' components are the groups.

Defined results: null, empty and blank texts have no shingles and are linked with nothing;
null ids take part and never become a component id unless all ids of it are null; rows
that repeat an id are rows of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerflow.llm import tokens
from ledgerflow.llm.common import bitmap, cut, may_hold, ship, shuffle_parts, spread_join, table, text_of
from ledgerflow.llm.graph import components

BANDS, ROWS = 24, 4
BLOCK = 128
COLUMNS = 4096
NO_ID = -(1 << 63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, at = tokens.words(data, offsets)
    odd = [np.uint64(2 * tokens.hash_word(b"shingle%d" % i) + 1 & (1 << 64) - 1) for i in range(n)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        w = hashes[a:b]
        take = min(n, len(w))
        if take == 0:
            yield w
            continue
        total = np.full(len(w) - take + 1, take, np.uint64)
        for i in range(take):
            total += w[i:len(w) - take + 1 + i] * odd[i]
        yield np.unique(tokens.mix(total))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Circulant MinHash signatures, one row per (non-empty) set."""
    out = np.empty((len(sets), k), np.uint32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    row = 0
    while row < len(sets):  # runs of sets that fit the processor's cache
        end = max(row + 1, int(np.searchsorted(at, at[row] + 32768, side="right")) - 1)
        place = _mix32(np.concatenate(sets[row:end]).astype(np.uint32))  # the first permutation
        starts = at[row:end] - at[row]
        for j in range(k):  # the second one, shifted by j
            out[row:end, j] = np.minimum.reduceat(_mix32(place - np.uint32(j)), starts)
        row = end
    return out


def band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(sigs), bands), np.int64)
    for b in range(bands):
        key = np.full(len(sigs), b + 1, np.uint64)
        for r in range(rows):
            key = tokens.mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, b * rows + r])
        keys[:, b] = key.view(np.int64)
    return keys


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tokens.buffers(batch.column("text"))
            for a, b, data, offs in tokens.slices(raw, offsets):
                sets = list(shingle_sets(data, offs, n))
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = iter(band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)) if full else iter(())
                some = [next(keys) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("text_key").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(some, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "fp", "bands"])
    return run


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tokens.buffers(batch.column("text"))
            for _, _, data, offs in tokens.slices(raw, offsets):
                sets = [s for s in shingle_sets(data, offs, n) if len(s)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([digest(s) for s in sets], pa.binary()),
                    pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["fp", "members"])
    return run


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """|x & y| for every x of ``a`` and y of ``b``: products of 0/1 matrices, by column blocks."""
    sets = [*a, *b]
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, uses = np.unique(every, return_inverse=True, return_counts=True)
    keep = uses[column] > 1  # what one set holds alone meets nothing
    renumber = np.cumsum(uses > 1) - 1
    column, row = renumber[column[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(a), len(b)))
    width = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, width - c)), np.float32)
        block[row[lo:hi], column[lo:hi] - c] = 1
        out += block[:len(a)] @ block[len(a):].T
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Where 100 * intersection >= percent * union."""
    common = np.rint(intersections(a, b)).astype(np.int64)
    union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - common
    return 100 * common >= percent * union


def spanning(links: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches (links: symmetric, boolean)."""
    n = len(links)
    links = links | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(links, label[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _verify(percent: int):
    def check(group: list[tuple]) -> pa.RecordBatch | None:
        first, second = group[0][1], group[0][2]
        sets = [np.frombuffer(r[5], "<u8") for r in group]
        if first == second:
            links = linked(sets, sets, percent)
        else:
            left = [i for i, r in enumerate(group) if r[3] == first]
            right = [i for i, r in enumerate(group) if r[3] != first]
            if not left or not right:
                return None
            links = np.zeros((len(group), len(group)), bool)
            found = linked([sets[i] for i in left], [sets[i] for i in right], percent)
            links[np.ix_(left, right)] = found
            links[np.ix_(right, left)] = found.T
        label = spanning(links)
        got = [(group[i][4], group[int(label[i])][4]) for i in range(len(group)) if label[i] != i]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.binary()), pa.array([x for _, x in got], pa.binary())],
                                          ["a", "b"]) if got else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and r[:3] != group[0][:3]:
                    if (out := check(group)) is not None:
                        yield out
                    group = []
                group.append(r)
        if group and (out := check(group)) is not None:
            yield out
    return run


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key per row; ``text_key`` is a hash of the text.

    Texts are linked if 100 * intersection >= percent * union of their shingle sets.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("text_key"))
    sig = cut(texts.mapInArrow(_sign(n, bands, rows), "doc_id long, text_key long, n_shingles long, fp binary, bands array<long>"))
    own = F.coalesce("doc_id", F.lit(NO_ID))
    classes = sig.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("min_id"), F.min(own).alias("pick"), F.first("bands").alias("bands"))
    keys = classes.select("fp", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    clusters = components(spread_join(keys, buckets, ["key"]).select(F.col("fp").alias("a"), "b"))
    clusters = cut(clusters.withColumnRenamed("node", "fp").withColumnRenamed("root", "cluster"))

    # one text per class; the bitmap keeps other texts out of the shuffle
    picked = cut(classes.select("fp", "pick").join(clusters.select("fp"), "fp").select("pick").distinct())
    chosen = texts.withColumn("pick", own).filter(may_hold(bitmap(picked, "pick"), F.col("pick"))).join(picked, "pick", "left_semi")
    sets = chosen.select("text").mapInArrow(_full_sets(n), "fp binary, members binary")
    size = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = cut(spread_join(sets.join(clusters, "fp"), size, ["cluster"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp", "members")
    pairs = pairs.repartitionByRange(shuffle_parts(docs.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = pairs.mapInArrow(_verify(percent), "a binary, b binary")
    groups = components(links)

    root = F.coalesce("root", "fp")
    by_class = classes.drop("bands", "pick").join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "min_id", root.alias("root"))
    least = by_class.groupBy("root").agg(F.min("min_id").alias("component"))
    by_class = spread_join(by_class, least, ["root"]).select(F.col("fp").alias("key"), "component")
    # rows without shingles get a key of their own, so that they spread over the tasks
    alone = F.encode(F.concat(F.lit("alone "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "utf-8")
    out = sig.select("doc_id", "text_key", "n_shingles", "fp", F.coalesce("fp", alone).alias("key"))
    out = spread_join(out, by_class, ["key"], "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def _text_key():
    return F.xxhash64(text_of())


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one text of each group, with their columns as they were.

    Of rows that repeat with id and text one stays; texts without words stay all."""
    found = cut(near_duplicates(docs, n, percent).select("doc_id", "kept", "n_shingles", F.xxhash64("doc_id", "text_key").alias("_key")))
    key = [F.col("_key"), F.col("doc_id").alias("_id")]
    gone = found.filter("not kept").select(*key, F.lit(True).alias("_gone")).distinct()
    again = found.filter("kept and n_shingles > 0").groupBy(*key).count().filter("count > 1").select("_key", "_id", F.lit(False).alias("_gone"))
    marked = cut(gone.unionByName(again))
    own = F.xxhash64(F.col("doc_id").cast("long"), _text_key())
    maybe = may_hold(bitmap(marked, "_key"), own)
    packed = docs.filter(maybe).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), own.alias("own"))
    same = (F.col("own") == F.col("_key")) & F.col("r.doc_id").cast("long").eqNullSafe(F.col("_id"))
    left = packed.join(marked, same, "left").filter("_gone is null or not _gone")
    one = left.filter("_gone is not null").withColumn("_r", F.row_number().over(W.partitionBy("own").orderBy(F.xxhash64("r")))).filter("_r = 1")
    return docs.filter(~maybe).unionByName(left.filter("_gone is null").select("r.*")).unionByName(one.select("r.*"))


def op5_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85).select(
        "doc_id", "n_shingles", "component_id", "kept")
