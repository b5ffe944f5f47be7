"""Removal of repeated byte strings by suffix sorting of the suspicious places.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else.

1. Every window of ``length`` bytes has an owner: its first smallest ``GRAM``-byte gram by
   hash.  Equal windows have equal owners, at the same distance.  Neighbouring windows with
   one owner form a block.  Only owners that occur at least twice can hold repeats.
2. Blocks of such owners are compared by a 128-bit digest; equal blocks are a class, and
   the windows of a class with two members or more are all repeated.  These rows are
   narrow and grouped with partial sums, so a passage with very many copies needs no task
   of its own.
3. Where an owner has several classes (at the edges of repeats), the classes' bytes, each
   once, meet in one task.  Their windows are suffix-sorted: a multikey sort by 8-byte
   words down to a shallow depth, then blind tries for the groups that still agree; a
   group is split at the first word where a member leaves its leader, and members that
   never leave it are equal.  Comparisons are of bytes, not of hashes.
   An owner with more than ``GROUP`` classes is split by class digest; its parts are sorted
   apart, and a digest of each distinct window is counted across the parts.
4. The repeated windows of a class go back to its places, and documents that have any are
   rewritten once.

Two bitmaps of fixed size say which owners may matter, so texts stay where they are until
the last step.  False positives only cost work.

Defined results: texts are UTF-8 bytes; null is empty; texts shorter than ``length`` lose
nothing; rows that repeat an id (and text) are rows of their own, so they repeat each
other; null ids are allowed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerflow.llm import tokens
from ledgerflow.llm.common import bitmap, cut, may_hold, ship, shuffle_parts, spread_join, table, text_of

LENGTH, GRAM = 200, 64
SLICE, PIECE = 1 << 18, 1 << 23
BITS = 1 << 25
SHALLOW = 4  # words
GROUP = 512
MOST_SPLIT = 100_000
CHUNK = 1 << 21
_codes = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LOW = np.uint64((1 << 24) - 1)


class Rolling:
    """Hashes of any substring of a buffer from prefix sums, modulo 2^64."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        self.inverse = tokens.powers(np.uint64(pow(base, -1, 1 << 64)), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_codes[data] * tokens.powers(np.uint64(base), n)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tokens.mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """min(values[i:i + width]) for every i."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def blocks(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Blocks of a slice: owner hash, row, first and last window start (in the slice)."""
    empty = {k: np.zeros(0, np.int64) for k in ("owner", "row", "first", "last")}
    n = len(data)
    if n < length:
        return empty
    roll = Rolling(data, _BASES[0])
    at = np.arange(n - gram + 1)
    hashes = (roll.sums[gram:] - roll.sums[:-gram]) * roll.inverse[:n - gram + 1]
    hashes = tokens.mix(hashes)
    order = (hashes & ~_LOW) | at.astype(np.uint64)
    owner = (sliding_min(order, length - gram + 1) & _LOW).astype(np.int64)  # per window start
    sizes = np.diff(offsets)
    ends = np.repeat(offsets[1:], sizes)
    fits = ends[:len(owner)] >= np.arange(len(owner)) + length
    new = fits.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | ~fits[:-1]
    # two rows' windows never share a block: between them lie starts that do not fit
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    stop = fits.copy()
    stop[:-1] &= (owner[1:] != owner[:-1]) | ~fits[1:]
    last = np.flatnonzero(stop)
    row = np.searchsorted(offsets, first, side="right") - 1
    return {"owner": hashes[owner[first]].view(np.int64), "row": row, "first": first, "last": last, "roll": roll}


def pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch row per row, start of the piece in its text, bytes, offsets): long texts in overlapping pieces."""
    raw, offsets = tokens.buffers(batch.column("text"))
    for a, b, data, offs in tokens.slices(raw, offsets, SLICE):
        if len(data) <= PIECE:
            yield np.arange(a, b), np.zeros(b - a, np.int64), data, offs
            continue
        for s in range(0, max(1, len(data) - length + 1), PIECE - length + 1):  # one long text
            part = data[s:s + PIECE]
            yield np.array([a]), np.array([s]), part, np.array([0, len(part)])


def _owners(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in pieces(batch, length):
                h, n = np.unique(blocks(data, offs, length, gram)["owner"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["h", "n"])
    return run


class Bits:
    """A bitmap over 64-bit numbers, sent to the workers."""

    def __init__(self, keys: DataFrame, key: str):
        at = F.pmod(F.col(key), F.lit(BITS))
        rows = (keys.select(at.alias("b")).groupBy(F.expr("b div 64").alias("w"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("x")).toArrow())
        words = np.zeros(BITS // 64, np.int64)
        words[rows.column("w").to_numpy()] = rows.column("x").to_numpy()
        self.sent = keys.sparkSession.sparkContext.broadcast(words)

    def hold(self, keys: np.ndarray) -> np.ndarray:
        at = keys % BITS
        return (self.sent.value[at >> 6] >> (at & 63)) & 1 == 1


def _places(bits: Bits, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for rows, starts, data, offs in pieces(batch, length):
                b = blocks(data, offs, length, gram)
                use = bits.hold(b["owner"])
                if not use.any():
                    continue
                row, first, last = b["row"][use], b["first"][use], b["last"][use]
                f1, f2 = _digests(b["roll"], data, first, last + length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(k1[rows[row]]), pa.array(k2[rows[row]]), pa.array(b["owner"][use]), pa.array(f1), pa.array(f2),
                    pa.array(first - offs[row] + starts[row], pa.int64()), pa.array((last - first + 1).astype(np.int32))],
                    ["k1", "k2", "h", "f1", "f2", "first", "windows"])
    return run


def _digests(roll: Rolling, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = Rolling(data, _BASES[1])
    size = (end - start).astype(np.uint64)
    return tokens.mix(roll.of(start, end) + size).view(np.int64), tokens.mix(other.of(start, end) + size).view(np.int64)


def _bodies(bits: Bits, split: tuple[np.ndarray, np.ndarray], length: int, gram: int):
    hot, ways = split

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in pieces(batch, length):
                b = blocks(data, offs, length, gram)
                use = bits.hold(b["owner"])
                if not use.any():
                    continue
                h, first, last = b["owner"][use], b["first"][use], b["last"][use]
                f1, f2 = _digests(b["roll"], data, first, last + length)
                _, one = np.unique(np.stack([f1, f2]), axis=1, return_index=True)  # each class once
                h, first, last, f1, f2 = (v[one] for v in (h, first, last, f1, f2))
                part = np.zeros(len(h), np.int32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    is_hot = hot[at] == h
                    part[is_hot] = 1 + f2[is_hot] % ways[at[is_hot]]
                body = data.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(h), pa.array(part), pa.array(f1), pa.array(f2), pa.array((last - first + 1).astype(np.int32)),
                    pa.array([body[s:e + length] for s, e in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())],
                    ["h", "part", "f1", "f2", "windows", "body"])
    return run


def deep_shallow(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each start; two are equal if and only if the ``length`` bytes there are.

    Starts whose string occurs once get numbers of their own.
    """
    words = length // 8 + (length % 8 > 0)
    padded = np.concatenate([text, np.zeros(8 * words + 8, np.uint8)])
    at_byte = np.ndarray((len(padded) - 7,), ">u8", padded.data, 0, (1,))

    def word(which: np.ndarray, d: int) -> np.ndarray:
        x = at_byte[starts[which] + 8 * d].astype(np.uint64)
        over = 8 * (d + 1) - length
        return x >> np.uint64(8 * over) if over > 0 else x

    answer = np.arange(len(starts), dtype=np.int64)
    live, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)

    def split(live: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Groups of two or more with equal keys: (members, group numbers), sorted."""
        order = np.lexsort(keys[::-1])
        live, keys = live[order], [k[order] for k in keys]
        new = np.ones(len(live), bool)
        if len(live):
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        number = np.cumsum(new) - 1
        keep = np.bincount(number, minlength=1)[number] > 1 if len(live) else np.zeros(0, bool)
        return live[keep], number[keep]

    for d in range(min(SHALLOW, words)):  # multikey sort, a word at a time
        live, group = split(live, group, word(live, d))
    while len(live):  # blind tries: one branch along each group's leader a round
        _, lead_at, back = np.unique(group, return_index=True, return_inverse=True)
        leader = live[lead_at][back]
        depth, mark = np.full(len(live), words), np.zeros(len(live), np.uint64)
        open_ = np.arange(len(live))
        for d in range(SHALLOW, words):
            mine = word(live[open_], d)
            differs = mine != word(leader[open_], d)
            depth[open_[differs]], mark[open_[differs]] = d, mine[differs]
            open_ = open_[~differs]
        same = depth == words
        answer[live[same]] = leader[same]
        live, group = split(live[~same], group[~same], depth[~same], mark[~same])
    return answer


def runs_of(flags: np.ndarray) -> list[int]:
    """Start and end (exclusive) of each run of true values, one after the other."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel().tolist()


def _sort(length: int):
    """Sorted (h, part) rows with a class's bytes: its repeated windows, and for split owners the others' digests."""
    names = ["h", "f1", "f2", "spans", "w1", "w2", "at"]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        seen: dict[tuple, tuple] = {r[2:4] + (r[0],): r for r in rows}
        rows = list(seen.values())
        text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(r[5]) for r in rows])))
        count = np.array([r[4] for r in rows])
        begin = np.concatenate(([0], np.cumsum(count)))
        starts = np.repeat(offsets[:-1] - begin[:-1], count) + np.arange(begin[-1])
        number = deep_shallow(text, starts, length)
        repeated = np.bincount(number, minlength=len(number))[number] > 1
        apart = np.repeat(np.array([r[1] > 0 for r in rows]), count)
        lone = apart & (number == np.arange(len(number)))  # one of each distinct window of a split owner
        w = [(), ()]
        if lone.any():
            w = [Rolling(text, b).of(starts, starts + length).view(np.int64) for b in _BASES]
        out = [[] for _ in names]
        for i, r in enumerate(rows):
            a, b = begin[i], begin[i + 1]
            pick = np.flatnonzero(lone[a:b]) if r[1] > 0 else ()
            for column, v in zip(out, (r[0], r[2], r[3], runs_of(repeated[a:b]), [int(w[0][a + x]) for x in pick],
                                       [int(w[1][a + x]) for x in pick], [int(x) if not repeated[a + x] else -1 for x in pick]), strict=True):
                column.append(v)
        types = [pa.int64()] * 3 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, key = 0, None
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("h", "part", "f1", "f2", "windows", "body")], strict=True):
                if r[:2] != key and size > CHUNK:  # groups are never cut, small ones go together
                    yield solve(rows)
                    rows, size = [], 0
                key = r[:2]
                rows.append(r)
                size += len(r[5])
        if rows:
            yield solve(rows)
    return run


def _rewrite(with_spans: bool, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tokens.buffers(batch.column("text"))
            spans = batch.column("spans").to_pylist() if with_spans else [None] * len(batch)
            n_removed, n_spans, kept = [], [], []
            for a, b, found in zip(offsets[:-1], offsets[1:], spans, strict=True):
                body = raw[a:b]
                gone = 0
                pairs: list[list[int]] = []
                for s, e in sorted((int(x["s"]), int(x["e"])) for x in found or ()):
                    if pairs and s <= pairs[-1][1]:
                        pairs[-1][1] = max(pairs[-1][1], e)
                    else:
                        pairs.append([s, e])
                rest, at = [], 0
                for s, e in pairs:
                    rest.append(body[at:s].tobytes())
                    gone, at = gone + e - s, e
                rest.append(body[at:].tobytes())
                n_removed.append(gone)
                n_spans.append(len(pairs))
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) per row of ``docs``."""
    ship(docs.sparkSession)
    parts = shuffle_parts(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", text_of().alias("text"))
    texts = texts.withColumn("k1", F.xxhash64("doc_id", F.lit(1), "text")).withColumn("k2", F.xxhash64("text"))

    owners = texts.select("text").mapInArrow(_owners(length, gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    again = Bits(owners.filter("n > 1"), "h")
    places = cut(texts.select("k1", "k2", "text").mapInArrow(
        _places(again, length, gram), "k1 long, k2 long, h long, f1 long, f2 long, first long, windows int"))

    classes = places.groupBy("h", "f1", "f2").agg(F.count(F.lit(1)).alias("n"))
    per_owner = cut(classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1"))
    mixed = Bits(per_owner, "h")
    most = max(GROUP, int(per_owner.agg(F.coalesce(F.sum("classes"), F.lit(0))).first()[0]) // MOST_SPLIT)
    big = per_owner.filter(F.col("classes") > most).select("h", F.ceil(F.col("classes") / (GROUP // 2)).cast("long").alias("ways")).toArrow()
    order = np.argsort(big.column("h").to_numpy())
    split = (big.column("h").to_numpy()[order], big.column("ways").to_numpy()[order])

    bodies = texts.select("text").mapInArrow(_bodies(mixed, split, length, gram), "h long, part int, f1 long, f2 long, windows int, body binary")
    bodies = bodies.repartition(parts, "h", "part").sortWithinPartitions("h", "part")
    solved = cut(bodies.mapInArrow(_sort(length), "h long, f1 long, f2 long, spans array<int>, w1 array<long>, w2 array<long>, at array<int>"))

    # windows of split owners that another part holds too
    lone = solved.filter("size(w1) > 0").select("h", "f1", "f2", F.explode(F.arrays_zip("w1", "w2", "at")).alias("w")).select("h", "f1", "f2", "w.*")
    shared = lone.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    across = lone.filter("at >= 0").join(shared, ["w1", "w2"]).select("h", "f1", "f2", F.col("at").alias("a"), (F.col("at") + 1).alias("b"))
    inside = solved.filter("size(spans) > 0").select("h", "f1", "f2", F.explode(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))).alias("i"), "spans")
    inside = inside.select("h", "f1", "f2", F.get("spans", F.col("i")).alias("a"), F.get("spans", F.col("i") + 1).alias("b"))
    whole = classes.filter("n > 1").select("h", "f1", "f2", F.lit(0).alias("a"), F.lit(1 << 30).alias("b"))
    ranges = whole.union(inside).union(across).groupBy("h", "f1", "f2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))

    # back to the places: window starts a..b-1 of a block cover the bytes a..b-1+length
    hits = spread_join(places, ranges, ["h", "f1", "f2"]).select("k1", "k2", "first", "windows", F.explode("ranges").alias("r"))
    start = F.col("first") + F.col("r.a")
    end = F.col("first") + F.least(F.col("r.b"), F.col("windows")) - 1 + length
    spans = cut(hits.groupBy("k1", "k2").agg(F.collect_set(F.struct(start.alias("s"), end.alias("e"))).alias("spans")))

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    touched = may_hold(bitmap(spans, "k1"), F.col("k1"))
    plain = texts.filter(~touched).select("doc_id", "text").mapInArrow(_rewrite(False, length), schema)
    cleaned = texts.filter(touched).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_rewrite(True, length), schema)
    return plain.union(cleaned)


def op8_suffix_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
