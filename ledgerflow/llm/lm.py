"""Language-model scoring with a log-frequency Bloom filter.

Training documents are those whose id's checksum is not 0 modulo 10.  Their word and word
pair counts are gathered exactly: each task counts what it reads, packs the counts by hash
shard, and the shards add them up.

The model keeps quantised counts only.  A count c of at least ``MIN_COUNT`` has the level
1 + floor(log2(c / MIN_COUNT)), and the filter holds the n-gram once for each level up to
its own; a reader probes level after level until one is missing.  ``MIN_COUNT`` is 1, so
every n-gram of the training documents is in the filter, however large the corpus.  The
filter is built segment by segment: each shard has one for its words and one for its
pairs, sized by what they hold, so the filter grows with the corpus and its error rate
stays what it is.  Segments never leave their shard: the distinct words and pairs of a
slice of documents are sent there, and their levels come back to the slice.  Texts move
once, to meet these levels: the slices are cut a second time for that, by the number of
their partition, so a partition must hold the same rows in the same order each time it
is read.  Tables in files do; other inputs are stored first.

The probability of a word after another mixes the pair's share with the smoothed word
probability, both from probed counts.  The base score uses exact counts, which the shards
send along with the levels of the words.

Defined results: null and empty texts have one token, the end; a null id has the checksum
of the empty text; rows that repeat an id are rows of their own; without training
documents N and V are 0 and every probability is that of an unknown word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerflow.llm import tokens
from ledgerflow.llm.common import cut, cut_clean, ship, shuffle_parts, table

MIN_COUNT = 1
BITS_PER_EVENT, PROBES = 12, 4
PAIR_WEIGHT = 0.7
ADD = 0.1
FLUSH = 1 << 21  # distinct n-grams that a task gathers before it hands them on
SLICE = 1 << 23  # larger slices repeat fewer n-grams
END = np.uint64(tokens.hash_word(b"\x00end of text"))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, context of each token, offsets per row): words, then one end; the first context is the end."""
    words, at = tokens.words(data, offsets)
    n = len(at) - 1
    out = np.empty(len(words) + n, np.uint64)
    ends = at[1:] + np.arange(n)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = words
    out[ends] = END
    context = np.empty_like(out)
    context[1:] = out[:-1]
    if len(out):
        context[0] = END
    return out, context, np.concatenate(([0], ends + 1))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """56 bits: enough to tell pairs apart far below the filter's error rate, and shorter to send."""
    return tokens.mix(first * _A + second * _B + np.uint64(1)) >> np.uint64(8)


def _merge(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def _slim(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    top = int(counts.max(initial=0))
    return counts.astype("u1" if top < 256 else "<u4" if top < 1 << 32 else "<u8")


def _squeeze(h: np.ndarray) -> bytes:
    """Sorted numbers as the first one, the bytes per step, and the steps byte by byte."""
    steps = np.diff(h)
    width = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return h[:1].astype("<u8").tobytes() + bytes([width]) + steps.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T.tobytes() + len(h).to_bytes(8, "little")


def _unsqueeze(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[-8:], "little")
    if not n:
        return np.zeros(0, np.uint64)
    steps = np.zeros((n, 8), "u1")
    steps[0] = np.frombuffer(blob, "u1", 8)
    steps[1:, :blob[8]] = np.frombuffer(blob, "u1", blob[8] * (n - 1), 9).reshape(blob[8], n - 1).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _pack(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(rows["shard"], pa.int32()), pa.array(rows["pairs"], pa.bool_()), pa.array(rows["hashes"], pa.binary()),
        pa.array(rows["counts"], pa.binary()), pa.array(rows["width"], pa.int32())], ["shard", "pairs", "hashes", "counts", "width"])


def _by_shard(h: np.ndarray, c: np.ndarray, pairs: bool, shards: int) -> Iterator[pa.RecordBatch]:
    number = (h % np.uint64(shards)).astype(np.int64)
    order = np.argsort(number, kind="stable")
    h, c, cuts = h[order], c[order], np.searchsorted(number[order], np.arange(shards + 1))
    rows: dict[str, list] = {k: [] for k in ("shard", "pairs", "hashes", "counts", "width")}
    for s in np.flatnonzero(np.diff(cuts)):
        part = _slim(c[cuts[s]:cuts[s + 1]])
        for k, v in zip(rows, (int(s), pairs, _squeeze(h[cuts[s]:cuts[s + 1]]), part.tobytes(), part.itemsize), strict=True):
            rows[k].append(v)
    yield _pack(rows)


def _count(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}

        def flush(pairs: bool) -> Iterator[pa.RecordBatch]:
            hashes, counts = held[pairs]
            if hashes:
                h, c = _merge(hashes, counts)
                held[pairs] = ([], [])
                yield from _by_shard(h, c, pairs, shards)

        for batch in batches:
            raw, offsets = tokens.buffers(batch.column("text"))
            for _, _, data, offs in tokens.slices(raw, offsets, SLICE):
                words, context, _ = sequences(data, offs)
                for pairs, grams in ((False, words), (True, pair_hash(context, words))):
                    h, c = np.unique(grams, return_counts=True)
                    held[pairs][0].append(h)
                    held[pairs][1].append(c)
                    if sum(map(len, held[pairs][0])) > FLUSH:
                        yield from flush(pairs)
        for pairs in (False, True):
            yield from flush(pairs)
    return run


def _load(hashes: bytes, counts: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return _unsqueeze(hashes), np.frombuffer(counts, f"<u{width}").astype(np.int64)


MODEL = "shard int, pairs boolean, hashes binary, counts binary, width int, bits binary, n_bits long, total long, distinct long"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (shard, pairs) rows to one row each: the segment of the filter, and the exact counts of words."""
    def done(key, hashes, counts):
        h, c = _merge(hashes, counts)
        bloom = LogBloom(1, 0, MIN_COUNT)
        bloom.segment_bits = max(64, math.ceil(int(bloom.level(c).sum()) * BITS_PER_EVENT * 1.1))
        bits, slim = bloom.segment(h, c), _slim(c)
        exact = (None, None, None) if key[1] else (_squeeze(h), slim.tobytes(), slim.itemsize)
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.bool_()), pa.array([exact[0]], pa.binary()), pa.array([exact[1]], pa.binary()),
            pa.array([exact[2]], pa.int32()), pa.array([bits.tobytes()], pa.binary()), pa.array([bloom.segment_bits], pa.int64()),
            pa.array([int(c.sum())], pa.int64()), pa.array([len(h)], pa.int64())],
            ["shard", "pairs", "hashes", "counts", "width", "bits", "n_bits", "total", "distinct"])

    key, hashes, counts = None, [], []
    for batch in batches:
        for shard, pairs, h, c, width in zip(*[batch.column(x).to_pylist() for x in ("shard", "pairs", "hashes", "counts", "width")], strict=True):
            if key is not None and (shard, pairs) != key:
                yield done(key, hashes, counts)
                hashes, counts = [], []
            key = (shard, pairs)
            h, c = _load(h, c, width)
            hashes.append(h)
            counts.append(c)
            if len(hashes) >= 32:
                h, c = _merge(hashes, counts)
                hashes, counts = [h], [c]
    if key is not None:
        yield done(key, hashes, counts)


class LogBloom:
    """A log-frequency Bloom filter of ``shards`` segments."""

    def __init__(self, shards: int, segment_bits: int, min_count: int, bits: np.ndarray | None = None):
        self.shards, self.segment_bits, self.min_count, self.bits = shards, segment_bits, min_count, bits

    def places(self, grams: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """Bit numbers of (n-gram, level) inside the n-gram's segment, probe by probe."""
        x = tokens.mix(grams + np.uint64(level * int(_A) & (1 << 64) - 1))
        step = (x >> np.uint64(32)) | np.uint64(1)
        x &= np.uint64(0xFFFFFFFF)
        for _ in range(PROBES):
            yield x % np.uint64(self.segment_bits)
            x = x + step

    def level(self, counts: np.ndarray) -> np.ndarray:
        """0 for a count below ``min_count``, then one more for each doubling."""
        return np.where(counts < self.min_count, 0, np.frexp(counts / self.min_count)[1])

    def segment(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The bytes of the segment that holds these n-grams."""
        out = np.zeros((self.segment_bits + 7) // 8, np.uint8)
        level = self.level(counts)
        for j in range(1, int(level.max(initial=0)) + 1):
            for at in self.places(grams[level >= j], j):
                np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        return out

    def holds(self, grams: np.ndarray, base: np.ndarray, level: int) -> np.ndarray:
        held = np.ones(len(grams), bool)
        for at in self.places(grams, level):
            byte = self.bits[(base + (at >> np.uint64(3))).astype(np.int64)]
            held &= (byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return held

    def probe(self, grams: np.ndarray) -> np.ndarray:
        """The highest level held without a gap; 0 if none is."""
        level, alive, j = np.zeros(len(grams), np.int64), np.arange(len(grams)), 1
        base = (grams % np.uint64(self.shards)) * np.uint64((self.segment_bits + 7) // 8)
        while len(alive):
            alive = alive[self.holds(grams[alive], base[alive], j)]
            level[alive] = j
            j += 1
        return level

    def middle(self, level: np.ndarray) -> np.ndarray:
        """The middle of a level's count range; 0 for level 0."""
        return np.where(level > 0, 1.5 * self.min_count * np.exp2(level - 1.0) - 0.5, 0.0)

    def count(self, grams: np.ndarray) -> np.ndarray:
        return self.middle(self.probe(grams))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, value) of ``wanted`` in the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, np.where(found, values[at], 0)


TABLES, DOC, BODY, PROBE = -1, 0, 1, 2
ROW = "shard int, slice long, kind int, row long, pairs boolean, start long, hashes binary, counts binary, width int, bits binary, n_bits long"
ANSWER = "slice long, kind int, pairs boolean, start long, counts binary, width int, levels binary"
PLACE = "slice long, kind int, row long, doc_id {kind}, held_out boolean, n_tokens long, hashes binary, counts binary"
_TYPES = {"shard": pa.int32(), "slice": pa.int64(), "kind": pa.int32(), "row": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "pairs": pa.bool_(),
          "start": pa.int64(), "hashes": pa.binary(), "counts": pa.binary(), "width": pa.int32(), "bits": pa.binary(), "n_bits": pa.int64(), "levels": pa.binary()}


def _rows(schema: str, m: int, id_type: pa.DataType | None = None, **given) -> pa.RecordBatch:
    """``m`` rows of these columns; columns that are not given are null."""
    kinds, names = _TYPES | {"doc_id": id_type}, [c.split()[0] for c in schema.split(", ")]
    column = lambda k: pa.nulls(m, kinds[k]) if k not in given else given[k] if isinstance(given[k], pa.Array) else pa.array(given[k], kinds[k])
    return pa.RecordBatch.from_arrays([column(k) for k in names], names)


def _dealt(grams: np.ndarray, shards: int, light: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-grams by light shard and hash, place of each n-gram among them, first place per light shard)."""
    own, back = np.unique(grams, return_inverse=True)
    number = (own % np.uint64(shards) % np.uint64(light)).astype(np.int64)
    order = np.argsort(number, kind="stable")
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    return own[order], place[back], np.searchsorted(number[order], np.arange(light + 1))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(number, batch, first row, end row, bytes, offsets) of the slices of a partition."""
    done: dict[int, int] = {}
    for batch in batches:
        if not len(batch):
            continue
        part = batch.column("part")[0].as_py()
        raw, offsets = tokens.buffers(batch.column("text"))
        for a, b, data, offs in tokens.slices(raw, offsets, SLICE):
            done[part] = done.get(part, -1) + 1
            yield (part << 40) + done[part], batch, a, b, data, offs


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents and the texts of each slice."""
    for uid, batch, a, b, data, offs in _slices(batches):
        words, at = tokens.words(data, offs)
        id_type, n = batch.schema.field("doc_id").type, b - a
        yield _rows(PLACE, n, id_type, kind=[DOC] * n, slice=[uid] * n, row=range(n), doc_id=batch.column("doc_id").slice(a, n),
                    held_out=batch.column("held_out").slice(a, n), n_tokens=np.diff(at) + 1)
        yield _rows(PLACE, 1, id_type, kind=[BODY], slice=[uid], hashes=[pa.compress(data.tobytes(), codec="zstd", asbytes=True)],
                    counts=[offs.astype("<u8").tobytes()])


def _ask(shards: int, light: int):
    """The distinct words and pairs of each slice for their shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, _, _, _, data, offs in _slices(batches):
            words, context, _ = sequences(data, offs)
            for pairs in (False, True):
                own, _, cuts = _dealt(pair_hash(context, words) if pairs else words, shards, light)
                some = np.flatnonzero(np.diff(cuts))
                m = len(some)
                yield _rows(ROW, m, shard=some, kind=[PROBE] * m, slice=[uid] * m, pairs=[pairs] * m, start=cuts[some],
                            hashes=[_squeeze(own[x:y]) for x, y in zip(cuts[some], cuts[some + 1], strict=True)])
    return run


def _answer(shards: int, light: int):
    """Sorted (shard, kind) rows: the tables of a shard first, then the n-grams that are looked up there.

    Each request gives one row: levels, and for words also exact counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tables, keys, values, segments = None, [], None, None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "kind", "slice", "pairs", "start", "hashes", "counts", "width", "bits", "n_bits", "row")]
            out: list[tuple] = []
            for number, kind, piece, pairs, start, h, c, width, bits, n_bits, own in zip(*columns, strict=True):
                if number != shard:
                    shard, tables, segments = number, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], {}
                if kind == TABLES:
                    segments[pairs, own] = LogBloom(1, n_bits, MIN_COUNT, np.frombuffer(bits, np.uint8))
                    if not pairs:
                        tables.append(_load(h, c, width))
                    continue
                if tables:
                    keys, values = _merge([k for k, _ in tables], [v for _, v in tables])
                    tables = []
                h = _unsqueeze(h)
                full, level = h % np.uint64(shards), np.zeros(len(h), np.int64)
                for at in range(number, shards, light):
                    if (pairs, at) in segments:
                        mine = np.flatnonzero(full == at)
                        level[mine] = segments[pairs, at].probe(h[mine])
                exact = None if pairs else _slim(_lookup(keys, values, h)[1])
                out.append((piece, pairs, start, level.astype("u1").tobytes(), *((None, None) if pairs else (exact.tobytes(), exact.itemsize))))
            if out:
                piece, pairs, start, levels, counts, width = zip(*out, strict=True)
                yield _rows(ANSWER, len(out), slice=piece, kind=[PROBE] * len(out), pairs=pairs, start=start, levels=levels, counts=counts, width=width)
    return run


def _combine(total: int, distinct: int, shards: int, light: int):
    """Sorted (slice, kind) rows: the documents of a slice, its words, then what the shards know of them."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    scale = total + ADD * (distinct + 1)
    middle = LogBloom(1, 0, MIN_COUNT).middle

    def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        docs = t.filter(pc.equal(t.column("kind"), DOC)).sort_by("row")
        rest = t.filter(pc.greater(t.column("kind"), DOC)).select(["kind", "pairs", "start", "hashes", "counts", "width", "levels"]).to_pylist()
        offs = np.frombuffer(rest[0]["counts"], "<u8").astype(np.int64)
        data = np.frombuffer(pa.decompress(rest[0]["hashes"], int(offs[-1]), codec="zstd", asbytes=True), np.uint8)
        words, context, at = sequences(data, offs)
        own, back, _ = _dealt(words, shards, light)
        pairs, pair_back, _ = _dealt(pair_hash(context, words), shards, light)
        exact, word_level, pair_level = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(pairs), np.int64)
        for r in rest[1:]:
            level = np.frombuffer(r["levels"], "u1")
            if r["pairs"]:
                pair_level[r["start"]:r["start"] + len(level)] = level
            else:
                word_level[r["start"]:r["start"] + len(level)] = level
                exact[r["start"]:r["start"] + len(level)] = np.frombuffer(r["counts"], f"<u{r['width']}")
        n = len(docs)
        row = np.repeat(np.arange(n), np.diff(at))
        word_count = middle(word_level)
        first_count = word_count[back][np.concatenate(([-1], np.arange(len(back) - 1)))]  # the first context is the end, as is the last word
        plain = ((word_count + ADD) / scale)[back]
        share = np.minimum(1.0, middle(pair_level)[pair_back] / np.maximum(first_count, 1.0))
        p = np.where(first_count > 0, (1 - PAIR_WEIGHT) * plain + PAIR_WEIGHT * share, plain)
        return pa.RecordBatch.from_arrays([
            docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), docs.column("n_tokens").combine_chunks(),
            pa.array(np.bincount(row, exact[back] > 0, n).astype(np.int64)), pa.array(np.bincount(row, np.log10((exact + ADD) / scale)[back], n)),
            pa.array(np.bincount(row, np.log10(p), n))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            number = batch.column("slice").to_numpy()
            edges = np.flatnonzero(np.diff(number)) + 1
            for a, b in zip([0, *edges], [*edges, len(number)], strict=True):
                if a == b:
                    continue
                if number[a] != current:
                    if parts:
                        yield done(parts)
                    current, parts = number[a], []
                parts.append(batch.slice(a, b - a))
        if parts:
            yield done(parts)
    return run


def score_documents(docs: DataFrame, steady: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``.

    ``steady`` says that ``docs`` gives the same partitions, in the same order, each time it is read.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = shuffle_parts(spark)
    shards, light = 4 * parts, parts
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    texts = docs.select("doc_id", held.alias("held_out"), "text")
    if not steady:
        texts = cut(texts)
    placed = texts.withColumn("part", F.spark_partition_id())

    schema = "shard int, pairs boolean, hashes binary, counts binary, width int"
    counted = texts.filter("not held_out").select("text").mapInArrow(_count(shards), schema)
    counted = counted.repartition(parts, "shard").sortWithinPartitions("shard", "pairs")
    model = cut_clean(counted.mapInArrow(_add_up, MODEL))
    total, distinct = model.filter("not pairs").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    kind = dict(docs.dtypes)["doc_id"]
    asked = placed.mapInArrow(_ask(shards, light), ROW)
    tables = model.select((F.col("shard") % light).alias("shard"), F.lit(TABLES).alias("kind"), F.col("shard").cast("long").alias("row"),
                          "pairs", "hashes", "counts", "width", "bits", "n_bits")
    both = asked.unionByName(tables, allowMissingColumns=True)
    both = both.repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    known = both.mapInArrow(_answer(shards, light), ANSWER)
    known = known.unionByName(placed.mapInArrow(_place, PLACE.format(kind=kind)), allowMissingColumns=True)
    known = known.repartition(parts, "slice").sortWithinPartitions("slice", "kind")
    out = known.mapInArrow(_combine(total, distinct, shards, light), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), steady=True)
