"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenation.

A text longer than a chunk is cut into chunks that overlap.  All chunks are pre-tokenised
in parallel, each from its own start, which may lie inside a pre-token.  The chunks are
stitched where the boundaries of two neighbours resynchronise in their overlap: the
pattern never looks back, so from a common boundary on both go on alike.  If two
neighbours find no common boundary (one run fills the overlap), the cut moves to the next
place where a blank follows a non-blank, which is a boundary for any start.  The pieces
between the cuts are whole pre-tokens; they are encoded in parallel and their ids joined
in order.  A shorter text is one piece.

The vocabulary file is read on the driver and sent to the workers; its size is fixed.
A run of blanks longer than ``LONG_RUN`` is one pre-token by the pattern's rule and is encoded
without the pattern's engine.

Defined results: a null or empty text has no ids; an empty table gives no rows; rows that repeat an id are rows of
their own; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from ledgerflow.llm import tokens
from ledgerflow.llm.common import cut, ship, shuffle_parts, table, text_of

CHUNK, OVERLAP, GUARD = 16384, 256, 3
_codecs: dict[tuple[str, str], "Codec"] = {}

# The characters with the Unicode property White_Space.
BLANKS = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class Codec:
    """Encoder and byte table of a rank file, built once per worker."""

    def __init__(self, ranks_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.blank_rule = r"\s+(?!\S)" in pattern
        words = {i: b for b, i in ranks.items()}
        known = [words.get(i, b"") for i in range(max(words) + 1)]
        self.size = np.array([len(b) for b in known], np.int32)
        self.start = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.blob = np.frombuffer(b"".join(known), np.uint8)

    @staticmethod
    def of(ranks_file: bytes, pattern: str) -> "Codec":
        key = (hashlib.sha1(ranks_file).hexdigest(), pattern)
        if key not in _codecs:
            _codecs[key] = Codec(ranks_file, pattern)
        return _codecs[key]

    def text(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The raw bytes of all ids, one after the other, and where each id's bytes end."""
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.start[ids] - (ends - size), size)
        at += np.arange(len(at))
        return self.blob[at], ends

    def ids(self, text: str) -> np.ndarray:
        if not self.blank_rule or len(text) <= LONG_RUN or not (runs := [m.span() for m in LONG_BLANKS.finditer(text)]):
            return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        # the pattern takes a run of blanks as one match, but for the last blank before a non-blank;
        # such a match goes past the pattern's engine, whose stack it would not fit
        out, at = [], 0
        for a, b in runs:
            b -= b < len(text)
            if a > at:
                out.append(self.encoding.encode_to_numpy(text[at:a], disallowed_special=()))
            out.append(self._run(text[a:b]))
            at = b
        if at < len(text):
            out.append(self.encoding.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(out).astype(np.int32)

    def _run(self, blanks: str) -> np.ndarray:
        return np.array(self.encoding._encode_single_piece(blanks), np.int32)


LONG_RUN = 50_000
LONG_BLANKS = re.compile(f"[{''.join(sorted(BLANKS))}]{{{LONG_RUN},}}")


def id_lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    raw, offsets = tokens.buffers(column)
    for a, b, data, offs in tokens.slices(raw, offsets):
        blob = data.tobytes()
        yield a, b, [blob[s:e].decode("utf-8", "replace") for s, e in zip(offs[:-1], offs[1:], strict=True)]


def id_bytes(codec: Codec, rows: list[np.ndarray]) -> pa.Array:
    """The decoded bytes of each row's ids."""
    raw, ends = codec.text(np.concatenate(rows))
    cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum([len(r) for r in rows])))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])


def _encode(vocabulary, pattern: str, keep: list[str], decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary.value, pattern)
        for batch in batches:
            for a, b, texts in _texts(batch.column("text")):
                ids = [codec.ids(t) for t in texts]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in keep], id_lists(ids),
                                                  *([id_bytes(codec, ids)] if decoded else [])], [*keep, "ids", *["data"] * decoded])
    return run


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_pylist()
            for a, _, texts in _texts(batch.column("text")):
                for i, t in enumerate(texts):
                    starts = range(0, len(t), chunk)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([uids[a + i]] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()),
                        pa.array([s + chunk >= len(t) for s in starts], pa.bool_()),
                        pa.array([t[s:s + chunk + overlap] for s in starts], pa.string())], ["uid", "chunk", "last", "text"])
    return run


def splitter(pattern: str):
    """The pattern for the regex module; its white space is named, as the two engines differ on a few control characters."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def boundaries(text: str, pattern) -> list[int]:
    """The ends of the pre-tokens where a text may be cut.

    A run of blanks before a non-blank gives up its last blank; cut behind that blank the
    run would not, so that place is left out.
    """
    n = len(text)
    return [e for e in (m.end() for m in pattern.finditer(text)) if e == n or text[e - 1] not in BLANKS or text[e] in BLANKS]


def _edges(vocabulary, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = splitter(pattern)
        for batch in batches:
            numbers, last = batch.column("chunk").to_pylist(), batch.column("last").to_pylist()
            heads, tails, sure = [], [], []
            for a, _, texts in _texts(batch.column("text")):
                for i, t in enumerate(texts):
                    start = numbers[a + i] * chunk
                    ends = boundaries(t, compiled)
                    limit = len(t) if last[a + i] else len(t) - GUARD  # beyond it the window's end may have cut a pre-token
                    heads.append([start, *[start + e for e in ends if e <= min(overlap, limit)]])
                    tails.append([start + e for e in ends if chunk <= e <= limit])
                    plain = next((e for e in ends if e < min(chunk, len(t)) and t[e] in BLANKS and t[e - 1] not in BLANKS), None)
                    sure.append(None if plain is None else start + plain)
            yield pa.RecordBatch.from_arrays([
                batch.column("uid"), batch.column("chunk"), pa.array(heads, pa.list_(pa.int64())),
                pa.array(tails, pa.list_(pa.int64())), pa.array(sure, pa.int64())], ["uid", "chunk", "head", "tail", "sure"])
    return run


def stitch(chunks: list[tuple[list[int], list[int], int | None]]) -> list[tuple[int | None, int]]:
    """For each chunk (head, tail, sure) the cut where its piece begins, and the piece before it.

    None: no piece begins in this chunk; the piece before it goes on.
    """
    out, piece, tail = [], 0, None
    for c, (head, own_tail, sure) in enumerate(chunks):
        if c == 0:
            out.append((0, 0))
            tail = own_tail
            continue
        common = min(set(head) & set(tail), default=None)
        at = sure if common is None else common
        out.append((at, piece))
        if at is not None:
            piece = c
        tail = [] if at is None else [t for t in own_tail if t >= at]
    return out


def _cuts(chunk: int, overlap: int):
    """Per text: the piece that begins in each chunk, whether the chunk's window holds all of it, and the piece before."""
    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("chunk")
        sure = [None if pd.isna(x) else int(x) for x in pdf["sure"]]
        cuts = stitch(list(zip(pdf["head"].map(list), pdf["tail"].map(list), sure, strict=True)))
        until, end = [], None
        for at, _ in reversed(cuts):
            until.append(end)
            end = end if at is None else at
        until.reverse()
        last = len(cuts) - 1
        inside = [at is not None and (c == last if u is None else u <= (c + 1) * chunk + overlap)
                  for c, ((at, _), u) in enumerate(zip(cuts, until, strict=True))]
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "at": pd.array([a for a, _ in cuts], "Int64"),
                             "until": pd.array(until, "Int64"), "inside": inside, "before": [b for _, b in cuts],
                             "before_inside": [inside[b] for _, b in cuts]})
    return run


def _pieces(vocabulary, pattern: str, chunk: int):
    """Ids of the pieces that a chunk's window holds; of other pieces the part that lies in the chunk."""
    names = ["uid", "piece", "chunk", "ids", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary.value, pattern)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("uid", "chunk", "at", "until", "inside", "before", "before_inside")]
            rows = list(zip(*columns, strict=True))
            for a, _, texts in _texts(batch.column("text")):
                out: list[tuple] = []
                for (uid, number, at, until, inside, before, before_inside), t in zip(rows[a:a + len(texts)], texts, strict=True):
                    start = number * chunk
                    if at is None:
                        out.append((uid, before, number, None, t[:chunk]))
                        continue
                    if not before_inside and at > start:
                        out.append((uid, before, number, None, t[:at - start]))
                    if inside:
                        out.append((uid, number, number, codec.ids(t[at - start:None if until is None else until - start]).tobytes(), None))
                    else:
                        out.append((uid, number, number, None, t[at - start:chunk]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], names)
    return run


def _join(vocabulary, pattern: str, decoded: bool):
    """The ids of each text: its pieces in order; parts of a piece are put together first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary.value, pattern)
        for batch in batches:
            for uid, pieces in zip(batch.column("uid").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                ids, parts, open_piece = [], [], None
                for p in [*pieces, None]:
                    if parts and (p is None or p["piece"] != open_piece):
                        ids.append(codec.ids("".join(parts)))
                        parts = []
                    if p is None:
                        continue
                    open_piece = p["piece"]
                    if p["ids"] is None:
                        parts.append(p["part"])
                    else:
                        ids.append(np.frombuffer(p["ids"], np.int32))
                whole = [np.concatenate(ids)]
                yield pa.RecordBatch.from_arrays([pa.array([uid], pa.int64()), id_lists(whole), *([id_bytes(codec, whole)] if decoded else [])],
                                                  ["uid", "ids", *["data"] * decoded])
    return run


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) per row of ``docs``; with ``decoded`` also data, the ids decoded
    again by the task that made them."""
    shape = "ids array<int>" + ", data binary" * decoded
    spark = docs.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select("doc_id", text_of().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    one = rows.filter(F.length("text") <= chunk).mapInArrow(
        _encode(vocabulary, pattern, ["doc_id"], decoded), f"doc_id {kind}, {shape}")

    # the rest is numbered once and kept, so that every later step sees the same numbers
    n = shuffle_parts(spark)
    whole = cut(rows.filter(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id()))
    parts = whole.mapInArrow(_chunks(chunk, overlap), "uid long, chunk int, last boolean, text string").repartition(n, "uid", "chunk")
    edges = parts.mapInArrow(_edges(vocabulary, pattern, chunk, overlap), "uid long, chunk int, head array<long>, tail array<long>, sure long")
    cuts = edges.groupBy("uid").applyInPandas(
        _cuts(chunk, overlap), "uid long, chunk int, at long, until long, inside boolean, before int, before_inside boolean")
    pieces = parts.join(cuts, ["uid", "chunk"]).select("uid", "chunk", "text", "at", "until", "inside", "before", "before_inside")
    pieces = pieces.mapInArrow(_pieces(vocabulary, pattern, chunk), "uid long, piece int, chunk int, ids binary, part string")
    pieces = pieces.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("piece", "chunk", "ids", "part"))).alias("pieces"))
    joined = pieces.mapInArrow(_join(vocabulary, pattern, decoded), f"uid long, {shape}")
    return one.union(whole.select("doc_id", "uid").join(joined, "uid").drop("uid"))


def _decode(vocabulary, pattern: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary.value, pattern)
        for batch in batches:
            column = batch.column("ids")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            row = 0
            while row < len(column):
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 18), side="right")) - 1)
                raw, ends = codec.text(values[offsets[row]:offsets[end]])
                cuts = np.concatenate(([0], ends))[offsets[row:end + 1] - offsets[row]].astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), end - row, [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(row, end - row) for c in keep], column.slice(row, end - row), data],
                                                  [*keep, "ids", "data"])
                row = end
    return run


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and data (the decoded bytes) per row of ``encoded`` (doc_id, ids)."""
    ship(encoded.sparkSession)
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(_decode(vocabulary, pattern, ["doc_id"]),
                                                      f"doc_id {kind}, ids array<int>, data binary")


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, per row of ``docs``."""
    import public_tokenizers

    path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    back = encode(docs, path, pattern, decoded=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("data", 256).alias("decoded_sha256"))


def op2_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
