"""Token counts of a piece vocabulary: rank-synchronous merging of ragged numpy arrays.

* A text is cut into pre-tokens wherever two neighbouring characters occur next to each
  other in no piece of the vocabulary.  No merge can span such a place, so each pre-token
  is a sequence of its own; equal pre-tokens of a batch are merged once.
* All sequences of a batch lie in one flat array of symbols.  In a round every sequence
  finds the lowest rank among its adjacent pairs and all of them apply it at once, at
  every place where it occurs.  A sequence without a mergeable pair leaves the batch, and
  the symbols it still has are its tokens.
* Merging all places of a rank at once equals merging them one after the other as long as
  the new neighbours have higher ranks.  Where a round makes a pair of the same or a lower
  rank (runs of blanks, whose pieces share a rank), that sequence takes the leftmost place
  only; a sequence of more than ``LONG`` symbols goes on with a heap instead.

Works on sentencepiece BPE models with identity normalisation: a blank becomes the mark
U+2581, a text that is not empty begins with one, a character without piece counts one
token per UTF-8 byte if the model has byte pieces, else one; control strings such as
``<s>`` are ordinary text.

Defined results: a null or empty text has no bytes and no tokens; rows that repeat an id
are rows of their own, ids may be null; an empty table gives no rows; columns other than
id and text are ignored.  A text of any length is read in windows; memory is bounded by a
window and by the longest pre-token.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from ledgerflow.llm import tokens
from ledgerflow.llm.common import ship, table

MARK, WINDOW, LONG, LIMIT = "▁", 1 << 21, 256, 4096
NONE = np.iinfo(np.int32).max
_known: dict[str, "Pieces"] = {}


class Pieces:
    """Merge table of a model, built once per worker from the model file."""

    def __init__(self, model: bytes):
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        if any(m.is_unused(i) for i in ids) or m.normalize(" Åﬁ  x ") != f"{MARK}{MARK}Åﬁ{MARK}{MARK}x{MARK}":
            raise ValueError("only models with identity normalisation, a leading blank and no unused pieces")
        names = [m.id_to_piece(i) for i in ids]
        ranks = np.unique([-m.get_score(i) for i in ids], return_inverse=True)[1].astype(np.int32)
        chars = sorted(set("".join(names)))
        symbol = {c: k for k, c in enumerate(chars)}          # single characters first, in code point order
        symbol.update({p: len(chars) + k for k, p in enumerate(n for n in names if len(n) > 1)})
        fallback = any(m.is_byte(i) for i in range(m.get_piece_size()))
        alone = set(names)
        self.bytes_each = fallback
        self.weight = np.ones(len(symbol), np.int64)
        for c in chars:
            if c not in alone and fallback:
                self.weight[symbol[c]] = len(c.encode())
        self.char = np.zeros(0x110000, np.int32)              # code point -> symbol + 1, 0 without
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.touch = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        pairs = {}
        for name, rank in zip(names, ranks, strict=True):
            for a, b in zip(name, name[1:]):
                self.touch[symbol[a] + 1, symbol[b] + 1] = True
            for cut in range(1, len(name)):
                left, right = symbol.get(name[:cut]), symbol.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left * len(symbol) + right] = (int(rank), symbol[name])
        self.size = len(symbol)
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.rank = np.array([pairs[k][0] if k in pairs else NONE for k in self.keys.tolist()], np.int32)
        self.made = np.array([pairs[k][1] if k in pairs else 0 for k in self.keys.tolist()], np.int32)

    @cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))

    @staticmethod
    def of(model: bytes) -> "Pieces":
        key = hashlib.sha1(model).hexdigest()
        if key not in _known:
            _known[key] = Pieces(model)
        return _known[key]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; rank ``NONE`` if it cannot be merged."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.rank[at], NONE), self.made[at]

    # ------------------------------------------------------------------ merging
    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; ``symbols`` holds the sequences one after the other."""
        tokens_of = np.zeros(len(sizes), np.int64)
        owner = np.arange(len(sizes))
        rank, made = self._ranks(symbols, sizes)
        while len(owner):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            done = best == NONE
            if done.any():
                tokens_of[owner[done]] = np.add.reduceat(self.weight[symbols], starts)[done]
                stay = np.repeat(~done, sizes)
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                owner, sizes, best = owner[~done], sizes[~done], best[~done]
                continue
            of = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rank == best[of])
            first = np.concatenate(([True], np.diff(at) != 1))        # places that overlap: every second one
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))) % 2 == 0]
            step = self._apply(symbols, rank, made, of, at)
            early = np.zeros(len(sizes), bool)
            early[step[4][step[5] <= best[step[4]]]] = True           # a new pair that comes before the others
            early &= np.bincount(of[at], minlength=len(sizes)) > 1
            if early.any():
                leftmost = np.concatenate(([True], of[at][1:] != of[at][:-1]))
                step = self._apply(symbols, rank, made, of, at[leftmost | ~early[of[at]]])
            symbols, rank, made, of = step[:4]
            sizes = np.bincount(of, minlength=len(sizes))
            heavy = early & (sizes > LONG)
            if heavy.any():
                ends = np.cumsum(sizes)
                for s in np.flatnonzero(heavy):
                    tokens_of[owner[s]] = self._by_heap(symbols[ends[s] - sizes[s]:ends[s]])
                stay = np.repeat(~heavy, sizes)
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                owner, sizes = owner[~heavy], sizes[~heavy]
        return tokens_of

    def _ranks(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], made[:-1] = self.pair(symbols[:-1], symbols[1:])
        rank[np.cumsum(sizes) - 1] = NONE
        return rank, made

    def _apply(self, symbols, rank, made, of, at):
        """The arrays after merging the pairs at ``at``, with the sequence and rank of each new pair."""
        symbols, rank, made = symbols.copy(), rank.copy(), made.copy()
        symbols[at] = made[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        symbols, rank, made, of = symbols[keep], rank[keep], made[keep], of[keep]
        new = place[at]
        new = np.unique(np.concatenate([new, new[new > 0] - 1]))
        inner = np.zeros(len(new), bool)
        short = new < len(symbols) - 1
        inner[short] = of[new[short]] == of[new[short] + 1]
        rank[new] = NONE
        new = new[inner]
        rank[new], made[new] = self.pair(symbols[new], symbols[new + 1])
        return symbols, rank, made, of, of[new], rank[new]

    def _by_heap(self, symbols: np.ndarray) -> int:
        """Tokens of one long sequence, merged place by place."""
        value, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self.table

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                hit = table.get(value[i] * self.size + value[after[i]])
                if hit:
                    heapq.heappush(heap, (hit[0], i, value[i], value[after[i]], hit[1]))

        heap: list[tuple] = []
        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if value[i] != left or j >= n or value[j] != right:
                continue
            value[i], value[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return int(sum(self.weight[v] for v in value if v >= 0))

    # ------------------------------------------------------------------ texts
    def count(self, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token of a run of code points; ``cuts`` are their starts."""
        if not len(cuts):
            return np.zeros(0, np.int64)
        wide = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        ends = np.append(cuts[1:], len(codes))
        byte = np.concatenate(([0], np.cumsum(wide)))[np.append(cuts, len(codes))]
        blob = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        words = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(byte.astype(np.int64)), pa.py_buffer(blob)])
        index = words.dictionary_encode().indices.to_numpy()
        first = np.zeros(index.max() + 1, np.int64)
        first[index[::-1]] = np.arange(len(index))[::-1]
        start, size = cuts[first], (ends - cuts)[first]
        known = self.char[codes[start]] > 0
        out = np.where(known, 0, wide[start] if self.bytes_each else 1)
        start, size = start[known], size[known]
        if len(start):
            flat = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out[known] = self.merge(self.char[codes[flat]] - 1, size)
        return out[index]

    def cuts(self, codes: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens."""
        if not len(codes):
            return np.zeros(0, np.int64)
        index = self.char[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.touch[index[:-1], index[1:]]
        cut[row_starts] = True
        return np.flatnonzero(cut)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice."""
        filled = np.diff(offsets) > 0
        head = (data & 0xC0) != 0x80
        starts = np.concatenate(([0], np.cumsum(head)))[offsets[:-1]][filled]
        codes = _codes(data.tobytes())
        codes = np.insert(codes, starts, ord(MARK))
        starts = starts + np.arange(len(starts))
        cuts = self.cuts(codes, starts)
        sums = np.concatenate(([0], np.cumsum(self.count(codes, cuts))))
        at = np.searchsorted(cuts, np.append(starts, len(codes)))
        out = np.zeros(len(filled), np.int64)
        out[filled] = np.diff(sums[at])
        return out

    def long_text(self, data: np.ndarray, window: int) -> int:
        """Tokens of one long text, window by window; an unfinished pre-token goes to the next window."""
        total, at, n, step = 0, 0, len(data), window
        rest = np.array([ord(MARK)], np.uint32)
        while at < n:
            end = min(at + step, n)
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
            codes = np.concatenate([rest, _codes(data[at:end].tobytes())])
            cuts = self.cuts(codes, np.zeros(1, np.int64))
            last = len(codes) if end == n else int(cuts[-1])
            total += int(self.count(codes[:last], cuts[cuts < last]).sum())
            rest, at = codes[last:], end
            step = max(window, 4 * len(rest))
        return total


def _codes(blob: bytes) -> np.ndarray:
    """Code points of UTF-8 bytes, blanks as marks."""
    codes = np.frombuffer(blob.decode("utf-8").encode("utf-32-le"), "<u4").astype(np.uint32)
    codes[codes == 0x20] = ord(MARK)
    return codes


def _valid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts; bytes that are no UTF-8 become U+FFFD, as in the library."""
    raw, offsets = tokens.buffers(column)
    try:
        raw[offsets[0]:offsets[-1]].tobytes().decode("utf-8")
        return raw, offsets
    except UnicodeDecodeError:
        texts = [raw[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _count(model, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for batch in batches:
            pieces = pieces or Pieces.of(model.value)
            raw, offsets = _valid(batch.column(1))
            out = np.zeros(batch.num_rows, np.int64)
            for a, b, data, offs in tokens.slices(raw, offsets, window):
                out[a:b] = [pieces.long_text(data, window)] if b == a + 1 and len(data) > window else pieces.rows(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), batch.column(2)], ["id", "n_tokens", "n_bytes"])
    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) per row of ``docs``."""
    ship(docs.sparkSession)
    with open(model_path, "rb") as file:        # a vocabulary: its size does not grow with the data
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(_count(model, window), f"id {kind}, n_tokens long, n_bytes long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op13_token_counts(spark, sf_dir):
    """Every whole text of ``documents`` by the piece model of 32,000 pieces; over_limit above 4096 tokens."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
