"""Quality classifier from weak labels: labellers, expectation-maximisation, linear scorer.

1. Overlapping heuristic labellers vote good, bad or abstain on every document.  Only the
   counts of vote patterns leave the tasks (at most 3^8 patterns).
2. Expectation-maximisation over these counts, which cover all documents, estimates how
   often each labeller votes what on good and on bad text, and so the posterior of every
   pattern.
3. The posteriors are the training targets of a logistic scorer over hashed words and word
   shapes: single shapes, neighbouring shapes, and marks of words that repeat the one
   before, that were there already in their block of ``BLOCK`` words, and that end a run of
   ``RUN`` words the document had before.  The shares of the marks are the statistics the
   labellers look at.  It is trained on a sample of about ``TRAIN_ROWS`` documents drawn by
   a hash of id and text.
4. The scorer alone decides on every document, over its whole text.

Defined results: a document without words (null, empty, blank) gets score 0 and is not
kept; null ids and repeated rows are rows like any other; extra columns pass through
``keep_good`` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerflow.llm import tokens
from ledgerflow.llm.common import cut, ship, table, text_of

TRAIN_ROWS = 20_000
SHAPES, FEATURES = 1 << 12, 1 << 14  # shapes and marks come first, then words
BLOCK, RUN = 256, 5
ROUNDS, STEPS = 40, 300
GOOD, BAD = 1, 2

LABELLERS = ("repeats", "variety", "capitals", "symbols", "bare_marks", "sentence_ends", "marked_ends", "shouting")

_CLASS = np.zeros(256, np.uint64)
_CLASS[:128] = np.arange(128) + 10
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[128:] = 1
_LETTER = (_CLASS == 1) | (_CLASS == 2)
_SOLID = _LETTER | (_CLASS == 3)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True


def _later(keys: np.ndarray) -> np.ndarray:
    """Where a key was there before."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


class Words:
    """Word table of a slice: hash, row, last byte and counts per word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.rows = len(offsets) - 1
        blank = tokens.SPACE[data] if len(data) else np.zeros(0, bool)
        first = ~blank
        if len(data):
            first[1:] &= blank[:-1]
            inner = offsets[1:-1][offsets[1:-1] < len(data)]
            first[inner] = ~blank[inner]
        self.starts = np.flatnonzero(first)
        self.hashes, self.at = tokens.words(data, offsets)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.at))
        self.data, self.blank = data, blank
        self.seen, self.echo = self._seen(), self._echo()

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each word where ``mask`` holds (blanks never count)."""
        return np.add.reduceat((mask & ~self.blank).astype(np.int32), self.starts) if len(self.starts) else np.zeros(0, np.int32)

    def _seen(self) -> np.ndarray:
        """Words that were there already in their block of ``BLOCK`` words: a share that does not grow with the length."""
        block = (np.arange(len(self.row)) - self.at[self.row]) // BLOCK
        place = tokens.mix((self.row.astype(np.uint64) << np.uint64(32)) + block.astype(np.uint64))
        return _later(tokens.mix(self.hashes + place))

    def _echo(self) -> np.ndarray:
        """Words that end a run of ``RUN`` words which the document had before."""
        out, n = np.zeros(len(self.row), bool), len(self.row) - RUN + 1
        if n > 0:
            run = self.row[:n].astype(np.uint64)
            for k in range(RUN):
                run = tokens.mix(run * np.uint64(0x9E3779B97F4A7C15) + self.hashes[k:k + n])
            whole = np.flatnonzero(self.row[:n] == self.row[RUN - 1:])
            out[whole + RUN - 1] = _later(run[whole])
        return out

    def per_row(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, self.rows)


def statistics(w: Words) -> dict[str, np.ndarray]:
    n = np.diff(w.at).astype(float)
    safe = np.maximum(n, 1)
    raw = w.data
    length = w.sums(np.ones(len(raw), bool))
    letters, solid = w.sums(_LETTER[raw]), w.sums(_SOLID[raw])
    again = np.zeros(len(w.hashes), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.row[1:] == w.row[:-1])
    last = raw[w.starts + length - 1] if len(length) else np.zeros(0, np.uint8)
    bytes_of = np.maximum(w.per_row(length), 1)
    letters_of = np.maximum(w.per_row(letters), 1)
    ends = np.isin(last, [ord(c) for c in ".!?:;"])
    return {
        "n": n, "repeats": w.per_row(again) / safe, "variety": 1 - w.per_row(w.seen) / safe, "echoes": w.per_row(w.echo) / safe,
        "capitals": w.per_row(w.sums(_CLASS[raw] == 2)) / letters_of, "symbols": w.per_row(w.sums(_SYMBOL[raw])) / bytes_of,
        "bare_marks": w.per_row(solid == 0) / safe, "sentence_ends": w.per_row(ends) / safe,
        "marked_ends": w.per_row(_SYMBOL[last]) / safe, "shouting": w.per_row(last == ord("!")) / safe}


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """Vote patterns, one number per document: base 3, 0 abstains, 1 good, 2 bad."""
    some, many = s["n"] >= 1, s["n"] >= 40

    def vote(bad: np.ndarray, good: np.ndarray, may: np.ndarray) -> np.ndarray:
        return np.where(~may, 0, np.where(bad, BAD, np.where(good, GOOD, 0)))

    each = [
        vote(s["repeats"] > 0.2, s["repeats"] < 0.05, s["n"] >= 5),
        vote((s["variety"] < 0.12) | (s["echoes"] > 0.5), (s["variety"] > 0.25) & (s["echoes"] < 0.2), many),
        vote(s["capitals"] > 0.5, s["capitals"] < 0.15, some),
        vote(s["symbols"] > 0.08, s["symbols"] < 0.04, some),
        vote(s["bare_marks"] > 0.2, s["bare_marks"] < 0.05, some),
        vote(s["sentence_ends"] == 0, s["sentence_ends"] > 0.02, many),
        vote(s["marked_ends"] > 0.25, s["marked_ends"] < 0.05, some),
        vote(s["shouting"] > 0.3, s["shouting"] < 0.1, some)]
    code = np.zeros(len(s["n"]), np.int64)
    for v in reversed(each):
        code = code * 3 + v
    return code


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word: its shape, the pair with the shape before, the marks, the word itself."""
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[w.data]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[w.starts] = True
    change &= ~w.blank
    at = np.flatnonzero(change)  # a shape is the word's classes without immediate repeats
    word = np.searchsorted(w.starts, at, side="right") - 1
    first = np.searchsorted(at, w.starts)
    place = np.minimum(np.arange(len(at)) - first[word], 15)
    value = tokens.mix(kind[at] * np.uint64(31) + place.astype(np.uint64))
    shape = tokens.mix(np.add.reduceat(value, first))
    before = np.full(len(shape), 1, np.uint64)
    same_row = w.row[1:] == w.row[:-1]
    before[1:][same_row] = shape[:-1][same_row]
    again = np.zeros(len(shape), np.uint64)
    again[1:] = same_row & (w.hashes[1:] == w.hashes[:-1])
    pair = tokens.mix(before * np.uint64(0x9E3779B97F4A7C15) + shape)
    mark, seen, echo = (tokens.mix(x.astype(np.uint64) + np.uint64(k)) for x, k in ((again, 77), (w.seen, 177), (w.echo, 277)))
    hashed = [(x % np.uint64(SHAPES)).astype(np.int64) for x in (shape, pair, mark, seen, echo)]
    words = (w.hashes % np.uint64(FEATURES - SHAPES)).astype(np.int64) + SHAPES
    return np.concatenate([w.row] * 6), np.concatenate([*hashed, words])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    raw, offsets = tokens.buffers(batch.column("text"))
    for a, b, data, offs in tokens.slices(raw, offsets):
        yield a, b, Words(data, offs)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, w in _slices(batch):
            s = statistics(w)
            code, n = np.unique(votes(s)[s["n"] > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["votes", "n"])


def fit_votes(codes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> dict[int, float]:
    """P(good) of each vote pattern by expectation-maximisation (Dawid and Skene's model)."""
    m = len(LABELLERS)
    each = (codes[:, None] // 3 ** np.arange(m)) % 3
    # begin with the alarms: each labeller looks for another fault, so one bad vote outweighs any number of good ones
    good = np.where((each == BAD).any(1), 0.1, 0.9)
    for _ in range(rounds):
        prior = (n @ good + 1) / (n.sum() + 2)
        logit = np.log(prior / (1 - prior)) * np.ones(len(codes))
        for j in range(m):
            yes = np.array([n @ (good * (each[:, j] == v)) + 1 for v in (GOOD, BAD)])
            no = np.array([n @ ((1 - good) * (each[:, j] == v)) + 1 for v in (GOOD, BAD)])
            logit += np.append(0, np.log((yes / yes.sum()) / (no / no.sum())))[each[:, j]]  # to abstain says nothing
        good = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
    return dict(zip(codes.tolist(), good.tolist(), strict=True))


def _examples(posterior: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in _slices(batch):
                s = statistics(w)
                code = votes(s)
                row, feature = features(w)
                key, times = np.unique(row * FEATURES + feature, return_counts=True)
                cuts = np.searchsorted(key, np.arange(w.rows + 1) * FEATURES)
                use = [i for i in range(w.rows) if s["n"][i] > 0]
                yield pa.RecordBatch.from_arrays([
                    pa.array([posterior[int(code[i])] for i in use], pa.float64()),
                    pa.array([(key[cuts[i]:cuts[i + 1]] % FEATURES).tolist() for i in use], pa.list_(pa.int64())),
                    pa.array([(times[cuts[i]:cuts[i + 1]] / s["n"][i]).tolist() for i in use], pa.list_(pa.float64()))], ["target", "at", "share"])
    return run


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logistic regression on the sample, both classes with the same total weight."""
    target, at, share, size = [], [], [], []
    for batch in batches:
        target.append(batch.column("target").to_numpy(zero_copy_only=False))
        at.append(batch.column("at").flatten().to_numpy(zero_copy_only=False))
        share.append(batch.column("share").flatten().to_numpy(zero_copy_only=False))
        size.append(np.diff(batch.column("at").offsets.to_numpy()))
    weights = np.zeros(FEATURES + 1)
    if target and sum(map(len, target)):
        y, at, share = np.concatenate(target), np.concatenate(at), np.concatenate(share)
        row = np.repeat(np.arange(len(y)), np.concatenate(size))
        good, bad = max(y.sum(), 1e-3), max((1 - y).sum(), 1e-3)
        mean, var, rate = np.zeros_like(weights), np.zeros_like(weights), 0.3
        for step in range(1, STEPS + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[at] * share, len(y)) + weights[-1], -30, 30)))
            err = (1 - y) / bad * p - y / good * (1 - p)
            grad = np.append(np.bincount(at, err[row] * share, FEATURES), err.sum()) + 1e-5 * np.append(weights[:-1], 0)
            mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad * grad
            weights -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.999 ** step)) + 1e-9)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64()))], ["weights"])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[dict[int, float], np.ndarray]:
    """(posterior of each vote pattern, weights of the scorer)."""
    ship(docs.sparkSession)
    texts = docs.select("doc_id", text_of().alias("text"))
    counts = texts.select("text").mapInArrow(_patterns, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    if not counts:
        return {}, np.zeros(FEATURES + 1)
    codes, n = np.array([r["votes"] for r in counts]), np.array([float(r["n"]) for r in counts])
    order = np.argsort(codes)
    posterior = fit_votes(codes[order], n[order])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    part = texts.filter(draw < int((1 << 30) * min(1.0, train_rows / n.sum())))
    examples = part.select("text").mapInArrow(_examples(posterior), "target double, at array<long>, share array<double>")
    # the sample is written first, so that the one training task reads nothing but the sample
    return posterior, np.array(cut(examples).coalesce(1).mapInArrow(_train, "weights array<double>").first()["weights"])


def scores(w: Words, weights: np.ndarray) -> np.ndarray:
    """P(good) of each document; 0 without words."""
    row, feature = features(w)
    n = np.diff(w.at)
    logit = np.bincount(row, weights[feature], w.rows) / np.maximum(n, 1) + weights[-1]
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(logit, -500, 500))), 0.0)


def _score(posterior: dict[int, float], weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in _slices(batch):
                s = statistics(w)
                weak = [posterior.get(int(c)) if n else None for c, n in zip(votes(s), s["n"], strict=True)]
                p = scores(w, weights.value)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(s["n"].astype(np.int64)), pa.array(weak, pa.float64()),
                    pa.array(p), pa.array(p >= 0.5)], ["doc_id", "n_words", "weak_label", "score", "kept"])
    return run


def _filter(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [scores(w, weights.value) >= 0.5 for _, _, w in _slices(batch)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))
    return run


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, weak_label, score, kept per row of ``docs``."""
    posterior, weights = fit(docs)
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select("doc_id", "text").mapInArrow(_score(posterior, sent), f"doc_id {kind}, n_words long, weak_label double, score double, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with their columns as they were."""
    _, weights = fit(docs)
    return docs.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(weights)), docs.schema)


def op4_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"))
