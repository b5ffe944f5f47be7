"""Conversation structure repair: rank-convergent parallel Viterbi over chunks of rows.

The cheapest edits turn the roles of a conversation into ``(s?(ua)+)?`` (role initials):
keep a row (0), give it the role user or assistant (1), delete it (2), insert an empty row
of either role (5); a truncated row that stays costs 5 more.  Blank rows and rows whose
role and text were seen before must go, so they need no decision.  The other rows are
numbered by distributed prefix sums and cut into chunks of ``CHUNK`` rows, one small code
per row; a conversation of any length is spread over many tasks.

* Backward costs: four numbers, the cheapest way to the end from each state (nothing yet,
  after s, after u, after a).  All chunks start at once from a speculative vector, the one
  at a conversation's end.  A fix-up pass gives each chunk the vector its right neighbour
  found; a chunk is run again only if that differs from the one it used by more than a
  constant, and only until both runs differ by a constant.  Passes go on until no chunk
  is open.  Rows on which two vectors never meet (a long run of unknown roles) would need
  a pass per chunk: after ``PASSES`` passes the chunks of such conversations are run from
  the four unit vectors and joined by those (four by four numbers a chunk).
* Tracing: with the right vectors known, each chunk finds where it ends from each of the
  four states; these maps are followed from chunk to chunk, and then every chunk traces
  its edits, the least letter first among those that stay cheapest (D < I < K < R).

``repair`` returns one row per edit; ``audits`` derives the report per conversation.
Texts are moved only to join them with the edits that keep them and, for the digest, into
the order of their conversation; one task hashes a conversation, row by row, since SHA-256
cannot be split.

Defined results: a null role or text counts as one blank, a null conv_id is a conversation
of its own; rows go by turn (nulls first), equal turns by role, then by the SHA-256 of the
text; repeated rows are rows of their own, of which all but the first are duplicates; an
empty table gives no rows; columns other than the four are ignored; texts of any length
are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerflow.llm.common import cut, ordered_prefix, ship, table

CHUNK, PASSES, GROUP = 4096, 8, 1 << 19
BLANKS = " \t\n\x0b\x0c\r"
RECAST, DELETE, INSERT, BROKEN = 1, 2, 5, 5
FAR = 1 << 40
# states: 0 nothing yet, 1 after s, 2 after u, 3 after a
NEXT = np.array([2, 2, 3, 2])                                   # after a user or assistant row
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])  # by class of the row: s u a other
END = np.array([0, 2 * INSERT, INSERT, 0])
SUMS = "n_rows", "blank", "duplicate", "truncated", "illegal"


# ---------------------------------------------------------------- damage and faults
def damaged(conversations: DataFrame) -> DataFrame:
    """conv (key), turn, role, text, weight: the rows after the planted damage; a repeated row has weight 2."""
    rows = conversations.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
                                F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_kind", F.crc32(key) % 20).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("_kind") == 3, 2).otherwise(1).cast("long").alias("weight"))


def _trimmed(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def _row_class(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).cast("byte")


def _same(rows: DataFrame) -> DataFrame:
    """Rows with the digest of their text, which stands for the text until it is needed."""
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def units(rows: DataFrame) -> DataFrame:
    """Equal rows as one: conv, turn, role, digest, copies, pos (of the first copy), blank, broken, first, cls.

    ``first`` tells that no earlier row has the role and text; the copies after the first
    of a unit are duplicates.
    """
    narrow = _same(rows).select("conv", "turn", "role", "digest", "weight", (_trimmed(F.col("text")) == "").alias("blank"),
                                (~F.substring(_trimmed(F.col("text")), -1, 1).isin(".", "!", "?")).alias("broken"))
    narrow = narrow.groupBy("conv", "turn", "role", "digest", "blank", "broken").agg(F.sum("weight").alias("copies"))
    placed = cut(ordered_prefix(narrow, ["conv"], ["turn", "role", "digest"], {"pos": "copies"}))
    first = placed.filter(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("first"))
    return cut(placed.join(first, ["conv", "pos"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
               .withColumn("cls", _row_class(F.col("role"))))


def fault_counts(parts: DataFrame) -> DataFrame:
    """Per conv: rows, blank, duplicate, truncated, illegal neighbours and gaps in the turns."""
    after = parts.select("conv", F.col("pos").alias("_at"), F.col("cls").alias("_next"))
    pairs = parts.withColumn("_at", F.col("pos") + F.col("copies")).join(after, ["conv", "_at"], "left")
    legal = ((F.col("_next") == 1) & F.col("cls").isin(0, 2)) | ((F.col("_next") == 2) & (F.col("cls") == 1))
    stays = ~F.col("blank") & F.col("first")
    counts = {"n_rows": F.col("copies"), "blank": F.when(F.col("blank"), F.col("copies")),
              "duplicate": F.when(~F.col("blank"), F.col("copies") - F.col("first").cast("long")),
              "truncated": (stays & F.col("broken")).cast("long"),
              "illegal": F.col("copies") - 1 + (F.col("_next").isNotNull() & ~legal).cast("long")}
    turns = pairs.groupBy("conv", "turn").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(k) for k, c in counts.items()])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv").agg(*[F.sum(k).alias(k) for k in SUMS], F.coalesce(gaps, F.lit(0)).alias("gaps"))


# ---------------------------------------------------------------- costs of a run of rows
def _closed(v: np.ndarray) -> np.ndarray:
    """Costs when rows may be inserted first."""
    for _ in range(2):
        v = np.minimum(v, INSERT + v[:, NEXT])
    return v


def _before(v: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Costs in front of a row from the costs behind it, for many chunks at once."""
    stay = BROKEN * (codes & 1)[:, None]
    to = KEPT[codes >> 1]
    keep = np.where(to < 0, FAR, np.take_along_axis(v, np.maximum(to, 0), axis=1) + stay)
    return _closed(np.minimum(np.minimum(v + DELETE, v[:, NEXT] + RECAST + stay), keep))


class Runs:
    """Chunks of row codes, longest first, worked on in step."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.flat, self.ends, self.sizes = flat, ends[self.order], sizes[self.order]
        self.most = int(sizes.max(initial=0))

    def active(self, step: int) -> int:
        return int(np.searchsorted(-self.sizes, -step, side="left"))

    def _back(self, given: np.ndarray) -> np.ndarray:
        out = np.empty_like(given)
        out[self.order] = given
        return out

    def left(self, right: np.ndarray, seen: Callable | None = None) -> np.ndarray:
        """The costs in front of each chunk from those behind it."""
        v = right[self.order].copy()
        for t in range(self.most):
            m = self.active(t)
            at = self.ends[:m] - 1 - t
            if seen:
                seen(at, v[:m])
            v[:m] = _before(v[:m], self.flat[at])
        return self._back(v)

    def fixed(self, right: np.ndarray, old_right: np.ndarray, old_left: np.ndarray) -> np.ndarray:
        """As ``left``, running only until the vectors differ from those of the old run by a constant."""
        v, old, out = right[self.order].copy(), old_right[self.order].copy(), old_left[self.order].copy()
        live = np.arange(len(v))
        for t in range(self.most):
            gap = v[live] - old[live]
            apart = (gap != gap[:, :1]).any(axis=1)
            ended = apart & (self.sizes[live] <= t)
            out[live[ended]] = v[live[ended]]
            live = live[apart & ~ended]
            if not len(live):
                break
            codes = self.flat[self.ends[live] - 1 - t]
            v[live], old[live] = _before(v[live], codes), _before(old[live], codes)
        gap = v[live] - old[live]
        apart = live[(gap != gap[:, :1]).any(axis=1)]
        out[apart] = v[apart]
        return self._back(out)

    def trace(self, right: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state behind each chunk, edit of each row): 12 * state before + 4 * inserted rows + 0 D, 2 K, 3 R."""
        behind = np.zeros((len(self.flat), 4), np.int64)

        def note(at: np.ndarray, v: np.ndarray) -> None:
            behind[at] = v

        self.left(right, note)
        state, edits = entry[self.order].copy(), np.zeros(len(self.flat), np.int8)
        for t in range(self.most):
            m = self.active(t)
            at = self.ends[:m] - self.sizes[:m] + t
            codes, v, s, who = self.flat[at], behind[at], state[:m].copy(), np.arange(m)
            w = _before(v, codes)
            inserted = np.zeros(m, np.int64)
            for _ in range(2):
                add = (DELETE + v[who, s] != w[who, s]) & (INSERT + w[who, NEXT[s]] == w[who, s])
                s = np.where(add, NEXT[s], s)
                inserted += add
            drop = DELETE + v[who, s] == w[who, s]
            to = KEPT[codes >> 1, s]
            keep = ~drop & (to >= 0) & (v[who, np.maximum(to, 0)] + BROKEN * (codes & 1) == w[who, s])
            edits[at] = 12 * state[:m] + 4 * inserted + np.where(drop, 0, np.where(keep, 2, 3))
            state[:m] = np.where(drop, s, np.where(keep, to, NEXT[s]))
        return self._back(state), edits


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Runs]]:
    """Slices of a batch with about ``GROUP`` rows in their chunks."""
    codes = batch.column("codes")
    offsets, values = codes.offsets.to_numpy(), codes.values.to_numpy(zero_copy_only=False)
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP, side="right")) - 1)
        part = offsets[row:end + 1]
        yield batch.slice(row, end - row), Runs(values[part[0]:part[-1]].astype(np.int64), part[1:] - part[0], np.diff(part))
        row = end


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.array(rows.tolist(), pa.list_(pa.int64()))


def _per_chunk(work: Callable[[pa.RecordBatch, Runs], np.ndarray], name: str):
    """Task: conv, chunk and one list of numbers for each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, runs in _groups(batch):
                yield pa.RecordBatch.from_arrays([part.column("conv"), part.column("chunk"), _lists(work(part, runs))], ["conv", "chunk", name])
    return run


def _each(chunks: DataFrame, work: Callable, name: str) -> DataFrame:
    return chunks.mapInArrow(_per_chunk(work, name), f"conv string, chunk long, {name} array<long>")


def _speculate(part, runs):
    return runs.left(_vectors(part.column("right")))


def _fix(part, runs):
    return runs.fixed(*[_vectors(part.column(c)) for c in ("want", "right", "left")])


def _units(part, runs):
    n = part.num_rows
    return np.hstack([runs.left(np.tile(np.where(np.arange(4) == k, 0, FAR), (n, 1))) for k in range(4)])


def _exits(part, runs):
    right = _vectors(part.column("right"))
    return np.stack([runs.trace(right, np.full(part.num_rows, s))[0] for s in range(4)], axis=1)


def _follow(start: list[int], step: Callable[[list[int], list[int]], list[int]], name: str):
    """Task over sorted chunks: the value in front of each chunk, carried along its conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, value = None, start
        for batch in batches:
            seen = []
            for c, numbers in zip(batch.column("conv").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                if c != conv:
                    conv, value = c, start
                seen.append(value)
                value = step(value, numbers)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(seen, pa.list_(pa.int64()))], ["conv", "chunk", name])
    return run


def _carried(chunks: DataFrame, order: Column, start: list[int], step: Callable, name: str) -> DataFrame:
    """One small list per chunk follows its conversation; rows stream, so a task holds one batch."""
    return (chunks.repartition("conv").sortWithinPartitions("conv", order)
            .mapInArrow(_follow(start, step, name), f"conv string, chunk long, {name} array<long>"))


def _through(vector: list[int], matrix: list[int]) -> list[int]:
    left = [min(vector[j] + matrix[4 * j + s] for j in range(4)) for s in range(4)]
    return [x - min(left) for x in left]


# ---------------------------------------------------------------- over the chunks of all conversations
def right_vectors(many: DataFrame, passes: int = PASSES) -> DataFrame:
    """conv, chunk, right: the costs behind each chunk (up to a constant) of conversations with several chunks."""
    end = F.array(*[F.lit(int(x)).cast("long") for x in END])
    state = cut(many.select("conv", "chunk", end.alias("right")).join(
        _each(many.withColumn("right", end), _speculate, "left"), ["conv", "chunk"]))
    gap = F.zip_with("want", "right", lambda a, b: a - b)
    for _ in range(passes):
        want = state.select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("left").alias("want"))
        joined = state.join(want, ["conv", "chunk"], "left")
        joined = joined.withColumn("open", F.coalesce(F.array_min(gap) != F.array_max(gap), F.lit(False)))
        joined = cut(joined)
        if joined.filter("open").isEmpty():
            return state.select("conv", "chunk", "right")
        todo = joined.filter("open").join(many.select("conv", "chunk", "codes"), ["conv", "chunk"])
        again = _each(todo, _fix, "left").join(joined.filter("open").select("conv", "chunk", "want"), ["conv", "chunk"])
        state = cut(joined.filter("not open").select("conv", "chunk", "right", "left")
                    .union(again.select("conv", "chunk", F.col("want").alias("right"), "left")))
    matrices = _each(many, _units, "numbers")
    return cut(_carried(matrices, F.desc("chunk"), [int(x) for x in END], _through, "right"))


def edits_of(chunks: DataFrame, passes: int = PASSES) -> DataFrame:
    """conv, idx, edit (as in ``Runs.trace``); a row behind the last one has the state there."""
    single = F.col("chunk").eqNullSafe(F.lit(0)) & F.col("last")
    many, end = chunks.filter(~single), F.array(*[F.lit(int(x)).cast("long") for x in END])
    ready = chunks.filter(single).select("*", end.alias("right"), F.lit(0).cast("long").alias("entry"))
    if not many.isEmpty():
        known = many.join(right_vectors(many, passes), ["conv", "chunk"])
        exits = _each(known, _exits, "numbers")
        entry = _carried(exits, F.asc("chunk"), [0], lambda s, exit: [exit[s[0]]], "entry")
        ready = ready.union(known.join(entry.select("conv", "chunk", F.col("entry")[0].alias("entry")), ["conv", "chunk"])
                            .select(*ready.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, runs in _groups(batch):
                entry = part.column("entry").to_numpy(zero_copy_only=False)
                states, edits = runs.trace(_vectors(part.column("right")), entry)
                sizes = np.diff(part.column("codes").offsets.to_numpy())
                first = part.column("first_idx").to_numpy(zero_copy_only=False)
                inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                row, last = np.repeat(np.arange(len(sizes)), sizes), np.flatnonzero(part.column("last").to_numpy(zero_copy_only=False))
                conv = part.column("conv").take(pa.array(np.concatenate([row, last])))
                idx = np.concatenate([inside + first[row], first[last] + sizes[last]])
                edit = np.concatenate([edits, 12 * states[last] + 1])
                yield pa.RecordBatch.from_arrays([conv, pa.array(idx, pa.int64()), pa.array(edit.astype(np.int32))], ["conv", "idx", "edit"])

    return ready.mapInArrow(run, "conv string, idx long, edit int")


def steps_of(parts: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """Every edit of every conversation: conv, pos, sub (their order), edit, cost, role, turn, digest.

    Role, turn and digest belong to the row; an inserted row has a role only.
    """
    stays = ~F.col("blank") & F.col("first")
    plan = parts.filter(stays).select("conv", "pos", "turn", "role", "digest", "broken",
                                      (2 * F.col("cls") + F.col("broken").cast("byte")).cast("byte").alias("code"), F.lit(1).alias("_one"))
    plan = cut(ordered_prefix(plan, ["conv"], ["pos"], {"idx": "_one"}))
    number = F.floor(F.col("idx") / chunk).cast("long")
    chunks = plan.groupBy("conv", number.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "code"))).alias("rows"))        # at most ``chunk`` rows
    total = plan.groupBy("conv").agg(F.max(number).alias("_last"))
    chunks = cut(chunks.join(total, "conv").select("conv", "chunk", (F.col("chunk") == F.col("_last")).alias("last"),
                                                   F.col("rows")[0]["idx"].alias("first_idx"), F.col("rows.code").alias("codes")))
    found = cut(edits_of(chunks, passes))
    last = 12 * F.floor(F.col("edit") / 12)
    state, kind = (last / 12).cast("int"), F.col("edit") % 4
    added = F.floor((F.col("edit") - last) / 4).cast("int")
    # the rows that a state still needs behind the last row: after s two, after u one
    found = found.select("conv", "idx", state.alias("state"), kind.alias("kind"),
                         F.when(kind == 1, F.when(state == 1, 2).when(state == 2, 1).otherwise(0)).otherwise(added).alias("added"))
    other = F.when(F.col("state") == 2, "assistant").otherwise("user")
    swap = F.when(other == "user", "assistant").otherwise("user")
    decided = found.join(plan, ["conv", "idx"], "left").withColumn("pos", F.coalesce("pos", F.lit((1 << 63) - 1)))
    nothing = [F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest")]
    inserted = decided.filter("added > 0").select("conv", "pos", F.explode(F.sequence(F.lit(0), F.col("added") - 1)).alias("sub"), F.lit("I").alias("edit"),
                                                  F.lit(INSERT).cast("long").alias("cost"), other.alias("_a"), swap.alias("_b")).select(
        "conv", "pos", "sub", "edit", "cost", F.when(F.col("sub") == 0, F.col("_a")).otherwise(F.col("_b")).alias("role"), *nothing)
    stay = F.when(F.col("broken"), BROKEN).otherwise(0)
    # the role of a row with a new role: the other one after an odd number of inserted rows
    recast = F.when(F.col("added") % 2 == 1, swap).otherwise(other)
    rows = decided.filter("kind <> 1").select(
        "conv", "pos", F.lit(2).alias("sub"), F.when(F.col("kind") == 0, "D").when(F.col("kind") == 2, "K").otherwise("R").alias("edit"),
        F.when(F.col("kind") == 0, DELETE).when(F.col("kind") == 2, stay).otherwise(stay + RECAST).cast("long").alias("cost"),
        F.when(F.col("kind") == 3, recast).otherwise(F.col("role")).alias("role"), "turn", "digest")
    gone = parts.withColumn("_from", F.when(stays, 1).otherwise(0)).filter("_from < copies")
    gone = gone.select("conv", F.explode(F.sequence(F.col("pos") + F.col("_from"), F.col("pos") + F.col("copies") - 1)).alias("pos"), F.lit(2).alias("sub"),
                       F.lit("D").alias("edit"), F.lit(DELETE).cast("long").alias("cost"), "role", "turn", "digest")
    return rows.union(inserted).union(gone)


def _with_texts(rows: DataFrame, parts: DataFrame, steps: DataFrame) -> DataFrame:
    """Edits with the text of the rows that stay; '' for inserted rows, null for deleted ones."""
    stay = F.col("edit").isin("K", "R")
    # the role a row had is part of what names its text
    kept = (steps.filter(stay).join(parts.select("conv", "pos", F.col("role").alias("_had")), ["conv", "pos"])
            .select("conv", "pos", "sub", "edit", "cost", "role", "turn", "digest", "_had"))
    texts = _same(rows).groupBy("conv", F.col("turn").alias("_turn"), F.col("role").alias("_had"), "digest").agg(F.first("text").alias("text"))
    same = [kept["conv"] == texts["conv"], kept["_had"] == texts["_had"], kept["digest"] == texts["digest"], kept["turn"].eqNullSafe(texts["_turn"])]
    found = kept.join(texts, same).select(kept["conv"], "pos", "sub", "edit", "cost", kept["role"], "turn", "text")
    return found.union(steps.filter(~stay).select("conv", "pos", "sub", "edit", "cost", "role", "turn", F.when(F.col("edit") == "I", "").alias("text")))


def _names(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "conv_id").distinct()


def repair(conversations: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """One row per edit: conv_id, pos, sub (order by both), edit (D I K R), turn, role, text (null where deleted)."""
    ship(conversations.sparkSession)
    rows = damaged(conversations)
    parts = units(rows)
    out = _with_texts(rows, parts, steps_of(parts, chunk, passes))
    return out.join(_names(conversations), "conv").select("conv_id", "pos", "sub", "edit", "turn", "role", "text")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over the sorted edits: audit, cost and digest of each conversation."""
    def done():
        return pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "cost": cost, "sha": digest.hexdigest()}], schema)

    schema = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("cost", pa.int64()), ("sha", pa.string())])
    conv, audit, cost, digest, some = None, [], 0, hashlib.sha256(), False
    for batch in batches:
        for c, edit, price, role, text in zip(*[batch.column(n).to_pylist() for n in ("conv", "edit", "cost", "role", "text")], strict=True):
            if c != conv:
                if conv is not None:
                    yield done()
                conv, audit, cost, digest, some = c, [], 0, hashlib.sha256(), False
            audit.append(edit)
            cost += price
            if edit != "D":
                digest.update((("\n" if some else "") + role + ":").encode())
                digest.update(text.encode())
                some = True
    if conv is not None:
        yield done()


def audits(conversations: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """Every conv_id with its faults, the cheapest edits, their cost and the digest of the repaired rows."""
    ship(conversations.sparkSession)
    rows = damaged(conversations)
    parts = units(rows)
    edits = _with_texts(rows, parts, steps_of(parts, chunk, passes))
    told = (edits.select("conv", "pos", "sub", "edit", "cost", "role", "text").repartition("conv").sortWithinPartitions("conv", "pos", "sub")
            .mapInArrow(_report, "conv string, audit string, cost long, sha string"))
    counted = fault_counts(parts).select("conv", "gaps", *SUMS[1:])
    out = _names(conversations).join(counted, "conv", "left").join(told, "conv", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark, sf_dir):
    """The report over all of ``conversations``."""
    return audits(table(spark, sf_dir, "conversations"))
