"""Bounded scoring of customers against products (M26, M27): exact threshold pruning.

A customer's score for a product is (n_category + n_subcategory + n_specification +
n_process + sum of price closeness to the bought products of the category) / (5 n_bought),
times the price match.  Counts and price sum are known per customer or per (customer,
category), so a score has cheap upper bounds:

* per (customer, category): counts at their largest, price sum at n_category, price match 1
  (0.5 without a price profile);
* per (customer, product): the real counts, price sum at n_category, the real price match.

Products lie in shards of one category, ordered by price.  A first round scores each
customer (M27: product) where its best partners are expected; the k-th score found there
is its limit.  The second round sends a (customer, category) only to the shards whose price
range can still reach the limit, and inside a shard sums prices only for the products whose
bound reaches it.  What is left out scores below the limit, so the lists are exact.

Shards meet customers in blocks of bounded size; nothing is collected.  Attribute values
stand for themselves as 64-bit hashes.

M26 searches wide shards (``SHELF`` products), so that a customer's row goes to few of them.
Inside, products lie by price bin and by cell, which is one pair of specification and process
type: a customer's counts are the same all over a cell, the price part has one bound per bin.
The customers of a shard are searched together, in rounds of falling limit: a round scores the
cells and bins whose bound reaches it, until the limit is no higher than the customer's k-th
score.  So a customer meets few products of a shard, however many it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.session import cut, lookup, ship_package

SHARD, BLOCK, CHUNK = 2048, 4096, 256   # products of a shard, customers of a block, customers scored at once
ROUND = 10                              # decimals that scores are ranked by
SLACK = 1e-9
SHELF, BINS = 1 << 18, 256              # products of a wide shard, its price bins
CROWD = 1 << 15                         # customers from which a wide shard is copied to another task
EACH = 4                                # products looked at first for each place of a list in a wide shard
GRID = 1 << 20                          # elements of the arrays that a search of a wide shard makes at once
ATTRS = ("specification", "process_type")
UNKNOWN = "unknown"                     # FIXED VALUE: fill for missing product attributes


def _code(c: Column | str) -> Column:
    return F.xxhash64(c)


# ------------------------------------------------------------------ inputs of the search
def goods(products: DataFrame, prices: DataFrame, cat: DataFrame, shard: int = SHARD) -> DataFrame:
    """Products with price, codes and their shard: one category, one price range, at most
    about ``shard`` products; products without a price have shards of their own."""
    p = lookup(products.join(prices, "product_id", "left"), cat.select("category", "cat_std"), ["category"], "left")
    p = cut(p.select("product_id", "category", "cat_std", F.col("product_price").alias("price"), F.col("subcategory"),
                     *[_code(a).alias(a) for a in ATTRS], _code("subcategory").alias("sub"), (F.col("subcategory") == UNKNOWN).alias("unknown")))
    sizes = p.groupBy("category").agg(F.ceil(F.count("price") / shard).cast("int").alias("_n"))
    # price cuts per category; written with the rows below, so no task can see other cuts
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n"), F.lit(1))), lambda i: i / F.greatest(F.col("_n"), F.lit(1)))
    grid = F.array(*[F.lit(i / 256) for i in range(257)])
    cuts = p.groupBy("category").agg(F.percentile_approx("price", grid, 10000).alias("_grid")).join(sizes, "category").select(
        "category", F.array_distinct(F.transform(parts, lambda q: F.get("_grid", F.round(q * 256).cast("int")))).alias("_cuts"))
    p = lookup(p, cuts, ["category"])
    slot = F.when(F.col("price").isNull(), F.lit(-1)).otherwise(F.size(F.filter("_cuts", lambda x: x <= F.col("price"))))
    p = p.withColumn("slot", slot).drop("_cuts")
    count = p.groupBy("category", "slot").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("_pieces"))
    p = lookup(p, count, ["category", "slot"])
    return cut(p.withColumn("piece", F.pmod(F.xxhash64("product_id"), F.col("_pieces")).cast("int")).drop("_pieces"))


def _runs(group: np.ndarray, value: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per group its distinct values: offsets, values and how often each occurs."""
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1]))) if len(group) else np.empty(0, np.int64)
    return np.searchsorted(group[first], np.arange(groups + 1)), value[first], np.diff(np.append(first, len(group)))


BUYERS = "customer_id long, n_bought long, n_unknown long, subs array<long>, odd array<long>, " + ", ".join(
    f"{a}_codes array<long>, {a}_ns array<long>, {a}_max long" for a in ATTRS)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of bought products, sorted by customer, to one row per customer."""
    def one_each(t: pa.Table) -> pa.RecordBatch:
        who = t.column("customer_id").to_numpy()
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        size = np.diff(np.append(first, len(who)))
        group = np.repeat(np.arange(len(first)), size)

        def lists(at: np.ndarray, values: np.ndarray) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))

        def filled(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            there = t.column(name).is_valid().to_numpy()
            return _runs(group[there], t.column(name).fill_null(0).to_numpy()[there], len(first))

        odd = filled("odd")
        out = {"customer_id": pa.array(who[first]), "n_bought": pa.array(size), "subs": lists(*filled("sub")[:2]), "odd": lists(*odd[:2]),
               "n_unknown": pa.array(np.diff(odd[0]))}
        for a in ATTRS:
            at, codes, ns = _runs(group, t.column(a).to_numpy(), len(first))
            out |= {f"{a}_codes": lists(at, codes), f"{a}_ns": lists(at, ns), f"{a}_max": pa.array(np.maximum.reduceat(ns, at[:-1]))}
        names = [x.split()[0] for x in BUYERS.split(", ")]
        return pa.RecordBatch.from_arrays([out[n] for n in names], names)

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        who = rest.column("customer_id").to_numpy()
        whole = int(np.searchsorted(who, who[-1]))          # the last customer may go on
        if whole:
            yield one_each(rest.slice(0, whole))
            rest = rest.slice(whole)
    if rest is not None:
        yield one_each(rest)


def buyers(bought: DataFrame) -> DataFrame:
    """Per customer: n_bought, n_unknown, codes and counts of the attributes, bought subcategories, bought products of unknown ones.
    Bought products (each once) move once to their customers, who hold a bounded number of them."""
    n = int(bought.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bought.filter(F.col("customer_id").isNotNull()).select(
        F.col("customer_id").cast("long").alias("customer_id"), *[_code(a).alias(a) for a in ATTRS],
        F.when(F.col("subcategory") != UNKNOWN, _code("subcategory")).alias("sub"),
        F.when(F.col("subcategory") == UNKNOWN, F.col("product_id").cast("long")).alias("odd"))
    return rows.repartition(n, "customer_id").sortWithinPartitions("customer_id").mapInArrow(_tally, BUYERS)


def baskets(sales: DataFrame, bought: DataFrame, prices: DataFrame, cat: DataFrame) -> DataFrame:
    """Per (customer, category): n_category, average price (null below two purchases), the prices of the bought products."""
    c = "customer_id"
    prof = (sales.groupBy(c, "category").agg(F.avg("unit_price").alias("avg_price"), F.count("*").alias("_n"))
            .select(c, "category", F.when(F.col("_n") >= 2, F.col("avg_price")).alias("avg_price")))
    n = bought.join(prices, "product_id").groupBy(c, "category").agg(F.count("*").alias("n_category"), F.collect_list("product_price").alias("prices"))
    out = n.join(prof, [c, "category"]).join(F.broadcast(cat.select("category", "cat_std")), "category", "left")   # one row per category
    # no price has a larger product of price sum and price match: closeness to b times closeness to the
    # average a is at most exp(-((b - a) / 2 sd)^2)
    most = F.aggregate("prices", F.lit(0.0), lambda x, b: x + F.exp(-F.pow((b - F.col("avg_price")) / (2 * F.col("cat_std")), 2)))
    return out.withColumn("most", F.when(F.col("avg_price").isNotNull() & (F.col("cat_std") > 0), most).otherwise(F.col("n_category").cast("double")))


WHO = ["customer_id", "n_bought", "n_unknown", "subs", "odd", *[f"{a}_{x}" for a in ATTRS for x in ("codes", "ns", "max")]]


def _largest(category_part: Column) -> Column:
    """Upper bound of the similarity part, without the price match."""
    rest = F.col("n_unknown") + sum((F.col(f"{a}_max") for a in ATTRS), F.lit(0))
    return (category_part + rest) / (5.0 * F.col("n_bought"))


# ------------------------------------------------------------------ scoring a shard
def _closeness(a: np.ndarray, b: np.ndarray, sd: float | None) -> np.ndarray:
    d = np.abs(a - b)
    if sd is not None and sd > 0:
        return np.exp(-0.5 * (d / sd) ** 2)
    return np.where(d == 0, 1.0, 0.5)


class Shelf:
    """The products of a shard as arrays."""

    def __init__(self, columns: dict[str, np.ndarray], sd: float | None):
        order = np.argsort(columns["product_id"], kind="stable")
        self.at = {k: v[order] for k, v in columns.items()}
        self.id, self.price, self.sd = self.at["product_id"], self.at["price"], sd
        self.values = {a: np.unique(self.at[a], return_inverse=True) for a in (*ATTRS, "sub")}
        self.need = self.at["need"].copy()

    def counts(self, a: str, rows: list[dict]) -> np.ndarray:
        """customers x products: how many bought products share attribute ``a``."""
        values, inverse = self.values[a]
        grid = np.zeros((len(rows), len(values)))
        who = np.repeat(np.arange(len(rows)), [len(r[f"{a}_codes"]) for r in rows])
        codes = np.array([x for r in rows for x in r[f"{a}_codes"]], np.int64)
        at = np.minimum(np.searchsorted(values, codes), len(values) - 1)
        hit = values[at] == codes
        grid[who[hit], at[hit]] = np.array([x for r in rows for x in r[f"{a}_ns"]], float)[hit]
        return grid[:, inverse]

    def barred(self, rows: list[dict]) -> np.ndarray:
        """customers x products: bought, or of a bought subcategory."""
        values, inverse = self.values["sub"]
        grid = np.zeros((len(rows), len(values)), bool)
        for i, r in enumerate(rows):
            codes = np.array(r["subs"], np.int64)
            at = np.minimum(np.searchsorted(values, codes), len(values) - 1)
            grid[i, at[values[at] == codes]] = True
        out = grid[:, inverse]
        for i, r in enumerate(rows):
            if r["odd"]:
                out[i] |= np.isin(self.id, np.array(r["odd"], np.int64))
        return out

    def scores(self, rows: list[dict]) -> tuple[np.ndarray, ...]:
        """(customer index, product index, base, price match) of the pairs whose bound reaches the limit."""
        n_cat = np.array([r["n_category"] for r in rows], float)[:, None]
        five = 5.0 * np.array([r["n_bought"] for r in rows], float)[:, None]
        average = np.array([np.nan if r["avg_price"] is None else r["avg_price"] for r in rows], float)[:, None]
        known = n_cat + np.array([r["n_unknown"] for r in rows], float)[:, None] * self.at["unknown"][None, :]
        for a in ATTRS:
            known = known + self.counts(a, rows)
        match = np.where(np.isnan(average) | np.isnan(self.price)[None, :], 0.5, _closeness(average, self.price[None, :], self.sd))
        who, what = np.nonzero(((known + n_cat) / five * match >= self.need[None, :] - SLACK) & ~self.barred(rows) & (known + n_cat > 0))
        sums = np.zeros(len(who))
        cuts = np.searchsorted(who, np.arange(len(rows) + 1))
        for i, r in enumerate(rows):
            mine = slice(cuts[i], cuts[i + 1])
            if r["prices"] and cuts[i + 1] > cuts[i]:
                price = self.price[what[mine]]
                near = _closeness(price[:, None], np.array(r["prices"], float)[None, :], self.sd).sum(axis=1)
                sums[mine] = np.where(np.isnan(price), 0.5 * len(r["prices"]), near)
        base = (known[who, what] + sums) / five[who, 0]
        return who, what, base, match[who, what]


def _first(groups: list[np.ndarray], order: list[np.ndarray], k: int) -> np.ndarray:
    """Indices of the first k of each group in ``order`` (most important key last)."""
    by = np.lexsort((*order, *groups))
    change = np.zeros(len(by), bool)
    change[:1] = True
    for g in groups:
        change[1:] |= g[by][1:] != g[by][:-1]
    start = np.flatnonzero(change)
    rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return by[rank < k]


class Rack:
    """The products of a wide shard by price bin and cell of equal specification and process type."""

    def __init__(self, columns: dict[str, np.ndarray], sd: float | None, bins: int | None = None):
        self.sd, n = sd, len(columns["product_id"])
        values, inverse = {}, {}
        for a in (*ATTRS, "sub"):
            values[a], inverse[a] = np.unique(columns[a], return_inverse=True)
        key = (inverse[ATTRS[0]].astype(np.int64) * len(values[ATTRS[1]]) + inverse[ATTRS[1]]) * 2 + columns["unknown"]
        cells, cell = np.unique(key, return_inverse=True)
        self.values, self.cell_unknown = values, (cells % 2).astype(float)
        self.cell_of = {ATTRS[0]: cells // 2 // len(values[ATTRS[1]]), ATTRS[1]: cells // 2 % len(values[ATTRS[1]])}
        bins = max(1, min(bins or BINS, n, (1 << 22) // len(cells)))
        by_price = np.argsort(columns["price"], kind="stable")          # products without a price last
        bin_of = np.empty(n, np.int64)
        bin_of[by_price] = np.arange(n) * bins // n
        none = np.isnan(columns["price"])
        bin_of[none] = bins                                              # a bin of their own
        order = np.lexsort((columns["product_id"], cell, bin_of))
        self.id, self.price, self.sub, self.cell = (x[order] for x in (columns["product_id"], columns["price"], inverse["sub"], cell))
        # units: products of one bin and one cell
        self.starts = np.searchsorted(bin_of[order] * len(cells) + self.cell, np.arange((bins + 1) * len(cells) + 1))
        self.bins = bins + 1
        self.lo, self.hi = np.full(bins + 1, np.nan), np.full(bins + 1, np.nan)
        held = bin_of[by_price][~none[by_price]]
        sorted_price = columns["price"][by_price][~none[by_price]]
        if len(held):
            first = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
            self.lo[held[first]] = sorted_price[first]
            self.hi[held[first]] = sorted_price[np.append(first[1:], len(held)) - 1]

    def crowd(self) -> int:
        """Customers searched at once: their counts per cell and subcategory lie in dense arrays."""
        return max(1, min(CHUNK, GRID // max(len(self.cell_unknown), self.bins, *[len(v) for v in self.values.values()])))

    def _counts(self, a: str, c: dict) -> np.ndarray:
        """customers x cells: bought products that share attribute ``a``."""
        values = self.values[a]
        at, codes = c[f"{a}_codes"]
        out = np.zeros((len(at) - 1, len(values)))
        who = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.minimum(np.searchsorted(values, codes), len(values) - 1)
        hit = values[place] == codes
        out[who[hit], place[hit]] = c[f"{a}_ns"][1][hit]
        return out[:, self.cell_of[a]]

    def _bounds(self, c: dict, average: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """customers x bins: upper bounds of the price match and of price sum times price match.

        With sd > 0 the closeness to a bought price b times that to the average a is
        exp(-((b - a) / 2 sd)^2) exp(-((p - (a + b) / 2) / sd)^2): one bell, bounded at its nearest price."""
        none = np.isnan(self.lo)[None, :]

        def off(x: np.ndarray) -> np.ndarray:
            return np.maximum(np.maximum(self.lo[None, :] - x[:, None], x[:, None] - self.hi[None, :]), 0.0)

        match = np.where(np.isnan(average)[:, None] | none, 0.5, _closeness(off(average), 0.0, self.sd))
        part = np.zeros_like(match)
        at, bought = c["prices"]
        lo = 0
        while lo < len(average):                                         # bounded pieces of (bought price, bin)
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + GRID // self.bins, side="right")) - 1)
            n, prices = np.diff(at[lo:hi + 1]), bought[at[lo]:at[hi]]
            who = np.repeat(np.arange(lo, hi), n)
            mean = average[who]
            if self.sd is not None and self.sd > 0:
                blank = np.isnan(mean)
                weight = np.where(blank, 0.5, np.exp(-0.25 * ((prices - mean) / self.sd) ** 2))
                steep = np.where(blank, 0.5, 1.0)
                bells = weight[:, None] * np.exp(-steep[:, None] * (off(np.where(blank, prices, (prices + mean) / 2)) / self.sd) ** 2)
            else:
                bells = _closeness(off(prices), 0.0, self.sd) * match[who]
            some = n > 0
            if some.any():
                part[lo:hi][some] = np.add.reduceat(np.where(none, 0.25, bells), (at[lo:hi] - at[lo])[some], axis=0)
            lo = hi
        return match, part

    def _scores(self, c: dict, average: np.ndarray, five: np.ndarray, counts: np.ndarray, floor: np.ndarray,
                who: np.ndarray, what: np.ndarray) -> list[np.ndarray]:
        """(customer index, product index, base, price match, rank score) of the pairs that may reach the floor."""
        at, prices = c["prices"]
        price, n_cat = self.price[what], c["n_category"][who]
        known = n_cat + counts[who, self.cell[what]]
        near = np.where(np.isnan(price) | np.isnan(average[who]), 0.5, _closeness(average[who], price, self.sd))
        may = (known + n_cat) / five[who] * near >= floor[who]           # the price sum is n_category at most
        who, what, price, known, near = (x[may] for x in (who, what, price, known, near))
        many = np.diff(at)[who]
        sums, ends = np.zeros(len(who)), np.cumsum(many)
        lo = 0
        while lo < len(who):                                             # bounded pieces of (pair, bought price)
            before = ends[lo] - many[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, before + GRID, side="right")))
            n = many[lo:hi]
            start = ends[lo:hi] - n - before
            bought = prices[np.repeat(at[who[lo:hi]] - start, n) + np.arange(n.sum())]
            some = n > 0
            if some.any():
                sums[lo:hi][some] = np.add.reduceat(_closeness(np.repeat(price[lo:hi], n), bought, self.sd), start[some])
            lo = hi
        sums = np.where(np.isnan(price), 0.5 * many, sums)
        base = (known + sums) / five[who]
        rank = np.round(base * near, ROUND)
        keep = rank > 0
        return [x[keep] for x in (who, what, base, near, rank)]

    def best(self, c: dict, k: int) -> tuple[np.ndarray, ...]:
        """(customer index, product index, base, price match) of the best product of each of the k best
        subcategories of the customers ``c`` (columns; lists as offsets and values).

        Rounds of falling limit: all units whose bound reaches the limit are scored.  A customer is done
        once its k-th score or its need is no lower than the limit: what is left lies below."""
        m, cells = len(c["customer_id"]), len(self.cell_unknown)
        everyone = np.arange(m)
        five, n_cat, average = 5.0 * c["n_bought"], c["n_category"], c["avg_price"]
        counts = sum(self._counts(a, c) for a in ATTRS) + c["n_unknown"][:, None] * self.cell_unknown
        level = counts.astype(np.int64)
        by_count = np.argsort(-level.astype(np.int16 if level.max() < 1 << 15 else np.int64), axis=1, kind="stable")   # cells by falling count
        high = int(level.max()) + 1
        reaching = np.bincount((everyone[:, None] * (high + 1) + level).ravel(), minlength=m * (high + 1)).reshape(m, high + 1)
        reaching = reaching[:, ::-1].cumsum(axis=1)[:, ::-1]             # cells of at least that count
        match, part = self._bounds(c, average)

        subs, (at, codes) = self.values["sub"], c["subs"]
        barred = np.zeros((m, len(subs)), bool)
        place = np.minimum(np.searchsorted(subs, codes), len(subs) - 1)
        hit = subs[place] == codes
        barred[np.repeat(everyone, np.diff(at))[hit], place[hit]] = True
        at, odd = c["odd"]
        gone = None
        if len(odd):
            by_id = np.argsort(self.id, kind="stable")
            place = by_id[np.minimum(np.searchsorted(self.id, odd, sorter=by_id), len(by_id) - 1)]
            hit = self.id[place] == odd
            gone = np.repeat(everyone, np.diff(at))[hit] * len(self.id) + place[hit]

        floor = np.maximum(c["need"] - SLACK, 0.0)
        found = [np.empty(0, np.int64), np.empty(0, np.int64), *[np.empty(0)] * 3]
        seen = np.zeros((m, self.bins), np.int64)                        # cells scored of each bin, by falling count
        # a first limit that some products for each place reach: the best bins of the cell of the highest count
        units = np.arange(self.bins)[None, :] * cells + by_count[:, :1]
        size = self.starts[units + 1] - self.starts[units]
        bound = ((n_cat + level.max(axis=1))[:, None] * match + part) / five[:, None]
        peak = bound.max(axis=1)
        by_bound = np.argsort(-bound, axis=1)
        enough = np.take_along_axis(size, by_bound, axis=1).cumsum(axis=1) >= EACH * k
        last = np.where(enough[:, -1], enough.argmax(axis=1), self.bins - 1)
        guess = bound[everyone, by_bound[everyone, last]] - SLACK
        live, depth, limit = everyone, 0.04, np.maximum(np.maximum(0.96 * peak, guess), floor)
        while len(live):
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                least = (limit[live, None] * five[live, None] - SLACK - part[live]) / match[live] - n_cat[live, None]
            least = np.where(np.isnan(least), 0.0, least)                # no match at all and no price sum
            now = np.maximum(reaching[live[:, None], np.clip(np.ceil(least), 0, high).astype(np.int64)], seen[live])
            new = now - seen[live]
            owner, bin_ = np.nonzero(new)
            n, first = new[owner, bin_], seen[live[owner], bin_]
            owner = live[owner]
            seen[live] = now
            ends, lo = np.cumsum(n), 0
            while lo < len(n):                                           # bounded pieces of units
                before = ends[lo] - n[lo]
                hi = max(lo + 1, int(np.searchsorted(ends, before + GRID, side="right")))
                some = n[lo:hi]
                who = np.repeat(owner[lo:hi], some)
                ranks = np.repeat(first[lo:hi] - (ends[lo:hi] - some - before), some) + np.arange(some.sum())
                units = np.repeat(bin_[lo:hi], some) * cells + by_count[who, ranks]
                size = self.starts[units + 1] - self.starts[units]
                units, who, size = units[size > 0], who[size > 0], size[size > 0]
                held, at_ = np.cumsum(size), 0
                while at_ < len(size):                                   # bounded pieces of products
                    ahead = held[at_] - size[at_]
                    to = max(at_ + 1, int(np.searchsorted(held, ahead + GRID, side="right")))
                    part_n = size[at_:to]
                    what = np.repeat(self.starts[units[at_:to]] - (held[at_:to] - part_n - ahead), part_n) + np.arange(part_n.sum())
                    pair = np.repeat(who[at_:to], part_n)
                    free = ~barred[pair, self.sub[what]]
                    if gone is not None:
                        free &= ~np.isin(pair * len(self.id) + what, gone)
                    more = self._scores(c, average, five, counts, floor, pair[free], what[free])
                    at_ = to
                    if not len(more[0]):
                        continue
                    found = [np.concatenate([a, b]) for a, b in zip(found, more, strict=True)]
                    one = _first([found[0] * len(subs) + self.sub[found[1]]], [self.id[found[1]], -found[4]], 1)
                    found = [x[one] for x in found]
                    top = _first([found[0]], [self.id[found[1]], -found[4]], k)
                    found = [x[top] for x in found]
                    full = np.flatnonzero(np.bincount(found[0], minlength=m) == k)
                    last = np.full(m, np.inf)
                    np.minimum.at(last, found[0], found[4])
                    floor[full] = np.maximum(floor[full], last[full] - SLACK)
                lo = hi
            live = live[limit[live] > floor[live]]
            sure = np.bincount(found[0], minlength=m) == k
            limit = np.where(sure, floor, np.maximum(floor, (1 - depth) * peak if depth < 0.5 else 0.0))
            depth *= 4
        return tuple(found[:4])


OUT = "customer_id long, product_id long, base_similarity double, price_match double"
WIDE = OUT + ", sub long"


def _search(k: int):
    """Task over the rows of shards, products first, then customers by falling bound."""
    def answer(shelf: Shelf, rows: list[dict], best: list) -> None:
        who, what, base, match = shelf.scores(rows)
        customer = np.array([r["customer_id"] for r in rows], np.int64)[who]
        rank = np.round(base * match, ROUND)
        keep = rank > 0
        who, what, base, match, customer, rank = (x[keep] for x in (who, what, base, match, customer, rank))
        found = [np.concatenate([a, b]) for a, b in zip(best, (what, customer, base, match, rank), strict=True)] if best else [what, customer, base, match, rank]
        pick = _first([found[0]], [found[1], -found[4]], k)
        best[:] = [x[pick] for x in found]
        full = np.bincount(best[0], minlength=len(shelf.id)) == k
        least = np.full(len(shelf.id), np.inf)
        np.minimum.at(least, best[0], best[4])
        shelf.need[full] = np.maximum(shelf.need[full], least[full])

    def rest(shelf: Shelf, best: list) -> pa.RecordBatch:
        what, customer, base, match, _ = best
        return pa.RecordBatch.from_arrays([pa.array(customer), pa.array(shelf.id[what]), pa.array(base), pa.array(match)],
                                          ["customer_id", "product_id", "base_similarity", "price_match"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, stock, shelf, rows, best = None, [], None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                here = (r["category"], r["slot"], r["piece"], r["block"])
                if here != place or len(rows) >= CHUNK:
                    if rows:
                        answer(shelf, rows, best)
                        rows = []
                    if here != place:
                        if best:
                            yield rest(shelf, best)
                        place, stock, shelf, best = here, [], None, []
                if r["is_product"]:
                    stock.append(r)
                    continue
                if shelf is None and stock:
                    def column(name: str, kind, none) -> np.ndarray:
                        return np.array([none if s.get(name) is None else s[name] for s in stock], kind)
                    shelf = Shelf({"product_id": column("product_id", np.int64, 0), "price": column("price", float, np.nan),
                                   "need": column("need", float, 0.0), "sub": column("sub", np.int64, 0), "unknown": column("unknown", bool, False),
                                   **{a: column(a, np.int64, 0) for a in ATTRS}}, stock[0]["cat_std"])
                    stock = []
                if shelf is not None:
                    rows.append(r)
        if rows:
            answer(shelf, rows, best)
        if best:
            yield rest(shelf, best)
    return run


def _ask(stock: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Scores of the customer ``rows`` (with category, slot, piece, bound) against the products of their shards."""
    keys = ["category", "slot", "piece"]
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    placed = lookup(rows, blocks, keys).withColumn("block", F.pmod(F.xxhash64("customer_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    copies = lookup(stock.drop("subcategory"), blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    both = copies.withColumn("is_product", F.lit(True)).unionByName(placed.withColumn("is_product", F.lit(False)), allowMissingColumns=True)
    n = int(stock.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(n, *keys, "block").sortWithinPartitions(*keys, "block", F.desc("is_product"), F.desc("bound"), "customer_id")
    return both.mapInArrow(_search(k), OUT)


def _column(batch: pa.RecordBatch, name: str, kind, none) -> np.ndarray:
    return np.array(batch.column(name).fill_null(none).to_numpy(zero_copy_only=False), kind)


LISTS = [*[f"{a}_{x}" for a in ATTRS for x in ("codes", "ns")], "subs", "odd", "prices"]
NUMBERS = {"customer_id": (np.int64, 0), "n_bought": (float, 0), "n_unknown": (float, 0), "need": (float, 0.0),
           "n_category": (float, 0), "avg_price": (float, float("nan"))}


def _customers(batch: pa.RecordBatch) -> dict:
    """Customer rows as arrays; a list column as offsets and values."""
    out = {n: _column(batch, n, kind, none) for n, (kind, none) in NUMBERS.items()}
    for n in LISTS:
        at = np.asarray(batch.column(n).offsets, np.int64)
        values = batch.column(n).values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)
        out[n] = (at - at[0], values)
    return out


def _browse(k: int, bins: int):
    """Task over the rows of wide shards, products first: only their columns are kept, customers pass by."""
    kinds = {"product_id": (np.int64, 0), "price": (float, float("nan")), "sub": (np.int64, 0), "unknown": (bool, False), **{a: (np.int64, 0) for a in ATTRS}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, stock, rack, sd = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column("category").dictionary_encode().indices.to_numpy(zero_copy_only=False),
                    *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "piece", "block", "is_product")]]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
            for lo, hi in zip([0, *change], [*change, batch.num_rows], strict=True):
                here = tuple(batch.column(c)[lo].as_py() for c in ("category", "slot", "piece", "block"))
                if here != place:
                    place, stock, rack = here, [], None
                some = batch.slice(lo, hi - lo)
                if keys[-1][lo]:
                    sd = some.column("cat_std")[0].as_py()
                    stock.append({n: _column(some, n, kind, none) for n, (kind, none) in kinds.items()})
                    continue
                if rack is None and stock:
                    rack = Rack({n: np.concatenate([s[n] for s in stock]) for n in kinds}, sd, bins)
                    stock = []
                if rack is not None:
                    for first in range(0, some.num_rows, rack.crowd()):
                        c = _customers(some.slice(first, rack.crowd()))
                        who, what, base, match = rack.best(c, k)
                        if len(who):
                            yield pa.RecordBatch.from_arrays([pa.array(c["customer_id"][who]), pa.array(rack.id[what]), pa.array(base), pa.array(match),
                                                              pa.array(rack.values["sub"][rack.sub[what]])],
                                                             ["customer_id", "product_id", "base_similarity", "price_match", "sub"])
    return run


def _listless(stock: DataFrame) -> DataFrame:
    """Product rows with empty lists: a null list costs Arrow's writer a pass over all nulls before it in the batch."""
    return stock.withColumns({n: F.array().cast("array<double>" if n == "prices" else "array<long>") for n in LISTS})


def _ask_wide(stock: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k best subcategories of the customer ``rows`` (with category, slot, piece) in each of their wide shards.

    Customers only pass by, so their number bounds no memory: a shard is copied for the sake of
    parallel tasks alone, a few times the shuffle partitions in all."""
    keys = ["category", "slot", "piece"]
    n = int(stock.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    crowd = max(CROWD, (sizes.agg(F.sum("_n")).first()[0] or 0) // (4 * n))
    blocks = sizes.select(*keys, F.ceil(F.col("_n") / crowd).cast("int").alias("_blocks"))
    placed = lookup(rows, blocks, keys).withColumn("block", F.pmod(F.xxhash64("customer_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    copies = lookup(stock.drop("subcategory"), blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    both = _listless(copies).withColumn("is_product", F.lit(True)).unionByName(placed.withColumn("is_product", F.lit(False)), allowMissingColumns=True)
    both = both.repartition(4 * n, *keys, "block").sortWithinPartitions(*keys, "block", F.desc("is_product"))
    return both.mapInArrow(_browse(k, BINS), WIDE)


def _score(df: DataFrame) -> DataFrame:
    return df.withColumn("rank_score", F.round(F.col("base_similarity") * F.col("price_match"), ROUND))


class Scoring:
    """Materialised inputs of both directions; customers of more than ``hot`` bought products are left to the caller."""

    def __init__(self, sales: DataFrame, products: DataFrame, prices: DataFrame, cat: DataFrame, hot: int, shard: int = SHARD):
        ship_package(sales.sparkSession)
        prices = cut(prices)
        bought = cut(sales.select("customer_id", "product_id").distinct().join(products, "product_id"))
        self.hot = cut(bought.groupBy("customer_id").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("customer_id"))
        bought = bought.join(self.hot, "customer_id", "left_anti")
        calm = sales.join(self.hot, "customer_id", "left_anti")
        self.bought, self.goods = bought, lambda size: goods(products, prices, cat, size)
        self.shard = shard
        self.who = cut(buyers(bought))
        self.baskets = cut(baskets(calm, bought, prices, cat))

    @cached_property
    def stock(self) -> DataFrame:
        return self.goods(self.shard)

    def rows(self, parts: DataFrame) -> DataFrame:
        return parts.join(self.who, "customer_id")

    def _far(self, who: DataFrame, stock: DataFrame) -> DataFrame:
        """Rows of ``who`` (with need) for shards of categories they never bought but that share an attribute value."""
        held = [stock.select(F.lit(a).alias("_kind"), F.col(a).alias("_code"), "category", "slot", "piece") for a in ATTRS]
        held.append(stock.filter("unknown").select(F.lit("sub").alias("_kind"), F.lit(0).cast("long").alias("_code"), "category", "slot", "piece"))
        wants = [who.select("customer_id", F.lit(a).alias("_kind"), F.explode(f"{a}_codes").alias("_code")) for a in ATTRS]
        wants.append(who.filter("n_unknown > 0").select("customer_id", F.lit("sub").alias("_kind"), F.lit(0).cast("long").alias("_code")))
        index = held[0].union(held[1]).union(held[2]).distinct()
        asked = wants[0].union(wants[1]).union(wants[2])
        pairs = asked.join(index, ["_kind", "_code"]).select("customer_id", "category", "slot", "piece").distinct()
        pairs = pairs.join(self.baskets.select("customer_id", "category"), ["customer_id", "category"], "left_anti")
        empty = {"n_category": F.lit(0).cast("long"), "avg_price": F.lit(None).cast("double"), "prices": F.array().cast("array<double>")}
        return pairs.withColumns(empty)

    def products_for_customers(self, k: int) -> DataFrame:
        """customer_id, product_id, base_similarity, price_match, rank_score: every candidate that may be
        the best of its subcategory among the customer's k best (scores above 0 only)."""
        stock = self.goods(SHELF)
        shards = cut(stock.groupBy("category", "slot", "piece").agg(F.min("price").alias("lo"), F.max("price").alias("hi")))
        first = Window.partitionBy("customer_id").orderBy(F.desc("n_category"), "category")
        own = cut(self.baskets.withColumn("main", F.row_number().over(first) == 1))
        columns = [*[c for c in WHO if not c.endswith("_max")], "need", "category", "slot", "piece", "n_category", "avg_price", "prices"]
        # where a customer's best products are expected: the shards around the average price of the main category
        at_home = F.col("main") & (F.col("slot") >= 0) & (
            F.col("avg_price").isNull() | ((F.col("avg_price") >= F.col("lo")) & (F.col("avg_price") <= F.col("hi"))))
        home = self.rows(lookup(own.filter("main"), shards, ["category"]).filter(at_home)).withColumn("need", F.lit(0.0))
        near = cut(_ask_wide(stock, home.select(*columns), k))
        best = self._best(near, k)
        limit = best.groupBy("customer_id").agg(F.when(F.count("*") >= k, F.min("rank_score")).otherwise(0.0).alias("need"))
        who = cut(self.who.join(limit, "customer_id", "left").withColumn("need", F.coalesce("need", F.lit(0.0))))
        # a hair below the limit: bounds and scores are sums in another order
        low = F.col("need") - SLACK
        parts = own.join(who, "customer_id")
        full = _largest(2 * F.col("n_category"))
        # a product's price match falls with its distance from the average price, the price sum times it is ``most`` at the highest
        off = F.greatest(F.col("lo") - F.col("avg_price"), F.col("avg_price") - F.col("hi"), F.lit(0.0))
        match = F.when(F.col("cat_std") > 0, F.exp(-0.5 * F.pow(off / F.col("cat_std"), 2))).otherwise(1.0)
        top = match * _largest(F.col("n_category")) + F.least(F.col("most"), match * F.col("n_category")) / (5.0 * F.col("n_bought"))
        reach = F.when(F.col("lo").isNull(), 0.5 * _largest(1.5 * F.col("n_category")) >= low).when(
            F.col("avg_price").isNull(), 0.5 * full >= low).otherwise((top >= low) | (low <= 0))
        inside = lookup(parts, shards, ["category"]).filter(reach & ~F.coalesce(at_home, F.lit(False)))
        far = who.filter(0.5 * _largest(F.lit(0)) >= low)
        outside = self._far(far, stock).join(who, "customer_id")
        best = self._best(near.union(_ask_wide(stock, inside.select(*columns).unionByName(outside.select(*columns)), k)), k)
        return best.drop("sub").join(stock.select("product_id", "subcategory"), "product_id")

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        """The best product of each subcategory, k subcategories per customer; customers move once."""
        n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = _score(found).repartition(n, "customer_id")
        order = [F.desc("rank_score"), "product_id"]
        one = found.withColumn("_r", F.row_number().over(Window.partitionBy("customer_id", "sub").orderBy(*order))).filter("_r = 1")
        return one.withColumn("_r", F.row_number().over(Window.partitionBy("customer_id").orderBy(*order))).filter(F.col("_r") <= k).drop("_r")

    def _leaders(self, parts: DataFrame, sample: int) -> DataFrame:
        """customer_id, category: the ``sample`` highest bounds of each category, and a quarter as many
        of the customers without a price profile, whom no price puts off; and the highest bounds of each
        price level, for products away from the usual price.  The first are found in buckets, so that
        no task sorts a category."""
        n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        some = parts.select("customer_id", "category", "bound", F.col("avg_price").isNull().alias("_free"),
                            F.floor(8 * F.col("avg_price") / F.when(F.col("cat_std") > 0, F.col("cat_std"))).alias("_level"),
                            F.pmod(F.xxhash64("customer_id"), F.lit(n)).alias("_bucket"))
        some = cut(some)

        def top(by: list[str], k: int, rows: DataFrame) -> DataFrame:
            ranked = Window.partitionBy(*by).orderBy(F.desc("bound"), "customer_id")
            return rows.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= F.when(F.col("_free"), sample // 4).otherwise(k)).drop("_r")

        best = top(["category", "_free"], sample, top(["category", "_free", "_bucket"], sample, some))
        near = top(["category", "_level"], max(sample // 32, 1), some.filter("not _free"))
        return best.union(near).select("customer_id", "category").distinct()

    def _strangers(self, stock: DataFrame, each: int) -> DataFrame:
        """customer_id and shard: of the customers with the largest share of a value of ``stock`` (``each``
        of a value), those who never bought the category of a shard that holds it."""
        held = [stock.select(F.lit(a).alias("_kind"), F.col(a).alias("_code"), "category", "slot", "piece") for a in ATTRS]
        index = cut(held[0].union(held[1]).distinct())
        share = [self.who.select("customer_id", "n_bought", F.lit(a).alias("_kind"), F.explode(F.arrays_zip(F.col(f"{a}_codes").alias("_code"), F.col(f"{a}_ns").alias("_n"))).alias("_z"))
                 .select("customer_id", "_kind", F.col("_z._code").alias("_code"), (F.col("_z._n") / F.col("n_bought")).alias("_share")) for a in ATTRS]
        first = Window.partitionBy("_kind", "_code").orderBy(F.desc("_share"), "customer_id")
        known = lookup(share[0].union(share[1]), index.select("_kind", "_code").distinct(), ["_kind", "_code"])
        top = cut(known.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= each).select("customer_id", "_kind", "_code"))
        pairs = top.join(index, ["_kind", "_code"]).select("customer_id", "category", "slot", "piece").distinct()
        return pairs.join(self.baskets.select("customer_id", "category"), ["customer_id", "category"], "left_anti")

    def _absent(self, who: DataFrame, ranges: DataFrame) -> DataFrame:
        """Rows of ``who`` (with bound) for categories they never bought, if their bound reaches a limit
        there.  Shards come later: a customer pairs with categories, not with every shard."""
        weakest = F.broadcast(ranges.groupBy("category").agg(F.min("least").alias("_least")))   # one row per category
        pairs = who.select("customer_id", "bound").join(weakest, F.col("bound") >= F.col("_least") - SLACK).drop("_least")
        return pairs.join(self.baskets.select("customer_id", "category"), ["customer_id", "category"], "left_anti")

    def customers_for_products(self, wanted: DataFrame, k: int, sample: int = 1024, each: int = 16) -> DataFrame:
        """product_id, customer_id, base_similarity, price_match, rank_score: the k best customers (scores above 0) of each wanted product."""
        stock = cut(self.stock.join(wanted.select("product_id"), "product_id", "left_semi"))
        keys, pair = ["category", "slot", "piece"], ["customer_id", "category"]
        ranges = cut(stock.groupBy(*keys).agg(F.min("price").alias("lo"), F.max("price").alias("hi")))
        columns = [*WHO, *keys, "n_category", "avg_price", "prices", "bound"]
        empty = {"n_category": F.lit(0).cast("long"), "avg_price": F.lit(None).cast("double"), "prices": F.array().cast("array<double>")}
        own = lookup(self.baskets, ranges.select("category").distinct(), ["category"])
        parts = cut(self.rows(own).withColumn("bound", _largest(2 * F.col("n_category")) * F.when(F.col("avg_price").isNull(), 0.5).otherwise(1.0)))
        far = self.who.withColumn("bound", 0.5 * _largest(F.lit(0)))
        # a first round of likely customers: the highest bounds of the category, and the largest shares
        # of an attribute value among those who never bought the category
        lead = cut(self._leaders(parts, sample).withColumn("_lead", F.lit(True)))
        parts = cut(lookup(parts, lead, pair, "left"))
        guests = cut(self._strangers(stock, each))
        likely = lookup(parts.filter("_lead"), ranges, ["category"]).select(*columns)
        likely = likely.unionByName(guests.join(far, "customer_id").withColumns(empty).select(*columns))
        near = cut(_ask(stock, likely, k))
        best = _score(near).withColumn("_r", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("rank_score"), "customer_id")))
        limit = best.filter(F.col("_r") <= k).groupBy("product_id").agg(F.when(F.count("*") >= k, F.min("rank_score")).otherwise(0.0).alias("need"))
        stock = cut(stock.join(limit, "product_id", "left").withColumn("need", F.coalesce("need", F.lit(0.0))))
        ranges = cut(stock.groupBy(*keys).agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.min("need").alias("least")))
        off = F.greatest(F.col("lo") - F.col("avg_price"), F.col("avg_price") - F.col("hi"), F.lit(0.0))
        match = F.when(F.col("lo").isNull() | F.col("avg_price").isNull(), 0.5).when(F.col("cat_std") > 0, F.exp(-0.5 * F.pow(off / F.col("cat_std"), 2))).otherwise(1.0)
        inside = lookup(parts.filter("_lead is null"), ranges, ["category"]).filter(_largest(2 * F.col("n_category")) * match >= F.col("least") - SLACK)
        absent = cut(self._absent(far, ranges).drop("bound").join(far, "customer_id"))
        outside = lookup(absent, ranges.select(*keys, "least"), ["category"]).filter(F.col("bound") >= F.col("least") - SLACK)
        outside = lookup(outside, guests.withColumn("_guest", F.lit(True)), ["customer_id", *keys], "left").filter("_guest is null").withColumns(empty)
        rows = inside.select(*columns).unionByName(outside.select(*columns))
        return _score(near.union(_ask(stock, rows, k)))
