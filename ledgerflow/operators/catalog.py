"""Filters, lookups, joins, ordered lists and set operations (F*, J*, T*, W1–W2, U*).

Range conditions are turned into equi-joins where possible (J18, J20 explode each row
into the few dates it can match), so no join degenerates into a nested loop or emits
all pairs of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.constants import ALL_CATEGORIES, STATUS_CONFIRMED, STATUS_DELETED, STATUS_OPEN
from ledgerflow.functions.misc import blank_to_null

LEVELS = ("category", "subcategory", "name_zh", "city", "district")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------- filters
def filter_level(df: DataFrame, level: str, values: Sequence[str]) -> DataFrame:
    """``level IN values``; any other level is an error."""
    if level not in LEVELS:
        raise ValueError(f"unsupported level {level!r}")
    return df.filter(F.col(level).isin(list(values)))


def optional_filters(df: DataFrame, **kw) -> DataFrame:
    """equality filter per given keyword; None, '' and the all-categories value mean
    no filter."""
    for col, value in kw.items():
        if value is None or value == "" or value == ALL_CATEGORIES:
            continue
        df = df.filter(F.col(col) == F.lit(value))
    return df


def between_days(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """start ≤ ts < end + 1 day (the whole end day)."""
    c = F.col(ts).cast("timestamp")
    return df.filter((c >= F.lit(start).cast("timestamp"))
                     & (c < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))


def visible_orders(df: DataFrame, as_of: str) -> DataFrame:
    """open orders always; confirmed ones until 1 day after confirmed_at; deleted
    ones until 1 day after updated_at; a null or unparsable time keeps the row."""
    now = F.lit(as_of).cast("timestamp")
    st = F.col("status")
    t = (F.when(st == STATUS_CONFIRMED, F.col("confirmed_at").cast("string"))
         .when(st == STATUS_DELETED, F.col("updated_at").cast("string")))
    parsed = F.try_to_timestamp(t)
    keep = ((st == STATUS_OPEN) | ~st.isin(STATUS_CONFIRMED, STATUS_DELETED) | parsed.isNull()
            | (now < parsed + F.expr("INTERVAL 1 DAY")))
    return df.filter(keep)


def min_days(df: DataFrame, col: str, lo: int, hi: int | None = None) -> DataFrame:
    """col ≥ lo (and ≤ hi when given)."""
    cond = F.col(col) >= lo
    if hi is not None:
        cond = cond & (F.col(col) <= hi)
    return df.filter(cond)


def filter_change(df: DataFrame, kind: str | None, name: str | None = None, name_col: str = "product_name") -> DataFrame:
    """increase (> 0), decrease (< 0), none (= 0) on change_amount; exact name."""
    s = F.signum(F.col("change_amount"))
    if kind == "increase":
        df = df.filter(s > 0)
    elif kind == "decrease":
        df = df.filter(s < 0)
    elif kind == "none":
        df = df.filter(s == 0)
    if name:
        df = df.filter(F.col(name_col) == F.lit(name))
    return df


def missing_contact(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """F8: phone / address null, '' or 'None' → flags and a warning text."""
    mp = blank_to_null("phone_number").isNull()
    ma = blank_to_null("address").isNull()
    out = df.withColumn("missing_phone", mp).withColumn("missing_address", ma).withColumn(
        "warning", F.concat_ws(", ", F.when(mp, F.lit("missing phone")), F.when(ma, F.lit("missing address"))))
    return out.filter(F.col("missing_phone") | F.col("missing_address")) if only_missing else out


def missing_required(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``missing_fields`` = names of required fields that are null or blank."""
    arr = F.array(*[F.when(blank_to_null(F.col(f).cast("string")).isNull(), F.lit(f)) for f in fields])
    return df.withColumn("missing_fields", F.filter(arr, lambda x: x.isNotNull()))


def match_history(hist: DataFrame, targets: DataFrame, name_col: str = "product_name") -> DataFrame:
    """per target (one per customer), the customer's history rows of the first
    non-empty tier: 1 id equal (trim, lower), 2 name equal, 3 history name contains the
    target name, 4 target name (or the name without its first word) contains the history
    name, 5 all rows.  ``targets``: customer_id, target_product_id, target_name."""
    j = hist.join(targets, "customer_id")
    hn, tn = F.col(name_col), F.col("target_name")
    tn_tail = F.trim(F.regexp_replace(tn, r"^\S+\s*", ""))
    tier = (F.when(F.lower(F.trim(F.col("product_id").cast("string")))
                   == F.lower(F.trim(F.col("target_product_id").cast("string"))), 1)
            .when(hn == tn, 2)
            .when(F.instr(F.lower(hn), F.lower(tn)) > 0, 3)
            .when((F.instr(F.lower(tn), F.lower(hn)) > 0)
                  | ((tn_tail != "") & (F.instr(F.lower(tn_tail), F.lower(hn)) > 0)), 4)
            .otherwise(5))
    j = j.withColumn("tier", tier)
    best = j.groupBy("customer_id").agg(F.min("tier").alias("best_tier"))
    return j.join(best, "customer_id").filter(F.col("tier") == F.col("best_tier")).drop("best_tier")


def name_contains(df: DataFrame, col: str, term: str) -> DataFrame:
    """case-insensitive substring."""
    return df.filter(F.instr(F.lower(F.col(col)), F.lit(term.lower())) > 0)


def distinct_values(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """distinct non-null, non-empty values, sorted."""
    d = df if where is None else df.filter(where)
    v = blank_to_null(F.col(col).cast("string"))
    return d.select(v.alias(col)).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def new_item_orders(df: DataFrame) -> DataFrame:
    """confirmed orders of new products."""
    return df.filter(F.col("is_new_product") & (F.col("status") == STATUS_CONFIRMED))


def timeline(tx: DataFrame, customer_id=None, product_id=None, month: str | None = None) -> DataFrame:
    """dated purchases, optional customer / product (trimmed, lower-case) / month
    'YYYY-MM'; oldest first."""
    t = tx
    if customer_id is not None:
        t = t.filter(F.col("customer_id") == F.lit(customer_id))
    if product_id is not None:
        t = t.filter(F.lower(F.trim(F.col("product_id").cast("string"))) == str(product_id).strip().lower())
    if month:
        first = F.to_date(F.lit(f"{month}-01"))
        t = t.filter((F.col("transaction_date") >= first) & (F.col("transaction_date") < F.add_months(first, 1)))
    return t.orderBy("customer_id", "transaction_date", "transaction_id")


# ------------------------------------------------------------------------------ joins
def customer_latest(customers: DataFrame, tx: DataFrame) -> DataFrame:
    """J4 + W1: every customer with its latest transaction (date, product), null if none.
    The latest row is the max of (date, transaction id) per key — no sort of the group."""
    last = tx.groupBy("customer_id").agg(
        F.max_by(F.struct("transaction_date", "product_id", "transaction_id"),
                 F.struct("transaction_date", "transaction_id")).alias("l"))
    return customers.join(last, "customer_id", "left").select(
        *customers.columns, F.col("l.transaction_date").alias("last_transaction_date"),
        F.col("l.product_id").alias("last_product_id"))


def attach_ranked(df: DataFrame, key: str, prefix: str, n: int, dim: DataFrame, dim_key: str,
                  dim_cols: Sequence[str]) -> DataFrame:
    """For rank columns prefix1..prefixN attach dimension columns per rank with ONE
    join: unpivot to long, join, pivot back by conditional aggregate."""
    ranks = [f"{prefix}{k}" for k in range(1, n + 1)]
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.col(r).alias("ref"))
                                               for k, r in enumerate(ranks, 1)])).alias("x"))
    long = long.select(key, "x.rank", "x.ref").filter(F.col("ref").isNotNull())
    d = dim.select(F.col(dim_key).alias("ref"), *dim_cols)
    j = long.join(d, "ref", "left")
    aggs = [F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}_rank{k}") for k in range(1, n + 1) for c in dim_cols]
    return df.join(j.groupBy(key).agg(*aggs), key, "left")


def split_known(df: DataFrame, customers: DataFrame, pm: DataFrame) -> DataFrame:
    """Flag each record: customer known, product known, valid = both."""
    kc = customers.select("customer_id").distinct().withColumn("_kc", F.lit(True))
    kp = pm.select("product_id").distinct().withColumn("_kp", F.lit(True))
    j = df.join(kc, "customer_id", "left").join(kp, "product_id", "left")
    return (j.withColumn("customer_known", F.coalesce("_kc", F.lit(False)))
            .withColumn("product_known", F.coalesce("_kp", F.lit(False)))
            .withColumn("valid", F.col("customer_known") & F.col("product_known")).drop("_kc", "_kp"))


def split_counts(flagged: DataFrame) -> DataFrame:
    """Valid + skipped = input, with skipped by reason."""
    return flagged.agg(F.count("*").alias("input_rows"), F.count_if("valid").alias("valid_rows"),
                       F.count_if(~F.col("valid")).alias("skipped_rows"),
                       F.count_if(~F.col("customer_known")).alias("unknown_customer_rows"),
                       F.count_if(~F.col("product_known")).alias("unknown_product_rows"))


def missing_members(df: DataFrame, dim: DataFrame, key: str, attrs: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Distinct keys of ``df`` absent from ``dim``, with the attributes of their
    first occurrence (by ``order``)."""
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*attrs), F.struct(*order)).alias("_f"))
    return first.join(dim.select(key), key, "left_anti").select(key, "_f.*")


def sibling_products(pm: DataFrame) -> DataFrame:
    """J14 (re-aimed): product → its non-empty subcategory and the number of products in
    it.  Siblings are reached by joining through the subcategory key; the all-pairs
    product × product list is never emitted."""
    p = pm.filter(blank_to_null("subcategory").isNotNull()).select("product_id", "subcategory").distinct()
    cnt = p.groupBy("subcategory").agg(F.count("*").alias("sibling_count"))
    return p.join(cnt, "subcategory")


def purchased_by_subcategory(cands: DataFrame, tx: DataFrame, pm: DataFrame) -> DataFrame:
    """Candidates (customer_id, product_id) whose customer bought any product of the
    candidate product's subcategory (semi join on (customer, subcategory))."""
    sub = pm.filter(blank_to_null("subcategory").isNotNull()).select("product_id", "subcategory").distinct()
    bought = tx.join(sub, "product_id").select("customer_id", "subcategory").distinct()
    c = cands.join(sub, "product_id")
    return c.join(bought, ["customer_id", "subcategory"], "left_semi")


def pair_days(pairs: DataFrame, start: str, end: str, skip_sunday: bool = True) -> DataFrame:
    """Every pair × every day in [start, end] (Sundays removed), by ``explode`` of a
    bounded date sequence — no cross join."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("target_date")
    out = pairs.select("*", days)
    return out.filter(F.weekday("target_date") != 6) if skip_sunday else out


def sample_windows(tx: DataFrame, first: str, last: str, step_days: int, history_days: int = 90,
                   label_days: int = 7) -> DataFrame:
    """Assign each row to the sample dates d = first + k·step (d ≤ last) with
    d − history ≤ date < d (role 'history') or d ≤ date < d + label (role 'label').

    Each row is exploded into the few sample dates whose windows contain it (at most
    (history+label)/step), which replaces a range join by arithmetic."""
    d = F.col("transaction_date")
    off = F.datediff(d, F.lit(first).cast("date"))
    n_last = F.floor(F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) / step_days)
    # history: d < s ≤ d + history  → k in [ceil((off+1)/step), floor((off+history)/step)]
    k_lo_h = F.ceil((off + 1) / step_days)
    k_hi_h = F.floor((off + history_days) / step_days)
    # label: d − label < s ≤ d → k in [ceil((off − label + 1)/step), floor(off/step)]
    k_lo_l = F.ceil((off - label_days + 1) / step_days)
    k_hi_l = F.floor(off / step_days)

    def ks(lo, hi):
        lo2, hi2 = F.greatest(lo, F.lit(0)), F.least(hi, n_last)
        return F.when(lo2 <= hi2, F.sequence(lo2.cast("int"), hi2.cast("int"))).otherwise(F.array().cast("array<int>"))

    tagged = tx.select("*", F.concat(
        F.transform(ks(k_lo_h, k_hi_h), lambda k: F.struct(k.alias("k"), F.lit("history").alias("role"))),
        F.transform(ks(k_lo_l, k_hi_l), lambda k: F.struct(k.alias("k"), F.lit("label").alias("role")))).alias("_s"))
    out = tagged.select("*", F.explode("_s").alias("_x")).drop("_s")
    return (out.withColumn("sample_date", F.date_add(F.lit(first).cast("date"), (F.col("_x.k") * step_days).cast("int")))
            .withColumn("role", F.col("_x.role")).drop("_x"))


def attach_notes(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The customer's notes, '' when none."""
    n = customers.select("customer_id", F.col("notes").alias("customer_notes"))
    return orders.join(n, "customer_id", "left").withColumn("customer_notes", F.coalesce("customer_notes", F.lit("")))


def hits_within(pred: DataFrame, tx: DataFrame, days: int = 2, date_col: str = "prediction_date") -> DataFrame:
    """Predictions with a purchase of the same pair within ±days.

    Each purchase day is expanded to the 2·days+1 dates it covers and de-duplicated, then
    the predictions are semi-joined on (customer, product, date): an equi-join, no
    pair explosion for hot pairs."""
    cover = (tx.select("customer_id", "product_id", "transaction_date").distinct()
             .select("customer_id", "product_id",
                     F.explode(F.sequence(F.date_sub("transaction_date", days), F.date_add("transaction_date", days)))
                     .alias(date_col)).distinct())
    return pred.join(cover, ["customer_id", "product_id", date_col], "left_semi")


def line_map(df: DataFrame, customers: DataFrame, by: str = "line_id") -> DataFrame:
    """Chat id ↔ customer id lookup with an existence flag."""
    m = customers.filter(F.col("line_id").isNotNull()).select(
        F.col("line_id"), F.col("customer_id").alias("mapped_customer_id"))
    if by == "line_id":
        out = df.join(m, "line_id", "left")
        return out.withColumn("mapped", F.col("mapped_customer_id").isNotNull())
    m2 = m.select(F.col("mapped_customer_id").alias("customer_id"), F.col("line_id").alias("mapped_line_id"))
    return df.join(m2, "customer_id", "left").withColumn("mapped", F.col("mapped_line_id").isNotNull())


def delivery_orders(ds: DataFrame, orders: DataFrame) -> DataFrame:
    """Delivery ⟕ order on the id as text; 'N/A' when no order matches."""
    o = orders.select(F.col("id").cast("string").alias("_oid"), F.col("customer_name").alias("order_customer_name"),
                      F.col("status").alias("order_status"))
    j = ds.join(o, ds.source_order_id.cast("string") == o._oid, "left").drop("_oid")
    return (j.withColumn("order_customer_name", F.coalesce("order_customer_name", F.lit("N/A")))
            .withColumn("order_status", F.coalesce("order_status", F.lit("N/A"))))


def delivery_category(ds: DataFrame, pm: DataFrame, category: str | None = None) -> DataFrame:
    """Delivery ⟕ product through the product name (not a key), optional category."""
    names = pm.select(F.col("name_zh").alias("product_name"), "category").distinct()
    j = ds.join(names, "product_name", "left")
    return j if not category or category == ALL_CATEGORIES else j.filter(F.col("category") == category)


# ------------------------------------------------------------------------ top-k, order
def page(df: DataFrame, order: Sequence, page_no: int, size: int) -> DataFrame:
    """Rows of one page (1-based) in ``order`` plus total_count, pages, has_next,
    has_prev.  The page is a TakeOrderedAndProject; the total is a scalar subquery."""
    rows = df.orderBy(*order).offset((page_no - 1) * size).limit(size)
    total = df.agg(F.count("*")).scalar()
    return rows.select("*", total.alias("total_count"), F.ceil(total / size).alias("pages"),
                       (F.lit(page_no * size) < total).alias("has_next"), F.lit(page_no > 1).alias("has_prev"))


def top_k_per(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first k rows per key in a total ``order``, with their rank.  The
    planner limits every group to k rows before the shuffle as well as after it, so a hot
    key sends at most k rows per task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def top_products_by_count(tx: DataFrame, k: int = 3) -> DataFrame:
    """The k most bought products per customer (by line count, tie → product id)."""
    g = tx.groupBy("customer_id", "product_id").agg(F.count("*").alias("purchase_count"))
    return top_k_per(g, ["customer_id"], [F.col("purchase_count").desc(), F.col("product_id").asc()], k)


def cap_pairs(tx: DataFrame, n: int) -> DataFrame:
    """The n most active (customer, product) pairs (TakeOrdered, ties by key)."""
    g = tx.groupBy("customer_id", "product_id").agg(F.count("*").alias("purchase_count"))
    return g.orderBy(F.col("purchase_count").desc(), "customer_id", "product_id").limit(n)


def ordered(df: DataFrame, keys: Sequence) -> DataFrame:
    """T4: multi-key ordered list."""
    return df.orderBy(*keys)


def sort_by(df: DataFrame, col: str, ascending: bool = True, as_date: bool = False) -> DataFrame:
    """T5: user-chosen column and direction; text dates sort as dates."""
    key = F.to_date(F.col(col)) if as_date else F.col(col)
    return df.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last())


# ------------------------------------------------------------------- window picks
def latest_per(df: DataFrame, key: Sequence[str], ts: str, tie: Sequence[str]) -> DataFrame:
    """Newest row per key (ts desc, then ``tie`` desc)."""
    return distinct_on(df, key, [F.col(ts).desc()] + [F.col(t).desc() for t in tie])


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order`` (DISTINCT ON); ``order`` must be total."""
    return top_k_per(df, keys, order, 1, rank_col="_rn").drop("_rn")


# ------------------------------------------------------------------ set operations
def pair_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples of a not in b."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def pair_intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples in both."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Union by column name; missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
