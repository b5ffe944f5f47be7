"""Price profiles and product / customer recommendations.

Scoring follows the source's rules: the similarity of two products is the mean of five
factors (equal category, subcategory, specification, process type, and price closeness
exp(−½(Δ/σ_category)²) inside one category); a candidate's score for a customer is its
mean similarity to the customer's bought products times the price match of the product
against the customer's average price in that category.

Scale notes:

* The mean similarity to a bought set B splits into per-customer attribute counts:
  (#B same category + #B same subcategory + #B same spec + #B same process + Σ price
  factor) / (5·|B|).  The four counts are equi-joins on attribute values; only the price
  sum needs (candidate, bought product) pairs, and only inside one category, with bought
  products of equal price merged first.
* The lists of M26 and M27 come from the bounded search of ``bounded.py``: limits from a
  first round, upper bounds against them in the second, prices summed only where a bound
  still reaches the limit.  Customers with more than ``HOT`` bought products, whose prices
  would not fit a row, are scored by joins instead.
* Candidates are products sharing an attribute value with the customer's history; a
  product sharing none scores 0.  Short lists are filled with those by id: M26 with the
  smallest products of subcategories not bought, M27 with customers who did not buy the
  subcategory.
* The 5 % / 95 % price cut uses exact quantiles computed from value → count and
  magnitude → count aggregates: no global sort, and heavily repeated prices collapse
  before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.misc import default
from ledgerflow.operators.sales import dedup_product
from ledgerflow.session import cut

R = 6
UNKNOWN = "unknown"   # FIXED VALUE: fill for missing product attributes
HOT = 2048            # bought products of a customer from which joins score it instead of the search


def _r(c: Column) -> Column:
    return F.round(c.cast("double"), R)


# ------------------------------------------------------------------ exact quantiles
def magnitude(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises: 256 steps per power of two."""
    step = F.floor(F.log2(F.abs(v)) * 256) + 300_000   # log2 of a double is above -1075
    return F.when(v > 0, step).when(v < 0, -step).otherwise(F.lit(0)).cast("long")


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / SQL ``quantile_cont``) of ``col`` as
    columns q0, q1, ...: one row, or one per ``group`` (columns without nulls).

    Distinct values are counted (partial aggregation) and the counts summed per magnitude,
    a fixed function of the value, so a task run again cannot disagree with the offsets.
    Running sums over the magnitudes tell which of them hold the wanted ranks (at most two
    per quantile); only their values are ordered."""
    by = list(group)
    g = (df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("v")).agg(F.count("*").alias("c"))
         .withColumn("b", magnitude(F.col("v"))))
    every = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    off = g.groupBy(*by, "b").agg(F.sum("c").alias("bc")).select(
        *by, "b", "bc", F.coalesce(F.sum("bc").over(before), F.lit(0)).alias("off"), F.sum("bc").over(every).alias("n"))
    ranks = [r for q in qs for k1 in [F.floor((F.col("n") - 1) * F.lit(float(q)))] for r in (k1, k1 + 1)]
    wanted = F.exists(F.array(*ranks), lambda r: (F.col("off") <= r) & (r < F.col("off") + F.col("bc")))
    off = off.filter(wanted)
    # without groups: at most two rows per quantile
    cum = g.join(off if by else F.broadcast(off), [*by, "b"]).withColumn("cin", F.sum("c").over(
        Window.partitionBy(*by, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    cum = cum.withColumn("hi", F.col("off") + F.col("cin")).withColumn(
        "lo", F.col("hi") - F.col("c"))                       # value v holds 0-based ranks [lo, hi)
    sel, outs = [], []
    for i, q in enumerate(qs):
        h = (F.col("n") - 1) * F.lit(float(q))
        k1 = F.floor(h)
        k2 = k1 + 1
        sel += [F.max(F.when((F.col("lo") <= k1) & (F.col("hi") > k1), F.col("v"))).alias(f"x1_{i}"),
                F.max(F.when((F.col("lo") <= k2) & (F.col("hi") > k2), F.col("v"))).alias(f"x2_{i}"),
                F.max(h).alias(f"h_{i}")]
        x1, x2 = F.col(f"x1_{i}"), F.coalesce(F.col(f"x2_{i}"), F.col(f"x1_{i}"))
        outs.append((x1 + (x2 - x1) * (F.col(f"h_{i}") - F.floor(F.col(f"h_{i}")))).alias(f"q{i}"))
    return (cum.groupBy(*by) if by else cum).agg(*sel).select(*by, *outs)


# --------------------------------------------------------------------- price data
def priced_sales(tx: DataFrame, pm: DataFrame) -> DataFrame:
    """Sales lines with quantity > 0 of active products, unit price = amount / quantity,
    product attributes (missing → 'unknown')."""
    p = active_products(pm)
    t = tx.filter((F.col("quantity") > 0) & F.col("customer_id").isNotNull() & F.col("amount").isNotNull())
    return t.join(p, "product_id").withColumn(
        "unit_price", F.col("amount").cast("double") / F.col("quantity").cast("double"))


def active_products(pm: DataFrame) -> DataFrame:
    """Active products, one row each, attributes with 'unknown' for missing values."""
    p = dedup_product(pm.filter(F.col("is_active") == "active"))
    return p.select(
        "product_id", *[default(F.col(c).cast("string"), UNKNOWN).alias(c)
                        for c in ("category", "subcategory", "specification", "process_type")])


def trim_prices(sales: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Keep rows with unit price inside the global [5 %, 95 %] quantiles (inclusive).
    The bounds are one row, broadcast; the sales stay where they are."""
    q = exact_quantiles(sales, "unit_price", [lo, hi]).select(F.col("q0").alias("_lo"), F.col("q1").alias("_hi"))
    j = sales.join(F.broadcast(q), (F.col("unit_price") >= F.col("_lo")) & (F.col("unit_price") <= F.col("_hi")))
    return j.drop("_lo", "_hi")


def category_price_stats(sales: DataFrame) -> DataFrame:
    """Per category mean, sample std, min, max, count of unit prices."""
    return sales.groupBy("category").agg(
        F.avg("unit_price").alias("cat_mean"), F.stddev_samp("unit_price").alias("cat_std"),
        F.min("unit_price").alias("cat_min"), F.max("unit_price").alias("cat_max"), F.count("*").alias("cat_count"))


def price_profiles(sales: DataFrame, cat: DataFrame | None = None) -> DataFrame:
    """Per (customer, category) with ≥ 2 purchases: mean, sample std, count, z-score
    against the category and level (high > 1, medium > −1, low)."""
    cat = category_price_stats(sales) if cat is None else cat
    g = sales.groupBy("customer_id", "category").agg(
        F.avg("unit_price").alias("avg_price"), F.stddev_samp("unit_price").alias("price_std"),
        F.count("*").alias("purchase_count")).filter(F.col("purchase_count") >= 2)
    j = g.join(cat.select("category", "cat_mean", "cat_std"), "category")
    z = F.when(F.col("cat_std") > 0, (F.col("avg_price") - F.col("cat_mean")) / F.col("cat_std"))
    lvl = F.when(z > 1, F.lit("high")).when(z > -1, F.lit("medium")).otherwise(F.lit("low"))
    return j.withColumn("z_score", z).withColumn("price_level", F.when(z.isNull(), F.lit("low")).otherwise(lvl)) \
            .drop("cat_mean", "cat_std")


def product_prices(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id").agg(F.avg("unit_price").alias("product_price"))


def _gauss(a: Column, b: Column, sd: Column) -> Column:
    """Price closeness: exp(−½(|a−b|/σ)²); σ ≤ 0 or null → 1 if equal else 0.5; a missing
    price → 0.5."""
    d = F.abs(a - b)
    return (F.when(a.isNull() | b.isNull(), F.lit(0.5))
            .when(sd > 0, F.exp(-0.5 * F.pow(d / sd, 2)))
            .when(d == 0, F.lit(1.0)).otherwise(F.lit(0.5)))


def price_match(pairs: DataFrame, products: DataFrame, prices: DataFrame, profiles: DataFrame,
                cat: DataFrame) -> DataFrame:
    """For (customer_id, product_id) pairs: Gaussian closeness of the product's mean
    price to the customer's mean price in the product's category (σ of the category);
    0.5 when the product has no price or the customer no profile there."""
    j = (pairs.join(products.select("product_id", "category"), "product_id")
         .join(prices, "product_id", "left")
         .join(profiles.select("customer_id", "category", "avg_price"), ["customer_id", "category"], "left")
         .join(cat.select("category", "cat_std"), "category", "left"))
    pmatch = F.when(F.col("product_price").isNull() | F.col("avg_price").isNull(), F.lit(0.5)).otherwise(
        _gauss(F.col("product_price"), F.col("avg_price"), F.col("cat_std")))
    return j.select("customer_id", "product_id", pmatch.alias("price_match"))


def bought_together(lines: DataFrame, order_key: str, product_key: str) -> DataFrame:
    """Every distinct pair of products of one order (product_id_a < product_id_b).  Repeated
    lines of a product are one before the pairs are made."""
    one = lines.select(F.col(order_key).alias("_o"), F.col(product_key).alias("product_id_a")).distinct()
    other = one.withColumnRenamed("product_id_a", "product_id_b")
    return one.join(other, "_o").filter("product_id_a < product_id_b").select("product_id_a", "product_id_b").distinct()


def priced_products(products: DataFrame, prices: DataFrame, cat: DataFrame) -> DataFrame:
    """Products with their mean price (null without one) and their category's deviation."""
    p = products.join(prices.select("product_id", F.col("product_price").alias("price")), "product_id", "left")
    return p.join(cat.select("category", "cat_std"), "category", "left")


def similar(pairs: DataFrame, priced: DataFrame, digits: int, *more: Column) -> DataFrame:
    """The 5-factor similarity of pairs that hold their first product whole (columns of ``priced``
    with _a) and the id of the second; ``more`` columns may use the prices."""
    j = pairs.join(priced.drop("cat_std").select(*[F.col(c).alias(f"{c}_b") for c in priced.columns if c != "cat_std"]), "product_id_b")
    same = [F.when(F.col(f"{c}_a") == F.col(f"{c}_b"), 1.0).otherwise(0.0)
            for c in ("category", "subcategory", "specification", "process_type")]
    price = F.when(F.col("category_a") != F.col("category_b"), F.lit(0.0)).otherwise(
        _gauss(F.col("price_a"), F.col("price_b"), F.col("cat_std_a")))
    names = ("same_category", "same_subcategory", "same_specification", "same_process")
    j = j.withColumns({n: s for s, n in zip(same, names)})
    return j.select("product_id_a", "product_id_b", *names, F.round(price, digits).alias("price_similarity"),
                    F.round((same[0] + same[1] + same[2] + same[3] + price) / 5.0, digits).alias("similarity"), *more)


def product_similarity(pairs: DataFrame, products: DataFrame, prices: DataFrame, cat: DataFrame, digits: int = R) -> DataFrame:
    """The 5-factor similarity for given (product_a, product_b) pairs.  Products get their
    price and deviation before they meet the pairs, which move once to each product."""
    priced = cut(priced_products(products, prices, cat))
    first = priced.select(*[F.col(c).alias(f"{c}_a") for c in priced.columns])
    return similar(pairs.join(first, "product_id_a"), priced, digits)


# ---------------------------------------------------------------- candidate scoring
def _scored_pairs(pairs: DataFrame, sales: DataFrame, pm: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """base_similarity, price_match, final_score and rank_score of given (customer_id,
    product_id) pairs, by joins.  ``only`` names the customers of the pairs, if few."""
    c, p = "customer_id", "product_id"
    products, prices = active_products(pm), product_prices(sales)
    cat = category_price_stats(sales).select("category", "cat_std")
    mine = sales if only is None else sales.join(only, c, "left_semi")
    bought = mine.select(c, p).distinct().join(products, p)
    nb = bought.groupBy(c).agg(F.count("*").alias("n_bought"), F.count_if(F.col("subcategory") == UNKNOWN).alias("n_unknown"))
    x = pairs.select(c, p).join(products.join(prices, p, "left"), p).join(nb, c).join(cat, "category", "left")
    for a in ("category", "specification", "process_type"):
        x = x.join(bought.groupBy(c, a).agg(F.count("*").alias(f"n_{a}")), [c, a], "left")
    prof = (mine.groupBy(c, "category").agg(F.avg("unit_price").alias("avg_price"), F.count("*").alias("_pc"))
            .filter(F.col("_pc") >= 2).drop("_pc"))
    x = x.join(prof, [c, "category"], "left")
    # price term: each product × the bought prices of its category (equal prices merged)
    bp = (bought.join(prices, p, "left").groupBy(c, "category", F.col("product_price").alias("bought_price"))
          .agg(F.count("*").alias("m")))
    x = x.join(bp, [c, "category"], "left")
    term = F.when(F.col("m").isNotNull(),
                  F.col("m") * _gauss(F.col("product_price"), F.col("bought_price"), F.col("cat_std")))
    keep = ["subcategory", "n_category", "n_specification", "n_process_type", "n_bought", "n_unknown",
            "product_price", "avg_price", "cat_std"]
    g = x.groupBy(c, p).agg(*[F.max(k).alias(k) for k in keep], F.sum(term).alias("ps"))
    z = F.lit(0)
    n_sub = F.when(F.col("subcategory") == UNKNOWN, F.col("n_unknown")).otherwise(z)
    base = (F.coalesce("n_category", z) + n_sub + F.coalesce("n_specification", z)
            + F.coalesce("n_process_type", z) + F.coalesce("ps", F.lit(0.0))) / (5.0 * F.col("n_bought"))
    pmatch = F.when(F.col("product_price").isNull() | F.col("avg_price").isNull(), F.lit(0.5)).otherwise(
        _gauss(F.col("product_price"), F.col("avg_price"), F.col("cat_std")))
    out = g.select(c, p, "subcategory", base.alias("base_similarity"), pmatch.alias("price_match"))
    # rank on a rounded score so that last-bit differences of float sums cannot reorder
    return out.withColumn("rank_score", F.round(F.col("base_similarity") * F.col("price_match"), 10))


def _scored_candidates(sales: DataFrame, pm: DataFrame, only: DataFrame) -> DataFrame:
    """Every candidate of the customers ``only``, scored by joins.  Candidates: unbought active
    products sharing category, specification, process type or the unknown subcategory with
    the bought set, whose subcategory the customer has not bought ('unknown' never blocks)."""
    c, p = "customer_id", "product_id"
    products = active_products(pm)
    bought = sales.join(only, c, "left_semi").select(c, p).distinct().join(products, p)
    shared = [bought.select(c, a).distinct().join(products.select(p, a), a).select(c, p)
              for a in ("category", "specification", "process_type")]
    shared.append(bought.filter(F.col("subcategory") == UNKNOWN).select(c, "subcategory").distinct()
                  .join(products.select(p, "subcategory"), "subcategory").select(c, p))
    cand = shared[0].union(shared[1]).union(shared[2]).union(shared[3]).distinct()
    bsub = bought.filter(F.col("subcategory") != UNKNOWN).select(c, "subcategory").distinct()
    cand = (cand.join(bought.select(c, p), [c, p], "left_anti").join(products.select(p, "subcategory"), p)
            .join(bsub, [c, "subcategory"], "left_anti"))
    return _scored_pairs(cand, sales, pm, only)


def scoring_sales(tx: DataFrame, pm: DataFrame, trim: bool = True) -> DataFrame:
    """The priced sales every scoring branch reads, written once to the shared checkpoint
    folder (``checkpoint()``): the ~10 branches of the scoring plan read it instead of
    re-running the scan and joins, and a lost executor re-reads the checkpoint instead of
    the whole lineage.  The price cut (one row of bounds) comes after, so its quantiles read
    the written rows as well."""
    cols = ["customer_id", "product_id", "category", "subcategory", "specification", "process_type", "unit_price"]
    sales = cut(priced_sales(tx, pm).select(*cols))
    if not trim:
        return sales
    lo, hi = exact_quantiles(sales, "unit_price", [0.05, 0.95]).first() or (None, None)
    price = F.col("unit_price")
    return sales.filter((price >= F.lit(lo).cast("double")) & (price <= F.lit(hi).cast("double")))


def _scoring(sales: DataFrame, pm: DataFrame):
    from ledgerflow.operators.bounded import Scoring

    return Scoring(sales, active_products(pm), product_prices(sales), category_price_stats(sales), HOT)


SCORES = ["customer_id", "product_id", "subcategory", "base_similarity", "price_match", "rank_score"]


def _zero_scores(scoring: DataFrame, everyone: DataFrame, sales: DataFrame, pm: DataFrame, k: int) -> DataFrame:
    """Subcategories that score 0, for the customers (of ``everyone``) with fewer than ``k`` scoring ones.

    Every subcategory stands for its smallest product id, and the subcategories are
    numbered in that order.  A customer with e subcategories that are bought or scoring
    finds k others among the first k + e, so no customer meets the whole list."""
    c = "customer_id"
    reps = active_products(pm).groupBy("subcategory").agg(F.min("product_id").alias("product_id"))
    reps = reps.withColumn("place", F.row_number().over(Window.orderBy("product_id")))   # one row per subcategory
    few = cut(everyone.join(scoring.groupBy(c).agg(F.count("*").alias("n")), c, "left").filter(F.coalesce("n", F.lit(0)) < k).select(c))
    if few.isEmpty():
        return scoring.limit(0)
    mine = sales.join(few, c, "left_semi")
    taken = (mine.select(c, "subcategory").filter(F.col("subcategory") != UNKNOWN).unionByName(scoring.join(few, c, "left_semi").select(c, "subcategory"))
             .distinct())
    reach = few.join(taken.groupBy(c).agg(F.count("*").alias("e")), c, "left").select(
        c, F.explode(F.sequence(F.lit(1), F.lit(k) + F.coalesce("e", F.lit(0)).cast("int"))).alias("place"))
    free = (reach.join(reps, "place").join(taken, [c, "subcategory"], "left_anti")
            .join(mine.select(c, "product_id").distinct(), [c, "product_id"], "left_anti"))
    return _scored_pairs(free, sales, pm, few).select(*SCORES)


def _zero_customers(scoring: DataFrame, sales: DataFrame, wanted: DataFrame, pm: DataFrame, k: int) -> DataFrame:
    """Customers who score 0, for the wanted products with fewer than ``k`` scoring ones.

    Customers are numbered by id.  What bars a customer is the product's subcategory (an
    unknown one: the product itself).  Of a subcategory with e barred customers the first
    k + n others lie among the first k + n + e; all these reaches together are no more
    than the distinct pairs of customer and subcategory.  n: scoring customers, below k."""
    c, p = "customer_id", "product_id"
    barrier = F.when(F.col("subcategory") == UNKNOWN, F.concat(F.lit("p:"), F.col(p).cast("string"))).otherwise(
        F.concat(F.lit("s:"), F.col("subcategory"))).alias("barrier")
    few = (wanted.join(scoring.groupBy(p).agg(F.count("*").alias("n")), p, "left").filter(F.coalesce("n", F.lit(0)) < k)
           .join(active_products(pm).select(p, "subcategory"), p).select(p, barrier))
    few = cut(few)
    barred = cut(sales.select(c, barrier).distinct().join(few.select("barrier").distinct(), "barrier", "left_semi"))
    order = sales.select(c).distinct()
    n = int(sales.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = cut(order.repartitionByRange(n, c).withColumn("_part", F.spark_partition_id()))
    ahead = order.groupBy("_part").agg(F.count("*").alias("_n")).withColumn(      # one row per partition
        "_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = order.join(F.broadcast(ahead.drop("_n")), "_part").withColumn(
        "place", F.col("_ahead") + F.row_number().over(Window.partitionBy("_part").orderBy(c)))
    reach = few.select("barrier").distinct().join(barred.groupBy("barrier").agg(F.count("*").alias("e")), "barrier", "left").select(
        "barrier", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(2 * k) + F.coalesce("e", F.lit(0)))).alias("place"))
    free = reach.join(order.select(c, "place"), "place").join(barred, [c, "barrier"], "left_anti")
    from ledgerflow.operators.catalog import top_k_per
    free = top_k_per(free, ["barrier"], [F.col("place")], 2 * k, "_r").select("barrier", c)
    pairs = free.join(few, "barrier").select(c, p).join(scoring.select(c, p), [c, p], "left_anti")
    return _scored_pairs(pairs, sales, pm).select(*SCORES)


def recommend_products(tx: DataFrame, pm: DataFrame, k: int = 7, trim: bool = True,
                       sales: DataFrame | None = None) -> DataFrame:
    """M26 (+ W9): per customer the best product of each unbought subcategory, then the top
    k of those by final score (ties by product id), with rank and rounded scores.  A
    customer with fewer than k scoring subcategories gets those that score 0 as well."""
    sales = scoring_sales(tx, pm, trim) if sales is None else sales
    from ledgerflow.operators.catalog import top_k_per
    order = [F.col("rank_score").desc(), F.col("product_id")]
    search = _scoring(sales, pm)
    scoring = search.products_for_customers(k).select(*SCORES)
    if not search.hot.isEmpty():
        best = best_per_subcategory(_scored_candidates(sales, pm, search.hot)).filter(F.col("rank_score") > 0)
        scoring = scoring.unionByName(best.select(*SCORES))
    scoring = cut(scoring)
    everyone = search.who.select("customer_id").union(search.hot)
    top = top_k_per(scoring.unionByName(_zero_scores(scoring, everyone, sales, pm, k)), ["customer_id"], order, k)
    return top.select("customer_id", F.col("product_id").alias("recommended_product_id"), "rank",
                      F.round("base_similarity", 4).alias("similarity_score"),
                      F.round("price_match", 4).alias("price_match_score"),
                      F.round(F.col("base_similarity") * F.col("price_match"), 4).alias("final_score"), "subcategory")


def best_per_subcategory(scored: DataFrame) -> DataFrame:
    """The best product of each (customer, subcategory) by rank score, ties by product id."""
    from ledgerflow.operators.catalog import top_k_per

    return top_k_per(scored, ["customer_id", "subcategory"], [F.col("rank_score").desc(), F.col("product_id")], 1, "_r").drop("_r")


def recommend_customers(tx: DataFrame, pm: DataFrame, k: int = 7, trim: bool = True,
                        sales: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Per sold product the top k customers who bought neither it nor its subcategory, by
    the same score (ties by customer id), customers who score 0 included.  ``wanted`` (product_id)
    leaves out other products."""
    sales = scoring_sales(tx, pm, trim) if sales is None else sales
    sold = sales.select("product_id").distinct()
    sold = cut(sold if wanted is None else sold.join(wanted, "product_id", "left_semi"))
    from ledgerflow.operators.catalog import top_k_per
    order = [F.col("rank_score").desc(), F.col("customer_id")]
    search = _scoring(sales, pm)
    scoring = search.customers_for_products(sold, k).join(search.stock.select("product_id", "subcategory"), "product_id")
    if not search.hot.isEmpty():
        hot = _scored_candidates(sales, pm, search.hot).join(sold, "product_id", "left_semi").filter(F.col("rank_score") > 0)
        scoring = scoring.select(*SCORES).unionByName(hot.select(*SCORES))
    scoring = cut(top_k_per(scoring.select(*SCORES), ["product_id"], order, k, "_r").drop("_r"))
    top = top_k_per(scoring.unionByName(_zero_customers(scoring, sales, sold, pm, k)), ["product_id"], order, k)
    return top.select("product_id", F.col("customer_id").alias("recommended_customer_id"), "rank",
                      F.round("base_similarity", 4).alias("similarity_score"),
                      F.round("price_match", 4).alias("price_match_score"),
                      F.round(F.col("base_similarity") * F.col("price_match"), 4).alias("final_score"))


def enrich_recs(recs: DataFrame, pm: DataFrame, tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recommendations with product attributes and average unit price; and match
    statistics (count, mean and sample std of the final score, mean price match)."""
    p = active_products(pm)
    prices = product_prices(priced_sales(tx, pm))
    r = (recs.join(p, recs.recommended_product_id == p.product_id, "left").drop(p.subcategory).drop("product_id")
         .join(prices.withColumnRenamed("product_id", "recommended_product_id"), "recommended_product_id", "left")
         .withColumn("avg_price", _r(F.col("product_price"))).drop("product_price"))
    stats = recs.agg(F.count("*").alias("recommendations"), F.count_distinct("customer_id").alias("customers"),
                     _r(F.avg("final_score")).alias("avg_final_score"),
                     _r(F.stddev_samp("final_score")).alias("std_final_score"),
                     _r(F.avg("price_match_score")).alias("avg_price_match"))
    return r, stats
