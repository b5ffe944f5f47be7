"""Most similar products of each product (M24), without scoring all pairs.

The similarity counts equal attributes (category, subcategory, specification, process type)
and, inside one category, price closeness.  Take the set M of attributes that a product and
a neighbour share: among the products that share M with it, k others that are at least as
near in price (M with the category) or have smaller ids (M without) score at least as much.
So for each set of attributes it is enough to look, in the block of products with the same
values, at the k nearest prices and at the k smallest ids; the union of these candidates
over the 16 sets holds the exact k best.

The sets are taken in rounds of falling bound: who shares exactly M scores at most
(size of M + 1) / 5, one less without the category.  A product whose k-th neighbour is
above the bound of the next round is done; the others alone go on.

Blocks are swept in price order through distributed positions: the distinct prices of a
block are cut into chunks that hold k more positions at either end, so a block of any size
is spread over many tasks, and a price shared by many products carries its k + 1 smallest
ids only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.operators.prefix import exclusive_sums
from ledgerflow.session import cut, lookup

ATTRS = ("category", "subcategory", "specification", "process_type")
PRICE_DIGITS, RANK_DIGITS = 6, 9
SWEEP = 1024   # positions of a chunk


def _smallest(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k smallest product ids per ``by`` as an array."""
    w = Window.partitionBy(*by).orderBy("product_id")
    few = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return few.groupBy(*by).agg(F.array_sort(F.collect_list("product_id")).alias("ids"))


def _bound(s: tuple[str, ...]) -> int:
    """Five times the largest similarity of two products that share exactly ``s``."""
    return len(s) + ("category" in s)


def rounds() -> list[tuple[int, list[tuple[str, ...]]]]:
    """(largest bound, sets of attributes) of each round: bounds 5 and 4, 3, 2, 1 and 0."""
    sets = [s for n in range(len(ATTRS) + 1) for s in combinations(ATTRS, n)]
    return [(hi, [s for s in sets if lo <= _bound(s) <= hi]) for hi, lo in ((5, 4), (3, 3), (2, 2), (1, 0))]


def _near(placed: DataFrame, k: int) -> DataFrame:
    """Per (block, price): the ids at the k nearest prices, with those as near as the last of them."""
    home, at = F.floor(F.col("pos") / SWEEP), F.col("pos") % SWEEP
    chunks = F.array_compact(F.array(home, F.when(at < k, home - 1), F.when(at >= SWEEP - k, home + 1)))
    around = Window.partitionBy("block", "chunk").orderBy("pos").rowsBetween(-k, k)
    seen = (placed.select("block", "price", "ids", "pos", F.explode(chunks).alias("chunk"))
            .withColumn("entries", F.collect_list(F.struct(F.col("price").alias("p"), F.col("ids").alias("o"))).over(around))
            .filter(F.col("chunk") == home))

    def side(keep) -> Column:
        """The first k + 1 ids of one side by exact distance, then id."""
        some = F.filter("entries", lambda e: keep(e["p"]))
        every = F.flatten(F.transform(some, lambda e: F.transform(e["o"], lambda i: F.struct(F.abs(e["p"] - F.col("price")).alias("d"), i.alias("o")))))
        return F.slice(F.array_sort(every), 1, k + 1)

    both = F.concat(side(lambda p: p < F.col("price")), side(lambda p: p >= F.col("price")))
    seen = seen.select("block", "price", F.transform(both, lambda x: F.struct(F.round(x["d"], PRICE_DIGITS).alias("d"), x["o"].alias("o"))).alias("both"))
    seen = seen.withColumn("last", F.get(F.sort_array(F.transform("both", lambda x: x["d"])), F.lit(k)))
    return seen.select("block", "price", F.transform(F.filter("both", lambda x: F.col("last").isNull() | (x["d"] <= F.col("last"))), lambda x: x["o"]).alias("ids"))


def candidates(products: DataFrame, k: int, sets: list[tuple[str, ...]], asking: DataFrame | None = None) -> DataFrame:
    """product_id and ids, distinct: who may be among the k best neighbours that share exactly one of ``sets``.

    ``products``: product_id, the attributes (not null) and price (null without one).
    ``asking`` (product_id) leaves out the other products' candidates."""
    block = F.array(*[F.struct(F.concat_ws("\u001f", F.lit(",".join(str(ATTRS.index(a)) for a in s)), *s).alias("block"), F.lit("category" in s).alias("priced"))
                      for s in sets])
    rows = products.select("product_id", "price", F.explode(block).alias("b")).select("product_id", "price", "b.block", "b.priced")
    if asking is not None:
        mine = rows.join(asking, "product_id", "left_semi")
        rows = rows.join(mine.select("block").distinct(), "block", "left_semi")
    rows = cut(rows)
    mine = rows if asking is None else cut(rows.join(asking, "product_id", "left_semi"))

    # by id: blocks without the category, products without a price, and rivals without one
    first = cut(_smallest(rows.filter("not priced"), ["block"], k + 1).unionByName(_smallest(rows.filter("priced and price is null"), ["block"], k + 1)))
    pairs = lookup(mine.select("product_id", "block"), first, ["block"]).select("product_id", "ids")
    plain = cut(mine.filter("priced and price is null").select("product_id", "block"))
    every = cut(_smallest(rows.filter("priced").join(plain.select("block").distinct(), "block", "left_semi"), ["block"], k + 1))
    unpriced = lookup(plain, every, ["block"]).select("product_id", "ids")

    # by price: distinct prices of a block, their positions, and k positions on either side
    with_price = rows.filter("priced and price is not null")
    groups = _smallest(with_price, ["block", "price"], k + 1).withColumn("_one", F.lit(1).cast("long"))
    near = _near(exclusive_sums(groups, ["block"], ["price"], {"pos": "_one"}), k)
    priced = mine.filter("priced and price is not null").select("product_id", "block", "price").join(near, ["block", "price"]).select("product_id", "ids")
    found = pairs.union(unpriced).union(priced)
    return found.groupBy("product_id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))


def nearest_products(products: DataFrame, prices: DataFrame, cat: DataFrame, k: int = 7) -> DataFrame:
    """The k most similar products of each product: rank, similarity and price similarity.
    Order: similarity, then nearer price (same category), then product id."""
    from ledgerflow.operators.recommend import priced_products, similar

    prices = prices.select("product_id", F.round("product_price", PRICE_DIGITS).alias("product_price"))
    products = cut(priced_products(products, prices, cat))
    distance = F.when(F.col("same_category") == 1, F.round(F.abs(F.col("price_a") - F.col("price_b")), PRICE_DIGITS)).alias("distance")
    order = [F.desc("similarity"), F.col("distance").asc_nulls_last(), F.col("product_id_b")]
    best, asking = None, None
    steps = rounds()
    for (_, sets), (bound, _) in zip(steps, [*steps[1:], (-1, [])], strict=True):
        found = candidates(products, k, sets, asking)
        # the lists and what is known of their product lie together; the pairs move to the other product and back
        pairs = found.join(products, "product_id").select(
            *[F.col(c).alias(f"{c}_a") for c in products.columns], F.explode("ids").alias("product_id_b")).filter("product_id_a <> product_id_b")
        scored = similar(pairs, products, RANK_DIGITS, distance).select("product_id_a", "product_id_b", "similarity", "price_similarity", "distance")
        if best is not None:
            scored = scored.unionByName(best.join(asking.withColumnRenamed("product_id", "product_id_a"), "product_id_a", "left_semi").drop("rank")).distinct()
            best = best.join(asking.withColumnRenamed("product_id", "product_id_a"), "product_id_a", "left_anti")
        place = Window.partitionBy("product_id_a").orderBy(*order)
        new = scored.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        best = cut(new if best is None else best.unionByName(new))
        if bound < 0:
            break
        done = best.filter((F.col("rank") == k) & (F.col("similarity") > bound / 5.0)).select(F.col("product_id_a").alias("product_id"))
        asking = products.select("product_id").join(done, "product_id", "left_anti")
        asking = cut(asking)
        if asking.isEmpty():
            break
    return best.select("product_id_a", "rank", "product_id_b", "similarity", "price_similarity")
