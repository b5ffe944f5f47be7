"""Registered recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import recommend as rc
from ledgerflow.plans.registry import query
from ledgerflow.sources.views import Views, osql


def _attr(c):
    return f"CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) IN ('', 'None') THEN 'unknown' ELSE CAST({c} AS VARCHAR) END"


REC_CTES = f"""
ap AS (SELECT product_id, {_attr('category')} AS category, {_attr('subcategory')} AS subcategory,
              {_attr('specification')} AS specification, {_attr('process_type')} AS process_type
       FROM product_master WHERE is_active = 'active'),
sales AS (SELECT t.customer_id, t.product_id, ap.category, ap.subcategory, ap.specification, ap.process_type,
                 CAST(t.amount AS DOUBLE) / CAST(t.quantity AS DOUBLE) AS unit_price
          FROM order_tx t JOIN ap ON t.product_id = ap.product_id
          WHERE t.quantity > 0 AND t.customer_id IS NOT NULL AND t.amount IS NOT NULL),
qb AS (SELECT quantile_cont(unit_price, 0.05) AS lo, quantile_cont(unit_price, 0.95) AS hi FROM sales),
ts AS (SELECT s.* FROM sales s, qb WHERE s.unit_price >= qb.lo AND s.unit_price <= qb.hi),
cat AS (SELECT category, AVG(unit_price) AS cat_mean, stddev_samp(unit_price) AS cat_std, MIN(unit_price) AS cat_min,
               MAX(unit_price) AS cat_max, COUNT(*) AS cat_count FROM ts GROUP BY 1),
prof AS (SELECT g.*, CASE WHEN c.cat_std > 0 THEN (g.avg_price - c.cat_mean) / c.cat_std END AS z_score
         FROM (SELECT customer_id, category, AVG(unit_price) AS avg_price, stddev_samp(unit_price) AS price_std,
                      COUNT(*) AS purchase_count FROM ts GROUP BY 1, 2 HAVING COUNT(*) >= 2) g
         JOIN cat c ON g.category = c.category),
prices AS (SELECT product_id, AVG(unit_price) AS product_price FROM ts GROUP BY 1),
bought AS (SELECT b.customer_id, ap.* FROM (SELECT DISTINCT customer_id, product_id FROM ts) b
           JOIN ap ON b.product_id = ap.product_id),
nb AS (SELECT customer_id, COUNT(*) AS n_bought FROM bought GROUP BY 1),
n_cat AS (SELECT customer_id, category, COUNT(*) AS n FROM bought GROUP BY 1, 2),
n_sub AS (SELECT customer_id, subcategory, COUNT(*) AS n FROM bought GROUP BY 1, 2),
n_spec AS (SELECT customer_id, specification, COUNT(*) AS n FROM bought GROUP BY 1, 2),
n_proc AS (SELECT customer_id, process_type, COUNT(*) AS n FROM bought GROUP BY 1, 2),
cand0 AS (SELECT DISTINCT customer_id, product_id FROM (
            SELECT n.customer_id, ap.product_id FROM n_cat n JOIN ap ON n.category = ap.category
            UNION ALL SELECT n.customer_id, ap.product_id FROM n_spec n JOIN ap ON n.specification = ap.specification
            UNION ALL SELECT n.customer_id, ap.product_id FROM n_proc n JOIN ap ON n.process_type = ap.process_type
            UNION ALL SELECT n.customer_id, ap.product_id FROM n_sub n JOIN ap ON n.subcategory = ap.subcategory AND ap.subcategory = 'unknown')),
cand AS (SELECT c.customer_id, ap.* FROM cand0 c JOIN ap ON c.product_id = ap.product_id
         WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = c.customer_id AND b.product_id = c.product_id)
           AND NOT EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = c.customer_id AND b.subcategory = ap.subcategory
                                                    AND b.subcategory <> 'unknown')),
bp AS (SELECT b.customer_id, b.category, p.product_price AS bought_price, COUNT(*) AS m
       FROM bought b LEFT JOIN prices p ON b.product_id = p.product_id GROUP BY 1, 2, 3),
ps AS (SELECT c.customer_id, c.product_id,
              SUM(bp.m * CASE WHEN p.product_price IS NULL OR bp.bought_price IS NULL THEN 0.5
                              WHEN k.cat_std > 0 THEN exp(-0.5 * pow(abs(p.product_price - bp.bought_price) / k.cat_std, 2))
                              WHEN abs(p.product_price - bp.bought_price) = 0 THEN 1.0 ELSE 0.5 END) AS ps
       FROM cand c LEFT JOIN prices p ON c.product_id = p.product_id
       JOIN bp ON bp.customer_id = c.customer_id AND bp.category = c.category
       LEFT JOIN cat k ON k.category = c.category GROUP BY 1, 2),
scored AS (
  SELECT c.customer_id, c.product_id, c.subcategory,
         (COALESCE(a.n, 0) + COALESCE(b.n, 0) + COALESCE(d.n, 0) + COALESCE(e.n, 0) + COALESCE(ps.ps, 0.0))
           / (5.0 * nb.n_bought) AS base_similarity,
         CASE WHEN p.product_price IS NULL OR pr.avg_price IS NULL THEN 0.5
              WHEN k.cat_std > 0 THEN exp(-0.5 * pow(abs(p.product_price - pr.avg_price) / k.cat_std, 2))
              WHEN abs(p.product_price - pr.avg_price) = 0 THEN 1.0 ELSE 0.5 END AS price_match
  FROM cand c JOIN nb ON c.customer_id = nb.customer_id
  LEFT JOIN n_cat a ON a.customer_id = c.customer_id AND a.category = c.category
  LEFT JOIN n_sub b ON b.customer_id = c.customer_id AND b.subcategory = c.subcategory
  LEFT JOIN n_spec d ON d.customer_id = c.customer_id AND d.specification = c.specification
  LEFT JOIN n_proc e ON e.customer_id = c.customer_id AND e.process_type = c.process_type
  LEFT JOIN ps ON ps.customer_id = c.customer_id AND ps.product_id = c.product_id
  LEFT JOIN prices p ON p.product_id = c.product_id
  LEFT JOIN prof pr ON pr.customer_id = c.customer_id AND pr.category = c.category
  LEFT JOIN cat k ON k.category = c.category),
scored2 AS (SELECT *, base_similarity * price_match AS final_score,
                   round(base_similarity * price_match, 10) AS rank_score FROM scored
            WHERE round(base_similarity * price_match, 10) > 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, subcategory
                                                     ORDER BY rank_score DESC, product_id) AS r1 FROM scored2) WHERE r1 = 1),
zeros AS (SELECT n.customer_id, r.product_id, r.subcategory, COALESCE(s.base_similarity, 0.0::DOUBLE) AS base_similarity,
                 COALESCE(s.price_match, 0.5::DOUBLE) AS price_match,
                 COALESCE(s.base_similarity * s.price_match, 0.0::DOUBLE) AS final_score, 0.0::DOUBLE AS rank_score
          FROM nb n CROSS JOIN (SELECT subcategory, MIN(product_id) AS product_id FROM ap GROUP BY 1) r
          LEFT JOIN scored s ON s.customer_id = n.customer_id AND s.product_id = r.product_id
          WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = n.customer_id AND b.subcategory = r.subcategory)
            AND NOT EXISTS (SELECT 1 FROM best x WHERE x.customer_id = n.customer_id AND x.subcategory = r.subcategory)),
recp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY rank_score DESC, product_id) AS rank
                        FROM (SELECT * EXCLUDE (r1) FROM best UNION ALL SELECT * FROM zeros)) WHERE rank <= 7),
every AS (SELECT n.customer_id, r.product_id, COALESCE(s.base_similarity, 0.0::DOUBLE) AS base_similarity,
                 COALESCE(s.price_match, 0.5::DOUBLE) AS price_match, COALESCE(s.base_similarity * s.price_match, 0.0::DOUBLE) AS final_score,
                 COALESCE(round(s.base_similarity * s.price_match, 10), 0.0::DOUBLE) AS rank_score
          FROM nb n CROSS JOIN (SELECT DISTINCT product_id, subcategory FROM ts) r
          LEFT JOIN scored s ON s.customer_id = n.customer_id AND s.product_id = r.product_id
          WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.customer_id = n.customer_id
                            AND (b.product_id = r.product_id OR (b.subcategory = r.subcategory AND b.subcategory <> 'unknown')))),
recc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY rank_score DESC, customer_id) AS rank
                        FROM every) WHERE rank <= 7)"""


def _sales(v, trim=True):
    if trim:
        return rc.scoring_sales(v.order_tx(), v.product_master)
    return rc.priced_sales(v.order_tx(), v.product_master)


@query("A18", osql("SELECT round(lo, 6) AS q05, round(hi, 6) AS q95, (SELECT COUNT(*) FROM ts) AS kept_rows, "
                   "(SELECT COUNT(*) FROM sales) AS input_rows FROM qb", ctes=REC_CTES))
def a18_trim_prices(spark, sf_dir):
    """Global 5 % / 95 % unit-price bounds (exact) and the rows kept between them."""
    v = Views(spark, sf_dir)
    s = _sales(v, trim=False)
    q = rc.exact_quantiles(s, "unit_price", [0.05, 0.95])
    kept = rc.trim_prices(s).agg(F.count("*")).scalar()
    inp = s.agg(F.count("*")).scalar()
    return q.select(F.round("q0", 6).alias("q05"), F.round("q1", 6).alias("q95"), kept.alias("kept_rows"),
                    inp.alias("input_rows"))


@query("A17", osql("""
SELECT customer_id, category, round(avg_price, 9) AS avg_price, round(price_std, 9) AS price_std, purchase_count,
       round(z_score, 9) AS z_score,
       CASE WHEN z_score IS NULL THEN 'low' WHEN z_score > 1 THEN 'high' WHEN z_score > -1 THEN 'medium' ELSE 'low' END
         AS price_level
FROM prof""", ctes=REC_CTES))
def a17_price_profiles(spark, sf_dir):
    """Customer × category price profiles with z-score level."""
    p = rc.price_profiles(_sales(Views(spark, sf_dir)))
    return p.select("customer_id", "category", F.round("avg_price", 9).alias("avg_price"),
                    F.round("price_std", 9).alias("price_std"), "purchase_count", F.round("z_score", 9).alias("z_score"),
                    "price_level")


@query("A17_category", osql("""
SELECT category, round(cat_mean, 6) AS cat_mean, round(cat_std, 6) AS cat_std, round(cat_min, 6) AS cat_min,
       round(cat_max, 6) AS cat_max, cat_count FROM cat""", ctes=REC_CTES))
def a17_category_stats(spark, sf_dir):
    """Category unit-price statistics."""
    c = rc.category_price_stats(_sales(Views(spark, sf_dir)))
    return c.select("category", *[F.round(x, 6).alias(x) for x in ("cat_mean", "cat_std", "cat_min", "cat_max")],
                    "cat_count")


@query("M24", osql("""
SELECT x.product_id_a, x.product_id_b,
       CASE WHEN a.category = b.category THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS same_category,
       CASE WHEN a.subcategory = b.subcategory THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS same_subcategory,
       CASE WHEN a.specification = b.specification THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS same_specification,
       CASE WHEN a.process_type = b.process_type THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS same_process,
       round(ps, 6) AS price_similarity,
       round(((CASE WHEN a.category = b.category THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END) + (CASE WHEN a.subcategory = b.subcategory THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)
              + (CASE WHEN a.specification = b.specification THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)
              + (CASE WHEN a.process_type = b.process_type THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END) + ps) / 5.0, 6) AS similarity
FROM (SELECT x.*, CASE WHEN a.category <> b.category THEN 0.0
                       WHEN pa.product_price IS NULL OR pb.product_price IS NULL THEN 0.5
                       WHEN k.cat_std > 0 THEN exp(-0.5 * pow(abs(pa.product_price - pb.product_price) / k.cat_std, 2))
                       WHEN abs(pa.product_price - pb.product_price) = 0 THEN 1.0 ELSE 0.5 END AS ps
      FROM pairs x JOIN ap a ON x.product_id_a = a.product_id JOIN ap b ON x.product_id_b = b.product_id
      LEFT JOIN prices pa ON pa.product_id = x.product_id_a LEFT JOIN prices pb ON pb.product_id = x.product_id_b
      LEFT JOIN cat k ON k.category = a.category) x
JOIN ap a ON x.product_id_a = a.product_id JOIN ap b ON x.product_id_b = b.product_id""", ctes=REC_CTES + """,
lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
pairs AS (SELECT DISTINCT a.l_partkey AS product_id_a, b.l_partkey AS product_id_b
          FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"""))
def m24_product_similarity(spark, sf_dir):
    """5-factor similarity of every pair of products bought in one order."""
    v = Views(spark, sf_dir)
    s = _sales(v)
    pairs = rc.bought_together(v.raw("lineitem"), "l_orderkey", "l_partkey")
    return rc.product_similarity(pairs, rc.active_products(v.product_master), rc.product_prices(s),
                                 rc.category_price_stats(s))


@query("M24_top", osql("""
SELECT product_id_a, rank, product_id_b, similarity, price_similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id_a ORDER BY similarity DESC, distance NULLS LAST, product_id_b) AS rank FROM (
    SELECT product_id_a, product_id_b, round(ps, 9) AS price_similarity, round((same + ps) / 5.0, 9) AS similarity, distance FROM (
      SELECT a.product_id AS product_id_a, b.product_id AS product_id_b,
             (a.category = b.category)::INT + (a.subcategory = b.subcategory)::INT + (a.specification = b.specification)::INT
               + (a.process_type = b.process_type)::INT AS same,
             CASE WHEN a.category = b.category THEN round(abs(pa.p - pb.p), 6) END AS distance,
             CASE WHEN a.category <> b.category THEN 0.0::DOUBLE
                  WHEN pa.p IS NULL OR pb.p IS NULL THEN 0.5::DOUBLE
                  WHEN k.cat_std > 0 THEN exp(-0.5 * pow(abs(pa.p - pb.p) / k.cat_std, 2))
                  WHEN abs(pa.p - pb.p) = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS ps
      FROM ap a JOIN ap b ON a.product_id <> b.product_id
      LEFT JOIN rp pa ON pa.product_id = a.product_id LEFT JOIN rp pb ON pb.product_id = b.product_id
      LEFT JOIN cat k ON k.category = a.category)))
WHERE rank <= 7""", ctes=REC_CTES + """,
rp AS (SELECT product_id, round(product_price, 6) AS p FROM prices)"""))
def m24_nearest_products(spark, sf_dir):
    """The 7 most similar products of every active product."""
    v = Views(spark, sf_dir)
    s = _sales(v)
    from ledgerflow.operators.neighbours import nearest_products

    return nearest_products(rc.active_products(v.product_master), rc.product_prices(s), rc.category_price_stats(s))


@query("M25", osql("""
SELECT o.customer_id, o.product_id,
       round(CASE WHEN p.product_price IS NULL OR pr.avg_price IS NULL THEN 0.5
                  WHEN k.cat_std > 0 THEN exp(-0.5 * pow(abs(p.product_price - pr.avg_price) / k.cat_std, 2))
                  WHEN abs(p.product_price - pr.avg_price) = 0 THEN 1.0 ELSE 0.5 END, 6) AS price_match
FROM (SELECT DISTINCT customer_id, product_id FROM incoming_orders WHERE customer_id IS NOT NULL) o
JOIN ap ON ap.product_id = o.product_id
LEFT JOIN prices p ON p.product_id = o.product_id
LEFT JOIN prof pr ON pr.customer_id = o.customer_id AND pr.category = ap.category
LEFT JOIN cat k ON k.category = ap.category""", ctes=REC_CTES))
def m25_price_match(spark, sf_dir):
    """Price match of every incoming order's (customer, product)."""
    v = Views(spark, sf_dir)
    s = _sales(v)
    cat = rc.category_price_stats(s)
    pairs = v.incoming_orders.filter(F.col("customer_id").isNotNull()).select("customer_id", "product_id").distinct()
    m = rc.price_match(pairs, rc.active_products(v.product_master), rc.product_prices(s), rc.price_profiles(s, cat), cat)
    return m.select("customer_id", "product_id", F.round("price_match", 6).alias("price_match"))


@query("M26", osql("""
SELECT customer_id, product_id AS recommended_product_id, rank, round(base_similarity, 4) AS similarity_score,
       round(price_match, 4) AS price_match_score, round(final_score, 4) AS final_score, subcategory FROM recp""",
    ctes=REC_CTES))
def m26_recommend_products(spark, sf_dir):
    """Top 7 products (best of each unbought subcategory) per customer."""
    v = Views(spark, sf_dir)
    return rc.recommend_products(v.order_tx(), v.product_master)


@query("M27", osql("""
SELECT product_id, customer_id AS recommended_customer_id, rank, round(base_similarity, 4) AS similarity_score,
       round(price_match, 4) AS price_match_score, round(final_score, 4) AS final_score FROM recc""", ctes=REC_CTES))
def m27_recommend_customers(spark, sf_dir):
    """Top 7 prospective customers per product."""
    v = Views(spark, sf_dir)
    return rc.recommend_customers(v.order_tx(), v.product_master)


@query("M28", osql("""
SELECT COUNT(*) AS recommendations, COUNT(DISTINCT customer_id) AS customers,
       round(AVG(round(final_score, 4)), 6) AS avg_final_score, round(stddev_samp(round(final_score, 4)), 6) AS std_final_score,
       round(AVG(round(price_match, 4)), 6) AS avg_price_match FROM recp""", ctes=REC_CTES))
def m28_enrich_stats(spark, sf_dir):
    """Recommendation match statistics."""
    v = Views(spark, sf_dir)
    recs = rc.recommend_products(v.order_tx(), v.product_master)
    return rc.enrich_recs(recs, v.product_master, v.order_tx())[1]


@query("M28_rows", osql("""
SELECT r.customer_id, r.product_id AS recommended_product_id, r.rank, round(r.base_similarity, 4) AS similarity_score,
       round(r.price_match, 4) AS price_match_score, round(r.final_score, 4) AS final_score, r.subcategory,
       a.category, a.specification, a.process_type, round(p.product_price, 6) AS avg_price
FROM recp r LEFT JOIN ap a ON r.product_id = a.product_id
LEFT JOIN (SELECT product_id, AVG(unit_price) AS product_price FROM sales GROUP BY 1) p ON r.product_id = p.product_id""",
    ctes=REC_CTES))
def m28_enrich_rows(spark, sf_dir):
    """Recommendations with product attributes and average price."""
    v = Views(spark, sf_dir)
    recs = rc.recommend_products(v.order_tx(), v.product_master)
    return rc.enrich_recs(recs, v.product_master, v.order_tx())[0]
