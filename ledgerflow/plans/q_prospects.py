"""Registered prospect-search queries (SRC3–SRC5, C8–C13, A32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.constants import TEST_KEYWORDS
from ledgerflow.operators import prospects as pr
from ledgerflow.operators import recommend as rc
from ledgerflow.plans.registry import query
from ledgerflow.sources.views import Views, osql

TARGET = 7

_FILEKEY = """
fk AS (SELECT *, len(parts) AS np, array_to_string(parts[5:], '_') AS tail FROM (
         SELECT *, string_split(regexp_replace(file_name, '\\.[^.]*$', ''), '_') AS parts FROM chat_messages)),
fk2 AS (SELECT *, instr(tail, '(') AS lp, instr(tail, ')') AS rp FROM fk),
fk3 AS (SELECT *, CASE WHEN lp > 0 AND rp > 0 THEN substr(tail, lp + 1, greatest(rp - lp - 1, 0)) END AS ident,
               CASE WHEN np >= 5 THEN (CASE WHEN lp > 0 AND rp > 0 THEN trim(substr(tail, 1, lp - 1)) ELSE tail END)
                    WHEN np = 4 THEN parts[-1] WHEN np >= 2 THEN parts[2] ELSE 'Unknown' END AS nm0 FROM fk2),
msgs_all AS (SELECT conv_id, row_no, file_name, batch, batch_time, message_date, sender_type, customer_id, content,
                    CASE WHEN nm0 IS NULL OR nm0 = '' THEN 'Unknown' ELSE nm0 END AS file_customer_name,
                    CASE WHEN np >= 5 AND ident <> '' AND ident <> 'Unknown' THEN ident END AS file_customer_id FROM fk3),
msgs AS (SELECT * REPLACE (trim(content) AS content) FROM msgs_all
         WHERE lower(trim(sender_type)) = 'user' AND length(trim(content)) >= 2)"""

_MATCH = _FILEKEY + """,
hits AS (SELECT m.*, k.keyword, instr(lower(m.content), lower(k.keyword)) - 1 AS position, 'exact' AS match_type, CAST(1.0 AS DOUBLE) AS score
         FROM msgs m JOIN keywords k ON instr(lower(m.content), lower(k.keyword)) > 0),
sibs AS (SELECT product_id FROM product_master WHERE subcategory IN (SELECT subcategory FROM product_master WHERE product_id = 7)),
buyers AS (SELECT DISTINCT customer_id FROM order_tx WHERE product_id IN (SELECT product_id FROM sibs)),
cls AS (SELECT h.*, CASE WHEN h.customer_id IS NULL THEN 'cannot_process'
                         WHEN h.customer_id IN (SELECT customer_id FROM buyers) THEN 'purchased' ELSE 'can_process' END
                    AS prospect_class FROM hits h),
keyed AS (SELECT *, COALESCE(CAST(customer_id AS VARCHAR), 'name:' || file_customer_name) AS prospect_key FROM cls),
cagg AS (SELECT prospect_key, MAX(CASE prospect_class WHEN 'purchased' THEN 3 WHEN 'can_process' THEN 2
                                                      WHEN 'cannot_process' THEN 1 ELSE 0 END) AS p,
                MAX(customer_id) AS customer_id,
                arg_min_null(file_customer_name, (message_date, file_name, row_no)) AS customer_name,
                MAX(message_date) AS latest_date, COUNT(*) AS hit_count FROM keyed GROUP BY 1),
ctext AS (SELECT prospect_key, CASE WHEN length(w) > 500 THEN substr(w, 1, 500) || '...' ELSE w END AS texts FROM (
          SELECT prospect_key, string_agg(content, '\n' ORDER BY o, content) AS w FROM (
            SELECT *, row_number() OVER (PARTITION BY prospect_key ORDER BY o, content) AS r FROM (
              SELECT prospect_key, content, MIN((message_date, file_name, row_no)) AS o FROM keyed GROUP BY 1, 2))
          WHERE r <= 5 GROUP BY 1)),
cons AS (SELECT a.prospect_key, a.customer_id, a.customer_name, a.latest_date, a.hit_count, t.texts,
                CASE a.p WHEN 3 THEN 'purchased' WHEN 2 THEN 'can_process' WHEN 1 THEN 'cannot_process' ELSE 'potential' END
                  AS prospect_class
         FROM cagg a JOIN ctext t ON a.prospect_key = t.prospect_key)"""


def _msgs(v):
    return pr.user_messages(pr.with_file_key(v.chat_messages))


def _classified(v):
    m = pr.search_messages(_msgs(v), v.keywords())
    return pr.classify_prospects(m, v.order_tx(), v.product_master, TARGET)


@query("SRC3", osql("SELECT conv_id, row_no, content FROM msgs", ctes=_FILEKEY))
def src3_user_messages(spark, sf_dir):
    """SRC3: customer-side text messages of every chat."""
    return _msgs(Views(spark, sf_dir)).select("conv_id", "row_no", "content")


@query("SRC4", osql("SELECT DISTINCT file_name, file_customer_name, file_customer_id FROM msgs_all", ctes=_FILEKEY))
def src4_file_keys(spark, sf_dir):
    """SRC4: customer name / id parsed from every chat file name."""
    m = pr.with_file_key(Views(spark, sf_dir).chat_messages)
    return m.select("file_name", "file_customer_name", "file_customer_id").distinct()


@query("SRC5", osql("""
SELECT conv_id, row_no, batch FROM msgs_all WHERE batch = (SELECT arg_max(batch, (batch_time, batch)) FROM msgs_all)""",
    ctes=_FILEKEY))
def src5_latest_batch(spark, sf_dir):
    """SRC5: messages of the newest batch only."""
    return pr.latest_batch(Views(spark, sf_dir).chat_messages).select("conv_id", "row_no", "batch")


@query("C8", osql("SELECT conv_id, row_no, customer_id, keyword, position, match_type, score FROM hits", ctes=_MATCH))
def c8_search_messages(spark, sf_dir):
    """Keyword hits in customer messages."""
    v = Views(spark, sf_dir)
    return pr.search_messages(_msgs(v), v.keywords()).select(
        "conv_id", "row_no", "customer_id", "keyword", "position", "match_type", "score")


@query("C9", osql("SELECT conv_id, row_no, keyword, customer_id, prospect_class FROM cls", ctes=_MATCH))
def c9_classify(spark, sf_dir):
    """Hits classified for product 7 (no id / purchased the subcategory / can process)."""
    return _classified(Views(spark, sf_dir)).select("conv_id", "row_no", "keyword", "customer_id", "prospect_class")


@query("C9_counts", osql("SELECT prospect_class, COUNT(*) AS count FROM cls GROUP BY 1", ctes=_MATCH))
def c9_counts(spark, sf_dir):
    """Hit counts per class."""
    return pr.class_counts(_classified(Views(spark, sf_dir)))


@query("C10", osql("""
SELECT prospect_key, customer_id, customer_name, CAST(latest_date AS VARCHAR) AS latest_date, hit_count, texts,
       prospect_class FROM cons""", ctes=_MATCH))
def c10_consolidate(spark, sf_dir):
    """One row per prospect with class, latest date, hits and first texts."""
    return pr.consolidate(_classified(Views(spark, sf_dir))).select(
        "prospect_key", "customer_id", "customer_name", "latest_date", "hit_count", "texts", "prospect_class")


@query("C10_texts", osql("""
SELECT prospect_key, content, CAST(o[1] AS VARCHAR) AS message_date, o[2] AS file_name, o[3] AS row_no, hits FROM (
  SELECT prospect_key, content, MIN((message_date, file_name, row_no)) AS o, COUNT(*) AS hits FROM keyed GROUP BY 1, 2)""",
    ctes=_MATCH))
def c10_texts(spark, sf_dir):
    """Every distinct text of every prospect, whole."""
    return pr.prospect_texts(_classified(Views(spark, sf_dir)))


def _recs_for_target(v):
    return rc.recommend_customers(v.order_tx(), v.product_master,
                                  wanted=v.product_master.filter(F.col("product_id") == TARGET).select("product_id"))


def _c11_sql():
    from ledgerflow.plans.q_recommend import REC_CTES
    return osql("""
SELECT prospect_key, customer_id, customer_name, CAST(latest_date AS VARCHAR) AS latest_date, hit_count, texts, prospect_class
FROM cons
UNION ALL
SELECT CAST(r.customer_id AS VARCHAR), r.customer_id, c.customer_name, NULL, 0, NULL, 'potential'
FROM (SELECT DISTINCT customer_id FROM recc WHERE product_id = 7 AND rank BETWEEN 1 AND 7) r
LEFT JOIN customers c ON r.customer_id = c.customer_id
WHERE r.customer_id NOT IN (SELECT customer_id FROM cons WHERE customer_id IS NOT NULL)""",
                ctes=_MATCH.strip().rstrip(",") + ",\n" + REC_CTES.strip())


@query("C11", _c11_sql())
def c11_add_recommended(spark, sf_dir):
    """C11: consolidated prospects plus recommended customers of product 7 as potential."""
    v = Views(spark, sf_dir)
    cons = pr.consolidate(_classified(v))
    return pr.add_recommended(cons, _recs_for_target(v), v.customers).select(
        "prospect_key", "customer_id", "customer_name", "latest_date", "hit_count", "texts", "prospect_class")


@query("C12", osql("""
SELECT COUNT(*) AS total, count_if(prospect_class = 'purchased') AS purchased,
       count_if(prospect_class = 'can_process') AS can_process, count_if(prospect_class = 'cannot_process') AS cannot_process,
       count_if(prospect_class = 'potential') AS potential FROM cons""", ctes=_MATCH))
def c12_summary(spark, sf_dir):
    """Prospect counts by class."""
    return pr.prospect_summary(pr.consolidate(_classified(Views(spark, sf_dir))))


_RUNS = _FILEKEY + f""",
kwp AS (SELECT DISTINCT product_id, keyword FROM (
          SELECT product_id, unnest(list_distinct([{", ".join(f"'{w}'" for w in TEST_KEYWORDS)},
              trim(regexp_replace(regexp_replace(name_zh, '[\\(（\\[【][^\\)）\\]】]*[\\)）\\]】]', '', 'g'), '[-_/]+', ' ', 'g'))]))
                 AS keyword
          FROM product_master)),
rh AS (SELECT k.product_id, m.customer_id FROM msgs m JOIN kwp k ON instr(lower(m.content), lower(k.keyword)) > 0),
rsub AS (SELECT DISTINCT k.product_id, pm.subcategory FROM kwp k JOIN product_master pm ON k.product_id = pm.product_id),
rbuy AS (SELECT DISTINCT r.product_id, t.customer_id FROM rsub r JOIN product_master pm ON pm.subcategory = r.subcategory
         JOIN order_tx t ON t.product_id = pm.product_id)"""


@query("C13", osql("""
SELECT n.product_id, n.keywords, COALESCE(p.matches, 0) AS matches, COALESCE(p.customers, 0) AS customers,
       COALESCE(p.purchased_customers, 0) AS purchased_customers
FROM (SELECT product_id, COUNT(*) AS keywords FROM kwp GROUP BY 1) n
LEFT JOIN (SELECT h.product_id, COUNT(*) AS matches, COUNT(DISTINCT h.customer_id) AS customers,
                  COUNT(DISTINCT CASE WHEN b.customer_id IS NOT NULL THEN h.customer_id END) AS purchased_customers
           FROM rh h LEFT JOIN rbuy b ON h.product_id = b.product_id AND h.customer_id = b.customer_id GROUP BY 1) p
  ON n.product_id = p.product_id""", ctes=_RUNS))
def c13_search_runs(spark, sf_dir):
    """One search run for every product (fixed words + the product's core name)."""
    v = Views(spark, sf_dir)
    kw = pr.keywords_for_products(v.product_master, TEST_KEYWORDS)
    return pr.search_runs(_msgs(v), kw, v.order_tx(), v.product_master)


@query("A32", osql("SELECT keyword, COUNT(*) AS hits, COUNT(DISTINCT customer_id) AS customers FROM hits GROUP BY 1",
                   ctes=_MATCH))
def a32_keyword_stats(spark, sf_dir):
    """Hits per keyword."""
    v = Views(spark, sf_dir)
    return pr.keyword_stats(pr.search_messages(_msgs(v), v.keywords()))


@query("A32_top", osql("""
SELECT prospect_class, customer_id, hits, rank FROM (
  SELECT prospect_class, customer_id, hits,
         row_number() OVER (PARTITION BY prospect_class ORDER BY hits DESC, customer_id) AS rank
  FROM (SELECT prospect_class, customer_id, COUNT(*) AS hits FROM cls WHERE customer_id IS NOT NULL GROUP BY 1, 2))
WHERE rank <= CASE prospect_class WHEN 'purchased' THEN 20 WHEN 'can_process' THEN 10 ELSE 10 END""", ctes=_MATCH))
def a32_top_customers(spark, sf_dir):
    """Top-20 purchased / top-10 other customers by hits."""
    return pr.top_customers_per_class(_classified(Views(spark, sf_dir)), {"purchased": 20, "can_process": 10})
