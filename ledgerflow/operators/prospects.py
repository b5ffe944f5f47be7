"""Prospect search in chat messages (SRC3–SRC5, C8–C13, A32).

Keywords are found through an index of character trigrams: a message is joined to a
keyword only where it holds the keyword's rarest trigram, and the pair is then checked
with ``instr``.  Each distinct keyword is matched once, however many products search it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerflow.constants import PROSPECT_CAN_PROCESS, PROSPECT_NO_ID, PROSPECT_POTENTIAL, PROSPECT_PURCHASED
from ledgerflow.functions.text import chat_file_key
from ledgerflow.session import cut, lookup

CLASS_PRIORITY = {PROSPECT_PURCHASED: 3, PROSPECT_CAN_PROCESS: 2, PROSPECT_NO_ID: 1, PROSPECT_POTENTIAL: 0}
# FIXED VALUES: the display text of a prospect.
DISPLAY_CHARS = 500
DISPLAY_TEXTS = 5


# ------------------------------------------------------------------------- sources
def read_chats_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC3 (files): every chat CSV under ``path`` → one row per record with file name and
    1-based record number (quoted line breaks belong to their record): sender type, sender
    name, date, time, content.  A file is one conversation and one task."""
    schema = "sender_type string, sender_name string, date_str string, time_str string, content string"
    rows = (spark.read.schema(schema).csv(path, multiLine=True, escape='"')
            .select("*", F.url_decode(F.col("_metadata.file_name")).alias("file_name"),
                    F.col("_metadata.file_path").alias("_path"),
                    F.col("_metadata.file_modification_time").alias("file_time"),
                    F.monotonically_increasing_id().alias("_id")))
    first = rows.groupBy("_path").agg(F.min("_id").alias("_first"))
    parsed = rows.join(first, "_path").withColumn("row_no", (F.col("_id") - F.col("_first") + 1).cast("int"))
    return parsed.filter(F.col("row_no") > 1).select(
        "file_name", "file_time", "row_no", F.trim("sender_type").alias("sender_type"),
        F.trim("sender_name").alias("sender_name"), F.trim("date_str").alias("date_str"),
        F.trim("time_str").alias("time_str"), F.trim("content").alias("content"),
        F.col("content").isNotNull().alias("has_5_fields"))


def user_messages(msgs: DataFrame) -> DataFrame:
    """SRC3: customer-side messages: ≥ 5 fields (when known), sender type 'user' (any
    case) and content of length ≥ 2."""
    m = msgs.filter("has_5_fields") if "has_5_fields" in msgs.columns else msgs
    c = F.trim(F.col("content"))
    return m.filter((F.lower(F.trim("sender_type")) == "user") & (F.length(c) >= 2)).withColumn("content", c)


def with_file_key(msgs: DataFrame) -> DataFrame:
    """SRC4: customer name and id from the file name."""
    name, cid = chat_file_key(F.col("file_name"))
    return msgs.withColumn("file_customer_name", name).withColumn("file_customer_id", cid)


def latest_batch(msgs: DataFrame, batch_col: str = "batch", time_col: str = "batch_time") -> DataFrame:
    """SRC5: rows of the newest batch only (by batch time, ties by batch name)."""
    newest = msgs.agg(F.max_by(batch_col, F.struct(time_col, batch_col)).alias("_b"))
    return msgs.join(F.broadcast(newest), F.col(batch_col) == F.col("_b")).drop("_b")


# ---------------------------------------------------------------------------- search
GRAM = 3           # characters of an indexed piece; a shorter keyword is a piece itself
FEW_GRAMS = 4096   # pieces that are looked up in a set inside the scan; more are joined


def grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters, overlapping, in one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def _gram_rows(texts: DataFrame, col: str, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per text and wanted piece it holds (``gram``)."""
    wanted = cut(wanted.select("gram").distinct())
    found = F.array_distinct(F.flatten(F.array(*[grams(F.col(col), n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    if wanted.count() <= FEW_GRAMS:
        few = [r["gram"] for r in wanted.collect()]      # at most FEW_GRAMS short strings
        return texts.withColumn("gram", F.explode(F.filter(found, lambda g: g.isin(few))))
    return lookup(texts.withColumn("gram", F.explode(found)), wanted, ["gram"])


def keyword_index(texts: DataFrame, col: str, keywords: DataFrame) -> tuple[DataFrame, list[int]]:
    """Each keyword with the piece of it that the fewest texts hold (ties by piece)."""
    low = F.lower(F.col("keyword"))
    pieces = [grams(low, n) for n in (1, 2, GRAM)]
    own = F.when(F.length(low) == 1, pieces[0]).when(F.length(low) == 2, pieces[1]).otherwise(pieces[2])
    kg = cut(keywords.select("keyword", F.explode(own).alias("gram")))
    sizes = [r[0] for r in kg.select(F.length("gram")).distinct().collect()]      # one to three numbers
    held = _gram_rows(texts, col, kg, sizes).groupBy("gram").agg(F.count("*").alias("n"))
    rare = kg.join(held, "gram", "left").groupBy("keyword").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return cut(rare), sizes


def search_messages(msgs: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row per (message, keyword) where the keyword occurs in the message (case
    insensitive), with its 0-based position, match type 'exact' and score 1.0."""
    kw = keywords.select("keyword").filter(F.length(F.trim("keyword")) > 0).distinct()
    texts = msgs.withColumn("_low", F.lower(F.col("content")))
    index, sizes = keyword_index(texts.select("_low"), "_low", kw)
    pos = F.instr(F.col("_low"), F.lower(F.col("keyword")))
    if index.count() <= FEW_GRAMS:
        j = lookup(_gram_rows(texts, "_low", index, sizes), index, ["gram"])
    else:
        # many keywords: only digests of the texts meet the index, the messages come back after it
        texts = texts.withColumn("_text", F.sha2("_low", 256))
        one = texts.groupBy("_text").agg(F.first("_low").alias("_low"))
        hits = lookup(_gram_rows(one, "_low", index, sizes).select("_text", "gram"), index, ["gram"]).select("_text", "keyword")
        j = texts.join(hits, "_text").drop("_text")
    j = j.filter(pos > 0).withColumn("position", pos - 1).drop("_low", "gram")
    return j.withColumn("match_type", F.lit("exact")).withColumn("score", F.lit(1.0))


def classify_prospects(matches: DataFrame, tx: DataFrame, pm: DataFrame, product_id) -> DataFrame:
    """C9 (+ J15): no customer id → cannot process; the customer bought any product of the
    searched product's subcategory → purchased; else can process."""
    sub = pm.filter(F.col("product_id") == F.lit(product_id)).select("subcategory").distinct()
    sibs = pm.join(F.broadcast(sub), "subcategory").select("product_id").distinct()
    buyers = tx.join(sibs, "product_id", "left_semi").select("customer_id").distinct().withColumn("_b", F.lit(True))
    j = matches.join(buyers, "customer_id", "left")
    cls = (F.when(F.col("customer_id").isNull(), F.lit(PROSPECT_NO_ID))
           .when(F.col("_b"), F.lit(PROSPECT_PURCHASED)).otherwise(F.lit(PROSPECT_CAN_PROCESS)))
    return j.withColumn("prospect_class", cls).drop("_b")


def class_counts(classified: DataFrame, col: str = "prospect_class") -> DataFrame:
    """Rows per class."""
    return classified.groupBy(col).agg(F.count("*").alias("count"))


def _priority(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in CLASS_PRIORITY.items() for x in kv])
    return F.element_at(m, c)


def _prospect_key(name_col: str) -> Column:
    return F.coalesce(F.col("customer_id").cast("string"), F.concat(F.lit("name:"), F.col(name_col)))


def prospect_texts(classified: DataFrame, name_col: str = "file_customer_name") -> DataFrame:
    """Every distinct whole text of every prospect, with its first occurrence and its
    number of hits (long rows, nothing cut)."""
    c = classified.withColumn("prospect_key", _prospect_key(name_col))
    g = c.groupBy("prospect_key", "content").agg(F.min(F.struct("message_date", "file_name", "row_no")).alias("_o"),
                                                 F.count("*").alias("hits"))
    return g.select("prospect_key", "content", "_o.*", "hits")


def consolidate(classified: DataFrame, name_col: str = "file_customer_name") -> DataFrame:
    """One row per customer id (or per name when there is no id): the highest class
    (purchased > can process > no id), latest message date, hit count, and a display text:
    the first 5 distinct texts (by date, file, row), one a line, with '...' after 500
    characters.  The whole texts are the rows of ``prospect_texts``."""
    c = classified.withColumn("prospect_key", _prospect_key(name_col))
    order = F.struct("message_date", "file_name", "row_no")
    agg = c.groupBy("prospect_key").agg(
        F.max(_priority(F.col("prospect_class"))).alias("_p"),
        F.max("customer_id").alias("customer_id"),
        F.min_by(F.col(name_col), order).alias("customer_name"),
        F.max("message_date").alias("latest_date"),
        F.count("*").alias("hit_count"))
    from ledgerflow.operators.catalog import top_k_per
    texts = c.groupBy("prospect_key", "content").agg(F.min(order).alias("_o"))
    first = top_k_per(texts, ["prospect_key"], [F.col("_o"), F.col("content")], DISPLAY_TEXTS, "_r")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "content"))), lambda x: x["content"]), "\n")
    joined = first.groupBy("prospect_key").agg(whole.alias("_w")).select(
        "prospect_key", F.when(F.length("_w") > DISPLAY_CHARS, F.concat(F.substring("_w", 1, DISPLAY_CHARS), F.lit("...")))
        .otherwise(F.col("_w")).alias("texts"))
    inv = F.create_map(*[F.lit(x) for k, v in CLASS_PRIORITY.items() for x in (v, k)])
    return agg.join(joined, "prospect_key").withColumn("prospect_class", F.element_at(inv, F.col("_p"))).drop("_p")


def add_recommended(cons: DataFrame, recs: DataFrame, customers: DataFrame) -> DataFrame:
    """C11: recommended customers (rank 1–7) not yet among the prospects → 'potential'."""
    r = recs.filter(F.col("rank").between(1, 7)).select(F.col("recommended_customer_id").alias("customer_id")).distinct()
    new = r.join(cons.filter(F.col("customer_id").isNotNull()).select("customer_id"), "customer_id", "left_anti")
    new = new.join(customers.select("customer_id", "customer_name"), "customer_id", "left")
    rows = new.select(F.col("customer_id").cast("string").alias("prospect_key"), "customer_id", "customer_name",
                      F.lit(None).cast("date").alias("latest_date"), F.lit(0).cast("long").alias("hit_count"),
                      F.lit(None).cast("string").alias("texts"), F.lit(PROSPECT_POTENTIAL).alias("prospect_class"))
    return cons.unionByName(rows.withColumn("customer_id", F.col("customer_id").cast(cons.schema["customer_id"].dataType)))


def prospect_summary(cons: DataFrame) -> DataFrame:
    """Counts by class in one row."""
    p = F.col("prospect_class")
    return cons.agg(F.count("*").alias("total"), F.count_if(p == PROSPECT_PURCHASED).alias("purchased"),
                    F.count_if(p == PROSPECT_CAN_PROCESS).alias("can_process"),
                    F.count_if(p == PROSPECT_NO_ID).alias("cannot_process"),
                    F.count_if(p == PROSPECT_POTENTIAL).alias("potential"))


def search_runs(msgs: DataFrame, keywords_by_product: DataFrame, tx: DataFrame, pm: DataFrame) -> DataFrame:
    """One search run per product (its keywords from ``keywords_by_product``:
    product_id, keyword): keywords, hits, distinct customers and purchased customers.

    Each distinct keyword is matched once and its hits are summed per customer before they
    meet products.  Products with the same keywords are one set, and keywords that every
    product has are counted once for all: a set adds only the customers they do not reach."""
    kw = cut(keywords_by_product.select("product_id", "keyword").filter(F.length(F.trim("keyword")) > 0).distinct())
    named = keywords_by_product.select("product_id", "keyword").distinct().groupBy("product_id").agg(F.count("*").alias("keywords"))
    total = kw.agg(F.count_distinct("product_id")).scalar()
    common = cut(kw.groupBy("keyword").agg((F.count("*") == total).alias("common")))
    hits = cut(search_messages(msgs, kw.select("keyword")).groupBy("keyword", "customer_id").agg(F.count("*").alias("hits"))
               .join(common, "keyword"))
    everyone = hits.filter("common")
    known = cut(everyone.filter("customer_id is not null").select("customer_id").distinct())
    own = kw.join(common.filter(~F.col("common")), "keyword")
    sets = cut(named.join(own.groupBy("product_id").agg(F.array_sort(F.collect_set("keyword")).alias("_words")), "product_id", "left")
               .withColumn("set", F.xxhash64("_words")))
    words = sets.select("set", F.explode("_words").alias("keyword")).distinct()
    reached = cut(words.join(hits.filter(~F.col("common")), "keyword").groupBy("set", "customer_id").agg(F.sum("hits").alias("hits")))
    fresh = cut(reached.filter("customer_id is not null").join(known, "customer_id", "left_anti").select("set", "customer_id"))
    sub = pm.select("product_id", "subcategory").distinct()
    bought = cut(tx.join(sub, "product_id").select("customer_id", "subcategory").distinct())
    per_set = reached.groupBy("set").agg(F.sum("hits").alias("_h")).join(fresh.groupBy("set").agg(F.count("*").alias("_c")), "set", "left")
    runs = sets.select("product_id", "keywords", "set").join(per_set, "set", "left")
    # a product of several subcategories counts a customer once
    in_sub = known.join(bought, "customer_id")
    in_set = fresh.join(bought, "customer_id")
    once = sub.groupBy("product_id").agg(F.count("*").alias("_n"), F.min("subcategory").alias("subcategory"))
    plain = (runs.join(once.filter("_n = 1").select("product_id", "subcategory"), "product_id")
             .join(in_sub.groupBy("subcategory").agg(F.count("*").alias("_p")), "subcategory", "left")
             .join(in_set.groupBy("set", "subcategory").agg(F.count("*").alias("_q")), ["set", "subcategory"], "left"))
    several = runs.join(once, "product_id", "left").filter("_n is null or _n > 1")
    many = several.select("product_id", "set").join(sub, "product_id")
    p = many.join(in_sub, "subcategory").select("product_id", "customer_id").distinct().groupBy("product_id").agg(F.count("*").alias("_p"))
    q = many.join(in_set, ["set", "subcategory"]).select("product_id", "customer_id").distinct().groupBy("product_id").agg(F.count("*").alias("_q"))
    columns = ["product_id", "keywords", "_h", "_c", "_p", "_q"]
    several = several.join(p, "product_id", "left").join(q, "product_id", "left")
    every = everyone.agg(F.sum("hits")).scalar()
    whole = known.agg(F.count("*")).scalar()
    zero = F.lit(0)
    return plain.select(*columns).unionByName(several.select(*columns)).select(
        "product_id", "keywords", (F.coalesce(every, zero) + F.coalesce("_h", zero)).alias("matches"),
        (F.coalesce(whole, zero) + F.coalesce("_c", zero)).alias("customers"),
        (F.coalesce("_p", zero) + F.coalesce("_q", zero)).alias("purchased_customers"))


def keyword_stats(matches: DataFrame) -> DataFrame:
    """Hits per keyword."""
    return matches.groupBy("keyword").agg(F.count("*").alias("hits"),
                                          F.count_distinct("customer_id").alias("customers"))


def top_customers_per_class(classified: DataFrame, k_by_class: dict[str, int]) -> DataFrame:
    """The top customers by hits within each class (k per class), ties by key."""
    g = classified.filter(F.col("customer_id").isNotNull()).groupBy("prospect_class", "customer_id").agg(
        F.count("*").alias("hits"))
    from ledgerflow.operators.catalog import top_k_per
    kmap = F.create_map(*[F.lit(x) for kv in k_by_class.items() for x in kv])
    r = top_k_per(g, ["prospect_class"], [F.col("hits").desc(), F.col("customer_id")], max([10, *k_by_class.values()]))
    return r.filter(F.col("rank") <= F.coalesce(F.element_at(kmap, F.col("prospect_class")), F.lit(10)))


def keywords_for_products(pm: DataFrame, words: Sequence[str]) -> DataFrame:
    """Keyword table per product: the fixed words plus the product's core name."""
    from ledgerflow.functions.text import core_name

    p = pm.select("product_id", core_name("name_zh").alias("nm"))
    fixed = F.array(*[F.lit(w) for w in words])
    return p.select("product_id", F.explode(F.array_union(fixed, F.array(F.col("nm")))).alias("keyword"))
