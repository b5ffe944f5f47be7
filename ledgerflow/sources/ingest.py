"""Sheet cleaning, column contracts and writes (SRC1, SRC2, SRC6, SNK1, SNK3–SNK8).

Sheets arrive as rows (file, row number, lettered columns).  Forward-fill of blank
cells ("same as above") is done per file in fixed-size row blocks with a carried-in
value per block, so a very large sheet never becomes one task (``forward_fill``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.misc import blank_to_null
from ledgerflow.sources.versions import VersionedTable

# FIXED VALUES: column letters of the ERP sheets and the first data row.
SALES_COLUMNS = {"A": "customer_id", "F": "product_id", "K": "product_name", "N": "transaction_date",
                 "Q": "document_type", "S": "quantity", "V": "unit_price", "Y": "currency", "Z": "amount"}
SALES_FILLED = ("customer_id", "product_id", "product_name", "currency")
STOCK_COLUMNS = {"A": "product_id", "D": "product_name", "H": "category", "J": "warehouse_id",
                 "M": "total_quantity", "O": "borrowed_out", "R": "borrowed_in", "T": "stock_quantity", "W": "unit"}
STOCK_NUMBERS = ("total_quantity", "borrowed_out", "borrowed_in", "stock_quantity")
FIRST_DATA_ROW = 8
# Column contracts of the import files.
CONTRACTS = {
    "customer": ("customer_id", "customer_name", "phone_number", "address", "city", "district"),
    "sales": ("customer_id", "product_id", "product_name", "transaction_date", "document_type", "quantity",
              "unit_price", "amount"),
    "inventory": ("product_id", "warehouse_id", "total_quantity", "borrowed_out", "borrowed_in", "stock_quantity",
                  "unit", "product_name"),
}


def forward_fill(df: DataFrame, part: str, order: str, cols: Sequence[str], block_rows: int = 100_000) -> DataFrame:
    """Every null/blank cell of ``cols`` takes the last non-blank value above it in the
    same ``part`` (rows ordered by the integer ``order``).

    Rows are cut into blocks of ``block_rows`` consecutive row numbers.  Inside a block
    a running ``last(ignorenulls)`` fills the gaps; each block's last non-blank value is
    carried into the next blocks through a (block-count-sized) window.  No task holds
    more than one block."""
    d = df.withColumn("_blk", F.floor(F.col(order) / block_rows))
    for c in cols:
        d = d.withColumn(c, blank_to_null(F.col(c)))
    w_in = Window.partitionBy(part, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for c in cols:
        d = d.withColumn(f"_run_{c}", F.last(c, ignorenulls=True).over(w_in))
    last_in_block = d.groupBy(part, "_blk").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}") for c in cols])
    w_blk = Window.partitionBy(part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_in_block.select(part, "_blk", *[F.last(f"_end_{c}", ignorenulls=True).over(w_blk).alias(f"_in_{c}")
                                                 for c in cols])
    out = d.join(carry, [part, "_blk"], "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_run_{c}"), F.col(f"_in_{c}")))
    return out.drop("_blk", *[f"_run_{c}" for c in cols], *[f"_in_{c}" for c in cols])


def clean_sales(raw: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """SRC1: from row 8 take the fixed sales columns, forward-fill customer, product,
    product name and currency, keep rows with a date and a quantity, and default a
    missing unit price / amount to 0.  ``raw``: file, row_no, and columns A..Z as text."""
    sel = raw.filter(F.col("row_no") >= FIRST_DATA_ROW).select(
        "file", "row_no", *[F.col(letter).alias(name) for letter, name in SALES_COLUMNS.items()])
    filled = forward_fill(sel, "file", "row_no", SALES_FILLED, block_rows)
    date = F.coalesce(F.try_to_timestamp(F.trim("transaction_date"), F.lit("yyyy-MM-dd")),
                      F.try_to_timestamp(F.trim("transaction_date"), F.lit("yyyy/MM/dd")))
    qty = _num(F.col("quantity"))
    out = filled.withColumn("transaction_date", F.to_date(date)).withColumn("quantity", qty)
    out = out.filter(F.col("transaction_date").isNotNull() & F.col("quantity").isNotNull())
    return (out.withColumn("unit_price", F.coalesce(_num(F.col("unit_price")), F.lit(0).cast("decimal(18,4)")))
            .withColumn("amount", F.coalesce(_num(F.col("amount")), F.lit(0).cast("decimal(18,4)"))))


def _num(c: Column) -> Column:
    """Text number with thousands separators → DECIMAL(18,4); '' and '---' → null."""
    t = F.regexp_replace(F.trim(c), ",", "")
    return F.when((t == "") | (t == "---") | t.isNull(), F.lit(None)).otherwise(t.try_cast("decimal(18,4)"))


def clean_stock(raw: DataFrame) -> DataFrame:
    """SRC2: from row 8 take the stock columns; numbers lose ',' and '---' / blank → 0; a
    row whose number does not parse is dropped; product id required."""
    sel = raw.filter(F.col("row_no") >= FIRST_DATA_ROW).select(
        "file", "row_no", *[F.col(letter).alias(name) for letter, name in STOCK_COLUMNS.items()])
    sel = sel.withColumn("product_id", blank_to_null(F.col("product_id")))
    parsed_cols, bad = [], F.lit(False)
    for c in STOCK_NUMBERS:
        t = F.regexp_replace(F.trim(F.col(c)), ",", "")
        empty = t.isNull() | (t == "") | (t == "---")
        parsed = t.try_cast("decimal(18,4)")
        bad = bad | (~empty & parsed.isNull())
        parsed_cols.append(F.when(empty, F.lit(0).cast("decimal(18,4)")).otherwise(parsed).alias(c))
    keep = [c for c in sel.columns if c not in STOCK_NUMBERS]
    out = sel.select(*keep, *parsed_cols, bad.alias("_bad"))
    return out.filter(F.col("product_id").isNotNull() & ~F.col("_bad")).drop("_bad")


def check_columns(raw: DataFrame, kind: str, letters: dict[str, str]) -> DataFrame:
    """SRC6: every column of every sheet file against the contract of ``kind``: one row per
    (file, column) with the file's rows, the rows in which the column is filled and a
    status: 'missing' (required, never filled), 'extra' (filled, not required) or 'ok'."""
    required = CONTRACTS[kind]
    absent = [c for c in required if c not in letters.values()]
    counts = raw.groupBy("file").agg(
        F.count("*").alias("rows"),
        *[F.count_if(blank_to_null(F.col(letter)).isNotNull()).alias(name) for letter, name in letters.items()],
        *[F.lit(0).cast("long").alias(c) for c in absent])
    names = [*letters.values(), *absent]
    each = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("filled_rows"),
                              F.lit(n in required).alias("required")) for n in names])
    status = (F.when(F.col("required") & (F.col("filled_rows") == 0), F.lit("missing"))
              .when(~F.col("required") & (F.col("filled_rows") > 0), F.lit("extra")).otherwise(F.lit("ok")))
    return counts.select("file", "rows", F.explode(each).alias("x")).select(
        "file", F.lit(kind).alias("kind"), "rows", "x.column_name", "x.filled_rows", "x.required").withColumn("status", status)


# ------------------------------------------------------------------------------- sinks
def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: CSV with a header row whose first cell starts with a UTF-8 BOM (spreadsheet
    tools then read the text as UTF-8)."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "﻿" + first)
    out.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)


def append_partitioned(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """SNK2 write: append partitioned by (e.g.) prediction month."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_months(target: DataFrame, batch: DataFrame, date_col: str = "transaction_date") -> DataFrame:
    """SNK3: drop every target row whose (year, month) occurs in the batch, then add the
    batch."""
    m = F.trunc(F.col(date_col), "month")
    months = batch.select(m.alias("_m")).distinct()
    kept = target.withColumn("_m", m).join(months, "_m", "left_anti").drop("_m")
    return kept.unionByName(batch.select(*target.columns))


def write_replace_months(batch: DataFrame, path: str, date_col: str = "transaction_date") -> None:
    """SNK3 write: dynamic partition overwrite of the month partitions in the batch."""
    (batch.withColumn("month", F.date_format(date_col, "yyyy-MM"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def replace_stock(target: DataFrame, batch: DataFrame, cross_product: bool = True) -> DataFrame:
    """SNK4: drop target rows whose product is in the batch's products and warehouse in the
    batch's warehouses (the source's cross product of the two sets; ``cross_product=False``
    uses the true (product, warehouse) pairs), then add the batch."""
    if cross_product:
        prods = batch.select("product_id").distinct()
        whs = batch.select("warehouse_id").distinct()
        hit_p = target.join(prods.withColumn("_p", F.lit(True)), "product_id", "left")
        hit = hit_p.join(whs.withColumn("_w", F.lit(True)), "warehouse_id", "left")
        kept = hit.filter(~(F.coalesce("_p", F.lit(False)) & F.coalesce("_w", F.lit(False)))).drop("_p", "_w")
    else:
        kept = target.join(batch.select("product_id", "warehouse_id"), ["product_id", "warehouse_id"], "left_anti")
    return kept.select(*target.columns).unionByName(batch.select(*target.columns))


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str], status_col: str = "prediction_status",
           updatable: str = "active") -> DataFrame:
    """SNK5: insert new keys; for existing keys take the new values only while the target
    row's status is still ``updatable`` (full outer join on the key)."""
    cols = [c for c in target.columns if c not in key]
    t = target.select(*key, *[F.col(c).alias(f"_t_{c}") for c in cols], F.lit(True).alias("_in_t"))
    n = new.select(*key, *[F.col(c).alias(f"_n_{c}") if c in new.columns else F.lit(None).alias(f"_n_{c}")
                           for c in cols], F.lit(True).alias("_in_n"))
    j = t.join(n, list(key), "full")
    take_new = F.col("_in_n").isNotNull() & (F.col("_in_t").isNull() | (F.col(f"_t_{status_col}") == updatable))
    return j.select(*key, *[F.when(take_new, F.col(f"_n_{c}")).otherwise(F.col(f"_t_{c}")).alias(c) for c in cols])


def insert_missing(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """SNK6: ON CONFLICT DO NOTHING — new rows whose key is absent are appended."""
    add = new.join(target.select(*key), list(key), "left_anti")
    return target.unionByName(add.select(*target.columns))


def apply_patches(target: DataFrame, patches: DataFrame, key: Sequence[str], order: str, stamp: str,
                  updated_col: str = "updated_at") -> DataFrame:
    """SNK7: the latest patch per key (by ``order``) overwrites the target row field by
    field where the patch value is not null; patched rows get ``updated_at`` = stamp."""
    cols = [c for c in target.columns if c not in key and c != updated_col]
    pcols = [c for c in cols if c in patches.columns]
    latest = patches.groupBy(*key).agg(F.max_by(F.struct(*pcols), F.col(order)).alias("_p"))
    j = target.join(latest, list(key), "left")
    sel = [*key]
    for c in cols:
        sel.append(F.coalesce(F.col(f"_p.{c}"), F.col(c)).alias(c) if c in pcols else F.col(c))
    upd = F.when(F.col("_p").isNotNull(), F.lit(stamp).cast("timestamp"))
    if updated_col in target.columns:
        upd = upd.otherwise(F.col(updated_col))
    sel.append(upd.alias(updated_col))
    return j.select(*sel)


def delete_keys(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """SNK8: rows whose key is in ``keys`` are removed (anti join)."""
    return df.join(keys.select(*key).distinct(), list(key), "left_anti")


def delete_products(pm: DataFrame, inventory: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK8: (products, stock) without the products of ``gone``."""
    return delete_keys(pm, gone, ["product_id"]), delete_keys(inventory, gone, ["product_id"])


# ------------------------------------------------------------- stored forms of the sinks
def stored_stock(table: VersionedTable, batch: DataFrame, number: int, cross_product: bool = True) -> bool:
    """SNK4 on a stored table; False if batch ``number`` was applied before."""
    return table.change(lambda t: replace_stock(t, batch, cross_product), number)


def stored_upsert(table: VersionedTable, new: DataFrame, key: Sequence[str], number: int) -> bool:
    """SNK5 on a stored table."""
    return table.change(lambda t: upsert(t, new, key), number)


def stored_insert_missing(table: VersionedTable, new: DataFrame, key: Sequence[str], number: int) -> bool:
    """SNK6 on a stored table."""
    return table.change(lambda t: insert_missing(t, new, key), number)


def stored_patches(table: VersionedTable, patches: DataFrame, key: Sequence[str], order: str, stamp: str, number: int) -> bool:
    """SNK7 on a stored table; the first patch adds ``updated_at``."""
    return table.change(lambda t: apply_patches(t, patches, key, order, stamp), number)


def stored_delete(tables: Sequence[tuple[VersionedTable, Sequence[str]]], gone: DataFrame, number: int) -> list[bool]:
    """SNK8 cascade on stored tables, each with the key columns it shares with ``gone``.

    The tables that refer to others come first; a cascade that stopped half way goes on
    with the tables that do not have batch ``number`` yet.  The keys are stored with the
    first table, so that a later table sees the same ones."""
    spark, first = gone.sparkSession, tables[0][0]
    keys = VersionedTable(spark, f"{first.path}/deleted", "k")
    keys.write(gone, number)
    gone = spark.read.parquet(keys.folder(number))
    return [table.change(lambda t, k=key: delete_keys(t, gone, list(k)), number) for table, key in tables]
