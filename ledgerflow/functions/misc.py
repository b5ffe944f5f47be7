"""Defaults, buckets, ids and arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.constants import METHOD_BY_GROUP


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """NULLIF(trim(x), '') — also maps the text 'None' to null."""
    t = F.trim(_c(c))
    return F.when((t == "") | (t == "None"), F.lit(None)).otherwise(_c(c))


def default(c, value) -> Column:
    """COALESCE(NULLIF(trim(x), ''), value)."""
    return F.coalesce(blank_to_null(c), F.lit(value))


def bucket(c, edges: Sequence[float], labels: Sequence[str], inclusive: bool = True) -> Column:
    """Label of the first edge the value is ≤ (or <) to; the last label otherwise.
    ``len(labels) == len(edges) + 1``."""
    c = _c(c)
    expr = None
    for e, lab in zip(edges, labels):
        cond = (c <= e) if inclusive else (c < e)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def bucket_ge(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first edge the value is ≥ to (edges descending); last label else."""
    c = _c(c)
    expr = None
    for e, lab in zip(edges, labels):
        expr = F.when(c >= e, F.lit(lab)) if expr is None else expr.when(c >= e, F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def method_of(group) -> Column:
    """Forecast method of a volatility group; 'unknown' otherwise."""
    m = F.create_map(*[F.lit(x) for kv in METHOD_BY_GROUP.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(group)), F.lit("unknown"))


def decode_labels(c, mapping: dict, default_label: str | None = None) -> Column:
    """F16: code → text by a map literal."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = F.element_at(m, _c(c).cast("string") if not isinstance(next(iter(mapping)), bool) else _c(c))
    return F.coalesce(out, F.lit(default_label)) if default_label is not None else out


ID_LENGTH, HASH_LENGTH = 8, 64


def transaction_id(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int = ID_LENGTH,
                   taken: DataFrame | None = None) -> DataFrame:
    """Deterministic id of ``length`` characters from the keys and the row's position
    among equal keys (so repeated rows differ).

    Rows whose id repeats, or is one of ``taken`` (column transaction_id), get twice as many
    characters of their hash, round by round, until no id repeats; every other row keeps
    its id, and ids of different rounds differ in length.  A round looks only at the rows
    that still collide.  ``id_collision`` tells which ids were lengthened."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("_n").cast("string"))
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_full", F.sha2(text, 256)).withColumn("_size", F.lit(length))
    used = None if taken is None else taken.select(F.col("transaction_id").alias("_id")).distinct()
    lengths = [length]
    while lengths[-1] < HASH_LENGTH:
        lengths.append(min(2 * lengths[-1], HASH_LENGTH))
    open_ids = rows.select(F.substring("_full", 1, length).alias("_id"), "_full")
    longer = None
    for now, following in zip(lengths, lengths[1:]):
        bad = open_ids.groupBy("_id").agg(F.count("*").alias("_c")).filter("_c > 1").select("_id")
        if used is not None:
            bad = bad.union(open_ids.select("_id").join(used, "_id", "left_semi")).distinct()
        hit = open_ids.join(bad, "_id", "left_semi").select(F.substring("_full", 1, following).alias("_id"), "_full")
        step = hit.select("_full", F.lit(following).alias("_to"))
        longer = step if longer is None else longer.union(step)
        open_ids = hit
    longer = longer.groupBy("_full").agg(F.max("_to").alias("_to"))
    out = rows.join(longer, "_full", "left").withColumn("_size", F.coalesce("_to", "_size"))
    return out.withColumn("transaction_id", F.expr("substring(_full, 1, _size)")).withColumn(
        "id_collision", F.col("_to").isNotNull()).select(*df.columns, "transaction_id", "id_collision")


def row_hash(cols: Sequence[str]) -> Column:
    """60 bits of the MD5 of a row's values, as an exact number."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u001e")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint_of(total: Column, count: Column) -> Column:
    """The fingerprint of rows whose hashes sum to ``total``; sums of disjoint rows may be added."""
    return F.md5(F.concat_ws(":", total.cast("string"), count.cast("string")))


def fingerprint(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Change fingerprint of a result set (per ``by`` group, or one row).

    The source hashes the ordered rows' text with MD5; here 60 bits of each row's MD5 are
    summed exactly (DECIMAL) and the sum and row count are hashed.  The value depends on
    the multiset of rows, not on their order, and it aggregates partially on every
    executor — no group is gathered into one buffer."""
    g = df.groupBy(*by) if by else df.groupBy()
    agg = g.agg(F.sum(row_hash(cols)).alias("_s"), F.count("*").alias("row_count"))
    return agg.select(*by, "row_count", fingerprint_of(F.col("_s"), F.col("row_count")).alias("fingerprint"))


def unit_price(amount, quantity) -> Column:
    """Amount / quantity, null when quantity is 0 or null."""
    return F.try_divide(_c(amount).cast("double"), _c(quantity).cast("double"))


def net_stock(total, out, inn) -> Column:
    """stock = total − borrowed out + borrowed in."""
    return _c(total) - _c(out) + _c(inn)
