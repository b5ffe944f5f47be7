"""Small helpers shared by the training-data operators.

Conventions used by every operator here:

* a null text counts as the empty text; ids may be null or repeat, each input row is a
  row of its own and nothing joins on the id alone where a repeat would multiply rows;
* inputs may carry further columns of any name: operators pick their columns first, or
  pack the whole row into one struct, so names cannot clash;
* lineage is cut only with ``checkpoint()`` into the shared folder of the session.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerflow.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

# Size of the membership bitmaps in bits: the filter has this size whatever the data.
# More keys only mean more false positives, which later exact steps remove.
BITMAP_BITS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_clean(df: DataFrame) -> DataFrame:
    """``cut``, after which Spark removes the shuffle files of ``df``: the rows are stored, nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return cut(df.select("*"))  # a query takes the setting when it is made
    finally:
        conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the Python operators."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerflow-"), "ledgerflow_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_of(key: Column, bits: int = BITMAP_BITS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(keys: DataFrame, key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """One row holding ``bits`` bits as an array of longs, with the bit of every key set.

    The row has ``bits`` / 8 bytes for any number of keys, so it may be read as a scalar
    subquery by every task.
    """
    words = (keys.select(bit_of(F.col(key), bits).alias("b"))
             .groupBy(F.expr("b div 64").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("x")))
    dense = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left")
    packed = F.array_sort(F.collect_list(F.struct("id", F.coalesce("x", F.lit(0)).alias("x"))))
    return dense.agg(packed.alias("a")).select(F.col("a.x").alias("a"))


def may_hold(bits_row: DataFrame, key: Column, bits: int = BITMAP_BITS) -> Column:
    """True for every key of the bitmap, and for a few others."""
    b = bit_of(key, bits)
    word = F.call_function("get", bits_row.scalar(), F.call_function("div", b, F.lit(64)).cast("int"))
    return F.call_function("shiftright", word, (b % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a grouped ``right`` whose keys may be very frequent in ``left``.

    A grouped table already lies by its keys, and a join that relies on that cannot split a
    large partition of ``left``.  The join key of its own makes Spark shuffle both sides
    for the join, and then AQE splits what is skewed.
    """
    both = [df.withColumn("_join", F.xxhash64(*on)) for df in (left, right)]
    return both[0].join(both[1], ["_join", *on], how).drop("_join")


def ordered_prefix(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive running sums over ``order`` within ``group``, without one task per group.

    Rows are range-partitioned by (group, order), so a large group spreads over many
    tasks.  The partition number is stored with each row before it is used, so a task run
    again cannot disagree with the offsets.  The offsets are running sums over at most one
    row per group and partition.  ``sums`` names a result column for each summed column;
    a null counts as 0.  Group columns must not be null.
    """
    n = shuffle_parts(df.sparkSession)
    keys = [F.col(c) for c in [*group, *order]]
    placed = cut(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    from pyspark.sql import Window as W

    inner = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    if not group:
        outer = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy(*group, "_part").agg(
        *[F.sum(F.coalesce(F.col(src), F.lit(0))).alias(f"_s_{dst}") for dst, src in sums.items()])
    for dst in sums:
        parts = parts.withColumn(f"_o_{dst}", F.coalesce(F.sum(f"_s_{dst}").over(outer), F.lit(0)))
    parts = parts.drop(*[f"_s_{dst}" for dst in sums])
    out = placed
    for dst, src in sums.items():
        out = out.withColumn(f"_i_{dst}", F.coalesce(F.sum(F.coalesce(F.col(src), F.lit(0))).over(inner), F.lit(0)))
    out = out.join(parts, [*group, "_part"])
    for dst in sums:
        out = out.withColumn(dst, F.col(f"_o_{dst}") + F.col(f"_i_{dst}"))
    return out.drop("_part", *[f"_{k}_{dst}" for dst in sums for k in "oi"])
