"""Purchase classifier (M16–M18): categories as ordered target statistics, boosted trees
with early stopping on a held-out part, a final fit on all rows, stored models.

A category becomes a number by its label mean.  For training rows only the rows that come
earlier in a hashed order count, so no row sees its own label; rows to be scored use all
training rows.  Both are smoothed by the overall mean.  The sums are distributed prefix
sums, so that a category of many rows (a weekday) is spread over many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators.prefix import exclusive_sums
from ledgerflow.operators.replenish import FEATURES_M12, PAIR, hash_unit
from ledgerflow.session import cut, lookup, ship_package

KEYS = [*PAIR, "target_date"]
# FIXED VALUES: the categories of the source's classifier and its training settings.
CATEGORIES = ["customer_id", "product_id", "day_of_week", "weekday_name", "preferred_weekday"]
ROUNDS, DEPTH, STEP = 500, 6, 0.05
ORDER_SEED, SPLIT_SEED, SMOOTHING = 44, 43, 1.0
HELD_OUT = 0.2
ROWS_PER_TASK = 1 << 17   # training rows that a partition holds


def _order(keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(ORDER_SEED)), *[F.col(k).cast("string") for k in keys]))


def _value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _long(rows: DataFrame, cats: Sequence[str], *extra) -> DataFrame:
    """One row per row and category: cat, value."""
    each = F.array(*[F.struct(F.lit(c).alias("cat"), _value(c).alias("value")) for c in cats])
    return rows.select(*extra, F.explode(each).alias("_c")).select("*", "_c.cat", "_c.value").drop("_c")


def ordered_target_stats(rows: DataFrame, cats: Sequence[str] = CATEGORIES, keys: Sequence[str] = KEYS, label: str = "label") -> DataFrame:
    """``keys`` and ``ts_<category>``: (labels of earlier rows + prior) / (earlier rows + 1) in
    the row's category, in the order of a hash of the keys; the prior is the label mean."""
    prior = rows.agg(F.avg(label)).scalar()
    long = _long(rows, cats, *keys, F.col(label).cast("long").alias("_y"), F.lit(1).cast("long").alias("_one"), _order(keys).alias("_h"))
    sums = exclusive_sums(long, ["cat", "value"], ["_h", *keys], {"_before": "_y", "_n": "_one"})
    stat = (F.col("_before") + F.lit(SMOOTHING) * prior) / (F.col("_n") + SMOOTHING)
    return sums.groupBy(*keys).agg(*[F.max(F.when(F.col("cat") == c, stat)).alias(f"ts_{c}") for c in cats])


def target_stats(rows: DataFrame, cats: Sequence[str] = CATEGORIES, label: str = "label") -> DataFrame:
    """(cat, value, stat) over all ``rows``; the row with a null value is the prior of its category."""
    prior = rows.agg(F.avg(label)).scalar()
    g = _long(rows, cats, F.col(label).cast("long").alias("_y")).groupBy("cat", "value").agg(F.sum("_y").alias("_s"), F.count("*").alias("_n"))
    known = g.select("cat", "value", ((F.col("_s") + F.lit(SMOOTHING) * prior) / (F.col("_n") + SMOOTHING)).alias("stat"))
    unseen = rows.sparkSession.createDataFrame([(c,) for c in cats], "cat string").select("cat", F.lit(None).cast("string").alias("value"), prior.alias("stat"))
    return known.unionByName(unseen)


def with_target_stats(rows: DataFrame, stats: DataFrame, cats: Sequence[str] = CATEGORIES) -> DataFrame:
    """``rows`` with ``ts_<category>`` looked up; an unseen category has the prior."""
    for c in cats:
        own = stats.filter(F.col("cat") == c)
        prior = own.filter("value is null").agg(F.max("stat")).scalar()
        rows = lookup(rows.withColumn("_v", _value(c)), own.filter("value is not null").select(F.col("value").alias("_v"), F.col("stat").alias("_s")),
                      ["_v"], "left").withColumn(f"ts_{c}", F.coalesce("_s", prior)).drop("_v", "_s")
    return rows


def held_out(cols: Sequence[str] = (*KEYS, "label")) -> Column:
    """One row in five by a hash of its keys and label, so that both classes split alike."""
    return hash_unit(list(cols), SPLIT_SEED) >= 1 - HELD_OUT


class PurchaseModel:
    """Boosted trees over the numeric features and the target statistics."""

    def __init__(self, trees, stats: DataFrame, features: list[str], facts: dict):
        self.trees, self.stats, self.features, self.facts = trees, stats, features, facts

    def transform(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        rows = with_target_stats(rows, self.stats)
        rows = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep").transform(rows)
        return self.trees.transform(rows)

    def save(self, path: str) -> None:
        self.trees.write().overwrite().save(f"{path}/trees")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        spark = self.stats.sparkSession
        facts = json.dumps({"features": self.features, "facts": self.facts})
        spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")   # written last

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PurchaseModel":
        from pyspark.ml.classification import GBTClassificationModel

        told = json.loads(spark.read.text(f"{path}/facts").first()[0])
        return PurchaseModel(GBTClassificationModel.load(f"{path}/trees"), spark.read.parquet(f"{path}/stats"), told["features"], told["facts"])


def _weights(rows: DataFrame, classes) -> Column:
    """``classes``: 'balanced' (n / 2 per class) or the weights of labels 0 and 1."""
    if classes == "balanced":
        n, p = rows.agg(F.count("*"), F.sum("label")).first()
        classes = (n / 2 / max(n - p, 1), n / 2 / max(p, 1)) if n else (1.0, 1.0)
    return F.when(F.col("label") == 1, F.lit(float(classes[1]))).otherwise(F.lit(float(classes[0])))


def _spread(rows: DataFrame) -> DataFrame:
    """Training rows dealt evenly by key to one partition per core, more if one would exceed
    ``ROWS_PER_TASK``.  A tree takes a job per level, so partitions cost more than their rows;
    as they come, training and held-out rows lie in partitions of their own.  So few rows that
    one partition holds them stay as they are."""
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK)
    return rows if n <= 1 else rows.repartition(-(-max(cores, n) // cores) * cores, *KEYS)


def _fit(rows: DataFrame, features: list[str], rounds: int, classes, check: bool, tol: float, seed: int):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = _spread(rows).withColumn("weight", _weights(rows, classes)).withColumn("label_d", F.col("label").cast("double"))
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)
    gbt = GBTClassifier(labelCol="label_d", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=DEPTH, stepSize=STEP, seed=seed)
    if check:
        gbt = gbt.setValidationIndicatorCol("held_out").setParams(validationTol=tol)
    return gbt.fit(cut(rows.select("features", "label_d", "weight", *(["held_out"] if check else []))))


def train(samples: DataFrame, numeric: Sequence[str] = FEATURES_M12, rounds: int = ROUNDS, classes="balanced", tol: float = 1e-4,
          seed: int = 42) -> tuple[PurchaseModel, DataFrame]:
    """(model, scored held-out rows).  Up to ``rounds`` trees; training stops when the error
    on the held-out fifth falls by less than ``tol`` of itself from one tree to the next."""
    ship_package(samples.sparkSession)
    rows = cut(samples.withColumn("held_out", held_out()))
    fit_on, rest = rows.filter("not held_out"), rows.filter("held_out")
    stats = cut(target_stats(fit_on))
    features = [*numeric, *[f"ts_{c}" for c in CATEGORIES]]
    ready = fit_on.join(ordered_target_stats(fit_on), KEYS).unionByName(with_target_stats(rest, stats))
    trees = _fit(cut(ready), features, rounds, classes, True, tol, seed)
    model = PurchaseModel(trees, stats, features, {"rounds": trees.getNumTrees, "limit": rounds})
    return model, model.transform(rest).withColumn("label_d", F.col("label").cast("double"))


def fit_all(samples: DataFrame, rounds: int, numeric: Sequence[str] = FEATURES_M12, classes="balanced", seed: int = 42) -> PurchaseModel:
    """M18, second stage: a model of all rows with the number of trees found before."""
    ship_package(samples.sparkSession)
    rows = cut(samples)
    features = [*numeric, *[f"ts_{c}" for c in CATEGORIES]]
    trees = _fit(cut(rows.join(ordered_target_stats(rows), KEYS)), features, rounds, classes, False, 0.0, seed)
    return PurchaseModel(trees, cut(target_stats(rows)), features, {"rounds": trees.getNumTrees, "limit": rounds})
