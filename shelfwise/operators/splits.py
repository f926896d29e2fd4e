"""Grouped folds and samples that don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.text import stable_rank
from shelfwise.operators.windows import ordinal, top_per_group


def hash_folds(component: Column, folds: int, seed: str) -> Column:
    """A component's fold, whole and the same for every row of it."""
    return F.pmod(F.conv(F.substring(stable_rank(F.lit(seed), component), 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def quota(rows: DataFrame, stratum: list[str], key: Column, n: int) -> DataFrame:
    """The n rows of least key in each stratum."""
    w = Window.partitionBy(*stratum).orderBy("key_")
    return rows.withColumn("key_", key).withColumn("place_", F.row_number().over(w)).where(F.col("place_") <= n).drop("key_", "place_")


def hard_random(rows: DataFrame, uncertainty: str, key: Column, by: list[str], n: int) -> DataFrame:
    """Of each group half the rows of least uncertainty value, then as many of the rest by least key; kind tells which.

    Keys are distinct. Both halves keep n rows of a group in each task before any is shuffled.
    """
    keyed, names = rows.withColumn("key_", key), [*rows.columns, "kind"]
    hard = top_per_group(keyed, by, [F.col(uncertainty), F.col("key_")], n // 2).withColumn("kind", F.lit("hard"))
    rest = keyed.join(hard.select("key_"), "key_", "left_anti")
    random = top_per_group(rest, by, [F.col("key_")], n - n // 2).withColumn("kind", F.lit("random"))
    return hard.select(*names).unionByName(random.select(*names))


def round_robin(rows: DataFrame, bucket: list[str], key: Column) -> DataFrame:
    """turn: the row's place within its bucket; rows in order of (turn, key) interleave the buckets. Keys are hex digits."""
    keyed = rows.withColumn("key_", key).withColumn("number_", F.conv(F.substring("key_", 1, 12), 16, 10).cast("double"))
    return ordinal(keyed, "number_", "key_", bucket).select(*rows.columns, (F.col("place_") + 1).cast("int").alias("turn"))


def exact_share(rows: DataFrame, stratum: list[str], key: Column, percent: int, tie: str, rounded: bool = False) -> DataFrame:
    """rows with chosen: the floor(n * percent / 100) rows, or that rounded, of least key in each stratum.

    Keys are even hashes: rows are counted by stratum and the key's first two digits, and ordered within those only.
    """
    cut = rows.withColumn("key_", key).withColumn("digits_", F.substring("key_", 1, 2))
    counts = cut.groupBy(*stratum, "digits_").agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*stratum)
    before = F.coalesce(F.sum("n_").over(w.orderBy("digits_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*stratum, "digits_", before.alias("before_"), (F.round if rounded else F.floor)(F.sum("n_").over(w) * percent / 100).alias("take_"))
    place = F.row_number().over(Window.partitionBy(*stratum, "digits_").orderBy("key_", tie))
    return cut.withColumn("in_", place).join(counts, [*stratum, "digits_"]).select(*rows.columns, (F.col("before_") + F.col("in_") <= F.col("take_")).alias("chosen"))
