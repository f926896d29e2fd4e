"""Shuffles that no key can make uneven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.lineage import cut_lineage  # noqa: F401  (the subpackage's operators take it from here)

SALTS = 64
#: Words of 64 marks that among() broadcasts at most: some 13 MB of rows.
MARKS = 1 << 19


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, by: str | Column, salts: int = SALTS) -> DataFrame:
    """rows left join table on key, where one key may hold a third of the rows and table has it once.

    The keys of rows are first reduced to one row for each salt, with partial sums before the shuffle; those few
    look up the table, and rows meet them by key and salt.
    """
    by = F.col(by) if isinstance(by, str) else by
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    found = salted.where(F.col(key).isNotNull()).groupBy(key, "salt_").agg(F.lit(1).alias("one_")).drop("one_").join(table, key)
    return salted.join(found, [key, "salt_"], "left").drop("salt_")


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in keys, and a few others: what a join with keys drops is mostly left out before its shuffle.

    Each key marks one of 64 * MARKS places by its hash; only the marks are broadcast, so they are bounded for any number of
    keys. With many more keys than places most rows pass: the join, which must follow, makes it exact.
    """
    place = F.pmod(F.xxhash64(key), F.lit(64 * MARKS))
    bit = F.pmod(F.col("place_"), F.lit(64)).cast("int")
    at = lambda df: df.withColumn("place_", place).withColumn("word_", F.shiftright("place_", 6))
    marks = at(keys.select(key)).groupBy("word_").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("marks_"))
    return at(rows).join(F.broadcast(marks), "word_").where(F.bit_get("marks_", bit) == 1).select(*rows.columns)
