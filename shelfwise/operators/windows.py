"""Ranks and running totals, within groups by windows and over a whole table without one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.lineage import cut_lineage

BUCKETS = 64


def bucketed(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket_ grows with key; approximate quantiles make buckets of like size, in a list of bounded length."""
    edges = sorted(set(df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.005)))
    at = F.lit(0)
    for e in edges:
        at = at + (F.col(key) > e).cast("int")
    return df.withColumn("bucket_", at)


def running_totals(df: DataFrame, key: str, sums: dict[str, str], descending: bool = True, by: list[str] | None = None) -> DataFrame:
    """Sums of columns over all rows up to each, in order of key, whose values are distinct within `by`.

    Buckets of the key are summed first; a row adds those before its bucket to the running sum within it. The rows are
    written once, since where to cut, the sums and the rows themselves all need them.
    """
    by, df = by or [], cut_lineage(df)
    cut = bucketed(df, key)
    total = cut.groupBy(*by, "bucket_").agg(*(F.sum(c).alias(f"{n}_of_bucket") for n, c in sums.items()))
    order = F.desc("bucket_") if descending else F.asc("bucket_")
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*by, "bucket_", *(F.coalesce(F.sum(f"{n}_of_bucket").over(before), F.lit(0)).alias(f"{n}_before") for n in sums))
    within = Window.partitionBy(*by, "bucket_").orderBy(F.desc(key) if descending else F.asc(key)).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(total, [*by, "bucket_"])
    return out.select(*df.columns, *((F.col(f"{n}_before") + F.sum(c).over(within)).alias(n) for n, c in sums.items()))


def ordinal(df: DataFrame, score: str, tie: str, by: list[str], descending: bool = False) -> DataFrame:
    """place_ (from 0, ties by the tie column), average_ (from 1, ties share it), size_ of the tie and n_ of the group.

    Equal scores are counted before anything is ordered, so a group of a few categories is no task of its own.
    Rows whose score or group is null are left out. Rows meet the totals of their score where both are sorted: of a table with
    few columns Spark thinks too little, and would broadcast millions of scores.
    """
    blocks = cut_lineage(df.groupBy(*by, score).agg(F.count("*").alias("size_")))
    seen = running_totals(blocks, score, {"seen_": "size_"}, descending, by)
    n = blocks.groupBy(*by).agg(F.sum("size_").alias("n_"))
    within = F.row_number().over(Window.partitionBy(*by, score).orderBy(tie))
    out = df.withColumn("in_", within).join(seen.hint("merge"), [*by, score]).join(n, by)
    before = F.col("seen_") - F.col("size_")
    return out.select(*df.columns, (before + F.col("in_") - 1).alias("place_"), (before + (F.col("size_") + 1) / 2).alias("average_"), "size_", "n_")


def scaled_place(place: Column, n: Column) -> Column:
    """0 to 1; the only row of a group gets 0."""
    return F.when(n > 1, place / (n - 1)).otherwise(0.0)


def tile(place: Column, n: Column, tiles: int) -> Column:
    """Which of `tiles` parts, from 1, the row at a place from 0 lies in; the first parts take what is left over."""
    size, more = F.floor(n / tiles), n % tiles
    long = more * (size + 1)
    return F.when(place < long, F.floor(place / (size + 1))).otherwise(more + F.floor((place - long) / F.greatest(size, F.lit(1)))).cast("int") + 1


def leave_one_out(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """loo_count and loo_mean of the other rows of the group; null mean when alone."""
    stats = df.groupBy(*by).agg(F.count(value).alias("n_"), F.sum(value).alias("s_"))
    out = df.join(stats, by)
    return out.select(*df.columns, (F.col("n_") - 1).alias("loo_count"), F.when(F.col("n_") > 1, (F.col("s_") - F.col(value)) / (F.col("n_") - 1)).alias("loo_mean"))


def first_per_key(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row for each key, by a minimum that is combined before the shuffle."""
    rest = [c for c in df.columns if c not in by and c not in order]
    return df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("first_")).select(*by, "first_.*").select(*df.columns)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def quantiles(df: DataFrame, value: str, tie: str, by: list[str], shares: list[float]) -> DataFrame:
    """by and quantiles, exact and with linear interpolation: rows are numbered, and only those that a share asks for are kept."""
    placed = ordinal(df, value, tie, by).select(*by, "place_", "n_", value)
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares))))
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n")).select(*by, "n", wanted.alias("w")).select(*by, "w.i", (F.col("w.s") * (F.col("n") - 1)).alias("at"))
    ends = sizes.select(*by, "i", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("place_"))
    met = ends.join(placed, [*by, "place_"])
    share = F.when(F.floor("at") == F.ceil("at"), 1.0).when(F.col("place_") == F.floor("at"), F.ceil("at") - F.col("at")).otherwise(F.col("at") - F.floor("at"))
    each = met.groupBy(*by, "i").agg(F.sum(F.col(value) * share).alias("q"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("quantiles"))
