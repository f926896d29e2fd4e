"""Comparing two sets of predictions: transitions, cohorts, and a bootstrap over components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.lineage import cut_lineage
from shelfwise.operators.windows import ordinal


def transition(label: Column, base: Column, candidate: Column) -> Column:
    right, now = base == label, candidate == label
    return F.when(right & now, "both_right").when(right, "regressed").when(now, "corrected").otherwise("both_wrong")


def cohorts(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """A row for each cohort that a row lies in; the number of cohorts is a parameter."""
    names = F.filter(F.array(*(F.when(F.coalesce(m, F.lit(False)), F.lit(n)) for n, m in masks.items())), lambda x: x.isNotNull())
    return df.withColumn("cohort", F.explode(names))


def survival(base: str, cand: str, base_after: str, cand_after: str) -> list[Column]:
    """Changes before and after a later step: how many there were, went, stayed and came, and the share that stayed."""
    before, after = F.col(base) != F.col(cand), F.col(base_after) != F.col(cand_after)
    stayed, were = F.count_if(before & after), F.count_if(before)
    rate = F.round(F.coalesce(stayed / F.nullif(were, F.lit(0)), F.lit(0.0)), 9)
    return [were.alias("changed"), F.count_if(before & ~after).alias("overridden"), stayed.alias("survived"), F.count_if(~before & after).alias("introduced"), rate.alias("rate")]


def pearson(a: str, b: str) -> Column:
    """Population form; null where a side doesn't vary."""
    x, y = F.col(a), F.col(b)
    spread = (F.avg(x * x) - F.pow(F.avg(x), 2)) * (F.avg(y * y) - F.pow(F.avg(y), 2))
    return F.when(spread > 0, (F.avg(x * y) - F.avg(x) * F.avg(y)) / F.sqrt(spread))


COUNTS = ("tp_0", "said_0", "tp_1", "said_1", "pos")


def counted(df: DataFrame, keys: list[str], label: str, base: str, candidate: str) -> DataFrame:
    """What F1 needs of each component and category, for both predictions: summed before any draw."""
    of = [(F.col(p), i) for i, p in enumerate((base, candidate))]
    return df.groupBy(*keys).agg(*(F.sum(F.col(label) * p).alias(f"tp_{i}") for p, i in of), *(F.sum(p).alias(f"said_{i}") for p, i in of), F.sum(label).alias("pos"))


def change(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys and delta: the candidate's F1 less the base's, from weighted counts."""
    score = [F.coalesce(2 * F.sum(F.col("w") * F.col(f"tp_{i}")) / F.nullif(F.sum(F.col("w") * (F.col(f"said_{i}") + F.col("pos"))), F.lit(0)), F.lit(0.0)) for i in (0, 1)]
    return sums.groupBy(*keys).agg((score[1] - score[0]).alias("delta"))


#: Draws that are made at once.
DRAWS = 10_000


def draws(components: DataFrame, by: list[str], repeats: int, seed: Column) -> DataFrame:
    """by, repeat, place and w: as many draws as there are components, with replacement, and how often each was drawn.

    components: by and n. A draw is the hash of the repeat and its number, so a lost task draws the same again and no list of
    components is gathered; parts of the draws are dealt to all tasks, and draws are counted before they meet the components.
    Spark takes this table for as small as `components`, so it asks for a merge join: it must never be broadcast.
    """
    last = F.floor((F.col("n") - 1) / DRAWS).cast("bigint")
    parts = components.where("n > 0").select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).select(*by, "n", "repeat", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    dealt = parts.repartition(4 * components.sparkSession.sparkContext.defaultParallelism, *by, "repeat", "part")
    each = dealt.select(*by, "n", "repeat", F.explode(F.sequence(F.col("part") * DRAWS, F.least((F.col("part") + 1) * DRAWS, "n") - 1)).alias("j"))
    digits = F.substring(F.sha2(F.concat_ws("\0", seed, F.col("repeat").cast("string"), F.col("j").cast("string")), 256), 1, 8)
    place = F.floor(F.conv(digits, 16, 10).cast("bigint") * F.col("n") / 4294967296.0).cast("bigint")
    return each.select(*by, "repeat", place.alias("place")).groupBy(*by, "repeat", "place").agg(F.count("*").alias("w")).hint("merge")


def multinomial_bootstrap(df: DataFrame, component: str, category: str, label: str, base: str, candidate: str, repeats: int, seed: str) -> DataFrame:
    """repeat and delta: the change in macro F1 when whole components are drawn anew, over all categories at once."""
    numbered = ordinal(df.select(component).distinct().withColumn("all_", F.lit(0)), component, component, ["all_"]).select(component, F.col("place_").cast("bigint").alias("place"), "n_")
    drawn = draws(numbered.select(F.col("n_").alias("n")).limit(1), [], repeats, F.lit(seed))
    sums = counted(df, [component, category], label, base, candidate)
    met = drawn.join(numbered.drop("n_"), "place").join(sums, component)
    return change(met, ["repeat", category]).groupBy("repeat").agg(F.avg("delta").alias("delta"))


def category_bootstrap(df: DataFrame, component: str, category: str, label: str, base: str, candidate: str, repeats: int) -> DataFrame:
    """repeat, category and delta: components are drawn anew within each category; the category seeds its draws."""
    sums = cut_lineage(counted(df, [component, category], label, base, candidate))
    numbered = ordinal(sums, component, component, [category]).withColumn("place", F.col("place_").cast("bigint"))
    drawn = draws(sums.groupBy(category).agg(F.count("*").alias("n")), [category], repeats, F.col(category).cast("string"))
    return change(drawn.join(numbered.select(category, "place", *COUNTS), [category, "place"]), ["repeat", category])
