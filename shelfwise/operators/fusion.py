"""Blending, thresholds and overrides of score columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators.metrics import f1, score_blocks

STEPS = 100


def simplex(parts: int, units: int) -> Iterator[tuple[float, ...]]:
    """All weights of `parts` heads that are multiples of 1 / units and sum to 1."""
    for w in product(range(units + 1), repeat=parts):
        if sum(w) == units:
            yield tuple(x / units for x in w)


def weight_table(spark: SparkSession, parts: int, units: int) -> DataFrame:
    """weight_id and weights: its size depends on the parameters only."""
    return spark.createDataFrame([(i, list(w)) for i, w in enumerate(simplex(parts, units))], "weight_id int, weights array<double>")


def weighted(scores: list[Column], weights: Column) -> Column:
    return sum((s * weights[i] for i, s in enumerate(scores)), F.lit(0.0))


def sweep_threshold(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Best F1 over cuts after any distinct score; the threshold is the midpoint to the next lower one (or the last itself)."""
    blocks = score_blocks(df, score, label, by)
    total = blocks.groupBy(*by).agg(F.sum("pos").alias("all_pos"))
    scored = blocks.join(total, by).withColumn("f1", f1(F.col("tp"), F.col("seen") - F.col("tp"), F.col("all_pos") - F.col("tp")))
    best = scored.groupBy(*by).agg(F.max(F.struct("f1", score)).alias("best")).select(*by, "best.f1", F.col(f"best.{score}").alias("at_"))
    lower = blocks.join(best, by).where(F.col(score) < F.col("at_")).groupBy(*by).agg(F.max(score).alias("next_"))
    out = best.join(lower, by, "left")
    return out.select(*by, ((F.col("at_") + F.coalesce("next_", "at_")) / 2).alias("threshold"), "f1")


def grid_thresholds(df: DataFrame, score: str, label: str, by: list[str], fold: str) -> DataFrame:
    """For each outer fold, the threshold (a hundredth from 0 to 1) of best F1 on the rows of all other folds.

    Scores become counts in hundredths, so what is swept is bounded by groups, folds and steps. Of equals the lowest.
    """
    step = F.least(F.greatest(F.floor(F.round(F.col(score) * STEPS, 6)), F.lit(0)), F.lit(STEPS)).cast("int")
    cells = df.groupBy(*by, fold, step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    whole = cells.groupBy(*by, "step").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    folds = cells.select(*by, fold).distinct()
    own = cells.select(*by, fold, "step", F.col("n").alias("n_own"), F.col("pos").alias("pos_own"))
    others = folds.join(whole, by).join(own, [*by, fold, "step"], "left")
    others = others.select(*by, fold, "step", (F.col("n") - F.coalesce("n_own", F.lit(0))).alias("n"), (F.col("pos") - F.coalesce("pos_own", F.lit(0))).alias("pos"))
    w = Window.partitionBy(*by, fold)
    down = w.orderBy(F.desc("step"))
    swept = others.select(*by, fold, "step", F.sum("n").over(down).alias("seen"), F.sum("pos").over(down).alias("tp"), F.sum("pos").over(w).alias("all_pos"))
    swept = swept.withColumn("f1", F.round(f1(F.col("tp"), F.col("seen") - F.col("tp"), F.col("all_pos") - F.col("tp")), 9))
    best = swept.groupBy(*by, fold).agg(F.max(F.struct("f1", (-F.col("step")).alias("neg"))).alias("b"))
    return best.select(*by, fold, (-F.col("b.neg") / STEPS).alias("threshold"), F.col("b.f1").alias("f1"))


def nested_selection(df: DataFrame, heads: list[str], label: str, category: str, fold: str, units: int) -> DataFrame:
    """For each category and outer fold the weights and threshold chosen on the other folds; ties go to the first weights."""
    grid = weight_table(df.sparkSession, len(heads), units)
    rows = df.select(category, fold, label, F.explode(F.array(*(
        F.struct(F.lit(i).alias("weight_id"), weighted([F.col(h) for h in heads], F.array(*map(F.lit, w))).alias("blend"))
        for i, w in enumerate(simplex(len(heads), units))
    ))).alias("g")).select(category, fold, label, "g.*")
    scored = grid_thresholds(rows, "blend", label, [category, "weight_id"], fold)
    best = scored.groupBy(category, fold).agg(F.max(F.struct("f1", (-F.col("weight_id")).alias("neg"), "threshold")).alias("b"))
    chosen = best.select(category, fold, (-F.col("b.neg")).alias("weight_id"), F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))
    return chosen.join(F.broadcast(grid), "weight_id").select(category, fold, "weight_id", "weights", "threshold", "f1")


def logit(p: Column, floor: float = 1e-6) -> Column:
    inside = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.log(inside / (1 - inside))


def routed(category: Column, scores: list[Column], rules: dict[str | None, tuple[list[float], float]]) -> Column:
    """Whether the weighted score of a row's category reaches its threshold; the rule of None holds for all others."""
    said = lambda rule: (weighted(scores, F.array(*map(F.lit, rule[0]))) >= rule[1]).cast("int")
    out = said(rules[None]) if None in rules else F.lit(None).cast("int")
    for name, rule in rules.items():
        if name is not None:
            out = F.when(category == name, said(rule)).otherwise(out)
    return out


def aligned(seeds: list[DataFrame], key: str, same: list[str], score: str) -> DataFrame:
    """key, the columns that all seeds must agree on, the mean score and the number of seeds; what doesn't agree is an error."""
    out = None
    for i, seed in enumerate(seeds):
        part = seed.select(key, *same, F.col(score).alias("score"), F.lit(i).alias("seed"))
        out = part if out is None else out.unionByName(part)
    agree = reduce(lambda a, b: a & b, [F.min(c).eqNullSafe(F.max(c)) for c in same])
    whole = (F.count("*") == len(seeds)) & (F.countDistinct("seed") == len(seeds))
    mean = F.when(agree & whole, F.avg("score")).otherwise(F.raise_error(F.lit("seeds don't align")).cast("double"))
    return out.groupBy(key).agg(*(F.min(c).alias(c) for c in same), mean.alias("score"), F.count("*").alias("seeds"))
