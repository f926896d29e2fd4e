"""Scores of binary predictions, from counts that combine before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.windows import running_totals


def confusion(label: Column, predicted: Column) -> list[Column]:
    count = lambda y, p: F.sum(((label == y) & (predicted == p)).cast("bigint"))
    return [count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn")]


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing is positive or predicted so."""
    whole = 2 * tp + fp + fn
    return F.when(whole > 0, 2 * tp / whole).otherwise(0.0)


def f1_by(df: DataFrame, by: list[str], label: str, predicted: str) -> DataFrame:
    counts = df.groupBy(*by).agg(*confusion(F.col(label), F.col(predicted)))
    return counts.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(df: DataFrame, by: str, label: str, predicted: str) -> DataFrame:
    return f1_by(df, [by], label, predicted).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("categories"))


def score_blocks(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Each distinct score with its rows and positives, and both counted from the highest score down to it."""
    by = by or []
    blocks = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    return running_totals(blocks, score, {"seen": "n", "tp": "pos"}, by=by)


def average_precision(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Equal scores are one step. Null without positives."""
    by = by or []
    step = F.col("pos") * F.col("tp") / F.col("seen")
    return score_blocks(df, score, label, by).groupBy(*by).agg(F.sum("pos").alias("positives"), (F.sum(step) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"))


def best_threshold(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """The score at or above which predicting 1 gives the best F1; of equals the highest. Only ends of ties count."""
    blocks = score_blocks(df, score, label, by)
    total = blocks.groupBy(*by).agg(F.sum("pos").alias("all_pos"))
    scored = blocks.join(total, by).withColumn("f1", f1(F.col("tp"), F.col("seen") - F.col("tp"), F.col("all_pos") - F.col("tp")))
    best = scored.groupBy(*by).agg(F.max(F.struct("f1", score)).alias("best"))
    return best.select(*by, F.col(f"best.{score}").alias("threshold"), "best.f1")


def row_sweep(df: DataFrame, score: str, label: str, tie: Column) -> DataFrame:
    """Every row with seen and tp: rows and positives from the highest score down to it, equal scores in order of tie."""
    blocks = score_blocks(df, score, label).withColumnsRenamed({"n": "n_", "pos": "pos_", "seen": "seen_", "tp": "tp_"})
    w = Window.partitionBy(score).orderBy("tie_").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("tie_", tie).withColumn("row_", F.count("*").over(w)).withColumn("hit_", F.sum(F.col(label).cast("bigint")).over(w)).join(blocks, score)
    return out.select(*df.columns, (F.col("seen_") - F.col("n_") + F.col("row_")).alias("seen"), (F.col("tp_") - F.col("pos_") + F.col("hit_")).alias("tp"))
