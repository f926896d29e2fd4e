"""Label priors of families, taken from donors only."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def family_prior(donors: DataFrame, key: str, label: str, least: int = 1) -> DataFrame:
    """key, support and prior: the mean label of each family with enough donors."""
    return donors.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("support"), F.avg(label).alias("prior")).where(F.col("support") >= least)


def cascade(rows: DataFrame, donors: DataFrame, keys: list[str], label: str, row_id: str = "id") -> DataFrame:
    """Rows with prior and stage: the first key in order whose family has donors answers; null where none has."""
    out = rows
    for i, key in enumerate(keys):
        out = out.join(family_prior(donors, key, label).select(key, F.col("prior").alias(f"prior_{i}")), key, "left")
    found = [F.col(f"prior_{i}") for i in range(len(keys))]
    stage = reduce(lambda rest, i: F.when(found[i].isNotNull(), F.lit(keys[i])).otherwise(rest), reversed(range(len(keys))), F.lit(None).cast("string"))
    return out.select(*rows.columns, F.coalesce(*found).alias("prior"), stage.alias("stage"))


def cross_fold(rows: DataFrame, key: str, label: str, fold: str) -> DataFrame:
    """support and prior of each row's family from the rows of other folds: sums by fold are taken off the whole."""
    whole = rows.groupBy(key).agg(F.count("*").alias("n_"), F.sum(label).alias("s_"))
    own = rows.groupBy(key, fold).agg(F.count("*").alias("n_own_"), F.sum(label).alias("s_own_"))
    out = rows.join(whole, key).join(own, [key, fold])
    n = F.col("n_") - F.col("n_own_")
    return out.select(*rows.columns, n.alias("support"), F.when(n > 0, (F.col("s_") - F.col("s_own_")) / n).alias("prior"))


def majority(donors: DataFrame, keys: list[str], label: str, least: int, confidence: float) -> DataFrame:
    """keys and majority: the label of most donors of a key that at least `least` hold, where so large a share agrees; no ties."""
    held = donors.where(F.concat_ws("", *(F.col(k).cast("string") for k in keys)) != "").groupBy(*keys).agg(F.count("*").alias("n_"), F.avg(label).alias("m_"))
    sure = (F.col("n_") >= least) & (F.col("m_") != 0.5) & (F.greatest("m_", 1 - F.col("m_")) >= confidence)
    return held.where(sure).select(*keys, (F.col("m_") > 0.5).cast("int").alias("majority"), F.col("n_").alias("support"))


def posteriors(rows: DataFrame, donors: DataFrame, levels: list[tuple[str, list[str], int, float]], label: str, weight: float, rate: float) -> DataFrame:
    """rows with posterior and source: of the first level whose family holds enough donors and is sure enough, the mean
    label, drawn towards `rate` as by `weight` more donors. A level that asks for 999 donors or more is switched off."""
    out, found = rows, []
    for name, keys, least, confidence in levels:
        if least >= 999:
            continue
        held = donors.groupBy(*keys).agg(F.count("*").alias("n_"), F.sum(label).alias("s_"))
        held = held.withColumn("p_", (F.col("s_") + weight * rate) / (F.col("n_") + weight)).where((F.col("n_") >= least) & (F.greatest("p_", 1 - F.col("p_")) >= confidence))
        out = out.join(held.select(*keys, F.col("p_").alias(f"p_{name}")), keys, "left")
        found.append(name)
    source = reduce(lambda rest, n: F.when(F.col(f"p_{n}").isNotNull(), n).otherwise(rest), reversed(found), F.lit("none"))
    return out.select(*(F.col(c) for c in rows.columns), F.coalesce(*(F.col(f"p_{n}") for n in found)).alias("posterior"), source.alias("source"))


def unanimous(rows: DataFrame, donors: DataFrame, channels: list[tuple[str, list[str]]], label: str, least: int, most: int, row_id: str = "id") -> DataFrame:
    """row_id, label, channel and donors of rows for which some channel's donors, `least` to `most` of them, are of one mind;
    of several channels the first."""
    out = rows.drop(label)
    for name, keys in channels:
        held = donors.groupBy(*keys).agg(F.min(label).alias("lo_"), F.max(label).alias("hi_"), F.count("*").alias("n_")).where((F.col("lo_") == F.col("hi_")) & F.col("n_").between(least, most))
        out = out.join(held.select(*keys, F.struct(F.col("lo_").alias(label), F.lit(name).alias("channel"), F.col("n_").alias("donors")).alias(f"of_{name}")), keys, "left")
    return out.select(row_id, F.coalesce(*(F.col(f"of_{n}") for n, _ in channels)).alias("first_")).where("first_ IS NOT NULL").select(row_id, "first_.*")


def policy_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """A row for each combination of parameter values: its size depends on the parameters only."""
    return spark.createDataFrame(list(product(*values.values())), list(values)).select(*(F.col(n).cast("int" if isinstance(v[0], int) else "double").alias(n) for n, v in values.items()))
