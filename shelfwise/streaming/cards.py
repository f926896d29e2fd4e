"""Streams of cards: first of each fingerprint within a watermark, priors from a static table, windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, fingerprint: Column, time: str, late: str) -> DataFrame:
    """Rows whose fingerprint wasn't seen within `late`; state is kept no longer than that."""
    return stream.withColumn("fingerprint", fingerprint).withWatermark(time, late).dropDuplicatesWithinWatermark(["fingerprint"])


def with_priors(stream: DataFrame, priors: DataFrame, key: str) -> DataFrame:
    """A stream-static join: the prior of each row's family, null where it has none."""
    return stream.join(priors.select(key, "prior", "support"), key, "left")


def windowed(stream: DataFrame, time: str, width: str, late: str, by: list[str], value: str) -> DataFrame:
    """Count, sum and greatest of value for each window and group; a window is given out once the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *by).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")
    ).select(F.col("window.start").alias("start"), *by, "n", "total", "most")
