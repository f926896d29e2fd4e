"""Neighbours by shared rare items, and what their labels say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.lineage import cut_lineage

c = F.col


def shared_items(rows: DataFrame, node: str, category: str, items: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """node, category, size, item and df of items that 2 to `most` rows hold; and all nodes with how many rows there are.

    Items are made once and written, since their frequencies, and both sides of the pairs, need them.
    """
    held = cut_lineage(rows.select(c(node).alias("node"), c(category).alias("category"), items.alias("items")).select("node", "category", F.size("items").alias("size"), F.explode("items").alias("item")))
    rare = held.groupBy("item").agg(F.count("*").alias("df")).where(c("df").between(2, most))
    return cut_lineage(held.join(rare, "item")), rows


def pairs(held: DataFrame, least: int, *sums: Column) -> DataFrame:
    """node, neighbour, size, other and shared, and sums, of rows of one category that share `least` items at least. An
    item's pairs are bounded by the square of `most`."""
    side = held.select("item", "category", c("node").alias("neighbour"), c("size").alias("other"))
    both = held.join(side, ["item", "category"]).where("node != neighbour")
    return both.groupBy("node", "neighbour", "size", "other").agg(F.count("*").alias("shared"), *sums).where(c("shared") >= least)


def graph(rows: DataFrame, node: str, category: str, items: Column, most: int, least: int, containment: float, jaccard: float, k: int) -> DataFrame:
    """node, neighbour, shared, containment, jaccard and rank of the k best neighbours.

    Shared counts rare items only, sizes all of them: so rare items decide who meets, and long texts aren't favoured.
    """
    held, _ = shared_items(rows, node, category, items, most)
    shared = c("shared").cast("double")
    met = pairs(held, least).withColumn("containment", shared / F.least("size", "other")).withColumn("jaccard", shared / (c("size") + c("other") - shared))
    met = met.where((c("containment") >= containment) & (c("jaccard") >= jaccard))
    best = Window.partitionBy("node").orderBy(F.desc("containment"), F.desc("jaccard"), F.desc("shared"), F.desc("neighbour"))
    return met.withColumn("rank", F.row_number().over(best)).where(c("rank") <= k).select("node", "neighbour", "shared", "containment", "jaccard", "rank")


def weighted(rows: DataFrame, node: str, category: str, items: Column, most: int, least: int, containment: float, k: int) -> DataFrame:
    """node, neighbour, shared, containment (to six digits) and rank: items weigh by how few rows hold them."""
    held, whole = shared_items(rows, node, category, items, most)
    held = held.withColumn("weight", F.log((whole.count() + 1) / (c("df") + 1)) + 1)
    totals = held.groupBy("node").agg(F.sum("weight").alias("total"))
    met = pairs(held, least, F.sum("weight").alias("mass"))
    met = met.join(totals, "node").join(totals.select(c("node").alias("neighbour"), c("total").alias("other_total")), "neighbour")
    met = met.withColumn("containment", F.round(c("mass") / F.least("total", "other_total"), 6)).where(c("containment") >= containment)
    best = Window.partitionBy("node").orderBy(F.desc("containment"), "neighbour")
    return met.withColumn("rank", F.row_number().over(best)).where(c("rank") <= k).select("node", "neighbour", "shared", "containment", "rank")


def vote(found: DataFrame, donors: DataFrame, label: str, k: int, least: int, confidence: float) -> DataFrame:
    """node, donors and prediction: the mean of the first k neighbours that are donors, where it is sure enough; no ties."""
    some = found.join(donors, "neighbour").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("rank"))).where(c("place") <= k)
    mean = some.groupBy("node").agg(F.count("*").alias("donors"), F.avg(label).alias("m")).where(c("donors") >= least)
    return mean.where((c("m") != 0.5) & (F.greatest("m", 1 - c("m")) >= confidence)).select("node", "donors", (c("m") >= 0.5).cast("int").alias("prediction"))


def weighted_vote(candidates: DataFrame, weight: str, label: str, k: int) -> DataFrame:
    """query, n, rate and channels: the weighted mean label of each query's k heaviest donors, ties to the smaller one."""
    best = Window.partitionBy("query").orderBy(F.desc(weight), "donor")
    top = candidates.withColumn("rank", F.row_number().over(best)).where(c("rank") <= k)
    return top.groupBy("query").agg(F.count("*").alias("n"), (F.sum(c(weight) * c(label)) / F.sum(weight)).alias("rate"), F.max("channels").alias("channels"))
