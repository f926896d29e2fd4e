"""Entity resolution: keys, edges, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.lineage import cut_lineage, drop_tables, settled
from shelfwise.operators.windows import bucketed, ordinal


def star_edges(rows: DataFrame, key: str, node: str, cap: int | None = None) -> DataFrame:
    """(left_id, right_id): from each key's smallest node to its others; keys over the cap give none, empty keys neither."""
    held = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key, node).distinct()
    degree = held.groupBy(key).agg(F.min(node).alias("left_id"), F.count("*").alias("degree_")).where("degree_ > 1")
    if cap:
        degree = degree.where(F.col("degree_") <= cap)
    return held.join(degree, key).where(F.col(node) != F.col("left_id")).select("left_id", F.col(node).alias("right_id")).distinct()


def key_degrees(rows: DataFrame, key: str, node: str, cap: int) -> DataFrame:
    """Each key with its distinct nodes and whether the cap admits it."""
    return rows.groupBy(key).agg(F.countDistinct(node).alias("degree")).withColumn("admitted", (F.col("degree") > 1) & (F.col("degree") <= cap))


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node and component, the smallest node it is connected to: hooking to the smallest neighbour, and doubling paths."""
    mapping = nodes.select(F.col(node).alias("node"), F.col(node).alias("component")).distinct()
    left = settled(edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).where("a != b"))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        once = settled(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("component"), F.least("a", "b").alias("up")))
        twice = once.select(F.col("component").alias("up"), F.col("up").alias("top"))
        hook = settled(once.join(twice, "up", "left").select("component", F.coalesce("top", "up").alias("up")))
        moved = settled(mapping.join(hook, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        ends = left
        for end in ("a", "b"):
            ends = ends.join(hook.withColumnRenamed("component", end), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        ends = settled(ends.select("a", "b").where("a != b").distinct())
        drop_tables(once, hook, mapping, left)
        mapping, left = moved, ends
    drop_tables(left)
    return mapping


def overlap_pairs(rows: DataFrame, node: str, items: Column, least: int, share: float, rarest: int) -> DataFrame:
    """Pairs whose item sets share at least `least` items that at most `rarest` rows hold, with Jaccard of all items >= share."""
    sets = cut_lineage(rows.select(F.col(node).alias("node"), items.alias("items")).where(F.size("items") > 0))
    each = sets.select("node", F.size("items").alias("n"), F.explode("items").alias("item"))
    df = each.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    held = cut_lineage(each.join(df, "item"))
    common = held.groupBy("node").agg(F.count_if(F.col("df") > rarest).alias("common"))
    kept = held.where(F.col("df") <= rarest).join(common, "node")
    a, b = (kept.select("item", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("common").alias(f"common_{x}")) for x in ("a", "b"))
    pairs = a.join(b, "item").where("a < b").groupBy("a", "b", "n_a", "n_b", "common_a", "common_b").agg(F.count("*").alias("rare"))
    # Beside its rare items a pair shares at most the common ones of either set: pairs that can't be alike enough go before their items are met.
    most = F.least(F.col("rare") + F.least("common_a", "common_b"), F.least("n_a", "n_b"))
    pairs = pairs.where((F.col("rare") >= least) & (most >= share * (F.col("n_a") + F.col("n_b") - most)))
    one, two = (sets.select(F.col("node").alias(x), F.col("items").alias(f"items_{x}")) for x in ("a", "b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    out = pairs.join(one, "a").join(two, "b").withColumn("jaccard", both / (F.col("n_a") + F.col("n_b") - both))
    return out.where(F.col("jaccard") >= share).select("a", "b", "rare", "jaccard")


#: Rows of a group that meet at once, and items whose places are counted at once.
BLOCK_ROWS, ITEMS_AT_ONCE = 1024, 4096


def shared_counts(one: pa.ListArray, other: pa.ListArray) -> np.ndarray:
    """How many items each set of one shares with each of the other, by products of 0/1 matrices."""
    both = pa.concat_arrays([one, other])
    coded = both.flatten().dictionary_encode()
    rows, items = pa.compute.list_parent_indices(both).to_numpy(), coded.indices.to_numpy()
    out = np.zeros((len(one), len(other)), np.float32)
    for start in range(0, len(coded.dictionary), ITEMS_AT_ONCE):
        some = (items >= start) & (items < start + ITEMS_AT_ONCE)
        held = np.zeros((len(both), min(ITEMS_AT_ONCE, len(coded.dictionary) - start)), np.float32)
        held[rows[some], items[some] - start] = 1
        out += held[: len(one)] @ held[len(one) :].T
    return out


def contained_pairs(rows: DataFrame, node: str, by: list[str], items: str) -> DataFrame:
    """a, b and containment (to nine digits) of all pairs a < b that share the columns `by`: what of the lesser set of items the other holds.

    A group is cut into blocks of about BLOCK_ROWS rows and each pair of blocks is one piece of work, so a group of any size is
    spread; items are strings, distinct within a row. Rows where a column of `by` is null meet nothing.
    """
    rows = rows.select(*by, F.col(node).cast("bigint").alias("node"), F.col(items).alias("items")).dropna(subset=by)
    blocks = rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    each = rows.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    each = each.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = [F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")]

    def run(table: pa.Table) -> pa.Table:
        at = pa.compute.equal(table.column("block"), table.column("low"))
        inside = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        one, other = (table, table) if inside else (table.filter(at), table.filter(pa.compute.invert(at)))
        ids = [x.column("node").to_numpy() for x in (one, other)]
        sets = [x.column("items").combine_chunks() for x in (one, other)]
        least = np.minimum.outer(*(pa.compute.list_value_length(x).to_numpy() for x in sets))
        i, j = np.nonzero(np.less.outer(*ids) if inside else np.not_equal.outer(*ids))
        share = shared_counts(*sets)[i, j].astype(np.float64) / np.maximum(least[i, j], 1)
        a, b = ids[0][i], ids[1][j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "containment": np.floor(share * 1e9 + 0.5) / 1e9})

    return each.select(*by, *cell, "block", "node", "items").groupBy(*by, "low", "high").applyInArrow(run, "a bigint, b bigint, containment double")


def hamming_pairs(rows: DataFrame, node: str, value: str, bits: int, most: int) -> DataFrame:
    """Pairs (a, b, distance) whose values differ in at most `most` of their bits.

    The bits are cut into most + 1 bands, of which one at least is equal in such a pair; equal values meet once by value.
    """
    width = -(-bits // (most + 1))
    band = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.shiftright(F.col(value), i * width).bitwiseAND(2**width - 1).alias("v")) for i in range(most + 1))))
    each = rows.select(F.col(node).alias("node"), F.col(value).alias("h"), band.alias("band"))
    a, b = (each.select("band", F.col("node").alias(x), F.col("h").alias(f"h_{x}")) for x in ("a", "b"))
    distance = F.bit_count(F.col("h_a").bitwiseXOR(F.col("h_b")))
    return a.join(b, "band").where("a < b").withColumn("distance", distance).where(F.col("distance") <= most).select("a", "b", "distance").distinct()


def nearest_below(queries: DataFrame, donors: DataFrame, key: str, value: str) -> DataFrame:
    """queries with below, the greatest donor key not above theirs, and prior, that donor's value.

    Donor keys are distinct. Both sides are cut into the same ranges; a range's queries before its first donor take
    the last donor of the ranges before, so no range sees more than its own rows and one carried row.
    """
    both = queries.withColumn("donor_", F.lit(None).cast("struct<k:double,v:double>")).withColumn("query_", F.lit(1)).unionByName(
        donors.select(key, F.struct(F.col(key).cast("double").alias("k"), F.col(value).cast("double").alias("v")).alias("donor_"), F.lit(0).alias("query_")), allowMissingColumns=True
    )
    cut = bucketed(both, key)
    ends = cut.groupBy("bucket_").agg(F.max("donor_").alias("end_"))
    ends = ends.select("bucket_", F.max("end_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))
    near = F.max("donor_").over(Window.partitionBy("bucket_").orderBy(key, "query_").rowsBetween(Window.unboundedPreceding, 0))
    found = cut.withColumn("near_", near).join(F.broadcast(ends), "bucket_").where("query_ = 1").withColumn("near_", F.coalesce("near_", "carried_"))
    return found.select(*queries.columns, F.col("near_.k").alias("below"), F.col("near_.v").alias("prior"))


def nearest(queries: DataFrame, donors: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """key, donor, value and rank of the k donors of nearest key, of two as near the smaller; donor keys are distinct.

    Donors are numbered in order of their keys and a query looks up the 2 k numbers around its own place, so no task
    meets more donors than its queries need. The place comes from the greatest donor below.
    """
    numbered = ordinal(donors.select(key, value).withColumn("all_", F.lit(0)), key, key, ["all_"]).select(F.col(key).alias("donor"), value, F.col("place_").alias("number"))
    below = nearest_below(queries.select(key).distinct(), numbered.select(F.col("donor").alias(key), "number"), key, "number")
    around = F.explode(F.sequence(F.coalesce("prior", F.lit(-1)).cast("bigint") - (k - 1), F.coalesce("prior", F.lit(-1)).cast("bigint") + k))
    met = below.select(key, around.alias("number")).join(numbered, "number").withColumn("gap_", F.abs(F.col(key) - F.col("donor")))
    place = F.row_number().over(Window.partitionBy(key).orderBy("gap_", "donor"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select(key, "donor", value, "rank")
