"""Projections, joins, aggregates, sets, components and samples over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions import geometry
from shelfwise.functions import text as T
from shelfwise.operators import resolution, splits, windows
from shelfwise.queries import query

c = F.col

# ---- projections and predicates ----


@query("SELECT event_id, trim(CAST(CAST(value AS BIGINT) AS VARCHAR)) AS normal_id, coalesce(props, '') AS props, value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AS finite FROM (SELECT event_id, floor(value) AS value, props FROM events)", "events")
def prj6_id_normal(d):
    v = F.floor("value")
    return d.select("event_id", F.trim(v.cast("bigint").cast("string")).alias("normal_id"), F.coalesce("props", F.lit("")).alias("props"), (c("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).alias("finite"))


@query("SELECT event_id, len(list_filter(json_keys(props), lambda k: k <> 'k')) AS extra, NOT list_contains(json_keys(props), 'k') AS missing FROM events", "events")
def prj20_key_sets(d):
    keys = F.json_object_keys("props")
    return d.select("event_id", F.size(F.array_except(keys, F.array(F.lit("k")))).cast("bigint").alias("extra"), (~F.array_contains(keys, "k")).alias("missing"))


@query("SELECT id, CASE WHEN category LIKE '1%' THEN 'urgent' WHEN score > 300000 THEN 'large' WHEN label = 1 THEN 'filled' ELSE 'other' END AS flag FROM cards", "cards")
def prj22_first_flag(d):
    return d.select("id", F.when(c("category").startswith("1"), "urgent").when(c("score") > 300000, "large").when(c("label") == 1, "filled").otherwise("other").alias("flag"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE score > 50000) AS priced, count(*) FILTER (WHERE score > 50000 AND label = 1) AS filled, count(*) FILTER (WHERE score > 50000 AND label = 1 AND fold <> 0) AS donors FROM cards", "cards")
def prj23_survivors(d):
    """Survivors after each predicate, in one pass."""
    a, b = c("score") > 50000, c("label") == 1
    return d.agg(F.count("*").alias("total"), F.count_if(a).alias("priced"), F.count_if(a & b).alias("filled"), F.count_if(a & b & (c("fold") != 0)).alias("donors"))


# ---- joins ----


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS quantity, a.category, b.label FROM lineitem JOIN cards a ON l_orderkey = a.id JOIN cards b ON b.id = a.id AND b.fold = a.fold")
def jn2_composite(t):
    d = t("cards")
    lines = t("lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), c("l_quantity").alias("quantity"))
    return lines.join(d.select("id", "fold", "category"), "id").join(d.select("id", "fold", "label"), ["id", "fold"]).select("id", "line", "quantity", "category", "label")


@query("SELECT p_partkey AS part, coalesce(n, 0) AS sold FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) ON l_partkey = p_partkey")
def jn7_lookup_default(t):
    n = t("lineitem").where("l_quantity > 45").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t("part").join(n, "p_partkey", "left").select(c("p_partkey").alias("part"), F.coalesce("n", F.lit(0)).alias("sold"))


@query("SELECT a.id AS a, b.id AS b, a.family AS key FROM cards a JOIN cards b ON a.family = b.family AND a.id < b.id WHERE a.family IN (SELECT family FROM cards GROUP BY family HAVING count(*) <= 16)")
def jn15_pairs_within_key(t):
    """Pairs of a key that at most 16 rows hold: the cap is the operator's rule, and bounds its output."""
    d = t("cards").select("id", "family")
    few = d.groupBy("family").agg(F.count("*").alias("n")).where(c("n").between(2, 16)).select("family")
    kept = d.join(few, "family")
    return kept.select("family", c("id").alias("a")).join(kept.select("family", c("id").alias("b")), "family").where("a < b").select("a", "b", c("family").alias("key"))


@query("WITH h AS (SELECT id, ('0x' || substring(md5(CAST(id // 3 AS VARCHAR)), 1, 15))::BIGINT AS h FROM cards), k AS (SELECT id, xor(h, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 5 ELSE 1048577 END) AS h FROM h) SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM k a JOIN k b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 4")
def jn23_hamming(t):
    """Pairs of 60-bit hashes at a distance of at most 4: five bands of 12 bits, of which one at least must be equal."""
    d = t("cards")
    flip = F.when(c("id") % 3 == 0, 0).when(c("id") % 3 == 1, 5).otherwise(1048577).cast("bigint")
    h = F.conv(F.substring(F.md5(F.floor(c("id") / 3).cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    return resolution.hamming_pairs(d.select("id", h.bitwiseXOR(flip).alias("h")), "id", "h", 60, 4)


@query("WITH q AS (SELECT id, score FROM cards WHERE fold = 0), d AS (SELECT score, avg(label) AS label FROM cards WHERE fold <> 0 GROUP BY score), m AS (SELECT q.id, max(d.score) AS below FROM q LEFT JOIN d ON d.score <= q.score GROUP BY q.id) SELECT m.id, below, round(d.label, 6) AS prior FROM m LEFT JOIN d ON d.score = below")
def jn24_nearest_below(t):
    """The nearest donor value at or below each query's: both sides in one order, cut into ranges of like size."""
    d = t("cards")
    donors = d.where("fold != 0").groupBy("score").agg(F.avg("label").alias("label"))
    return resolution.nearest_below(d.where("fold = 0").select("id", "score"), donors, "score", "label").select("id", "below", F.round("prior", 6).alias("prior"))


@query("SELECT event_id, n_nationkey AS nation, contains(props, CAST(n_nationkey AS VARCHAR)) AS inside FROM events JOIN nation ON user_id % 25 = n_nationkey")
def jn25_substring(t):
    both = t("events").withColumn("n_nationkey", (c("user_id") % 25).cast("int")).join(F.broadcast(t("nation").select("n_nationkey")), "n_nationkey")
    return both.select("event_id", c("n_nationkey").alias("nation"), F.contains("props", c("n_nationkey").cast("string")).alias("inside"))


@query("SELECT category, i / 10 AS threshold, count(*) FILTER (WHERE score / 600000 >= i / 10) AS predicted, coalesce(sum(label) FILTER (WHERE score / 600000 >= i / 10), 0)::BIGINT AS tp FROM cards, range(10) g(i) GROUP BY ALL", "cards")
def jn28_parameter_grid(d):
    """All thresholds of a fixed list, as conditional counts in one pass: rows are never multiplied by the grid."""
    at = c("score") / 600000
    counts = [F.struct(F.lit(i / 10).alias("threshold"), F.count_if(at >= i / 10).alias("predicted"), F.coalesce(F.sum(F.when(at >= i / 10, c("label")).cast("bigint")), F.lit(0)).alias("tp")) for i in range(10)]
    return d.groupBy("category").agg(F.array(*counts).alias("g")).select("category", F.inline("g"))


# ---- aggregates ----


@query("SELECT category, count(DISTINCT family) AS families, count(DISTINCT family) FILTER (WHERE fold > 0) AS of_donors, median(score) AS middle FROM cards GROUP BY category", "cards")
def agg6_filtered_distinct(d):
    middle = windows.quantiles(d, "score", "id", ["category"], [0.5]).select("category", c("quantiles")[0].alias("middle"))
    counts = d.groupBy("category").agg(F.countDistinct("family").alias("families"), F.countDistinct(F.when(c("fold") > 0, c("family"))).alias("of_donors"))
    return counts.join(middle, "category")


@query("SELECT category, list_min(l) AS least, l[CAST(round_even((len(l) - 1) * 0.5, 0) AS INTEGER) + 1] AS middle, l[CAST(round_even((len(l) - 1) * 0.95, 0) AS INTEGER) + 1] AS high, list_max(l) AS most FROM (SELECT category, list_sort(list(CAST(floor(score) AS BIGINT))) AS l FROM cards GROUP BY category)", "cards")
def agg11_integer_quantiles(d):
    """Elements at the place round((n - 1) f), halves to even, of the sorted values: places, not a list, are kept."""
    v = windows.ordinal(d.select("id", "category", F.floor("score").alias("v")), "v", "id", ["category"])
    at = lambda f: F.max(F.when(c("place_") == F.bround((c("n_") - 1) * f, 0).cast("bigint"), c("v")))
    return v.groupBy("category").agg(F.min("v").alias("least"), at(0.5).alias("middle"), at(0.95).alias("high"), F.max("v").alias("most"))


@query("SELECT l_orderkey AS id, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_linestatus = 'F') AS all_filled FROM lineitem GROUP BY ALL", "lineitem")
def agg21_any_all(d):
    return d.groupBy(c("l_orderkey").alias("id")).agg(F.bool_or(c("l_returnflag") == "R").alias("any_returned"), F.bool_and(c("l_linestatus") == "F").alias("all_filled"))


# ---- sets ----


@query("SELECT id, 'low' AS part FROM cards WHERE score < 100000 UNION ALL SELECT id, 'zero' FROM cards WHERE fold = 0")
def set1_union_all(t):
    d = t("cards")
    return d.where("score < 100000").select("id", F.lit("low").alias("part")).unionByName(d.where("fold = 0").select("id", F.lit("zero").alias("part")))


@query("SELECT family FROM cards WHERE fold = 0 UNION SELECT family FROM cards WHERE label = 1")
def set4_union(t):
    return t("cards").where("fold = 0 OR label = 1").select("family").distinct()


# ---- vectors and geometry ----


@query("SELECT vec_id, round(list_sum(u), 5) AS total, round(list_sum(list_transform(u, lambda x: abs(x))), 5) AS l1 FROM (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))", "embeddings")
def fn13_l2_normal(d):
    u = T.once(c("embedding").cast("array<double>"), lambda v: T.once(F.greatest(F.sqrt(T.dot(v, v)), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return d.withColumn("u", u).select("vec_id", F.round(total(c("u")), 5).alias("total"), F.round(total(F.transform("u", F.abs)), 5).alias("l1"))


@query("WITH b AS (SELECT id, id % 50 AS x, id % 37 AS y, 5 + id % 11 AS w, 3 + id % 7 AS h FROM cards), q AS (SELECT *, greatest(least(x + w, 25) - greatest(x, 10), 0) * greatest(least(y + h, 20) - greatest(y, 5), 0) AS i FROM b) SELECT id, CAST(w * h AS DOUBLE) AS area, round(i / (w * h + 225 - i), 6) AS iou FROM q", "cards")
def fn28_boxes(d):
    x, y = c("id") % 50, c("id") % 37
    right, low = x + 5 + c("id") % 11, y + 3 + c("id") % 7
    quad = F.array(F.array(x, y), F.array(right, y), F.array(right, low), F.array(x, low))
    other = F.struct(F.lit(10).alias("x0"), F.lit(5).alias("y0"), F.lit(25).alias("x1"), F.lit(20).alias("y1"))
    return d.withColumn("quad", quad).select("id", geometry.area(c("quad")).alias("area"), F.round(geometry.iou(geometry.box(c("quad")), other), 6).alias("iou"))


# ---- components and invariants ----


@query("SELECT family, sha256(string_agg(CAST(id AS VARCHAR), chr(0) ORDER BY CAST(id AS VARCHAR))) AS component, count(*) AS size, count(*) > greatest(1, floor(0.02 * (SELECT count(*) FROM cards))) AS oversized, count(DISTINCT fold) = 1 AS safe, count(DISTINCT category) > 1 AS mixed FROM cards GROUP BY family", "cards")
def er16_component_audit(d):
    """Each component's digest of ids, size, and whether it is too large, within one fold, and of several categories.

    A component whose ids are too many for one task belongs in the oversized report, which needs counts only.
    """
    n = d.count()
    ids = F.array_join(F.array_sort(F.collect_list(c("id").cast("string"))), "\0")
    return d.groupBy("family").agg(
        F.sha2(ids, 256).alias("component"), F.count("*").alias("size"), (F.count("*") > max(1, int(0.02 * n))).alias("oversized"),
        (F.countDistinct("fold") == 1).alias("safe"), (F.countDistinct("category") > 1).alias("mixed"),
    )


@query("SELECT user_id, event_type, count(DISTINCT value) AS identities FROM events GROUP BY ALL HAVING count(DISTINCT value) > 1", "events")
def er6_cross_identity_keys(d):
    return d.groupBy("user_id", "event_type").agg(F.countDistinct("value").alias("identities")).where("identities > 1")


# ---- samples ----

RANK = "substring(sha256('{0}' || chr(0) || CAST(id AS VARCHAR)), 1, 32)"


def rank(seed: str):
    return T.stable_rank(F.lit(seed), c("id").cast("string"))


@query(f"WITH k AS (SELECT id, category, label, {RANK.format('valid')} AS key FROM cards), r AS (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY key) AS place, count(*) OVER (PARTITION BY category, label) AS n FROM k) SELECT id, CASE WHEN place <= floor(n * 22 / 100) THEN 'valid' ELSE 'train' END AS part FROM r")
def smp6_stratified_split(t):
    """Exactly 22 % of each stratum, by the order of hashes; hashes are counted by their first digits before they are ordered."""
    return splits.exact_share(t("cards"), ["category", "label"], rank("valid"), 22, "id").select("id", F.when(c("chosen"), "valid").otherwise("train").alias("part"))


@query(f"SELECT id, family FROM (SELECT id, family, row_number() OVER (PARTITION BY family ORDER BY {RANK.format('one')}) AS r FROM cards) WHERE r = 1")
def smp28_component_representatives(t):
    return windows.first_per_key(t("cards").select("family", rank("one").alias("key"), "id"), ["family"], ["key"]).select("id", "family")


@query("SELECT id, family, CASE WHEN r = 1 THEN 'cover' ELSE 'extra' END AS slot FROM (SELECT id, family, score, row_number() OVER (PARTITION BY family ORDER BY score, id) AS r FROM cards) WHERE r <= 2")
def smp12_family_cover(t):
    """The hardest row of each family and the next, by two minima that combine before the shuffle."""
    d = t("cards").select("family", "score", "id")
    first = windows.first_per_key(d, ["family"], ["score", "id"])
    second = windows.first_per_key(d.join(first.select("id"), "id", "left_anti"), ["family"], ["score", "id"])
    return first.withColumn("slot", F.lit("cover")).unionByName(second.withColumn("slot", F.lit("extra"))).select("id", "family", "slot")


@query("SELECT l_orderkey AS id, l_linenumber AS line FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1 + l_orderkey % n")
def smp32_gallery_cycle(t):
    """One child of each row, by a cycle over its children that the id decides."""
    w = Window.partitionBy("l_orderkey")
    d = t("lineitem").select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("r"))
    return d.where(c("r") == 1 + c("l_orderkey") % c("n")).select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"))


@query("SELECT family, count(DISTINCT fold) AS folds, count(DISTINCT category) AS categories FROM cards GROUP BY family HAVING count(DISTINCT fold) > 1 OR count(DISTINCT category) > 1", "cards")
def gov2_invariant_faults(d):
    """Components that cross folds or categories: a sealed table has none."""
    return d.groupBy("family").agg(F.countDistinct("fold").alias("folds"), F.countDistinct("category").alias("categories")).where("folds > 1 OR categories > 1")
