"""Channels of donors, prototypes, projected ranks, and what is sealed."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.functions import unicode as U
from shelfwise.operators import dense, resolution, windows
from shelfwise.plans.scores import HEADS, heads
from shelfwise.queries import query
from shelfwise.sources.scans import checked

c = F.col


@query(f"WITH {HEADS}, d AS (SELECT category, a, count(*) OVER (PARTITION BY category) AS n FROM heads WHERE fold <> 0), k AS (SELECT h.id, count(*) AS below, max(d.n) AS n FROM heads h JOIN d ON d.category = h.category AND d.a <= h.a WHERE h.fold = 0 GROUP BY h.id) SELECT h.id, round(least(1, greatest(0, (coalesce(below, 0) - 1) / (g.n - 1))), 9) AS rank FROM heads h JOIN (SELECT category, count(*) AS n FROM heads WHERE fold <> 0 GROUP BY category) g USING (category) LEFT JOIN k ON k.id = h.id WHERE h.fold = 0")
def win20_projected_rank(t):
    """Where an outer score would stand on the scale of the donors' ranks."""
    d = heads(t).withColumn("donor", (c("fold") != 0).cast("bigint"))
    blocks = d.groupBy("category", "a").agg(F.sum("donor").alias("donors"))
    seen = windows.running_totals(blocks, "a", {"below": "donors"}, descending=False, by=["category"])
    n = d.groupBy("category").agg(F.sum("donor").alias("n"))
    rank = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c("below") - 1) / (c("n") - 1)))
    return d.where("fold = 0").join(seen, ["category", "a"]).join(n, "category").select("id", F.round(rank, 9).alias("rank"))


@query("")  # the inverse of the normal distribution is beyond SQL; a test holds it against the standard library
def win7_normal_scores(t):
    """The normal quantile of each row's place, ties sharing theirs."""
    placed = windows.ordinal(t("cards"), "family", "id", ["category"])
    return placed.select("id", U.normal_quantile((c("average_") - 0.5) / c("n_")).alias("z"))


SHINGLES = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: substring('  ' || {0} || '  ', CAST(i AS INTEGER), 3)))"


@query(f"WITH p AS (SELECT p_partkey, p_brand, p_size, {SHINGLES.format('p_name')} AS s FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, round(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / least(len(a.s), len(b.s)), 9) AS containment FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def fn18_containment(t):
    """What of the lesser set of shingles the other holds."""
    d = t("part").select("p_partkey", "p_brand", "p_size", T.char_shingles(c("p_name")).alias("s"))
    return resolution.contained_pairs(d, "p_partkey", ["p_brand", "p_size"], "s")


@query("SELECT query, list(donor ORDER BY donor) AS donors FROM (SELECT a.id AS query, b.id AS donor, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS r FROM cards a JOIN cards b ON a.family = b.family AND a.fold <> b.fold) WHERE r <= 6 GROUP BY query")
def ret6_exact_channel(t):
    """The first donors of other folds with a row's key: six of each fold are enough to choose from."""
    d = t("cards").select("family", "fold", "id")
    few = windows.top_per_group(d, ["family", "fold"], [c("id")], 6).groupBy("family", "fold").agg(F.collect_list("id").alias("ids"))
    held = few.groupBy("family").agg(F.collect_list(F.struct("fold", "ids")).alias("held"))
    others = F.flatten(F.transform(F.filter("held", lambda h: h["fold"] != c("fold")), lambda h: h["ids"]))
    out = d.join(held, "family").select(c("id").alias("query"), F.slice(F.array_sort(others), 1, 6).alias("donors"))
    return out.where(F.size("donors") > 0)


COSINE = "list_cosine_similarity({0}, {1})"
VECTORS = "v AS (SELECT vec_id, label % 2 AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


@query(f"""WITH {VECTORS}, p AS (SELECT a.vec_id AS query, b.vec_id AS donor, a.y = b.y AS same, round({COSINE.format('a.x', 'b.x')}, 6) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 10 = 0)
SELECT query, donor, same, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query, same ORDER BY cosine DESC, donor) AS r FROM p) WHERE r = 1""")
def smp20_nearest_pairs(t):
    """For each prototype the nearest of its own label and the nearest of the other."""
    e = t("embeddings").withColumn("y", c("label") % 2)
    asked, out = e.where("vec_id % 10 = 0"), None
    for y in (0, 1):
        best = dense.top_k(asked, e.where(c("y") == y), "vec_id", "embedding", 1).select("query", "donor", "cosine", F.lit(y).alias("y_donor"))
        out = best if out is None else out.unionByName(best)
    labels = asked.select(c("vec_id").alias("query"), "y")
    return out.join(labels, "query").select("query", "donor", (c("y") == c("y_donor")).alias("same"), "cosine")


@query(f"""WITH {VECTORS}, e AS (SELECT vec_id % 30 * 2 + y AS family, y, unnest(range(len(x))) AS i, unnest(x) AS x FROM v), m AS (SELECT family, min(y) AS y, i, avg(x) AS x FROM e GROUP BY family, i), p AS (SELECT family, any_value(y) AS y, list(x ORDER BY i) AS x FROM m GROUP BY family),
s AS (SELECT v.vec_id, p.y, round({COSINE.format('v.x', 'p.x')}, 6) AS s, row_number() OVER (PARTITION BY v.vec_id, p.y ORDER BY round({COSINE.format('v.x', 'p.x')}, 6) DESC, family) AS r FROM v, p WHERE v.vec_id % 10 = 0)
SELECT vec_id, round(avg(s) FILTER (WHERE y = 1) - avg(s) FILTER (WHERE y = 0), 5) AS score FROM s WHERE r <= 3 GROUP BY vec_id""")
def ret21_prototype_score(t):
    """Means of families of one label; a vector's score is its mean cosine with the three nearest of label 1 less that of label 0."""
    e = t("embeddings").withColumn("y", c("label") % 2).withColumn("family", c("vec_id") % 30 * 2 + c("y"))
    parts = e.select("family", "y", F.posexplode("embedding").alias("i", "x")).groupBy("family", "i").agg(F.avg(c("x").cast("double")).alias("x"), F.min("y").alias("y"), F.max("y").alias("most"))
    means = parts.where("y = most").groupBy("family").agg(F.min("y").alias("y"), F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("x"))
    means = means.select((-1 - c("family")).alias("vec_id"), c("x").alias("embedding"), "y")
    asked = e.where("vec_id % 10 = 0").select("vec_id", "embedding")
    mean = lambda y: dense.top_k(asked, means.where(c("y") == y), "vec_id", "embedding", 3, descending_ids=True).groupBy("query").agg(F.avg("cosine").alias(f"m{y}"))
    return mean(1).join(mean(0), "query").select(c("query").alias("vec_id"), F.round(c("m1") - c("m0"), 5).alias("score"))


@query("""WITH f AS (SELECT p_brand || '-' || p_size % 10 AS family, list_distinct(flatten(list(string_split(p_name, ' ')))) AS w FROM part GROUP BY 1), e AS (SELECT family, len(w) AS n, unnest(w) AS token FROM f),
p AS (SELECT a.family AS query, b.family AS donor, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared FROM e a JOIN e b ON a.token = b.token AND a.family <> b.family GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT query, donor, shared, round(CAST(shared AS DOUBLE) / (n + m - shared), 9) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CAST(shared AS DOUBLE) / (n + m - shared) DESC, donor) AS r FROM p WHERE CAST(shared AS DOUBLE) / (n + m - shared) >= 0.3) WHERE r <= 3""")
def jn30_nearest_families(t):
    """The nearest families by the tokens of their names."""
    family = F.concat(c("p_brand"), F.lit("-"), (c("p_size") % 10).cast("string"))
    each = t("part").select(family.alias("family"), F.explode(F.split("p_name", " ")).alias("token")).distinct()
    n = each.groupBy("family").agg(F.count("*").alias("n"))
    held = each.join(n, "family")
    a, b = (held.select("token", c("family").alias(x), c("n").alias(f"n_{x}")) for x in ("query", "donor"))
    met = a.join(b, "token").where("query != donor").groupBy("query", "donor", "n_query", "n_donor").agg(F.count("*").alias("shared")).where("shared >= 2")
    met = met.withColumn("jaccard", c("shared").cast("double") / (c("n_query") + c("n_donor") - c("shared"))).where("jaccard >= 0.3")
    top = windows.top_per_group(met, ["query"], [F.desc("jaccard"), c("donor")], 3)
    return top.select("query", "donor", "shared", F.round("jaccard", 9).alias("jaccard"))


@query("""WITH p AS (SELECT *, count(*) OVER a - 1 AS n1, (sum(label) OVER a - label) / nullif(count(*) OVER a - 1, 0) AS m1, count(*) OVER b - 1 AS n2, (sum(label) OVER b - label) / nullif(count(*) OVER b - 1, 0) AS m2 FROM cards WINDOW a AS (PARTITION BY family, category), b AS (PARTITION BY family))
SELECT id, CASE WHEN n1 >= 2 AND m1 <> 0.5 AND greatest(m1, 1 - m1) >= 0.7 THEN CAST(m1 > 0.5 AS INTEGER) WHEN n2 >= 3 AND m2 <> 0.5 AND greatest(m2, 1 - m2) >= 0.6 THEN CAST(m2 > 0.5 AS INTEGER) ELSE CAST(score >= 150000 AS INTEGER) END AS predicted FROM p""")
def pri4_leave_one_out_apply(t):
    """What the others of the exact family say, else those of the looser one, where they are enough and agree; else the base."""
    d = t("cards").select("id", "family", "category", "label", "score")
    d = windows.leave_one_out(d, ["family", "category"], "label").withColumnsRenamed({"loo_count": "n1", "loo_mean": "m1"})
    d = windows.leave_one_out(d, ["family"], "label").withColumnsRenamed({"loo_count": "n2", "loo_mean": "m2"})
    sure = lambda n, m, least, share: (c(n) >= least) & (c(m) != 0.5) & (F.greatest(c(m), 1 - c(m)) >= share)
    said = F.when(sure("n1", "m1", 2, 0.7), (c("m1") > 0.5).cast("int")).when(sure("n2", "m2", 3, 0.6), (c("m2") > 0.5).cast("int"))
    return d.select("id", said.otherwise((c("score") >= 150000).cast("int")).alias("predicted"))


@query("")  # components by union-find in the operator's test
def er20_leak_topology(t):
    """Components of several kinds of edges together, and in how many folds each has rows."""
    d = t("cards").withColumn("exact", F.concat_ws("|", c("family").cast("string"), "category")).withColumn("masked", F.concat_ws("|", (c("family") % 400).cast("string"), "category", c("label").cast("string")))
    edges = None
    for key, cap in (("exact", None), ("masked", 12)):
        some = resolution.star_edges(d, key, "id", cap)
        edges = some if edges is None else edges.unionByName(some)
    reach = resolution.components(d.select(c("id").alias("node")), edges.distinct())
    each = d.select(c("id").alias("node"), "fold").join(reach, "node").groupBy("component").agg(F.count("*").alias("size"), F.countDistinct("fold").alias("folds"))
    return each.groupBy("folds").agg(F.count("*").alias("components"), F.sum("size").alias("rows"), F.max("size").alias("largest"))


@query("SELECT id, CASE WHEN family % 6 = 0 THEN 'holdout' ELSE 'development' END AS split, CAST(family % 6 - 1 AS INTEGER) AS fold FROM cards")
def gov1_sealed(t):
    """Of a drafted registry the first part is sealed, the others become folds; a component in two parts is an error."""
    draft = t("cards").select("id", c("family").alias("component"), (c("family") % 6).cast("int").alias("part"))
    torn = draft.groupBy("component").agg((F.min("part") == F.max("part")).alias("whole"))
    part = checked(c("part"), c("whole"), "a component lies in two parts")
    return draft.join(torn, "component").select("id", F.when(part == 0, "holdout").otherwise("development").alias("split"), (part - 1).alias("fold"))
