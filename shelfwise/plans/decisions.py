"""Priors, votes, fusion, thresholds and metrics of decisions: what changes a prediction, and what the change is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators import comparison, fusion, metrics, neighbours, priors, resolution, windows
from shelfwise.plans.scores import HEADS, heads
from shelfwise.plans.texts import WORDS
from shelfwise.queries import query

c = F.col

F1 = "coalesce(2 * sum(label * {0}) / nullif(sum(label) + sum({0}), 0), 0)"


def f1_of(p: str) -> Column:
    return F.coalesce(2 * F.sum(c("label") * c(p)) / F.nullif(F.sum("label") + F.sum(p), F.lit(0)), F.lit(0.0))


# ---- neighbours and priors ----

GRAPH = f"""n AS (SELECT doc_id, lang, list_distinct({WORDS}) AS w FROM documents), e AS (SELECT doc_id, lang, len(w) AS size, unnest(w) AS item FROM n),
u AS (SELECT item FROM e GROUP BY item HAVING count(*) BETWEEN 2 AND 30), k AS (SELECT e.* FROM e JOIN u USING (item)),
p AS (SELECT a.doc_id AS node, b.doc_id AS neighbour, any_value(a.size) AS size, any_value(b.size) AS other, count(*) AS shared FROM k a JOIN k b ON a.item = b.item AND a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY ALL HAVING count(*) >= 8),
s AS (SELECT *, CAST(shared AS DOUBLE) / least(size, other) AS containment, CAST(shared AS DOUBLE) / (size + other - shared) AS jaccard FROM p),
g AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY containment DESC, jaccard DESC, shared DESC, neighbour DESC) AS rank FROM s WHERE containment >= 0.05 AND jaccard >= 0.02)"""


def graph(t) -> DataFrame:
    return neighbours.graph(t("documents"), "doc_id", "lang", F.array_distinct(T.tokens(c("text"))), 30, 8, 0.05, 0.02, 50)


@query(f"WITH {GRAPH} SELECT node, neighbour, shared, round(containment, 9) AS containment, round(jaccard, 9) AS jaccard, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 50")
def jn17_neighbour_graph(t):
    """The best neighbours of each text by the rare words that they share; all words count in the sizes."""
    return graph(t).select("node", "neighbour", "shared", F.round("containment", 9).alias("containment"), F.round("jaccard", 9).alias("jaccard"), "rank")


@query(f"""WITH {GRAPH}, r AS (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY rank) AS place FROM g JOIN (SELECT doc_id, quality AS label FROM labels) l ON l.doc_id = neighbour WHERE rank <= 50 AND containment >= 0.06 AND neighbour % 5 <> 0 AND node % 5 = 0),
v AS (SELECT node, count(*) AS n, avg(label) AS mean FROM r WHERE place <= 4 GROUP BY node HAVING count(*) >= 2)
SELECT node, n AS donors, CAST(mean >= 0.5 AS INTEGER) AS prediction FROM v WHERE mean <> 0.5 AND greatest(mean, 1 - mean) >= 0.6""")
def pri8_neighbour_prior(t):
    """The label of the best donors above a threshold, where they are enough and agree enough."""
    donors = t("labels").where("doc_id % 5 != 0").select(c("doc_id").alias("neighbour"), c("quality").alias("label"))
    found = graph(t).where("node % 5 = 0").where(c("containment") >= 0.06)
    return neighbours.vote(found, donors, "label", 4, 2, 0.6)


WEIGHTED = f"""x AS (SELECT doc_id, lang, list_distinct({WORDS}) AS w FROM documents), e AS (SELECT doc_id, lang, unnest(w) AS item FROM x), u AS (SELECT item, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS weight FROM e GROUP BY item HAVING count(*) BETWEEN 2 AND 40),
k AS (SELECT e.*, weight FROM e JOIN u USING (item)), z AS (SELECT doc_id, sum(weight) AS total FROM k GROUP BY doc_id), p AS (SELECT a.doc_id AS node, b.doc_id AS neighbour, count(*) AS shared, sum(a.weight) AS mass FROM k a JOIN k b ON a.item = b.item AND a.lang = b.lang AND a.doc_id <> b.doc_id GROUP BY ALL HAVING count(*) >= 4)"""


@query(f"WITH {WEIGHTED}, s AS (SELECT node, neighbour, shared, round(mass / least(a.total, b.total), 6) AS containment FROM p JOIN z a ON a.doc_id = node JOIN z b ON b.doc_id = neighbour) SELECT node, neighbour, shared, containment, CAST(row_number() OVER (PARTITION BY node ORDER BY containment DESC, neighbour) AS INTEGER) AS rank FROM s WHERE containment >= 0.2 QUALIFY rank <= 5")
def jn19_weighted_overlap(t):
    """Neighbours by the weight of the rare words that they share, as a part of what the lesser text holds."""
    return neighbours.weighted(t("documents"), "doc_id", "lang", F.array_distinct(T.tokens(c("text"))), 40, 4, 0.2, 5)


@query("SELECT q.id, round(avg(label), 9) AS prior FROM (SELECT q.id, d.label, row_number() OVER (PARTITION BY q.id ORDER BY abs(d.id - q.id), d.id) AS r FROM cards q JOIN cards d ON q.fold = 0 AND d.fold <> 0 AND d.id BETWEEN q.id - 60 AND q.id + 60) q WHERE r <= 5 GROUP BY q.id")
def pri14_nearest_prior(t):
    found = resolution.nearest(t("cards").where("fold = 0").select("id"), t("cards").where("fold != 0").select("id", "label"), "id", "label", 5)
    return found.groupBy("id").agg(F.round(F.avg("label"), 9).alias("prior"))


@query("SELECT category, family, CAST(avg(label) > 0.5 AS INTEGER) AS majority, count(*) AS support FROM cards WHERE fold <> 0 GROUP BY ALL HAVING count(*) >= 2 AND avg(label) <> 0.5 AND greatest(avg(label), 1 - avg(label)) >= 0.75")
def pri1_majority(t):
    return priors.majority(t("cards").where("fold != 0"), ["category", "family"], "label", 2, 0.75)


LEVELS = """a AS (SELECT category, family, count(*) AS n, (sum(label) + 0.4) / (count(*) + 1) AS p FROM cards WHERE fold <> 0 GROUP BY ALL), b AS (SELECT family, count(*) AS n, (sum(label) + 0.4) / (count(*) + 1) AS p FROM cards WHERE fold <> 0 GROUP BY ALL)"""


@query(f"""WITH {LEVELS}, j AS (SELECT id, label, score, CASE WHEN a.n >= 2 AND greatest(a.p, 1 - a.p) >= 0.6 THEN a.p WHEN b.n >= 4 AND greatest(b.p, 1 - b.p) >= 0.55 THEN b.p END AS posterior, CASE WHEN a.n >= 2 AND greatest(a.p, 1 - a.p) >= 0.6 THEN 'exact' WHEN b.n >= 4 AND greatest(b.p, 1 - b.p) >= 0.55 THEN 'name' ELSE 'none' END AS source
  FROM cards c LEFT JOIN a ON a.category = c.category AND a.family = c.family LEFT JOIN b ON b.family = c.family WHERE fold = 0)
SELECT id, source, round(posterior, 9) AS posterior, CAST(coalesce(0.5 * score / 600000 + 0.5 * posterior, score / 600000) >= 0.3 AS INTEGER) AS predicted FROM j""")
def pri12_cascaded_posterior(t):
    """The first level whose family is large and sure enough; a level of 999 rows at least is switched off. Blended with the score."""
    out = priors.posteriors(t("cards").where("fold = 0"), t("cards").where("fold != 0"), [("exact", ["category", "family"], 2, 0.6), ("name", ["family"], 4, 0.55), ("canonical", ["category"], 999, 0.999)], "label", 1.0, 0.4)
    blended = F.coalesce(0.5 * c("score") / 600000 + 0.5 * c("posterior"), c("score") / 600000)
    return out.select("id", "source", F.round("posterior", 9).alias("posterior"), (blended >= 0.3).cast("int").alias("predicted"))


@query(f"""WITH {LEVELS}, j AS (SELECT CAST(score >= 150000 AS INTEGER) AS base, CASE WHEN a.n >= 2 AND greatest(a.p, 1 - a.p) >= 0.6 THEN a.p WHEN b.n >= 4 AND greatest(b.p, 1 - b.p) >= 0.55 THEN b.p END AS posterior, CASE WHEN a.n >= 2 AND greatest(a.p, 1 - a.p) >= 0.6 THEN 'exact' WHEN b.n >= 4 AND greatest(b.p, 1 - b.p) >= 0.55 THEN 'name' ELSE 'none' END AS source
  FROM cards c LEFT JOIN a ON a.category = c.category AND a.family = c.family LEFT JOIN b ON b.family = c.family WHERE fold = 0)
SELECT source, count(*) AS rows, count(*) FILTER (WHERE coalesce(CAST(posterior >= 0.5 AS INTEGER), base) <> base) AS changed FROM j GROUP BY source""")
def pri16_source_audit(t):
    """How many rows each source decides, and how many of them change."""
    out = priors.posteriors(t("cards").where("fold = 0"), t("cards").where("fold != 0"), [("exact", ["category", "family"], 2, 0.6), ("name", ["family"], 4, 0.55)], "label", 1.0, 0.4)
    base = (c("score") >= 150000).cast("int")
    return out.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.coalesce((c("posterior") >= 0.5).cast("int"), base) != base).alias("changed"))


@query("SELECT CAST(a.x AS INTEGER) AS least, CAST(b.x AS DOUBLE) AS confidence, CAST(m.x AS INTEGER) AS top FROM (VALUES (1), (2), (4)) a(x), (VALUES (0.55), (0.75), (0.9)) b(x), (VALUES (3), (5)) m(x)")
def pri17_policy_grid(t):
    """All policies of a grid of parameters."""
    return priors.policy_grid(t("region").sparkSession, {"least": [1, 2, 4], "confidence": [0.55, 0.75, 0.9], "top": [3, 5]})


@query("""WITH k AS (SELECT category, family, min(label) AS label, count(*) AS n FROM cards WHERE fold <> 0 GROUP BY ALL HAVING min(label) = max(label) AND count(*) BETWEEN 2 AND 6), f AS (SELECT family, min(label) AS label, count(*) AS n FROM cards WHERE fold <> 0 GROUP BY ALL HAVING min(label) = max(label) AND count(*) BETWEEN 2 AND 6)
SELECT id, coalesce(k.label, f.label) AS label, CASE WHEN k.label IS NOT NULL THEN 'exact' ELSE 'name' END AS channel, coalesce(k.n, f.n) AS donors FROM cards c LEFT JOIN k ON k.category = c.category AND k.family = c.family LEFT JOIN f ON f.family = c.family WHERE fold = 0 AND coalesce(k.label, f.label) IS NOT NULL""")
def ret13_unanimous_prior(t):
    """The label of the first channel whose donors are all of one mind, neither too few nor too many."""
    rows, donors = t("cards").where("fold = 0"), t("cards").where("fold != 0")
    return priors.unanimous(rows, donors, [("exact", ["category", "family"]), ("name", ["family"])], "label", 2, 6).select("id", "label", "channel", "donors")


FUSED = """d AS (SELECT q.id AS query, b.id AS donor, b.label, 1.0::DOUBLE / (60 + b.id % 7 + 1) AS rrf, 1 + b.id % 3 AS channels, row_number() OVER (PARTITION BY q.id ORDER BY 1.0::DOUBLE / (60 + b.id % 7 + 1) DESC, b.id) AS rank FROM cards q JOIN cards b ON q.family = b.family AND q.fold = 0 AND b.fold <> 0)"""


@query(f"""WITH {FUSED}, v AS (SELECT query, count(*) AS n, sum(rrf * label) / sum(rrf) AS rate, max(channels) AS channels FROM d WHERE rank <= 5 GROUP BY query)
SELECT id, round(CASE WHEN n >= 3 AND greatest(rate, 1 - rate) >= 0.8 AND channels >= 2 THEN 0.75 * score / 600000 + 0.25 * rate ELSE score / 600000 END, 10) AS score, n >= 3 AND greatest(rate, 1 - rate) >= 0.8 AND channels >= 2 AS applied FROM cards JOIN v ON v.query = id""")
def ret11_cache_vote(t):
    """A score moves a quarter towards the vote of its five best donors where three at least agree and two channels speak for them."""
    rows = t("cards").where("fold = 0")
    d = rows.select(c("id").alias("query"), "family").join(t("cards").where("fold != 0").select("family", c("id").alias("donor"), "label"), "family")
    d = d.select("query", "donor", "label", (F.lit(1.0) / (60 + c("donor") % 7 + 1)).alias("weight"), (1 + c("donor") % 3).alias("channels"))
    voted = neighbours.weighted_vote(d, "weight", "label", 5)
    gate = (c("n") >= 3) & (F.greatest("rate", 1 - c("rate")) >= 0.8) & (c("channels") >= 2)
    old = c("score") / 600000
    return rows.select("id", "score").join(voted.withColumnRenamed("query", "id"), "id").select("id", F.round(F.when(gate, 0.75 * old + 0.25 * c("rate")).otherwise(old), 10).alias("score"), gate.alias("applied"))


@query(f"""WITH {FUSED}, v AS (SELECT query, sum(rrf * label) / sum(rrf) AS rate, count(*) AS n FROM d WHERE rank <= 5 GROUP BY query) SELECT id, round(score / 600000 + CASE WHEN n >= 2 AND greatest(rate, 1 - rate) >= 0.6 THEN least(greatest(rate - score / 600000, -0.1), 0.1) ELSE 0 END, 10) AS score FROM cards JOIN v ON v.query = id""")
def fus26_vote_residual(t):
    """What the donors' vote adds to a score, clipped to a tenth either way, where they agree enough."""
    rows = t("cards").where("fold = 0")
    d = rows.select(c("id").alias("query"), "family").join(t("cards").where("fold != 0").select("family", c("id").alias("donor"), "label"), "family")
    voted = neighbours.weighted_vote(d.select("query", "donor", "label", (F.lit(1.0) / (60 + c("donor") % 7 + 1)).alias("weight"), F.lit(1).alias("channels")), "weight", "label", 5)
    old = c("score") / 600000
    step = F.when((c("n") >= 2) & (F.greatest("rate", 1 - c("rate")) >= 0.6), F.least(F.greatest(c("rate") - old, F.lit(-0.1)), F.lit(0.1))).otherwise(0.0)
    return rows.select("id", "score").join(voted.withColumnRenamed("query", "id"), "id").select("id", F.round(old + step, 10).alias("score"))


# ---- fusion ----


@query(f"WITH {HEADS} SELECT id, CAST(CASE category WHEN '1-URGENT' THEN 0.5 * a + 0.3 * b + 0.2 * base WHEN '2-HIGH' THEN 0.2 * a + 0.7 * b + 0.1 * base ELSE 0.4 * a + 0.4 * b + 0.2 * base END >= CASE category WHEN '1-URGENT' THEN 0.4 WHEN '2-HIGH' THEN 0.5 ELSE 0.45 END AS INTEGER) AS predicted FROM heads")
def fus6_routed_fusion(t):
    """Three heads by weights and a threshold that the category decides; the rules are a parameter."""
    rules = {"1-URGENT": ([0.5, 0.3, 0.2], 0.4), "2-HIGH": ([0.2, 0.7, 0.1], 0.5), None: ([0.4, 0.4, 0.2], 0.45)}
    return heads(t).select("id", fusion.routed(c("category"), [c("a"), c("b"), c("base").cast("double")], rules).alias("predicted"))


@query(f"WITH {HEADS} SELECT id, round(0.25 * a + 0.5 * b + 0.25 * cand, 10) AS score FROM heads")
def fus8_weighted_score(t):
    scores, weights = F.array(c("a"), c("b"), c("cand").cast("double")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25))
    return heads(t).select("id", F.round(T.dot(scores, weights), 10).alias("score"))


@query("SELECT a.i / 4 AS w1, b.i / 4 AS w2, (4 - a.i - b.i) / 4 AS w3 FROM range(5) a(i), range(5) b(i) WHERE a.i + b.i <= 4 AND a.i / 4 <= 1 AND b.i / 4 <= 0.5 AND (4 - a.i - b.i) / 4 <= 0.25")
def fus10_capped_weights(t):
    """Weights of which none exceeds its cap."""
    caps = F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25))
    table = fusion.weight_table(t("region").sparkSession, 3, 4)
    return table.where(F.forall(F.zip_with("weights", caps, lambda w, m: w <= m + 1e-7), lambda ok: ok)).select(*(c("weights")[i].alias(f"w{i + 1}") for i in range(3)))


@query("""WITH q AS (SELECT category, CAST(unnest(range(1, 20)) AS INTEGER) AS step, unnest(quantile_cont(score, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS cut FROM cards GROUP BY category),
e AS (SELECT q.category, step, cut, round(coalesce(2 * sum(CASE WHEN score >= cut THEN label ELSE 0 END) / nullif(sum(label) + count(*) FILTER (WHERE score >= cut), 0), 0), 9) AS f1 FROM q JOIN cards USING (category) GROUP BY ALL)
SELECT category, round(first(cut ORDER BY f1 DESC, step), 4) AS threshold, max(f1) AS f1 FROM e GROUP BY category""")
def fus13_quantile_threshold(t):
    """The best of evenly spaced quantiles as a cut; equal cuts count as the first."""
    d = t("cards").select("category", "score", "label", "id")
    cuts = windows.quantiles(d, "score", "id", ["category"], [i / 20 for i in range(1, 20)])
    each = cuts.select("category", F.posexplode("quantiles").alias("step", "cut"))
    scored = d.join(each, "category").groupBy("category", "step", "cut").agg(
        F.sum(F.when(c("score") >= c("cut"), c("label")).otherwise(0)).alias("tp"), F.sum("label").alias("pos"), F.count_if(c("score") >= c("cut")).alias("said")
    )
    f1 = F.round(F.coalesce(2 * c("tp") / F.nullif(c("pos") + c("said"), F.lit(0)), F.lit(0.0)), 9)
    best = scored.select("category", F.struct(f1.alias("f1"), (-c("step")).alias("back"), "cut").alias("s")).groupBy("category").agg(F.max("s").alias("s"))
    return best.select("category", F.round("s.cut", 4).alias("threshold"), c("s.f1").alias("f1"))


@query("""WITH o AS (SELECT category, f.i AS fold, floor(score / 1000) AS score, label FROM cards JOIN range(5) f(i) ON fold <> f.i), b AS (SELECT category, fold, score, count(*) AS n, sum(label) AS pos FROM o GROUP BY ALL),
s AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY category, fold) AS p FROM b WINDOW w AS (PARTITION BY category, fold ORDER BY score DESC))
SELECT category, CAST(fold AS INTEGER) AS fold, CAST(first(score ORDER BY round(2 * tp / (seen + p), 9) DESC, score DESC) AS DOUBLE) AS threshold FROM s GROUP BY ALL""")
def fus14_donor_thresholds(t):
    """For each fold and category the threshold that is best on the other folds, ready to be frozen."""
    d = t("cards").withColumn("score", F.floor(c("score") / 1000).cast("double")).withColumn("outer", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("outer != fold")
    blocks = metrics.score_blocks(d, "score", "label", ["category", "outer"])
    pos = blocks.groupBy("category", "outer").agg(F.sum("pos").alias("all"))
    f1 = F.round(2 * c("tp") / (c("seen") + c("all")), 9)
    best = blocks.join(pos, ["category", "outer"]).groupBy("category", "outer").agg(F.max(F.struct(f1.alias("f1"), "score")).alias("s"))
    return best.select("category", c("outer").alias("fold"), c("s.score").alias("threshold"))


@query(f"WITH {HEADS} SELECT id, CASE WHEN id % 3 = 0 AND family % 2 = 0 THEN b ELSE a END AS p, id % 3 = 0 AND family % 2 = 0 AS replaced FROM heads")
def fus18_gated_replacement(t):
    """The candidate's probability only where its evidence is valid."""
    valid = (c("id") % 3 == 0) & (c("family") % 2 == 0)
    return heads(t).select("id", F.when(valid, c("b")).otherwise(c("a")).alias("p"), valid.alias("replaced"))


@query("SELECT id, fold, label, round((score + (score + id % 10) + (score - id % 4)) / 3, 6) AS score, CAST(3 AS BIGINT) AS seeds FROM cards")
def fus22_seed_alignment(t):
    """Seeds joined by id; ids that repeat, or whose folds or labels differ, are an error."""
    d = t("cards").select("id", "fold", "label", "score")
    return fusion.aligned([d, d.withColumn("score", c("score") + c("id") % 10), d.withColumn("score", c("score") - c("id") % 4)], "id", ["fold", "label"], "score").withColumn("score", F.round("score", 6))


@query(f"WITH {HEADS} SELECT id, CASE WHEN base = 1 AND a - 0.05 * (id % 5) < 0.25 AND b < 0.4 AND cand = 0 THEN 0 ELSE base END AS predicted FROM heads")
def fus25_counterfactual(t):
    """A positive flips only if its score falls below the threshold without the cue and two other heads agree."""
    flip = (c("base") == 1) & (c("a") - 0.05 * (c("id") % 5) < 0.25) & (c("b") < 0.4) & (c("cand") == 0)
    return heads(t).select("id", F.when(flip, 0).otherwise(c("base")).alias("predicted"))


# ---- metrics ----


@query("SELECT family, 2.0::DOUBLE * sum(CASE WHEN label = 1 AND score >= 250000 THEN 1 ELSE 0 END) / nullif(sum(label) + count(*) FILTER (WHERE score >= 250000), 0) AS f1 FROM cards GROUP BY family".replace("2.0::DOUBLE *", "round(2.0::DOUBLE *").replace(", 0) AS f1", ", 0), 9) AS f1"))
def met2_f1_or_nothing(t):
    """Nothing where no row is positive or predicted so."""
    d = t("cards").withColumn("p", (c("score") >= 250000).cast("int"))
    return d.groupBy("family").agg(F.round(2 * F.sum(c("label") * c("p")) / F.nullif(F.sum("label") + F.sum("p"), F.lit(0)), 9).alias("f1"))


@query("""WITH d AS (SELECT family % 40 AS slice, floor(score / 5000) AS score, label FROM cards WHERE family % 40 <> 7 OR label = 0), b AS (SELECT slice, score, count(*) AS n, sum(label) AS pos FROM d GROUP BY ALL), s AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp FROM b WINDOW w AS (PARTITION BY slice ORDER BY score DESC))
SELECT slice, CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos * tp / seen) / nullif(sum(pos), 0), 9) AS ap FROM s GROUP BY slice""")
def met5_average_precision_or_nothing(t):
    d = t("cards").where("family % 40 != 7 OR label = 0").select((c("family") % 40).alias("slice"), F.floor(c("score") / 5000).cast("double").alias("score"), "label")
    return metrics.average_precision(d, "score", "label", ["slice"]).select("slice", "positives", F.round("ap", 9).alias("ap"))


@query(f"WITH {HEADS} SELECT category, count(*) FILTER (WHERE cand = label AND base <> label) AS corrected, count(*) FILTER (WHERE cand <> label AND base = label) AS regressed FROM heads GROUP BY category")
def met7_corrections(t):
    right, was = c("cand") == c("label"), c("base") == c("label")
    return heads(t).groupBy("category").agg(F.count_if(right & ~was).alias("corrected"), F.count_if(~right & was).alias("regressed"))


@query(f"WITH {HEADS}, g AS (SELECT family, count(*) FILTER (WHERE cand = label AND base <> label) AS corrected, count(*) FILTER (WHERE cand <> label AND base = label) AS regressed FROM heads GROUP BY family) SELECT family, round(corrected / nullif(regressed, 0), 9) AS ratio, coalesce(corrected / nullif(regressed, 0) >= 1.5, false) AS accepted FROM g")
def met8_correction_ratio(t):
    """Nothing where no row regressed; such a family isn't accepted."""
    right, was = c("cand") == c("label"), c("base") == c("label")
    g = heads(t).groupBy("family").agg(F.count_if(right & ~was).alias("corrected"), F.count_if(~right & was).alias("regressed"))
    ratio = c("corrected") / F.nullif(c("regressed"), F.lit(0))
    return g.select("family", F.round(ratio, 9).alias("ratio"), F.coalesce(ratio >= 1.5, F.lit(False)).alias("accepted"))


@query(f"WITH {HEADS}, e AS (SELECT category, label, unnest(['a', 'b', 'both']) AS head, unnest([CAST(a >= 0.5 AS INTEGER), CAST(b >= 0.5 AS INTEGER), CAST(a + b >= 1 AS INTEGER)]) AS said FROM heads WHERE base <> label AND cand <> label) SELECT category, head, count(*) AS errors, round(avg(CAST(said = label AS INTEGER)), 9) AS rescued FROM e GROUP BY ALL")
def met13_rescues(t):
    """Of the errors that two predictions share, how many each head would have set right."""
    said = F.explode(F.array(*(F.struct(F.lit(n).alias("head"), x.cast("int").alias("said")) for n, x in (("a", c("a") >= 0.5), ("b", c("b") >= 0.5), ("both", c("a") + c("b") >= 1)))))
    wrong = heads(t).where("base != label AND cand != label").select("category", "label", said.alias("s"))
    return wrong.groupBy("category", c("s.head").alias("head")).agg(F.count("*").alias("errors"), F.round(F.avg((c("s.said") == c("label")).cast("int")), 9).alias("rescued"))


@query(f"""WITH {HEADS}, p AS (SELECT *, CASE WHEN family % 3 = 0 THEN 1 ELSE base END AS base2, CASE WHEN family % 3 = 0 THEN 1 ELSE cand END AS cand2 FROM heads)
SELECT category, count(*) FILTER (WHERE base <> cand) AS changed, count(*) FILTER (WHERE base <> cand AND base2 = cand2) AS overridden, count(*) FILTER (WHERE base <> cand AND base2 <> cand2) AS survived, count(*) FILTER (WHERE base = cand AND base2 <> cand2) AS introduced, round(coalesce(count(*) FILTER (WHERE base <> cand AND base2 <> cand2) / nullif(count(*) FILTER (WHERE base <> cand), 0), 0), 9) AS rate FROM p GROUP BY category""")
def met14_survival(t):
    """Which changes are left after priors have decided some rows for both."""
    d = heads(t)
    for n in ("base", "cand"):
        d = d.withColumn(f"{n}2", F.when(c("family") % 3 == 0, 1).otherwise(c(n)))
    return d.groupBy("category").agg(*comparison.survival("base", "cand", "base2", "cand2"))


@query(f"WITH {HEADS}, g AS (SELECT fold, {F1.format('cand')} - {F1.format('base')} AS d FROM heads GROUP BY fold) SELECT count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses, round(max(d), 9) AS best FROM g")
def met15_fold_wins(t):
    by = heads(t).groupBy("fold").agg((f1_of("cand") - f1_of("base")).alias("d"))
    return by.agg(F.count_if(c("d") > 0).alias("wins"), F.count_if(c("d") < 0).alias("losses"), F.round(F.max("d"), 9).alias("best"))


#: A draw of a component: the first eight digits of a hash of the repeat and the draw, as a part of all components.
DRAW = "CAST(floor(('0x' || substring(sha256('{0}' || chr(0) || CAST(r.i AS VARCHAR) || chr(0) || CAST(j AS VARCHAR)), 1, 8))::BIGINT * n / 4294967296.0) AS BIGINT)"
BOOTSTRAP = f"""WITH {HEADS}, k AS (SELECT family, row_number() OVER (ORDER BY family) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT family FROM cards)),
d AS (SELECT CAST(r.i AS INTEGER) AS repeat, {DRAW.format('draw')} AS place, count(*) AS w FROM range(20) r(i), (SELECT unnest(range(max(n))) AS j, max(n) AS n FROM k) GROUP BY ALL),
s AS (SELECT family, category, sum(label * base) AS tp0, sum(base) AS p0, sum(label * cand) AS tp1, sum(cand) AS p1, sum(label) AS y FROM heads GROUP BY ALL),
g AS (SELECT repeat, category, sum(w * tp0) AS tp0, sum(w * p0) AS p0, sum(w * tp1) AS tp1, sum(w * p1) AS p1, sum(w * y) AS y FROM d JOIN k USING (place) JOIN s USING (family) GROUP BY ALL),
m AS (SELECT repeat, avg(coalesce(2 * tp1 / nullif(p1 + y, 0), 0) - coalesce(2 * tp0 / nullif(p0 + y, 0), 0)) AS delta FROM g GROUP BY repeat)"""


@query(f"{BOOTSTRAP} SELECT repeat, round(delta, 9) AS delta FROM m")
def met25_paired_deltas(t):
    """The change in macro F1 in each of twenty draws of as many families as there are, with replacement."""
    return comparison.multinomial_bootstrap(heads(t), "family", "category", "label", "base", "cand", 20, "draw").select("repeat", F.round("delta", 9).alias("delta"))


@query(f"{BOOTSTRAP} SELECT count(*) AS repeats, round(avg(CAST(delta > 0 AS INTEGER)), 9) AS won, round(quantile_cont(delta, 0.025), 9) AS low, round(quantile_cont(delta, 0.5), 9) AS middle, round(quantile_cont(delta, 0.975), 9) AS high FROM m")
def met16_component_bootstrap(t):
    """Share of draws won, and quantiles of the change; components are drawn over all categories at once."""
    d = comparison.multinomial_bootstrap(heads(t), "family", "category", "label", "base", "cand", 20, "draw")
    q = lambda p: F.round(F.percentile("delta", p), 9)
    return d.agg(F.count("*").alias("repeats"), F.round(F.avg((c("delta") > 0).cast("int")), 9).alias("won"), q(0.025).alias("low"), q(0.5).alias("middle"), q(0.975).alias("high"))


@query(f"""WITH {HEADS}, k AS (SELECT category, family, row_number() OVER (PARTITION BY category ORDER BY family) - 1 AS place, count(*) OVER (PARTITION BY category) AS n FROM (SELECT DISTINCT category, family FROM cards)),
d AS (SELECT category, CAST(r.i AS INTEGER) AS repeat, {DRAW.format("' || category || '")} AS place, count(*) AS w FROM range(10) r(i), (SELECT category, unnest(range(max(n))) AS j, max(n) AS n FROM k GROUP BY category) GROUP BY ALL),
s AS (SELECT family, category, sum(label * base) AS tp0, sum(base) AS p0, sum(label * cand) AS tp1, sum(cand) AS p1, sum(label) AS y FROM heads GROUP BY ALL)
SELECT repeat, category, round(coalesce(2 * sum(w * tp1) / nullif(sum(w * (p1 + y)), 0), 0) - coalesce(2 * sum(w * tp0) / nullif(sum(w * (p0 + y)), 0), 0), 9) AS delta FROM d JOIN k USING (category, place) JOIN s USING (category, family) GROUP BY ALL""")
def met17_category_bootstrap(t):
    """Families drawn anew within each category."""
    return comparison.category_bootstrap(heads(t), "family", "category", "label", "base", "cand", 10).select("repeat", "category", F.round("delta", 9).alias("delta"))


@query(f"WITH {HEADS}, g AS (SELECT id % 7 AS repeat, {F1.format('cand')} - {F1.format('base')} AS d FROM heads GROUP BY ALL) SELECT round(avg(d), 9) AS mean, round(stddev_pop(d), 9) AS std, count(*) FILTER (WHERE d > 0) AS positive, count(*) AS repeats FROM g")
def met19_repeat_summary(t):
    by = heads(t).groupBy((c("id") % 7).alias("repeat")).agg((f1_of("cand") - f1_of("base")).alias("d"))
    return by.agg(F.round(F.avg("d"), 9).alias("mean"), F.round(F.stddev_pop("d"), 9).alias("std"), F.count_if(c("d") > 0).alias("positive"), F.count("*").alias("repeats"))


MASKS = [("cheap", "score < 60000"), ("dear", "score > 300000"), ("urgent", "category = '1-URGENT'")]


@query("SELECT m.name AS mask, count(*) AS rows, round(avg(label), 9) AS rate FROM (SELECT *, unnest([CASE WHEN score < 60000 THEN 'cheap' END, CASE WHEN score > 300000 THEN 'dear' END, CASE WHEN category = '1-URGENT' THEN 'urgent' END]) AS name FROM cards) m WHERE m.name IS NOT NULL GROUP BY ALL")
def met21_rule_precision(t):
    """What a rule that forces a label would be right about."""
    d = comparison.cohorts(t("cards"), {n: F.expr(m) for n, m in MASKS})
    return d.groupBy(c("cohort").alias("mask")).agg(F.count("*").alias("rows"), F.round(F.avg("label"), 9).alias("rate"))


@query(f"WITH {HEADS}, v AS (SELECT label, base, unnest(['up cheap', 'down cheap', 'up dear', 'down dear']) AS variant, unnest([CASE WHEN score < 60000 THEN 1 ELSE base END, CASE WHEN score < 60000 THEN 0 ELSE base END, CASE WHEN score > 300000 THEN 1 ELSE base END, CASE WHEN score > 300000 THEN 0 ELSE base END]) AS said FROM heads) SELECT variant, count(*) FILTER (WHERE said <> base) AS changed, round({F1.format('said')}, 9) AS f1 FROM v GROUP BY variant")
def met22_override_variants(t):
    """Each rule forced either way: the rows that change, and the F1 that comes of it."""
    ways = [F.struct(F.lit(f"{w} {n}").alias("variant"), F.when(F.expr(m), y).otherwise(c("base")).alias("said")) for n, m in MASKS[:2] for w, y in (("up", 1), ("down", 0))]
    d = heads(t).select("label", "base", F.explode(F.array(*ways)).alias("v")).select("label", "base", "v.*")
    return d.groupBy("variant").agg(F.count_if(c("said") != c("base")).alias("changed"), F.round(f1_of("said"), 9).alias("f1"))


@query(f"WITH {HEADS}, m AS (SELECT *, unnest([CASE WHEN score < 60000 THEN 'cheap' END, CASE WHEN score > 300000 THEN 'dear' END, CASE WHEN category = '1-URGENT' THEN 'urgent' END, CASE WHEN score < 60000 OR score > 300000 OR category = '1-URGENT' THEN 'any' END]) AS cohort FROM heads) SELECT cohort, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(label * (1 - base)) AS BIGINT) AS missed_base, CAST(sum(label * (1 - cand)) AS BIGINT) AS missed_cand, round((sum(label * cand) - sum(label * base)) / nullif(sum(label), 0), 9) AS recall_delta FROM m WHERE cohort IS NOT NULL GROUP BY cohort")
def met24_recall_delta(t):
    """In each cohort and in any of them: positives missed before and after, and the change in recall."""
    masks = {n: F.expr(m) for n, m in MASKS} | {"any": F.expr(" OR ".join(m for _, m in MASKS))}
    d = comparison.cohorts(heads(t), masks)
    missed = lambda p: F.sum(c("label") * (1 - c(p)))
    return d.groupBy("cohort").agg(
        F.sum("label").alias("positives"), missed("base").alias("missed_base"), missed("cand").alias("missed_cand"),
        F.round((F.sum(c("label") * c("cand")) - F.sum(c("label") * c("base"))) / F.nullif(F.sum("label"), F.lit(0)), 9).alias("recall_delta"),
    )


@query(f"WITH {HEADS}, s AS (SELECT category, avg(a * b) - avg(a) * avg(b) AS cov, sqrt((avg(a * a) - avg(a) ** 2) * (avg(b * b) - avg(b) ** 2)) AS d FROM heads GROUP BY category) SELECT category, round(CASE WHEN d > 0 THEN cov / d END, 6) AS pearson FROM s")
def met28_pearson(t):
    """Population form; nothing where a side doesn't vary."""
    return heads(t).groupBy("category").agg(F.round(comparison.pearson("a", "b"), 6).alias("pearson"))
