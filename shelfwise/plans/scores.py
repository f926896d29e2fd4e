"""Ranks, fusion, thresholds, priors and metrics of two score columns.

Heads are orders with scores a and b and the predictions base and cand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import comparison, fusion, metrics, windows
from shelfwise.queries import query

c = F.col


def heads(t) -> DataFrame:
    d = t("cards").withColumn("a", c("score") / 600000).withColumn("b", (c("id") * 7919 % 1000) / 1000)
    return d.withColumn("base", (c("a") >= 0.25).cast("int")).withColumn("cand", (c("a") + c("b") >= 0.75).cast("int"))


HEADS = """heads AS (SELECT *, CAST(a >= 0.25 AS INTEGER) AS base, CAST(a + b >= 0.75 AS INTEGER) AS cand
  FROM (SELECT *, score / 600000 AS a, (id * 7919 % 1000) / 1000 AS b FROM cards))"""
RANKED = f"""WITH {HEADS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY fold, category ORDER BY a, id) - 1 AS place,
  count(*) OVER (PARTITION BY fold, category) AS n, rank() OVER (PARTITION BY fold, category ORDER BY b) + (count(*) OVER (PARTITION BY fold, category, b) - 1) / 2 AS average FROM heads)"""

# ---- ranks ----


@query(f"{RANKED} SELECT id, round(place / nullif(n - 1, 0), 6) AS rank01, round(average / n, 6) AS percentile, round((average - 1) / nullif(n - 1, 0), 6) AS scaled FROM ranked")
def win4_percentile_ranks(t):
    d = heads(t)
    a = windows.ordinal(d, "a", "id", ["fold", "category"]).select("id", F.round(windows.scaled_place(c("place_"), c("n_")), 6).alias("rank01"))
    b = windows.ordinal(d, "b", "id", ["fold", "category"])
    b = b.select("id", F.round(c("average_") / c("n_"), 6).alias("percentile"), F.round(windows.scaled_place(c("average_") - 1, c("n_")), 6).alias("scaled"))
    return a.join(b, "id")


@query(f"WITH {HEADS}, d AS (SELECT category, a, count(*) OVER (PARTITION BY category) AS n FROM heads WHERE fold <> 0) SELECT h.id, round(count(d.a) / max(g.n), 6) AS ecdf FROM heads h JOIN (SELECT category, count(*) AS n FROM cards WHERE fold <> 0 GROUP BY category) g USING (category) LEFT JOIN d ON d.category = h.category AND d.a <= h.a WHERE h.fold = 0 GROUP BY h.id")
def win8_donor_ecdf(t):
    """Share of the donors' scores at or below each outer score: both are counted as blocks of one running total."""
    d = heads(t).withColumn("donor", (c("fold") != 0).cast("bigint"))
    blocks = d.groupBy("category", "a").agg(F.sum("donor").alias("donors"))
    seen = windows.running_totals(blocks, "a", {"below": "donors"}, descending=False, by=["category"])
    n = blocks.groupBy("category").agg(F.sum("donors").alias("n"))
    return d.where("fold = 0").join(seen, ["category", "a"]).join(n, "category").select("id", F.round(c("below") / c("n"), 6).alias("ecdf"))


@query("SELECT id, CASE WHEN score <= 50000 THEN 0 WHEN score <= 150000 THEN 1 WHEN score <= 300000 THEN 2 ELSE 3 END AS bin FROM cards", "cards")
def win21_fixed_bins(d):
    return d.select("id", F.when(c("score") <= 50000, 0).when(c("score") <= 150000, 1).when(c("score") <= 300000, 2).otherwise(3).alias("bin"))


@query(f"WITH {HEADS} SELECT id, round((a - avg(a) OVER w) / greatest(stddev_pop(a) OVER w, 1e-4), 5) AS z FROM heads WINDOW w AS (PARTITION BY category)")
def fn12_zscore(t):
    d = heads(t)
    s = d.groupBy("category").agg(F.avg("a").alias("m"), F.greatest(F.stddev_pop("a"), F.lit(1e-4)).alias("s"))
    return d.join(s, "category").select("id", F.round((c("a") - c("m")) / c("s"), 5).alias("z"))


# ---- fusion ----


@query(f"{RANKED} SELECT id, round(0.6 * place / nullif(n - 1, 0) + 0.4 * (average - 1) / nullif(n - 1, 0), 6) AS blend FROM ranked")
def fus5_rank_blend(t):
    d = heads(t)
    a = windows.ordinal(d, "a", "id", ["fold", "category"]).select("id", windows.scaled_place(c("place_"), c("n_")).alias("x"))
    b = windows.ordinal(d, "b", "id", ["fold", "category"]).select("id", windows.scaled_place(c("average_") - 1, c("n_")).alias("y"))
    return a.join(b, "id").select("id", F.round(0.6 * c("x") + 0.4 * c("y"), 6).alias("blend"))


@query("SELECT a.i / 4 AS w1, b.i / 4 AS w2, (4 - a.i - b.i) / 4 AS w3 FROM range(5) a(i), range(5) b(i) WHERE a.i + b.i <= 4")
def fus7_simplex(t):
    return fusion.weight_table(t("region").sparkSession, 3, 4).select(*(c("weights")[i].alias(f"w{i + 1}") for i in range(3)))


THRESHOLDS = f"""WITH {HEADS}, w AS (SELECT i AS weight_id, i / 4 AS wa, 1 - i / 4 AS wb FROM range(5) r(i)),
s AS (SELECT category, fold, label, weight_id, least(greatest(floor(round((0.0::DOUBLE + a * wa + b * wb) * 100, 6)), 0), 100)::INTEGER AS step FROM heads, w),
g AS (SELECT category, weight_id, f.i AS outer_fold, step, count(*) FILTER (WHERE fold <> f.i) AS n, coalesce(sum(label) FILTER (WHERE fold <> f.i), 0) AS pos FROM s, range(5) f(i) GROUP BY ALL),
d AS (SELECT category, weight_id, outer_fold, step, sum(n) OVER o AS seen, sum(pos) OVER o AS tp, sum(pos) OVER (PARTITION BY category, weight_id, outer_fold) AS p FROM g WINDOW o AS (PARTITION BY category, weight_id, outer_fold ORDER BY step DESC)),
e AS (SELECT category, weight_id, outer_fold, step, round(CASE WHEN seen + p > 0 THEN 2 * tp / (seen + p) ELSE 0 END, 9) AS f1 FROM d)"""


@query(f"{THRESHOLDS} SELECT category, CAST(outer_fold AS INTEGER) AS fold, CAST(first(weight_id ORDER BY f1 DESC, weight_id, step) AS INTEGER) AS weight_id, first(step ORDER BY f1 DESC, weight_id, step) / 100 AS threshold, max(f1) AS f1 FROM e GROUP BY category, outer_fold")
def fus9_nested_selection(t):
    return fusion.nested_selection(heads(t), ["a", "b"], "label", "category", "fold", 4).drop("weights")


@query(f"{THRESHOLDS}, best AS (SELECT category, outer_fold, first(step ORDER BY f1 DESC, step) / 100 AS threshold FROM e WHERE weight_id = 4 GROUP BY ALL) SELECT id, CAST(a >= threshold AS INTEGER) AS predicted FROM heads JOIN best ON best.category = heads.category AND outer_fold = fold")
def fus21_cross_fold_predictions(t):
    d = heads(t)
    best = fusion.grid_thresholds(d, "a", "label", ["category"], "fold").select("category", "fold", "threshold")
    return d.join(best, ["category", "fold"]).select("id", (c("a") >= c("threshold")).cast("int").alias("predicted"))


BLOCKS = """WITH b AS (SELECT category, score, count(*) AS n, sum(label) AS pos FROM cards GROUP BY ALL),
s AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY category) AS p, lead(score) OVER w AS next FROM b WINDOW w AS (PARTITION BY category ORDER BY score DESC))"""


@query(f"{BLOCKS}, f AS (SELECT category, score, next, 2 * tp / (seen + p) AS f1 FROM s) SELECT category, round(first((score + coalesce(next, score)) / 2 ORDER BY f1 DESC, score DESC), 6) AS threshold, round(max(f1), 9) AS f1 FROM f GROUP BY category", "cards")
def fus11_midpoint_threshold(d):
    out = fusion.sweep_threshold(d, "score", "label", ["category"])
    return out.select("category", F.round("threshold", 6).alias("threshold"), F.round("f1", 9).alias("f1"))


@query(f"WITH {HEADS}, p AS (SELECT id, least(greatest(a, 1e-6), 1 - 1e-6) AS x, least(greatest(b, 1e-6), 1 - 1e-6) AS y FROM heads) SELECT id, round(1 / (1 + exp(-(ln(x / (1 - x)) + ln(y / (1 - y))) / 2)), 6) AS p FROM p")
def fus17_logit_mean(t):
    mean = (fusion.logit(c("a")) + fusion.logit(c("b"))) / 2
    return heads(t).select("id", F.round(1 / (1 + F.exp(-mean)), 6).alias("p"))


@query(f"WITH {HEADS}, q AS (SELECT category, quantile_cont(abs(b - 0.5), 0.8) AS q FROM heads GROUP BY category) SELECT id, CASE WHEN abs(b - 0.5) >= q THEN CAST(b >= 0.5 AS INTEGER) ELSE base END AS predicted FROM heads JOIN q USING (category)")
def fus20_quantile_override(t):
    """A prediction changes only where the other head is among the most confident fifth of its category."""
    d = heads(t).withColumn("confidence", F.abs(c("b") - 0.5))
    q = windows.quantiles(d, "confidence", "id", ["category"], [0.8]).select("category", c("quantiles")[0].alias("q"))
    sure = c("confidence") >= c("q")
    return d.join(q, "category").select("id", F.when(sure, (c("b") >= 0.5).cast("int")).otherwise(c("base")).alias("predicted"))


@query(f"WITH {HEADS} SELECT id, round(abs(a - 0.25) - 0.025 * CAST(base <> cand AS INTEGER), 8) AS uncertainty, CASE WHEN abs(a - 0.25) < 0.05 AND abs(b - 0.5) > 0.4 AND base <> CAST(b >= 0.5 AS INTEGER) THEN 1 - base ELSE base END AS gated, round(0.7 * label + 0.3 * b, 6) AS soft_target FROM heads")
def fus23_uncertainty_gate(t):
    flip = (F.abs(c("a") - 0.25) < 0.05) & (F.abs(c("b") - 0.5) > 0.4) & (c("base") != (c("b") >= 0.5).cast("int"))
    return heads(t).select(
        "id", F.round(F.abs(c("a") - 0.25) - 0.025 * (c("base") != c("cand")).cast("int"), 8).alias("uncertainty"),
        F.when(flip, 1 - c("base")).otherwise(c("base")).alias("gated"), F.round(0.7 * c("label") + 0.3 * c("b"), 6).alias("soft_target"),
    )


# ---- priors ----


@query("WITH g AS (SELECT avg(label) AS rate FROM cards WHERE fold <> 0), f AS (SELECT family, count(*) AS n, sum(label) AS s FROM cards WHERE fold <> 0 GROUP BY family) SELECT id, round((coalesce(s, 0) + 2 * rate) / (coalesce(n, 0) + 2), 6) AS posterior, round(0.75 * score / 600000 + 0.25 * (coalesce(s, 0) + 2 * rate) / (coalesce(n, 0) + 2), 8) AS blended FROM cards LEFT JOIN f USING (family), g WHERE fold = 0")
def pri11_smoothed_posterior(t):
    donors, rows = t("cards").where("fold != 0"), t("cards").where("fold = 0")
    rate = donors.agg(F.avg("label")).first()[0] or 0.0
    sums = donors.groupBy("family").agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    zero = F.lit(0)
    p = (F.coalesce("s", zero) + 2 * rate) / (F.coalesce("n", zero) + 2)
    return rows.join(sums, "family", "left").select("id", F.round(p, 6).alias("posterior"), F.round(0.75 * c("score") / 600000 + 0.25 * p, 8).alias("blended"))


@query("WITH f AS (SELECT family, min(label) AS label FROM cards WHERE fold <> 0 GROUP BY family HAVING min(label) = max(label) AND count(*) >= 2) SELECT id, coalesce(f.label, CAST(score >= 150000 AS INTEGER)) AS predicted, CASE WHEN f.label IS NULL THEN 'NONE' ELSE 'FAMILY' END AS source FROM cards LEFT JOIN f USING (family) WHERE fold = 0")
def pri2_consistent_lookup(t):
    known = t("cards").where("fold != 0").groupBy("family").agg(F.min("label").alias("sure"), F.max("label").alias("most"), F.count("*").alias("n"))
    known = known.where("sure = most AND n >= 2").select("family", "sure")
    out = t("cards").where("fold = 0").join(known, "family", "left")
    return out.select("id", F.coalesce("sure", (c("score") >= 150000).cast("int")).alias("predicted"), F.when(c("sure").isNull(), "NONE").otherwise("FAMILY").alias("source"))


# ---- metrics ----


@query(f"WITH {HEADS}, r AS (SELECT category, label, b, rank() OVER (PARTITION BY category ORDER BY b) + (count(*) OVER (PARTITION BY category, b) - 1) / 2 AS r, least(greatest(b, 1e-6), 1 - 1e-6) AS q FROM heads) SELECT category, round(avg((b - label) ** 2), 6) AS brier, round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 6) AS log_loss, round((sum(r * label) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * sum(1 - label), 0), 6) AS auc FROM r GROUP BY category")
def met6_probability_quality(t):
    d = windows.ordinal(heads(t), "b", "id", ["category"])
    q, y, pos, neg = F.least(F.greatest(c("b"), F.lit(1e-6)), F.lit(1 - 1e-6)), c("label"), F.sum("label"), F.sum(1 - c("label"))
    auc = (F.sum(c("average_") * y) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))
    return d.groupBy("category").agg(
        F.round(F.avg(F.pow(c("b") - y, 2)), 6).alias("brier"), F.round(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))), 6).alias("log_loss"), F.round(auc, 6).alias("auc")
    )


@query(f"WITH {HEADS} SELECT category, CASE WHEN base = label AND cand = label THEN 'both_right' WHEN base = label THEN 'regressed' WHEN cand = label THEN 'corrected' ELSE 'both_wrong' END AS transition, count(*) AS n FROM heads GROUP BY ALL")
def met9_transitions(t):
    return heads(t).groupBy("category", comparison.transition(c("label"), c("base"), c("cand")).alias("transition")).agg(F.count("*").alias("n"))


@query(f"WITH {HEADS}, m AS (SELECT *, unnest([CASE WHEN a < 0.1 THEN 'cheap' END, CASE WHEN b >= 0.5 THEN 'likely' END, CASE WHEN base <> cand THEN 'changed' END]) AS cohort FROM heads), r AS (SELECT category, avg(label) AS rate FROM cards GROUP BY category), g AS (SELECT cohort, category, count(*) AS n, avg(label) AS rate, 2 * sum(label * base) / nullif(sum(label) + sum(base), 0) AS f_base, 2 * sum(label * cand) / nullif(sum(label) + sum(cand), 0) AS f_cand FROM m WHERE cohort IS NOT NULL GROUP BY ALL) SELECT cohort, category, n, round(g.rate / nullif(r.rate, 0), 6) AS lift, round(coalesce(f_cand, 0) - coalesce(f_base, 0), 6) AS delta FROM g JOIN r USING (category)")
def met10_cohorts(t):
    d = heads(t)
    each = comparison.cohorts(d, {"cheap": c("a") < 0.1, "likely": c("b") >= 0.5, "changed": c("base") != c("cand")})
    f1_of = lambda p: F.coalesce(2 * F.sum(c("label") * c(p)) / F.nullif(F.sum("label") + F.sum(p), F.lit(0)), F.lit(0.0))
    g = each.groupBy("cohort", "category").agg(F.count("*").alias("n"), F.avg("label").alias("rate"), (f1_of("cand") - f1_of("base")).alias("delta"))
    whole = d.groupBy("category").agg(F.avg("label").alias("whole"))
    return g.join(whole, "category").select("cohort", "category", "n", F.round(c("rate") / F.nullif(c("whole"), F.lit(0.0)), 6).alias("lift"), F.round("delta", 6).alias("delta"))


@query(f"WITH {HEADS}, g AS (SELECT fold, category, coalesce(2 * sum(label * cand) / nullif(sum(label) + sum(cand), 0), 0) - coalesce(2 * sum(label * base) / nullif(sum(label) + sum(base), 0), 0) AS d FROM heads GROUP BY ALL), f AS (SELECT fold, avg(d) AS d FROM g GROUP BY fold) SELECT count(*) FILTER (WHERE d > 0) AS wins, round(min(d), 6) AS worst, round(avg(d), 6) AS mean, avg(d) >= 0.003 AND count(*) FILTER (WHERE d > 0) >= 4 AND min(d) >= -0.005 AS accepted FROM f")
def met20_fold_gate(t):
    f1_of = lambda p: F.coalesce(2 * F.sum(c("label") * c(p)) / F.nullif(F.sum("label") + F.sum(p), F.lit(0)), F.lit(0.0))
    by = heads(t).groupBy("fold", "category").agg((f1_of("cand") - f1_of("base")).alias("d")).groupBy("fold").agg(F.avg("d").alias("d"))
    wins = F.count_if(c("d") > 0)
    return by.agg(wins.alias("wins"), F.round(F.min("d"), 6).alias("worst"), F.round(F.avg("d"), 6).alias("mean"), ((F.avg("d") >= 0.003) & (wins >= 4) & (F.min("d") >= -0.005)).alias("accepted"))


@query("SELECT count(*) AS vectors, count(*) FILTER (WHERE norm = 0) AS zeros, round(min(norm), 5) AS least, round(quantile_cont(norm, 0.5), 5) AS middle, round(max(norm), 5) AS most FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)", "embeddings")
def met26_norms(d):
    n = d.select("vec_id", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm"))
    middle = windows.quantiles(n.withColumn("all", F.lit(0)), "norm", "vec_id", ["all"], [0.5]).select(F.round(c("quantiles")[0], 5).alias("middle"))
    return n.agg(F.count("*").alias("vectors"), F.count_if(c("norm") == 0).alias("zeros"), F.round(F.min("norm"), 5).alias("least"), F.round(F.max("norm"), 5).alias("most")).crossJoin(middle)


@query("WITH s AS (SELECT family, count(*) AS n FROM cards GROUP BY family) SELECT CASE WHEN n = 1 THEN 'single' WHEN n <= 2 THEN 'rare' ELSE 'repeated' END AS kind, count(*) AS rows, round(avg(label), 6) AS rate FROM cards JOIN s USING (family) GROUP BY ALL")
def met29_family_sizes(t):
    sizes = t("cards").groupBy("family").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    kind = F.when(c("n") == 1, "single").when(c("n") <= 2, "rare").otherwise("repeated")
    return sizes.groupBy(kind.alias("kind")).agg(F.sum("n").alias("rows"), F.round(F.sum("pos") / F.sum("n"), 6).alias("rate"))


@query("SELECT family, category, count(*) FILTER (WHERE label = 1 AND score >= 150000) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 150000) AS fp, count(*) FILTER (WHERE label = 1 AND score < 150000) AS fn, count(*) FILTER (WHERE label = 0 AND score < 150000) AS tn FROM cards GROUP BY ALL", "cards")
def agg17_confusion_by_component(d):
    return d.withColumn("pred", (c("score") >= 150000).cast("int")).groupBy("family", "category").agg(*metrics.confusion(c("label"), c("pred")))
