"""Folds of whole components, and samples, over orders as cards and customers as components."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators import folds, windows
from shelfwise.queries import query

c = F.col

RANK = "substring(sha256('{0}' || chr(0) || CAST({1} AS VARCHAR)), 1, 32)"


def rank(seed: str, key: str = "id"):
    return T.stable_rank(F.lit(seed), c(key).cast("string"))


#: The kind of a component: its rows by category and label. Its hash differs between engines, so it decides no fold here.
def even_folds(seed: str, many: int, rows: str = "cards", stratum: str = "category") -> str:
    """SQL of the folds of components of one kind, dealt out in order of hashes."""
    return f"""SELECT family, CAST((row_number() OVER (PARTITION BY kind ORDER BY {RANK.format(seed, 'family')}, family) - 1) % {many} AS INTEGER) AS place, kind
  FROM (SELECT family, string_agg(stratum || '=' || n, ';' ORDER BY stratum) AS kind FROM (SELECT family, {stratum} AS stratum, count(*) AS n FROM {rows} GROUP BY ALL) GROUP BY family)"""


def evenness(dealt, many: int):
    """Folds of the components of each kind, as far apart as they are: at most one, since a kind is dealt out in turn."""
    each = dealt.groupBy("kind", "fold").agg(F.count("*").alias("n"))
    spread = each.groupBy("kind").agg(F.count("*").alias("folds"), F.sum("n").alias("components"), (F.max("n") - F.when(F.count("*") < many, 0).otherwise(F.min("n"))).alias("spread"))
    return spread.agg(F.sum("components").alias("components"), F.max("spread").cast("bigint").alias("spread"))


@query("SELECT category, count(DISTINCT family % 300) AS groups, 5 AS folds, 0 AS split FROM cards GROUP BY category")
def smp1_group_folds(t):
    """Each category has all folds, and no group lies in two."""
    d = t("cards").withColumn("family", (c("family") % 300).cast("string"))
    placed = folds.stratified_group_folds(d, "category", "family", "label", 5, "42")
    each = placed.groupBy("category", "family").agg(F.countDistinct("fold").alias("n"))
    split = each.groupBy("category").agg(F.count("*").alias("groups"), F.sum((c("n") > 1).cast("int")).cast("int").alias("split"))
    return split.join(placed.groupBy("category").agg(F.countDistinct("fold").cast("int").alias("folds")), "category").select("category", "groups", "folds", "split")


@query("SELECT count(DISTINCT family) AS components, count(DISTINCT family) AS placed, 0 AS split FROM cards")
def smp2_holdout_and_folds(t):
    """One part in seven held out, the rest in five folds: every component is in one place."""
    placed = folds.holdout_and_folds(t("cards"), "family", c("category"), 7, 3, 5, "input")
    both = (c("holdout") & (c("fold") >= 0)) | (~c("holdout") & (c("fold") < 0))
    return placed.agg(F.count("*").alias("components"), F.countDistinct("family").alias("placed"), F.sum(both.cast("int")).cast("int").alias("split"))


@query("")  # a search over trials; a test holds it against a plain one
def smp3_balanced_folds(t):
    """The most even of eight trials: families of five categories and two labels."""
    d = t("cards").withColumn("family", (c("family") % 200).cast("string"))
    strata = [f"{p}|{y}" for y in (0, 1) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
    return folds.balanced_folds(d, "family", strata, F.concat_ws("|", "category", c("label").cast("string")), 5, 17, 8)


@query(f"SELECT count(*) AS components, CAST(max(spread) AS BIGINT) AS spread FROM (SELECT kind, family FROM ({even_folds('kinds', 5)})) a JOIN (SELECT kind, max(n) - CASE WHEN count(*) < 5 THEN 0 ELSE min(n) END AS spread FROM (SELECT kind, place, count(*) AS n FROM ({even_folds('kinds', 5)}) GROUP BY ALL) GROUP BY kind) USING (kind)")
def smp3_even_kinds(t):
    """For any number of components: those of equal counts by category are dealt out evenly."""
    d = t("cards")
    kinds = folds.component_counts(d, "family", c("category")).select("family", F.to_json("counts").alias("kind"))
    return evenness(folds.kind_folds(d, "family", c("category"), 5, "kinds").join(kinds, "family"), 5)


@query("SELECT count(DISTINCT family) AS components, count(DISTINCT family) FILTER (WHERE family % 4 = 0) AS unsafe, 0 AS faults FROM cards")
def smp4_repeated_folds(t):
    """Three times over the components that are safe; the others have no fold in any."""
    d = t("cards").withColumn("safe", c("family") % 4 != 0)
    placed = folds.repeated_folds(d, "family", c("category"), "safe", 5, ["a", "b", "c"])
    out = [c(f"fold_{s}") for s in "abc"]
    unsafe = (out[0] == -1) & (out[1] == -1) & (out[2] == -1)
    fault = unsafe != (c("family") % 4 == 0)
    return placed.agg(F.count("*").alias("components"), F.sum(unsafe.cast("bigint")).alias("unsafe"), F.sum(fault.cast("int")).cast("int").alias("faults"))


@query("SELECT id, CAST(id % 3 AS INTEGER) AS fold FROM cards")
def smp5_frozen_folds(t):
    frozen = t("orders").select(c("o_orderkey").alias("id"), (c("o_orderkey") % 3).cast("int").alias("fold"))
    return folds.imported_folds(t("cards").select("id"), frozen, "id")


@query(f"WITH r AS (SELECT rep, id, label, row_number() OVER (PARTITION BY rep, label ORDER BY substring(sha256('donors' || chr(0) || CAST(rep AS VARCHAR) || chr(0) || CAST(id AS VARCHAR)), 1, 32)) AS place, count(*) OVER (PARTITION BY rep, label) AS n FROM cards, range(3) t(rep)) SELECT rep, label, n, count(*) AS donors, min(id) AS first FROM r WHERE place <= round(0.7 * n) GROUP BY ALL")
def smp7_repeated_donors(t):
    """Seven tenths of each label as donors, anew in each repeat: exact counts, chosen by order of hashes."""
    from shelfwise.operators import splits

    spark = t("cards").sparkSession
    d = t("cards").select("id", "label").crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "rep")))
    key = T.stable_rank(F.lit("donors"), c("rep").cast("string"), c("id").cast("string"))
    chosen = splits.exact_share(d, ["rep", "label"], key, 70, "id", rounded=True)
    return chosen.groupBy("rep", "label").agg(F.count("*").alias("n"), F.count_if("chosen").alias("donors"), F.min(F.when(c("chosen"), c("id"))).alias("first"))


@query("WITH g AS (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY CASE WHEN label = 1 THEN score ELSE -score END, id) AS worst, count(*) OVER (PARTITION BY category, label) AS n FROM cards) SELECT id, category FROM g WHERE worst > floor(0.1 * n)")
def smp9_clean_labels(t):
    """Without the tenth of each category and label whose scores contradict the label most."""
    key = F.when(c("label") == 1, c("score")).otherwise(-c("score"))
    placed = windows.ordinal(t("cards").withColumn("doubt", key), "doubt", "id", ["category", "label"])
    return placed.where(c("place_") >= F.floor(0.1 * c("n_"))).select("id", "category")


@query(f"""WITH f AS (SELECT family, id, row_number() OVER (PARTITION BY family ORDER BY {RANK.format('over', 'id')}) AS r, count(*) OVER (PARTITION BY family) AS n FROM cards WHERE label = 1),
q AS (SELECT family, n, CAST(3 + CASE WHEN {RANK.format('extra', 'family')} < '8' THEN 1 ELSE 0 END AS INTEGER) AS quota FROM f WHERE r = 1), s AS (SELECT family, n, unnest(range(quota)) AS slot FROM q)
SELECT s.family, CAST(slot AS INTEGER) AS slot, f.id FROM s JOIN f ON f.family = s.family AND f.r = 1 + slot % s.n""")
def smp10_family_oversample(t):
    """Every family equally often, with repeats: three slots, and a fourth for those whose hash says so."""
    return folds_oversample(t("cards").where("label = 1"))


def folds_oversample(d):
    from pyspark.sql import Window

    w = Window.partitionBy("family")
    placed = d.select("family", "id", F.row_number().over(w.orderBy(rank("over"))).alias("r"), F.count("*").over(w).alias("n"))
    quota = (F.lit(3) + (rank("extra", "family") < "8").cast("int")).cast("int")
    slots = placed.where("r = 1").select("family", "n", F.explode(F.sequence(F.lit(0), quota - 1)).alias("slot"))
    return slots.withColumn("r", (1 + c("slot") % c("n")).cast("int")).join(placed.select("family", "r", "id"), ["family", "r"]).select("family", "slot", "id")


@query(f"""WITH one AS (SELECT family, first(id ORDER BY score, id) AS id, min(score) AS score FROM cards GROUP BY family),
h AS (SELECT *, row_number() OVER (ORDER BY score, id) <= 20 AS hard FROM one) SELECT id, CASE WHEN hard THEN 'hard' ELSE 'random' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY hard ORDER BY {RANK.format('diverse', 'id')}) AS place FROM h) WHERE hard OR place <= 20""")
def smp11_family_diverse(t):
    """The hardest row of each family; of those the hardest and as many others by hash."""
    one = t("cards").groupBy("family").agg(F.min(F.struct("score", "id")).alias("m")).select("m.score", "m.id")
    hard = one.orderBy("score", "id").limit(20).select("id", F.lit("hard").alias("kind"))
    rest = one.join(hard, "id", "left_anti").orderBy(rank("diverse")).limit(20).select("id", F.lit("random").alias("kind"))
    return hard.unionByName(rest)


@query("SELECT family, id FROM (SELECT family, id, row_number() OVER (PARTITION BY family ORDER BY id) AS r FROM cards WHERE category = '1-URGENT') WHERE r = 1")
def smp16_first_of_component(t):
    """The first row, in order of ids, of each component that a scan meets."""
    return t("cards").where("category = '1-URGENT'").groupBy("family").agg(F.min("id").alias("id"))


@query(f"SELECT category, label, fold, id FROM (SELECT *, row_number() OVER (PARTITION BY category, label, fold ORDER BY {RANK.format('smoke', 'id')}) AS r FROM cards) WHERE r <= 4")
def smp18_smoke_cells(t):
    """Four rows of each cell of category, label and fold."""
    w = windows.top_per_group(t("cards").withColumn("key", rank("smoke")), ["category", "label", "fold"], [c("key")], 4)
    return w.select("category", "label", "fold", "id")


@query("""WITH p AS (SELECT a.l_orderkey AS query, b.l_orderkey AS donor, a.l_returnflag = b.l_returnflag AS same, abs(a.l_extendedprice - b.l_extendedprice) AS gap FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey),
r AS (SELECT query, same, donor, min(gap) AS gap FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query, same ORDER BY gap, donor) AS place FROM r) SELECT query, donor, CAST(same AS INTEGER) AS label, CAST(place AS INTEGER) AS place FROM k WHERE place <= 2""")
def smp22_balanced_hard_pairs(t):
    """For each query its two nearest donors of the same label and of the other."""
    d = t("lineitem").select("l_partkey", "l_suppkey", c("l_orderkey").alias("q"), c("l_returnflag").alias("y"), c("l_extendedprice").alias("x"))
    other = d.select("l_partkey", "l_suppkey", *(c(n).alias(f"{n}2") for n in "qyx"))
    pairs = d.join(other, ["l_partkey", "l_suppkey"]).where("q != q2").groupBy(c("q").alias("query"), c("q2").alias("donor"), (c("y") == c("y2")).cast("int").alias("label")).agg(F.min(F.abs(c("x") - c("x2"))).alias("gap"))
    return windows.top_per_group(pairs, ["query", "label"], [c("gap"), c("donor")], 2).select("query", "donor", "label", "place")


@query("SELECT id, category, label FROM (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY score, id) AS r FROM cards) WHERE label = 1 AND r <= 15 OR label = 0 AND r <= 30")
def smp31_rank_caps(t):
    """The lowest ranks of each label, of label 0 twice as many."""
    top = windows.top_per_group(t("cards"), ["category", "label"], [c("score"), c("id")], 30)
    return top.where((c("label") == 0) | (c("place") <= 15)).select("id", "category", "label")


@query(f"""WITH p AS (SELECT id, family, label, row_number() OVER (PARTITION BY family ORDER BY id) AS place, row_number() OVER (PARTITION BY family ORDER BY {RANK.format('permute', 'id')}) AS dealt FROM cards)
SELECT a.id, b.label FROM p a JOIN p b ON a.family = b.family AND a.place = b.dealt""")
def smp33_permuted_labels(t):
    """Labels dealt anew within each family: as many of each as before."""
    from pyspark.sql import Window

    w = Window.partitionBy("family")
    d = t("cards").select("family", "id", "label", F.row_number().over(w.orderBy("id")).alias("place"), F.row_number().over(w.orderBy(rank("permute"))).alias("dealt"))
    return d.select("family", "id", "place").join(d.select("family", c("dealt").alias("place"), "label"), ["family", "place"]).select("id", "label")
