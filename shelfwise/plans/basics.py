"""Projections, predicates, joins, aggregates, windows and orders, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators import dense, metrics, priors, resolution, retrieval, windows
from shelfwise.plans.texts import WORDS
from shelfwise.queries import query
from shelfwise.sources.scans import checked

c = F.col

RANK = "substring(sha256('{0}' || chr(0) || CAST({1} AS VARCHAR)), 1, 32)"


def rank(seed: str, key: str = "id") -> Column:
    return T.stable_rank(F.lit(seed), c(key).cast("string"))


# ---- projections and predicates ----


@query("SELECT id, score FROM cards", "cards")
def prj1_columns(d):
    return d.select("id", "score")


@query("SELECT id, round(score * (1 + fold) - label, 6) AS weight FROM cards", "cards")
def prj2_computed(d):
    return d.select("id", F.round(c("score") * (1 + c("fold")) - c("label"), 6).alias("weight"))


@query("SELECT id, coalesce(CAST(nullif(family % 7, 3) AS VARCHAR), '') AS text FROM cards", "cards")
def prj3_null_fill(d):
    return d.select("id", T.filled(F.nullif(c("family") % 7, F.lit(3))).alias("text"))


ODD = "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 'nan'::DOUBLE ELSE (id % 4)::DOUBLE END"


def odd() -> Column:
    return F.when(c("id") % 5 == 0, None).when(c("id") % 5 == 1, F.lit(0.0)).when(c("id") % 5 == 2, F.lit(float("nan"))).otherwise((c("id") % 4).cast("double"))


@query(f"WITH o AS (SELECT id, {ODD} AS x FROM cards) SELECT id, CASE WHEN isnan(x) THEN 'nan' WHEN x IS NULL OR x = 0 THEN '' ELSE CAST(x AS VARCHAR) END AS text FROM o", "cards")
def prj4_falsy_to_empty(d):
    """Nothing and zero are empty; a number that is none keeps its name."""
    return d.select("id", T.falsy_to_empty(odd()).alias("text"))


@query(f"WITH o AS (SELECT id, {ODD} AS x FROM cards) SELECT id, CASE WHEN x IS NULL OR isnan(x) THEN '' ELSE CAST(x AS VARCHAR) END AS text FROM o", "cards")
def prj5_nan_to_empty(d):
    return d.select("id", T.nan_to_empty(odd()).alias("text"))


@query("SELECT id, label FROM cards WHERE label = 1 AND NOT (score < 50000 OR fold = 2)", "cards")
def prj7_mask(d):
    return d.where((c("label") == 1) & ~((c("score") < 50000) | (c("fold") == 2))).select("id", "label")


@query("SELECT id FROM cards WHERE category IN ('1-URGENT', '5-LOW')", "cards")
def prj9_membership(d):
    return d.where(c("category").isin("1-URGENT", "5-LOW")).select("id")


@query("SELECT id, CASE WHEN score > 250000 THEN 'high' WHEN score > 100000 THEN 'middle' ELSE 'low' END AS band FROM cards", "cards")
def prj10_conditional(d):
    return d.select("id", F.when(c("score") > 250000, "high").when(c("score") > 100000, "middle").otherwise("low").alias("band"))


@query("SELECT doc_id, regexp_matches(lower(coalesce(text, '')), 'licen[cs]e|copyright') AS found FROM documents", "documents")
def prj11_regex(d):
    return d.select("doc_id", F.lower(T.filled(c("text"))).rlike("licen[cs]e|copyright").alias("found"))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'ring') OR regexp_matches(p_type, '^(ECONOMY|SMALL)')", "part")
def prj12_contains(d):
    return d.where(c("p_name").contains("ring") | c("p_type").rlike("^(ECONOMY|SMALL)")).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 12 AND l_discount * 100 >= 3.5", "lineitem")
def prj14_informative(d):
    """Enough contrast and enough entropy."""
    return d.where((c("l_quantity") >= 12) & (c("l_discount") * 100 >= 3.5)).select("l_orderkey", "l_linenumber")


@query("SELECT l_partkey, l_orderkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) <= 28)", "lineitem")
def prj15_degree_cap(d):
    admitted = d.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("degree")).where("degree <= 28").select("l_partkey")
    return d.select("l_partkey", "l_orderkey").join(admitted, "l_partkey", "left_semi")


@query("SELECT a.id AS query, count(*) AS donors, min(b.id) AS first FROM cards a JOIN cards b ON a.category = b.category AND floor(a.score / 1000) = floor(b.score / 1000) AND a.fold <> b.fold AND a.family <> b.family GROUP BY a.id")
def prj16_eligible_donors(t):
    """Donors of like score, of another fold and another component."""
    d = t("cards").withColumn("band", F.floor(c("score") / 1000))
    a = d.select("category", "band", c("id").alias("query"), c("fold").alias("fold_a"), c("family").alias("family_a"))
    b = d.select("category", "band", c("id").alias("donor"), c("fold").alias("fold_b"), c("family").alias("family_b"))
    pairs = a.join(b, ["category", "band"]).where("fold_a != fold_b AND family_a != family_b")
    return pairs.groupBy("query").agg(F.count("*").alias("donors"), F.min("donor").alias("first"))


@query(f"WITH o AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'inf'::DOUBLE ELSE {ODD} END AS x FROM cards) SELECT id, x FROM o WHERE isfinite(x)", "cards")
def prj17_finite(d):
    x = F.when(c("id") % 11 == 0, F.lit(float("inf"))).otherwise(odd())
    return d.select("id", x.alias("x")).where(T.finite(c("x")))


@query("SELECT doc_id, toxic = 1 AS flag FROM labels", "labels")
def prj18_strict_boolean(d):
    """Only 'true' and 'false' are read; anything else is an error."""
    return d.select("doc_id", T.strict_boolean(F.when(c("toxic") == 1, "true").otherwise("false")).alias("flag"))


@query("SELECT event_id, list_contains(json_keys(props), 'k') AS required, list_contains(json_keys(props), 'label') AS forbidden FROM events", "events")
def prj19_keys(d):
    keys = F.json_object_keys("props")
    return d.select("event_id", F.array_contains(keys, "k").alias("required"), F.array_contains(keys, "label").alias("forbidden"))


# ---- joins ----


@query("SELECT o_orderkey AS id, c_mktsegment AS segment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def jn3_left_complete(t):
    """A left join in which every row must find its partner, once."""
    customer = t("customer").select(c("c_custkey").alias("o_custkey"), c("c_mktsegment").alias("segment"))
    out = t("orders").select(c("o_orderkey").alias("id"), "o_custkey").join(customer, "o_custkey", "left")
    return out.select("id", checked(c("segment"), c("segment").isNotNull(), "a row has no partner").alias("segment"))


@query("SELECT o_orderkey AS id, n_name AS nation, r_name AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def jn4_chained(t):
    out = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).join(t("nation"), c("c_nationkey") == c("n_nationkey")).join(t("region"), c("n_regionkey") == c("r_regionkey"))
    return out.select(c("o_orderkey").alias("id"), c("n_name").alias("nation"), c("r_name").alias("region"))


@query("SELECT CAST(9999999 - id AS BIGINT) AS place, id, score FROM cards WHERE fold = 1")
def jn5_reindex(t):
    """Values in the order of a list of keys, which each must have one."""
    order = t("cards").where("fold = 1").select((9999999 - c("id")).alias("place"), "id")
    out = order.join(t("cards").select("id", "score"), "id", "left")
    return out.select("place", "id", checked(c("score"), c("score").isNotNull(), "a key has no value").alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS left_value, l_extendedprice AS right_value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def jn8_positional(t):
    """Two tables row by row, by position, whose keys must agree."""
    one = windows.first_per_key(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    a = one.select("l_orderkey", "l_linenumber", c("l_partkey").alias("key_a"), c("l_quantity").alias("left_value"))
    b = one.select("l_orderkey", "l_linenumber", c("l_partkey").alias("key_b"), c("l_extendedprice").alias("right_value"))
    both = a.join(b, ["l_orderkey", "l_linenumber"], "full")
    return both.select("l_orderkey", "l_linenumber", checked(c("left_value"), c("key_a").eqNullSafe(c("key_b")), "keys differ").alias("left_value"), "right_value")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn = (conv_id % 3)")
def jn9_ordinal(t):
    """An index into a list, as a join on the index."""
    asked = t("conversations").select("conv_id", (c("conv_id") % 3).alias("turn")).distinct()
    return t("conversations").select("conv_id", c("turn").cast("bigint").alias("turn"), "role").join(asked, ["conv_id", "turn"], "left_semi").select("conv_id", "turn", "role")


@query("SELECT id FROM cards WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND family NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def jn12_exclusion(t):
    used = t("orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("id"))
    bad = t("customer").where("c_acctbal < 0").select(c("c_custkey").alias("family"))
    return t("cards").select("id", "family").join(used, "id", "left_anti").join(bad, "family", "left_anti").select("id")


MAJORITY = """f AS (SELECT category, family, count(*) AS n, avg(label) AS m FROM cards WHERE fold <> 0 GROUP BY ALL HAVING count(*) >= 2 AND avg(label) <> 0.5 AND greatest(avg(label), 1 - avg(label)) >= 0.6),
g AS (SELECT category, family % 50 AS band, count(*) AS n, avg(label) AS m FROM cards WHERE fold <> 0 GROUP BY ALL HAVING count(*) >= 3 AND avg(label) <> 0.5 AND greatest(avg(label), 1 - avg(label)) >= 0.5)"""


@query(f"WITH {MAJORITY} SELECT id, CASE WHEN f.m IS NOT NULL THEN CAST(f.m > 0.5 AS INTEGER) WHEN g.m IS NOT NULL THEN CAST(g.m > 0.5 AS INTEGER) ELSE CAST(score >= 150000 AS INTEGER) END AS predicted, CASE WHEN f.m IS NOT NULL THEN 'family' WHEN g.m IS NOT NULL THEN 'band' ELSE 'base' END AS source FROM cards c LEFT JOIN f ON f.category = c.category AND f.family = c.family LEFT JOIN g ON g.category = c.category AND g.band = c.family % 50 WHERE fold = 0")
def jn13_donor_cascade(t):
    """The majority of a key's donors where they are enough and agree enough; the first key of several that has one, else the base."""
    d = t("cards").withColumn("band", c("family") % 50)
    rows, donors = d.where("fold = 0"), d.where("fold != 0")
    out = rows
    for key, least, sure in (("family", 2, 0.6), ("band", 3, 0.5)):
        out = out.join(priors.majority(donors, ["category", key], "label", least, sure).withColumnRenamed("majority", f"of_{key}").select("category", key, f"of_{key}"), ["category", key], "left")
    source = F.when(c("of_family").isNotNull(), "family").when(c("of_band").isNotNull(), "band").otherwise("base")
    return out.select("id", F.coalesce("of_family", "of_band", (c("score") >= 150000).cast("int")).alias("predicted"), source.alias("source"))


@query(f"WITH q AS (SELECT item_id AS query, unnest(list_distinct({WORDS})) AS term FROM benchmark), d AS (SELECT doc_id AS donor, unnest(list_distinct({WORDS})) AS term FROM documents), h AS (SELECT query, donor, count(*) AS hits FROM q JOIN d USING (term) GROUP BY ALL) SELECT query, donor, hits, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, donor) AS rank FROM h) WHERE rank <= 5")
def jn18_postings_hits(t):
    """Donors that hold most of a query's terms, by the postings of those terms only."""
    asked = t("benchmark").select(c("item_id").alias("query"), F.explode(F.array_distinct(T.tokens(c("text")))).alias("term"))
    docs = t("documents").select(c("doc_id").alias("node"), T.normalized(c("text")).alias("words"))
    return retrieval.best_donors(docs, asked, 5).select("query", "donor", c("score").cast("bigint").alias("hits"), "rank")


DENSE = "SELECT a.vec_id AS query, b.vec_id AS donor, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"


@query(f"WITH s AS ({DENSE} WHERE a.vec_id % 20 = 0) SELECT query, donor, cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, donor) AS rank FROM s) WHERE rank <= 10")
def jn21_dense_top_k(t):
    e = t("embeddings").select("vec_id", "embedding")
    return dense.top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)


@query(f"WITH s AS ({DENSE}) SELECT query, donor, cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, donor) AS rank FROM s) WHERE rank <= 5")
def jn22_nearest_neighbours(t):
    """The neighbours of every vector, itself left out."""
    e = t("embeddings").select("vec_id", "embedding")
    return dense.top_k(e, e, "vec_id", "embedding", 5)


NEAREST = "SELECT q.id, d.id AS donor, d.label, abs(d.id - q.id) AS gap, row_number() OVER (PARTITION BY q.id ORDER BY abs(d.id - q.id), d.id) AS r FROM cards q JOIN cards d ON q.fold = 0 AND d.fold <> 0 AND d.id BETWEEN q.id - 60 AND q.id + 60"


@query(f"WITH n AS ({NEAREST}) SELECT id, CAST(list(donor ORDER BY r) AS BIGINT[]) AS donors, round(avg(label), 9) AS prior FROM n WHERE r <= 3 GROUP BY id")
def jn24_nearest(t):
    """The three donors of nearest id, of two as near the smaller, and their mean label."""
    found = resolution.nearest(t("cards").where("fold = 0").select("id"), t("cards").where("fold != 0").select("id", "label"), "id", "label", 3)
    return found.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "donor"))), lambda x: x["donor"]).alias("donors"), F.round(F.avg("label"), 9).alias("prior"))


QUOTE = "substring(text, 11, 14)"


@query(f"WITH q AS (SELECT doc_id, text, {QUOTE} AS quote FROM documents WHERE length(text) > 30), n AS (SELECT doc_id, quote, (length(text) - length(replace(text, quote, ''))) // length(quote) AS n, strpos(text, quote) AS pos FROM q) SELECT doc_id, CAST(n AS INTEGER) AS occurrences, CASE WHEN n = 1 THEN CAST(pos - 1 AS INTEGER) END AS start FROM n")
def jn26_grounded_once(t):
    """Where a quote stands, if its text holds it exactly once."""
    d = t("documents").where(F.length("text") > 30).select("doc_id", "text", F.substring("text", 11, 14).alias("quote"))
    n = ((F.length("text") - F.length(F.replace("text", "quote"))) / F.length("quote")).cast("int")
    return d.select("doc_id", n.alias("occurrences"), F.when(n == 1, F.instr("text", c("quote")) - 1).alias("start"))


@query("SELECT id, h.name AS hypothesis, 'is ' || id || ' ' || h.name || '?' AS prompt FROM cards, (VALUES ('safe', 0), ('risky', 1)) h(name, place) WHERE label = h.place OR fold = 0")
def jn29_hypotheses(t):
    """A prompt for each row and hypothesis; the hypotheses are a parameter."""
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).alias("place")) for i, n in enumerate(("safe", "risky")))))
    d = t("cards").withColumn("h", named).where((c("label") == c("h.place")) | (c("fold") == 0))
    return d.select("id", c("h.name").alias("hypothesis"), F.concat(F.lit("is "), c("id").cast("string"), F.lit(" "), c("h.name"), F.lit("?")).alias("prompt"))


@query("SELECT family AS query, list(id ORDER BY score, id) AS donors FROM cards WHERE fold <> 0 GROUP BY family")
def jn31_aligned_donors(t):
    """Each family's donors in canonical order; families are of bounded size."""
    held = t("cards").where("fold != 0").groupBy(c("family").alias("query")).agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("held"))
    return held.select("query", F.transform("held", lambda x: x["id"]).alias("donors"))


# ---- aggregates ----


@query("SELECT category, count(*) AS n FROM cards GROUP BY category", "cards")
def agg1_counts(d):
    return d.groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey", "lineitem")
def agg3_distinct(d):
    return d.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@query("SELECT family, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, count(DISTINCT label) AS labels, first(id ORDER BY score, id) AS example FROM cards GROUP BY family", "cards")
def agg5_with_example(d):
    return d.groupBy("family").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.countDistinct("label").alias("labels"), F.min_by("id", F.struct("score", "id")).alias("example"))


@query("SELECT family, list_sort(list(DISTINCT category)) AS categories FROM cards GROUP BY family", "cards")
def agg19_sets(d):
    return d.groupBy("family").agg(F.sort_array(F.collect_set("category")).alias("categories"))


# ---- windows ----


@query("SELECT id, round((row_number() OVER (ORDER BY score, id) - 1) / (count(*) OVER () - 1.0), 9) AS rank01 FROM cards", "cards")
def win1_rank01(d):
    """Over the whole table, without a task that holds it."""
    placed = windows.ordinal(d.withColumn("all", F.lit(0)), "score", "id", ["all"])
    return placed.select("id", F.round(windows.scaled_place(c("place_"), c("n_")), 9).alias("rank01"))


@query("SELECT id, CAST(row_number() OVER (PARTITION BY category ORDER BY score, id) AS BIGINT) AS place FROM cards", "cards")
def win5_ordinal(d):
    return windows.ordinal(d.where(checked(F.lit(True), T.finite(c("score")), "a score isn't finite")), "score", "id", ["category"]).select("id", (c("place_") + 1).alias("place"))


@query("SELECT id, count(*) OVER (PARTITION BY family) AS size, (SELECT count(DISTINCT x.category) FROM cards x WHERE x.family = cards.family) AS categories FROM cards")
def win10_group_size(t):
    stats = t("cards").groupBy("family").agg(F.count("*").alias("size"), F.countDistinct("category").alias("categories"))
    return t("cards").select("id", "family").join(stats, "family").select("id", "size", "categories")


@query("SELECT id, CAST(row_number() OVER w AS BIGINT) AS seen, CAST(sum(label) OVER w AS BIGINT) AS tp FROM cards WINDOW w AS (ORDER BY floor(score / 1000) DESC, id DESC ROWS UNBOUNDED PRECEDING)", "cards")
def win12_row_sweep(d):
    """Rows and positives from the highest score down to each row; ties in descending order of id."""
    return metrics.row_sweep(d.withColumn("band", F.floor(c("score") / 1000).cast("double")), "band", "label", -c("id")).select("id", "seen", "tp")


@query("SELECT family, first(id ORDER BY fold, id) AS id FROM cards GROUP BY family", "cards")
def win16_first_seen(d):
    """Of each key the row seen first, by source and place."""
    return windows.first_per_key(d.select("family", "fold", "id"), ["family"], ["fold", "id"]).select("family", "id")


@query("WITH p AS (SELECT id, CASE WHEN count(*) OVER a > 1 THEN (sum(label) OVER a - label) / (count(*) OVER a - 1.0) END AS exact, CASE WHEN count(*) OVER b > 1 THEN (sum(label) OVER b - label) / (count(*) OVER b - 1.0) END AS loose FROM cards WINDOW a AS (PARTITION BY family, category), b AS (PARTITION BY family)) SELECT id, round(coalesce(exact, loose), 9) AS prior, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN loose IS NOT NULL THEN 'loose' END AS source FROM p")
def win23_leave_one_out_cascade(t):
    """The mean of the others of the exact family, else of the loose one, else nothing."""
    d = windows.leave_one_out(t("cards").select("id", "family", "category", "label"), ["family", "category"], "label").select("id", "family", "label", c("loo_mean").alias("exact"))
    d = windows.leave_one_out(d, ["family"], "label").withColumnRenamed("loo_mean", "loose")
    return d.select("id", F.round(F.coalesce("exact", "loose"), 9).alias("prior"), F.when(c("exact").isNotNull(), "exact").when(c("loose").isNotNull(), "loose").alias("source"))


# ---- orders ----


def placed(df: DataFrame, *order: Column, n: int) -> DataFrame:
    """The first n rows in order, with place from 1: one task sees n rows of each partition and no more."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query("SELECT id, CAST(row_number() OVER (ORDER BY category, score DESC, id) AS INTEGER) AS place FROM cards QUALIFY place <= 100", "cards")
def srt1_mixed(d):
    return placed(d, c("category"), F.desc("score"), c("id"), n=100).select("id", "place")


@query("SELECT id, CAST(row_number() OVER (ORDER BY fold, id) AS INTEGER) AS place FROM cards QUALIFY place <= 100", "cards")
def srt2_stable(d):
    """Equal keys in the order of rows, which is a key of its own."""
    return placed(d, c("fold"), c("id"), n=100).select("id", "place")


@query("SELECT id, CAST(row_number() OVER (ORDER BY (fold, category, id)) AS INTEGER) AS place FROM cards QUALIFY place <= 100", "cards")
def srt3_tuples(d):
    return placed(d.withColumn("key", F.struct("fold", "category", "id")), c("key"), n=100).select("id", "place")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY {RANK.format('blind', 'id')}) AS INTEGER) AS place FROM cards QUALIFY place <= 100", "cards")
def srt4_hash_order(d):
    return placed(d.withColumn("key", rank("blind")), c("key"), n=100).select("id", "place")


@query("SELECT id, CAST(row_number() OVER (ORDER BY label, -score, id) AS INTEGER) AS place FROM cards QUALIFY place <= 100", "cards")
def srt5_lexsort(d):
    return placed(d, c("label"), -c("score"), c("id"), n=100).select("id", "place")


@query("SELECT id, score FROM cards ORDER BY score DESC, id LIMIT 25", "cards")
def srt6_top(d):
    return d.orderBy(F.desc("score"), "id").limit(25).select("id", "score")


@query("SELECT family AS query, id AS donor FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, id) AS r FROM cards) WHERE r <= 3", "cards")
def srt7_top_per_query(d):
    return windows.top_per_group(d, ["family"], [F.desc("score"), c("id")], 3).select(c("family").alias("query"), c("id").alias("donor"))


@query("SELECT category, label, round(avg(score), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY score DESC, id) AS r FROM cards) WHERE r <= 5 GROUP BY ALL", "cards")
def srt8_mean_of_top(d):
    top = windows.top_per_group(d.select("category", "label", "score", "id"), ["category", "label"], [F.desc("score"), c("id")], 5)
    return top.groupBy("category", "label").agg(F.round(F.avg("score"), 6).alias("mean"))


@query("SELECT family AS query, id AS donor FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, id) AS r FROM cards WHERE score >= 200000) WHERE r <= 4", "cards")
def srt9_early_stop(d):
    """Donors in order until there are four or the next is below the threshold."""
    return windows.top_per_group(d.where("score >= 200000"), ["family"], [F.desc("score"), c("id")], 4).select(c("family").alias("query"), c("id").alias("donor"))


@query(f"SELECT category, label, id FROM (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY {RANK.format('cap', 'id')}) AS r FROM cards) WHERE r <= 32", "cards")
def srt10_sample_cap(d):
    return windows.top_per_group(d.withColumn("key", rank("cap")), ["category", "label"], [c("key")], 32).select("category", "label", "id")
