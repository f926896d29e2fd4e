"""The engine's own queries over the driver's tables, each with equivalent SQL.

Cards are orders: id, category, label, fold and score columns. Texts are documents, vectors are embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators import metrics, priors, resolution, retrieval, splits, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

c = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        c("o_orderkey").alias("id"), c("o_orderpriority").alias("category"), (c("o_orderstatus") == "F").cast("int").alias("label"),
        (c("o_orderkey") % 5).cast("int").alias("fold"), F.round("o_totalprice", 2).alias("score"), c("o_custkey").alias("family"),
    )


CARDS = """cards AS (SELECT o_orderkey AS id, o_orderpriority AS category, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
  CAST(o_orderkey % 5 AS INTEGER) AS fold, round(o_totalprice, 2) AS score, o_custkey AS family FROM orders)"""
NORMAL = "trim(regexp_replace(replace(lower(regexp_replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g')), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"


def query(sql: str, source: str | None = None):
    """Registers a function of a source (cards or a table; without one, of a function that reads tables) with its SQL."""

    def register(f):
        if source is None:
            QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: cards(spark, sf_dir) if name == "cards" else table(spark, sf_dir, name))
        else:
            QUERIES[f.__name__] = lambda spark, sf_dir: f(cards(spark, sf_dir) if source == "cards" else table(spark, sf_dir, source))
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {CARDS}\n{sql}" if " cards" in sql and not sql.lstrip().startswith("WITH") else sql.replace("WITH ", f"WITH {CARDS}, ", 1) if " cards" in sql else sql)
        return f

    return register


# ---- text ----


@query(f"SELECT doc_id, {NORMAL} AS normal FROM documents", "documents")
def str1_normalize(d):
    return d.select("doc_id", T.normalized(c("text")).alias("normal"))


@query("SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ё', 'е'), '\\s+', ' ', 'g')) AS light FROM documents", "documents")
def str2_light(d):
    return d.select("doc_id", T.light(c("text")).alias("light"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace({NORMAL.replace('[^0-9a-zа-я]+', '[^.,0-9a-zа-я]+')}, '[0-9]+([.,][0-9]+)*', '#', 'g'), '[^#0-9a-zа-я]+', ' ', 'g')) AS masked FROM documents", "documents")
def str6_digit_mask(d):
    return d.select("doc_id", T.digit_masked(c("text")).alias("masked"))


@query("SELECT p_partkey, p_name || chr(10) || p_name || chr(10) || p_type AS composed, sha1(p_name || chr(10) || p_name || chr(10) || p_type) AS fingerprint FROM part".replace("sha1(", "sha256("), "part")
def str7_compose(p):
    text = T.composed(c("p_name"), c("p_type"))
    return p.select("p_partkey", text.alias("composed"), F.sha2(text, 256).alias("fingerprint"))


@query(f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(string_split({NORMAL}, ' '), lambda t: length(t) >= 3))), ' '), '') AS signature FROM documents", "documents")
def str13_token_signature(d):
    return d.select("doc_id", T.token_signature(c("text")).alias("signature"))


@query("", "documents")  # SQL over every character is too slow on whole texts; a test holds the operator
def str16_char_shingles(d):
    return d.select("doc_id", F.size(T.char_shingles(c("text"))).alias("shingles"))


@query(f"WITH n AS (SELECT doc_id, list_filter(string_split({NORMAL}, ' '), lambda t: t <> '') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM n), g AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS s FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)) SELECT documents.doc_id, CAST(count(DISTINCT s) AS INTEGER) AS shingles FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id GROUP BY documents.doc_id", "documents")
def str17_word_shingles(d):
    return d.select("doc_id", F.size(T.word_shingles(c("text"))).alias("shingles"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE rtrim(substring(text, 1, 280), ' ') || ' … ' || ltrim(right(text, 117), ' ') END AS compact FROM documents", "documents")
def str21_compact(d):
    return d.select("doc_id", T.compacted(c("text"), 400).alias("compact"))


@query("SELECT doc_id, CAST(least(3, len(regexp_extract_all(text, '[0-9]+'))) AS INTEGER) AS numbers FROM documents", "documents")
def str30_capped_count(d):
    return d.select("doc_id", T.capped_count(c("text"), "[0-9]+").alias("numbers"))


@query("SELECT lang, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS words FROM documents GROUP BY lang", "documents")
def str32_lengths(d):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return d.groupBy("lang").agg(F.sum(F.length("text")).alias("characters"), F.sum(words).alias("words"))


@query("SELECT doc_id, substring(sha256('seed' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 32) AS key FROM documents", "documents")
def fn4_stable_rank(d):
    return d.select("doc_id", T.stable_rank(F.lit("seed"), c("doc_id").cast("string")).alias("key"))


# ---- numeric and vector functions ----


@query("SELECT id, round(1 / (1 + exp(-(score - 100000) / 50000)), 9) AS p, round(CASE WHEN score / 600000 < 0.3 THEN 0.5 * (score / 600000) / 0.3 ELSE 0.5 + 0.5 * (score / 600000 - 0.3) / 0.7 END, 9) AS calibrated, round(ln(1 + score) / 10, 9) AS log_length FROM cards", "cards")
def fn9_sigmoid_calibration(d):
    return d.select("id", F.round(T.sigmoid((c("score") - 100000) / 50000), 9).alias("p"), F.round(T.piecewise(c("score") / 600000, F.lit(0.3)), 9).alias("calibrated"), F.round(F.log1p("score") / 10, 9).alias("log_length"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn14_cosine(t):
    e = t("embeddings")
    a, b = e.select(c("vec_id").alias("a"), c("embedding").alias("x")), e.select((c("vec_id") - 1).alias("a"), c("vec_id").alias("b"), c("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(T.cosine(c("x"), c("y")), 6).alias("cosine"), F.round(T.dot(c("x"), c("y")), 6).alias("dot"))


@query("SELECT id, CAST(bit_count(xor(id, family)) AS INTEGER) AS distance FROM cards", "cards")
def fn19_hamming(d):
    return d.select("id", T.hamming(c("id"), c("family")).alias("distance"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_valid(props), false) AS valid FROM events".replace("json_extract_string(props, '$.k') AS k, ", ""), "events")
def fn23_json_valid(d):
    return d.select("event_id", F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("valid"))


# ---- projections and filters ----


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) > 8000 THEN 'long' WHEN regexp_matches(text, '[%&$#*]{3}') THEN 'marks' ELSE 'kept' END AS reason FROM documents) GROUP BY reason", "documents")
def prj13_reject_counters(d):
    n = F.length("text")
    reason = F.when(n < 200, "short").when(n > 8000, "long").when(c("text").rlike("[%&$#*]{3}"), "marks").otherwise("kept")
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT id, CASE category WHEN '1-URGENT' THEN score * 0.7 WHEN '2-HIGH' THEN score * 0.5 ELSE score * 0.3 END AS routed FROM cards", "cards")
def prj8_routing(d):
    return d.select("id", F.when(c("category") == "1-URGENT", c("score") * 0.7).when(c("category") == "2-HIGH", c("score") * 0.5).otherwise(c("score") * 0.3).alias("routed"))


# ---- joins ----


@query("SELECT id, c_mktsegment AS segment, c_nationkey AS nation FROM cards JOIN customer ON c_custkey = family")
def jn1_inner(t):
    return t("cards").join(t("customer"), c("family") == c("c_custkey")).select("id", c("c_mktsegment").alias("segment"), c("c_nationkey").alias("nation"))


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def jn6_reindex_default(t):
    n = t("orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT doc_id, 'unlabelled' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def jn10_anti_both(t):
    d, l = t("documents").select("doc_id"), t("labels").select("doc_id")
    return d.join(l, "doc_id", "left_anti").withColumn("side", F.lit("unlabelled")).unionByName(l.join(d, "doc_id", "left_anti").withColumn("side", F.lit("unknown")))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jn11_semi(t):
    return t("documents").select("doc_id").join(t("labels").where("quality = 1"), "doc_id", "left_semi")


@query("WITH s AS (SELECT a.id AS query, b.id AS donor, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS rank FROM cards a JOIN cards b ON a.family = b.family AND a.category = b.category AND a.fold <> b.fold) SELECT query, donor, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 3")
def jn14_cross_fold_donors(t):
    d = t("cards")
    # Three donors of each fold are enough for the first three of other folds: a family's pairs stay bounded.
    few = windows.top_per_group(d, ["family", "category", "fold"], [c("id")], 3)
    a = d.select("family", "category", c("id").alias("query"), c("fold").alias("fold_a"))
    b = few.select("family", "category", c("id").alias("donor"), c("fold").alias("fold_b"))
    pairs = a.join(b, ["family", "category"]).where("fold_a != fold_b")
    return windows.top_per_group(pairs, ["query"], [c("donor")], 3).select("query", "donor", c("place").alias("rank"))


@query("WITH m AS (SELECT family, category, min(id) AS left_id FROM cards GROUP BY ALL HAVING count(*) BETWEEN 2 AND 16) SELECT DISTINCT left_id, id AS right_id FROM cards JOIN m USING (family, category) WHERE id <> left_id")
def jn16_star_edges(t):
    return resolution.star_edges(t("cards").withColumn("key", F.concat_ws("|", "family", "category")), "key", "id", 16)


@query(f"""WITH n AS (SELECT doc_id, list_distinct(list_filter(string_split({NORMAL}, ' '), lambda t: t <> '')) AS w FROM documents),
e AS (SELECT doc_id, len(w) AS n, unnest(w) AS item FROM n), r AS (SELECT item FROM e GROUP BY item HAVING count(*) BETWEEN 2 AND 20),
k AS (SELECT e.* FROM e JOIN r USING (item)), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS rare FROM k a JOIN k b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 3),
j AS (SELECT a, b, rare, len(list_intersect(x.w, y.w)) AS shared, len(x.w) + len(y.w) AS whole FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b)
SELECT a, b, rare, round(CAST(shared AS DOUBLE) / (whole - shared), 9) AS jaccard FROM j WHERE CAST(shared AS DOUBLE) / (whole - shared) >= 0.5""")
def jn17_rare_overlap(t):
    pairs = resolution.overlap_pairs(t("documents"), "doc_id", F.array_distinct(T.tokens(c("text"))), 3, 0.5, 20)
    return pairs.withColumn("jaccard", F.round("jaccard", 9))


# ---- aggregates ----


@query("SELECT category, count(*) AS n, sum(label) AS positives, round(avg(label), 9) AS rate, count(DISTINCT family) AS families, count(DISTINCT family) FILTER (WHERE label = 1) AS positive_families FROM cards GROUP BY category".replace("sum(label)", "CAST(sum(label) AS BIGINT)"), "cards")
def agg2_stats(d):
    return d.groupBy("category").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.round(F.avg("label"), 9).alias("rate"), F.countDistinct("family").alias("families"), F.countDistinct(F.when(c("label") == 1, c("family"))).alias("positive_families"))


@query("SELECT family, count(*) AS n, count(DISTINCT label) AS labels FROM cards GROUP BY family HAVING count(*) > 1 AND count(DISTINCT label) > 1", "cards")
def agg4_conflicts(d):
    return d.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).where("n > 1 AND labels > 1")


@query("WITH g AS (SELECT category, label, count(*) AS n FROM cards GROUP BY ALL) SELECT category, label, n, round(n / sum(n) OVER (PARTITION BY category), 9) AS share FROM g", "cards")
def agg7_crosstab(d):
    n = d.groupBy("category", "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy("category")), 9))


@query("SELECT category, count(*) FILTER (WHERE fold = 0) AS f0, count(*) FILTER (WHERE fold = 1) AS f1, count(*) FILTER (WHERE fold = 2) AS f2, count(*) FILTER (WHERE fold = 3) AS f3, count(*) FILTER (WHERE fold = 4) AS f4 FROM cards GROUP BY category", "cards")
def agg8_pivot(d):
    out = d.groupBy("category").pivot("fold", [0, 1, 2, 3, 4]).count().na.fill(0)
    return out.select("category", *(c(str(i)).alias(f"f{i}") for i in range(5)))


@query("SELECT category, median(score) AS median, quantile_cont(score, 0.95) AS p95, quantile_cont(score, 0.99) AS p99 FROM cards GROUP BY category".replace("median(score)", "round(median(score), 6)").replace("quantile_cont(score, 0.95)", "round(quantile_cont(score, 0.95), 6)").replace("quantile_cont(score, 0.99)", "round(quantile_cont(score, 0.99), 6)"), "cards")
def agg10_quantiles(d):
    q = windows.quantiles(d, "score", "id", ["category"], [0.5, 0.95, 0.99])
    return q.select("category", *(F.round(c("quantiles")[i], 6).alias(n) for i, n in enumerate(("median", "p95", "p99"))))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(string_split({NORMAL}, ' '), lambda t: t <> '')) AS term FROM documents) GROUP BY term", "documents")
def agg12_term_counts(d):
    return d.select(F.explode(T.tokens(c("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT family, category, count(*) AS n, min(id) AS first FROM cards GROUP BY ALL) SELECT family, arg_min(category, (-n, first)) AS mode FROM g GROUP BY family".replace("arg_min(category, (-n, first))", "first(category ORDER BY n DESC, first)"), "cards")
def agg13_mode(d):
    n = d.groupBy("family", "category").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return n.groupBy("family").agg(F.min_by("category", F.struct(-c("n"), "first")).alias("mode"))


@query("SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY ALL", "embeddings")
def agg14_vector_mean(d):
    return d.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(c("x").cast("double")), 6).alias("mean"))


@query("SELECT family, min(label) = max(label) AS unanimous, CAST(max(label) AS INTEGER) AS label FROM cards GROUP BY family", "cards")
def agg15_unanimity(d):
    return d.groupBy("family").agg((F.min("label") == F.max("label")).alias("unanimous"), F.max("label").alias("label"))


@query("SELECT category, round(coalesce(sum(score * fold) / nullif(sum(fold), 0), 0.5), 4) AS weighted FROM cards GROUP BY category", "cards")
def agg18_weighted_mean(d):
    return d.groupBy("category").agg(F.round(F.coalesce(F.sum(c("score") * c("fold")) / F.nullif(F.sum("fold"), F.lit(0)), F.lit(0.5)), 4).alias("weighted"))


@query("SELECT family, CASE WHEN sum(label) = count(*) THEN 'all' WHEN sum(label) = 0 THEN 'none' ELSE 'partial' END AS status FROM cards GROUP BY family", "cards")
def agg20_rollup(d):
    return d.groupBy("family").agg(F.when(F.sum("label") == F.count("*"), "all").when(F.sum("label") == 0, "none").otherwise("partial").alias("status"))


@query("SELECT category, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(corr(score, label), 9) AS correlation FROM cards GROUP BY category", "cards")
def agg22_mean_std_corr(d):
    return d.groupBy("category").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"), F.round(F.corr("score", c("label").cast("double")), 9).alias("correlation"))


@query("SELECT category, first(id ORDER BY score DESC, id) AS best, first(id ORDER BY score, id) AS worst FROM cards GROUP BY category", "cards")
def agg24_argmax(d):
    return d.groupBy("category").agg(F.min_by("id", F.struct(-c("score"), "id")).alias("best"), F.min_by("id", F.struct("score", "id")).alias("worst"))


@query("SELECT family, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS digest FROM cards GROUP BY family", "cards")
def agg25_id_digest(d):
    return d.groupBy("family").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ","), 256).alias("digest"))


# ---- windows ----


@query("SELECT id, round(CASE WHEN count(*) OVER w > 1 THEN (row_number() OVER (PARTITION BY fold, category ORDER BY score, id) - 1) / (count(*) OVER w - 1.0) ELSE 0 END, 9) AS rank01 FROM cards WINDOW w AS (PARTITION BY fold, category)", "cards")
def win3_rank01(d):
    placed = windows.ordinal(d, "score", "id", ["fold", "category"])
    return placed.select("id", F.round(windows.scaled_place(c("place_"), c("n_")), 9).alias("rank01"))


@query("SELECT id, (rank() OVER (PARTITION BY category ORDER BY family) + (count(*) OVER (PARTITION BY category, family) - 1) / 2.0) AS average_rank FROM cards".replace("/ 2.0) AS", "/ 2.0)::DOUBLE AS"), "cards")
def win6_average_rank(d):
    return windows.ordinal(d, "family", "id", ["category"]).select("id", c("average_").cast("double").alias("average_rank"))


@query("SELECT id, count(*) OVER w - 1 AS loo_count, round(CASE WHEN count(*) OVER w > 1 THEN (sum(label) OVER w - label) / (count(*) OVER w - 1.0) END, 9) AS loo_mean FROM cards WINDOW w AS (PARTITION BY family)", "cards")
def win9_leave_one_out(d):
    return windows.leave_one_out(d, ["family"], "label").select("id", "loo_count", F.round("loo_mean", 9).alias("loo_mean"))


@query("SELECT id, count(*) OVER w AS family_size, CASE WHEN count(*) OVER w = 1 THEN 'singleton' WHEN min(label) OVER w = max(label) OVER w THEN 'consistent' ELSE 'conflicting' END AS kind FROM cards WINDOW w AS (PARTITION BY family)", "cards")
def win22_family_kind(d):
    stats = d.groupBy("family").agg(F.count("*").alias("family_size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    kind = F.when(c("family_size") == 1, "singleton").when(c("lo") == c("hi"), "consistent").otherwise("conflicting")
    return d.select("id", "family").join(stats, "family").select("id", "family_size", kind.alias("kind"))


@query("SELECT id, CAST(ntile(4) OVER (PARTITION BY category ORDER BY score, id) AS INTEGER) AS quartile, CASE WHEN score <= 50000 THEN 0 WHEN score <= 150000 THEN 1 WHEN score <= 300000 THEN 2 ELSE 3 END AS bin FROM cards", "cards")
def win11_bins(d):
    placed = windows.ordinal(d, "score", "id", ["category"])
    return placed.select("id", windows.tile(c("place_"), c("n_"), 4).alias("quartile"), F.when(c("score") <= 50000, 0).when(c("score") <= 150000, 1).when(c("score") <= 300000, 2).otherwise(3).alias("bin"))


@query("WITH b AS (SELECT score, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM cards GROUP BY score) SELECT score, n, pos, CAST(sum(n) OVER w AS BIGINT) AS seen, CAST(sum(pos) OVER w AS BIGINT) AS tp FROM b WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)", "cards")
def win13_tie_block_sweep(d):
    return metrics.score_blocks(d, "score", "label")


@query("SELECT id, category, score FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY id) AS r FROM cards) WHERE r = 1", "cards")
def win15_first_per_key(d):
    return windows.first_per_key(d.select("id", "category", "score", "family"), ["family"], ["id"]).select("id", "category", "score")


@query("SELECT category, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS place FROM cards) WHERE place <= 10", "cards")
def win17_top_per_group(d):
    return windows.top_per_group(d, ["category"], [F.desc("score"), c("id")], 10).select("category", "id", "place")


# ---- sets ----


@query("SELECT family FROM cards WHERE label = 1 EXCEPT SELECT family FROM cards WHERE label = 0", "cards")
def set2_difference(d):
    return d.where("label = 1").select("family").subtract(d.where("label = 0").select("family"))


@query("SELECT family FROM cards WHERE fold = 0 INTERSECT SELECT family FROM cards WHERE fold = 1", "cards")
def set3_intersection(d):
    return d.where("fold = 0").select("family").intersect(d.where("fold = 1").select("family"))


@query("SELECT count(*) FILTER (WHERE d.doc_id IS NULL) = 0 AS subset, count(*) FILTER (WHERE l.doc_id IS NULL) = 0 AND count(*) FILTER (WHERE d.doc_id IS NULL) = 0 AS same FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def set5_coverage(t):
    both = t("documents").select("doc_id", F.lit(1).alias("d")).distinct().join(t("labels").select("doc_id", F.lit(1).alias("l")).distinct(), "doc_id", "full")
    missing = both.agg(F.count(F.when(c("d").isNull(), 1)).alias("unknown"), F.count(F.when(c("l").isNull(), 1)).alias("uncovered"))
    return missing.select((c("unknown") == 0).alias("subset"), ((c("unknown") == 0) & (c("uncovered") == 0)).alias("same"))


# ---- resolution ----


@query("""WITH RECURSIVE e AS (SELECT DISTINCT left_id AS a, id AS b FROM (SELECT id, min(id) OVER (PARTITION BY l_partkey) AS left_id, count(*) OVER (PARTITION BY l_partkey) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey AS id FROM lineitem WHERE l_orderkey % 20 = 1)) WHERE id <> left_id AND n <= 3),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a, b FROM s UNION SELECT reach.a, s.b FROM reach JOIN s ON s.a = reach.b),
n AS (SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_orderkey % 20 = 1)
SELECT node, least(node, coalesce(min(b), node)) AS component FROM n LEFT JOIN reach ON a = node GROUP BY node""".replace(" WHERE l_orderkey % 20 = 1", ""))
def er2_components(t):
    rows = t("lineitem").select("l_partkey", c("l_orderkey").alias("id"))
    return resolution.components(rows.select(c("id").alias("node")), resolution.star_edges(rows.withColumn("key", c("l_partkey").cast("string")), "key", "id", 3))


ORACLE_SQL.pop("er2_components")  # the recursion is quadratic in a component; tests hold the operator against union-find


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS degree, count(DISTINCT l_orderkey) BETWEEN 2 AND 32 AS admitted FROM lineitem GROUP BY l_partkey", "lineitem")
def er14_key_degrees(d):
    return resolution.key_degrees(d, "l_partkey", "l_orderkey", 32)


@query("SELECT family, CASE WHEN count(DISTINCT fold) > 1 THEN 'recurs' ELSE 'one fold' END AS regime, count(*) > 0.02 * (SELECT count(*) FROM cards) AS oversized FROM cards GROUP BY family")
def er21_recurrence(t):
    d = t("cards")
    whole = d.agg(F.count("*").alias("whole"))
    sizes = d.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("folds"))
    return sizes.join(F.broadcast(whole)).select("family", F.when(c("folds") > 1, "recurs").otherwise("one fold").alias("regime"), (c("n") > 0.02 * c("whole")).alias("oversized"))


# ---- splits ----


@query("SELECT id, CAST(('0x' || substring(sha256('folds' || chr(0) || CAST(family AS VARCHAR)), 1, 8))::BIGINT % 5 AS INTEGER) AS component_fold FROM cards", "cards")
def hash_component_folds(d):
    return d.select("id", splits.hash_folds(c("family").cast("string"), 5, "folds").alias("component_fold"))


@query("SELECT id, category, label FROM (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY substring(sha256('quota' || chr(0) || CAST(id AS VARCHAR)), 1, 32)) AS r FROM cards) WHERE r <= 20", "cards")
def smp15_quota(d):
    return splits.quota(d, ["category", "label"], T.stable_rank(F.lit("quota"), c("id").cast("string")), 20).select("id", "category", "label")


@query("""WITH k AS (SELECT *, substring(sha256('hard' || chr(0) || CAST(id AS VARCHAR)), 1, 32) AS key FROM cards), h AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score, key) <= 10 AS hard FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY category, hard ORDER BY key) AS place FROM h) SELECT id, category, CASE WHEN hard THEN 'hard' ELSE 'random' END AS kind FROM r WHERE hard OR place <= 10""".replace("FROM cards)", "FROM cards)"), "cards")
def smp8_hard_random(d):
    return splits.hard_random(d, "score", T.stable_rank(F.lit("hard"), c("id").cast("string")), ["category"], 20).select("id", "category", "kind")


@query("SELECT id, CAST(row_number() OVER (PARTITION BY category, label ORDER BY substring(sha256('turn' || chr(0) || CAST(id AS VARCHAR)), 1, 32)) AS INTEGER) AS turn FROM cards", "cards")
def smp14_round_robin(d):
    return splits.round_robin(d, ["category", "label"], T.stable_rank(F.lit("turn"), c("id").cast("string"))).select("id", "turn")


# ---- retrieval ----


def asked(benchmark: DataFrame) -> DataFrame:
    return benchmark.select((-1 - c("item_id")).alias("query"), F.explode(F.array_distinct(T.tokens(c("text")))).alias("term"))


TERMS = f"""WITH d AS (SELECT doc_id AS node, list_filter(string_split({NORMAL}, ' '), lambda t: t <> '') AS t FROM documents),
p AS (SELECT node, dl, term, count(*) AS tf FROM (SELECT node, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT -1 - item_id AS query, unnest(list_distinct(list_filter(string_split({NORMAL}, ' '), lambda t: t <> ''))) AS term FROM benchmark),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
w AS (SELECT node, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)) AS weight FROM p JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) USING (term), s),
r AS (SELECT query, node AS donor, round(sum(weight), 6) AS score FROM q JOIN w USING (term) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, donor) AS INTEGER) AS rank FROM r)"""


@query(f"{TERMS} SELECT query, donor, rank FROM k WHERE rank <= 10")
def ret4_bm25(t):
    docs = t("documents").select(c("doc_id").alias("node"), T.normalized(c("text")).alias("words"))
    return retrieval.best_donors(docs, asked(t("benchmark")), 10, (1.5, 0.75)).select("query", "donor", "rank")


@query("""WITH a AS (SELECT id AS query, 'score' AS channel, id + 1 AS donor, CAST(1 + id % 7 AS INTEGER) AS rank FROM cards), b AS (SELECT id AS query, 'text' AS channel, id + 1 + id % 2 AS donor, CAST(1 + id % 3 AS INTEGER) AS rank FROM cards),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT query, donor, round(sum(CASE channel WHEN 'score' THEN 1.0 ELSE 0.5 END / (60 + rank)), 12) AS rrf_score, count(DISTINCT channel) AS channels, min(rank) AS best_rank FROM u GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY rrf_score DESC, channels DESC, best_rank, donor) AS INTEGER) AS fused_rank FROM f""".replace("CASE channel WHEN 'score' THEN 1.0 ELSE 0.5 END /", "CASE channel WHEN 'score' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END /"))
def ret10_rrf(t):
    d = t("cards")
    a = d.select(c("id").alias("query"), F.lit("score").alias("channel"), (c("id") + 1).alias("donor"), (1 + c("id") % 7).cast("int").alias("rank"))
    b = d.select(c("id").alias("query"), F.lit("text").alias("channel"), (c("id") + 1 + c("id") % 2).alias("donor"), (1 + c("id") % 3).cast("int").alias("rank"))
    return retrieval.fused(a.unionByName(b), {"score": 1.0, "text": 0.5})


# ---- priors ----


@query("""WITH f AS (SELECT family, avg(label) AS p FROM cards WHERE fold <> 0 GROUP BY family), g AS (SELECT category, avg(label) AS p FROM cards WHERE fold <> 0 GROUP BY category)
SELECT id, round(coalesce(f.p, g.p), 9) AS prior, CASE WHEN f.p IS NOT NULL THEN 'family' WHEN g.p IS NOT NULL THEN 'category' END AS stage FROM cards LEFT JOIN f ON f.family = cards.family LEFT JOIN g ON g.category = cards.category WHERE fold = 0""")
def jn13_mean_cascade(t):
    d = t("cards").withColumn("family", c("family").cast("string"))
    out = priors.cascade(d.where("fold = 0"), d.where("fold != 0"), ["family", "category"], "label")
    return out.select("id", F.round("prior", 9).alias("prior"), "stage")


@query("WITH g AS (SELECT a.id, count(b.id) AS support, avg(b.label) AS prior FROM cards a LEFT JOIN cards b ON a.family = b.family AND a.fold <> b.fold GROUP BY a.id) SELECT id, support, round(prior, 9) AS prior FROM g")
def pri5_cross_fold(t):
    return priors.cross_fold(t("cards"), "family", "label", "fold").select("id", "support", F.round("prior", 9).alias("prior"))


# ---- metrics ----


@query("WITH p AS (SELECT category, label, CAST(score >= 150000 AS INTEGER) AS pred FROM cards), g AS (SELECT category, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn FROM p GROUP BY category) SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM g", "cards")
def met1_f1(d):
    out = metrics.f1_by(d.withColumn("pred", (c("score") >= 150000).cast("int")), ["category"], "label", "pred")
    return out.withColumn("f1", F.round("f1", 9))


@query("WITH p AS (SELECT category, label, CAST(score >= 150000 AS INTEGER) AS pred FROM cards), g AS (SELECT category, 2.0 * sum(label * pred) / nullif(sum(label) + sum(pred), 0) AS f1 FROM p GROUP BY category) SELECT round(avg(coalesce(f1, 0)), 9) AS macro_f1, count(*) AS categories FROM g", "cards")
def met3_macro_f1(d):
    out = metrics.macro_f1(d.withColumn("pred", (c("score") >= 150000).cast("int")), "category", "label", "pred")
    return out.withColumn("macro_f1", F.round("macro_f1", 9))


@query("WITH b AS (SELECT category, score, count(*) AS n, sum(label) AS pos FROM cards GROUP BY ALL), s AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp FROM b WINDOW w AS (PARTITION BY category ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT category, CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos * CAST(tp AS DOUBLE) / seen) / nullif(sum(pos), 0), 9) AS ap FROM s GROUP BY category", "cards")
def met4_average_precision(d):
    return metrics.average_precision(d, "score", "label", ["category"]).withColumn("ap", F.round("ap", 9))


@query("WITH b AS (SELECT category, score, count(*) AS n, sum(label) AS pos FROM cards GROUP BY ALL), s AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY category) AS p FROM b WINDOW w AS (PARTITION BY category ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), f AS (SELECT category, score, CAST(2 * tp AS DOUBLE) / (seen + p) AS f1 FROM s) SELECT category, first(score ORDER BY f1 DESC, score DESC) AS threshold, round(max(f1), 9) AS f1 FROM f GROUP BY category", "cards")
def fus12_best_threshold(d):
    return metrics.best_threshold(d, "score", "label", ["category"]).withColumn("f1", F.round("f1", 9))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of each category, ties as one step."""
    return QUERIES["met4_average_precision"](spark, sf_dir)
