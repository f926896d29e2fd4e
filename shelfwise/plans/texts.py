"""Text forms, features and evidence over the driver's documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.functions import unicode as U
from shelfwise.operators import evidence, retrieval
from shelfwise.queries import NORMAL, query

c = F.col
WORDS = f"list_filter(string_split({NORMAL}, ' '), lambda t: t <> '')"


@query("")
def str1_canonical_text(t):
    """All character references and compatibility forms; tests hold it against the plain function."""
    return t("documents").select("doc_id", U.canonical(c("text")).alias("canonical"), U.case_folded(c("text")).alias("folded"))


@query("SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g')) AS ocr_form FROM documents", "documents")
def str5_ocr_form(d):
    return d.select("doc_id", T.ocr_form(c("text")).alias("ocr_form"))


#: Numbers that stand alone, and what a masked name must hold: fixed values.
@query(r"""WITH n AS (SELECT p_partkey, list_filter(string_split(trim(regexp_replace(lower(p_name || ' ' || p_size || ' x'), '[^0-9a-zа-я]+', ' ', 'g')), ' '), lambda t: t <> '') AS w FROM part),
m AS (SELECT p_partkey, w, list_filter(w, lambda t: regexp_full_match(t, '[a-zа-я]+')) AS alpha, list_transform(w, lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '#' ELSE t END) AS masked FROM n)
SELECT p_partkey AS part, CASE WHEN list_contains(masked, '#') AND len(alpha) >= 2 AND length(list_aggregate(alpha, 'string_agg', '')) >= 8 THEN list_aggregate(masked, 'string_agg', ' ') ELSE '' END AS masked FROM m""", "part")
def str9_masked_quantity(d):
    """Numbers that stand alone are '#'; empty unless one is, beside two words of eight letters in all."""
    name = F.concat_ws(" ", "p_name", "p_size", F.lit("x"))
    return d.select(c("p_partkey").alias("part"), T.masked_quantity(name, 2, 8).alias("masked"))


@query(f"SELECT doc_id, len(list_distinct(list_filter({WORDS}, lambda t: length(t) >= 3 OR regexp_matches(t, '[0-9]')))) AS unigrams, len({WORDS}) AS words FROM documents", "documents")
def str18_gated_unigrams(d):
    return d.withColumn("w", T.tokens(c("text"))).select("doc_id", F.size(F.array_distinct(F.filter("w", lambda t: (F.length(t) >= 3) | t.rlike("[0-9]")))).cast("bigint").alias("unigrams"), F.size("w").cast("bigint").alias("words"))


@query("WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), g AS (SELECT p_partkey, unnest(list_concat(list_transform(range(1, greatest(length(w) + 2 - 3, 0) + 2), lambda i: substring(' ' || w || ' ', i, 3)), [])) AS gram FROM w WHERE w <> '') SELECT p_partkey AS part, gram, count(*) AS n FROM g WHERE length(gram) = 3 GROUP BY ALL", "part")
def str19_word_bound_grams(d):
    """Character triples of words padded by a blank each side, with their counts."""
    w = d.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("w")).where("w != ''")
    padded = F.concat(F.lit(" "), c("w"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(padded, i, F.lit(3)))
    return w.select(c("p_partkey").alias("part"), F.explode(grams).alias("gram")).where(F.length("gram") == 3).groupBy("part", "gram").agg(F.count("*").alias("n"))


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS bigram FROM w", "documents")
def str20_word_bigrams(d):
    return d.select("doc_id", F.explode(T.word_shingles(c("text"), 2)).alias("bigram"))


@query(r"SELECT doc_id, CAST(nullif(strpos(lower(coalesce(text, '')), 'license'), 0) AS INTEGER) AS found, CASE WHEN strpos(lower(coalesce(text, '')), 'license') > 0 THEN substring(text, greatest(1, strpos(lower(text), 'license') - 20), 47) END AS context FROM documents", "documents")
def str31_first_match(d):
    at = F.instr(F.lower("text"), "license")
    return d.select("doc_id", F.nullif(at, F.lit(0)).alias("found"), F.when(at > 0, F.substring("text", F.greatest(F.lit(1), at - 20), F.lit(47))).alias("context"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9]+', ' ', 'g'), ' +', ' ', 'g'), ' ') AS ablated, CAST(contains(text, '@') AS VARCHAR) || CAST(contains(text, '#') AS VARCHAR) AS cues FROM documents", "documents")
def str40_ablation_cues(d):
    ablated = F.trim(F.regexp_replace(F.regexp_replace(T.filled(c("text")), "[0-9]+", " "), " +", " "))
    return d.select("doc_id", ablated.alias("ablated"), F.concat(*(F.contains("text", F.lit(x)).cast("string") for x in "@#")).alias("cues"))


@query("SELECT part, list_sort(list_distinct(list_filter(w, lambda t: length(t) >= 4 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ('part', 'with')))) AS tokens FROM (SELECT p_partkey AS part, string_split(trim(regexp_replace(lower(p_name), '[^0-9a-zа-я]+', ' ', 'g')), ' ') AS w FROM part)", "part")
def str41_name_tokens(d):
    keep = lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$") & ~t.isin("part", "with")
    return d.select(c("p_partkey").alias("part"), F.array_sort(F.array_distinct(F.filter(T.tokens(c("p_name")), keep))).alias("tokens"))


@query("SELECT doc_id, sha1(encode(coalesce(text, ''))) AS sha1, sha256(encode(coalesce(text, ''))) AS sha256 FROM documents", "documents")
def fn1_fingerprints(d):
    raw = T.filled(c("text")).cast("binary")
    return d.select("doc_id", F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"))


@query("")
def str22_sentences(t):
    return t("documents").select("doc_id", F.posexplode(U.sentences(c("text"))).alias("place", "span")).select("doc_id", "place", "span.start", "span.end")


RULES = [
    evidence.Rule("license", r"licen[sc]e", 1, True, 2),
    evidence.Rule("address", r"[a-z0-9.]+@[a-z0-9]+", 1, True, 1),
    evidence.Rule("number", r"[0-9]{4,}", 1, False, 0),
    evidence.Rule("prose", r"[a-z]+ [a-z]+ [a-z]+ [a-z]+", 0, False, 0),
]


@query("")
def ev1_evidence(t):
    """A quote and concept for each labelled document, or the reason why there is none."""
    d = t("documents").join(t("labels").select("doc_id", c("toxic").alias("verdict")), "doc_id", "left")
    return evidence.extract(d, "doc_id", "text", "verdict", RULES)


TFIDF = f"""WITH t AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), f AS (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM t GROUP BY ALL),
d AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY term HAVING count(*) >= 2), w AS (SELECT doc_id, term, tf * idf AS w FROM f JOIN d USING (term)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"""


@query(f"{TFIDF} SELECT doc_id, term, round(w / norm, 5) AS weight FROM w JOIN n USING (doc_id)", "documents")
def ret1_tfidf(d):
    weights = retrieval.tfidf(retrieval.postings(d, "doc_id", T.tokens(c("text"))), d.count(), 2)
    return weights.select(c("node").alias("doc_id"), "term", F.round("weight", 5).alias("weight"))


@query("WITH k AS (SELECT a.id AS query, b.id AS donor, a.label = b.label AS useful, row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS rank FROM cards a JOIN cards b ON a.family = b.family AND a.fold <> b.fold WHERE a.fold = 0) SELECT count(DISTINCT query) AS queries, count(DISTINCT query) FILTER (WHERE useful AND rank <= 5) AS hit_at_5, count(*) FILTER (WHERE useful AND rank = 1) AS hit_at_1 FROM k")
def ret14_recall(t):
    d = t("cards").select("id", "label", "family", "fold")
    donors = d.where("fold != 0").select("family", c("id").alias("donor"), c("label").alias("donor_label"))
    best = donors.groupBy("family").agg(F.slice(F.sort_array(F.collect_list(F.struct("donor", "donor_label"))), 1, 5).alias("five"))
    asked = d.where("fold = 0").join(best, "family").withColumn("useful", F.transform("five", lambda x: x["donor_label"] == c("label")))
    return asked.agg(F.count("*").alias("queries"), F.count_if(F.exists("useful", lambda u: u)).alias("hit_at_5"), F.count_if(c("useful")[0]).alias("hit_at_1"))


@query("WITH m AS (SELECT i, avg(x) FILTER (WHERE label % 2 = 1) - avg(x) FILTER (WHERE label % 2 = 0) AS w FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i), x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings) SELECT vec_id, round(sum(x * w), 4) + 0.0 AS score FROM x JOIN m USING (i) GROUP BY vec_id")
def ret19_centroid_score(t):
    """Inner product with the difference of the two class means, which is one small vector."""
    e = t("embeddings").select("vec_id", "label", c("embedding").cast("array<double>").alias("x"))
    means = e.select("label", F.posexplode("x").alias("i", "v")).groupBy("i").agg((F.avg(F.when(c("label") % 2 == 1, c("v"))) - F.avg(F.when(c("label") % 2 == 0, c("v")))).alias("w"))
    direction = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("w"))
    return e.crossJoin(F.broadcast(direction)).select("vec_id", (F.round(T.dot(c("x"), c("w")), 4) + 0.0).alias("score"))
