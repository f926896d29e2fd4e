"""Further forms of text, vectors, boxes and records, and the submission's format."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import geometry
from shelfwise.functions import text as T
from shelfwise.operators import retrieval
from shelfwise.plans.storage import place
from shelfwise.plans.texts import WORDS
from shelfwise.queries import NORMAL, query
from shelfwise.sources import scans, sinks

c = F.col

NAME = "p_name || ' ' || p_size || ' мл ' || p_type"


def name():
    return F.concat(c("p_name"), F.lit(" "), c("p_size").cast("string"), F.lit(" мл "), c("p_type"))


NORMAL_OF = "trim(regexp_replace(replace(lower(regexp_replace({0}, '<[^>]+>', ' ', 'g')), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g'))"
MASKED_OF = "trim(regexp_replace(regexp_replace(replace(replace(lower(regexp_replace({0}, '<[^>]+>', ' ', 'g')), 'ё', 'е'), '#', ' '), '[0-9]+([.,][0-9]+)*', '#', 'g'), '[^#0-9a-zа-я]+', ' ', 'g'))"

# ---- text ----


@query("SELECT doc_id, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '[^0-9a-zа-яё]+', ' ', 'g')) AS normal FROM documents", "documents")
def str4_keeps_yo(d):
    return d.select("doc_id", T.normalized_with_yo(c("text")).alias("normal"))


COMPOSED = f"({NAME}) || chr(10) || ({NAME}) || chr(10) || p_type"


@query(f"SELECT p_partkey, {MASKED_OF.format(COMPOSED)} AS masked, {NORMAL_OF.format(COMPOSED)} AS plain FROM part", "part")
def str8_row_text(d):
    """A row's canonical text, its numbers masked or not."""
    text = T.composed(name(), c("p_type"))
    return d.select("p_partkey", T.digit_masked(text).alias("masked"), T.normalized(text).alias("plain"))


@query(f"WITH m AS (SELECT p_partkey, string_split({MASKED_OF.format(NAME)}, ' ') AS w FROM part), a AS (SELECT *, list_filter(w, lambda t: t <> '#' AND regexp_matches(t, '[a-zа-я]')) AS alpha FROM m) SELECT p_partkey, CASE WHEN len(alpha) >= 3 AND coalesce(list_sum(list_transform(alpha, lambda t: length(regexp_replace(t, '[^a-zа-я]', '', 'g')))), 0) >= 10 AND list_contains(w, '#') THEN array_to_string(w, ' ') ELSE '' END AS masked FROM a", "part")
def str10_masked_name(d):
    """The masked name, if it holds a number and enough words and letters beside it."""
    return d.select("p_partkey", T.masked_name(name()).alias("masked"))


@query(f"SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE {NORMAL_OF.format('p_name')} || chr(10) || CASE WHEN p_size % 2 = 0 THEN '' ELSE {NORMAL_OF.format('p_type')} END END AS full_text FROM part", "part")
def str12_full_text(d):
    """Name and description, a line each; empty only if both are."""
    n, t = F.when(c("p_size") % 3 != 0, c("p_name")), F.when((c("p_size") % 3 != 0) & (c("p_size") % 2 != 0), c("p_type"))
    return d.select("p_partkey", T.full_text(n, t).alias("full_text"))


@query(f"SELECT {NORMAL_OF.format('p_name || chr(10) || p_name || chr(10) || p_type')} AS family, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1", "part")
def str14_family_key(d):
    """Rows of one normalised text."""
    return d.groupBy(T.normalized(T.composed(c("p_name"), c("p_type"))).alias("family")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


PRODUCT = NORMAL_OF.format("p_name || chr(10) || p_name || chr(10) || p_type")


@query(f"SELECT p_partkey, {PRODUCT} AS product FROM part", "part")
def str15_product_group(d):
    return d.select("p_partkey", T.normalized(T.composed(c("p_name"), c("p_type"))).alias("product"))


@query(f"""WITH w AS (SELECT p_partkey, string_split({NORMAL_OF.format(NAME)}, ' ') AS n, string_split({NORMAL_OF.format('p_type')}, ' ') AS d FROM part), t AS (SELECT p_partkey, list_concat(n, n, d) AS t FROM w)
SELECT p_partkey, CAST(len(list_distinct(list_filter(t, lambda x: length(x) >= 3 OR regexp_matches(x, '[0-9]')))) AS INTEGER) AS unigrams, CAST(len(list_distinct(list_transform(list_filter(range(1, len(t)), lambda i: length(t[i]) + length(t[i + 1]) >= 7), lambda i: t[i] || ' ' || t[i + 1]))) AS INTEGER) AS bigrams FROM t""", "part")
def str18_gated_features(d):
    """Words of three letters or with a digit, and neighbours of seven letters together, of the name twice and the description."""
    unigrams, bigrams = T.gated_features(name(), c("p_type"))
    return d.select("p_partkey", F.size(unigrams).alias("unigrams"), F.size(bigrams).alias("bigrams"))


GRAMS = "list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: w <> ''), lambda w: ' ' || w || ' ')"


@query(f"""WITH p AS (SELECT p_partkey, unnest({GRAMS}) AS w FROM part), n AS (SELECT p_partkey, w, unnest([3, 4, 5]) AS n FROM p), g AS (SELECT p_partkey, n, unnest(list_transform(range(0, greatest(length(w) - n, 0) + 1), lambda i: substring(w, CAST(i + 1 AS INTEGER), n))) AS gram FROM n WHERE n = 3 OR length(w) >= n)
SELECT p_partkey AS part, gram, count(*) AS n FROM g GROUP BY ALL""", "part")
def str19_word_bound_ngrams(d):
    """Runs of three to five characters of words padded by a blank each side; a word that is shorter counts once."""
    each = d.select(c("p_partkey").alias("part"), F.explode(T.word_bound_ngrams(F.lower("p_name"), 3, 5)).alias("gram"))
    return each.groupBy("part", "gram").agg(F.count("*").alias("n"))


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), l AS (SELECT doc_id, list_filter(w, lambda t: length(t) >= 2) AS w FROM w), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM l) SELECT doc_id, count(*) AS grams, count(DISTINCT gram) AS kinds FROM g GROUP BY doc_id", "documents")
def str20_word_ngrams(d):
    """Words of two letters at least, alone and with the next one."""
    w = d.select("doc_id", F.filter(T.tokens(c("text")), lambda t: F.length(t) >= 2).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return w.select("doc_id", F.explode(F.concat("w", pairs)).alias("gram")).groupBy("doc_id").agg(F.count("*").alias("grams"), F.countDistinct("gram").alias("kinds"))


@query("WITH m AS (SELECT doc_id, text, strpos(lower(text), 'license') AS s FROM documents) SELECT doc_id, substring(text, greatest(1, s - 180), s + 187 - greatest(1, s - 180)) AS context FROM m WHERE s > 0", "documents")
def str29_context(d):
    """A match with 180 characters either side."""
    s = F.instr(F.lower("text"), "license")
    start = F.greatest(F.lit(1), s - 180)
    return d.where(s > 0).select("doc_id", F.substring("text", start, s + 187 - start).alias("context"))


@query("SELECT doc_id, left(coalesce(text, ''), 40) AS head FROM documents", "documents")
def str33_slice(d):
    return d.select("doc_id", F.left(T.filled(c("text")), F.lit(40)).alias("head"))


@query("SELECT doc_id, rule FROM (SELECT doc_id, unnest([CASE WHEN regexp_matches(text, 'AKIA[A-Z0-9]{12}') THEN 'access key' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+') THEN 'address' END, CASE WHEN contains(text, 'PRIVATE KEY') THEN 'private key' END]) AS rule FROM documents) WHERE rule IS NOT NULL", "documents")
def str39_forbidden(d):
    """Texts that may not be published, with the rule that says so."""
    rules = {"access key": "AKIA[A-Z0-9]{12}", "address": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+", "private key": "PRIVATE KEY"}
    found = F.filter(F.array(*(F.when(c("text").rlike(p), F.lit(n)) for n, p in rules.items())), lambda r: r.isNotNull())
    return d.select("doc_id", F.explode(found).alias("rule"))


@query("WITH s AS (SELECT id, id % 30 AS s, id % 30 + 7 AS e FROM cards), t AS (SELECT id, s, e, unnest(range(8)) AS i FROM s) SELECT id, CAST(min(i) AS INTEGER) AS first_token, CAST(max(i) + 1 AS INTEGER) AS end_token FROM t WHERE i * 5 < e AND i * 5 + 4 > s GROUP BY id", "cards")
def str42_token_span(d):
    """The tokens that a span of characters overlaps; tokens here are four characters and a blank."""
    offsets = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((i * 5).alias("start"), (i * 5 + 4).alias("end")))
    first, end = T.token_span(offsets, c("id") % 30, c("id") % 30 + 7)
    return d.select("id", first.alias("first_token"), end.alias("end_token")).where("first_token IS NOT NULL")


@query("SELECT doc_id, CAST(CAST(regexp_matches(text, '[0-9]{4}') AS INTEGER) AS VARCHAR) || CAST(CAST(contains(text, '@') AS INTEGER) AS VARCHAR) || CAST(CAST(regexp_matches(lower(text), 'licen[cs]e') AS INTEGER) AS VARCHAR) AS mask FROM documents WHERE text IS NOT NULL", "documents")
def str43_cue_mask(d):
    """A digit for each cue: whether the text has it."""
    cues = [c("text").rlike("[0-9]{4}"), c("text").contains("@"), F.lower("text").rlike("licen[cs]e")]
    return d.where("text IS NOT NULL").select("doc_id", F.concat(*(x.cast("int").cast("string") for x in cues)).alias("mask"))


COMMENT = "'card ' || id || ' of ' || category || ' was judged by its score and its family only'"


def comment():
    return F.concat(F.lit("card "), c("id").cast("string"), F.lit(" of "), c("category"), F.lit(" was judged by its score and its family only"))


@query(f"SELECT id, '<комментарий>' || {COMMENT} || '<вердикт>' || CASE label WHEN 1 THEN 'не бан' ELSE 'бан' END AS answer FROM cards", "cards")
def str35_rendered(d):
    return d.select("id", sinks.rendered(comment(), c("label")).alias("answer"))


@query(f"SELECT id, {COMMENT} AS comment, CASE label WHEN 1 THEN 'не бан' ELSE 'бан' END AS verdict, label FROM cards", "cards")
def str36_parsed(d):
    answers = d.select("id", sinks.rendered(comment(), c("label")).alias("answer"))
    return answers.select("id", *sinks.parsed(c("answer")))


@query(f"WITH a AS (SELECT id, CASE id % 4 WHEN 0 THEN '<комментарий>' || {COMMENT} || '<вердикт>бан' WHEN 1 THEN '<комментарий>short<вердикт>бан' WHEN 2 THEN {COMMENT} || '<вердикт>бан' ELSE '<комментарий>' || {COMMENT} || '<вердикт>нет' END AS answer FROM cards) SELECT id, id % 4 = 0 AS valid FROM a", "cards")
def prj21_output_format(d):
    whole = F.concat(F.lit("<комментарий>"), comment(), F.lit("<вердикт>бан"))
    kinds = F.when(c("id") % 4 == 0, whole).when(c("id") % 4 == 1, "<комментарий>short<вердикт>бан").when(c("id") % 4 == 2, F.concat(comment(), F.lit("<вердикт>бан")))
    answer = kinds.otherwise(F.concat(F.lit("<комментарий>"), comment(), F.lit("<вердикт>нет")))
    return d.select("id", sinks.well_formed(answer).alias("valid"))


@query(f"SELECT id, '<комментарий>' || {COMMENT} || '<вердикт>' || CASE label WHEN 1 THEN 'не бан' ELSE 'бан' END AS answer FROM cards", "cards")
def snk7_submission(d):
    """Written as id and answer, and read again."""
    path = place(d.sparkSession)
    sinks.write_csv(d.select("id", sinks.rendered(comment(), c("label")).alias("answer")), path)
    return scans.csv(d.sparkSession, path, "id bigint, answer string")


# ---- hashes, vectors, records, boxes ----


@query(f"WITH n AS (SELECT doc_id, lang, {WORDS} AS w FROM documents), g AS (SELECT DISTINCT lang, doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, lang, w, unnest(range(0, len(w) - 4)) AS i FROM n WHERE len(w) >= 5)), k AS (SELECT lang, s, count(*) AS n FROM g GROUP BY ALL) SELECT lang, n AS texts, count(*) AS shingles FROM k GROUP BY ALL", "documents")
def fn3_shingle_hashes(d):
    """How many shingles of a language so many texts hold, by 64-bit hashes of language and words."""
    each = d.select("lang", F.explode(T.word_shingles(c("text"))).alias("s")).select("lang", F.xxhash64("lang", "s").alias("h"))
    return each.groupBy("lang", "h").agg(F.count("*").alias("texts")).groupBy("lang", "texts").agg(F.count("*").alias("shingles"))


@query("""SELECT id, sha256('{"category":"' || category || '","fold":' || fold || ',"id":' || id || ',"label":' || label || '}') AS digest FROM cards""", "cards")
def fn5_canonical_json(d):
    """The digest of a record as JSON, its keys sorted and without blanks."""
    return d.select("id", T.canonical_digest("category", "fold", "id", "label").alias("digest"))


@query("SELECT category, label, sha256(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY id)) AS digest FROM cards WHERE id % 50 = 0 GROUP BY ALL".replace(" WHERE id % 50 = 0", " GROUP BY category, label, family").replace(" GROUP BY ALL", "").replace("SELECT category, label,", "SELECT category, label, family,"), "cards")
def fn7_id_sequence(d):
    """The digest of ids in order, a line each, of each bounded group."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), "\n")
    return d.groupBy("category", "label", "family").agg(F.sha2(ids, 256).alias("digest"))


VECTORS = "SELECT a.vec_id AS a, b.vec_id AS b, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def vectors(t):
    e = t("embeddings")
    a = e.select(c("vec_id").alias("a"), c("embedding").cast("array<double>").alias("x"))
    return a.join(e.select((c("vec_id") - 1).alias("a"), c("vec_id").alias("b"), c("embedding").cast("array<double>").alias("y")), "a")


@query(f"WITH v AS ({VECTORS}) SELECT a, b, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))), 4) AS l1, round(sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) ** 2))), 4) AS l2, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] * y[i]))) / len(x), 5) AS product FROM v")
def fn14_distances(t):
    """Sum and root of squares of differences, and the mean absolute product."""
    return vectors(t).select("a", "b", F.round(T.l1("x", "y"), 4).alias("l1"), F.round(T.l2("x", "y"), 4).alias("l2"), F.round(T.mean_product("x", "y"), 5).alias("product"))


@query(f"WITH v AS ({VECTORS}), i AS (SELECT a, b, list_concat(x, y, list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i])), list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i])) AS z FROM v) SELECT a, b, len(z) AS size, round(list_sum(z), 4) AS total, round(z[3 * len(z) // 4 + 1], 6) AS first_product FROM i")
def fn15_interaction(t):
    z = vectors(t).select("a", "b", T.interaction("x", "y").alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + x)
    return z.select("a", "b", F.size("z").cast("bigint").alias("size"), F.round(total, 4).alias("total"), F.round(F.element_at("z", (3 * F.size("z") / 4).cast("int") + 1), 6).alias("first_product"))


@query("SELECT event_id, CASE WHEN json_valid(props) AND json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 80 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k FROM events", "events")
def fn23_fail_soft(d):
    """A field in its domain, else a default: a record that can't be read is no error."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return d.select("event_id", F.when(k.between(0, 80), k).otherwise(F.lit(-1).cast("bigint")).alias("k"))


@query("SELECT l_orderkey AS id, count(*) AS images FROM lineitem GROUP BY l_orderkey", "lineitem")
def fn24_json_array_length(d):
    lists = d.groupBy(c("l_orderkey").alias("id")).agg(F.to_json(F.collect_list("l_partkey")).alias("urls"))
    return lists.select("id", F.json_array_length("urls").cast("bigint").alias("images"))


QUAD = "[[l_partkey % 90, l_suppkey % 70], [l_partkey % 90 + CAST(l_quantity AS INTEGER), l_suppkey % 70 + l_linenumber], [l_partkey % 80 + 9, l_suppkey % 60 + 11], [l_suppkey % 50, l_partkey % 40 + 8]]"


def quad():
    p, s, q = c("l_partkey"), c("l_suppkey"), c("l_quantity").cast("int")
    return F.array(F.array(p % 90, s % 70), F.array(p % 90 + q, s % 70 + c("l_linenumber")), F.array(p % 80 + 9, s % 60 + 11), F.array(s % 50, p % 40 + 8))


def turn(a: str, b: str, p: str) -> str:
    return f"sign(({b}[1] - {a}[1]) * ({p}[2] - {a}[2]) - ({b}[2] - {a}[2]) * ({p}[1] - {a}[1]))"


def crossing(a: str, b: str, p: str, q: str) -> str:
    return f"({turn(a, b, p)} * {turn(a, b, q)} < 0 AND {turn(p, q, a)} * {turn(p, q, b)} < 0)"


Q = [f"q[{i}]" for i in (1, 2, 3, 4)]


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {QUAD} AS q FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {crossing(*Q)} OR {crossing(Q[1], Q[2], Q[3], Q[0])} AS crossed FROM x", "lineitem")
def fn26_crossings(d):
    """Whether opposite sides of a quadrilateral cross strictly."""
    q = d.select("l_orderkey", "l_linenumber", "l_partkey", quad().alias("q"))
    p = [c("q")[i] for i in range(4)]
    return q.select("l_orderkey", "l_linenumber", "l_partkey", (geometry.crosses(*p) | geometry.crosses(p[1], p[2], p[3], p[0])).alias("crossed"))


AREA = "abs(" + " + ".join(f"(q[{i}][1] * q[{i % 4 + 1}][2] - q[{i % 4 + 1}][1] * q[{i}][2])" for i in (1, 2, 3, 4)) + ") / 2"


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {QUAD} AS q FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, len(list_distinct(q)) >= 3 AND {AREA} > 0 AND NOT ({crossing(*Q)}) AND NOT ({crossing(Q[1], Q[2], Q[3], Q[0])}) AS valid FROM x", "lineitem")
def fn27_valid_quads(d):
    return d.select("l_orderkey", "l_linenumber", "l_partkey", geometry.valid_quad(quad()).alias("valid"))


# ---- weights of words and runs of characters together ----

UNION = f"""w AS (SELECT p_partkey AS node, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part), t AS (SELECT node, 'word' AS block, unnest(list_concat(list_filter(w, lambda x: length(x) >= 2), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w
  UNION ALL SELECT node, 'char', unnest(list_transform(range(0, greatest(length(p) - n, 0) + 1), lambda i: substring(p, CAST(i + 1 AS INTEGER), n))) FROM (SELECT node, p, unnest([3, 4, 5]) AS n FROM (SELECT node, unnest(list_transform(w, lambda x: ' ' || x || ' ')) AS p FROM w)) WHERE n = 3 OR length(p) >= n),
f AS (SELECT node, block, term, 1 + ln(count(*)) AS tf FROM t GROUP BY ALL), k AS (SELECT block, term, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY ALL HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM part)),
x AS (SELECT node, block, term, tf * idf AS x FROM f JOIN k USING (block, term)), l AS (SELECT node, block, sqrt(sum(x * x)) AS l FROM x GROUP BY ALL)"""


@query(f"WITH {UNION} SELECT node, block, term, round(x / l, 5) AS weight FROM x JOIN l USING (node, block)")
def ret1_tfidf_union(t):
    """Words alone and in pairs, and runs of three to five characters within words: each block of length 1."""
    text = F.lower(F.concat("p_name", F.lit(" "), "p_type"))
    words = F.split(text, " ")
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    d = t("part").select(c("p_partkey").alias("node"), words.alias("w"), T.word_bound_ngrams(text, 3, 5).alias("grams"))
    blocks = {"word": F.concat(F.filter("w", lambda x: F.length(x) >= 2), pairs), "char": c("grams")}
    n, out = d.count(), None
    for block, terms in blocks.items():
        part = retrieval.tfidf(retrieval.postings(d, "node", terms), n, 2, 0.9).select("node", F.lit(block).alias("block"), "term", F.round("weight", 5).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out
