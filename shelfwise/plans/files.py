"""Files written and read again: parts, folds, ordered lines, id lists; and what a registry may hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.plans.storage import place
from shelfwise.queries import query
from shelfwise.sources import scans, sinks

c = F.col


@query("SELECT CAST(id AS VARCHAR) AS id, category, CAST(label AS VARCHAR) AS label FROM cards", "cards")
def src2_string_ids(d):
    """Ids stay text, whatever they look like."""
    path = place(d.sparkSession)
    sinks.write_csv(d.select("id", "category", "label"), path)
    return scans.csv(d.sparkSession, path, "id string, category string, label string")


@query("SELECT CAST(id AS VARCHAR) AS id, category FROM cards", "cards")
def src3_csv_texts(d):
    path = place(d.sparkSession)
    sinks.write_csv(d.select("id", "category"), path)
    return scans.csv_texts(d.sparkSession, path)


@query("SELECT CAST(id AS BIGINT) AS position, category FROM cards", "cards")
def src9_ordered_jsonl(d):
    """Lines that carry their place: all places from 0 on must be there, once each."""
    path = place(d.sparkSession)
    sinks.write_jsonl(d.select(c("id").alias("position"), "category"), path, gzip=True)
    return scans.in_order(scans.jsonl(d.sparkSession, path, "position bigint, category string"), "position")


@query("SELECT id, label FROM cards", "cards")
def src18_parts(d):
    """Parts of one table, each with a header and compressed, as one."""
    path = place(d.sparkSession)
    parts = [f"{path}/part{i}" for i in range(3)]
    for i, part in enumerate(parts):
        sinks.write_csv(d.where(c("id") % 3 == i).select("id", "label"), part, gzip=True)
    return scans.csv(d.sparkSession, parts, "id bigint, label int")


@query("SELECT id, label, fold FROM cards", "cards")
def src20_fold_jsonl(d):
    """A folder of JSON lines for each fold; the fold is the folder's."""
    path = place(d.sparkSession)
    sinks.write_jsonl(d.select("id", "label", "fold"), path, by=["fold"])
    return scans.jsonl(d.sparkSession, path, "id bigint, label int, fold int")


LISTS = """CASE id % 3 WHEN 0 THEN '["' || id || '","x"]' WHEN 1 THEN '[{"id":"' || id || '"},{"id":"y"}]' ELSE '{"ids":["' || id || '"]}' END"""


@query("SELECT id, CASE id % 3 WHEN 0 THEN [CAST(id AS VARCHAR), 'x'] WHEN 1 THEN [CAST(id AS VARCHAR), 'y'] ELSE [CAST(id AS VARCHAR)] END AS ids FROM cards", "cards")
def src22_id_lists(d):
    """A list of ids, of records with one, or a record with the list."""
    return d.select("id", scans.id_list(F.expr(LISTS)).alias("ids"))


@query("SELECT id, category FROM cards", "cards")
def snk2_gzip_csv(d):
    path = place(d.sparkSession)
    sinks.write_csv(d.select("id", "category"), path, gzip=True)
    return scans.csv(d.sparkSession, path, "id bigint, category string")


@query("SELECT doc_id, length(text) AS characters, contains(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL", "documents")
def snk3_line_ends(d):
    """Texts with line ends and quotes inside come back as they went."""
    path = place(d.sparkSession)
    sinks.write_csv(d.where("text IS NOT NULL").select("doc_id", "text"), path)
    back = scans.csv(d.sparkSession, path, "doc_id bigint, text string")
    return back.select("doc_id", F.length("text").cast("bigint").alias("characters"), c("text").contains("\n").alias("lines"))


@query("SELECT doc_id, text, lang FROM documents", "documents")
def snk5_jsonl(d):
    path = place(d.sparkSession)
    sinks.write_jsonl(d.select("doc_id", "text", "lang"), path)
    return scans.jsonl(d.sparkSession, path, "doc_id bigint, text string, lang string")


@query("SELECT o_custkey AS tree, sha256(string_agg('order/' || o_orderkey || chr(0) || sha256(CAST(o_totalprice AS VARCHAR)), chr(10) ORDER BY 'order/' || o_orderkey)) AS digest FROM orders GROUP BY o_custkey")
def fn8_tree_digest(t):
    """Paths and their contents' digests, sorted by path: one digest for each tree."""
    leaf = F.struct(F.concat(F.lit("order/"), c("o_orderkey").cast("string")).alias("path"), F.sha2(c("o_totalprice").cast("string"), 256).alias("digest"))
    return t("orders").groupBy(c("o_custkey").alias("tree")).agg(T.tree_digest(F.collect_list(leaf)).alias("digest"))


@query("SELECT id, category FROM cards WHERE fold <> 4", "cards")
def gov4_development_rows(d):
    """The registry without what is sealed; a component on both sides is an error."""
    registry = d.withColumn("split", F.when(c("fold") == 4, "sealed").otherwise("development")).withColumn("component", c("id"))
    return scans.development(registry, "split", "component").select("id", "category")


@query("SELECT 'missing' AS fault, count(*) AS ids FROM cards WHERE fold = 0 AND id % 7 = 0 UNION ALL SELECT 'unknown', count(*) FROM cards WHERE fold = 1 AND id % 11 = 0")
def gov5_prediction_faults(t):
    """Predictions without labels, for each id of a fold and no other: what breaks the rule, by kind."""
    d = t("cards")
    said = d.where("(fold = 0 AND id % 7 != 0) OR (fold = 1 AND id % 11 = 0)").select("id", c("score").alias("probability"))
    return scans.prediction_faults(said, d.where("fold = 0").select("id"), "id", ["label", "target", "y"])
