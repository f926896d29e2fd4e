"""Tables written and read again in each format, checked against what went in; streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators.lineage import shared_folder
from shelfwise.queries import query
from shelfwise.sources import scans, sinks
from shelfwise.streaming import cards as streams

c = F.col


def place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"


@query("SELECT id, category, label, fold, score, family FROM cards", "cards")
def src1_csv(d):
    path = place(d.sparkSession)
    sinks.write_csv(d, path, gzip=True)
    return scans.csv(d.sparkSession, path, "id bigint, category string, label int, fold int, score double, family bigint")


@query("SELECT id, label FROM cards", "cards")
def src4_strict_csv(d):
    path = place(d.sparkSession)
    sinks.write_csv(d.select("id", "label"), path)
    return scans.strict_numbers(scans.csv_texts(d.sparkSession, path), {"id": "bigint", "label": "int"}, {"label": (0, 1)})


@query("SELECT doc_id, text FROM documents", "documents")
def src6_jsonl(d):
    path = place(d.sparkSession)
    sinks.write_jsonl(d.select("doc_id", "text"), path)
    return scans.jsonl(d.sparkSession, path, "doc_id bigint, text string")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS position, 'part/' || l_partkey AS url FROM lineitem")
def src8_gallery(t):
    lines = t("lineitem").select(c("l_orderkey").cast("string").alias("id"), "l_linenumber", "l_partkey")
    each = sinks.nested(lines, "id", ["l_linenumber", "l_partkey"], "items")
    path = place(lines.sparkSession)
    sinks.write_csv(each.select("id", F.to_json(F.transform("items", lambda x: F.concat(F.lit("part/"), x["l_partkey"].cast("string")))).alias("image_urls")), path, gzip=True, sep="\t")
    return scans.gallery(lines.sparkSession, path)


@query("SELECT id, label, fold FROM cards", "cards")
def src19_fold_files(d):
    path = place(d.sparkSession)
    sinks.write_csv(d.select("id", "label", "fold"), path, by=["fold"])
    return scans.fold_files(d.sparkSession, path, "id bigint, label int, fold int", 5)


@query("SELECT conv_id, list(role ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def snk4_nested_jsonl(t):
    d = sinks.nested(t("conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], "turns")
    path = place(d.sparkSession)
    sinks.write_jsonl(d, path, gzip=True)
    back = scans.jsonl(d.sparkSession, path, "conv_id bigint, turns array<struct<turn:bigint,role:string>>")
    return back.select("conv_id", F.transform("turns", lambda x: x["role"]).alias("roles"), F.size("turns").cast("bigint").alias("turns"))


@query("SELECT id % 4 AS shard, count(*) AS rows, 0 AS faults FROM cards GROUP BY ALL", "cards")
def src21_shards(d):
    owned = d.withColumn("shard", F.pmod("id", F.lit(4)))
    faults = scans.shard_faults(owned, "id", "shard", 4).groupBy(F.pmod("index", F.lit(4)).alias("shard")).agg(F.count("*").cast("int").alias("faults"))
    rows = owned.groupBy("shard").agg(F.count("*").alias("rows"))
    return rows.join(faults, "shard", "left").select("shard", "rows", F.coalesce("faults", F.lit(0)).alias("faults"))


@query("")
def snk12_manifest(t):
    """Rows and digest of a table, whatever the order of its rows."""
    return sinks.table_digest(t("orders"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream over a finite folder gives out, written once and read again."""
    spark = stream.sparkSession
    path = place(spark)
    run = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", path + "-state").option("path", path).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def followed(table: DataFrame, name: str) -> DataFrame:
    """The table's files as a stream."""
    folder, _, _ = table.inputFiles()[0].rpartition("/")
    return table.sparkSession.readStream.schema(table.schema).option("pathGlobFilter", f"{name}.parquet*").option("recursiveFileLookup", True).parquet(folder)


@query("")
def stream1_first_seen(t):
    """The first event of each user, kind and value within an hour of event time."""
    key = T.stable_rank(c("user_id").cast("string"), c("event_type"), c("value").cast("string"))
    events = followed(t("events"), "events").withColumn("ts", c("ts").cast("timestamp"))
    return drained(streams.first_seen(events, key, "ts", "1 hour"))


@query("SELECT event_id, prior, support FROM events LEFT JOIN (SELECT family, round(avg(label), 6) AS prior, count(*) AS support FROM cards GROUP BY family) ON family = user_id")
def stream2_priors(t):
    priors = t("cards").groupBy(c("family").alias("user_id")).agg(F.round(F.avg("label"), 6).alias("prior"), F.count("*").alias("support"))
    return drained(streams.with_priors(followed(t("events"), "events"), priors, "user_id")).select("event_id", "prior", "support")


@query("")
def stream3_windowed(t):
    """Counts of each kind of event in ten minutes; windows that the watermark hasn't passed at the end aren't given out."""
    events = followed(t("events"), "events").withColumn("ts", c("ts").cast("timestamp"))
    return drained(streams.windowed(events, "ts", "10 minutes", "1 hour", ["event_type"], "value"))
