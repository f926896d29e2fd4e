"""Readers with explicit schemas. What a file must hold is checked as it is read, and what breaks the rule raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str | list[str], schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header, of any compression; a row that doesn't fit the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True, multiLine=True, quote='"', escape='"', sep=sep)


def csv_texts(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose columns all stay strings; a byte order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return df.toDF(*(n.lstrip("\ufeff") for n in df.columns))


#: Canonical spellings: no sign but a minus, no leading zeros, no exponent.
NUMBERS = {"int": r"^(0|-?[1-9][0-9]*)$", "bigint": r"^(0|-?[1-9][0-9]*)$", "double": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"}


def checked(value: Column, ok: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(message + ": "), F.coalesce(value.cast("string"), F.lit("null")))))


def strict_numbers(df: DataFrame, kinds: dict[str, str], ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """String columns as numbers; a spelling that isn't canonical, or a value out of its range, raises."""
    out = df
    for name, kind in kinds.items():
        number = checked(F.col(name), F.col(name).rlike(NUMBERS[kind]), f"{name} isn't {kind}").cast(kind)
        if name in (ranges or {}):
            low, high = ranges[name]
            number = checked(number, number.between(low, high), f"{name} isn't from {low} to {high}").cast(kind)
        out = out.withColumn(name, number)
    return out


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, bad ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects, with file and the text of each line that isn't one in `bad`, where a report is wanted before raising."""
    whole = StructType.fromDDL(schema + ", bad string")
    return spark.read.schema(whole).option("columnNameOfCorruptRecord", "bad").json(path).withColumn("file", F.input_file_name())


def gallery(spark: SparkSession, path: str) -> DataFrame:
    """id, position and url from a tab-separated file whose image_urls are JSON arrays."""
    listed = csv(spark, path, "id string, image_urls string", sep="\t").withColumn("urls", F.from_json("image_urls", "array<string>"))
    return listed.select("id", F.posexplode("urls").alias("position", "url"))


def prior_map(spark: SparkSession, path: str) -> DataFrame:
    """category, key and label from files of one JSON object each, whose names are 'category TAB key'."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, int>")).alias("name", "label"))
    return pairs.select(F.split_part("name", F.lit("\t"), F.lit(1)).alias("category"), F.split_part("name", F.lit("\t"), F.lit(2)).alias("key"), "label")


def fold_files(spark: SparkSession, path: str, schema: str, folds: int) -> DataFrame:
    """CSVs in folders fold=0, fold=1 and so on; a fold that is missing or not expected raises."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)
    return df.withColumn("fold", checked(F.col("fold"), F.col("fold").between(0, folds - 1), "no such fold"))


def shard_faults(rows: DataFrame, index: str, shard: str, shards: int) -> DataFrame:
    """Rows in a shard that isn't index modulo shards, and indices held more than once, each with its fault."""
    wrong = rows.where(F.pmod(F.col(index), F.lit(shards)) != F.col(shard)).select(F.col(index).alias("index"), F.lit("owner").alias("fault"))
    twice = rows.groupBy(F.col(index).alias("index")).count().where("count > 1").select("index", F.lit("repeated").alias("fault"))
    return wrong.unionByName(twice)


def image_files(spark: SparkSession, path: str, pattern: str = r"([^/]+)_([0-9]+)\.[a-z]+$") -> DataFrame:
    """id, position, path, length and sha256 of files named id_position."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(
        F.regexp_extract("path", pattern, 1).alias("id"), F.regexp_extract("path", pattern, 2).try_cast("int").alias("position"), "path", "length", F.sha2("content", 256).alias("sha256")
    )


def position_gaps(images: DataFrame, most: int = 5) -> DataFrame:
    """Ids whose positions aren't 0 to n - 1, or that have more than `most`."""
    held = images.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("low"), F.max("position").alias("high"))
    return held.where((F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("d") != F.col("n")) | (F.col("n") > most)).select("id", "n")


def in_order(df: DataFrame, position: str) -> DataFrame:
    """The rows, whose positions must be all numbers from 0 on, once each: each row checks counts that were made of all."""
    whole = df.agg(F.count("*").alias("n_"), F.min(position).alias("least_"), F.max(position).alias("most_"))
    twice = df.groupBy(position).agg(F.count("*").alias("times_"))
    ok = (F.col("times_") == 1) & (F.col("least_") == 0) & (F.col("most_") == F.col("n_") - 1)
    met = df.join(twice, position).crossJoin(F.broadcast(whole))
    return met.select(*(checked(F.col(c), ok, "lines out of order").alias(c) if c == position else F.col(c) for c in df.columns))


def id_list(text: Column) -> Column:
    """Ids of a JSON list of ids, of a list of records with an id, or of a record with the list; else null."""
    plain, records, whole = (F.from_json(text, t) for t in ("array<string>", "array<struct<id:string>>", "struct<ids:array<string>>"))
    of_records = F.transform(records, lambda r: r["id"])
    first = F.substring(F.regexp_replace(text, r"\s+", ""), 1, 2)
    return F.when(first == "[{", of_records).when(F.left(first, F.lit(1)) == "[", plain).when(F.left(first, F.lit(1)) == "{", whole["ids"])


def development(registry: DataFrame, split: str, component: str) -> DataFrame:
    """Rows that aren't sealed. A component with rows on both sides is an error when one of its rows is read."""
    torn = registry.groupBy(component).agg((F.min(split) != F.max(split)).alias("torn_"))
    rows = registry.where(F.col(split) == "development").join(torn, component)
    return rows.withColumn(split, checked(F.col(split), ~F.col("torn_"), "a component is sealed in part")).drop("torn_")


def prediction_faults(predictions: DataFrame, expected: DataFrame, key: str, forbidden: list[str]) -> DataFrame:
    """fault and ids: expected ids that are missing, ids that are unknown. A column that tells the label raises at once."""
    if told := sorted(set(predictions.columns) & set(forbidden)):
        raise ValueError(f"predictions hold {', '.join(told)}")
    a, b = expected.select(key).distinct(), predictions.select(key).distinct()
    sides = {"missing": a.join(b, key, "left_anti"), "unknown": b.join(a, key, "left_anti")}
    missing, unknown = (d.agg(F.count("*").alias("ids")).select(F.lit(n).alias("fault"), "ids") for n, d in sides.items())
    return missing.unionByName(unknown)
