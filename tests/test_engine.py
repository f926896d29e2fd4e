import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise import plans  # noqa: F401  (registers its queries)
from shelfwise.functions import text as T
from shelfwise.operators import metrics, resolution, windows
from shelfwise.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels", "orders", "lineitem", "customer", "part", "events", "nation", "region", "conversations")


def rows(records):
    return sorted(tuple(str(v) for _, v in sorted(r.items())) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    assert rows(got) == rows(duck.execute(ORACLE_SQL[name]).to_arrow_table().to_pylist())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_forms(spark):
    assert one(spark, T.digit_masked(F.lit("10.5 мл"))) == "# мл"
    assert one(spark, T.normalized(F.lit("Ёлка <b>10&nbsp;мл</b>"))) == "елка 10 мл"
    assert one(spark, T.normalized(F.lit(None).cast("string"))) == ""
    assert one(spark, T.composed(F.lit("a"), F.lit(None))) == "a\na\n"
    assert one(spark, T.char_shingles(F.lit(""))) == []
    assert sorted(one(spark, T.char_shingles(F.lit("ab")))) == ["  a", " ab", "ab ", "b  "]
    assert one(spark, T.word_shingles(F.lit("a b c d e a b c d e"))) == ["a b c d e", "b c d e a", "c d e a b", "d e a b c", "e a b c d"]


def test_average_precision_with_ties(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "label int, score double")
    assert abs(metrics.average_precision(d, "score", "label").first().ap - 5 / 6) < 1e-12


def test_f1_without_positives(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 0), ("b", 0, 0)], "category string, label int, pred int")
    assert {r.category: round(r.f1, 6) for r in metrics.f1_by(d, ["category"], "label", "pred").collect()} == {"a": 0.666667, "b": 0.0}


def test_rank01_of_one_row_is_zero(spark):
    d = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 5.0)], "k string, v double")
    assert {(r.k, r.v): r.r for r in windows.ordinal(d, "v", "v", ["k"]).withColumn("r", windows.scaled_place(F.col("place_"), F.col("n_"))).collect()} == {("a", 2.0): 1.0, ("a", 1.0): 0.0, ("b", 5.0): 0.0}


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    parent = list(range(200))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    nodes = spark.range(200).select(F.col("id").alias("node"))
    got = resolution.components(nodes, spark.createDataFrame(edges, "left_id long, right_id long"))
    assert {r.node: r.component for r in got.collect()} == {x: root(x) for x in range(200)}


def test_degree_cap(spark):
    d = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), ("m", 1), ("m", 9), ("", 1), ("", 2)], "key string, id int")
    assert sorted(map(tuple, resolution.star_edges(d, "key", "id", 2).collect())) == [(1, 9)]
