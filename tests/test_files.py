import pytest
from pyspark.sql import functions as F

from shelfwise.sources import scans


def test_order_and_seals_are_checked(spark):
    good = spark.createDataFrame([(0, "a"), (1, "b")], "position long, v string")
    assert scans.in_order(good, "position").count() == 2
    for bad in ([(0, "a"), (2, "b")], [(0, "a"), (0, "b"), (1, "c")], [(1, "a")]):
        with pytest.raises(Exception, match="out of order"):
            scans.in_order(spark.createDataFrame(bad, "position long, v string"), "position").collect()
    torn = spark.createDataFrame([("k", "sealed"), ("k", "development")], "component string, split string")
    with pytest.raises(Exception, match="sealed in part"):
        scans.development(torn, "split", "component").collect()


def test_predictions_hold_no_labels(spark):
    d = spark.createDataFrame([(1, 0)], "id long, label int")
    with pytest.raises(ValueError, match="label"):
        scans.prediction_faults(d, d.select("id"), "id", ["label"])


def test_id_lists(spark):
    rows = [(0, '["a", "b"]'), (1, ' [ {"id": "a"} ]'), (2, '{"ids": ["a"]}'), (3, "7"), (4, None), (5, "[]")]
    got = {r.i: r.ids for r in spark.createDataFrame(rows, "i int, t string").select("i", scans.id_list(F.col("t")).alias("ids")).collect()}
    assert got == {0: ["a", "b"], 1: ["a"], 2: ["a"], 3: None, 4: None, 5: []}
