"""Lineage cut where it must survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where checkpoints go: what the cluster names, and only where it names none, as in tests, a local folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: computed once, where checkpoint() computes them twice.

    The table stays until drop_tables() or the folder goes, as files of checkpoints do where their cleaning is off.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path_ = path
    return out


#: Spark's setting by which what a command shuffled is deleted when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Commands run in here delete their shuffle files when they end, which else stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def settled(df: DataFrame) -> DataFrame:
    """As cut_lineage(), for steps whose disk counts: the table is packed more densely and what it took to shuffle goes with the step."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path_ = path
    return out


def is_table(df: DataFrame) -> bool:
    return "table_path_" in vars(df)


def drop_tables(*frames: DataFrame) -> None:
    """Deletes the tables of frames that cut_lineage() or settled() gave and nothing will read again; other frames are left alone."""
    for df in frames:
        if path := vars(df).get("table_path_"):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
