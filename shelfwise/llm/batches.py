"""Row functions over Arrow batches, kept small whatever the length of the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of Arrow data turned into Python objects at a time.
SLICE_BYTES = 4 << 20
#: Spark's own limit of a batch's bytes, 64 MB unless it is set.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `limit` bytes each, one row at least."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands workers Arrow batches of about SLICE_BYTES, or of less where less is set; the rows stay the same.

    A task holds a batch several times: as vectors that double as they grow, in the buffer to its worker, and in the worker.
    """
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > SLICE_BYTES:
        spark.conf.set(BATCH_LIMIT, SLICE_BYTES)


def map_slices(df: DataFrame, schema: str, make: Callable[[], Callable[..., list[tuple]]], limit: int = SLICE_BYTES) -> DataFrame:
    """Any number of output rows for a slice: make() gives, once a task, the function of a slice's columns as lists."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = make()
        for batch in batches:
            for part in slices(batch, limit):
                if rows := rows_of(*(c.to_pylist() for c in part.columns)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow
                    )

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., tuple]], limit: int = SLICE_BYTES) -> DataFrame:
    """One output row for each input row: make() gives, once a task, the function of a row's values."""

    def make_rows():
        row = make()
        return lambda *columns: [row(*values) for values in zip(*columns, strict=True)]

    return map_slices(df, schema, make_rows, limit)


def packed(df: DataFrame, **values: str | Column) -> DataFrame:
    """kept, a struct of all columns, beside the values: no name of the rows can clash with a name used inside."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("kept"), *((F.col(f"`{v}`") if isinstance(v, str) else v).alias(k) for k, v in values.items()))


def map_arrays(df: DataFrame, passed: list[str], read: list[str], schema: str, make: Callable[[], Callable[..., list[pa.Array]]], limit: int = SLICE_BYTES) -> DataFrame:
    """The columns `passed` as they are, beside new ones: make() gives, once a task, the function of a slice's columns `read`, arrays to arrays.

    What is passed stays Arrow data, so types and long texts are never turned into Python objects.
    """
    wanted = StructType([df.schema[c] for c in passed] + StructType.fromDDL(schema).fields)
    new = to_arrow_schema(StructType.fromDDL(schema))
    places, inputs = ([df.columns.index(c) for c in names] for names in (passed, read))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = make()
        for batch in batches:
            for part in slices(batch, limit):
                made = [a.cast(f.type) for a, f in zip(arrays(*(part.column(i) for i in inputs)), new, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *made], names=wanted.names)

    return df.mapInArrow(run, wanted)


def map_beside(df: DataFrame, passed: list[str], read: list[str], schema: str, make: Callable[[], Callable[..., tuple]], limit: int = SLICE_BYTES) -> DataFrame:
    """The columns `passed` as they are, beside new ones: make() gives, once a task, the function of the values of the columns `read`."""
    new = to_arrow_schema(StructType.fromDDL(schema))

    def make_arrays():
        row = make()

        def arrays(*columns):
            rows = [row(*values) for values in zip(*(c.to_pylist() for c in columns), strict=True)]
            return [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), new, strict=True)]

        return arrays

    return map_arrays(df, passed, read, schema, make_arrays, limit)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))
