"""What workers are handed and what they keep is bounded."""

import sys

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from shelfwise.llm import bpe, queries
from shelfwise.llm.batches import BATCH_LIMIT, SLICE_BYTES


def test_stages_hand_on_small_batches(spark):
    before = spark.conf.get(BATCH_LIMIT)
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "concat(repeat('word ', 1500), id) AS text", "'en' AS lang", "'s' AS source", "7500L AS n_chars")
    bench = "/root/testdata/sf0.001"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    try:
        for _, stage in corpus_pipeline.STAGES[2:]:
            spark.conf.set(BATCH_LIMIT, "64m")
            stage(spark, docs.limit(1), bench)
            got = docs.mapInArrow(sizes, "n bigint, size bigint").collect()
            assert sum(r.n for r in got) == 4000 and max(r.size for r in got) < 1.1 * SLICE_BYTES
        spark.conf.set(BATCH_LIMIT, "1m")  # less stays less
        corpus_pipeline.encode(spark, docs, bench)
        assert spark.conf.get(BATCH_LIMIT) == "1m"
    finally:
        spark.conf.set(BATCH_LIMIT, before)


def test_codec_keeps_bounded_bytes():
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as f:
        codec = bpe.Codec(f.read(), public_tokenizers.PATTERN)
    chunk = lambda i: " " + "ж" * 50 + str(i)
    for at in range(0, 240_000, 20_000):
        codec.merged = lambda pieces: dict.fromkeys(pieces, b"1234" * 20)  # only what is kept counts here
        codec.ids_of([chunk(i) for i in range(at, at + 20_000)])
    kept = sum(sys.getsizeof(k) + sys.getsizeof(v) for d in (codec.known, codec.older) for k, v in d.items())
    assert codec.known and kept < 52 << 20
