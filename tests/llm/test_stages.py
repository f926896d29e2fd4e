"""Stages hand on every column, whatever its name, and stand nulls, empty tables and repeated rows."""

import pytest

import corpus_pipeline
from shelfwise.llm import decontaminate, neardup, quality, secrets

CLASHING = ("kept", "score", "statistics", "items", "n_words", "contaminated", "ranges", "spans", "found", "row", "row_", "owner", "owner_", "copy", "live", "hash", "id", "id_", "key", "key_", "node", "first", "salt_", "bucket", "a.b")
ROWS = [(1, "w " * 40 + "token = 'q8Zr41LmPx77tt'", "en", "s"), (1, "w " * 40 + "token = 'q8Zr41LmPx77tt'", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "one two three four five six", "en", "s")]
ENSEMBLE = quality.Ensemble([(((1, 3.0, True),), 2.0)], 0.0)


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return d.selectExpr("*", *(f"map('{c}', doc_id) AS `{c}`" for c in CLASHING))


def stages(spark):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string")
    return {
        "quality": lambda d: quality.keep_accepted(d, ENSEMBLE),
        "near": neardup.keep_first,
        "benchmark": lambda d: decontaminate.drop_contaminated(d, bench),
        "secrets": secrets.redact,
    }


@pytest.mark.parametrize("name, kept", [("quality", 5), ("near", 4), ("benchmark", 4), ("secrets", 5)])
def test_columns_of_any_name_pass(spark, docs, name, kept):
    stage = stages(spark)[name]
    got = stage(docs)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    rows = got.collect()
    assert len(rows) == kept
    assert all(r[c] == {c: r.doc_id} for r in rows for c in CLASHING)
    assert stage(docs.limit(0)).count() == 0


def test_masked_text(spark, docs):
    texts = [r.text for r in secrets.redact(docs).collect()]
    assert sorted(t or "" for t in texts) == ["", "", "one two three four five six", *["w " * 40 + secrets.MASK + "'"] * 2]


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_filter_reads_statistics_once(spark, docs):
    """The optimiser must not put the statistics into the filter once for each condition."""
    many = quality.Ensemble([(((k, float(j), True),), 0.1) for k in range(11) for j in range(4)], 0.0)
    plan = quality.keep_accepted(docs, many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") <= 7


def test_automata_beyond_one_block(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "Lead, " + " - ".join(f"W{i}x{k}" for k in range(20)) + "; " + " ".join(f"w{8 - i}x{k}" for k in range(14)), "keep") for i in range(4)], "doc_id long, text string, kept string")
    one = sorted(map(tuple, decontaminate.digests(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 2000)
    assert len(list(decontaminate.pattern_blocks(bench))) > 3
    assert sorted(map(tuple, decontaminate.digests(docs, bench).collect())) == one
    found = decontaminate.find(docs.selectExpr("struct(doc_id) AS kept", "text"), bench).collect()
    for r in found:
        i = r.kept.doc_id
        text = docs.where(f"doc_id = {i}").first().text
        assert [text[a:b].split()[0] for a, b in r.spans] == [f"W{i}x0"] and r.ranges == [[1, 35]]
