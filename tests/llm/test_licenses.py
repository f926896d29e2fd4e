import random
import re

import duckdb

from shelfwise.llm import licenses, queries

SF = "/root/testdata/sf0.001"


def brute(text):
    """All detections and those that stay, by plain loops over words."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for i, label, priority, keyword, pattern in licenses.rules():
        if keyword not in "| " + " ".join(words) + " ":
            continue
        starts = [k for k in range(len(words)) if re.match(f" (?:{pattern})(?= )", " " + " ".join(words[k:]) + " ")]
        for k, at in enumerate(starts):
            until = starts[k + 1] if k + 1 < len(starts) else len(words)
            m = re.match(f" (?:{pattern})(?= )", " " + " ".join(words[at:until]) + " ")
            length = m[0].count(" ") if m else until - at
            found.append((at, at + length, priority, i, label))

    def beats(e, d):
        inside = e[0] <= d[0] and d[1] <= e[1]
        longer, equal = e[1] - e[0] > d[1] - d[0], e[1] - e[0] == d[1] - d[0]
        return inside and (e[2] > d[2] or e[2] == d[2] and (longer or equal and e[3] < d[3]))

    stay = [d for d in found if d[2] == licenses.BASE_PRIORITY or not any(beats(e, d) for e in found if e != d)]
    base = [d for d in found if d[2] == licenses.BASE_PRIORITY]
    labels = lambda ds: ",".join(sorted({d[4] for d in ds}))
    starts = [d[0] for d in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(stay), max((d[2] for d in stay), default=0) / licenses.BASE_PRIORITY)


def check(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(d).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_scan_equals_brute_force(spark):
    rng = random.Random(6)
    parts = [re.sub(r"\(\?:([^|()]*)[^()]*\)\??|\[(.)[^\]]*\]\+?", r"\1\2", p) for _, _, _, _, p in licenses.rules()]
    parts += ["mit license", "the mit license", "under the mit license", "Apache License, Version 2.0", "CC BY-NC-SA 4.0", "gnu general public license v3", "x", "é", "license"]
    texts = [" ".join(rng.choice(parts) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    check(spark, [*texts, None, "", " .. ", "mit"])


def test_many_detections_equal_brute_force(spark):
    rng = random.Random(7)
    check(spark, [" ".join(rng.choice(["mit license", "the mit license", "under the mit license", "licensed under the apache license version 2 0", "cc by nc sa 4 0", "x"]) for _ in range(300))])


def test_documents_base_equals_sql(spark):
    """The base columns over a whole table, with plain expressions in another engine."""
    got = sorted((r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels) for r in queries.op2_licenses(spark, SF).collect())
    sql = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM '{SF}/documents.parquet'),
    p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w), phrases(phrase, label, n) AS (VALUES ('under the mit license', 'mit', 4), ('apache license version 2', 'apache-2', 4), ('cc by nc', 'cc-by-nc', 3)),
    f AS (SELECT doc_id, i, label FROM p, phrases WHERE array_to_string(w[i + 1:i + n], ' ') = phrase)
    SELECT w.doc_id, count(f.i), min(f.i), max(f.i), coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') FROM w LEFT JOIN f USING (doc_id) GROUP BY w.doc_id"""
    assert got == sorted(duckdb.connect().execute(sql).fetchall())
