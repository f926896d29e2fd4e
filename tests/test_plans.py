import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import geometry
from shelfwise.functions import unicode as U
from shelfwise.operators import comparison, evidence, fusion, resolution, splits, windows
from shelfwise.sources import scans, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_canonical_text(spark):
    texts = ["Ёлка&nbsp;10 мл", "ﬁne &amp; ½", None, "", "<b>A</b>&lt;b", "Straße\u2003\x1fİ\u00a0x", "&eacute;&#x41;＜b＞"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.a, r.b) for r in d.select("i", U.canonical(F.col("t")).alias("a"), U.case_folded(F.col("t")).alias("b")).collect()}
    def plain(text):
        text = unicodedata.normalize("NFKC", re.sub("<[^>]+>", " ", html.unescape(text or "")))
        return re.sub("[^0-9a-zа-я]+", " ", text.lower().replace("ё", "е")).strip()

    assert got == {i: (plain(t), " ".join(unicodedata.normalize("NFKC", t or "").casefold().split())) for i, t in enumerate(texts)}
    assert got[0][0] == "елка 10 мл" and got[2] == ("", "")


def test_polygons(spark):
    square = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in [(0, 0), (2, 0), (2, 2), (0, 2)]))
    bow = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in [(0, 0), (4, 3), (4, 0), (0, 2)]))
    assert one(spark, geometry.area(square)) == 4.0
    assert one(spark, geometry.valid_quad(square)) is True
    assert one(spark, geometry.valid_quad(bow)) is False
    assert one(spark, geometry.iou(geometry.box(square), geometry.box(square))) == 1.0


def test_strict_numbers_raise(spark):
    d = spark.createDataFrame([("01",)], "n string")
    with pytest.raises(Exception, match="isn't int"):
        scans.strict_numbers(d, {"n": "int"}).collect()
    with pytest.raises(Exception, match="isn't from"):
        scans.strict_numbers(spark.createDataFrame([("7",)], "n string"), {"n": "int"}, {"n": (0, 1)}).collect()


def test_csv_keeps_quotes_lines_and_marks(spark, tmp_path):
    texts = ['a "quoted", text', "two\nlines", "plain"]
    sinks.write_csv(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string"), str(tmp_path / "a"))
    assert [r.t for r in scans.csv(spark, str(tmp_path / "a"), "id int, t string").orderBy("id").collect()] == texts
    with pytest.raises(Exception):
        sinks.write_csv(spark.range(1), str(tmp_path / "a"))
    (tmp_path / "b.csv").write_bytes("\ufeffid,t\n1,x\n".encode())
    assert scans.csv_texts(spark, str(tmp_path / "b.csv")).columns == ["id", "t"]


def test_prior_maps_images_and_hashes(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"c\\tkey one": 1, "d\\tk": 0}')
    assert sorted(map(tuple, scans.prior_map(spark, str(tmp_path / "p.json")).collect())) == [("c", "key one", 1), ("d", "k", 0)]
    folder = tmp_path / "i"
    folder.mkdir()
    for name in ("a_0.jpg", "a_1.jpg", "b_1.jpg"):
        (folder / name).write_bytes(name.encode())
    assert [r.id for r in scans.position_gaps(scans.image_files(spark, str(folder))).collect()] == ["b"]
    text = sinks.self_hashed({"b": 1, "a": [2]})
    assert sinks.verified(text)["b"] == 1
    with pytest.raises(ValueError):
        sinks.verified(text.replace('"b":1', '"b":2'))


def test_submission_form(spark):
    long = "x" * 60
    shown = sinks.rendered(F.lit(long), F.lit(1))
    assert tuple(spark.range(1).select(*sinks.parsed(shown)).first()) == (long, "не бан", 1)
    with pytest.raises(Exception, match="not a submission"):
        one(spark, sinks.rendered(F.lit("short"), F.lit(1)))


def test_ordinal_and_shares(spark):
    rows = [("a", i, float(i // 3)) for i in range(10)] + [("b", 99, 1.0)]
    d = spark.createDataFrame(rows, "k string, id int, v double")
    got = {r.id: (r.place_, r.average_, r.n_) for r in windows.ordinal(d, "v", "id", ["k"]).collect()}
    assert got == {i: (i, 3 * (i // 3) + (2 if i < 9 else 1), 10) for i in range(10)} | {99: (0, 1, 1)}
    chosen = splits.exact_share(d, ["k"], F.sha2(F.col("id").cast("string"), 256), 30, "id").where("chosen").collect()
    assert len(chosen) == 3 and {r.k for r in chosen} == {"a"}


def test_hamming_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    values = [rng.getrandbits(20) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for v in values]
    d = spark.createDataFrame(list(enumerate(values)), "i long, h long")
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if (values[i] ^ values[j]).bit_count() <= 3}
    assert {(r.a, r.b) for r in resolution.hamming_pairs(d, "i", "h", 20, 3).collect()} == want


def test_simplex_and_evidence():
    assert list(fusion.simplex(2, 2)) == [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)]
    rules = [evidence.Rule("gas", "gas", 1, True, 1), evidence.Rule("empty", "without gas", 0, True, 2)]
    best = lambda t, v: evidence.best_evidence(t, v, rules)
    assert best("A lighter. It holds gas inside; yes", 1) == ("SAFE", "gas", "It holds gas inside", 11, 30)
    assert [best(t, v)[0] for t, v in [("", 1), (None, 0), ("some gas", 7), ("all the gas", 0), ("nothing here", 1), ("gas", 1)]] == [
        "EMPTY", "EMPTY", "UNKNOWN_VERDICT", "CONTRADICTED", "ABSENT", "UNSAFE",
    ]


def test_bootstrap_repeats_itself_and_sees_a_better_candidate(spark):
    d = spark.createDataFrame([(i % 40, "c", i % 2, 0, i % 2) for i in range(400)], "f int, c string, y int, base int, cand int")
    draw = lambda n: sorted(r.delta for r in comparison.multinomial_bootstrap(d.repartition(n), "f", "c", "y", "base", "cand", 20, "s").collect())
    assert draw(2) == draw(5) and min(draw(3)) > 0.9


def test_normal_quantiles(spark):
    from statistics import NormalDist

    shares = [0.5, 0.025, 0.9, 0.5, None]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(shares)], "i int, s double")
    got = {r.i: r.z for r in d.select("i", U.normal_quantile(F.col("s")).alias("z")).collect()}
    assert all(abs(got[i] - NormalDist().inv_cdf(s)) < 1e-12 for i, s in enumerate(shares) if s) and got[4] is None
