"""The family graph's replay and the search for even folds, held against plain loops."""

import itertools
import random

from pyspark.sql import functions as F

from shelfwise.operators import family, folds


def cards(spark, rows):
    return spark.createDataFrame(rows, "id string, full_text string, name string, masked string, description string, identity string")


def images(spark, rows):
    return spark.createDataFrame(rows, "id string, position int, exact string, perceptual string")


def test_replay_equals_all_pairs():
    rng = random.Random(2)
    for _ in range(30):
        ids = [f"i{k:02}" for k in range(12)]
        anchors = {i: (rng.choice(["", "a", "b"]), frozenset(rng.sample(["e1", "e2", "p1", "p2"], rng.randint(0, 2)))) for i in ids}
        edges = [tuple(sorted(rng.sample(ids, 2))) for _ in range(15)]
        anchored = lambda a, b: bool(anchors[a][0] and anchors[a][0] == anchors[b][0] or anchors[a][1] & anchors[b][1])
        groups = [{i} for i in ids]
        for (left, right), (accepted, a, b) in zip(edges, family.replayed(edges, anchors)):
            one, two = (next(g for g in groups if x in g) for x in (left, right))
            fits = one is two or all(anchored(x, y) for x, y in itertools.product(one, two))
            assert accepted == fits
            if fits and one is not two:
                groups.remove(two)
                one |= two
            if not fits:
                assert a in one and b in two and not anchored(a, b)


def test_stages_and_vetoes(spark):
    text = [("a", "t", "n", "m", "same words here", "x"), ("b", "t", "n", "m", "same words here", "x"), ("c", "u", "n", "m", "quite another", "x"), ("d", "v", "n2", "m2", "other", ""), ("e", "v", "n3", "m3", "other", "")]
    pics = [("a", 0, "e1", "p1"), ("b", 0, "e1", "p1"), ("c", 0, "e9", "p9"), ("d", 0, "e2", "p2"), ("e", 0, "e3", "p2"), ("e", 1, None, None)]
    k, i = cards(spark, text), images(spark, pics)
    assert [(r.full_text, r.status) for r in family.text_groups(k, i).orderBy("full_text").collect()] == [("t", "accepted_direct"), ("v", "quarantined_nonindependent_text")]
    found = {(r.stage, r.left_id, r.right_id, r.reason) for r in family.all_edges(k, i).collect()}
    assert found == {
        ("exact_full_text", "a", "b", "direct_exact_full_text"), ("exact_name_corroborated", "a", "b", "description_similarity"),
        ("masked_name_corroborated", "a", "b", "description_similarity"), ("exact_first_image", "a", "b", "both_informative_first_images"),
        ("perceptual_corroborated", "d", "e", "two_hashes_per_match_and_both_first_positions"),
    }
    safe = family.safe_edges(family.all_edges(k, i), k, i).collect()
    assert len(safe) == 5 and all(r.accepted for r in safe)
    torn = cards(spark, [*text[:2], ("z", "t", "n", "m", "x", "x")])
    assert family.text_groups(torn, images(spark, [*pics[:2], ("z", 0, "e7", "p7")])).first().status == "quarantined_first_image_conflict"


def test_replay_vetoes_a_chain(spark):
    """Each edge by itself is sound; together they would join two cards without an anchor."""
    k = cards(spark, [(i, "", "", "", "", "") for i in "abc"])
    i = images(spark, [("a", 0, "e1", "p1"), ("b", 0, "e1", "p2"), ("c", 0, "e3", "p2")])
    edges = spark.createDataFrame([("exact_first_image", "a", "b", "e1"), ("perceptual_corroborated", "b", "c", "p2")], "stage string, left_id string, right_id string, key string")
    got = {(r.left_id, r.right_id): (r.accepted, r.witness_left, r.witness_right) for r in family.safe_edges(edges, k, i).collect()}
    assert got == {("a", "b"): (True, None, None), ("b", "c"): (False, "a", "c")}


def test_degree_cap_drops_a_name(spark):
    many = [(f"i{n:03}", f"t{n}", "n", "m", "d", "x") for n in range(70)]
    none = images(spark, [("zz", 0, "e", "p")])
    assert family.name_edges(cards(spark, many), none, "name", "exact_name_corroborated").count() == 0
    assert family.name_edges(cards(spark, many[:64]), none, "name", "exact_name_corroborated").count() == 64 * 63 // 2


def test_balanced_folds_beat_single_trials(spark):
    rng = random.Random(8)
    rows = [(f"c{rng.randrange(60)}", f"{rng.choice('ab')}|{int(rng.random() < 0.3)}") for _ in range(600)]
    d = spark.createDataFrame(rows, "component string, stratum string")
    strata = ["a|0", "a|1", "b|0", "b|1"]

    def worst(trials):
        placed = {r.component: r.fold for r in folds.balanced_folds(d, "component", strata, F.col("stratum"), 4, 3, trials).collect()}
        assert set(placed) == {k for k, _ in rows} and set(placed.values()) == set(range(4))
        counts = [sum(1 for k, s in rows if placed[k] == f and s == "b|1") for f in range(4)]
        return max(abs(x - sum(counts) / 4) for x in counts), placed

    one, few = worst(1), worst(12)
    assert few[0] <= one[0] <= 3
    assert worst(12)[1] == few[1]


def test_frozen_folds_must_be_whole(spark):
    import pytest

    rows = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(Exception, match="no single frozen fold"):
        folds.imported_folds(rows, spark.createDataFrame([(1, 0)], "id long, fold int"), "id").collect()
    with pytest.raises(Exception, match="no single frozen fold"):
        folds.imported_folds(rows, spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "id long, fold int"), "id").collect()
