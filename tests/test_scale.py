"""Plans and memory that hold for large tables: what each test looks at is small."""

import hashlib
import math
import os
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from shelfwise import plans  # noqa: F401  (registers its queries)
from shelfwise.llm import neardup, tables
from shelfwise.operators import comparison, dense, family, lineage, resolution, retrieval
from shelfwise.queries import QUERIES

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_draws_are_dealt_and_never_broadcast(spark):
    drawn = comparison.draws(spark.createDataFrame([("a", 25_000)], "k string, n bigint"), ["k"], 4, F.lit("s"))
    assert drawn.agg(F.sum("w")).first()[0] == 100_000
    places = spark.range(25_000).select(F.lit("a").alias("k"), F.col("id").alias("place"))
    assert "Broadcast" not in planned(drawn.join(places, ["k", "place"]))
    assert "RepartitionByExpression" in drawn._jdf.queryExecution().optimizedPlan().toString()


def test_multinomial_bootstrap_meets_draws_by_merge(spark):
    d = spark.createDataFrame([(i % 40, "ab"[i % 2], i % 2, i % 3 % 2, i % 5 % 2) for i in range(400)], "family int, category string, label int, base int, cand int")
    plan = planned(comparison.multinomial_bootstrap(d, "family", "category", "label", "base", "cand", 3, "draw"))
    assert "SortMergeJoin [place" in plan and "BroadcastHashJoin [place" not in plan


def test_nearest_vectors_over_shards_with_ties(spark, monkeypatch):
    monkeypatch.setattr(dense, "SHARD_BYTES", 200)
    rng = np.random.default_rng(5)
    x = rng.integers(-1, 2, (90, 3)).astype(float)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(unit @ unit.T, 6) + 0.0
    for back in (False, True):
        want = {i: [(j, s[i, j]) for j in sorted((j for j in range(90) if j != i), key=lambda j: (-s[i, j], -j if back else j))[:4]] for i in range(0, 90, 7)}
        got = {}
        for r in sorted(dense.top_k(e.where("vec_id % 7 = 0"), e, "vec_id", "v", 4, back).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query"], []).append((r["donor"], r["cosine"]))
        assert got == want


def test_scores_of_nearest_vectors_stay_small():
    x = np.random.default_rng(6).normal(size=(20_000, 8))
    tracemalloc.start()
    at, donors, _ = dense.best_of(np.arange(256), x[:256], np.arange(20_000), x, 5, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 256 * 5 and peak < 48 << 20


def test_contained_pairs_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(resolution, "BLOCK_ROWS", 8)
    monkeypatch.setattr(resolution, "ITEMS_AT_ONCE", 5)
    sets = {i: sorted({f"x{i * k % 13}" for k in range(1, 1 + i % 6)}) for i in range(60)}
    d = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 58 else None, s) for i, s in sets.items()], "id long, k string, s array<string>")
    share = lambda a, b: round(len(set(sets[a]) & set(sets[b])) / min(len(sets[a]), len(sets[b])), 9) if sets[a] and sets[b] else 0.0
    want = sorted((a, b, share(a, b)) for a in range(58) for b in range(a + 1, 58) if (a < 50) == (b < 50))
    assert sorted(map(tuple, resolution.contained_pairs(d, "id", ["k"], "s").collect())) == sorted(want)


def test_bigrams_normalise_a_text_once(spark):
    plan = QUERIES["str20_word_bigrams"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]+>") == 1


def test_best_donors_in_parts_equal_plain_search(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(retrieval, "POSTINGS_AT_ONCE", 7)
    docs = {i: [f"w{i * k % 11}" for k in range(1, 2 + i % 7)] if i % 9 else [] for i in range(40)}
    asked = {q: sorted({f"w{q * k % 14}" for k in range(1, 5)}) for q in range(10)}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "node long, words string")
    a = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query long, term string")
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in w for w in docs.values()) for ts in asked.values() for t in ts}
    bm = lambda q, i: round(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * docs[i].count(t) * 2.5 / (docs[i].count(t) + 1.5 * (0.25 + 0.75 * len(docs[i]) / mean)) for t in asked[q] if t in docs[i]), 6)
    for of, own, f in ((None, True, lambda q, i: float(sum(t in docs[i] for t in asked[q]))), ((1.5, 0.75), False, bm)):
        want = []
        for q in asked:
            met = sorted((-f(q, i), i) for i in docs if set(asked[q]) & set(docs[i]) and (own or i != q))[:4]
            want += [(q, i, -s, place) for place, (s, i) in enumerate(met, 1)]
        assert sorted(map(tuple, retrieval.best_donors(d, a, 4, of).select("query", "donor", "score", "rank").collect())) == sorted(want)
    assert retrieval.best_donors(d, a.where("query < 0"), 4).count() == 0


def test_components_leave_one_table(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 7], "left_id long, right_id long")
    folder = lineage.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = resolution.components(spark.range(61).select(F.col("id").alias("node")), edges)
    assert found.where("component = 1").count() == 7 and len(set(os.listdir(folder)) - before) == 1


def test_keys_are_among_their_own_rows_for_any_number_of_marks(spark, monkeypatch):
    keys = spark.range(0, 300, 3).selectExpr("cast(id as string) as k")
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id > 0 THEN cast(id as string) END AS k")
    want = {i for i in range(3, 300, 3)}
    for marks, most in ((tables.MARKS, 110), (1, 6000)):
        monkeypatch.setattr(tables, "MARKS", marks)
        got = {r.id for r in tables.among(rows, keys, "k").collect()}
        assert want <= got and len(got) <= most
    assert tables.among(rows, keys.limit(0), "k").count() == 0


def test_texts_without_a_near_one_are_not_shuffled(spark):
    text = lambda i, n: " ".join(hashlib.sha256(f"{i} {j}".encode()).hexdigest() for j in range(n))
    docs = [(i, text(i, 200)) for i in range(300)] + [(300, text(7, 190)), (301, text(8, 200))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).localCheckpoint()
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = {r.doc_id: r.component_id for r in neardup.groups(d).collect()}
        took = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {i: {300: 7, 301: 8}.get(i, i) for i in range(302)}
    assert took < sum(len(t) for _, t in docs) / 4


def shuffled(spark) -> set[str]:
    """Names of the shuffle files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def family_of(spark):
    cards = [(n, f"t{n // 2}", f"n{n // 4}", f"m{n // 4}", f"words {n // 4} here", "x" if n % 5 else "") for n in range(60)]
    images = [(n, place, f"e{(n + place) // 3}", f"p{(n + place) // 3}") for n in range(60) for place in range(2)]
    return (
        spark.createDataFrame(cards, "id long, full_text string, name string, masked string, description string, identity string"),
        spark.createDataFrame(images, "id long, position int, exact string, perceptual string"),
    )


def gone(spark, before: set[str]) -> bool:
    """Whether no more shuffle files come to be than there were; Spark deletes them in the background."""
    for _ in range(50):
        if not shuffled(spark) - before:
            return True
        time.sleep(0.2)
    return False


def test_stage_audit_leaves_no_shuffles_and_few_tables(spark):
    cards, images = family_of(spark)
    folder = lineage.shared_folder(spark).removeprefix("file:")
    before, tables = shuffled(spark), set(os.listdir(folder))
    edges = family.all_edges(cards, images)
    audit = family.stage_audit(cards.select("id", F.col("name").alias("label"), F.col("masked").alias("category")), edges, "label", "category")
    assert gone(spark, before)
    assert len(set(os.listdir(folder)) - tables) == len(family.STAGES) + 1  # a row of each stage, and the edges
    held, group, want = edges.collect(), {n: {n} for n in range(60)}, []
    for stage in family.STAGES:
        for e in (e for e in held if e.stage == stage):
            merged = group[e.left_id] | group[e.right_id]
            group.update(dict.fromkeys(merged, merged))
        want.append((stage, len({id(g) for g in group.values()}), max(map(len, group.values()))))
    assert [(r.stage, r.components, r.largest) for r in audit.orderBy("place").collect()] == want
    assert want[0][1] == 40  # of 30 texts, 10 are torn by their first images
    assert spark.conf.get(lineage.CLEANED, None) in (None, "false")


def test_images_meet_their_cards_where_they_are_numbered(spark):
    """Lines are dealt out by their orders once, for their positions and for their cards."""
    from shelfwise.plans import families

    t = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").hint("merge")
    plan = family.marked(families.images_of(t), families.cards_of(t))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 2


def test_strong_images_make_up_for_unlike_descriptions(spark):
    cards = spark.createDataFrame([(n, f"t{n}", "n" if n < 4 else "o", "m", f"{n}" * 9, "" if n == 3 else "x") for n in range(6)], "id long, full_text string, name string, masked string, description string, identity string")
    images = spark.createDataFrame([(n, 1, "shared", None) for n in range(5)] + [(n, 2, "two", None) for n in (0, 1)], "id long, position int, exact string, perceptual string")
    found = {(r.left_id, r.right_id, r.degree, r.reason) for r in family.name_edges(cards, images, "name", "exact_name_corroborated").collect()}
    assert found == {(a, b, 4, "strong_image_pair") for a, b in ((0, 1), (0, 2), (1, 2))}


def test_common_keys_go_before_they_are_dealt_out(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "few").otherwise(F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 3 == 1, F.col("id") % 4).otherwise(F.col("id")).alias("id"))
    left = family.uncrowded(rows, 8)
    assert left.where("key = 'hot'").isEmpty() and left.count() == 2000


def test_safe_edges_leave_no_shuffles_and_one_table(spark):
    cards, images = family_of(spark)
    edges = family.all_edges(cards, images)
    folder = lineage.shared_folder(spark).removeprefix("file:")
    before, tables = shuffled(spark), set(os.listdir(folder))
    safe = family.safe_edges(edges, cards, images)
    assert gone(spark, before) and len(set(os.listdir(folder)) - tables) == 1
    assert sorted(tuple(r[:4]) for r in safe.collect()) == sorted((r.stage, r.left_id, r.right_id, r.key) for r in edges.collect())
