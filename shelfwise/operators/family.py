"""The staged family graph: edges by text and image keys, each with its guards, and what of them closes safely.

cards: id, full_text, name, masked, description, identity; an empty string is unknown. images: id, position, exact,
perceptual; null keys are uninformative. A stage gives edges (stage, left_id, right_id, key, degree, reason,
similarity) with left_id before right_id. Keys over their stage's degree cap give none, and degrees count every
occurrence of a key, informative or not; so what a key's pairs cost is bounded by the cap, whatever the key's rows.

Each stage is a function of cards and images; all_edges() gives them all from tables that they share (marks, cards with
their first keys, pairs with an equal image), one step after another, so that a step's shuffles are all that the disk holds beside these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfwise.functions import text as T
from shelfwise.operators.lineage import drop_tables, is_table, settled
from shelfwise.operators.resolution import components

#: The stages in the order in which their edges are replayed, the caps, and the least likeness of descriptions.
STAGES = ("exact_full_text", "exact_name_corroborated", "masked_name_corroborated", "exact_first_image", "exact_auxiliary_images", "perceptual_corroborated")
CAPS = {"exact_name_corroborated": 64, "masked_name_corroborated": 32, "exact_first_image": 32, "exact_auxiliary_images": 64, "perceptual_corroborated": 16}
LIKENESS = 0.88

c = F.col
EDGE = ("stage", "left_id", "right_id", "key", "degree", "reason", "similarity")


def occurrences(images: DataFrame, key: str) -> DataFrame:
    """key, id and positions: where each image key occurs."""
    held = images.where(c(key).isNotNull() & (c(key) != "")).select(c(key).alias("key"), "id", "position")
    return held.groupBy("key", "id").agg(F.sort_array(F.collect_set("position")).alias("positions"))


def reused_keys(held: DataFrame, cards: DataFrame) -> DataFrame:
    """Keys that cards of more than one known identity hold."""
    known = held.join(cards.where("identity != ''").select("id", "identity"), "id")
    return known.groupBy("key").agg(F.min("identity").alias("least"), F.max("identity").alias("most")).where("least != most").select("key")


def marked(images: DataFrame, cards: DataFrame) -> DataFrame:
    """id, first, exact and perceptual of each image, with its card's identity where it is known; standing: 2 if so, else 1, or 0 without a card."""
    known = cards.select("id", F.when(c("identity") != "", c("identity")).alias("identity"), F.lit(True).alias("carded"))
    some = images.where("exact IS NOT NULL OR perceptual IS NOT NULL").select("id", (c("position") == 0).alias("first"), "exact", "perceptual")
    standing = F.when(c("identity").isNotNull(), 2).when(c("carded"), 1).otherwise(0).cast("tinyint")
    return some.join(known, "id", "left").select("id", "first", "exact", "perceptual", "identity", standing.alias("standing"))


#: Keys that are looked at, and those that a sketch of all keys keeps, for what may be too many rows of one key for a task.
CROWDED, TRACKED = 1000, 10_000


def uncrowded(rows: DataFrame, cap: int) -> DataFrame:
    """Rows without the commonest keys, those of them that more than `cap` ids hold; rows: key, id and others.

    A sketch only names candidates, which are then counted; keys over the cap that it misses have few rows, and go later.
    """
    likely = rows.select(F.expr(f"approx_top_k(key, {CROWDED}, {TRACKED}) AS top")).select(F.inline("top").alias("key", "seen")).where(c("seen") > cap).select("key")
    over = rows.join(F.broadcast(likely), "key").select("key", "id").distinct().groupBy("key").agg(F.count("*").alias("ids")).where(c("ids") > cap).select("key")
    return rows.join(F.broadcast(over), "key", "left_anti")


def eligible(marks: DataFrame, key: str, cap: int) -> DataFrame:
    """key, id, first, standing and degree of keys that one identity holds, at least two cards and at most `cap`.

    Rows are dealt out by their keys once and judged where they lie.
    """
    held = marks.where(c(key).isNotNull() & (c(key) != "")).select(c(key).alias("key"), "id", "first", "identity", "standing")
    each = uncrowded(held, cap).repartition("key").groupBy("key", "id").agg(F.max("first").alias("first"), F.max("standing").alias("standing"), F.min("identity").alias("least"), F.max("identity").alias("most"))
    group = Window.partitionBy("key")
    each = each.select("key", "id", "first", "standing", F.count("*").over(group).alias("degree"), F.min("least").over(group).alias("least"), F.max("most").over(group).alias("most"))
    return each.where(c("degree").between(2, cap) & F.coalesce(c("least") == c("most"), F.lit(True))).select("key", "id", "first", "standing", "degree")


def first_keys(images: DataFrame) -> DataFrame:
    """id, first_exact and first_perceptual: the keys of each card's first image."""
    return images.where("position = 0").groupBy("id").agg(F.collect_set("exact").alias("first_exact"), F.collect_set("perceptual").alias("first_perceptual"))


def conflict(left: str, right: str) -> Column:
    """Whether both first images are informative and share neither key; left and right are structs with first_exact and first_perceptual."""
    keys = lambda side, k: F.coalesce(c(f"{side}.{k}"), F.array().cast("array<string>"))
    le, re, lp, rp = keys(left, "first_exact"), keys(right, "first_exact"), keys(left, "first_perceptual"), keys(right, "first_perceptual")
    return (F.size(lp) > 0) & (F.size(rp) > 0) & ~F.arrays_overlap(le, re) & ~F.arrays_overlap(lp, rp)


def with_firsts(cards: DataFrame, images: DataFrame) -> DataFrame:
    return cards.join(first_keys(images), "id", "left")


def text_groups(cards: DataFrame, images: DataFrame) -> DataFrame:
    return judged_texts(with_firsts(cards, images))


def judged_texts(cards: DataFrame) -> DataFrame:
    """full_text, first_id, degree and status of each text that several cards share; cards have their first keys.

    First images of one text agree when all share a key of one kind, so the group is judged from aggregates and never
    by its pairs: one text may be a third of all cards.
    """
    d = cards.where("full_text != ''")
    informative = F.size(F.coalesce("first_perceptual", F.array().cast("array<string>"))) > 0
    one = lambda k: F.when(informative, F.coalesce(F.array_min(k), F.concat(F.lit("none "), c("id").cast("string"))))
    groups = d.groupBy("full_text").agg(
        F.count("*").alias("degree"), F.min("id").alias("first_id"), F.max((c("identity") != "").cast("int")).alias("known"),
        *(f(one(f"first_{k}")).alias(f"{n}_{k}") for k in ("exact", "perceptual") for n, f in (("least", F.min), ("most", F.max))),
    ).where("degree > 1")
    torn = (c("least_exact") != c("most_exact")) & (c("least_perceptual") != c("most_perceptual"))
    status = F.when(torn, "quarantined_first_image_conflict").when(c("known") == 0, "quarantined_nonindependent_text").otherwise("accepted_direct")
    return groups.select("full_text", "first_id", "degree", F.coalesce(status, F.lit("accepted_direct")).alias("status"))


def text_edges(cards: DataFrame, images: DataFrame) -> DataFrame:
    return text_stars(cards, text_groups(cards, images))


def text_stars(cards: DataFrame, groups: DataFrame) -> DataFrame:
    """Exact text: a star from the first card of each text that is accepted."""
    star = cards.select("id", "full_text").join(groups.where("status = 'accepted_direct'"), "full_text").where("id != first_id")
    return star.select(
        F.lit("exact_full_text").alias("stage"), c("first_id").alias("left_id"), c("id").alias("right_id"), c("full_text").alias("key"), "degree",
        F.lit("direct_exact_full_text").alias("reason"), F.lit(1.0).alias("similarity"),
    )


def pairs_within(rows: DataFrame, key: str, **more: Callable[[Column], Column]) -> DataFrame:
    """key and pairs of structs (l, r) with l.id before r.id, of rows that share a key; the caller has capped what a key holds.

    A key's rows are gathered and paired where they lie; `more` are fields that are made of a gathered row, so that no sort carries them.
    """
    fields = ["id", *(x for x in rows.columns if x != "id")]
    one = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("all"))
    if more:
        one = one.select(F.transform("all", lambda x: F.struct(*(x[f].alias(f) for f in fields), *(make(x).alias(n) for n, make in more.items()))).alias("all"))
    pairs = one.select(F.posexplode("all").alias("at", "l"), "all").select("l", F.explode(F.slice("all", c("at") + 2, F.size("all"))).alias("r"))
    return pairs.where(c("l.id") < c("r.id")).select(c(f"l.{key}").alias("key"), "l", "r")


def similarity() -> Column:
    return T.jaccard(c("l.shingles"), c("r.shingles"))


def shared_images(marks: DataFrame, key: str, cap: int) -> DataFrame:
    """left_id, right_id, key, degree, first and standing: a row for each eligible key that two cards share.

    standing is the lesser of both cards'. Where it is 2 both identities are known, and equal, or else the key were not eligible.
    """
    first = c("l.first") & c("r.first")
    pairs = pairs_within(eligible(marks, key, cap), "key")
    return pairs.select(c("l.id").alias("left_id"), c("r.id").alias("right_id"), "key", c("l.degree").alias("degree"), first.alias("first"), F.least("l.standing", "r.standing").alias("standing"))


def image_pairs(shared: DataFrame) -> DataFrame:
    """left_id, right_id, keys, degree, both_first and standing of each pair of cards."""
    return shared.groupBy("left_id", "right_id").agg(
        F.array_join(F.sort_array(F.collect_set("key")), "|").alias("key"), F.max("degree").alias("degree"), F.max("first").alias("both_first"), F.max("standing").alias("standing")
    )


def equal_images(images: DataFrame, cards: DataFrame) -> DataFrame:
    return shared_images(marked(images, cards), "exact", CAPS["exact_auxiliary_images"])


def near(shared: DataFrame) -> DataFrame:
    """left_id and right_id of cards of one known identity that share an image: few, and all for which texts or names are looked up."""
    return shared.where("standing = 2").select("left_id", "right_id").distinct()


def cards_of(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(c("left_id").alias("id")).unionByName(pairs.select(c("right_id").alias("id"))).distinct()
    return cards.join(ends, "id", "left_semi")


def both_cards(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """pairs with the structs l and r: their cards, with shingles of their descriptions."""
    held = cards.withColumn("shingles", T.char_shingles(c("description")))
    side = lambda n, i: held.select(c("id").alias(i), F.struct(*held.columns).alias(n))
    return pairs.join(side("l", "left_id"), "left_id").join(side("r", "right_id"), "right_id")


def with_quarantine(cards: DataFrame, groups: DataFrame) -> DataFrame:
    """cards with quarantined: true for those of a text that is not accepted."""
    return cards.join(groups.where("status != 'accepted_direct'").select("full_text", F.lit(True).alias("quarantined")), "full_text", "left")


def name_edges(cards: DataFrame, images: DataFrame, key: str, stage: str) -> DataFrame:
    known, strong = with_firsts(cards, images), near(equal_images(images, cards))
    known = with_quarantine(known, judged_texts(known))
    return names(known, strong, cards_of(known, strong), key, stage)


def names(cards: DataFrame, strong: DataFrame, few: DataFrame, key: str, stage: str) -> DataFrame:
    """Pairs of one name and one known identity whose first images don't conflict, with like descriptions or a strong image pair.

    Pairs of a quarantined text don't count. Strong pairs share an eligible exact image; they are met by themselves, among the
    few cards they have, so that the pairs of a name need not be dealt out again to meet them.
    """
    wanted = ("id", c(key).alias("key"), "identity", "full_text", "quarantined", "description", "first_exact", "first_perceptual")
    cards, few = (d.where(c(key) != "").select(*wanted) for d in (cards, few))
    fits = c("degree").between(2, CAPS[stage])
    rows = uncrowded(cards, CAPS[stage]).repartition("key").withColumn("degree", F.count("*").over(Window.partitionBy("key"))).where(fits & (c("identity") != ""))
    few = few.join(cards.groupBy("key").agg(F.count("*").alias("degree")).where(fits), "key")

    def sound(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where((c("l.key") == c("r.key")) & (c("l.identity") != "") & (c("l.identity") == c("r.identity")) & ~conflict("l", "r"))
        pairs = pairs.where(~(F.coalesce(c("l.quarantined"), F.lit(False)) & (c("l.full_text") == c("r.full_text"))))
        return pairs.select(c("l.id").alias("left_id"), c("r.id").alias("right_id"), c("l.key").alias("key"), c("l.degree").alias("degree"), similarity().alias("similarity"))

    alike = sound(pairs_within(rows, "key", shingles=lambda x: T.char_shingles(x["description"]))).where(c("similarity") >= LIKENESS)
    other = sound(both_cards(strong, few)).where(c("similarity") < LIKENESS)
    both = alike.withColumn("reason", F.lit("description_similarity")).unionByName(other.withColumn("reason", F.lit("strong_image_pair")))
    return both.withColumn("stage", F.lit(stage)).select(*EDGE)


def corroborated(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """Pairs with text_reason, similarity and torn: what the cards' texts say for a pair, and whether their first images conflict."""
    both = both_cards(pairs, cards.select("id", "full_text", "identity", "description", "first_exact", "first_perceptual"))
    same = (c("l.identity") != "") & (c("l.identity") == c("r.identity"))
    whole = (c("l.full_text") != "") & (c("l.full_text") == c("r.full_text"))
    text = F.when(same & whole, "exact_product_identity_and_full_text").when(same & (similarity() >= LIKENESS), "exact_product_identity_and_description").when(same, "exact_product_identity")
    alike = F.when(same & whole, 1.0).when(same, similarity()).otherwise(0.0)
    return both.select(*pairs.columns, text.alias("text_reason"), alike.alias("similarity"), conflict("l", "r").alias("torn"))


def first_image_edges(cards: DataFrame, images: DataFrame) -> DataFrame:
    return first_images(equal_images(images, cards))


def first_images(shared: DataFrame) -> DataFrame:
    """Pairs whose first images are the same."""
    firsts = shared.where(c("first") & (c("degree") <= CAPS["exact_first_image"])).groupBy("left_id", "right_id").agg(F.min("key").alias("key"), F.max("degree").alias("degree"))
    return firsts.select(F.lit("exact_first_image").alias("stage"), "left_id", "right_id", "key", "degree", F.lit("both_informative_first_images").alias("reason"), F.lit(0.0).alias("similarity"))


def auxiliary_edges(cards: DataFrame, images: DataFrame) -> DataFrame:
    shared = equal_images(images, cards)
    return auxiliary_images(cards_of(with_firsts(cards, images), near(shared)), shared)


def auxiliary_images(few: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs that share other exact images and one known identity, their first images not in conflict."""
    firsts = first_images(shared).select("left_id", "right_id")
    pairs = image_pairs(shared.where("standing = 2")).join(firsts, ["left_id", "right_id"], "left_anti").select("left_id", "right_id", "key", "degree")
    found = corroborated(pairs, few).where("text_reason IS NOT NULL AND NOT torn")
    return found.withColumn("stage", F.lit("exact_auxiliary_images")).withColumn("reason", F.concat(F.lit("exact_auxiliary_plus_"), "text_reason")).select(*EDGE)


def perceptual_edges(cards: DataFrame, images: DataFrame) -> DataFrame:
    looks = shared_images(marked(images, cards), "perceptual", CAPS["perceptual_corroborated"])
    return perceptual_images(cards_of(with_firsts(cards, images), near(looks)), equal_images(images, cards), looks)


def perceptual_images(few: DataFrame, shared: DataFrame, looks: DataFrame) -> DataFrame:
    """Pairs whose images look alike, both first ones or with a text that says so; pairs with an equal image were judged before.

    A text can only speak for cards of one known identity, so only such pairs look up their cards.
    """
    equal = shared.select("left_id", "right_id").distinct()
    pairs = image_pairs(looks).where("both_first AND standing > 0 OR standing = 2").join(equal, ["left_id", "right_id"], "left_anti")
    told = corroborated(pairs.where("standing = 2"), few)
    silent = pairs.where("standing < 2").select("*", F.lit(None).cast("string").alias("text_reason"), F.lit(0.0).alias("similarity"), F.lit(False).alias("torn"))
    reason = F.when(c("both_first"), "two_hashes_per_match_and_both_first_positions")
    reason = reason.when(c("text_reason").isNotNull() & ~c("torn"), F.concat(F.lit("two_hashes_per_match_plus_"), "text_reason"))
    return told.unionByName(silent).withColumn("reason", reason).where("reason IS NOT NULL").withColumn("stage", F.lit("perceptual_corroborated")).select(*EDGE)


def all_edges(cards: DataFrame, images: DataFrame, columns: tuple[str, ...] = EDGE) -> DataFrame:
    """The edges of all stages, as one table with these columns. What several stages need is written once; each step's shuffles go with the step."""
    marks = settled(marked(images, cards))
    bare = settled(cards.join(first_keys(marks.where("first").withColumn("position", F.lit(0))), "id", "left"))
    shared = settled(shared_images(marks, "exact", CAPS["exact_auxiliary_images"]))
    looks = settled(shared_images(marks, "perceptual", CAPS["perceptual_corroborated"]))
    drop_tables(marks)
    groups = settled(judged_texts(bare))
    known = settled(with_quarantine(bare, groups))
    drop_tables(bare)
    strong = settled(near(shared))
    few = settled(cards_of(known, strong.unionByName(near(looks))))
    parts = []
    for stage in (
        text_stars(known, groups), names(known, strong, few, "name", "exact_name_corroborated"), names(known, strong, few, "masked", "masked_name_corroborated"),
        first_images(shared), auxiliary_images(few, shared), perceptual_images(few, shared, looks),
    ):
        parts.append(settled(stage.select(*columns)))
    drop_tables(known, groups, shared, looks, strong, few)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = settled(out)
    drop_tables(*parts)
    return out


def image_key_audit(cards: DataFrame, images: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """key, degree and status of each exact image key of several cards, given the edges of its stage."""
    held = occurrences(images, "exact")
    degree = held.groupBy("key").agg(F.count("*").alias("degree")).where("degree > 1")
    used = edges.select(F.explode(F.split("key", r"\|")).alias("key")).groupBy("key").agg(F.count("*").alias("edges"))
    reused = reused_keys(held, cards).withColumn("reused", F.lit(True))
    status = F.when(c("reused"), "quarantined_cross_identity_reuse").when(c("degree") > cap, "quarantined_degree").when(c("edges") > 0, "accepted").otherwise("rejected")
    return degree.join(reused, "key", "left").join(used, "key", "left").select("key", "degree", status.alias("status"))


def replayed(edges: list[tuple], anchors: dict) -> list[tuple[bool, object, object]]:
    """Of each edge in order: whether it closes safely, and else the first pair without a strong anchor.

    anchors: id to (identity, set of first keys). Cards whose identities are equal, or whose first images share a key,
    anchor each other; two groups merge only if each of one is anchored to each of the other.
    """
    group = {i: [i] for i in anchors}
    out = []
    for left, right in edges:
        one, two = group[left], group[right]
        witness = None
        if one is not two:
            for a in one:
                identity, keys = anchors[a]
                witness = next(((a, b) for b in two if not (identity and identity == anchors[b][0]) and keys.isdisjoint(anchors[b][1])), None)
                if witness:
                    break
            if witness is None:
                merged = sorted(one + two)
                group.update(dict.fromkeys(merged, merged))
        out.append((witness is None, *(witness or (None, None))))
    return out


def safe_edges(edges: DataFrame, cards: DataFrame, images: DataFrame) -> DataFrame:
    """stage, left_id, right_id, key, accepted, witness_left and witness_right of each edge, replayed in order.

    A veto looks only within what all edges together connect, so each such component, which the degree caps keep small,
    is replayed by itself. Stages go by their places, and what a step leaves behind is deleted after the next one.
    """
    kind = cards.schema["id"].dataType
    place = F.array_position(F.array(*map(F.lit, STAGES)), c("stage")).cast("int")
    edges = settled(edges.select(place.alias("place"), "left_id", "right_id", "key", F.when(place == 0, c("stage")).alias("other")))
    ends = edges.select(c("left_id").alias("node")).unionByName(edges.select(c("right_id").alias("node"))).distinct()
    reach = components(ends, edges.select("left_id", "right_id"))
    firsts = F.concat(
        F.transform(F.coalesce("first_exact", F.array().cast("array<string>")), lambda k: F.concat(F.lit("e"), k)),
        F.transform(F.coalesce("first_perceptual", F.array().cast("array<string>")), lambda k: F.concat(F.lit("p"), k)),
    )
    known = cards.select("id", "identity").join(reach.withColumnRenamed("node", "id"), "id")
    known = settled(with_firsts(known, images).select("component", c("id").alias("node"), "identity", firsts.alias("keys")))
    placed = settled(edges.join(reach.select(c("node").alias("left_id"), "component"), "left_id"))
    drop_tables(edges, reach)
    anchors = known.groupBy("component").agg(F.collect_list(F.struct("node", "identity", "keys")).alias("anchors"))
    each = placed.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("place", "left_id", "right_id", "key", "other"))).alias("edges"))
    names = ("stage", "left_id", "right_id", "key")
    name = kind.simpleString()
    schema = f"stage string, left_id {name}, right_id {name}, key string, accepted boolean, witness_left {name}, witness_right {name}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rows, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = {a["node"]: (a["identity"], frozenset(a["keys"])) for a in held}
                found = replayed([(r["left_id"], r["right_id"]) for r in rows], known)
                out += [(STAGES[r["place"] - 1] if r["place"] else r["other"], *(r[n] for n in names[1:]), *f) for r, f in zip(rows, found)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    out = settled(each.join(anchors, "component").select("edges", "anchors").mapInArrow(replay, schema))
    drop_tables(known, placed)
    return out


def stage_audit(nodes: DataFrame, edges: DataFrame, label: str, category: str) -> DataFrame:
    """After each stage's edges: components, the largest, and how many mix labels or categories. nodes: id, label and category.

    A stage joins the components of the one before, so only its own edges are walked; its row is written at once and what
    the stage before left is deleted.
    """
    out, given = None, edges
    edges = given if is_table(given) else settled(given)
    reach = nodes.select(c("id").alias("node"), c("id").alias("component")).distinct()
    for i, stage in enumerate(STAGES):
        some = edges.where(c("stage") == stage).select("left_id", "right_id")
        for end in ("left_id", "right_id"):
            some = some.join(reach.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        some = settled(some.select("left_id", "right_id").where("left_id != right_id").distinct())
        ends = some.select(c("left_id").alias("node")).unionByName(some.select(c("right_id").alias("node"))).distinct()
        merged = components(ends, some)
        up = merged.select(c("node").alias("component"), c("component").alias("up"))
        moved = settled(reach.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        drop_tables(some, merged, reach)
        reach = moved
        each = nodes.join(reach.withColumnRenamed("node", "id"), "id").groupBy("component").agg(
            F.count("*").alias("size"), *((F.min(k) != F.max(k)).cast("bigint").alias(f"mixed_{n}") for n, k in (("labels", label), ("categories", category)))
        )
        row = each.agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.sum("mixed_labels").alias("mixed_labels"), F.sum("mixed_categories").alias("mixed_categories"))
        row = settled(row.select(F.lit(i).alias("place"), F.lit(stage).alias("stage"), *row.columns))
        out = row if out is None else out.unionByName(row)
    drop_tables(reach, *([] if edges is given else [edges]))
    return out


def token_edges(rows: DataFrame, node: str, tokens: str) -> DataFrame:
    """(left_id, right_id): cards that share any token of their lists, as a star from each token's first card."""
    held = rows.select(F.explode(F.array_distinct(tokens)).alias("token"), c(node).alias("node")).where("token IS NOT NULL AND token != ''")
    first = held.groupBy("token").agg(F.min("node").alias("left_id"), F.count("*").alias("many")).where("many > 1")
    return held.join(first, "token").where("node != left_id").select("left_id", c("node").alias("right_id")).distinct()


def row_keys(images: DataFrame, least: float) -> DataFrame:
    """id, exact and perceptual: the distinct image keys of each card; a perceptual key needs a contrast of at least `least`."""
    return images.groupBy("id").agg(F.sort_array(F.collect_set("exact")).alias("exact"), F.sort_array(F.collect_set(F.when(c("contrast") >= least, c("perceptual")))).alias("perceptual"))


def guarded(nodes: DataFrame, edges: DataFrame, fold: str) -> DataFrame:
    """Every row with component, size and safe: whether the component lies within one fold. nodes: id and fold."""
    reach = components(nodes.select(c("id").alias("node")), edges).withColumnRenamed("node", "id")
    each = nodes.join(reach, "id")
    stats = each.groupBy("component").agg(F.count("*").alias("size"), (F.min(fold) == F.max(fold)).alias("safe"))
    return each.join(stats, "component").select("id", fold, "component", "size", "safe")
