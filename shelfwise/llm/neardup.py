"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find grouping.

A document's set is its distinct 5-word shingles; documents link when 100 * intersection >= 75 * union.
SuperMinHash draws for each element one random permutation of the signature's places; the jth place it visits gets
j plus a random fraction, and each place keeps its least value. Places are visited layer by layer for all elements
at once, and a set stops early: once every place holds less than j, later layers change nothing.

Texts with equal sets are one class from the start. Each band's bucket first compares its members to one of
them, and what is found is grouped; only buckets whose members still lie in several groups go on, to another centre
and at last to all members of other groups, block by block. So a bucket of copies costs one comparison a member, no
link is lost to a limit, and every link is confirmed on the words themselves.

Null, empty and wordless texts have empty sets and link with nothing. Fewer than five words make one shingle.
Rows with equal ids are rows of their own. Null ids are no component's smallest id. Very long texts are hashed
in slices of their shingles. Empty tables give no rows. Columns of any name pass through unread. Texts whose sets
have equal 64-bit hashes throughout are one class: two sets of n shingles that differ by one do so with odds 2**-64.

A text, centre or group that very many rows hold is looked up in salted parts, hot buckets by broadcast, and what two
blocks of a cluster share is dealt by a key of the pair, so no task gets all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.batches import map_slices, packed
from shelfwise.llm.tables import among, cut_lineage, salted_lookup

SHINGLE, PLACES, ROWS = 5, 128, 4
SHARE = 75  # of the union, in hundredths
#: Shingles whose permutations are drawn at a time.
ELEMENTS = 1 << 16
#: Rounds of one centre a bucket, before blocks; bytes of a block, of which a row counts for so many at least.
CENTRES, BLOCK_BYTES, ROW_BYTES = 2, 2 << 20, 2048
#: Shingles of texts just compared that a task keeps.
KNOWN_SHINGLES = 200_000
#: A bucket with more than this part of all places, and more rows than these, is hot: no more than HOT buckets are.
HOT, HOT_ROWS = 4096, 100_000

def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(text: str | None) -> set[bytes]:
    w = words(text)
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LAYERS = np.arange(1, PLACES + 1, dtype=np.uint64) * GOLDEN


#: A random number for each byte, and the base of the powers by which a byte's place in its word counts.
BYTES, BASE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN), 0x5851F42D4C957F2D
#: Words hashed at a time.
BLOCK_WORDS = 200_000


def word_hashes(w: list[bytes]) -> np.ndarray:
    out = []
    for at in range(0, len(w), BLOCK_WORDS):
        raw = np.frombuffer(b" ".join(w[at : at + BLOCK_WORDS]) + b" ", np.uint8)
        ends = np.flatnonzero(raw == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        size = ends + 1 - starts
        powers = np.cumprod(np.full(int(size.max()), BASE, np.uint64))
        place = np.arange(len(raw)) - np.repeat(starts, size)
        out.append(mix(np.add.reduceat(BYTES[raw] * powers[place], starts) + size.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def element_hashes(docs: list[list[bytes]]) -> list[np.ndarray]:
    """Distinct hashes of each text's shingles, from its words' hashes."""
    h = word_hashes([x for d in docs for x in d])
    whole = np.full(max(0, len(h) - SHINGLE + 1), SHINGLE, np.uint64)
    for k in range(SHINGLE):
        whole = mix((whole + GOLDEN) ^ h[k : k + len(whole)])
    out, at = [], 0
    for d in docs:
        if len(d) >= SHINGLE:
            out.append(np.unique(whole[at : at + len(d) - SHINGLE + 1]))
        else:
            one = np.full(1 if d else 0, len(d), np.uint64)
            for k in range(len(d)):
                one = mix((one + GOLDEN) ^ h[at + k : at + k + 1])
            out.append(one)
        at += len(d)
    return out


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """SuperMinHash of `sets` sets; elements[i] belongs to set owner[i]. Values hold a layer and a fraction."""
    out = np.full((sets, PLACES), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    for at in range(0, len(elements), ELEMENTS):
        e, o = elements[at : at + ELEMENTS], owner[at : at + ELEMENTS].astype(np.int64)
        order = np.broadcast_to(np.arange(PLACES, dtype=np.uint8), (len(e), PLACES)).copy()
        for j in range(PLACES):
            bits = mix(e + LAYERS[j])
            other = j + ((bits & np.uint64(0xFFFFFFFF)) % np.uint64(PLACES - j)).astype(np.int64)
            rows = np.arange(len(e))
            place = order[rows, other].copy()
            order[rows, other] = order[:, j]
            np.minimum.at(flat, o * PLACES + place, (bits >> np.uint64(32)) | np.uint64(j << 32))
            sure = np.unique(o)
            open_sets = sure[out[sure].max(axis=1) >= np.uint64((j + 1) << 32)]
            if not open_sets.size:
                break
            if open_sets.size < sure.size:
                stay = np.isin(o, open_sets)
                e, o, order = e[stay], o[stay], order[stay]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """Each set's bucket in each band."""
    many = PLACES // ROWS
    parts = signature.reshape(len(signature), many, ROWS)
    h = np.broadcast_to(np.arange(1, many + 1, dtype=np.uint64) * GOLDEN, (len(signature), many)).copy()
    for k in range(ROWS):
        h = mix(h ^ parts[:, :, k]) + GOLDEN
    return h.view(np.int64)


def features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (of the text), n_shingles, node (of the set; null if it is empty) and bands, a row for each row."""

    def make():
        def rows(ids, keys, texts):
            sets = element_hashes([words(t) for t in texts])
            size = np.array([len(s) for s in sets])
            sig = signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets))
            of_sets = bands(sig).tolist()
            out = []
            for i, s in enumerate(sets):
                node = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                out.append((ids[i], keys[i], len(s), node, of_sets[i] if len(s) else []))
            return out

        return rows

    kind = df.schema[id_col].dataType.simpleString()
    some = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col))).alias("key"), F.col(text_col).alias("text"))
    return map_slices(some, f"id {kind}, key binary, n_shingles bigint, node binary, bands array<bigint>", make, limit=2 << 20)


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' sets are alike enough, compared word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, set[bytes]] = {}
        held = 0

        def of(node: bytes, text: str) -> set[bytes]:
            nonlocal held
            if node not in known:
                if held > KNOWN_SHINGLES:
                    known.clear()
                    held = 0
                known[node] = shingles(text)
                held += len(known[node])
            return known[node]

        for batch in batches:
            keep = []
            for a, b, text_a, text_b in zip(*(batch.column(k).to_pylist() for k in range(4))):
                x, y = of(a, text_a), of(b, text_b)
                both = len(x & y)
                keep.append(100 * both >= SHARE * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # Both sides read the texts under the same names, so that one shuffle of them serves both.
    texts = texts.where("text is not null")
    both = salted_lookup(pairs.withColumnRenamed("b", "node"), texts, "node", "a").select(F.col("a").alias("node"), F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = both.where("text_b is not null").join(texts, "node").select(F.col("node").alias("a"), "b", F.col("text").alias("text_a"), "text_b")
    return both.mapInArrow(run, "a binary, b binary")


def local_union(links: DataFrame) -> DataFrame:
    """(a, b) with b the least node that a's partition connects it to: a forest of the partition's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        forest = [(a, root(a)) for a in parent]
        forest = [(a, r) for a, r in forest if a != r]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in forest], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return links.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that a link touches; root: the least node it is connected to.

    Each partition's links are first reduced to a forest. What is joined here are two ids a row; where a root holds
    very many of them, adaptive execution splits its partition, whose other side has that root once.
    """
    edges = cut_lineage(local_union(links))
    whole: DataFrame | None = None
    higher = lambda m: m.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    through = lambda m, by: m.join(higher(by), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        hook = cut_lineage(through(through(hook, hook), hook))
        whole = hook if whole is None else cut_lineage(through(whole, hook))
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(hook.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("root", end)
        edges = cut_lineage(ends.select("a", "b").where("a != b").distinct())
    return links.limit(0).select(F.col("a").alias("node"), F.col("b").alias("root")) if whole is None else whole


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays of distinct values, neither empty, share."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def within_blocks(open_members: DataFrame, texts: DataFrame, hot: list[int]) -> DataFrame:
    """Pairs (a, b) of different groups that share a bucket and whose sets are alike enough by their hashes.

    open_members: bucket, node, root. Members that buckets connect are a cluster; a cluster is cut into blocks of
    bounded size, and each two blocks of it meet in one task, which gives out only what it found.
    """
    centre = open_members.groupBy("bucket").agg(F.min("node").alias("b"))
    reach = components(by_bucket(open_members.select("bucket", F.col("node").alias("a")), centre, hot).where("a != b").select("a", "b").distinct())
    each = open_members.groupBy("node", "root").agg(F.collect_list("bucket").alias("buckets")).join(reach.withColumnRenamed("root", "cluster"), "node")

    def make():
        return lambda nodes, roots, buckets, clusters, t: [
            (n, r, b, c, e.tobytes()) for n, r, b, c, e in zip(nodes, roots, buckets, clusters, element_hashes([words(x) for x in t]))
        ]

    schema = "node binary, root binary, buckets array<bigint>, cluster binary, elements binary"
    each = cut_lineage(map_slices(each.join(texts, "node").select("node", "root", "buckets", "cluster", "text"), schema, make))
    sizes = each.groupBy("cluster").agg(F.sum(F.greatest(F.length("elements"), F.lit(ROW_BYTES))).alias("size")).select("cluster", F.ceil(F.col("size") / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = salted_lookup(each, sizes, "cluster", "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "buckets", "elements")
    # One key of the pair: rows that lie together by cluster alone would leave all its pairs in one task.
    dealt = dealt.withColumn("pair", F.concat_ws(":", F.hex("cluster"), "i", "j")).drop("cluster")

    def meet(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, node, root, buckets = (table.column(c).to_pylist() for c in ("block", "node", "root", "buckets"))
        sets = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()]
        of_bucket: dict[int, list[int]] = {}
        for k in (k for k in range(len(node)) if block[k] == j):
            for b in buckets[k]:
                of_bucket.setdefault(b, []).append(k)
        found = []
        for k in (k for k in range(len(node)) if block[k] == i):
            one, n = sets[k], len(sets[k])
            for m in {m for b in buckets[k] for m in of_bucket.get(b, ())}:
                two = sets[m]
                if root[k] != root[m] and (i != j or k < m) and 100 * min(n, len(two)) >= SHARE * max(n, len(two)):
                    both = in_both(one, two)
                    if 100 * both >= SHARE * (n + len(two) - both):
                        found.append((node[k], node[m]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return dealt.groupBy("pair").applyInArrow(meet, "a binary, b binary")


def hot_buckets(crowded: DataFrame) -> list[int]:
    """Buckets that hold more than a part 1 / HOT of all places: HOT at most."""
    places = crowded.agg(F.sum("many")).first()[0] or 0
    return [r[0] for r in crowded.where(F.col("many") > max(HOT_ROWS, places // HOT)).select("bucket").collect()]


def by_bucket(rows: DataFrame, table: DataFrame, hot: list[int]) -> DataFrame:
    """rows join table by bucket, which table has once: of hot buckets its few short rows are broadcast, so none is one task's."""
    if not hot:
        return rows.join(table, "bucket")
    few = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in hot], "bucket bigint"))
    cool = rows.join(few, "bucket", "left_anti").join(table, "bucket")
    return rows.join(F.broadcast(table.join(few, "bucket", "left_semi")), "bucket").select(*cool.columns).unionByName(cool)


def grouped(classes: DataFrame, texts_of) -> DataFrame:
    """(node, root) of the classes that link with others. classes: node, n_shingles, bands; texts_of(nodes): node, text."""
    each = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    crowded = cut_lineage(each.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1"))
    hot = hot_buckets(crowded)
    members = cut_lineage(by_bucket(among(each, crowded, "bucket"), crowded.select("bucket"), hot))
    texts = cut_lineage(texts_of(members.select("node").distinct()))
    now, roots, links, tested = members.withColumn("root", F.col("node")), None, None, None
    for turn in range(CENTRES + 1):
        if roots is not None:
            # A bucket whose members are all of one group has nothing left to find.
            known = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            mixed = known.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("bucket")
            now = cut_lineage(by_bucket(known, mixed, hot))
        if now.isEmpty():
            break
        if turn < CENTRES:
            a = now.select("bucket", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
            centre = now.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "root")).alias("c"))
            b = cut_lineage(centre.select("bucket", F.col("c.node").alias("b"), F.col("c.n").alias("n_b"), F.col("c.root").alias("root_b")))
            alike = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SHARE) & (F.col("root_a") != F.col("root_b"))
            pairs = by_bucket(a, b, hot).where(alike).select("a", "b").distinct()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
        else:
            pairs = within_blocks(now.select("bucket", "node", "root"), texts, hot)
        pairs = cut_lineage(pairs)
        found = cut_lineage(linked(pairs, texts))
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        if roots is None or not found.isEmpty():
            roots = components(links)
    return roots if roots is not None else classes.select("node", F.col("node").alias("root")).limit(0)


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept, first (whether the row is the one that stays of its group's rows) and key (of its text)."""
    rows = cut_lineage(features(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    some = rows.where("node is not null")
    classes = some.groupBy("node").agg(F.min("key").alias("key"), F.max("n_shingles").alias("n_shingles"), F.min(order).alias("least"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes)

    def texts_of(nodes: DataFrame) -> DataFrame:
        keys = classes.join(nodes, "node").select("key", "node")
        each = df.where(F.col(text_col).isNotNull()).select(F.unhex(F.md5(F.col(text_col))).alias("key"), F.col(text_col).alias("text"))
        return among(each, keys, "key").groupBy("key").agg(F.first("text").alias("text")).join(keys, "key").select("node", "text")

    roots = grouped(classes.select("node", "n_shingles", "bands"), texts_of)
    known = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = cut_lineage(known.groupBy("root").agg(F.min("least").alias("best")))
    known = cut_lineage(salted_lookup(known.select("node", "root"), best, "root", "node").select("node", F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row")))
    out = salted_lookup(rows.select("id", "key", "n_shingles", "node", "row"), known, "node", "row")
    alone = F.col("node").isNull()
    out = out.withColumn("component_id", F.when(alone, F.col("id")).otherwise(F.col("best_id")))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
        (alone | (F.col("row") == F.col("best_row"))).alias("first"), "key",
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay: of each group the one with the smallest id, null ids last.

    Of rows that share that id the first text in order stays; rows equal in id and text are one row.
    """
    stay = groups(df, id_col, text_col).where("first").select(F.col(id_col).alias("stay_id"), F.col("key").alias("stay_key")).distinct()
    keyed = packed(df, id=id_col, key=F.unhex(F.md5(F.col(text_col))))
    kept = keyed.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & F.col("key").eqNullSafe(F.col("stay_key")), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("kept.*")
