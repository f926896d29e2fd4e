"""Regions, tiles and readings over lines as regions and orders as images."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import geometry
from shelfwise.operators import regions
from shelfwise.plans.forms import AREA, Q, QUAD, crossing, quad
from shelfwise.queries import query

c = F.col

#: Regions: lines with a text and a square of whole numbers; several lines of an order have the same.
SQUARE = "[[x, y], [x + 10, y], [x + 10, y + 8], [x, y + 8]]"
LINES = f"r AS (SELECT *, {SQUARE} AS quad FROM (SELECT l_orderkey AS image, l_linenumber AS place, l_partkey, 'Part  ' || (l_suppkey % 3) AS text, l_partkey % 4 * 3 AS x, l_suppkey % 2 * 2 AS y FROM lineitem))"


def lines(t):
    x, y = c("l_partkey") % 4 * 3, c("l_suppkey") % 2 * 2
    square = F.array(F.array(x, y), F.array(x + 10, y), F.array(x + 10, y + 8), F.array(x, y + 8))
    return t("lineitem").select(c("l_orderkey").alias("image"), c("l_linenumber").alias("place"), "l_partkey", F.concat(F.lit("Part  "), (c("l_suppkey") % 3).cast("string")).alias("text"), square.alias("quad"))


def plain():
    return F.lower(F.regexp_replace("text", r"\s+", " "))


@query(f"WITH {LINES} SELECT image, replace(lower(text), '  ', ' ') AS text, quad[1][1] AS x, quad[1][2] AS y, min(place) AS place, count(*) - 1 AS duplicates FROM r GROUP BY ALL")
def er22_distinct_regions(t):
    out = regions.distinct_regions(lines(t), "image", plain(), "quad", "place")
    return out.select("image", "text", c("quad")[0][0].alias("x"), c("quad")[0][1].alias("y"), "place", "duplicates")


@query("")  # greedy by image; a test holds it against a plain one
def er23_without_overlaps(t):
    d = lines(t).withColumn("margin", (c("l_partkey") % 5) / 5).withColumn("tile", (c("l_partkey") % 3).cast("int"))
    d = d.dropDuplicates(["image", "tile", "place"])
    return regions.without_overlaps(d, "image", plain(), c("quad"), "margin", "tile", "place").select("image", "tile", "place")


@query("SELECT id, CASE WHEN id % 4 = 1 THEN score + 1 ELSE score END AS score, CASE WHEN id % 4 = 1 THEN 1 - label ELSE label END AS label, id % 4 = 1 AS repaired FROM cards")
def er24_overlay(t):
    d = t("cards").select("id", "score", "label")
    return regions.overlaid(d, d.where("id % 4 = 1").select("id", (c("score") + 1).alias("score"), (1 - c("label")).alias("label")), "id")


RAW = "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN ' </s> ' ELSE 'text ' || repeat('<LOC_7>', CAST(id % 17 AS INTEGER)) || CASE WHEN id % 3 = 0 THEN '</s>' ELSE '' END END"
FAULTS = """list_filter([CASE WHEN (length(raw) - length(replace(raw, '<LOC_7>', ''))) // 7 % 8 <> 0 THEN 'partial_location_block' END, CASE WHEN id % 2 = 0 AND trim(raw) NOT IN ('', '</s>') THEN 'noncanonical_unparseable_generation' END,
  CASE WHEN trim(raw) NOT IN ('', '</s>') AND NOT suffix(trim(raw), '</s>') THEN 'generation_reached_limit_without_eos' END], lambda x: x IS NOT NULL)"""


def readings(t):
    marks = F.concat(F.lit("text "), F.repeat(F.lit("<LOC_7>"), (c("id") % 17).cast("int")), F.when(c("id") % 3 == 0, "</s>").otherwise(""))
    return t("cards").select("id", F.when(c("id") % 5 == 0, "").when(c("id") % 5 == 1, " </s> ").otherwise(marks).alias("raw"), (c("id") % 2).alias("regions"))


@query(f"WITH w AS (SELECT id, {RAW} AS raw FROM cards) SELECT id, {FAULTS} AS reasons FROM w")
def er25_faults(t):
    return readings(t).select("id", regions.faults(c("raw"), c("regions"), "<LOC_7>", "</s>").alias("reasons"))


@query("""WITH i AS (SELECT id, CAST(200 + id % 900 AS INTEGER) AS w, CAST(150 + id % 700 AS INTEGER) AS h, id % 1500 AS marks FROM cards), n AS (SELECT *, least(16, greatest(2, ceil(marks / 160))) AS needed FROM i),
g AS (SELECT id, w, h, first(r ORDER BY abs(ln((w / k) / (h / r))) + 0.75 * (r * k - needed), r * k - needed, abs(ln((w / k) / (h / r))), r, k) AS r, first(k ORDER BY abs(ln((w / k) / (h / r))) + 0.75 * (r * k - needed), r * k - needed, abs(ln((w / k) / (h / r))), r, k) AS k FROM n, (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS r) a, (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS k) b WHERE r * k BETWEEN needed AND 16 GROUP BY ALL),
t AS (SELECT *, unnest(range(r)) AS i FROM g), u AS (SELECT *, unnest(range(k)) AS j FROM t),
e AS (SELECT *, j * w // k AS x0, (j + 1) * w // k AS x1, i * h // r AS y0, (i + 1) * h // r AS y1 FROM u)
SELECT id AS image, CAST(i * k + j AS INTEGER) AS tile, CAST(CASE WHEN j = 0 THEN 0 ELSE greatest(0, x0 - ceil((x1 - x0) * 0.1)) END AS INTEGER) AS "left", CAST(CASE WHEN i = 0 THEN 0 ELSE greatest(0, y0 - ceil((y1 - y0) * 0.1)) END AS INTEGER) AS top,
  CAST(CASE WHEN j = k - 1 THEN w ELSE least(w, x1 + ceil((x1 - x0) * 0.1)) END AS INTEGER) AS "right", CAST(CASE WHEN i = r - 1 THEN h ELSE least(h, y1 + ceil((y1 - y0) * 0.1)) END AS INTEGER) AS bottom FROM e""")
def er26_tiles(t):
    images = t("cards").select(c("id").alias("image"), (200 + c("id") % 900).cast("int").alias("w"), (150 + c("id") % 700).cast("int").alias("h"), (c("id") % 1500).alias("marks"))
    return regions.tiles(images, "image", "w", "h", "marks")


MOVED = "list_transform(q, lambda p: [CAST(round_even(round_even(least(900, greatest(0, p[1] + 37)) * 1000 / 900, 0) * 900 / 1000, 0) AS INTEGER), CAST(round_even(round_even(least(700, greatest(0, p[2] - 5)) * 1000 / 700, 0) * 700 / 1000, 0) AS INTEGER)])"


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {QUAD} AS q FROM lineitem), m AS (SELECT l_orderkey, l_linenumber, l_partkey, {MOVED} AS q FROM x) SELECT l_orderkey, l_linenumber, l_partkey, q[1][1] AS x, q[1][2] AS y, round(least(list_min(list_transform(q, lambda p: p[1])) - 37, list_min(list_transform(q, lambda p: p[2])) + 5, 237 - list_max(list_transform(q, lambda p: p[1])), 145 - list_max(list_transform(q, lambda p: p[2]))) / 150, 9) AS margin FROM m")
def er27_translated(t):
    """A tile's polygons in the image, and how far they are from the tile's edge."""
    q = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", regions.moved(quad(), F.lit(37), F.lit(-5), F.lit(900), F.lit(700)).alias("q"))
    margin = regions.edge_margin(c("q"), F.lit(37), F.lit(-5), F.lit(237), F.lit(145))
    return q.select("l_orderkey", "l_linenumber", "l_partkey", c("q")[0][0].alias("x"), c("q")[0][1].alias("y"), F.round(margin, 9).alias("margin"))


@query("""WITH b AS (SELECT id, CAST(id % 90 AS INTEGER) AS l, CAST(id % 70 AS INTEGER) AS t, CAST(id % 90 + 40 + id % 130 AS INTEGER) AS r, CAST(id % 70 + 50 + id % 80 AS INTEGER) AS d FROM cards), w AS (SELECT *, r - l >= d - t AS wide, CASE WHEN r - l >= d - t THEN r - l ELSE d - t END AS size FROM b),
m AS (SELECT *, CASE WHEN wide THEN l ELSE t END + size // 2 AS mid, ceil(size / 2 * 0.1) AS pad FROM w)
SELECT id, 0 AS part, l AS "left", t AS top, CAST(CASE WHEN wide THEN least(r, mid + pad) ELSE r END AS INTEGER) AS "right", CAST(CASE WHEN wide THEN d ELSE least(d, mid + pad) END AS INTEGER) AS bottom FROM m
UNION ALL SELECT id, 1, CAST(CASE WHEN wide THEN greatest(l, mid - pad) ELSE l END AS INTEGER), CAST(CASE WHEN wide THEN t ELSE greatest(t, mid - pad) END AS INTEGER), r, d FROM m""")
def er28_halves(t):
    x, y = c("id") % 90, c("id") % 70
    both = regions.halves(x, y, x + 40 + c("id") % 130, y + 50 + c("id") % 80)
    return t("cards").select("id", F.posexplode(both).alias("part", "b")).select("id", "part", "b.*")


SOUND = f"len(list_distinct(q)) >= 3 AND {AREA} > 0 AND NOT ({crossing(*Q)}) AND NOT ({crossing(Q[1], Q[2], Q[3], Q[0])})"


@query(f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey AS id, {QUAD} AS q, {RAW.replace('id %', 'l_orderkey %')} AS raw FROM lineitem), f AS (SELECT l_orderkey, l_linenumber, l_partkey, {SOUND} AS sound, {FAULTS} AS reasons FROM x) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 10 = 0 OR len(reasons) > 0 OR NOT sound THEN 'OCR_UNAVAILABLE' ELSE 'OCR_AVAILABLE' END AS status, CASE WHEN l_partkey % 10 = 0 THEN ['source_processing_error'] WHEN len(reasons) > 0 THEN list_sort(reasons) WHEN NOT sound THEN ['strict_schema_or_geometry_failure'] ELSE [] END AS reasons FROM f")
def er29_availability(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", quad().alias("q")).join(readings(t).select(c("id").alias("l_orderkey"), "raw", "regions"), "l_orderkey")
    error = F.when(c("l_partkey") % 10 == 0, "timeout")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *regions.availability(error, regions.faults(c("raw"), c("regions"), "<LOC_7>", "</s>"), geometry.valid_quad(c("q"))))
