"""Text regions of images: duplicates, tiles for a second reading, and which reading counts.

A region is text and a polygon, an array of [x, y]. What a region needs is computed beside it; only the greedy choice
among an image's regions, which are few, runs in Python, over Arrow batches of images.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfwise.functions import geometry
from shelfwise.functions.text import once

c = F.col

#: Marks of a location that a tile should hold, how many tiles an image and an axis may have, what neighbours
#: share of a tile and of half a tile, and from which overlap on two regions of one text are the same.
MARKS_PER_TILE, LEAST_TILES, MOST_TILES, MOST_OF_AXIS = 160, 2, 16, 8
OVERLAP, REFINED_OVERLAP, SAME = 0.10, 0.10, 0.75


def distinct_regions(regions: DataFrame, image: str, text: Column, polygon: str, place: str) -> DataFrame:
    """image, text, polygon, place of the first and duplicates: regions of one text at one place count once."""
    each = regions.select(c(image), text.alias("text"), c(polygon), c(place))
    return each.groupBy(image, "text", polygon).agg(F.min(place).alias(place), (F.count("*") - 1).alias("duplicates"))


def suppressed(rows: list[tuple], least: float) -> list[int]:
    """Places of the rows that stay: in order, each whose text and box no earlier one of those has. rows: text, x0, y0, x1, y1."""
    stay: list[int] = []
    of_text: dict[str, list[tuple]] = {}
    for i, (text, *box) in enumerate(rows):
        size = (box[2] - box[0]) * (box[3] - box[1])
        for x0, y0, x1, y1 in of_text.setdefault(text, []):
            both = max(0, min(x1, box[2]) - max(x0, box[0])) * max(0, min(y1, box[3]) - max(y0, box[1]))
            union = size + (x1 - x0) * (y1 - y0) - both
            if union > 0 and both / union >= least:
                break
        else:
            stay.append(i)
            of_text[text].append(tuple(box))
    return stay


def without_overlaps(regions: DataFrame, image: str, text: Column, polygon: Column, margin: str, tile: str, place: str, least: float = SAME) -> DataFrame:
    """The regions that stay, best first: those farthest from their tile's edge go before, then those of earlier tiles."""
    names = [image, tile, place]
    b = geometry.box(polygon)
    ranked = F.struct((-c(margin)).alias("far"), c(tile).alias("tile"), c(place).alias("place"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"), text.alias("text"))
    each = regions.groupBy(image).agg(F.sort_array(F.collect_list(ranked)).alias("held"))
    wanted = StructType([regions.schema[n] for n in names])
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stay = suppressed([tuple(h[k] for k in ("text", "x0", "y0", "x1", "y1")) for h in held], least)
                out += [(key, held[i]["tile"], held[i]["place"]) for i in stay]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return regions.join(each.mapInArrow(run, wanted), names)


def faults(raw: Column, regions: Column, mark: str, end: str) -> Column:
    """Why a reading is not whole, as an array: marks that don't come in eights, text without regions, no end mark."""
    stripped = F.trim(raw)
    empty = stripped.isin("", end)
    marks = (F.length(raw) - F.length(F.replace(raw, F.lit(mark)))) / len(mark)
    reasons = F.array(
        F.when(marks % 8 != 0, "partial_location_block"), F.when((regions == 0) & ~empty, "noncanonical_unparseable_generation"),
        F.when(~empty & ~F.endswith(stripped, F.lit(end)), "generation_reached_limit_without_eos"),
    )
    return F.array_compact(reasons)


def grid(width: Column, height: Column, marks: Column) -> Column:
    """struct(rows, columns): of all small grids with enough tiles the one whose tiles are most like squares, and few."""
    needed = F.least(F.lit(MOST_TILES), F.greatest(F.lit(LEAST_TILES), F.ceil(marks / MARKS_PER_TILE))).cast("int")
    shapes = F.array(*(F.struct(F.lit(r).alias("rows"), F.lit(k).alias("columns")) for r in range(1, MOST_OF_AXIS + 1) for k in range(1, MOST_OF_AXIS + 1) if r * k <= MOST_TILES))

    def cost(s: Column, least: Column) -> Column:
        uneven = F.abs(F.log((width / s["columns"]) / (height / s["rows"])))
        more = s["rows"] * s["columns"] - least
        return F.struct((uneven + 0.75 * more).alias("cost"), more.alias("more"), uneven.alias("uneven"), s["rows"].alias("rows"), s["columns"].alias("columns"))

    best = once(needed, lambda n: F.array_min(F.transform(F.filter(shapes, lambda s: s["rows"] * s["columns"] >= n), lambda s: cost(s, n))))
    return F.struct(best["rows"].alias("rows"), best["columns"].alias("columns"))


def spans(length: Column, parts: Column) -> Column:
    """Windows (start, end) of an axis, which share a part of themselves with their neighbours."""
    edge = lambda i: F.floor(i * length / parts)

    def window(i: Column) -> Column:
        pad = F.ceil((edge(i + 1) - edge(i)) * OVERLAP)
        start = F.when(i == 0, 0).otherwise(F.greatest(F.lit(0), edge(i) - pad))
        end = F.when(i == parts - 1, length).otherwise(F.least(length, edge(i + 1) + pad))
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    return F.transform(F.sequence(F.lit(0), parts - 1), window)


def tiles(images: DataFrame, image: str, width: str, height: str, marks: str) -> DataFrame:
    """A row for each tile: image, tile, left, top, right and bottom, row by row."""
    planned = images.withColumn("grid_", grid(c(width), c(height), c(marks)))
    rows = planned.select(image, c("grid_.columns").alias("columns"), F.posexplode(spans(c(height), c("grid_.rows"))).alias("r", "y"), spans(c(width), c("grid_.columns")).alias("xs"))
    each = rows.select(image, "columns", "r", "y", F.posexplode("xs").alias("k", "x"))
    return each.select(image, (c("r") * c("columns") + c("k")).alias("tile"), c("x.start").alias("left"), c("y.start").alias("top"), c("x.end").alias("right"), c("y.end").alias("bottom"))


def halves(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Both halves of a tile along its longer axis, which share a part: an array of two structs."""
    wide = (right - left) >= (bottom - top)
    size = F.when(wide, right - left).otherwise(bottom - top)
    middle = F.when(wide, left).otherwise(top) + F.floor(size / 2)
    pad = F.ceil(size / 2 * REFINED_OVERLAP)
    box = lambda a, b, x, y: F.struct(a.cast("int").alias("left"), b.cast("int").alias("top"), x.cast("int").alias("right"), y.cast("int").alias("bottom"))
    low, high = middle + pad, middle - pad
    one = box(left, top, F.when(wide, F.least(right, low)).otherwise(right), F.when(wide, bottom).otherwise(F.least(bottom, low)))
    two = box(F.when(wide, F.greatest(left, high)).otherwise(left), F.when(wide, top).otherwise(F.greatest(top, high)), right, bottom)
    return F.array(one, two)


def moved(polygon: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """A tile's polygon in the image: moved, kept inside, and rounded to thousandths of the image's sides, halves to even."""
    inside = lambda v, by, most: F.least(most, F.greatest(F.lit(0), v + by))
    snap = lambda v, size: F.bround(F.bround(v * 1000 / size, 0) * size / 1000, 0).cast("int")
    return F.transform(polygon, lambda p: F.array(snap(inside(p[0], left, width), width), snap(inside(p[1], top, height), height)))


def edge_margin(polygon: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """How far a polygon's box is from its tile's nearest edge, as a part of the tile's shorter side."""
    b = geometry.box(polygon)
    near = F.least(b["x0"] - left, b["y0"] - top, right - b["x1"], bottom - b["y1"])
    return near / F.greatest(F.lit(1), F.least(right - left, bottom - top))


def overlaid(records: DataFrame, repairs: DataFrame, key: str) -> DataFrame:
    """The records, each replaced whole by its repair where there is one, and repaired."""
    rest = [n for n in records.columns if n != key]
    new = repairs.select(key, F.struct(*rest).alias("new_"))
    out = records.join(new, key, "left")
    return out.select(key, *(F.when(c("new_").isNotNull(), c(f"new_.{n}")).otherwise(c(n)).alias(n) for n in rest), c("new_").isNotNull().alias("repaired"))


def availability(error: Column, reasons: Column, sound: Column) -> list[Column]:
    """status and reasons of a reading: an error, faults, or polygons that aren't sound make it unavailable."""
    why = F.when(error.isNotNull(), F.array(F.lit("source_processing_error"))).when(F.size(reasons) > 0, F.array_sort(F.array_distinct(reasons))).when(~sound, F.array(F.lit("strict_schema_or_geometry_failure")))
    return [F.when(why.isNull(), "OCR_AVAILABLE").otherwise("OCR_UNAVAILABLE").alias("status"), F.coalesce(why, F.array().cast("array<string>")).alias("reasons")]
