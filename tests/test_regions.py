import random

from pyspark.sql import functions as F

from shelfwise.operators import regions


def test_overlaps_equal_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for image in range(20):
        for place in range(rng.randint(1, 12)):
            x, y = rng.randint(0, 6), rng.randint(0, 3)
            rows.append((image, place % 3, place, round(rng.random(), 1), rng.choice("ab"), [[x, y], [x + 20, y], [x + 20, y + 9], [x, y + 9]]))
    d = spark.createDataFrame(rows, "image int, tile int, place int, margin double, text string, quad array<array<int>>").repartition(3)
    got = {(r.image, r.tile, r.place) for r in regions.without_overlaps(d, "image", F.col("text"), F.col("quad"), "margin", "tile", "place").collect()}
    want = set()
    for image in range(20):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[3], r[1], r[2])):
            def iou(s):
                (ax, ay), (bx, by) = r[5][0], s[5][0]
                both = max(0, 20 - abs(ax - bx)) * max(0, 9 - abs(ay - by))
                return both / (360 - both)

            if not any(s[4] == r[4] and iou(s) >= 0.75 for s in kept):
                kept.append(r)
        want |= {r[:3] for r in kept}
    assert got == want


def test_tiles_cover_the_image(spark):
    d = spark.createDataFrame([(1, 1000, 300, 900), (2, 64, 64, 0), (3, 300, 900, 5000)], "image int, w int, h int, marks int")
    for r in d.collect():
        held = regions.tiles(d.where(f"image = {r.image}"), "image", "w", "h", "marks").collect()
        assert 2 <= len(held) <= 16 and sorted(t.tile for t in held) == list(range(len(held)))
        assert min(t.left for t in held) == min(t.top for t in held) == 0 and max(t.right for t in held) == r.w and max(t.bottom for t in held) == r.h
        for x in range(0, r.w, 7):
            for y in range(0, r.h, 7):
                assert any(t.left <= x < t.right and t.top <= y < t.bottom for t in held)
