"""Blocks as far away as others, told apart in double precision as the SQL does."""

import math

from sparkloom.operators import images


def test_diagonal_distances_that_nearly_tie(spark):
    ways = {}
    for a in range(30, 90):
        for b in range(30, 90):
            ways.setdefault(a * a + b * b, []).append((a, b))
    pics, blocks, want = [], [], {}
    for n, pairs in ways.items():
        if len(pairs) < 4:
            continue
        doc, far = str(n), []
        pics.append((doc, 1, f"i{n}", 0.0, 0.0, 10.0, 10.0, 100.0, 100.0))
        for a, b in pairs:
            x0, y0, text = (a + 10 - 2) / 2, (b + 10 - 2) / 2, f"{a}-{b}"
            blocks.append((doc, 1, x0, y0, x0 + 2, y0 + 2, text))
            dx, dy = (x0 + x0 + 2 - 10) / 2 / 100, (y0 + y0 + 2 - 10) / 2 / 100
            far.append((math.sqrt(dx * dx + dy * dy) + 0.25, y0, x0, text))
        want[f"i{n}"] = [text for *_, text in sorted(far)][:5]
    pics = spark.createDataFrame(pics, "doc string, page int, image_id string, ix0 double, iy0 double, ix1 double, iy1 double, width double, height double")
    blocks = spark.createDataFrame(blocks, "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {}
    for r in images.nearest_blocks(pics, blocks).orderBy("image_id", "nth").collect():
        got.setdefault(r.image_id, []).append(r.text)
    assert got == want and len(want) > 20
