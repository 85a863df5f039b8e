"""Duplicate removal against a plain fold over planes, and the overlay's panels and file."""

import random

import numpy as np
from pyspark.sql import functions as F

from neurofold.operators import extract, segment
from neurofold.sources import tiff

H, W = 40, 30


def brute_duplicates(cells, high):
    """Planes one after another: stamps of living cells, components of what neighbouring planes share, the largest ids of each."""
    gone = set()
    planes = sorted({z for _, z, _, _ in cells})

    def painted(z):
        out = {}
        for i, p, cy, cx in sorted(cells):
            if p == z and i not in gone:
                for dx in range(-2, 3):
                    for dy in range(-2, 3):
                        ind = (cx - 1) * H + cy + dx * H + dy
                        if 0 < ind < H * W:
                            out[ind] = i
        return out

    for z in planes:
        above, below = painted(z), painted(z + 1)
        open_ = set(above) & set(below)
        found = []
        while open_:
            stack, part = [min(open_)], []
            open_.discard(stack[0])
            while stack:
                ind = stack.pop()
                part.append(ind)
                y, x = (ind - 1) % H, (ind - 1) // H
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        other = (x + dx) * H + y + dy + 1
                        if 0 <= y + dy < H and 0 <= x + dx < W and other in open_:
                            open_.discard(other)
                            stack.append(other)
            found.append((max(above[i] for i in part), max(below[i] for i in part)))
        gone |= {b for a, b in found if (a, b) in high}
    return sorted(gone)


def test_greedy_duplicates(spark):
    rng = random.Random(2)
    cells = [(k + 1, z, rng.randint(1, H), rng.randint(1, W)) for k, z in enumerate(sorted(rng.choice([1, 2, 3, 4, 7, 8]) for _ in range(160)))]
    # A chain over three planes whose middle cell goes, so that the last one stays.
    cells += [(201, 20, 10, 10), (202, 21, 10, 10), (203, 22, 10, 10)]
    high = {(a, b) for a, za, *_ in cells for b, zb, *_ in cells if zb == za + 1 and rng.random() < 0.5} | {(201, 202), (202, 203)}
    df = spark.createDataFrame(cells, "cell_id long, z long, cy long, cx long")
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in high] + [(1, 2, 0.1), (3, 4, float("nan"))], "a long, b long, r double")
    got = sorted(r["cell_id"] for r in extract.greedy_duplicates(df, pairs, H, W, 0.5).collect())
    assert got == brute_duplicates(cells, high) and 202 in got and 203 not in got and len(got) > 10
    assert extract.greedy_duplicates(df.limit(0), pairs, H, W, 0.5).count() == 0


def test_components_number_pixels_of_the_whole_plane(spark):
    """A mask that ends early has the same indices as one that does not."""
    mask = spark.createDataFrame([(1, 2, 3), (1, 3, 3)], "z long, y long, x long")
    assert sorted(r["ind"] for r in segment.components(mask, 100, 64).collect()) == [202, 203]


def test_overlay_panels_and_colour_file(spark, tmp_path):
    grey = np.linspace(0, 1, 20).reshape(4, 5)
    pixels = spark.createDataFrame([(z, y + 1, x + 1, float(grey[y, x])) for z in (1, 2) for y in range(4) for x in range(5)], "z long, y long, x long, n double")
    labelled = spark.createDataFrame([(1, 2, 3, 1), (1, 4, 5, 10), (2, 1, 1, 12)], "z long, y long, x long, label long")
    image = segment.overlay(pixels, labelled, 5)
    rows = {(r["z"], r["y"], r["x"]): (r["red"], r["green"], r["blue"]) for r in image.collect()}
    assert len(rows) == 2 * 4 * 11 and rows[1, 1, 6] == (255, 255, 255)
    assert rows[1, 2, 3] == (round(255 * grey[1, 2]),) * 3 and rows[1, 2, 9] == segment.COLOURS[1] and rows[1, 4, 11] == segment.COLOURS[0] and rows[2, 1, 7] == segment.COLOURS[2]
    assert rows[2, 3, 8] == (round(150 * grey[2, 1]),) * 3
    tiff.write_colour(image, str(tmp_path / "mask.tif"))
    pages = tiff.read(spark, str(tmp_path / "mask.tif")).orderBy("page").collect()
    assert [(r["h"], r["w"]) for r in pages] == [(4, 11)] * 2
    for r in pages:
        page = np.frombuffer(bytes(r["px"]), np.uint8).reshape(4, 11, 3)
        assert all(tuple(page[y - 1, x - 1]) == c for (z, y, x), c in rows.items() if z == r["page"])
    assert image.select(F.max("red")).first()[0] == 255


def test_components_of_links(spark):
    """A long chain, a star, a ring, a lone node and links twice over."""
    from neurofold.operators.components import components

    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(20, 30), (30, 10), (10, 20)] + [(7, 7)] + [(30, 20), (101, 100)]
    got, contracted = ({r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), few).collect()} for few in (1000, 20))
    assert got == contracted == {**{k: 100 for k in range(100, 161)}, **{k: 500 for k in range(500, 540)}, 10: 10, 20: 10, 30: 10, 7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0 == components(spark.createDataFrame([], "a long, b long"), 0).count()


def test_duplicates_fall_into_groups(spark):
    """Far cells are folded apart, and the result is that of one fold over all planes."""
    rng = random.Random(7)
    cells = [(k + 1, z, rng.randint(1, H), rng.randint(1, W)) for k, z in enumerate(sorted(rng.randint(1, 9) for _ in range(120)))]
    high = {(a, b) for a, za, *_ in cells for b, zb, *_ in cells if zb == za + 1 and rng.random() < 0.6}
    df = spark.createDataFrame(cells, "cell_id long, z long, cy long, cx long")
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in high], "a long, b long, r double")
    got = sorted(r["cell_id"] for r in extract.greedy_duplicates(df, pairs, H, W, 0.5, fold=5).collect())
    assert got == brute_duplicates(cells, high)
    groups = extract.components(extract.interactions(df, H, W))
    assert groups.count() == len(cells) and groups.select("component").distinct().count() > 3
