"""Motion operators over every plane, frame and grid point, against brute-force versions."""

import math

import duckdb
import numpy as np
import pytest
from conftest import sf

from neurofold import adapters as A
from neurofold import queries as Q
from neurofold.operators import motion

SMALL = sf("0.001")


def brute_shift(source, target, radius):
    """Plain circular cross-correlation by its sum; a shift of -radius in y comes out as radius + 1."""
    best, found = -np.inf, None
    for dx in range(-radius, radius + 1):
        for dy in range(-radius, radius + 1):
            c = (np.roll(source, (-dy, -dx), (0, 1)) * target).sum()
            if c > best + 1e-6:
                best, found = c, (radius + 1 if dy == radius else -dy, -dx)
    return found


def brute_displacements(frames, references, points, radius, single=False):
    """frames: {(z, tp): image}, references: {z: image}, points: (z, grid_idx, ind)."""
    out = []
    for z, g, ind in points:
        h = next(iter(frames.values())).shape[0]
        y, x = (ind - 1) % h, (ind - 1) // h - 1
        cut = lambda image, a, b: image[y + a - radius : y + a + radius + 1, x + b - radius : x + b + radius + 1]
        for tp in sorted(t for p, t in frames if p == z):
            target = cut(frames[z, tp], 0, 0)
            dy, dx = brute_shift(cut(frames[z, 1], 0, 0), target, radius)
            best, dz = -np.inf, 0
            for s in range(-2, 3):
                if z + s in references and not single:
                    r = np.corrcoef(target.ravel(), cut(references[z + s], -dy, -dx).ravel())[0, 1]
                    if r > best:
                        best, dz = r, s
            out.append((z, g, ind, tp, dy, dx, dz))
    return sorted(out)


def found(df):
    return sorted(tuple(int(v) for v in r) for r in df.select("z", "grid_idx", "ind", "tp", "dy", "dx", "dz").collect())


def table(spark, images, names):
    rows = [(*key, y + 1, x + 1, float(v)) for key, image in images.items() for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in (*names, "y", "x")) + ", v double")


@pytest.fixture(scope="module")
def planes():
    rng = np.random.default_rng(4)
    base = {z: rng.integers(0, 900, (41, 37)).astype(float) for z in range(1, 4)}
    # Each frame is its plane or a neighbour moved round, with noise.
    frames = {(z, tp): np.roll(base[min(3, z + (tp == 3))], (tp - 1, 1 - tp), (0, 1)) + rng.integers(0, 60, (41, 37)) for z in base for tp in range(1, 5)}
    return base, frames


@pytest.mark.parametrize("single", [False, True])
def test_displacements(spark, planes, single):
    base, frames = planes
    grid = motion.grid(spark, 41, 37, 3)
    points = [(z, r["grid_idx"], r["ind"]) for z in base for r in grid.collect()]
    got = motion.displacements(table(spark, frames, ("z", "tp")), table(spark, {(z,): v for z, v in base.items()}, ("z",)), spark.createDataFrame(points, "z long, grid_idx long, ind long"), 41, 37, 3, single)
    expected = brute_displacements(frames, base, points, 3, single)
    assert found(got) == expected and len(expected) == len(points) * 4
    assert single or len({r[6] for r in expected}) > 2


def stk():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    images = {}
    for z, y, x, v in con.execute(A.with_views("SELECT z, y, x, v FROM px", "px")).fetchall():
        images.setdefault(z, np.zeros((A.HEIGHT, A.WIDTH)))[y - 1, x - 1] = v
    return images


def test_queries_run_over_all_of_stk(spark):
    images = stk()
    points = [(1, r["grid_idx"], r["ind"]) for r in motion.grid(spark, A.HEIGHT, A.WIDTH, Q.RADIUS).collect()]
    expected = brute_displacements({(1, t): v for t, v in images.items()}, images, points, Q.RADIUS)
    assert len(expected) == 120 * len(images)
    assert found(Q.QUERIES["xcorr_shift"](spark, SMALL)) == expected
    course = {r["tp"]: r for r in Q.QUERIES["motion_timecourse"](spark, SMALL).collect()}
    assert sorted(course) == sorted(images)
    for t, r in course.items():
        own = [e for e in expected if e[3] == t]
        assert r["xy_av"] == pytest.approx(np.mean([math.hypot(e[4], e[5]) for e in own]), abs=1e-5)
        assert r["z_av"] == pytest.approx(np.mean([e[6] for e in own]), abs=1e-5)


def test_register_over_all_of_stk(spark):
    images = stk()
    got = {r["t"]: (r["dy"], r["dx"]) for r in Q.QUERIES["stack_register"](spark, SMALL).collect()}
    assert sorted(got) == sorted(images)
    for t, image in images.items():
        power = {(dy, dx): (np.roll(image, (dy, dx), (0, 1)) * images[1]).sum() for dy in range(-49, 51) for dx in range(-31, 33)}
        assert power[got[t]] == max(power.values())


def test_z_interleave_takes_every_column(spark):
    assert Q.QUERIES["z_interleave"](spark, SMALL).select("x").distinct().count() == A.WIDTH


def test_displacement_groups_hold_one_patch(spark):
    """The groups of Python are a patch at a timepoint, not a plane."""
    plan = Q.QUERIES["xcorr_shift"](spark, SMALL)._jdf.queryExecution().toString()
    groups = [x.split("]")[0] for x in plan.split("FlatMapGroupsInArrow [")[1:]]
    assert groups and all("grid_idx" in g and "tp" in g for g in groups), groups


def images_table(spark, images, time):
    rows = [(z, t, *v.shape, v.astype("<f8").tobytes(order="F")) for (z, t), v in images.items()]
    return spark.createDataFrame(rows, f"z long, {time} long, h int, w int, image binary")


def test_no_image_is_shuffled(spark, planes):
    """References and first images are read by the tasks: whatever the broadcast threshold, no Exchange lies above the images."""
    base, frames = planes
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        images = images_table(spark, frames, "tp")
        references = images_table(spark, {(z, 0): v for z, v in base.items()}, "t")
        points = [(z, r["grid_idx"], r["ind"]) for z in base for r in motion.grid(spark, 41, 37, 3).collect()]
        for df in (motion.displacements_of_images(images, references, spark.createDataFrame(points, "z long, grid_idx long, ind long"), 3), motion.register_images(images.withColumnRenamed("tp", "t"), 1, move=True)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Join" not in plan
        got = motion.displacements_of_images(images, references, spark.createDataFrame(points, "z long, grid_idx long, ind long"), 3)
        assert found(got) == brute_displacements(frames, base, points, 3)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_images_are_moved_as_pixels_are(spark):
    rng = np.random.default_rng(8)
    image = rng.integers(0, 99, (12, 9)).astype(float)
    pixels = table(spark, {(1, 1): image}, ("z", "t"))
    for dy, dx in ((3, 2), (-4, 1), (2, -8), (-11, -1), (0, 4), (5, 0), (0, 0), (30, 2)):
        shifts = spark.createDataFrame([(1, 1, dy, dx)], "z long, t long, dy long, dx long")
        expected = np.zeros(image.shape)
        for r in motion.apply_shift(pixels, shifts).where("y between 1 and 12 and x between 1 and 9").collect():
            expected[r["y"] - 1, r["x"] - 1] = r["v"]
        assert (motion.shifted(image, dy, dx) == expected).all(), (dy, dx)


def test_registered_stacks_line_up(spark):
    """Frames that are their plane's first one moved round come back onto it, plane by plane; planes without the reference have none."""
    rng = np.random.default_rng(9)
    base = {z: rng.integers(0, 900, (30, 26)).astype(float) for z in (1, 2)}
    frames = {(z, t): np.roll(base[z], (t - 1, 2 * (t - 1)), (0, 1)) for z in base for t in (1, 2, 3)} | {(3, 2): base[1]}
    got = motion.register_images(images_table(spark, frames, "t"), 1, move=True).collect()
    assert {(r["z"], r["t"]): (r["dy"], r["dx"]) for r in got} == {(z, t): (1 - t, 2 - 2 * t) for z, t in frames if z < 3}
    for r in got:
        image, d = np.frombuffer(r["image"], "<f8").reshape(30, 26, order="F"), r["t"] - 1
        assert (image[: 30 - d, : 26 - 2 * d] == base[r["z"]][: 30 - d, : 26 - 2 * d]).all()
