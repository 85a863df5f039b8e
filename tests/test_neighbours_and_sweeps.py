"""Nearest points by rings, samples swept into frames, and rolling percentiles by runs, against brute force."""

import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from neurofold.operators import motion, traces


def test_nearest_points_by_rings(spark):
    """Regular, clumped and few points, cells inside, outside and far away, ties, planes without points."""
    rng = random.Random(3)
    points = [(1, i, 10 + 5 * (i % 9), 12 + 5 * (i // 9)) for i in range(60)]
    points += [(2, i, rng.choice([3, 3, 4, 90]), rng.choice([5, 6, 200])) for i in range(40)]
    points += [(3, i, rng.randint(1, 400), rng.randint(1, 300)) for i in range(150)]
    points += [(4, i, 7, 7) for i in range(3)] + [(5, 0, 1, 1)]
    cells = [(k, z, rng.randint(-20, 420), rng.randint(-20, 320)) for k, z in enumerate([1, 2, 3, 4, 5, 6] * 30)]
    got = motion.nearest(spark.createDataFrame(cells, "cell_id long, z int, cy int, cx int"), spark.createDataFrame([(*p, p[1] * 0.5) for p in points], "z int, grid_idx int, py int, px int, med_y double"))
    expected = []
    for c, z, cy, cx in cells:
        near = sorted(((cy - y) ** 2 + (cx - x) ** 2, i) for pz, i, y, x in points if pz == z)[:5]
        expected += [(c, i, k, float(d)) for k, (d, i) in enumerate(near, 1)]
    assert sorted((r["cell_id"], r["grid_idx"], r["k"], r["d2"]) for r in got.collect()) == sorted(expected)
    assert {"med_y", "py", "cy"} <= set(got.columns)
    empty = spark.createDataFrame([], "z int, grid_idx int, py int, px int")
    assert motion.nearest(spark.createDataFrame(cells, "cell_id long, z int, cy int, cx int"), empty).count() == 0


def test_rings_meet_few_points(spark):
    """On a full grid a cell meets at most 25 points before they are ranked."""
    grid = spark.range(400).selectExpr("1 AS z", "id AS grid_idx", "10 + 5 * (id % 20) AS py", "10 + 5 * (id div 20) AS px")
    cells = spark.range(2000).selectExpr("id AS cell_id", "1 AS z", "10 + (id * 7) % 95 AS cy", "10 + (id * 13) % 95 AS cx")
    assert motion.nearest(cells, grid).count() == 10_000
    side = 5
    inside = grid.selectExpr("grid_idx", "(py - 10) div 5 AS by", "(px - 10) div 5 AS bx").collect()
    most = max(sum(abs(p["by"] - (r["cy"] - 10) // side) <= motion.RINGS and abs(p["bx"] - (r["cx"] - 10) // side) <= motion.RINGS for p in inside) for r in cells.limit(200).collect())
    assert most <= 25


@pytest.mark.parametrize("stretch", [1 << 16, 7])
def test_samples_are_swept_into_frames(spark, stretch):
    """Frames with gaps, of one sample, overlapping by two, without samples, across stretches; several cells and channels."""
    rng = random.Random(5)
    samples = [(c, t, rng.random(), rng.randint(0, 9) / 2) for c in (1, 2) for t in range(1, 120) if not (c == 2 and 40 <= t < 55)]
    frames = [(1, 1, 1, 10), (1, 2, 2, 30), (1, 3, 31, 31), (1, 4, 35, 90), (1, 5, 100, 300), (2, 1, 5, 20), (2, 2, 42, 50), (2, 3, 60, 59), (2, 4, 70, 71), (3, 1, 1, 5)]
    stats = {"a": ("median", "x"), "b": ("mean", "y"), "c": ("median", "y")}
    got = traces.align(spark.createDataFrame(frames, "cell_id int, frame int, begin int, end int"), spark.createDataFrame(samples, "cell_id int, t int, x double, y double").repartition(3), stats, stretch)
    expected = {}
    for c, f, b, e in frames:
        own = [s for s in samples if s[0] == c and b <= s[1] <= e]
        if b == e:
            expected[c, f] = (0.0, 0.0, 0.0)
        elif b < e:
            expected[c, f] = (statistics.median(s[2] for s in own), statistics.mean(s[3] for s in own), statistics.median(s[3] for s in own)) if own else (None, None, None)
    rows = {(r["cell_id"], r["frame"]): (r["a"], r["b"], r["c"]) for r in got.collect()}
    assert rows.keys() == expected.keys()
    assert all(rows[k] == (pytest.approx(v) if v[0] is not None else v) for k, v in expected.items())
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_too_many_frames_over_one_sample(spark):
    frames = spark.createDataFrame([(1, 1, 1, 9), (1, 2, 2, 9), (1, 3, 3, 9)], "cell_id int, frame int, begin int, end int")
    with pytest.raises(Exception, match="more than 2 frames overlap, cell 1"):
        traces.align(frames, spark.createDataFrame([(1, 4, 1.0)], "cell_id int, t int, f double")).collect()


def brute_rolling(f, window, percentile):
    n, w = len(f), min(window, len(f))
    k = traces.window_rank(w, percentile)
    out = []
    for j in range(1, n + 1):
        at = min(max(j, -(-w // 2)), n - w // 2)
        out.append(np.sort(f[at - (-(-w // 2)) : at + w // 2])[k - 1])
    return np.array(out)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 90), st.integers(1, 100), st.sampled_from([0, 1, 15, 50, 99.5, 100]), st.integers(1, 12), st.integers(0, 99))
def test_windows_are_ranked_by_bits(n, window, percentile, kinds, seed):
    f = np.random.default_rng(seed).integers(0, kinds, n).astype(float)
    assert np.array_equal(traces.rolling_rank(f, window, percentile), brute_rolling(f, window, percentile))
    f[f == 1] = np.nan
    assert np.array_equal(traces.rolling_rank(f, window, percentile), brute_rolling(f, window, percentile), equal_nan=True)


@pytest.mark.parametrize(("window", "run"), [(1, 4), (5, 10), (6, 12), (20, 7), (64, 1)])
def test_runs_give_what_whole_traces_give(spark, window, run):
    """Traces shorter than the window, of exactly a run, ending just behind one, and long."""
    rng = np.random.default_rng(window)
    length = max(run, 2 * window)
    lengths = sorted({1, 2, window, max(1, window - 1), length, length + 1, length + window // 2, length + window // 2 + 1, 2 * length - 1, 5 * length + 3})
    traces_ = {c: rng.integers(0, 50, n).astype(float) for c, n in enumerate(lengths)}
    points = spark.createDataFrame([(c, t + 1, float(v)) for c, f in traces_.items() for t, v in enumerate(f)], "cell_id long, t long, f double").repartition(4)
    rows = traces.rolling_percentile_runs(points, window, 30, run).collect()
    assert len(rows) == sum(lengths)
    got = {(r["cell_id"], r["t"]): r["f0"] for r in rows}
    for c, f in traces_.items():
        assert [got[c, t + 1] for t in range(len(f))] == brute_rolling(f, window, 30).tolist(), (c, len(f))


def test_gaps_in_a_trace_are_refused(spark):
    for rows in ([(1, 1, 1.0), (1, 3, 2.0)], [(1, 2, 1.0), (1, 3, 2.0)]):
        with pytest.raises(Exception, match="without gaps"):
            traces.rolling_percentile_runs(spark.createDataFrame(rows, "cell_id long, t long, f double"), 2, 50).collect()


def test_time_hardly_grows_with_the_window():
    """Passes follow the samples' ranks, not the window."""
    import time

    f, took = np.random.default_rng(1).standard_normal(200_000), {}
    for w in (100, 12_800):
        began = time.process_time()
        traces.rolling_rank(f, w, 15)
        took[w] = time.process_time() - began
    assert took[12_800] < 4 * took[100]
