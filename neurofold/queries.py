"""Registered engine queries and their DuckDB twins.

Images and traces come from the driver's tables through ``adapters``; float results
are rounded on both sides, integers are 64 bits wide.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .config import Params
from .functions.semantics import exceeds, mround, slope, to_index, to_yx
from .operators import extract, motion, segment, stencil, traces
from .plans import batch
from .sources import planestack, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

H, W = A.HEIGHT, A.WIDTH
#: Thresholds that suit the adapters' images.
SEGMENT = Params(br_threshold=250, cont_threshold=5, cell_radius=5)
WINDOW, PERCENTILE, EPOCH = 20, 15, 15


def query(sql: str | None = None, *views: str):
    """Registers a query under its function's name, with its twin over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = A.with_views(sql, *views) if views else sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6).alias(name)


def r6_half(c: str, name: str) -> Column:
    """``r6`` of a mean of fitted shifts: one half-way between two roundings goes away from 0, whatever its last bits are."""
    return r6(F.round(c, 13), name)


def rolling_sql(w: int, p: float, out: str) -> str:
    """The rolling percentile by sorted windows; a trace shorter than the window is its own window."""
    return f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM tr),
    k AS (SELECT *, least({w}, n) AS w, greatest(1, least(least({w}, n), CAST(round(least({w}, n) * {p} / 100.0) AS BIGINT))) AS k FROM s),
    full_ AS (SELECT a.cell_id, a.t, list_sort(list(b.f))[any_value(a.k)] AS f0 FROM k a JOIN tr b ON b.cell_id = a.cell_id AND b.t BETWEEN a.t - CAST(ceil(a.w / 2.0) AS BIGINT) + 1 AND a.t + a.w // 2
              WHERE a.t >= ceil(a.w / 2.0) AND a.t <= a.n - a.w // 2 GROUP BY a.cell_id, a.t),
    r AS (SELECT a.cell_id, a.t, a.f, b.f0 FROM k a JOIN full_ b ON a.cell_id = b.cell_id AND b.t = least(greatest(a.t, CAST(ceil(a.w / 2.0) AS BIGINT)), a.n - a.w // 2))
    {out}"""


# Traces


@query(rolling_sql(WINDOW, PERCENTILE, "SELECT cell_id, t, round(f0, 6) AS f0 FROM r"), "tr")
def rolling_percentile(spark, sf_dir):
    based = traces.rolling_percentile(traces.as_arrays(A.tr(spark, sf_dir)), WINDOW, PERCENTILE)
    return traces.as_points(based, "f0", "f0").select("cell_id", "t", r6("f0", "f0"))


@query(rolling_sql(WINDOW, PERCENTILE, "SELECT cell_id, t, round(f0, 6) AS f0 FROM r"), "tr")
def rolling_percentile_windows(spark, sf_dir):
    return traces.rolling_percentile_points(A.tr(spark, sf_dir), WINDOW, PERCENTILE).select("cell_id", "t", r6("f0", "f0"))


@query(rolling_sql(600, PERCENTILE, "SELECT cell_id, t, round(f0, 6) AS f0 FROM r"), "tr")
def rolling_window_clamped(spark, sf_dir):
    based = traces.rolling_percentile(traces.as_arrays(A.tr(spark, sf_dir)), 600, PERCENTILE)
    return traces.as_points(based, "f0", "f0").select("cell_id", "t", r6("f0", "f0"))


@query("SELECT cell_id, t, round(f, 6) AS f0 FROM tr", "tr")
def rolling_w1(spark, sf_dir):
    based = traces.rolling_percentile(traces.as_arrays(A.tr(spark, sf_dir)), 1, PERCENTILE)
    return traces.as_points(based, "f0", "f0").select("cell_id", "t", r6("f0", "f0"))


DFF = rolling_sql(WINDOW, PERCENTILE, "SELECT cell_id, t, round(f0, 6) AS f0, round((f - f0) / (greatest(f0, 0) + 10.0), 6) AS dff FROM r")


@query(DFF, "tr")
def rolling_dff(spark, sf_dir):
    out = traces.rolling_dff(A.tr(spark, sf_dir), WINDOW, PERCENTILE, 10)
    return out.select("cell_id", "t", r6("f0", "f0"), r6("dff", "dff"))


@query("SELECT cell_id, t, round((f - f / 2) / (greatest(f / 2, 0) + 2.5), 6) AS dff FROM tr", "tr")
def dff_offset(spark, sf_dir):
    p = A.tr(spark, sf_dir)
    return p.select("cell_id", "t", r6(traces.dff(F.col("f"), F.col("f") / 2, 2.5), "dff"))


LOW20 = f"w AS (SELECT cell_id, (t - 1) // {EPOCH} AS w, f, max(t) OVER (PARTITION BY cell_id) // {EPOCH} AS windows FROM tr), lo AS (SELECT *, row_number() OVER (PARTITION BY cell_id, w ORDER BY f) AS r FROM w WHERE w < windows), b AS (SELECT cell_id, w, greatest(avg(f), 0) AS b FROM lo WHERE r <= {mround(EPOCH / 5)} GROUP BY ALL)"


@query(f"WITH {LOW20} SELECT cell_id, w, round(b, 6) AS b FROM b", "tr")
def window_low20(spark, sf_dir):
    return traces.window_low_mean(A.tr(spark, sf_dir), EPOCH).select("cell_id", "w", r6("b", "b"))


@query(
    f"""WITH {LOW20}, m AS (SELECT cell_id, avg(b) FILTER (w < 2) AS b12, count(*) AS n FROM b GROUP BY ALL),
    s AS (SELECT cell_id, b12, regr_slope(ln(b / b12), CAST({mround(EPOCH / 2)} + w * {EPOCH} AS DOUBLE)) AS slope FROM b JOIN m USING (cell_id) WHERE n >= 2 GROUP BY ALL)
    SELECT cell_id, t, round(exp(slope * t) * b12, 6) AS fitted, round(f / (exp(slope * t) * b12), 6) AS f FROM tr JOIN s USING (cell_id)""",
    "tr",
)
def exp_bleach_fit(spark, sf_dir):
    return traces.bleach_fit(A.tr(spark, sf_dir), EPOCH).select("cell_id", "t", r6("fitted", "fitted"), r6("f", "f"))


DEMEAN = f"d AS (SELECT cell_id, t, f - avg(f) OVER (PARTITION BY cell_id, (t - 1) % {EPOCH}) AS f FROM (SELECT *, max(t) OVER (PARTITION BY cell_id) AS n FROM tr) WHERE t <= n // {EPOCH} * {EPOCH})"


@query(f"WITH {DEMEAN} SELECT cell_id, t, round(f, 6) + 0.0 AS f FROM d", "tr")
def epoch_demean(spark, sf_dir):
    return traces.epoch_demean(A.tr(spark, sf_dir), EPOCH).select("cell_id", "t", (F.round("f", 6) + F.lit(0.0)).alias("f"))


@query(f"SELECT cell_id, round(min(m), 6) AS base FROM (SELECT cell_id, (t - 1) // {EPOCH} AS e, avg(f) AS m FROM tr GROUP BY ALL) GROUP BY ALL", "tr")
def min_baseline(spark, sf_dir):
    return traces.epoch_min(A.tr(spark, sf_dir), EPOCH).select("cell_id", r6("base", "base"))


@query("SELECT cell_id, CAST(CASE WHEN t <= 10 THEN 1 WHEN t <= 25 THEN 2 WHEN t <= 30 THEN 3 ELSE 4 END AS BIGINT) AS trial, round(avg(f), 6) AS mean FROM tr WHERE t <= 45 GROUP BY ALL", "tr")
def trial_average(spark, sf_dir):
    return traces.trial_average(A.tr(spark, sf_dir), [10, 15, 5, 15]).select("cell_id", "trial", r6("mean", "mean"))


#: Trials by the data: a user's events of a month are a trial, so its length is their number.
TRIALS = "ev AS (SELECT user_id AS cell_id, CAST(month(ts) AS BIGINT) AS trial, count(*) AS n FROM events GROUP BY ALL), span AS (SELECT cell_id, trial, sum(n) OVER (PARTITION BY cell_id ORDER BY trial) AS last, n FROM ev)"


@query(f"WITH {TRIALS} SELECT tr.cell_id, trial, round(avg(f), 6) AS mean FROM span JOIN tr ON tr.cell_id = span.cell_id AND t BETWEEN last - n + 1 AND last GROUP BY ALL", "tr")
def trial_means(spark, sf_dir):
    """Trials of the lengths that a table gives, over whole traces."""
    lengths = A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell_id"), F.month("ts").cast("long").alias("trial")).agg(F.count("*").alias("length"))
    return traces.trial_means(A.tr(spark, sf_dir), lengths).select("cell_id", "trial", r6("mean", "mean"))


@query("WITH n AS (SELECT cell_id, count(*) AS n FROM tr GROUP BY ALL), p AS (SELECT a.cell_id AS a, b.cell_id AS b, a.n AS na, b.n AS nb FROM n a JOIN n b ON b.cell_id = a.cell_id + 1) SELECT a, b, round(CASE WHEN na <> nb THEN 0 ELSE corr(x.f, y.f) END, 6) AS r FROM p JOIN tr x ON x.cell_id = a JOIN tr y ON y.cell_id = b AND y.t = x.t GROUP BY a, b, na, nb", "tr")
def pair_corr(spark, sf_dir):
    points = A.tr(spark, sf_dir)
    cells = points.select("cell_id").distinct()
    pairs = cells.select(F.col("cell_id").alias("a"), (F.col("cell_id") + 1).alias("b")).join(cells.select(F.col("cell_id").alias("b")), "b", "left_semi")
    return traces.pair_correlation(pairs, points).select("a", "b", r6("r", "r"))


EDGES = "e AS (SELECT cell_id, t, q - lag(q) OVER (PARTITION BY cell_id ORDER BY t) AS d FROM (SELECT cell_id, t, round(floor(f / 10) / 0.05) AS q FROM tr))"


def _coarse(spark, sf_dir):
    return A.tr(spark, sf_dir).withColumn("f", F.floor(F.col("f") / 10).cast("double"))


@query(f"WITH {EDGES} SELECT cell_id, t, d FROM e WHERE d <> 0", "tr")
def edge_segments(spark, sf_dir):
    return traces.edges(_coarse(spark, sf_dir))


def _segments(spark, sf_dir):
    points = _coarse(spark, sf_dir)
    return traces.debounce(traces.edges(points), points.groupBy("cell_id").agg(F.max("t").alias("last")), 2)


# The fold over edges, as a recursion over each cell's ordered marks.
SEGMENTS = f"""{EDGES}, marks AS (SELECT cell_id, m, row_number() OVER (PARTITION BY cell_id ORDER BY m) AS i FROM (SELECT cell_id, t - 1 AS m FROM e WHERE d <> 0 UNION ALL SELECT cell_id, max(t) FROM tr GROUP BY ALL)),
walk AS (SELECT cell_id, i, CAST(1 AS BIGINT) AS prev, m AS close, CAST(1 AS BIGINT) AS begin_, true AS kept FROM marks WHERE i = 1
         UNION ALL SELECT w.cell_id, x.i, CASE WHEN x.m - w.prev > 2 THEN x.m ELSE w.prev END, x.m, w.prev + 1, x.m - w.prev > 2 FROM walk w JOIN marks x ON x.cell_id = w.cell_id AND x.i = w.i + 1),
seg AS (SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY i) AS frame, CASE WHEN i = 1 THEN 1 ELSE begin_ END AS b, close AS e_ FROM walk WHERE kept)"""


@query(f'WITH {SEGMENTS} SELECT cell_id, frame, b AS "begin", e_ AS "end" FROM seg', "tr")
def debounce_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(f"WITH {SEGMENTS} SELECT cell_id, frame, round(CASE WHEN any_value(e_ - b) > 0 THEN median(f) ELSE 0 END, 6) AS med, round(CASE WHEN any_value(e_ - b) > 0 THEN avg(f) ELSE 0 END, 6) AS mean FROM seg JOIN tr USING (cell_id) WHERE t BETWEEN b AND e_ GROUP BY cell_id, frame", "tr")
def frame_stim_align(spark, sf_dir):
    return traces.align(_segments(spark, sf_dir), A.tr(spark, sf_dir)).select("cell_id", "frame", r6("med", "med"), r6("mean", "mean"))


#: Five channels of a recording beside its traces: what an event and its time hold.
CHANNELS = "ch AS (SELECT user_id AS cell_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS s1, CAST(second(ts) AS DOUBLE) AS s2, CAST(length(event_type) AS DOUBLE) AS s3, CAST(minute(ts) AS DOUBLE) AS s4, CAST(event_id % 7 AS DOUBLE) AS bl FROM events)"


def _channels(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    other = {"s2": F.second("ts"), "s3": F.length("event_type"), "s4": F.minute("ts"), "bl": F.col("event_id") % 7}
    return A.table(spark, sf_dir, "events").select(F.col("user_id").alias("cell_id"), F.row_number().over(order).cast("long").alias("t"), F.col("value").alias("s1"), *(c.cast("double").alias(name) for name, c in other.items()))


DUCK = {"median": "median", "mean": "avg"}
ALIGNED = {"s1": ("median", "s1"), "s2": ("mean", "s2"), "s3": ("median", "s3"), "s4": ("median", "s4"), "bl": ("median", "bl")}


@query(f"WITH {SEGMENTS}, {CHANNELS} SELECT cell_id, frame, {', '.join(f'round(CASE WHEN any_value(e_ - b) > 0 THEN {DUCK[how]}({c}) ELSE 0 END, 6) AS {c}' for c, (how, _) in ALIGNED.items())} FROM seg JOIN ch USING (cell_id) WHERE t BETWEEN b AND e_ GROUP BY cell_id, frame", "tr")
def frame_stim_channels(spark, sf_dir):
    """Stimulus parameters and block of every frame: medians of four channels, mean of one."""
    return traces.align(_segments(spark, sf_dir), _channels(spark, sf_dir), ALIGNED).select("cell_id", "frame", *(r6(c, c) for c in ALIGNED))


@query("SELECT cell_id, round(regr_slope(f, CAST(t AS DOUBLE)) * (max(t) - 1), 6) AS tilt FROM tr GROUP BY ALL", "tr")
def linear_tilt(spark, sf_dir):
    return A.tr(spark, sf_dir).groupBy("cell_id").agg(r6(slope(F.col("f"), F.col("t").cast("double")) * (F.max("t") - 1), "tilt"))


# Levels, quantiles and per-pixel scalars


@query("SELECT round(avg(v), 6) AS level FROM (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM px) WHERE r <= round(n / 20.0)", "px")
def bg_level_5pct(spark, sf_dir):
    return traces.lowest_mean(A.px(spark, sf_dir), "v").select(r6("level", "level"))


@query("WITH l AS (SELECT avg(v) AS level FROM (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM px) WHERE r <= round(n / 20.0)) SELECT cell_id, t, round(CAST(CAST(f - level AS FLOAT) AS DOUBLE), 3) AS f FROM tr, l", "px", "tr")
def bg_subtract(spark, sf_dir):
    level = traces.lowest_mean(A.px(spark, sf_dir), "v")
    return traces.subtract(A.tr(spark, sf_dir), level).select("cell_id", "t", F.round(F.col("f").cast("double"), 3).alias("f"))


@query("SELECT v AS threshold FROM (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM px) WHERE r = round(0.85 * n)", "px")
def suggested_threshold_85(spark, sf_dir):
    return traces.ranked_value(A.px(spark, sf_dir), "v", F.round(F.col("n") * 0.85)).select(F.col("value").alias("threshold"))


@query("WITH s AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM px WHERE z = 1), h AS (SELECT 0.85 * max(n) + 0.5 AS h FROM s) SELECT round(CAST(max(v) FILTER (r = floor(h)) + (h - floor(h)) * (max(v) FILTER (r = floor(h) + 1) - max(v) FILTER (r = floor(h))) AS DOUBLE), 6) AS threshold FROM s, h GROUP BY h", "px")
def prctile_hazen_85(spark, sf_dir):
    plane = A.px(spark, sf_dir).where("z = 1")
    h = F.col("n") * 0.85 + 0.5
    low = traces.ranked_value(plane, "v", F.floor(h)).select(F.col("value").alias("a"))
    high = traces.ranked_value(plane, "v", F.floor(h) + 1).select(F.col("value").alias("b"))
    n = plane.agg(F.count("*").alias("n"))
    return n.crossJoin(low).crossJoin(high).select(r6(F.col("a") + (h - F.floor(h)) * (F.col("b") - F.col("a")), "threshold"))


P99 = "s AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY z) AS n FROM px), l AS (SELECT z, min(v) AS lo, max(v) FILTER (r = round(n / 100.0)) AS hi FROM s GROUP BY z)"


def _per_plane_top(pixels: DataFrame, share: int) -> DataFrame:
    """(z, lo, hi): least value and the one at rank round(n / share) from the top, by value counts of each plane."""
    from pyspark.sql import Window

    counts = pixels.groupBy("z", "v").agg(F.count("*").alias("c"))
    down, whole = Window.partitionBy("z").orderBy(F.desc("v")), Window.partitionBy("z")
    ranked = counts.withColumn("upto", F.sum("c").over(down)).withColumn("n", F.sum("c").over(whole))
    return ranked.groupBy("z").agg(F.min("v").alias("lo"), F.max(F.when(F.col("upto") >= F.round(F.col("n") / share), F.col("v"))).alias("hi"), F.max("v").alias("top"), F.max("n").alias("n"))


@query(f"WITH {P99} SELECT z, lo, hi FROM l", "px")
def p99_scale(spark, sf_dir):
    return _per_plane_top(A.px(spark, sf_dir), 100).select("z", "lo", "hi")


@query(f"WITH {P99} SELECT z, y, x, round(least(CAST(v - lo AS DOUBLE) / (hi - lo), 1.0), 6) AS v FROM px JOIN l USING (z)", "px")
def norm99(spark, sf_dir):
    p = A.px(spark, sf_dir)
    scale = _per_plane_top(p, 100)
    return p.join(F.broadcast(scale), "z").select("z", "y", "x", r6(F.least((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(1.0)), "v"))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY z) AS n FROM px WHERE v > 400), l AS (SELECT z, CASE WHEN any_value(n) > 20 THEN max(v) FILTER (r = round(n / 20.0)) ELSE max(v) END AS hi FROM c GROUP BY z), m AS (SELECT z, min(v) AS lo, max(v) AS top FROM px GROUP BY z) SELECT z, y, x, round(least(CAST(v - lo AS DOUBLE) / (coalesce(hi, top) - lo), 1.0), 6) AS v FROM px JOIN m USING (z) LEFT JOIN l USING (z)", "px")
def norm95_candidates(spark, sf_dir):
    p = A.px(spark, sf_dir)
    lit = _per_plane_top(p.where("v > 400"), 20).select("z", F.when(F.col("n") > 20, F.col("hi")).otherwise(F.col("top")).alias("hi"))
    whole = p.groupBy("z").agg(F.min("v").alias("lo"), F.max("v").alias("top"))
    joined = p.join(F.broadcast(whole.join(lit, "z", "left")), "z")
    return joined.select("z", "y", "x", r6(F.least((F.col("v") - F.col("lo")) / (F.coalesce("hi", "top") - F.col("lo")), F.lit(1.0)), "v"))


@query("SELECT z, y, x, CAST(CASE WHEN v * 120 > 63000 THEN v * 120 - 60465 ELSE v * 120 + 2535 END AS BIGINT) AS v FROM px", "px")
def mbif3_fix(spark, sf_dir):
    from .sources.mbif3 import fix_error

    return A.px(spark, sf_dir).select("z", "y", "x", fix_error(F.col("v") * 120).cast("long").alias("v"))


@query("SELECT z, y, x, CASE WHEN z <= 21 THEN 2 * z - 1 ELSE 2 * (42 - z) END AS slot FROM px", "px")
def z_interleave(spark, sf_dir):
    slot = F.when(F.col("z") <= 21, F.col("z") * 2 - 1).otherwise((F.lit(42) - F.col("z")) * 2)
    return A.px(spark, sf_dir).select("z", "y", "x", slot.alias("slot"))


@query("WITH m AS (SELECT y, x, min(v) AS base FROM px GROUP BY ALL) SELECT z, y, x, round(least(greatest(CAST(v AS DOUBLE) / base - 1, 0) * 128, 255), 6) AS v FROM px JOIN m USING (y, x)", "px")
def ratio_render(spark, sf_dir):
    p = A.px(spark, sf_dir)
    base = p.groupBy("y", "x").agg(F.min("v").alias("base"))
    ratio = F.greatest(F.try_divide(F.col("v").cast("double"), F.col("base")) - 1, F.lit(0.0)) * 128
    return p.join(base, ["y", "x"]).select("z", "y", "x", r6(F.least(ratio, F.lit(255.0)), "v"))


@query("SELECT z, ind, y, x FROM px", "px")
def lin_index_roundtrip(spark, sf_dir):
    p = A.px(spark, sf_dir)
    y, x = to_yx(to_index(F.col("y"), F.col("x"), H), H)
    return p.select("z", "ind", y.alias("y"), x.alias("x"))


@query("SELECT z, r AS radius, dy, dx, count(*) AS pixels FROM px, (VALUES (3), (4), (7), (10)) t(r), range(-10, 11) a(dy), range(-10, 11) b(dx) WHERE dy * dy + dx * dx <= r * r AND y + dy BETWEEN 1 AND 100 AND x + dx BETWEEN 1 AND 64 GROUP BY ALL", "px")
def disk_offsets(spark, sf_dir):
    """For each plane the offsets of the disks, and how many of its pixels have a neighbour there."""
    return stencil.offset_counts(A.px(spark, sf_dir), [3, 4, 7, 10], H, W)


@query("SELECT least(199, CAST(floor((v - lo) * 200.0 / (hi - lo)) AS BIGINT)) AS bin, count(*) AS n FROM px, (SELECT min(v) AS lo, max(v) AS hi FROM px) GROUP BY 1", "px")
def histogram200(spark, sf_dir):
    p = A.px(spark, sf_dir)
    ends = p.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.least(F.lit(199), F.floor((F.col("v") - F.col("lo")) * 200.0 / (F.col("hi") - F.col("lo"))))
    return p.crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


# Block and slice means


@query("SELECT z, (t - 1) // 2 + 1 AS tp, y, x, round(avg(v), 6) AS v FROM stk WHERE t <= (SELECT max(t) // 2 * 2 FROM stk) GROUP BY ALL", "stk")
def block_mean(spark, sf_dir):
    return motion.block_means(A.stk(spark, sf_dir), 2).select("z", "tp", "y", "x", r6("v", "v"))


@query("SELECT z, y, x, round(avg(v), 6) AS v FROM stk WHERE t IN (1, 3, 4) GROUP BY ALL", "stk")
def slice_mean(spark, sf_dir):
    return A.stk(spark, sf_dir).where(F.col("t").isin(1, 3, 4)).groupBy("z", "y", "x").agg(r6(F.avg("v"), "v"))


@query("SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL")
def mean_z_large(spark, sf_dir):
    return A.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


# Stencils


@query("SELECT z, (y - 1) // 32 AS gy, (x - 1) // 32 AS gx, min(v) AS m FROM px WHERE y <= 96 GROUP BY ALL", "px")
def grid_min(spark, sf_dir):
    return stencil.grid_minima(A.px(spark, sf_dir), height=H).select("z", "gy", "gx", "m")


CONTRAST = "g AS (SELECT z, (y - 1) // 32 AS gy, (x - 1) // 32 AS gx, (x - 1) // 32 * 3 + (y - 1) // 32 AS g, min(v) AS m FROM px WHERE y <= 96 GROUP BY ALL), o AS (SELECT a.z, a.gy, a.gx, avg(b.m) AS m FROM g a, (SELECT dy, dx FROM range(-1, 2) p(dy), range(-1, 2) q(dx)) d, g b WHERE b.z = a.z AND b.g = a.g + d.dx * 3 + d.dy GROUP BY ALL)"


@query(f"WITH {CONTRAST} SELECT p.z, y, x, round(m, 6) AS m FROM px p JOIN o ON o.z = p.z AND gy = (y - 1) // 32 AND gx = (x - 1) // 32 WHERE v - m > 5", "px")
def local_contrast(spark, sf_dir):
    return stencil.local_contrast(A.px(spark, sf_dir), height=H).select("z", "y", "x", r6("m", "m"))


def neighbours_sql(r: int, source: str = "px") -> str:
    """Each pixel with its in-image disk neighbours; the centre-offset product is materialised first."""
    return f"d AS (SELECT dy, dx FROM range(-{r}, {r + 1}) a(dy), range(-{r}, {r + 1}) b(dx) WHERE dy * dy + dx * dx <= {r * r}), c AS MATERIALIZED (SELECT z, y, x, v, y + dy AS ny, x + dx AS nx FROM {source}, d), n AS (SELECT c.z, c.y, c.x, c.v, p.v AS nv FROM c JOIN {source} p ON p.z = c.z AND p.y = c.ny AND p.x = c.nx)"


def _plane(name, make, kind="bigint"):
    return lambda spark, sf_dir: stencil.kernel(A.px(spark, sf_dir), lambda image, there: {name: make(image, there)}, {name: kind}, size=(H, W)).select("z", "y", "x", name)


@query(f"WITH {neighbours_sql(3)} SELECT z, y, x, min(nv) AS v FROM n GROUP BY ALL", "px")
def erode_r3(spark, sf_dir):
    return _plane("v", lambda i, there: stencil.erode(i, 3, there))(spark, sf_dir)


@query(f"WITH {neighbours_sql(3)} SELECT z, y, x, max(nv) AS v FROM n GROUP BY ALL", "px")
def dilate_r3(spark, sf_dir):
    return _plane("v", lambda i, there: stencil.dilate(i, 3, there))(spark, sf_dir)


@query(f"WITH {neighbours_sql(7)} SELECT z, y, x, max(nv) AS v FROM n GROUP BY ALL", "px")
def dilate_r7(spark, sf_dir):
    return _plane("v", lambda i, there: stencil.dilate(i, 7, there))(spark, sf_dir)


@query(f"WITH {neighbours_sql(3)} SELECT z, y, x, max(nv) AS v FROM n GROUP BY ALL", "px")
def dilate_r3_joined(spark, sf_dir):
    return stencil.offset_join(A.px(spark, sf_dir), 3, H, W).groupBy("z", "y", "x").agg(F.max("nv").alias("v"))


@query(f"WITH {neighbours_sql(3)}, e AS MATERIALIZED (SELECT z, y, x, min(nv) AS v FROM n GROUP BY ALL), c2 AS MATERIALIZED (SELECT z, y, x, y + dy AS ny, x + dx AS nx FROM e, d) SELECT c2.z, c2.y, c2.x, max(e.v) AS v FROM c2 JOIN e ON e.z = c2.z AND e.y = c2.ny AND e.x = c2.nx GROUP BY ALL", "px")
def opening_r3(spark, sf_dir):
    return _plane("v", lambda i, there: stencil.opening(i, 3, there))(spark, sf_dir)


@query(f"WITH {neighbours_sql(10)} SELECT z, y, x, count(*) AS n FROM n GROUP BY ALL", "px")
def maskones_r10(spark, sf_dir):
    return _plane("n", lambda i, there: stencil.inside_count(i.shape, 10, there))(spark, sf_dir)


RANK = neighbours_sql(10) + ", k AS MATERIALIZED (SELECT z, y, x, (x - 1) * 100 + y AS ind, CASE WHEN v > 250 THEN CAST(sum(CASE WHEN v >= nv THEN 1 ELSE 0 END) AS DOUBLE) / count(*) ELSE 0 END AS rank, v > 250 AS cand FROM n GROUP BY z, y, x, v)"


@query(f"WITH {RANK} SELECT z, y, x, round(rank, 6) AS rank FROM k", "px")
def local_rank_r10(spark, sf_dir):
    return stencil.kernel(A.px(spark, sf_dir), lambda i, there: {"rank": stencil.local_rank(i, i > 250, 10, there)}, {"rank": "double"}, size=(H, W)).select("z", "y", "x", r6("rank", "rank"))


AVERAGE = RANK + ", d4 AS (SELECT dy, dx FROM d WHERE dy * dy + dx * dx <= 16), c4 AS MATERIALIZED (SELECT z, y, x, ind, (ind - 1 + dx * 100 + dy + 6400) % 6400 + 1 AS ni FROM k, d4 WHERE cand), av AS MATERIALIZED (SELECT c4.z, c4.y, c4.x, c4.ind, CAST(sum(k.rank) / 49 AS FLOAT) AS av FROM c4 JOIN k ON k.z = c4.z AND k.ind = c4.ni GROUP BY ALL)"


def _ranked(i, there):
    rank = stencil.local_rank(i, i > 250, 10, there)
    return stencil.local_average(rank, i > 250, 4)


@query(f"WITH {AVERAGE} SELECT z, y, x, round(CAST(av AS DOUBLE), 5) AS average FROM av", "px")
def local_average_r4(spark, sf_dir):
    out = stencil.kernel(A.px(spark, sf_dir), lambda i, there: {"average": _ranked(i, there).astype(float), "cand": i > 250}, {"average": "double"}, keep=lambda m: m["cand"], size=(H, W))
    return out.select("z", "y", "x", F.round("average", 5).alias("average"))


@query(f"WITH {neighbours_sql(10)}, d7 AS (SELECT dy, dx FROM d WHERE dy * dy + dx * dx <= 49), p AS MATERIALIZED (SELECT z, y, x, ind, CASE WHEN v > 250 THEN v ELSE 0 END AS v FROM px), c7 AS MATERIALIZED (SELECT z, y, x, ind, v, (ind - 1 + dx * 100 + dy + 6400) % 6400 + 1 AS ni FROM p, d7 WHERE v > 0) SELECT c7.z, c7.y, c7.x FROM c7 JOIN p ON p.z = c7.z AND p.ind = c7.ni GROUP BY c7.z, c7.y, c7.x, c7.v HAVING max(p.v) <= c7.v", "px")
def local_max_r7(spark, sf_dir):
    def make(i, there):
        own = (i > 250) * i.astype(float)
        return {"top": stencil.local_max(own, i > 250, 7)}

    return stencil.kernel(A.px(spark, sf_dir), make, {"top": "boolean"}, keep=lambda m: m["top"], size=(H, W)).select("z", "y", "x")


@query("WITH d AS (SELECT dy, dx FROM range(-4, 5) a(dy), range(-4, 5) b(dx) WHERE dy * dy + dx * dx <= 16) SELECT DISTINCT z, ind + dx * 100 + dy AS ind FROM px, d WHERE v > 450 AND ind + dx * 100 + dy BETWEEN 1 AND 6400", "px")
def stamp_round1(spark, sf_dir):
    return stencil.kernel(A.px(spark, sf_dir), lambda i, there: {"on": stencil.stamp(i > 450, 4)}, {"on": "boolean"}, keep=lambda m: m["on"], size=(H, W)).select("z", "ind")


def _stage(name):
    def run(spark, sf_dir):
        keep = lambda m: m[name] > 0
        return stencil.kernel(A.px(spark, sf_dir), lambda i, there: segment.segment_plane(i, SEGMENT, there), {}, keep=keep, size=(H, W)).select("z", "y", "x")

    return run


def disk_sql(r: int) -> str:
    return f"(SELECT dy, dx FROM range(-{r}, {r + 1}) p(dy), range(-{r}, {r + 1}) q(dx) WHERE dy * dy + dx * dx <= {r * r})"


def around_sql(name: str, source: str, r: int, agg: str) -> str:
    """An aggregate of v over the in-image disk around each pixel of a source (z, y, x, v)."""
    return f"{name} AS MATERIALIZED (SELECT a.z, a.y, a.x, {agg}(b.v) AS v FROM (SELECT z, y, x, y + dy AS ny, x + dx AS nx FROM {source}, {disk_sql(r)}) a JOIN {source} b ON b.z = a.z AND b.y = a.ny AND b.x = a.nx GROUP BY ALL)"


def opened_sql(name: str, source: str) -> str:
    return around_sql(f"{name}_e", source, 3, "min") + ", " + around_sql(name, f"{name}_e", 3, "max")


def seeds_sql(n: int, candidates: str, reach: int) -> str:
    """Rank, its average by wrapping indices in single precision, and the local maxima above 0.4; then the stamped mask."""
    near = lambda source, r: f"(SELECT *, (ind - 1 + dx * 100 + dy + 6400) % 6400 + 1 AS ni FROM {source}, {disk_sql(r)})"
    return f"""rank{n} AS MATERIALIZED (SELECT a.z, a.y, a.x, a.ind, CAST(sum(CASE WHEN a.v >= b.v THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rank
      FROM (SELECT *, y + dy AS ny, x + dx AS nx FROM {candidates}, {disk_sql(10)}) a JOIN px b ON b.z = a.z AND b.y = a.ny AND b.x = a.nx GROUP BY a.z, a.y, a.x, a.ind),
    mean{n} AS MATERIALIZED (SELECT a.z, a.y, a.x, a.ind, CAST(sum(b.rank) / 49 AS FLOAT) AS av FROM {near(f"rank{n}", 4)} a JOIN rank{n} b ON b.z = a.z AND b.ind = a.ni GROUP BY a.z, a.y, a.x, a.ind),
    seed{n} AS MATERIALIZED (SELECT a.z, a.y, a.x, a.ind FROM {near(f"mean{n}", reach)} a JOIN mean{n} b ON b.z = a.z AND b.ind = a.ni GROUP BY a.z, a.y, a.x, a.ind, a.av HAVING max(b.av) <= a.av AND a.av > CAST(0.4 AS FLOAT)),
    mask{n} AS MATERIALIZED (SELECT DISTINCT z, ind + dx * 100 + dy AS ind FROM seed{n}, {disk_sql(4)} WHERE ind + dx * 100 + dy BETWEEN 1 AND 6400)"""


SEGMENTED = f"""{CONTRAST}, raised AS MATERIALIZED (SELECT p.z, p.y, p.x, CASE WHEN v - m > 5 THEN 1 ELSE 0 END AS v FROM px p LEFT JOIN o ON o.z = p.z AND gy = (p.y - 1) // 32 AND gx = (p.x - 1) // 32),
    {opened_sql("clean", "raised")}, cand AS MATERIALIZED (SELECT px.z, px.y, px.x, px.ind, px.v FROM px JOIN clean ON clean.z = px.z AND clean.y = px.y AND clean.x = px.x WHERE clean.v > 0 AND px.v > 250),
    {seeds_sql(1, "cand", 7)}, painted AS MATERIALIZED (SELECT px.z, y, x, CASE WHEN mask1.ind IS NULL THEN 0 ELSE 1 END AS v FROM px LEFT JOIN mask1 ON mask1.z = px.z AND mask1.ind = px.ind),
    {around_sql("wide", "painted", 7, "max")}, outside AS MATERIALIZED (SELECT z, y, x, 1 - v AS v FROM wide), {opened_sql("free", "outside")},
    remaining AS MATERIALIZED (SELECT cand.* FROM cand JOIN free ON free.z = cand.z AND free.y = cand.y AND free.x = cand.x WHERE free.v > 0), {seeds_sql(2, "remaining", 4)}"""


@query(f"WITH {SEGMENTED} SELECT z, y, x FROM seed1", "px")
def seeds_round1(spark, sf_dir):
    return _stage("seed1")(spark, sf_dir)


@query(f"WITH {SEGMENTED} SELECT z, y, x FROM remaining", "px")
def exclusion_mask(spark, sf_dir):
    return _stage("remaining")(spark, sf_dir)


@query(f"WITH {SEGMENTED} SELECT z, y, x FROM seed2", "px")
def seeds_round2(spark, sf_dir):
    return _stage("seed2")(spark, sf_dir)


# Components of a fixed brightness mask, by least-index propagation in the twin.
MASK = "v > 420"
LABELS = "nb AS MATERIALIZED (SELECT a.z, a.ind AS a, b.ind AS b FROM m a JOIN m b ON a.z = b.z AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1), reach AS (SELECT z, ind, ind AS root FROM m UNION SELECT nb.z, nb.b, reach.root FROM reach JOIN nb ON nb.z = reach.z AND nb.a = reach.ind), lab AS (SELECT z, ind, dense_rank() OVER (PARTITION BY z ORDER BY min(root)) AS label FROM reach GROUP BY z, ind)"
COMPONENTS = f"m AS MATERIALIZED (SELECT z, y, x, ind FROM px WHERE {MASK}), {LABELS}"


def _labelled(spark, sf_dir):
    return segment.components(A.px(spark, sf_dir).where(MASK), H, W)


@query(f"WITH {COMPONENTS} SELECT z, ind, label FROM lab", "px")
def components8(spark, sf_dir):
    return _labelled(spark, sf_dir).select("z", "ind", "label")


@query(f"WITH {COMPONENTS} SELECT z, label, CAST(round(avg(y)) AS BIGINT) AS cy, CAST(round(avg(x)) AS BIGINT) AS cx, count(*) AS area, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM lab JOIN px USING (z, ind) GROUP BY z, label", "px")
def region_props(spark, sf_dir):
    return segment.region_properties(_labelled(spark, sf_dir)).select("z", "label", "cy", "cx", "area", "y_min", "y_max", "x_min", "x_max")


@query(f"WITH {COMPONENTS} SELECT z, max(label) AS cells FROM lab GROUP BY z", "px")
def cells_per_plane(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("z").agg(F.max("label").alias("cells"))


PALETTE = f"pal(colour, red, green, blue) AS (VALUES {', '.join(str((k, *c)) for k, c in enumerate(segment.COLOURS))})"


@query(f"WITH {COMPONENTS}, {PALETTE} SELECT z, ind, label % 10 AS colour, red, green, blue FROM lab JOIN pal ON colour = label % 10", "px")
def palette_label(spark, sf_dir):
    return segment.palette(_labelled(spark, sf_dir)).select("z", to_index(F.col("y"), F.col("x"), H).alias("ind"), (F.col("label") % 10).alias("colour"), *(F.col(c).cast("int").alias(c) for c in ("red", "green", "blue")))


@query(
    f"""WITH {SEGMENTED}, m AS MATERIALIZED (SELECT px.z, px.y, px.x, px.ind FROM px JOIN (SELECT * FROM mask1 UNION SELECT * FROM mask2) u ON u.z = px.z AND u.ind = px.ind), {LABELS},
    c AS (SELECT z, label, CAST(round(avg(y)) AS BIGINT) AS cy, CAST(round(avg(x)) AS BIGINT) AS cx, count(*) AS area, list(ind ORDER BY ind) AS inds, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM lab JOIN px USING (z, ind) GROUP BY z, label)
    SELECT row_number() OVER (ORDER BY z, label) AS cell_id, z, cy, cx, area, list_aggregate(inds, 'string_agg', ' ') AS inds, y_min, y_max, x_min, x_max FROM c""",
    "px",
)
def segment_cells(spark, sf_dir):
    cells = segment.region_properties(segment.labels(A.px(spark, sf_dir), SEGMENT, (H, W)))
    return cells.select(F.col("cell_id").cast("long").alias("cell_id"), "z", "cy", "cx", "area", F.array_join(F.col("inds").cast("array<string>"), " ").alias("inds"), "y_min", "y_max", "x_min", "x_max")


# Stacks as files: planes are written as raw stacks below the shared folder and read again by their offsets


#: Stored for 0: values of ``stk`` may be negative, and its frames may lack pixels, for which a stack file has 0.
BASE = 1 << 15


def _stack_files(spark, sf_dir) -> str:
    path = f"{store.shared_dir(spark)}/stacks-{uuid.uuid4().hex}"
    planestack.write(planestack.blocks_of(motion.images_of(A.stk(spark, sf_dir), H, W), BASE), path)
    return path


@query("SELECT z, y, x, round(avg(v), 6) AS mean FROM stk GROUP BY ALL", "stk")
def mean_stack(spark, sf_dir):
    """Mean image of a stack of any length, from partial sums of its blocks."""
    means = motion.mean_images(planestack.read(spark, _stack_files(spark, sf_dir), H, W, block=3), BASE)
    return motion.pixels_of(means.withColumn("t", F.lit(0).cast("long"))).select("z", "y", "x", r6("v", "mean"))


# Joins


#: Synthetic cells: a lattice of centres on every plane, for the join operators.
CELLS = "cells AS (SELECT z * 1000 + row_number() OVER (PARTITION BY z ORDER BY ind) AS cell_id, z, y AS cy, x AS cx FROM px WHERE (y + 3 * z) % 11 = 0 AND (x + z) % 7 = 0)"


def _cells(spark, sf_dir):
    from pyspark.sql import Window

    p = A.px(spark, sf_dir).where("(y + 3 * z) % 11 = 0 AND (x + z) % 7 = 0")
    return p.select((F.col("z") * 1000 + F.row_number().over(Window.partitionBy("z").orderBy("ind"))).cast("long").alias("cell_id"), "z", F.col("y").alias("cy"), F.col("x").alias("cx"))


STAMPS = CELLS + ", st AS (SELECT z, ind, max(cell_id) AS cell_id FROM (SELECT cell_id, z, (cx - 1) * 100 + cy + dx * 100 + dy AS ind FROM cells, range(-2, 3) a(dy), range(-2, 3) b(dx)) WHERE ind > 0 AND ind < 6400 GROUP BY z, ind)"


@query(f"WITH {STAMPS} SELECT z, ind, cell_id FROM st", "px")
def stamp_5x5(spark, sf_dir):
    return extract.stamps(_cells(spark, sf_dir), H, W)


@query(f"WITH {STAMPS} SELECT DISTINCT a.cell_id AS a, b.cell_id AS b FROM st a JOIN st b ON b.z = a.z + 1 AND b.ind = a.ind", "px")
def adjacent_overlap(spark, sf_dir):
    return extract.overlaps(_cells(spark, sf_dir), H, W)


@query(f"WITH {STAMPS} SELECT cell_id, t, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 3) AS f FROM (SELECT cell_id, ind FROM st WHERE z = 1) JOIN stk USING (ind) GROUP BY ALL", "px", "stk")
def roi_mean_trace(spark, sf_dir):
    pixels = extract.stamps(_cells(spark, sf_dir), H, W).where("z = 1")
    return extract.roi_means(A.stk(spark, sf_dir), pixels).select("cell_id", "t", F.round(F.col("f").cast("double"), 3).alias("f"))


@query(f"WITH {CELLS}, sp AS (SELECT cell_id, (cx - 1) * 100 + cy + dx * 100 + dy AS ind FROM cells, range(-2, 3) a(dy), range(-2, 3) b(dx)) SELECT cell_id, t, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 3) AS f FROM sp JOIN stk USING (ind) WHERE ind > 0 AND ind < 6400 GROUP BY ALL", "px", "stk")
def stack_cells(spark, sf_dir):
    """Traces of the cells of all planes over the stack's frames, by seeks to their pixels in its file."""
    stamps = extract.stamp_inds(_cells(spark, sf_dir), H, W).where("size(inds) > 0").withColumn("z", F.lit(1))
    cells = planestack.by_plane(stamps, f"{store.shared_dir(spark)}/cells-{uuid.uuid4().hex}")
    found = planestack.read_cells(spark, _stack_files(spark, sf_dir), H, W, cells, block=3, base=BASE)
    return found.select("cell_id", "t", F.round(F.col("f").cast("double"), 3).alias("f"))


def _cell_points(spark, sf_dir):
    """Traces of the lattice cells: the brightness around each centre, along columns."""
    cells = _cells(spark, sf_dir).select("cell_id", "z", "cy")
    return A.px(spark, sf_dir).select("z", F.col("y").alias("cy"), F.col("x").alias("t"), F.col("v").cast("double").alias("f")).join(cells, ["z", "cy"]).select("cell_id", "t", "f")


PAIRS = f"{STAMPS}, ov AS (SELECT DISTINCT a.cell_id AS a, b.cell_id AS b FROM st a JOIN st b ON b.z = a.z + 1 AND b.ind = a.ind), cp AS (SELECT cell_id, x AS t, v AS f FROM px JOIN cells ON cells.z = px.z AND cells.cy = px.y)"


@query(f"WITH {PAIRS} SELECT a, b, round(corr(x.f, y.f), 6) AS r FROM ov JOIN cp x ON x.cell_id = a JOIN cp y ON y.cell_id = b AND y.t = x.t GROUP BY a, b", "px")
def dedup_pairs(spark, sf_dir):
    pairs = extract.overlaps(_cells(spark, sf_dir), H, W)
    return traces.pair_correlation(pairs, _cell_points(spark, sf_dir)).select("a", "b", r6("r", "r"))


def labels_sql(rounds: int) -> str:
    """Least pixel of each 8-connected region of o, by rounds of: least label around, then that label's label."""
    steps = [f"l{k} AS MATERIALIZED (SELECT n.i AS ind, min(l.l) AS l FROM n JOIN j{k - 1} l ON l.ind = n.j GROUP BY n.i), j{k} AS MATERIALIZED (SELECT a.ind, b.l FROM l{k} a JOIN l{k} b ON b.ind = a.l)" for k in range(1, rounds + 1)]
    return "j0 AS (SELECT ind, ind AS l FROM o), " + ", ".join(steps)


#: Planes one after another: regions that living stamps of z and z + 1 share, their largest cells, and who goes.
FOLDED = f"""{CELLS}, sp AS MATERIALIZED (SELECT cell_id, z, ind FROM (SELECT cell_id, z, (cx - 1) * 100 + cy + dx * 100 + dy AS ind FROM cells, range(-2, 3) a(dy), range(-2, 3) b(dx)) WHERE ind > 0 AND ind < 6400),
    cp AS MATERIALIZED (SELECT cell_id, cells.z, x AS t, v AS f FROM px JOIN cells ON cells.z = px.z AND cells.cy = px.y),
    hp AS MATERIALIZED (SELECT x.cell_id AS a, y.cell_id AS b FROM cp x JOIN cp y ON y.z = x.z + 1 AND y.t = x.t GROUP BY ALL HAVING corr(x.f, y.f) > 0.15 AND NOT isnan(corr(x.f, y.f))),
    fold(z, gone) AS (SELECT min(z), CAST([] AS BIGINT[]) FROM cells UNION ALL (WITH
      up AS (SELECT ind, max(cell_id) AS above FROM sp JOIN fold ON sp.z = fold.z AND NOT list_contains(gone, cell_id) GROUP BY ind),
      down AS (SELECT ind, max(cell_id) AS below FROM sp JOIN fold ON sp.z = fold.z + 1 AND NOT list_contains(gone, cell_id) GROUP BY ind),
      o AS MATERIALIZED (SELECT ind, above, below FROM up JOIN down USING (ind)),
      n AS MATERIALIZED (SELECT p.ind AS i, q.ind AS j FROM o p, range(-1, 2) a(dy), range(-1, 2) b(dx), o q WHERE q.ind = p.ind + dx * 100 + dy AND (p.ind - 1) % 100 + dy BETWEEN 0 AND 99),
      {labels_sql(8)}, c AS (SELECT max(above) AS above, max(below) AS below FROM o JOIN j8 USING (ind) GROUP BY l),
      r AS (SELECT list(DISTINCT below) AS more FROM c JOIN hp ON hp.a = above AND hp.b = below)
      SELECT fold.z + 1, list_concat(gone, coalesce((SELECT more FROM r), [])) FROM fold WHERE fold.z < (SELECT max(z) FROM cells)))"""


@query(f"WITH {FOLDED} SELECT unnest(gone) AS cell_id FROM fold QUALIFY row_number() OVER (ORDER BY fold.z DESC) = 1", "px")
def dedup_greedy(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    pairs = extract.duplicate_pairs(cells, _cell_points(spark, sf_dir), H, W)
    return extract.greedy_duplicates(cells, pairs, H, W, 0.15)


GRID = "gp AS (SELECT (gx - 1) * 15 + gy AS grid_idx, gy, gx, (11 + (gx - 1) * 5) * 100 + 11 + (gy - 1) * 5 + 1 AS ind FROM range(1, 16) a(gy), range(1, 9) b(gx))"
RADIUS = 5


@query(f"WITH {GRID} SELECT z, grid_idx, gy, gx, ind, v FROM gp JOIN px USING (ind)", "px")
def grid_points(spark, sf_dir):
    """The grid's points on every plane, with the pixels they stand on."""
    return motion.grid(spark, H, W, RADIUS).join(A.px(spark, sf_dir).select("z", "ind", "v"), "ind").select("z", "grid_idx", "gy", "gx", "ind", "v")


PATCH = f"{GRID}, pc AS MATERIALIZED (SELECT grid_idx, ind AS start, ind + (c - 1) * 100 + r AS ind FROM gp, range(-5, 6) a(c), range(-5, 6) b(r)), pm AS (SELECT z, grid_idx, start AS ind, avg(v) AS m FROM pc JOIN px USING (ind) GROUP BY ALL)"


@query(f"WITH {PATCH} SELECT z, grid_idx, ind, round(m, 6) AS m FROM pm WHERE m > 290", "px")
def patch_mean(spark, sf_dir):
    means = motion.patch_means(A.px(spark, sf_dir), motion.grid(spark, H, W, RADIUS), H, RADIUS)
    return means.where(exceeds(F.col("m"), 290)).select("z", "grid_idx", "ind", r6("m", "m"))


@query(f"WITH {PATCH}, b AS (SELECT * FROM pm WHERE m > 290) SELECT a.z, a.grid_idx AS g, round(median(c.m), 6) AS med FROM b a, range(-1, 2) p(dy), range(-1, 2) q(dx), b c WHERE c.z = a.z AND c.grid_idx = a.grid_idx + dx * 15 + dy GROUP BY ALL", "px")
def median3x3(spark, sf_dir):
    means = motion.patch_means(A.px(spark, sf_dir), motion.grid(spark, H, W, RADIUS), H, RADIUS).where("m > 290")
    return stencil.median3x3(means.select("z", F.col("grid_idx").alias("g"), F.col("m").alias("v")), 15).select("z", "g", r6("med", "med"))


#: Grid points with tilts that follow from their place, for the join and summary operators.
POINTS = f"{GRID}, pt AS (SELECT z, grid_idx, (ind - 1) % 100 + 1 AS py, (ind - 1) // 100 + 1 AS px_, ((grid_idx * 7 + z) % 11 - 5) / 4.0 AS med_y, ((grid_idx * 3 + z) % 7 - 3) / 4.0 AS med_x, ((grid_idx + z) % 5 - 2) / 2.0 AS med_z FROM gp, (SELECT DISTINCT z FROM px))"


def _points(spark, sf_dir):
    planes = A.table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / H) + 1).cast("long").alias("z")).distinct()
    g = motion.grid(spark, H, W, RADIUS)
    tilt = lambda a, m, d: ((F.pmod(F.col("grid_idx") * a + F.col("z"), F.lit(m)) - m // 2) / float(d))
    return planes.crossJoin(F.broadcast(g)).select("z", "grid_idx", (F.pmod(F.col("ind") - 1, F.lit(H)) + 1).alias("py"), (F.floor((F.col("ind") - 1) / H) + 1).alias("px"), tilt(7, 11, 4).alias("med_y"), tilt(3, 7, 4).alias("med_x"), tilt(1, 5, 2).alias("med_z"))


KNN = f"{CELLS}, {POINTS}, nn AS (SELECT cell_id, grid_idx, med_y, med_x, med_z, row_number() OVER (PARTITION BY cell_id ORDER BY (cy - py) * (cy - py) + (cx - px_) * (cx - px_), grid_idx) AS k FROM cells JOIN pt USING (z))"


@query(f"WITH {KNN} SELECT cell_id, grid_idx, k FROM nn WHERE k <= 5", "px")
def knn5(spark, sf_dir):
    return motion.nearest(_cells(spark, sf_dir), _points(spark, sf_dir)).select("cell_id", "grid_idx", F.col("k").cast("long").alias("k"))


@query(f"WITH {KNN}, mm AS (SELECT cell_id, avg(med_y) AS y, avg(med_x) AS x, avg(med_z) AS z FROM nn WHERE k <= 5 GROUP BY ALL) SELECT cell_id FROM mm WHERE NOT (abs(y) > 0.6 OR abs(x) > 0.6 OR abs(z) > 0.6)", "px")
def motion_filter(spark, sf_dir):
    return motion.motion_filter(_cells(spark, sf_dir), _points(spark, sf_dir), 0.6).select("cell_id")


@query(f"WITH {POINTS} SELECT z, round(avg(sqrt(med_y * med_y + med_x * med_x) * 0.406), 6) AS xymove_av, round(stddev_samp(sqrt(med_y * med_y + med_x * med_x) * 0.406), 6) AS xymove_sd, round(avg(abs(med_z) * 5), 6) AS zmove_av, round(stddev_samp(abs(med_z) * 5), 6) AS zmove_sd FROM pt GROUP BY z", "px")
def motion_summary(spark, sf_dir):
    return motion.summary(_points(spark, sf_dir), 0.406, 5.0).select("z", *(r6(c, c) for c in ("xymove_av", "xymove_sd", "zmove_av", "zmove_sd")))


@query(f"WITH {POINTS} SELECT z, CAST(round(med_z) AS BIGINT) AS bin, count(*) AS n FROM pt GROUP BY ALL", "px")
def motion_z_histogram(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("z", F.round("med_z").cast("long").alias("bin")).agg(F.count("*").alias("n"))


#: Every shift of every frame against the first one, by all pairs of pixels.
REGISTER = "p AS (SELECT b.t, (a.y - b.y + 100) % 100 AS sy, (a.x - b.x + 64) % 64 AS sx, sum(a.v * b.v) AS c FROM stk a, stk b WHERE a.t = 1 GROUP BY ALL), best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY t ORDER BY c DESC, sx, sy) = 1)"


@query(f"WITH {REGISTER} SELECT CAST(1 AS BIGINT) AS z, t, CASE WHEN sy >= 50 THEN sy - 100 ELSE sy END AS dy, CASE WHEN sx >= 32 THEN sx - 64 ELSE sx END AS dx FROM best", "stk")
def stack_register(spark, sf_dir):
    return motion.register_images(motion.images_of(A.stk(spark, sf_dir), H, W), 1)


@query(f"""WITH {REGISTER}, s AS (SELECT t, CASE WHEN sy >= 50 THEN sy - 100 ELSE sy END AS dy, CASE WHEN sx >= 32 THEN sx - 64 ELSE sx END AS dx FROM best),
    m AS (SELECT stk.t, y + dy AS y, x + dx AS x, v FROM stk JOIN s ON s.t = stk.t WHERE dy <> 0 AND dx <> 0)
    SELECT stk.z, stk.t, stk.y, stk.x, coalesce(m.v, stk.v) AS v FROM stk LEFT JOIN m ON m.t = stk.t AND m.y = stk.y AND m.x = stk.x""", "stk")
def stacks_registered(spark, sf_dir):
    """Every frame moved onto the first one."""
    moved = motion.register_images(motion.images_of(A.stk(spark, sf_dir), H, W), 1, move=True)
    return motion.pixels_of(moved).withColumn("v", F.col("v").cast("long"))


#: Patches of all grid points in all frames, all their circular shifts, then the correlations with the planes around.
XCORR = f"""{GRID}, pc AS MATERIALIZED (SELECT grid_idx, g.ind, c, r, g.ind + (c - 1) * 100 + r AS pixel FROM gp g, range(-5, 6) a(c), range(-5, 6) b(r)),
    pt AS MATERIALIZED (SELECT grid_idx, pc.ind, t AS tp, c, r, pixel, v FROM pc JOIN stk ON stk.ind = pixel),
    sh AS (SELECT b.grid_idx, b.ind, b.tp, (a.r - b.r + 16) % 11 - 5 AS sy, (a.c - b.c + 16) % 11 - 5 AS sx, sum(a.v * b.v) AS p FROM pt a JOIN pt b ON a.grid_idx = b.grid_idx WHERE a.tp = 1 GROUP BY ALL),
    dd AS MATERIALIZED (SELECT grid_idx, ind, tp, CASE WHEN sy = 5 THEN 6 ELSE -sy END AS dy, -sx AS dx FROM sh QUALIFY row_number() OVER (PARTITION BY grid_idx, tp ORDER BY p DESC, sx, sy) = 1),
    dr AS (SELECT pt.grid_idx, pt.tp, q.z - 1 AS s, corr(pt.v, q.v) AS r FROM pt JOIN dd ON dd.grid_idx = pt.grid_idx AND dd.tp = pt.tp JOIN px q ON q.z <= 3 AND q.ind = pt.pixel - dx * 100 - dy GROUP BY ALL HAVING count(*) = 121),
    dz AS (SELECT grid_idx, tp, s FROM dr WHERE NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY grid_idx, tp ORDER BY r DESC, s) = 1),
    xc AS MATERIALIZED (SELECT CAST(1 AS BIGINT) AS z, dd.grid_idx, dd.ind, dd.tp, CAST(dy AS DOUBLE) AS dy, CAST(dx AS DOUBLE) AS dx, CAST(coalesce(s, 0) AS DOUBLE) AS dz FROM dd LEFT JOIN dz ON dz.grid_idx = dd.grid_idx AND dz.tp = dd.tp)"""


@query(f"WITH {XCORR} SELECT * FROM xc", "px", "stk")
def xcorr_shift(spark, sf_dir):
    """Frames of stk against its first one; the planes of px are the references of the search in z."""
    frames = A.stk(spark, sf_dir).select("z", F.col("t").alias("tp"), "y", "x", "v")
    points = motion.grid(spark, H, W, RADIUS).select(F.lit(1).cast("long").alias("z"), "grid_idx", "ind")
    return motion.displacements(frames, A.px(spark, sf_dir).select("z", "y", "x", "v"), points, H, W, RADIUS)


@query(f"WITH {XCORR} SELECT * FROM xc", "px", "stk")
def xcorr_shift_images(spark, sf_dir):
    """The same on images, as the motion stage runs it: references are read by the tasks, no image is shuffled."""
    images = motion.images_of(A.stk(spark, sf_dir).withColumnRenamed("t", "tp"), H, W, "tp")
    references = motion.images_of(A.px(spark, sf_dir).withColumn("t", F.lit(1)), H, W)
    points = motion.grid(spark, H, W, RADIUS).select(F.lit(1).cast("long").alias("z"), "grid_idx", "ind")
    return motion.displacements_of_images(images, references, points, RADIUS)


@query(f"WITH {XCORR} SELECT z, tp, (tp - 1) * 150 + 75 AS frame_center, round(avg(sqrt(dy * dy + dx * dx)), 6) AS xy_av, round(stddev_samp(sqrt(dy * dy + dx * dx)), 6) AS xy_sd, round(avg(dz), 6) AS z_av, round(stddev_samp(dz), 6) AS z_sd FROM xc GROUP BY ALL", "px", "stk")
def motion_timecourse(spark, sf_dir):
    out = motion.timecourse(xcorr_shift(spark, sf_dir), 150)
    return out.select("z", "tp", F.col("frame_center").cast("long").alias("frame_center"), *(r6(c, c) for c in ("xy_av", "xy_sd", "z_av", "z_sd")))


@query(
    f"""WITH {XCORR}, tl AS (SELECT grid_idx, ind, regr_slope(dy, tp) * (max(tp) - 1) AS y, regr_slope(dx, tp) * (max(tp) - 1) AS x, regr_slope(dz, tp) * (max(tp) - 1) AS z FROM xc GROUP BY ALL),
    md AS (SELECT a.grid_idx, median(b.y) AS y, median(b.x) AS x, median(b.z) AS z FROM tl a, range(-1, 2) p(u), range(-1, 2) q(w), tl b WHERE b.grid_idx = a.grid_idx + u + w * 15 GROUP BY ALL)
    SELECT CAST(1 AS BIGINT) AS z, grid_idx, tl.ind, round(tl.y, 6) AS tilt_y, round(tl.x, 6) AS tilt_x, round(tl.z, 6) AS tilt_z, round(md.y, 6) AS med_y, round(md.x, 6) AS med_x, round(md.z, 6) AS med_z FROM tl JOIN md USING (grid_idx)""",
    "px",
    "stk",
)
def motion_points(spark, sf_dir):
    """Displacements, their tilts and the medians around, over all grid points."""
    found = motion.median_tilts(motion.tilts(xcorr_shift(spark, sf_dir)), 15)
    return found.select("z", "grid_idx", "ind", *(r6_half(c, c) for c in ("tilt_y", "tilt_x", "tilt_z", "med_y", "med_x", "med_z")))


TILTS = f"""{XCORR}, tl AS (SELECT grid_idx, regr_slope(dy, tp) * (max(tp) - 1) AS y, regr_slope(dx, tp) * (max(tp) - 1) AS x, regr_slope(dz, tp) * (max(tp) - 1) AS z FROM xc GROUP BY ALL),
    md AS MATERIALIZED (SELECT a.grid_idx, median(b.y) AS y, median(b.x) AS x, median(b.z) AS z FROM tl a, range(-1, 2) p(u), range(-1, 2) q(w), tl b WHERE b.grid_idx = a.grid_idx + u + w * 15 GROUP BY ALL)"""


def _median_tilts(spark, sf_dir):
    tilts = store.materialise(motion.tilts(xcorr_shift_images(spark, sf_dir)), "tilts")
    return motion.median_tilts(tilts, 15)


@query(f"WITH {TILTS} SELECT CAST(1 AS BIGINT) AS z, round(avg(sqrt(y * y + x * x) * 0.406), 6) AS xymove_av, round(stddev_samp(sqrt(y * y + x * x) * 0.406), 6) AS xymove_sd, round(avg(abs(z) * 5), 6) AS zmove_av, round(stddev_samp(abs(z) * 5), 6) AS zmove_sd FROM md", "px", "stk")
def motion_summary_found(spark, sf_dir):
    """The summary of the shifts that the stage finds."""
    return motion.summary(_median_tilts(spark, sf_dir), 0.406, 5.0).select("z", *(r6(c, c) for c in ("xymove_av", "xymove_sd", "zmove_av", "zmove_sd")))


@query(f"""WITH {CELLS}, {TILTS}, pg AS (SELECT grid_idx, (ind - 1) % 100 + 1 AS py, (ind - 1) // 100 + 1 AS px_, md.y, md.x, md.z FROM md JOIN gp USING (grid_idx)),
    nn AS (SELECT cell_id, y, x, z FROM (SELECT cell_id, cy, cx FROM cells WHERE z = 1) c, pg QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY (cy - py) * (cy - py) + (cx - px_) * (cx - px_), grid_idx) <= 5)
    SELECT cell_id, round(avg(y), 6) AS my, round(avg(x), 6) AS mx, round(avg(z), 6) AS mz FROM nn GROUP BY cell_id UNION ALL SELECT cell_id, NULL, NULL, NULL FROM cells WHERE z <> 1""", "px", "stk")
def cell_motion_found(spark, sf_dir):
    """Mean tilt of each cell's five nearest grid points, as found; null on planes without any."""
    ind = F.col("ind") - 1
    placed = _median_tilts(spark, sf_dir).select("z", "grid_idx", (F.pmod(ind, F.lit(H)) + 1).alias("py"), (F.floor(ind / H) + 1).alias("px"), "med_y", "med_x", "med_z")
    return motion.cell_motion(_cells(spark, sf_dir), placed).select("cell_id", *(r6_half(c, c) for c in ("my", "mx", "mz")))


@query("SELECT z, y, x FROM px WHERE v > 350 AND NOT (v % 3 = 0)", "px")
def setdiff_keep(spark, sf_dir):
    p = A.px(spark, sf_dir).where("v > 350")
    return p.select("z", "y", "x").join(p.where("v % 3 = 0").select("z", "y", "x").hint("merge"), ["z", "y", "x"], "left_anti")


@query("SELECT z, y, x, v FROM px WHERE v > 350 AND y <= 96", "px")
def candidate_semi(spark, sf_dir):
    p = A.px(spark, sf_dir)
    return p.select("z", "y", "x", "v").join(p.where("v > 350 AND y <= 96").select("z", "y", "x").hint("merge"), ["z", "y", "x"], "left_semi")


# Orchestration tables


#: A nation's customers as a dataset: what its three stages came to follows from their number, keys and names.
RAN = """ran AS (SELECT n_name AS directory, ['OK', 'FAIL', 'skipped'][CAST(count(*) % 3 AS INT) + 1] AS segmentation, ['OK', 'OK', 'FAIL', 'skipped'][CAST(sum(c_custkey) % 4 AS INT) + 1] AS motion, ['OK', 'FAIL'][CAST(sum(length(c_mktsegment)) % 2 AS INT) + 1] AS timecourse FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name),
    gated AS (SELECT directory, segmentation, CASE WHEN segmentation = 'FAIL' THEN 'SKIP' ELSE motion END AS motion, CASE WHEN segmentation = 'FAIL' OR motion = 'FAIL' THEN 'SKIP' ELSE timecourse END AS timecourse FROM ran)"""


@query(f"WITH {RAN} SELECT * FROM gated")
def batch_status(spark, sf_dir):
    named = A.table(spark, sf_dir, "customer").join(A.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    ran = named.groupBy(F.col("n_name").alias("directory")).agg(
        pick(["OK", "FAIL", "skipped"], F.count("*")).alias("segmentation"), pick(["OK", "OK", "FAIL", "skipped"], F.sum("c_custkey")).alias("motion"), pick(["OK", "FAIL"], F.sum(F.length("c_mktsegment"))).alias("timecourse")
    )
    return batch.gated(ran)


@query(f"WITH {RAN}, long AS (SELECT 'segmentation' AS stage, segmentation AS s FROM gated UNION ALL SELECT 'motion', motion FROM gated UNION ALL SELECT 'timecourse', timecourse FROM gated) SELECT stage, count(*) FILTER (s = 'OK') AS ok, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'FAIL') AS fail FROM long GROUP BY stage")
def status_counts(spark, sf_dir):
    return batch.status_counts(batch_status(spark, sf_dir))


@query("SELECT p_brand, CASE WHEN count(DISTINCT p_size) = 1 THEN CAST(min(p_size) AS DOUBLE) END AS threshold FROM (SELECT p_brand, p_size FROM part UNION ALL SELECT 'largest', max(p_size) FROM part) GROUP BY p_brand")
def infer_threshold(spark, sf_dir):
    """Parts as mask files of their brand; the largest ones agree, a brand's may not."""
    from .sources.sidecar import agreed_threshold

    part = A.table(spark, sf_dir, "part").select("p_brand", "p_size")
    named = part.union(part.agg(F.lit("largest").alias("p_brand"), F.max("p_size").alias("p_size"))).select("p_brand", F.format_string("cellmask_%d_5_5.tif", "p_size").alias("name"))
    return named.groupBy("p_brand").agg(agreed_threshold().alias("threshold"))


@query("SELECT p_partkey, p_size + 0.5::DOUBLE AS frame_rate, p_partkey AS n_volumes, CAST(p_size AS BIGINT) AS h, p_partkey AS w, CAST(p_size + 1 AS BIGINT) AS z, p_retailprice AS z_step_um, CAST(p_size + 1 AS BIGINT) AS frame_start, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 101 ELSE 600 END AS frame_end FROM part")
def sidecar_parse(spark, sf_dir):
    """Parts as acquisition files: every field is read back from text."""
    from .sources import sidecar

    text = A.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat("p_size", F.lit(".5\n240\n"), "p_partkey", F.lit("\n")).alias("rate"),
        F.concat(F.lit('<a dimensions="'), "p_size", F.lit("x"), "p_partkey", F.lit("x"), F.col("p_size") + 1, F.lit('"/><info z_step="'), "p_retailprice", F.lit('">')).alias("xml"),
        F.concat(F.lit("minframe = "), "p_size", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\nmaxframe = "), F.col("p_partkey") + 100)).otherwise("")).alias("frames"),
    )
    return text.select("p_partkey", *sidecar.frame_rate(F.col("rate")), *sidecar.xml_dimensions(F.col("xml")), sidecar.z_step(F.col("xml")), *sidecar.frame_range(F.col("frames"), F.lit(600)))
