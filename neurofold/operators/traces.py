"""Grouped time-series operators on traces: rows (cell_id, t, f) or arrays by cell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import mround
from ..sources.store import materialise


#: Windows that are ranked at once; samples of a run of a long trace.
WINDOWS, RUN = 1 << 16, 1 << 13


class BadWindow(ValueError):
    """A rolling window below one sample."""


class NotVector(ValueError):
    """A trace that is not one-dimensional."""


def as_arrays(points: DataFrame, value: str = "f") -> DataFrame:
    """(cell_id, trace): one array a cell in time order."""
    ordered = F.sort_array(F.collect_list(F.struct("t", value)))
    return points.groupBy("cell_id").agg(F.transform(ordered, lambda p: p[value]).alias("trace"))


def as_points(traces: DataFrame, column: str, name: str) -> DataFrame:
    return traces.select("cell_id", F.posexplode(column).alias("p", name)).select("cell_id", (F.col("p") + 1).cast("long").alias("t"), name)


def window_ranks(f: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest of f[start:end] for many windows (NaN sorts last), in as many passes as the samples' ranks have bits.

    A pass splits all samples by one bit of their rank, stably, and each window goes on in the half that holds its k-th.
    """
    order = np.argsort(f, kind="stable")
    rank = np.empty(len(f), np.int64)
    rank[order] = np.arange(len(f))
    a, b, k, found = start.copy(), end.copy(), k - 1, np.zeros(len(start), np.int64)
    for bit in range(max(len(f) - 1, 1).bit_length() - 1, -1, -1):
        low = (rank >> bit) & 1 == 0
        zeros = np.append(0, np.cumsum(low))
        za, zb = zeros[a], zeros[b]
        up = k >= zb - za
        k = k - np.where(up, zb - za, 0)
        a, b = np.where(up, zeros[-1] + a - za, za), np.where(up, zeros[-1] + b - zb, zb)
        found |= up.astype(np.int64) << bit
        rank = np.concatenate([rank[low], rank[~low]])
    return f[order[found]]


def window_rank(w: int, percentile: float) -> int:
    """Which smallest sample of a window of w is its percentile."""
    return min(max(mround(w * percentile / 100), 1), w)


def rolling_rank(f: np.ndarray, window: int, percentile: float) -> np.ndarray:
    """The k-th smallest value of each full window; positions near the ends repeat the first and last full window's."""
    if f.ndim != 1:
        raise NotVector("a trace must have one dimension")
    n = len(f)
    w = min(window, n)
    if w < 1:
        raise BadWindow("the window must hold a sample")
    k, step, full = window_rank(w, percentile), max(WINDOWS, w), []
    for first in range(0, n - w + 1, step):
        start = np.arange(min(step, n - w + 1 - first))
        full.append(window_ranks(f[first : first + len(start) + w - 1], start, start + w, np.full(len(start), k)))
    j = np.arange(1, n + 1).clip(-(-w // 2), n - w // 2)
    return np.concatenate(full)[j - (-(-w // 2))]


def rolling_percentile_runs(points: DataFrame, window: int, percentile: float, run: int = RUN) -> DataFrame:
    """(cell_id, t, f, f0) from points (cell_id, t, f) whose t counts a trace's samples from 1 without gaps.

    Traces are cut in runs, each with the samples around it that its windows need, so no row or group holds a long trace.
    A group is one run of many cells.
    """
    if window < 1:
        raise BadWindow("the window must hold a sample")
    length, low, high = max(run, 2 * window), -(-window // 2), window // 2
    own = F.floor((F.col("t") - 1) / length)
    after = F.when(F.col("t") > (own + 1) * length - window, own + 1)
    before = F.when((F.col("t") <= own * length + high) & (own > 0), own - 1)
    buckets = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = points.select("cell_id", F.col("t").cast("long").alias("t"), F.col("f").cast("double").alias("f"), F.explode(F.array_compact(F.array(before, own, after))).alias("run"), F.pmod(F.xxhash64("cell_id"), F.lit(buckets)).alias("bucket"))

    def rank(table: pa.Table) -> pa.Table:
        first_t = table.column("run")[0].as_py() * length + 1
        cell, t, f = (table.column(c).to_numpy(zero_copy_only=False) for c in ("cell_id", "t", "f"))
        order = np.lexsort((t, cell))
        cell, t, f = cell[order], t[order], f[order].astype(np.float64)
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size = np.diff(np.append(begin, len(cell)))
        first, last = t[begin], t[begin + size - 1]
        if (last - first != size - 1).any() or (first_t == 1 and (first != 1).any()):
            raise ValueError(f"cell {cell[begin][(last - first != size - 1) | (first > first_t)][:1]}: samples must count from 1 without gaps")
        # Where a trace goes on beyond this run's windows, its end does not matter here.
        ends = last < first_t + length - 1 + high
        w = np.where(ends & (first_t == 1), np.minimum(window, last), window)
        k = np.array([window_rank(v, percentile) for v in range(1, window + 1)])[w - 1] if window <= 1 << 16 else np.array([window_rank(v, percentile) for v in w.tolist()])
        each = np.repeat(np.arange(len(begin)), size)
        at = np.flatnonzero((t >= first_t) & (t < first_t + length))
        each = each[at]
        middle = np.maximum(t[at], -(-w // 2)[each])
        middle = np.where(ends[each], np.minimum(middle, (last - w // 2)[each]), middle)
        start = begin[each] + middle - (-(-w // 2))[each] + 1 - 1 - (first[each] - 1)
        out = window_ranks(f, start, start + w[each], k[each]) if len(at) else np.zeros(0)
        return pa.table({"cell_id": pa.array(cell[at], table.schema.field("cell_id").type), "t": t[at], "f": f[at], "f0": out})

    kind = points.schema["cell_id"].dataType.simpleString()
    return rows.groupBy("run", "bucket").applyInArrow(rank, f"cell_id {kind}, t bigint, f double, f0 double")


def rolling_percentile(traces: DataFrame, window: int, percentile: float, column: str = "trace") -> DataFrame:
    """Adds ``f0``, the rolling percentile of an array column, cell by cell."""
    if window < 1:
        raise BadWindow("the window must hold a sample")
    schema = T.StructType([*traces.schema.fields, T.StructField("f0", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            out = [None if f is None else rolling_rank(np.asarray(f, np.float64), window, percentile) if len(f) else [] for f in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "f0"])

    return traces.mapInArrow(run, schema)


def rolling_percentile_points(points: DataFrame, window: int, percentile: float) -> DataFrame:
    """The same as windows over rows, for cross-checks: (cell_id, t, f0)."""
    n = F.count("*").over(W.partitionBy("cell_id"))
    out = points.withColumn("n", n)
    # One frame for all rows; a cell shorter than the window is a window itself.
    low, high = -(-window // 2), window // 2
    frame = W.partitionBy("cell_id").orderBy("t")
    k = min(max(mround(window * percentile / 100), 1), window)
    full = F.element_at(F.array_sort(F.collect_list("f").over(frame.rowsBetween(-(low - 1), high))), k)
    inside = out.where(F.col("n") >= window).select("cell_id", "t", "n", full.alias("f0"))
    at = F.least(F.greatest(F.col("t"), F.lit(low)), F.col("n") - high)
    return inside.select("cell_id", "t", at.alias("at")).join(inside.select("cell_id", F.col("t").alias("at"), "f0"), ["cell_id", "at"]).select("cell_id", "t", "f0")


def _counted(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """(v, c, b, n): distinct values, how often each occurs, how many values come before it in the order, and all of them.

    Whole numbers of images are few.  Fractions may be as many as the rows: they are cut in ranges, and only sums of ranges
    meet in one place.
    """
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    order = F.desc("v") if descending else F.asc("v")
    before = lambda by: F.coalesce(F.sum("c").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("c").over(W.partitionBy())
    if df.schema[value].dataType.simpleString() not in ("float", "double"):
        return counts.select("v", "c", before(W.orderBy(order)).alias("b"), total.alias("n"))
    ranged = materialise(counts.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "value-counts")
    sums = ranged.groupBy("range").agg(F.sum("c").alias("c"))
    starts = sums.select("range", before(W.orderBy("range")).alias("start"), total.alias("n"))
    inside = ranged.withColumn("inside", before(W.partitionBy("range").orderBy(order)))
    return inside.join(starts, "range").select("v", "c", (F.col("start") + F.col("inside")).alias("b"), "n")


def lowest_mean(df: DataFrame, value: str, share: int = 20) -> DataFrame:
    """Mean of the lowest round(N / share) values."""
    ranked = _counted(df, value)
    take = F.greatest(F.least(F.col("c"), F.round(F.col("n") / share) - F.col("b")), F.lit(0))
    return ranked.agg(F.try_divide(F.sum(F.col("v") * take), F.sum(take)).alias("level"))


def ranked_value(df: DataFrame, value: str, position: Column, descending: bool = False) -> DataFrame:
    """The value at a 1-based rank (an expression of the count ``n``)."""
    ranked = _counted(df, value, descending)
    return ranked.where(F.col("b") + F.col("c") >= position).agg((F.max("v") if descending else F.min("v")).alias("value"))


def subtract(points: DataFrame, level: DataFrame) -> DataFrame:
    """f - level, in single precision."""
    return points.crossJoin(F.broadcast(level)).select("cell_id", "t", (F.col("f") - F.col("level")).cast("float").alias("f"))


def dff(f: Column, f0: Column, offset: float) -> Column:
    return (f - f0) / (F.greatest(f0, F.lit(0.0)) + F.lit(float(offset)))


def rolling_dff(points: DataFrame, window: int, percentile: float, offset: float) -> DataFrame:
    """(cell_id, t, f0, dff) from background-free points."""
    based = rolling_percentile_runs(points.select("cell_id", "t", "f"), window, percentile)
    return based.select("cell_id", "t", "f0", dff(F.col("f"), F.col("f0"), offset).alias("dff"))


def window_low_mean(points: DataFrame, length: int, level: float = 0.0) -> DataFrame:
    """(cell_id, w, b): mean of the lowest round(length / 5) values of each full window, less a level, not below 0."""
    w = F.floor((F.col("t") - 1) / length)
    keep = F.floor(F.max("t").over(W.partitionBy("cell_id")) / length)
    rows = points.withColumn("w", w).withColumn("windows", keep).where("w < windows")
    rank = F.row_number().over(W.partitionBy("cell_id", "w").orderBy("f"))
    low = rows.withColumn("r", rank).where(F.col("r") <= mround(length / 5))
    return low.groupBy("cell_id", "w").agg(F.greatest(F.avg("f") - F.lit(float(level)), F.lit(0.0)).alias("b"))


def bleach_fit(points: DataFrame, length: int, level: float = 0.0) -> DataFrame:
    """(cell_id, t, fitted, f): exponential bleaching by the slope of log window baselines.

    A trace of less than two windows is an error; a baseline that is not positive makes the fit NaN.
    """
    # A cell's window baselines are few: one array a cell gives slope and level in one pass.
    base = window_low_mean(points, length, level).groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("base"))
    part = lambda f: F.aggregate("base", F.lit(0.0), f)
    n = F.size("base").cast("double")
    centre = lambda x: (mround(length / 2) + x["w"] * length).cast("double")
    base = base.withColumn("b12", part(lambda s, x: s + F.when(x["w"] < 2, x["b"]).otherwise(0.0)) / F.least(n, F.lit(2.0)))
    base = base.withColumn("fits", F.forall("base", lambda x: x["b"] > 0)).withColumn("mx", part(lambda s, x: s + centre(x)) / n)
    log = lambda x: F.ln(x["b"] / F.col("b12"))
    base = base.withColumn("my", F.when(F.col("fits"), part(lambda s, x: s + log(x)) / n))
    sxy = part(lambda s, x: s + (centre(x) - F.col("mx")) * (log(x) - F.col("my")))
    sxx = part(lambda s, x: s + (centre(x) - F.col("mx")) * (centre(x) - F.col("mx")))
    rate = F.when(F.col("fits"), F.coalesce(F.try_divide(sxy, sxx), F.lit(0.0))).otherwise(F.lit(float("nan")))
    fit = base.select("cell_id", "b12", rate.alias("slope"), F.size("base").alias("windows"))
    fitted = F.exp(F.col("slope") * F.col("t")) * F.col("b12")
    enough = F.when(F.coalesce("windows", F.lit(0)) < 2, F.raise_error(F.concat(F.lit("bleaching fit: two windows are needed, cell "), F.col("cell_id").cast("string"))).cast("double"))
    fitted = F.coalesce(enough, fitted)
    return points.join(fit, "cell_id", "left").select("cell_id", "t", fitted.alias("fitted"), ((F.col("f") - F.lit(float(level))) / fitted).alias("f"))


def epoch_demean(points: DataFrame, length: int) -> DataFrame:
    """Subtracts the mean over epochs at each phase; frames after the last full epoch are dropped."""
    phase = F.pmod(F.col("t") - 1, F.lit(length))
    epochs = F.floor(F.max("t").over(W.partitionBy("cell_id")) / length)
    kept = points.withColumn("last", epochs * length).where("t <= last").withColumn("phase", phase)
    return kept.select("cell_id", "t", (F.col("f") - F.avg("f").over(W.partitionBy("cell_id", "phase"))).alias("f"))


def epoch_min(points: DataFrame, length: int) -> DataFrame:
    """(cell_id, base): least epoch mean."""
    epoch = F.floor((F.col("t") - 1) / length)
    return points.groupBy("cell_id", epoch.alias("e")).agg(F.avg("f").alias("m")).groupBy("cell_id").agg(F.min("m").alias("base"))


def trial_average(points: DataFrame, lengths: list[int]) -> DataFrame:
    """(cell_id, trial, mean): trials follow each other with the given lengths."""
    ends = np.cumsum(lengths).tolist()
    trial = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("t"))) + 1
    return points.where(F.col("t") <= ends[-1]).groupBy("cell_id", trial.cast("long").alias("trial")).agg(F.avg("f").alias("mean"))


def trial_means(points: DataFrame, lengths: DataFrame) -> DataFrame:
    """(cell_id, trial, mean): trials follow each other in their order, with the lengths (cell_id, trial, length) that a table gives."""
    upto = F.sum("length").over(W.partitionBy("cell_id").orderBy("trial"))
    spans = lengths.where("length > 0").select("cell_id", F.col("trial").alias("frame"), (upto - F.col("length") + 1).alias("begin"), upto.alias("end"))
    return align(spans, points, {"mean": ("mean", "f")}, least=1).withColumnRenamed("frame", "trial")


def pair_correlation(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b, r): correlation of the traces of each pair; 0 where their lengths differ, NaN for constant ones.

    A trace travels once for each of its pairs as one array, not sample by sample; samples of a pair are matched by their time.
    """
    ordered = points.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("t", F.col("f").cast("double").alias("f")))).alias("s"))
    side = lambda c: ordered.select(F.col("cell_id").alias(c), F.col("s.t").alias(f"t{c}"), F.col("s.f").alias(f"f{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c) for c in ("ta", "fa", "tb", "fb")}
            r = []
            for i in range(batch.num_rows):
                ta, fa, tb, fb = (columns[c][i].values.to_numpy(zero_copy_only=False) for c in ("ta", "fa", "tb", "fb"))
                r.append(_correlation(ta, fa, tb, fb))
            keep = pa.array([v is not None for v in r], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(r, pa.float64())], ["a", "b", "r"]).filter(keep)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return joined.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, r double")


def _correlation(ta: np.ndarray, fa: np.ndarray, tb: np.ndarray, fb: np.ndarray) -> float | None:
    """Of two traces by their times; None where they have no time in common."""
    if len(ta) != len(tb) or (ta != tb).any():
        _, i, j = np.intersect1d(ta, tb, return_indices=True)
        if not len(i):
            return None
        if len(ta) != len(tb):
            return 0.0
        fa, fb = fa[i], fb[j]
    x, y = fa - fa.mean(), fb - fb.mean()
    sxx, syy = (x * x).sum(), (y * y).sum()
    return float((x * y).sum() / np.sqrt(sxx * syy)) if sxx > 0 and syy > 0 else float("nan")


def edges(samples: DataFrame, step: float = 0.05) -> DataFrame:
    """Samples (cell_id, t, f) at which round(f / step) differs from the sample before."""
    q = F.round(F.col("f") / step)
    return samples.withColumn("q", q).withColumn("d", F.col("q") - F.lag("q").over(W.partitionBy("cell_id").orderBy("t"))).where("d <> 0").select("cell_id", "t", F.col("d").cast("double").alias("d"))


def debounce(edge_rows: DataFrame, ends: DataFrame, least: int, strict: bool = False) -> DataFrame:
    """(cell_id, frame, begin, end): segments of the samples 1..last between edges, short ones merged forward.

    The first segment ends at the first edge.  A later edge closes a segment only if that is longer than ``least``.  Unless
    ``strict``, the second segment is measured and begins from sample 1 again, so it overlaps the first (as acquired data
    were aligned so far).  ends: (cell_id, last).
    """
    marks = edge_rows.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.col("t") - 1)).alias("marks"))
    all_marks = F.concat(F.coalesce("marks", F.array().cast("array<bigint>")), F.array("last"))
    span = lambda b, e: F.struct(b.alias("begin"), e.alias("end"))
    first = F.element_at("marks", 1)
    one = F.lit(1).cast("bigint")
    start = F.struct((first if strict else one).alias("prev"), F.array(span(one, first)).alias("out"))

    def step(acc, m):
        longer = m - acc["prev"] > least
        return F.struct(F.when(longer, m).otherwise(acc["prev"]).alias("prev"), F.when(longer, F.concat(acc["out"], F.array(span(acc["prev"] + 1, m)))).otherwise(acc["out"]).alias("out"))

    folded = ends.join(marks, "cell_id", "left").select("cell_id", all_marks.alias("marks")).select("cell_id", F.aggregate(F.slice("marks", 2, F.size("marks")), start, step)["out"].alias("out"))
    return folded.select("cell_id", F.posexplode("out").alias("p", "s")).select("cell_id", (F.col("p") + 1).cast("long").alias("frame"), "s.begin", "s.end")


#: Sets of frames that do not overlap among themselves; samples of a stretch that is swept in one piece.
LANES, STRETCH = 2, 1 << 16


def lanes_of(frames: DataFrame) -> DataFrame:
    """frames with a lane, so that frames of a lane do not overlap: those that begin after all before them, then the rest alike."""
    left, out = frames, None
    before = W.partitionBy("cell_id").orderBy("begin", "frame").rowsBetween(W.unboundedPreceding, -1)
    for lane in range(LANES):
        marked = left.withColumn("clear", F.coalesce(F.col("begin") > F.max("end").over(before), F.lit(True)))
        if lane + 1 == LANES:
            fine = F.when(F.col("clear"), F.lit(lane)).otherwise(F.raise_error(F.concat(F.lit(f"more than {LANES} frames overlap, cell "), F.col("cell_id").cast("string"))).cast("int"))
            taken = marked.withColumn("lane", fine)
        else:
            taken, left = marked.where("clear").withColumn("lane", F.lit(lane)), marked.where("NOT clear").drop("clear")
        out = taken.drop("clear") if out is None else out.union(taken.drop("clear"))
    return out


def align(frames: DataFrame, samples: DataFrame, stats: dict[str, tuple[str, str]] | None = None, stretch: int = STRETCH, least: int = 2) -> DataFrame:
    """(cell_id, frame, ...): medians or means of channels of the samples (cell_id, t, ...) inside each frame [begin, end].

    stats: output name -> (median or mean, channel); by default ``med`` and ``mean`` of f.  0 for frames of fewer than ``least`` samples,
    null for longer ones without samples; a frame that ends before it begins is left out.

    A sweep: starts and samples in order, each sample takes the last start before it.  Samples are swept in stretches, to
    which the start that is open at their begin is carried, so a recording is not one group.  At most ``LANES`` frames may overlap.
    """
    stats = stats or {"med": ("median", "f"), "mean": ("mean", "f")}
    channels = sorted({c for _, c in stats.values()})
    laned = lanes_of(frames.select("cell_id", "frame", "begin", "end").where("begin <= end"))
    open_ = F.struct("frame", "end").alias("open")
    at = lambda t: F.floor((t - 1) / stretch)
    starts = laned.select("cell_id", "lane", at(F.col("begin")).alias("stretch"), F.col("begin").alias("t"), F.lit(1).alias("kind"), open_)
    none = F.lit(None).cast(starts.schema["open"].dataType).alias("open")
    # The start that is open where a stretch begins: a row a stretch.
    heads = samples.select("cell_id", at(F.col("t")).alias("stretch")).distinct()
    heads = _each_lane(heads.select("cell_id", "stretch", (F.col("stretch") * stretch + 1).alias("t"), F.lit(0).alias("kind"), none))
    order = ["t", "kind", F.col("open.frame")]
    last = lambda *by: F.last("open", ignorenulls=True).over(W.partitionBy("cell_id", "lane", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    carried = heads.unionByName(starts).withColumn("open", last()).where("kind = 0 and open is not null")
    rows = _each_lane(samples.select("cell_id", at(F.col("t")).alias("stretch"), "t", F.lit(2).alias("kind"), none, *channels))
    events = rows.unionByName(starts, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    inside = events.withColumn("open", last("stretch")).where("kind = 2 and t <= open.end")
    make = {"median": F.median, "mean": F.avg}
    found = inside.groupBy("cell_id", F.col("open.frame").alias("frame")).agg(*(make[how](c).alias(name) for name, (how, c) in stats.items()))
    long = F.col("end") - F.col("begin") + 1 >= least
    kept = frames.select("cell_id", "frame", "begin", "end").where("begin <= end").join(found, ["cell_id", "frame"], "left")
    return kept.select("cell_id", "frame", *(F.when(long, F.col(name)).otherwise(F.lit(0.0)).alias(name) for name in stats))


def _each_lane(df: DataFrame) -> DataFrame:
    out = df.withColumn("lane", F.lit(0))
    for lane in range(1, LANES):
        out = out.union(df.withColumn("lane", F.lit(lane)))
    return out
