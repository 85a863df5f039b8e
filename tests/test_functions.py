"""SQL functions of a session, trace rules at their edges, and the batch runner's concurrency."""

import threading
import time

import numpy as np
import pytest

from neurofold.functions import sql
from neurofold.operators import traces
from neurofold.plans import batch


def test_sql_functions(spark):
    assert set(sql.register(spark)) > {"dff", "rolling_percentile"}
    r = spark.sql("SELECT round_half_away(-2.5D) AS a, dff(3.0D, 1.0D, 1.0D) AS b, linear_index(2, 3, 100) AS c, index_y(202, 100) AS d, index_x(202, 100) AS e, rolling_percentile(array(3.0D, 1.0D, 2.0D), 3, 50.0D) AS f, rolling_percentile(CAST(NULL AS ARRAY<DOUBLE>), 3, 50.0D) AS g").first()
    assert tuple(r) == (-3, 1.0, 202, 2, 3, [2.0] * 3, None)


def test_long_traces_are_ranked_in_runs(monkeypatch):
    f = np.random.default_rng(1).standard_normal(5000)
    whole = traces.rolling_rank(f, 600, 15)
    monkeypatch.setattr(traces, "WINDOWS", 7)
    assert (traces.rolling_rank(f, 600, 15) == whole).all()


def test_bleaching_needs_two_windows(spark):
    points = spark.createDataFrame([(1, t, 5.0) for t in range(1, 40)] + [(2, t, 5.0) for t in range(1, 12)], "cell_id long, t long, f double")
    assert traces.bleach_fit(points.where("cell_id = 1"), 10).count() == 39
    with pytest.raises(Exception, match="two windows are needed, cell 2"):
        traces.bleach_fit(points, 10).collect()


def test_datasets_run_side_by_side(spark):
    open_, most, heard = set(), [0], []
    lock = threading.Lock()

    def work(d):
        with lock:
            open_.add(d)
            most[0] = max(most[0], len(open_))
        time.sleep(0.2)
        with lock:
            open_.discard(d)
        if d == "c":
            raise ValueError("broken")
        return 3

    stages = dict.fromkeys(batch.STAGES, work)
    status = batch.run_batch(spark, list("abcd"), stages, lambda s, d: False, workers=4, notify=lambda *e: heard.append(e)).collect()
    assert most[0] > 1 and [r["directory"] for r in status] == list("abcd")
    assert [(r["segmentation"], r["motion"], r["timecourse"]) for r in status] == [("FAIL", "SKIP", "SKIP") if d == "c" else ("OK",) * 3 for d in "abcd"]
    assert len(heard) == 12 and ("c", "segmentation", "FAIL") in heard and batch.optimal_workers() >= 1
