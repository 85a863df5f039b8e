"""Batches of datasets: three stages, statuses, isolation of failures, resuming by parameters."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = "directory string, segmentation string, motion string, timecourse string, n_cells bigint"
STAGES = ("segmentation", "motion", "timecourse")


def gated(ran: DataFrame) -> DataFrame:
    """Statuses after the rules: a failed segmentation skips the later stages, a failed motion stage the last."""
    lost1 = F.col("segmentation") == "FAIL"
    motion = F.when(lost1, "SKIP").otherwise(F.col("motion"))
    timecourse = F.when(lost1 | (motion == "FAIL"), "SKIP").otherwise(F.col("timecourse"))
    return ran.select("directory", "segmentation", motion.alias("motion"), timecourse.alias("timecourse"))


def status_counts(status: DataFrame) -> DataFrame:
    """(stage, ok, skipped, fail)."""
    long = status.unpivot("directory", list(STAGES), "stage", "status")
    count = lambda s, n: F.count_if(F.col("status") == s).alias(n)
    return long.groupBy("stage").agg(count("OK", "ok"), count("skipped", "skipped"), count("FAIL", "fail"))


def optimal_workers() -> int:
    """Datasets that the driver keeps going at once: one less than its cores."""
    return max(1, (os.cpu_count() or 1) - 1)


def run_batch(
    spark: SparkSession,
    directories: list[str],
    stages: dict[str, Callable[[str], int | None]],
    done: Callable[[str, str], bool],
    skip: tuple[str, ...] = (),
    force: bool = False,
    abort: Callable[[], bool] = lambda: False,
    workers: int = 1,
    notify: Callable[[str, str, str], None] = lambda directory, stage, status: None,
) -> DataFrame:
    """Runs stage after stage over all directories and returns run_status.

    stages[name](directory) does the work (segmentation returns its number of cells); done(name, directory) says whether its
    output for the same parameters exists.  A directory that fails does not stop the others.  ``workers`` datasets go at
    once, so that the cluster is busy where one dataset is small; notify(directory, stage, status) is called after each.
    """
    rows = {d: dict.fromkeys(STAGES, "pending") | {"n_cells": None} for d in directories}

    def work(k: int, name: str, d: str) -> None:
        row = rows[d]
        if k and abort():
            row[name] = "aborted"
        elif k and any(row[s] in ("FAIL", "SKIP") for s in STAGES[:k]):
            row[name] = "SKIP"
        elif name in skip or (not force and done(name, d)):
            row[name] = "skipped"
        else:
            try:
                found = stages[name](d)
                row[name] = "OK"
                if name == "segmentation":
                    row["n_cells"] = found
            except Exception as error:  # a dataset's failure is its status
                row[name] = "FAIL"
                print(f"{d}: {name}: {error}")
        notify(d, name, row[name])

    for k, name in enumerate(STAGES):
        if workers == 1:
            for d in rows:
                work(k, name, d)
        else:
            with ThreadPoolExecutor(workers) as pool:
                list(pool.map(lambda d: work(k, name, d), rows))  # noqa: B023
    return spark.createDataFrame([(d, *(r[s] for s in STAGES), r["n_cells"]) for d, r in rows.items()], STATUS)


def ready(status: dict[str, bool], needs_motion: bool) -> bool:
    """Whether traces can be extracted: cells are there and, if the motion filter is on, motion is."""
    return status.get("segmentation", False) and (status.get("motion", False) or not needs_motion)
