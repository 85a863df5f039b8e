"""Planes that lack pixels, values below 0, and tasks that stay small, against the SQL twins and the plans."""

import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import sf
from pyspark.sql import functions as F
from test_queries import canonical

from neurofold.operators import extract, motion, stencil
from neurofold.queries import ORACLE_SQL, QUERIES, r6_half
from neurofold.sources import planestack

PARTIAL = "disk_offsets exclusion_mask grid_min seeds_round1 segment_cells stamp_round1 local_average_r4 local_contrast local_max_r7 opening_r3 maskones_r10 local_rank_r10 xcorr_shift xcorr_shift_images cell_motion_found mean_stack stack_cells stack_register stacks_registered dilate_r3_joined adjacent_overlap dedup_greedy knn5".split()


@pytest.fixture(scope="module", params=["last", "gaps"])
def data(request, tmp_path_factory):
    """Three planes of which the last ends early, or that lack rows here and there; some values are below 0."""
    folder = str(tmp_path_factory.mktemp("spark-partial"))
    rows = pq.read_table(f"{sf('0.01')}/embeddings.parquet").sort_by("vec_id").slice(0, 256)
    if request.param == "gaps":
        rows = rows.filter(np.random.default_rng(3).random(256) < 0.7)
    flat = rows.column("embedding").combine_chunks().flatten().to_numpy().copy()
    flat[::97] = -0.7
    lists = type(rows.column("embedding").combine_chunks()).from_arrays(rows.column("embedding").combine_chunks().offsets, flat)
    pq.write_table(rows.set_column(1, "embedding", lists), f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", PARTIAL)
def test_partial_planes(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    df = QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert canonical(rows, df.columns) == canonical(found.fetchall(), columns)


def test_cells_are_read_first_in_a_session(spark, tmp_path):
    """Reading cells needs no earlier read of frames that would have switched the pushdown on."""
    (tmp_path / "Plane01.stack").write_bytes(np.arange(12, dtype="<u2").tobytes())
    table = planestack.by_plane(spark.createDataFrame([(1, 1, [1, 2])], "cell_id long, z int, inds array<int>"), f"file://{tmp_path}/cells")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert [tuple(r) for r in planestack.read_cells(spark, str(tmp_path), 3, 2, table).orderBy("t").collect()] == [(1, 1, 0.5), (1, 2, 6.5)]


def test_values_that_do_not_fit_a_stack_are_an_error(spark):
    images = spark.createDataFrame([(1, 1, 1, 2, np.array([-9.0, 1.0]).tobytes())], "z long, t long, h int, w int, image binary")
    with pytest.raises(Exception, match="do not fit"):
        planestack.blocks_of(images, 5).collect()


@pytest.mark.parametrize("name", ["dilate_r3_joined", "setdiff_keep", "candidate_semi"])
def test_no_pixels_are_broadcast(spark, name):
    plan = QUERIES[name](spark, sf("0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_stamps_of_planes_meet_without_a_row_a_pixel(spark):
    cells = spark.createDataFrame([(1, 1, 10, 10), (2, 2, 11, 12), (3, 2, 30, 20), (4, 3, 11, 12)], "cell_id long, z long, cy long, cx long")
    for df in (extract.overlaps(cells, 40, 30), extract.duplicate_pairs(cells, cells.select("cell_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("t")).withColumn("f", F.rand(1)), 40, 30)):
        assert sorted((r["a"], r["b"]) for r in df.select("a", "b").collect()) == [(1, 2), (2, 4)]
        assert "explode" not in extract.overlaps(cells, 40, 30)._jdf.queryExecution().toString()


def test_nearest_deals_its_rounds_by_number(spark, monkeypatch):
    """With more cells than a task deals with, the cells of a round lie in more than one task, and the result is the same."""
    grid = spark.range(400).selectExpr("1 AS z", "id AS grid_idx", "10 + 5 * (id % 20) AS py", "10 + 5 * (id div 20) AS px")
    cells = spark.range(900).selectExpr("id AS cell_id", "1 AS z", "10 + (id * 7) % 95 AS cy", "10 + (id * 13) % 95 AS cx")
    listed = lambda df: sorted((r["cell_id"], r["grid_idx"], r["k"]) for r in df.collect())
    whole = motion.nearest(cells, grid)
    monkeypatch.setattr(motion, "DEALT", 200)
    dealt = motion.nearest(cells, grid)
    files = lambda df: len({os.path.basename(f) for f in df.inputFiles() if os.path.getsize(f.removeprefix("file://")) > 0})
    assert listed(dealt) == listed(whole) and files(dealt) > files(whole)


def test_pixels_that_are_missing_are_no_neighbours():
    image, there = np.array([[5, 0, 7], [1, 9, 0]]), np.array([[True, False, True], [True, True, False]])
    assert stencil.erode(image, 1, there)[there].tolist() == [1, 7, 1, 1] and stencil.dilate(image, 1, there)[there].tolist() == [5, 7, 9, 9]
    assert stencil.inside_count(image.shape, 1, there)[there].tolist() == [2, 1, 3, 2]


def test_tilts_half_way_between_roundings(spark):
    """Tilts of 3k/128 end at the 7th decimal; the order of rows must not decide how they are rounded."""
    shifts = spark.range(1, 257).selectExpr("id AS tp", "CASE id WHEN 256 THEN 1 WHEN 129 THEN 2 ELSE 0 END AS d")
    shifts = shifts.crossJoin(spark.range(1, 41).selectExpr("2 * id - 1 AS k")).selectExpr("1L AS z", "k AS grid_idx", "k AS ind", "tp", "CAST(d * k + 5 AS double) AS dy", "CAST(-d * k AS double) AS dx", "0D AS dz")
    for parts in (1, 3, 7):
        found = motion.tilts(shifts.orderBy(F.hash("tp", F.lit(parts))).repartition(parts, "tp"))
        for c, sign in (("tilt_y", 1), ("tilt_x", -1), ("tilt_z", 0)):
            assert {r["ind"]: r[c] for r in found.collect()} == {k: sign * 3 * k / 128 for k in range(1, 80, 2)}
    # Five tilts whose mean is half-way, added up in any order.
    means = spark.createDataFrame([(1, 0.0234375), (2, 0.023437499999999997), (3, -0.023437499999999993), (4, 0.0234374)], "id long, m double")
    assert [r["m"] for r in means.select("id", r6_half("m", "m")).orderBy("id").collect()] == [0.023438, 0.023438, -0.023438, 0.023437]
