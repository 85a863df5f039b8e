"""Dataset directories through all stages: volumetric, single plane, conflicting, resumed, aborted, without motion."""

import struct
import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurofold.config import Params
from neurofold.operators import motion, segment
from neurofold.plans import stages
from neurofold.sources import planestack, sidecar, tiff

H, W, T = 160, 160, 24
PARAMS = Params(br_threshold=300, cont_threshold=20, grid_radius=10, brightness_threshold=100, single_plane_cycle=6, detrend_window_frames=9)


def make(folder, planes, pages=None, seed=1, camera="ch0_cam1.xml"):
    """Round cells on a dim ground that drift by a pixel a timepoint; returns the frames (z, t, y, x)."""
    rng = np.random.default_rng(seed)
    folder.mkdir()
    y, x = np.mgrid[:H, :W]
    ave = np.full((planes, H, W), 200.0)
    for z in range(planes):
        for cy, cx in zip(rng.integers(10, H - 10, 40), rng.integers(10, W - 10, 40), strict=True):
            ave[z] += 600 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 12)
    frames = np.stack([[np.roll(p, t // 6, 0) * (1 + 0.1 * np.sin(t)) + rng.integers(0, 20, (H, W)) for t in range(T)] for p in ave]).astype("<u2")
    for z in range(planes):
        (folder / f"Plane{z + 1:02d}.stack").write_bytes(frames[z].transpose(0, 2, 1).tobytes())
    (folder / "ave.tif").write_bytes(tiff.encode([p.astype("<u2") for p in np.repeat(ave, (pages or planes) // planes, 0)]))
    (folder / "Background_1.tif").write_bytes(tiff.encode([np.full((H, W), 90, "<u2") + rng.integers(0, 9, (H, W)).astype("<u2")]))
    (folder / "Stack_frequency.txt").write_text(f"0.1 240 {T}")
    (folder / "Stack dimensions.log").write_bytes(struct.pack("<3I", H, W, planes))
    (folder / camera).write_text(f'<info z_step="5.0" dimensions="{H}x{W}x{planes}">')
    return frames


def statuses(df):
    return [tuple(r)[1:4] for r in df.collect()]


@pytest.fixture(scope="module")
def volume(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sets") / "volume"
    return folder, make(folder, 3, camera="ch0_cam2.xml")


def test_volume_runs_and_resumes(spark, volume):
    folder, frames = volume
    p = Params(**vars(PARAMS) | {"enable_remove_duplicates": True, "enable_motion_filter": True, "motion_threshold_pixels": 50.0})
    began = time.perf_counter()
    first = stages.run_all(spark, [str(folder), str(folder / "none")], p).collect()
    print("run_all", round(time.perf_counter() - began, 1), "s")
    assert [tuple(r)[1:4] for r in first] == [("OK", "OK", "OK"), ("FAIL", "SKIP", "SKIP")] and first[0]["n_cells"] > 60
    pipe = stages.Pipeline(spark, str(folder), p)
    assert pipe.acquisition() == {"frame_rate": 0.1, "n_total_frames": T, "stack_height": H, "stack_width": W, "n_zplanes": 3, "z_step_um": 5.0, "frame_start": 1, "frame_end": T, "is_single_plane": False}
    # Traces are the mean of each cell's pixels, less the background, over its rolling percentile.
    raw = {(r["cell_id"], r["t"]): r["f"] for r in planestack.cell_means(pipe.frames(pipe.acquisition()), pipe.cells()).collect()}
    for c in pipe.cells().limit(5).collect():
        own = frames[c["z"] - 1].transpose(0, 2, 1).reshape(T, -1)[:, np.array(c["inds"]) - 1].mean(1)
        assert [raw[c["cell_id"], t + 1] for t in range(T)] == pytest.approx(own, rel=1e-6)
    traces = spark.read.parquet(pipe.path("traces"))
    kept = traces.select("cell_id").distinct().count()
    assert 0 < kept <= first[0]["n_cells"] and traces.count() == kept * T
    course = spark.read.parquet(pipe.path("motion_tcourse")).where("z = 2").orderBy("tp").collect()
    assert [r["tp"] for r in course] == [1, 2, 3, 4] and course[3]["xy_av"] > course[0]["xy_av"]
    manifest = spark.read.parquet(pipe.path("rolling_baseline")).first()
    assert (manifest["method"], manifest["window_frames"], manifest["photobleach_fit_first"]) == ("rolling_percentile", 9, False) and 89 < manifest["background_baseline"] < 92
    page = tiff.read(spark, pipe.write_overlay()).count()
    assert page == 3
    # Finished work is skipped, a changed parameter is not finished, an abort stops the later stages.
    assert statuses(stages.run_all(spark, [str(folder)], p)) == [("skipped", "skipped", "skipped")]
    other = Params(**vars(PARAMS) | {"enable_detrending": False})
    assert statuses(stages.run_all(spark, [str(folder)], other, abort=lambda: True)) == [("OK", "aborted", "aborted")]


def test_missing_motion_is_a_warning(spark, volume):
    p = Params(**vars(PARAMS) | {"enable_motion_filter": True, "skip_motion": True, "detrend_percentile": 20.0})
    with pytest.warns(sidecar.NoMotionWarning):
        assert statuses(stages.run_all(spark, [str(volume[0])], p)) == [("OK", "skipped", "OK")]


def test_single_plane_and_conflict(spark, tmp_path):
    make(tmp_path / "single", 1)
    make(tmp_path / "odd", 1, pages=2)
    one = stages.Pipeline(spark, str(tmp_path / "single"), PARAMS).acquisition()
    assert one["is_single_plane"] and one["n_zplanes"] == 1
    with pytest.warns(sidecar.AmbiguousMode):
        assert not stages.Pipeline(spark, str(tmp_path / "odd"), PARAMS).acquisition()["is_single_plane"]
    with warnings.catch_warnings():
        warnings.simplefilter("error", sidecar.AmbiguousMode)
        assert statuses(stages.run_all(spark, [str(tmp_path / "single")], PARAMS)) == [("OK", "OK", "OK")]


def test_batch_file_drops_missing_directories(spark, tmp_path):
    make(tmp_path / "a", 1, seed=5)
    (tmp_path / "list.txt").write_text(f"# sets\n\n  {tmp_path}/a  \n{tmp_path}/gone\n#{tmp_path}/b\n")
    with pytest.warns(sidecar.MissingDirectoryWarning):
        got = stages.run_list(spark, str(tmp_path / "list.txt"), Params(**vars(PARAMS) | {"skip_motion": True})).collect()
    assert [(r["directory"], r["segmentation"], r["timecourse"]) for r in got] == [(f"{tmp_path}/a", "OK", "OK")]


def test_image_forms_equal_pixel_forms(spark, volume):
    """Block means, patch means, shifts and labels from images against the same operators on pixel rows."""
    folder, _ = volume
    blocks = planestack.read(spark, str(folder), H, W, block=5, t1=17)
    anatomy = tiff.read(spark, str(folder / "ave.tif"))
    images = motion.block_images(blocks, 6, 20).cache()
    pixels = motion.block_means(planestack.voxels(blocks), 6, 20).cache()
    assert sorted((r["z"], r["tp"]) for r in images.select("z", "tp").collect()) == [(z, tp) for z in (1, 2, 3) for tp in (1, 2)]
    for r in images.where("z = 2").collect():
        rows = pixels.where(f"z = 2 and tp = {r['tp']}").collect()
        image = np.frombuffer(bytes(r["image"]), "<f8")
        assert all(image[(p["x"] - 1) * H + p["y"] - 1] == pytest.approx(p["v"], rel=1e-12) for p in rows) and len(rows) == len(image)
    first = pixels.where("tp = 1").select("z", "y", "x", "v", ((F.col("x") - 1) * H + F.col("y")).alias("ind"))
    plain = {(r["z"], r["grid_idx"], r["ind"]): r["m"] for r in motion.patch_means(first, motion.grid(spark, H, W, 10), H, 10).collect()}
    assert {(r["z"], r["grid_idx"], r["ind"]): r["m"] for r in motion.patch_means_of_images(images.where("tp = 1"), 10).collect()} == pytest.approx(plain)
    points = spark.createDataFrame([k for k in plain if k[1] % 9 == 0], "z long, grid_idx long, ind long")
    listed = lambda df: sorted(map(tuple, df.select("z", "grid_idx", "ind", "tp", "dy", "dx", "dz").collect()))
    for single in (False, True):
        expected = listed(motion.displacements(pixels, tiff.pixels(anatomy), points, H, W, 10, single))
        assert listed(motion.displacements_of_images(images, motion.page_images(anatomy), points, 10, single)) == expected and len(expected) > 20
    cells = lambda df: sorted(map(tuple, df.select("z", "ind", "label").collect()))
    assert cells(segment.labels_of_pages(anatomy, PARAMS)) == cells(segment.labels(tiff.pixels(anatomy), PARAMS))


def test_crop_keeps_a_margin_inside_the_stack(spark):
    pixels = spark.createDataFrame([(y, x) for y in range(1, 21) for x in range(1, 31)], "y long, x long")
    r = stages.crop(pixels, 4.4, 6.5, 5, 6, 20, 30, 3).agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    assert tuple(r) == (1, 12, 4, 16)


def test_registration_leaves_frames_that_move_along_one_axis(spark):
    frames = spark.createDataFrame([(1, t, y, x, 10 * y + x) for t in (1, 2) for y in range(1, 5) for x in range(1, 5)], "z long, t long, y long, x long, v long")
    shifts = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 0)], "z long, t long, dy long, dx long")
    got = {(r["t"], r["y"], r["x"]): r["v"] for r in motion.apply_shift(frames, shifts).collect()}
    assert got[1, 3, 3] == 22 and got[1, 1, 1] == 11 and all(got[2, y, x] == 10 * y + x for y in range(1, 5) for x in range(1, 5))


def test_use_gpu_is_said_to_have_no_effect(spark, volume, caplog):
    folder, _ = volume
    stages.Pipeline(spark, str(folder), Params(**vars(PARAMS) | {"use_gpu": True})).move()
    assert any("use_gpu" in r.getMessage() for r in caplog.records)


def test_mean_images_of_long_stacks(spark, tmp_path):
    rng = np.random.default_rng(12)
    frames = {z: rng.integers(0, 60_000, (53, 4, 6)).astype("<u2") for z in (1, 3)}
    for z, x in frames.items():
        (tmp_path / f"Plane{z:02d}.stack").write_bytes(x.tobytes())
    rows = motion.mean_images(planestack.read(spark, str(tmp_path), 6, 4, block=5)).collect()
    assert {r["z"] for r in rows} == {1, 3}
    for r in rows:
        assert np.allclose(np.frombuffer(r["image"], "<f8"), frames[r["z"]].reshape(53, -1).mean(0))
