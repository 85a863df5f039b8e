"""Files written and read back, and a dataset directory through all three stages."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurofold.config import Params
from neurofold.plans import stages
from neurofold.sources import mbif3, planestack, sidecar, tiff

H, W, T = 7, 5, 6


@pytest.fixture
def stack(tmp_path):
    frames = np.arange(T * H * W, dtype="<u2").reshape(T, W, H)  # y is the fast axis
    (tmp_path / "Plane01.stack").write_bytes(frames.tobytes())
    return tmp_path, frames


def test_plane_stack_voxels(spark, stack):
    path, frames = stack
    rows = planestack.voxels(planestack.read(spark, str(path), H, W)).collect()
    assert len(rows) == T * H * W
    assert all(r["v"] == frames[r["t"] - 1, r["x"] - 1, r["y"] - 1] and r["ind"] == (r["x"] - 1) * H + r["y"] for r in rows)


def test_one_frame_is_clamped(spark, stack):
    path, frames = stack
    last = planestack.voxels(planestack.read_frame(spark, str(path / "Plane01.stack"), H, W, 99)).collect()
    assert sorted(r["v"] for r in last) == sorted(frames[-1].ravel().tolist())


def test_cell_means_joins_the_cells_as_a_table(spark, stack):
    path, frames = stack
    cells = spark.createDataFrame([(1, 1, [1, 2, H + 1]), (4, 1, [H * W]), (9, 2, [3])], "cell_id long, z int, inds array<int>")
    got = {(r["cell_id"], r["t"]): r["f"] for r in planestack.cell_means(planestack.read(spark, str(path), H, W), cells).collect()}
    assert got == pytest.approx({(i, t + 1): frames[t].ravel()[at].mean() for i, at in ((1, [0, 1, H]), (4, [H * W - 1])) for t in range(T)})


def test_plane_stack_is_written_as_it_was_read(spark, stack, tmp_path):
    path, frames = stack
    planestack.write(planestack.read(spark, str(path), H, W), str(tmp_path / "copy"))
    again = planestack.voxels(planestack.read(spark, str(tmp_path / "copy"), H, W)).orderBy("t", "ind").collect()
    assert [r["v"] for r in again] == frames.ravel().tolist()


def test_filters_leave_out_whole_blocks(spark, tmp_path):
    """Pushed filters give the rows that Spark's own filter gives, and fewer partitions."""
    for z in (1, 2):
        (tmp_path / f"Plane{z:02d}.stack").write_bytes((np.arange(64 * H * W) * z).astype("<u2").tobytes())
    blocks = planestack.read(spark, str(tmp_path), H, W)
    every = [(r["z"], r["t0"], r["n"]) for r in blocks.collect()]
    assert sorted(every) == [(1, 1, 32), (1, 33, 32), (2, 1, 32), (2, 33, 32)]
    tests = {"t0 <= 40": lambda z, t: t <= 40, "t0 >= 10": lambda z, t: t >= 10, "t0 > 33": lambda z, t: t > 33, "z = 2": lambda z, t: z == 2, "z = 1 and t0 < 33": lambda z, t: z == 1 and t < 33, "z > 5": lambda z, t: z > 5}
    for text, keep in tests.items():
        got = blocks.where(text)
        expected = sorted(e for e in every if keep(*e[:2]))
        assert sorted((r["z"], r["t0"], r["n"]) for r in got.collect()) == expected, text
        assert got.rdd.getNumPartitions() == max(1, len(expected)), text


def test_append_and_overwrite(spark, stack, tmp_path):
    path, frames = stack
    blocks, copy = planestack.read(spark, str(path), H, W), tmp_path / "grown"
    planestack.write(blocks, str(copy))
    planestack.write(blocks, str(copy), append=True)
    assert (copy / "Plane01.stack").read_bytes() == frames.tobytes() * 2
    planestack.write(blocks, str(copy))
    assert (copy / "Plane01.stack").read_bytes() == frames.tobytes() and sorted(p.name for p in copy.iterdir()) == ["Plane01.stack"]


def test_float_stack(spark, tmp_path):
    """A matrix file and a folder of parts, read and written."""
    matrix = np.arange(700 * 3, dtype="<f4")
    (tmp_path / "m.stackf").write_bytes(matrix.tobytes())
    points = planestack.read_float(spark, str(tmp_path / "m.stackf"), 3)
    assert {(r["cell_id"], r["t"]): r["f"] for r in points.collect()} == {(k % 3 + 1, k // 3 + 1): float(v) for k, v in enumerate(matrix)}
    for _ in range(2):
        planestack.write_float(points, str(tmp_path / "out"))
        assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*.stackf"))) == matrix.tobytes()
    again = planestack.read_float_parts(spark, str(tmp_path / "out"), 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, points.collect()))


def test_tiff_round_trip(spark, tmp_path):
    pages = [np.arange(12, dtype=np.uint16).reshape(3, 4) * k for k in (1, 100)]
    (tmp_path / "a.tif").write_bytes(tiff.encode(pages))
    rows = tiff.pixels(tiff.read(spark, str(tmp_path / "a.tif"))).collect()
    assert len(rows) == 24 and all(r["v"] == pages[r["z"] - 1][r["y"] - 1, r["x"] - 1] for r in rows)


def test_tiff_directory_by_name_position_and_instrument_order(spark, tmp_path):
    names = ["a_t1000_ch00.tif", "a_t998_ch00.tif", "a_t999_ch00.TIFF", "notes.txt", "b_t001_ch01.tif"]
    for k, n in enumerate(names):
        (tmp_path / n).write_bytes(tiff.encode([np.full((2, 2), k, np.uint16)]))
    value = lambda df: [int(np.frombuffer(bytes(r["px"]), "<u2")[0]) for r in df.collect()]
    assert value(tiff.read(spark, str(tmp_path), include="^a_")) == [0, 1, 2]
    assert value(tiff.read(spark, str(tmp_path), include="^A_", leica=True)) == [1, 2, 0]
    assert value(tiff.read(spark, str(tmp_path), indices=[2, 4])) == [1, 4]
    assert tiff.read(spark, str(tmp_path), include="nothing").count() == 0
    with pytest.raises(FileNotFoundError):
        tiff.read(spark, str(tmp_path / "gone.tif"))
    big_endian = b"MM\x00*" + struct.pack(">IH", 8, 7) + b"".join(struct.pack(">HHIHH", t, 3, 1, v, 0) for t, v in ((256, 2), (257, 1), (258, 16), (259, 1))) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in ((273, 98), (278, 1), (279, 4))) + struct.pack(">I", 0) + struct.pack(">2H", 7, 300)
    assert tiff.decode(big_endian)[0].tolist() == [[7, 300]]


def test_names_and_paths(spark, tmp_path):
    for n in ("Plane02.stack", "Plane01.stack", "skip.stack", "other.log"):
        (tmp_path / n).write_bytes(b"\0" * (2 * H * W * 3 + 5))
    assert [r["name"] for r in sidecar.files(spark, str(tmp_path), "STACK$", "^skip").orderBy("k").collect()] == ["Plane01.stack", "Plane02.stack"]
    assert [r["name"] for r in sidecar.files(spark, str(tmp_path), indices=[2]).collect()] == ["Plane02.stack"]
    assert planestack.frame_count(str(tmp_path / "Plane01.stack"), H, W) == 3
    assert planestack.stacks(f"file://{tmp_path}") == [(1, str(tmp_path / "Plane01.stack")), (2, str(tmp_path / "Plane02.stack"))]
    assert spark.range(1).select(sidecar.join_path(F.lit("/a/"), F.lit("b//"), F.lit("c/"))).first()[0] == "/a/b/c"


def test_mbif3(spark, tmp_path):
    head = struct.pack("<II8x4f", 2, 3, 1.0, 2.0, 3.0, 4.0)
    px = [np.arange(6, dtype="<u2") + k for k in (0, 10)]
    (tmp_path / "m.bin").write_bytes(b"".join(head + p.tobytes() for p in px))
    rows = mbif3.read(spark, str(tmp_path / "m.bin")).orderBy("t").collect()
    assert [bytes(r["px"]) for r in rows] == [p.tobytes() for p in px] and list(rows[0]["scan_v"]) == [1, 2, 3, 4]


def test_sidecar_expressions(spark):
    text = 'dimensions="2048x1024x41" <info z_step="-5.0" minframe = 3\nmaxframe = 9'
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(*sidecar.xml_dimensions(F.col("t")), sidecar.z_step(F.col("t")), *sidecar.frame_range(F.col("t"), F.lit(20))).first()
    assert tuple(r) == (2048, 1024, 41, None, 4, 10)


def test_missing_sidecar(spark, tmp_path):
    with pytest.raises(sidecar.MissingFile):
        sidecar.read_text(spark, str(tmp_path / "none.txt"))


def test_batch_isolates_failures(spark, tmp_path):
    status = stages.run_all(spark, [str(tmp_path / "none")], Params()).collect()
    assert [tuple(r)[1:4] for r in status] == [("FAIL", "SKIP", "SKIP")]


def random_cells(rng, size, n):
    return [(k + 1, int(rng.integers(1, 4)), sorted((rng.choice(size, rng.integers(1, 9), False) + 1).tolist())) for k in range(n)]


@pytest.mark.parametrize("gap", [0, 40, 1 << 20])
def test_cells_are_read_by_their_pixels(spark, tmp_path, gap):
    """Equal to the join of blocks and cells, whatever gaps are read through; planes without cells or files give nothing."""
    rng = np.random.default_rng(2)
    for z in (1, 2, 4):
        (tmp_path / f"Plane{z:02d}.stack").write_bytes(rng.integers(0, 60_000, 40 * H * W).astype("<u2").tobytes())
    cells = spark.createDataFrame([*random_cells(rng, H * W, 30), (99, 2, [])], "cell_id long, z int, inds array<int>")
    table = planestack.by_plane(cells, f"file://{tmp_path}/cells")
    found = planestack.read_cells(spark, str(tmp_path), H, W, table, gap=gap, block=7, t0=3, t1=38)
    expected = planestack.cell_means(planestack.read(spark, str(tmp_path), H, W, t0=3, t1=38), cells.where("size(inds) > 0"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_no_frame_is_moved(spark, stack):
    path, _ = stack
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = planestack.by_plane(spark.createDataFrame([(1, 1, [1, 2])], "cell_id long, z int, inds array<int>"), f"file://{path}/cells")
        plan = planestack.read_cells(spark, str(path), H, W, table)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


class Counting:
    def __init__(self, raw):
        self.raw, self.at, self.read_bytes = raw, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        self.at, self.read_bytes = self.at + n, self.read_bytes + n
        return self.raw[self.at - n : self.at]


def test_bytes_read_grow_with_the_pixels():
    size, frames = 10_000, 5
    x = np.arange(size * frames, dtype="<u2")
    for inds, gap, bound in (([5, 6, 7, 9_000], 8, 8), ([5, 6, 7, 12], 100, 16), (list(range(1, 9_001)), 8, 2 * size)):
        f, at = Counting(x.tobytes()), np.array(inds)
        got = planestack.read_pixels(f, at, range(2, 5), size, gap)
        assert (got == np.stack([x[size * (t - 1) :][at - 1] for t in range(2, 5)])).all()
        assert f.read_bytes == 3 * bound
    assert planestack.byte_ranges(np.array([1, 2, 5, 100]), 4).tolist() == [[0, 5], [99, 100]]


@pytest.mark.parametrize("stream", [False, True])
def test_blocks_are_placed_by_many_tasks(spark, tmp_path, stream):
    """A plane's blocks lie in several tasks, out of order; an append goes on behind them."""
    raw = {z: np.random.default_rng(z).integers(0, 9, 20 * H * W).astype("<u2").tobytes() for z in (1, 12)}
    for z, x in raw.items():
        (tmp_path / f"Plane{z:02d}.stack").write_bytes(x)
    blocks = planestack.read(spark, str(tmp_path), H, W, block=3, t0=5)
    shuffled = blocks.repartition(6, "t0").cache()
    for append in (False, True):
        planestack.write(shuffled, f"file://{tmp_path}/out", append, stream)
    for z, x in raw.items():
        assert (tmp_path / "out" / f"Plane{z:02d}.stack").read_bytes() == 2 * x[2 * H * W * 4 :]
    assert len(list((tmp_path / "out").iterdir())) == 2
    with pytest.raises(ValueError, match="overlap"):
        planestack.write(shuffled.where("t0 <> 8"), f"file://{tmp_path}/out")
    shuffled.unpersist()


def test_float_matrix_in_one_file(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 7)).astype("<f4")
    rows = spark.createDataFrame([(c + 1, t + 1, float(x[t, c])) for t in range(300) for c in range(7) if (t, c) != (40, 2)], "cell_id long, t int, f double")
    planestack.write_float_file(rows.repartition(5), f"file://{tmp_path}/m.stackf", 7)
    x[40, 2] = np.nan
    assert np.array_equal(np.frombuffer((tmp_path / "m.stackf").read_bytes(), "<f4").reshape(300, 7), x, equal_nan=True)
