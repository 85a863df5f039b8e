"""TIFF pages of every kind: written and read back, read from hand-made files, and unknown kinds refused."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from neurofold.sources import store, tiff, tiffcodec

rng = np.random.default_rng(4)
KINDS = ["u1", "<u2", "<u4", "<i2", "<f4", "<f8"]


def image(kind, h=37, w=29, samples=1):
    x = rng.normal(100, 40, (h, w, samples)).cumsum(1)
    x = x if np.dtype(kind).kind == "f" else np.abs(x).astype("i8") % 251
    return (x if samples > 1 else x[:, :, 0]).astype(kind)


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("compression", ["none", "lzw", "deflate", "packbits"])
@pytest.mark.parametrize("options", [{}, {"predictor": True, "rows": 10}, {"tile": (16, 16), "predictor": True}, {"tile": (64, 32), "big": True}, {"rows": 1, "big": True}])
def test_pages_come_back(kind, compression, options):
    pages = [image(kind), image(kind, 5, 64), image(kind, 16, 16, 3)]
    got = tiff.decode(tiff.encode(pages, compression=compression, **options))
    assert [(g.dtype, g.shape) for g in got] == [(p.dtype, p.shape) for p in pages]
    assert all((g == p).all() for g, p in zip(got, pages, strict=True))


def test_float_pages_are_not_read_as_integers(spark, tmp_path):
    page = np.array([[0.5, -2.25], [np.inf, 1e-30]], "<f4")
    (tmp_path / "f.tif").write_bytes(tiff.encode([page]))
    row = tiff.read(spark, str(tmp_path / "f.tif")).first()
    assert (row["bits"], row["kind"]) == (32, "f") and np.frombuffer(row["px"], "<f4").tolist() == page.ravel().tolist()
    assert sorted(r["v"] for r in tiff.pixels(tiff.read(spark, str(tmp_path / "f.tif")), "double").collect()) == sorted(page.ravel().tolist())
    with pytest.raises(Exception, match="fractions where whole numbers"):
        tiff.pixels(tiff.read(spark, str(tmp_path / "f.tif"))).collect()


def test_conversion_without_scaling(spark, tmp_path):
    (tmp_path / "f.tif").write_bytes(tiff.encode([np.array([[-1.0, 0.5, 254.6, 70000.0]], "<f4")]))
    pages = tiff.read(spark, str(tmp_path / "f.tif"))
    values = lambda kind, code: np.frombuffer(tiff.convert(pages, kind).first()["px"], code).tolist()
    assert values("uint8", "u1") == [0, 1, 255, 255] and values("uint16", "<u2") == [0, 1, 255, 65535] and values("single", "<f4") == [-1, 0.5, np.float32(254.6), 70000]


#: The example of the format's description, 9-bit codes 256 7 258 8 8 258 6 6 257.
EXAMPLE = ([7, 7, 7, 8, 8, 7, 7, 6, 6], [256, 7, 258, 8, 8, 258, 6, 6, 257])


def test_lzw_example_of_the_format():
    values, codes = EXAMPLE
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert list(tiffcodec.unlzw(raw, 9)) == values
    assert tiffcodec.lzw(bytes(values))[: len(raw)] == raw


def codes_of(data: bytes) -> bytes:
    """LZW by a table of strings, widths stepped up as the table grows: entry 511 is the first after which codes have ten bits."""
    table, out, width, at = {}, "", 9, 0
    emit = lambda c: f"{c:0{width}b}"
    out, strings, prefix = emit(256), 258, b""
    for b in data:
        if len(prefix + bytes([b])) == 1 or prefix + bytes([b]) in table:
            prefix += bytes([b])
            continue
        out += emit(table.get(prefix, prefix[0]))
        table[prefix + bytes([b])] = strings
        strings += 1
        prefix = bytes([b])
        if strings == 4094:
            out += emit(256)
            table, strings, width = {}, 258, 9
        elif strings in (512, 1024, 2048):
            width += 1
    out += emit(table.get(prefix, prefix[0]))
    strings += 1
    if strings in (512, 1024, 2048):
        width += 1
    out += emit(257)
    return int(out.ljust(-(-len(out) // 8) * 8, "0"), 2).to_bytes(-(-len(out) // 8), "big")


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 30_000), st.sampled_from([1, 2, 3, 30, 256]), st.integers(0, 99))
def test_codecs_round_trip(n, letters, seed):
    data = np.random.default_rng(seed).integers(0, letters, n).astype(np.uint8).tobytes()
    assert tiffcodec.unlzw(tiffcodec.lzw(data), n) == data == tiffcodec.unlzw(codes_of(data), n)
    assert tiffcodec.unpackbits(tiffcodec.packbits(data)) == data
    assert len(tiffcodec.packbits(bytes(1000))) < 20


def by_hand(order, tags, body, at=8):
    """A file of one directory: the body first, then the tags (tag, type, values)."""
    end = at + len(body) + len(body) % 2
    lists, entries = b"", b""
    beyond = end + 2 + 12 * len(tags) + 4
    for tag, kind, values in sorted(tags):
        raw = values if kind == "s" else struct.pack(f"{order}{len(values)}{kind}", *values)
        n = len(raw) if kind == "s" else len(values)
        entries += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4, "s": 2, "B": 1}[kind], n)
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack(f"{order}I", beyond + len(lists))
            lists += raw
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, end)
    return head + body.ljust(end - at, b"\0") + struct.pack(f"{order}H", len(tags)) + entries + struct.pack(f"{order}I", 0) + lists


def test_planes_in_big_endian_order_with_differences():
    x = rng.integers(0, 60_000, (4, 6, 2)).astype(">u2")
    steps = np.concatenate([x[:, :1], x[:, 1:] - x[:, :-1]], 1).astype(">u2")
    parts = [zlib.compress(np.ascontiguousarray(steps[a : a + 2, :, k]).tobytes()) for k in range(2) for a in (0, 2)]
    starts = np.cumsum([8, *map(len, parts)])[:-1].tolist()
    raw = by_hand(">", [(256, "H", [6]), (257, "H", [4]), (258, "H", [16, 16]), (259, "H", [8]), (273, "I", starts), (277, "H", [2]), (278, "H", [2]), (279, "I", [len(p) for p in parts]), (284, "H", [2]), (317, "H", [2])], b"".join(parts))
    (got,) = tiff.decode(raw)
    assert got.shape == (4, 6, 2) and (got == x).all()


def test_many_images_under_one_directory(spark, tmp_path):
    """The number of images stands in the description; they lie one after another."""
    frames = rng.integers(0, 999, (23, 3, 4)).astype(">u2")
    raw = by_hand(">", [(256, "H", [4]), (257, "H", [3]), (258, "H", [16]), (259, "H", [1]), (270, "s", b"ImageJ=1.53\nimages=23\nslices=23\n\0"), (273, "I", [8]), (277, "H", [1]), (278, "H", [3]), (279, "I", [24])], frames.tobytes())
    (tmp_path / "a.tif").write_bytes(raw)
    (tmp_path / "b.tif").write_bytes(tiff.encode([frames[0].astype("<u2"), frames[1].astype("<u2")]))
    assert tiff.page_count(str(tmp_path / "a.tif")) == 23 and tiff.page_count(str(tmp_path / "b.tif")) == 2
    stack = tiff.read_stack(spark, str(tmp_path), run_bytes=5 * 24)
    assert stack.rdd.getNumPartitions() == 6
    rows = sorted(stack.collect(), key=lambda r: r["frame"])
    assert [r["frame"] for r in rows] == list(range(1, 26)) and [r["page"] for r in rows] == [*range(1, 24), 1, 2]
    assert all(np.frombuffer(r["px"], "<u2").tolist() == frames[k if k < 23 else k - 23].ravel().tolist() for k, r in enumerate(rows))


def test_stacks_are_checked(spark, tmp_path):
    (tmp_path / "x_t998_ch00.tif").write_bytes(tiff.encode([np.zeros((2, 2), "<u2")]))
    (tmp_path / "x_t1000_ch00.tif").write_bytes(tiff.encode([np.ones((2, 2), "<u2")]))
    with pytest.raises(Exception, match="leica=True"):
        tiff.read_stack(spark, str(tmp_path)).collect()
    first = lambda df: [np.frombuffer(r["px"], "<u2")[0] for r in sorted(df.collect(), key=lambda r: r["frame"])]
    assert first(tiff.read_stack(spark, str(tmp_path), leica=True)) == [0, 1]
    with pytest.raises(Exception, match="no files remain"):
        tiff.read_stack(spark, str(tmp_path), include="none").collect()
    assert tiff.read_stack(spark, str(tmp_path), include="none", allow_missing=True).count() == 0
    (tmp_path / "x_t999_ch00.tif").write_bytes(tiff.encode([np.ones((2, 3), "<u2")]))
    with pytest.raises(Exception, match="differ in size or kind"):
        tiff.read_stack(spark, str(tmp_path), leica=True).collect()


@pytest.mark.parametrize(("tags", "said"), [({258: ("H", [12])}, "12"), ({259: ("H", [7])}, "compression 7"), ({317: ("H", [9])}, "predictor 9"), ({339: ("H", [6])}, "format"), ({258: ("H", [8]), 339: ("H", [3])}, "format"), ({279: ("I", [5])}, "holds 5 of 8")])
def test_what_is_not_known_is_refused(tags, said):
    own = {256: ("H", [2]), 257: ("H", [2]), 258: ("H", [16]), 259: ("H", [1]), 273: ("I", [8]), 277: ("H", [1]), 278: ("H", [2]), 279: ("I", [8])} | tags
    with pytest.raises(ValueError, match=said):
        tiff.decode(by_hand("<", [(t, *v) for t, v in own.items()], bytes(8)))


def rows_of(pages):
    return [(z, int(y) + 1, int(x) + 1, p[y, x].item()) for z, p in enumerate(pages, 1) for y, x in np.ndindex(*p.shape)]


@pytest.mark.parametrize("options", [{}, {"big": True}, {"compression": "lzw", "predictor": True}, {"compression": "deflate", "tile": (16, 16), "big": True}])
@pytest.mark.parametrize("bits", [8, 16, 32, "single"])
def test_files_are_written_by_page_tasks(spark, tmp_path, bits, options):
    pages = [image("<f4" if bits == "single" else "<u2", 9 + z, 7) for z in range(3)]
    df = spark.createDataFrame(rows_of(pages), f"z int, y int, x int, v {'double' if bits == 'single' else 'long'}")
    target = tmp_path / "new" / "out.tif"
    for _ in range(2):
        tiff.write(df, f"file://{target}", bits, **options)
    got = tiff.decode(target.read_bytes())
    value = (lambda p: np.minimum(255 * p.astype(int), 255)) if bits == 8 else (lambda p: p)
    assert [g.dtype.itemsize for g in got] == [4 if bits == "single" else bits // 8] * 3
    assert all((g == value(p)).all() for g, p in zip(got, pages, strict=True))
    assert [p.name for p in target.parent.iterdir()] == ["out.tif"]
    assert target.read_bytes()[2] == (43 if options.get("big") else 42)


def test_eight_bits_by_the_largest_value(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 1, 0), (1, 1, 2, 50), (1, 1, 3, 200)], "z int, y int, x int, v long")
    tiff.write(df, str(tmp_path / "s.tif"), 8, scale=True)
    assert tiff.decode((tmp_path / "s.tif").read_bytes())[0].tolist() == [[0, 63, 255]]
    tiff.write(df.where("z > 1"), str(tmp_path / "none.tif"))
    assert tiff.decode((tmp_path / "none.tif").read_bytes()) == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 1, 5), (1, 0, 1, 5), (2, 1, 1, 7)], "z int, y int, x int, v long")
    (tmp_path / "a.tif").write_bytes(b"old")
    with pytest.raises(Exception):
        tiff.write(df.selectExpr("z", "if(z = 2, 99999999999, y) AS y", "x", "v"), str(tmp_path / "a.tif"))
    assert [p.name for p in tmp_path.iterdir()] == ["a.tif"] and (tmp_path / "a.tif").read_bytes() == b"old"


def test_stores_without_places_get_one_stream(spark, tmp_path):
    """Pieces of tasks in order, by a task; the same for an append."""
    for stream in (True, False):
        target = tmp_path / f"f{stream}"
        for append in (False, True):
            placed = store.Placed(f"file://{target}", append, stream)
            put = lambda batches: (b for batch in batches for k in batch.column("id").to_pylist() for b in placed.put(3 * k, b"%03d" % k).to_batches())  # noqa: B023, E731
            assert placed.commit(spark.range(12).repartition(5).mapInArrow(put, store.Placed.ROWS)) == 12
        assert target.read_bytes() == b"".join(b"%03d" % k for k in range(12)) * 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["fFalse", "fTrue"]


def test_a_broken_append_is_undone(tmp_path):
    target = tmp_path / "f"
    target.write_bytes(b"abc")
    placed = store.Placed(str(target), append=True)
    placed.write(5, b"xyz")
    assert target.stat().st_size == 11 and store.size_of(str(target)) == 3
    again = store.Placed(str(target), append=True)  # the first driver is gone
    assert again.before == 3 and target.read_bytes() == b"abc"
    again.write(0, b"de")
    again.abort()
    assert target.read_bytes() == b"abc" and store.size_of(str(target)) == 3
