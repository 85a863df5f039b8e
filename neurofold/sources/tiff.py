"""TIFF images as rows, a page each, and pages to one file.

Read: classic and BigTIFF, strips and tiles, no compression, LZW, Deflate or PackBits with
both predictors, unsigned, signed and float samples of 8 to 64 bits, one sample a pixel or
several, together or in planes; and stacks of many images under one directory, whose
number stands in its description.  A partition is a run of pages, read by their segments,
so that a file may be larger than a task's memory.  What is not known is an error.

Written: grey pages of any of these kinds and 8-bit colours.  Page tasks write at their own
place of one file (see ``store.Placed``); from 4 GB on, or on demand, the file is a BigTIFF.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import tiffcodec as codec
from .planestack import listing, open_file
from .sidecar import leica_name
from .store import Placed

IMAGES = "path string, page int, frame int, h int, w int, bits int, kind string, px binary"
# TIFF tag numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
# Field types and their struct codes, sample formats and their numpy codes.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}
FORMATS = {1: "u", 2: "i", 3: "f"}
#: Bytes of pages that one partition reads.
RUN_BYTES = 32 << 20


class Page:
    """Where a page's pixels lie in a file: the byte order, the image's shape and kind, and its segments."""

    def __init__(self, order: str, tags: dict[int, tuple]):
        one = lambda tag, default=None: tags.get(tag, (default,))[0]
        self.h, self.w, self.samples = one(HEIGHT), one(WIDTH), one(SAMPLES, 1)
        bits, form = set(tags.get(BITS, (1,))), set(tags.get(FORMAT, (1,)))
        code = FORMATS.get(min(form))
        if len(bits) > 1 or len(form) > 1 or min(bits) not in (8, 16, 32, 64) or code is None or (code == "f" and min(bits) < 16):
            raise ValueError(f"TIFF samples of {sorted(bits)} bits and format {sorted(form)} are not known")
        self.kind = np.dtype(f"{code}{min(bits) // 8}").newbyteorder(order)
        self.scheme, self.predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
        self.planes = self.samples if one(PLANAR, 1) == 2 else 1
        tiled = TILE_OFFSETS in tags
        self.size = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS, self.h), self.h), self.w)
        self.segments = list(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True))
        self.tiled = tiled

    @property
    def bytes(self) -> int:
        return self.h * self.w * self.samples * self.kind.itemsize

    def images(self, tags: dict[int, tuple]) -> int:
        """How many images stand one after another from this directory's first byte on."""
        text = tags.get(DESCRIPTION, (b"",))[0].decode("latin-1")
        found = re.search(r"^images=(\d+)", text, re.M) if text.startswith("ImageJ") else None
        return int(found[1]) if found and self.scheme == codec.NONE and not self.tiled else 1

    def moved(self, by: int) -> Page:
        """The page of the same shape in one piece, ``by`` bytes after this one's begin."""
        out = object.__new__(Page)
        out.__dict__.update(self.__dict__, size=(self.h, self.w), segments=[(self.segments[0][0] + by, self.bytes)])
        return out

    def read(self, f) -> np.ndarray:
        """The height x width (x samples) array, segment by segment."""
        each = self.samples // self.planes
        image = np.zeros((self.h, self.w, self.samples), self.kind.newbyteorder("<"))
        h, w = self.size
        down, across = -(-self.h // h), -(-self.w // w)
        for k, (offset, count) in enumerate(self.segments):
            plane, (row, column) = k // (down * across), divmod(k % (down * across), across)
            y, x = row * h, column * w
            rows = h if self.tiled else min(h, self.h - y)
            f.seek(offset)
            data = codec.decoded(self.scheme, f.read(count), rows * w * each * self.kind.itemsize)
            block = codec.samples(data, (rows, w, each), self.kind, self.predictor)
            image[y : y + rows, x : x + w, plane * each : (plane + 1) * each] = block[: self.h - y, : self.w - x]
        return image if self.samples > 1 else image[:, :, 0]


def directories(f) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of every directory of an open file.  Only headers and tags are read."""

    def at(offset: int, form: str) -> tuple:
        f.seek(offset)
        return struct.unpack(form, f.read(struct.calcsize(form)))

    order = {b"II": "<", b"MM": ">"}[at(0, "2s")[0]]
    big = {42: False, 43: True}[at(2, order + "H")[0]]
    count, entry, word = ("Q", "HHQ", "Q") if big else ("H", "HHI", "I")
    room, where = struct.calcsize("=" + word), at(8 if big else 4, order + word)[0]
    while where:
        n, tags = at(where, order + count)[0], {}
        place = where + struct.calcsize("=" + count)
        for _ in range(n):
            tag, kind, number = at(place, order + entry)
            value = place + struct.calcsize("=" + entry)
            if kind in FIELDS:
                form = f"{order}{number}{FIELDS[kind]}"
                tags[tag] = at(value if struct.calcsize(form) <= room else at(value, order + word)[0], form)
            place = value + room
        yield order, tags
        where = at(place, order + word)[0]


def pages_of(f) -> list[Page]:
    """All pages of an open file, those of one-directory stacks by their stride."""
    out = []
    for order, tags in directories(f):
        page = Page(order, tags)
        n = page.images(tags)
        out += [page] if n == 1 else [page.moved(k * page.bytes) for k in range(n)]
    return out


def page_count(path: str) -> int:
    with open_file(path) as f:
        return sum(Page(order, tags).images(tags) for order, tags in directories(f))


def decode(content: bytes) -> list[np.ndarray]:
    """Pages as height x width (x samples) arrays."""
    f = io.BytesIO(content)
    return [p.read(f) for p in pages_of(f)]


class Layout:
    """How a page of a shape and kind stands in a file: a directory, lists that do not fit it, then the segments.

    Segments are ``rows`` rows each, or tiles of ``tile`` rows and columns; a whole page is one segment by default.
    """

    def __init__(self, h: int, w: int, samples: int, kind: str, compression: str = "none", predictor: bool = False, rows: int | None = None, tile: tuple[int, int] | None = None, big: bool = False):
        self.h, self.w, self.samples, self.kind, self.big = h, w, samples, np.dtype(kind), big
        self.scheme, self.tile = codec.SCHEMES[compression], tile
        self.predictor = (codec.FLOAT_PLANES if self.kind.kind == "f" else codec.DIFFERENCES) if predictor else codec.NO_PREDICTOR
        self.size = tile or (min(rows or h, h), w)
        self.down, self.across = -(-h // self.size[0]), -(-w // self.size[1])

    def bodies(self, image: np.ndarray) -> list[bytes]:
        """The coded segments of an image."""
        image = np.ascontiguousarray(image.reshape(self.h, self.w, self.samples).astype(self.kind))
        h, w = self.size
        out = []
        for y in range(0, self.h, h):
            for x in range(0, self.w, w):
                block = image[y : y + h, x : x + w]
                if self.tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                out.append(codec.coded(self.scheme, codec.predicted(block, self.predictor)))
        return out

    def plain_sizes(self) -> list[int]:
        """Bytes of the segments of an uncompressed page."""
        h, w = self.size
        each = w * self.samples * self.kind.itemsize
        return [(h if self.tile else min(h, self.h - y)) * each for y in range(0, self.h, h) for _ in range(self.across)]

    def fields(self, sizes: list[int], body: int) -> list[tuple[int, str, list[int]]]:
        starts = np.cumsum([body, *sizes[:-1]]).tolist()
        offset = "Q" if self.big else "I"
        place = [(TILE_WIDTH, "I", [self.size[1]]), (TILE_HEIGHT, "I", [self.size[0]]), (TILE_OFFSETS, offset, starts), (TILE_COUNTS, offset, sizes)] if self.tile else [(OFFSETS, offset, starts), (ROWS, "I", [self.size[0]]), (COUNTS, offset, sizes)]
        code = {v: k for k, v in FORMATS.items()}[self.kind.kind]
        own = [(WIDTH, "I", [self.w]), (HEIGHT, "I", [self.h]), (BITS, "H", [8 * self.kind.itemsize] * self.samples), (COMPRESSION, "H", [self.scheme]), (PHOTOMETRIC, "H", [2 if self.samples == 3 else 1]), (SAMPLES, "H", [self.samples]), (PLANAR, "H", [1]), (PREDICTOR, "H", [self.predictor]), (FORMAT, "H", [code] * self.samples)]
        return sorted(own + place)

    def head_size(self, segments: int) -> int:
        room = 8 if self.big else 4
        fields = self.fields([0] * segments, 0)
        lists = sum(len(v) * struct.calcsize("=" + k) for _, k, v in fields if len(v) * struct.calcsize("=" + k) > room)
        return (8 + 20 * len(fields) + 8 if self.big else 2 + 12 * len(fields) + 4) + lists

    def length(self, sizes: list[int]) -> int:
        """Bytes of a page in the file, padded to a multiple of eight."""
        return -(-(self.head_size(len(sizes)) + sum(sizes)) // 8) * 8

    def head(self, at: int, sizes: list[int], last: bool) -> bytes:
        """The directory of a page that begins at byte ``at``; the next page follows unless it is the last."""
        count, entry, word, room = ("<Q", "<HHQ", "<Q", 8) if self.big else ("<H", "<HHI", "<I", 4)
        body = at + self.head_size(len(sizes))
        fields, types = self.fields(sizes, body), {"H": 3, "I": 4, "Q": 16}
        out, lists = bytearray(struct.pack(count, len(fields))), bytearray()
        beyond = at + struct.calcsize(count) + len(fields) * (struct.calcsize(entry) + room) + room
        for tag, kind, values in fields:
            raw = struct.pack(f"<{len(values)}{kind}", *values)
            out += struct.pack(entry, tag, types[kind], len(values))
            if len(raw) <= room:
                out += raw.ljust(room, b"\0")
            else:
                out += struct.pack(word, beyond + len(lists))
                lists += raw
        return bytes(out + struct.pack(word, 0 if last else at + self.length(sizes)) + lists)

    def page(self, at: int, bodies: list[bytes], last: bool) -> bytes:
        sizes = list(map(len, bodies))
        return (self.head(at, sizes, last) + b"".join(bodies)).ljust(self.length(sizes), b"\0")


def header(big: bool, pages: bool = True) -> bytes:
    """A file's first bytes; the first page follows at once."""
    first = (16 if big else 8) if pages else 0
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if big else struct.pack("<2sHI", b"II", 42, first)


def encode(pages: list[np.ndarray], **options) -> bytes:
    """Little-endian file of pages; options are those of ``Layout``."""
    out = header(options.get("big", False), bool(pages))
    for k, image in enumerate(pages):
        layout = Layout(*image.shape[:2], image.shape[2] if image.ndim == 3 else 1, image.dtype.newbyteorder("<").str, **options)
        out += layout.page(len(out), layout.bodies(image), k + 1 == len(pages))
    return out


class Part(InputPartition):
    def __init__(self, path: str, number: int, frame: int, pages: list[Page]):
        self.path, self.number, self.frame, self.pages = path, number, frame, pages


class PageReader(DataSourceReader):
    """Options: path (a file or a directory of them), include (pattern of names), indices (1-based positions), leica, strict, missing, run_bytes."""

    def __init__(self, options):
        self.path, self.include = options["path"], options.get("include", ".*")
        self.indices = [int(k) for k in options.get("indices", "").split(",") if k]
        self.run_bytes = int(options.get("run_bytes", RUN_BYTES))
        self.leica, self.strict, self.missing = (options.get(k, "false") == "true" for k in ("leica", "strict", "missing"))

    def files(self) -> list[str]:
        files = [(n, p) for n, p in listing(self.path) if re.search(r"(?i)\.tiff?$", n) and re.search(f"(?i){self.include}", n)]
        files.sort(key=lambda f: leica_name(f[0]) if self.leica else f[0])
        kept = [(n, p) for k, (n, p) in enumerate(files, 1) if not self.indices or k in self.indices]
        if self.strict and not self.leica and any(re.search(r"t[0-9]+_ch0[01]\.tif", n) for n, _ in kept):
            raise ValueError(f"{self.path}: names of instrument files sort by their numbers only with leica=True")
        if self.strict and not kept and not self.missing:
            raise FileNotFoundError(f"{self.path}: no files remain")
        return [p for _, p in kept]

    def partitions(self):
        out, frame, shapes = [], 1, set()
        for path in self.files():
            with open_file(path) as f:
                pages = pages_of(f)
            shapes |= {(p.h, p.w, p.kind.newbyteorder("<").str) for p in pages}
            if self.strict and len(shapes) > 1:
                raise ValueError(f"{path}: pages of one stack differ in size or kind: {sorted(shapes)}")
            first = 0
            while first < len(pages):
                last, held = first, 0
                while last < len(pages) and (last == first or held + pages[last].bytes <= self.run_bytes):
                    held += pages[last].bytes
                    last += 1
                out.append(Part(path, first + 1, frame + first, pages[first:last]))
                first = last
            frame += len(pages)
        return out

    def read(self, part):
        if part is None:  # Spark's stand-in where there are no partitions
            return
        kinds = (pa.string(), *[pa.int32()] * 5, pa.string(), pa.binary())
        names = [c.split()[0] for c in IMAGES.split(", ")]
        with open_file(part.path) as f:
            for k, page in enumerate(part.pages):
                image = page.read(f)
                cells = [part.path, part.number + k, part.frame + k, *image.shape[:2], image.dtype.itemsize * 8, image.dtype.kind, image.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(cells, kinds, strict=True)], names)


class TiffPages(DataSource):
    @classmethod
    def name(cls):
        return "tiffpages"

    def schema(self):
        return IMAGES

    def reader(self, schema):
        return PageReader(self.options)


def read(spark: SparkSession, path: str, include: str = ".*", indices: list[int] | None = None, leica: bool = False) -> DataFrame:
    """Pages of a file or of a directory's files in name order: (path, page, frame, h, w, bits, kind, px row-major).

    page counts inside a file, frame over all files; kind is u, i or f.
    """
    return _read(spark, path, include, indices, leica)


def read_stack(spark: SparkSession, path: str, include: str = ".*", indices: list[int] | None = None, leica: bool = False, allow_missing: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``read`` as one stack: pages must be of one size and kind, no file is an error unless ``allow_missing``, and so are
    instrument names (_tNNN_ch) that are not sorted by their numbers."""
    return _read(spark, path, include, indices, leica, strict="true", missing=str(allow_missing).lower(), run_bytes=run_bytes)


def _read(spark: SparkSession, path: str, include: str, indices: list[int] | None, leica: bool, **more) -> DataFrame:
    if not listing(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(TiffPages)
    options = {"include": include, "leica": str(leica).lower(), "indices": ",".join(map(str, indices or [])), **more}
    return spark.read.format("tiffpages").options(**options).load(path)


def image_of(h: int, w: int, bits: int, kind: str, px: bytes) -> np.ndarray:
    """A page's array."""
    return np.frombuffer(px, f"<{kind}{bits // 8}").reshape(h, w)


def whole(image: np.ndarray) -> np.ndarray:
    """An image as 64-bit integers; values that are none are an error, not cut."""
    if image.dtype.kind == "f" and not (np.isfinite(image).all() and (image == np.trunc(image)).all()):
        raise ValueError("a page of fractions where whole numbers are needed; convert it first")
    return image.astype(np.int64)


def convert(images: DataFrame, kind: str) -> DataFrame:
    """Pages as uint8, uint16 or single without scaling: rounded and held in the range of the new kind."""
    top = {"uint8": 255, "uint16": 65535, "single": None}[kind]
    bits, code = {"uint8": (8, "u"), "uint16": (16, "u"), "single": (32, "f")}[kind]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["px"], f"<{row['kind']}{row['bits'] // 8}").astype(float)
                if top is not None:
                    x = np.clip(np.floor(np.nan_to_num(x) + 0.5), 0, top)
                row |= {"bits": bits, "kind": code, "px": x.astype(f"<{code}{bits // 8}").tobytes()}
                yield pa.RecordBatch.from_pylist([row], batch.schema)

    return images.mapInArrow(run, IMAGES)


def pixels(images: DataFrame, value: str = "bigint") -> DataFrame:
    """(z, y, x, ind, v) of grey pages; z is the page.  v is whole unless ``value`` is double."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                image = image_of(*(row[c] for c in ("h", "w", "bits", "kind", "px")))
                y, x = np.indices(image.shape)
                v = whole(image) if value == "bigint" else image.astype(float)
                cols = [np.full(image.size, row["page"], np.int64), y.ravel() + 1, x.ravel() + 1, x.ravel() * row["h"] + y.ravel() + 1, v.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["z", "y", "x", "ind", "v"])

    return images.mapInArrow(run, f"z bigint, y bigint, x bigint, ind bigint, v {value}")


def write(pixel_rows: DataFrame, path: str, bits: int = 16, scale: bool = False, **options) -> None:
    """(z, y, x, v) as one multi-page file of unsigned pages (bits 8, 16 or 32), or of float pages (bits "single").

    8-bit output takes floor(255 v), by the largest value if ``scale``.  Options: compression (none, lzw, deflate, packbits),
    predictor, rows (of a strip), tile (rows, columns) and big.
    """
    value = F.col("v")
    if bits == 8:
        top = (pixel_rows.agg(F.max("v")).first()[0] or 1) if scale else 1
        value = F.least(F.greatest(F.floor(F.lit(255.0) * F.col("v") / top), F.lit(0)), F.lit(255))
    kind = "<f4" if bits == "single" else f"<u{bits // 8}"
    _save(pixel_rows.select("z", "y", "x", value.cast("double" if bits == "single" else "long").alias("v")), ["v"], path, kind, options)


def write_colour(pixel_rows: DataFrame, path: str, **options) -> None:
    """(z, y, x, red, green, blue) as one multi-page file of 8-bit colours."""
    _save(pixel_rows, ["red", "green", "blue"], path, "u1", options)


def _save(pixel_rows: DataFrame, samples: list[str], path: str, kind: str, options: dict) -> None:
    """A task a page; pages lie in the file in the order of z.

    Places of uncompressed pages follow from their sizes, so that each is made and written once.  Compressed pages are first
    written to files of their own, then moved to their places by as many tasks.
    """
    sizes = pixel_rows.groupBy("z").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    spec = {k: v for k, v in options.items() if k != "big"}
    layout = lambda h, w, big: Layout(h, w, len(samples), kind, big=big, **spec)
    dealt = pixel_rows.select(F.col("z").alias("page_z"), "y", "x", *samples)

    def image_from(pixel: pa.Table, h: int, w: int) -> np.ndarray:
        y, x = pixel.column("y").to_numpy(), pixel.column("x").to_numpy()
        image = np.zeros((h, w, len(samples)), kind)
        for k, name in enumerate(samples):
            image[y - 1, x - 1, k] = pixel.column(name).to_numpy()
        return image

    target = Placed(path)
    try:
        if options.get("compression", "none") == "none":
            lengths = F.udf(lambda h, w, big: layout(h, w, big).length(layout(h, w, big).plain_sizes()), "long")
            pages, big = _places(sizes, lengths, options)

            def put(pixel: pa.Table, place: pa.Table) -> pa.Table:
                h, w, at, last = (place.column(c)[0].as_py() for c in ("h", "w", "at", "last"))
                own = layout(h, w, big)
                return target.put(at, own.page(at, own.bodies(image_from(pixel, h, w)), last))

            written = dealt.groupBy("page_z").cogroup(pages.groupBy("z")).applyInArrow(put, target.ROWS)
        else:

            def stage(pixel: pa.Table, size: pa.Table) -> pa.Table:
                h, w = (size.column(c)[0].as_py() for c in ("h", "w"))
                bodies = layout(h, w, False).bodies(image_from(pixel, h, w))
                file = target.stage(b"".join(bodies))
                return pa.table({"z": size.column("z").cast(pa.int64()), "h": size.column("h").cast(pa.int64()), "w": size.column("w").cast(pa.int64()), "file": [file], "sizes": pa.array([list(map(len, bodies))], pa.list_(pa.int64()))})

            staged = dealt.groupBy("page_z").cogroup(sizes.groupBy("z")).applyInArrow(stage, "z bigint, h bigint, w bigint, file string, sizes array<bigint>")
            # Where each page's file lies and how large it is: a row a page, kept so that no page is made twice.
            rows = staged.collect()
            staged = pixel_rows.sparkSession.createDataFrame(rows, staged.schema) if rows else staged.limit(0)
            lengths = F.udf(lambda h, w, big, own: layout(h, w, big).length(own), "long")
            pages, big = _places(staged, lengths, options, "sizes")

            def move(batches):
                for batch in batches:
                    for row in batch.to_pylist():
                        own = layout(row["h"], row["w"], big)
                        head = own.head(row["at"], row["sizes"], row["last"])
                        body = target.staged(row["file"])
                        done = target.put(row["at"], (head + body).ljust(own.length(row["sizes"]), b"\0"))
                        yield from done.to_batches()

            written = pages.repartition("z").mapInArrow(move, target.ROWS)
        target.commit(written, lambda n: header(big, n > 0))
    except BaseException:
        target.abort()
        raise


def _places(sizes: DataFrame, lengths, options: dict, *more: str) -> tuple[DataFrame, bool]:
    """Pages with where they begin (one row a page), and whether the file needs 64-bit offsets."""
    order = Window.orderBy("z")
    measure = lambda big: lengths("h", "w", F.lit(big), *more)
    big = bool(options.get("big")) or (sizes.agg(F.sum(measure(False))).first()[0] or 0) >= (1 << 32) - 8
    sized = sizes.withColumn("length", measure(big))
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("at", F.lit(16 if big else 8) + before).withColumn("last", F.lead("z").over(order).isNull()), big
