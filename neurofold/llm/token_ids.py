"""Token ids of documents as binary files of patched frame-of-reference blocks.

Documents are ordered by doc_id (nulls last, ties by a hash of the text) in ranges; each
range's task tokenises its texts and writes files, the committed names sort in id order.

A file: ``MAGIC``, the blocks, the index of block starts, the table of documents, a footer.
A block holds ``BLOCK`` ids: their minimum is subtracted and the rest packed at one width,
which is the bit length of one of the ``PERCENTILES`` of the block, whichever costs the
fewest bytes; ids above it are exceptions, listed by place with their whole value.  The
index gives random access: ``TokenFile.ids`` reads the blocks of a range and nothing else.

Tokenising: byte-level BPE cuts a text where classes of neighbouring characters differ
before it merges, so texts are cut at such places that are certain (ASCII and Latin
letters, digits, punctuation, a space after any of them), equal pieces are found by their
bytes, and the library encodes each distinct piece once.  Ids are those of the whole
text, as tests compare; tokenizers of another kind get whole texts.

Defined results: null and empty texts hold the end id alone; repeated rows, repeated and
null ids are documents of their own; an empty table gives no files and no rows; extra
columns are ignored; texts that hold a special token's string are encoded as the library
does by default; a missing tokenizer file is an error that names it.  Batches that reach
Python are bounded by spark.sql.execution.arrow.maxBytesPerBatch, or one text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from neurofold.sources.store import Committed, Written, store_of

from .common import chunks, flat, materialise, part_count, text_size

MAGIC, BLOCK = b"NFIDS001", 1024
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 1.0)
#: Ids of a file, beyond which a task begins another; text bytes of a range; text bytes tokenised at once.
FILE_IDS, RANGE_BYTES, CHUNK = 16 << 20, 32 << 20, 8 << 20
#: Distinct pieces and their ids that a worker remembers.
PIECES, POOL = 1_000_000, 8 << 20
FOOTER = struct.Struct("<QQQQ8s")


# ---- blocks


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1]


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All blocks of an array of 32-bit ids, one after another, and where each starts (one more entry: the end)."""
    blobs = []
    for first in range(0, len(ids), 512 * BLOCK):
        blobs += _pack_run(ids[first : first + 512 * BLOCK])
    starts = np.cumsum([0, *map(len, blobs)]).astype(np.uint64)
    return b"".join(blobs), starts


def _pack_run(ids: np.ndarray) -> list[bytes]:
    n = -(-len(ids) // BLOCK)
    # A short last block repeats its last id: that adds no exception and no width.
    x = np.append(ids, np.repeat(ids[-1:], n * BLOCK - len(ids))).astype(np.uint32).reshape(n, BLOCK)
    least = x.min(1)
    x = x - least[:, None]
    length = bit_length(x)
    within = np.bincount((33 * np.arange(n)[:, None] + length).ravel(), minlength=33 * n).reshape(n, 33).cumsum(1)
    # For each percentile the width that covers it, and its cost: packed bits and six bytes an exception.
    widths = np.stack([(within >= p * BLOCK).argmax(1) for p in PERCENTILES], 1)
    cost = widths * BLOCK + 48 * (BLOCK - np.take_along_axis(within, widths, 1))
    width = np.take_along_axis(widths, cost.argmin(1)[:, None], 1)[:, 0]
    out = [b""] * n
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        bits = (x[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        for row, body in zip(rows, packed, strict=True):
            at = np.flatnonzero(length[row] > w)
            out[row] = struct.pack("<IHH", least[row], w, len(at)) + body.tobytes() + at.astype("<u2").tobytes() + x[row, at].astype("<u4").tobytes()
    return out


def unpack_blocks(blob: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of blocks that start at ``starts`` (one more entry: the end) of blob; whole blocks, padding included."""
    raw = np.frombuffer(blob, np.uint8)
    at = starts[:-1].astype(np.int64)
    heads = np.frombuffer(raw[at[:, None] + np.arange(8)].tobytes(), np.dtype([("least", "<u4"), ("width", "<u2"), ("more", "<u2")]))
    out = np.zeros((len(at), BLOCK), np.uint32)
    for w in np.unique(heads["width"]).tolist():
        every = np.flatnonzero(heads["width"] == w)
        size = BLOCK * w // 8
        place = np.arange(BLOCK) * w
        for rows in (every[i : i + 256] for i in range(0, len(every), 256)):
            body = np.zeros((len(rows), size + 8), np.uint8)
            body[:, :size] = raw[at[rows][:, None] + 8 + np.arange(size)]
            value = np.zeros((len(rows), BLOCK), np.uint64)
            for k in range(5):
                value |= body[:, (place >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
            out[rows] = ((value >> (place & 7).astype(np.uint64)) & np.uint64((1 << w) - 1)).astype(np.uint32)
    for row in np.flatnonzero(heads["more"]):
        n, body = int(heads["more"][row]), at[row] + 8 + BLOCK * int(heads["width"][row]) // 8
        where = np.frombuffer(blob, "<u2", n, body)
        out[row, where] = np.frombuffer(blob, "<u4", n, body + 2 * n)
    return (out + heads["least"][:, None]).ravel()


# ---- files


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> bytes:
    """A whole file.  lengths: ids of each document; known: whether it has a doc_id."""
    body, starts = pack_blocks(ids)
    index = len(MAGIC) + len(body)
    table = doc_ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + lengths.astype("<u8").tobytes()
    return MAGIC + body + (starts + np.uint64(len(MAGIC))).astype("<u8").tobytes() + table + FOOTER.pack(index, len(starts) - 1, len(ids), len(lengths), MAGIC)


class TokenFile:
    """A file by its readable source: only the footer, the index and the blocks asked for are read."""

    def __init__(self, source, size: int):
        self.source = source
        index, blocks, self.n_ids, docs, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        tail = self._read(index, size - FOOTER.size - index)
        self.starts = np.frombuffer(tail, "<u8", blocks + 1)
        at = 8 * (blocks + 1)
        self.doc_ids, self.known = np.frombuffer(tail, "<i8", docs, at), np.frombuffer(tail, np.uint8, docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(tail, "<u8", docs, at + 9 * docs).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop) of the file."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        part = self.starts[first : last + 1]
        blob = self._read(int(part[0]), int(part[-1] - part[0]))
        return unpack_blocks(blob, part - part[0])[start - first * BLOCK : stop - first * BLOCK]


def read_slice(path: str, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of one file on any store, by seeks."""
    fs, at = store_of(path)
    with fs.open_input_file(at) as source:
        return TokenFile(source, source.size()).ids(start, stop)


# ---- tokenising

_CLASS = np.zeros(256, np.uint8)
for _c in range(128):
    _CLASS[_c] = 1 if chr(_c).isalpha() else 2 if chr(_c).isdigit() else 4 if chr(_c).isspace() else 3
#: Pieces that may stand in lines of their own: the line break is then a token of its own.
_LINE = re.compile(rb" ?(?:[\x21-\x7e]|[\xc3-\xc5][\x80-\xbf])+")


class Pieces:
    """Ids of whole texts from those of their distinct pieces, which are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if not os.path.exists(path):
            raise FileNotFoundError(f"no tokenizer at {path}: pass the path of a file that driver and executors have")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        before = plan.get("pre_tokenizer") or {}
        self.cuttable = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not plan.get("normalizer") and not (plan["model"].get("dropout") or 0)
        self.special = [t["content"].encode() for t in plan.get("added_tokens", [])]
        self.cuttable = self.cuttable and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in plan.get("added_tokens", []))
        line = self.encode(["\n"])[0]
        self.line = line[0] if self.cuttable and len(line) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.pool, self.first = array("I"), array("q", [0])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each place inside the data whether the tokenizer is certain to cut there, whatever is around it."""
        if not self.cuttable or len(data) < 2:
            return np.zeros(max(len(data) - 1, 0), bool)
        kind = _CLASS[data]
        # U+00C0 to U+017F are letters but for the signs of multiplication and division.
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
        lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
        kind[lead] = kind[lead + 1] = 1
        left, right = kind[:-1], kind[1:]
        sure = (left != right) & (left != 0) & (right != 0) & (left != 4) & ~((data[:-1] == 0x27) & (right == 1)) & ((right != 4) | (data[1:] == 0x20))
        raw = None
        for token in self.special:
            raw = data.tobytes() if raw is None else raw
            at = raw.find(token)
            while at >= 0:
                sure[at : at + len(token) - 1] = False
                at = raw.find(token, at + 1)
        return sure

    def learn(self, new: list[bytes]) -> None:
        """Remembers the ids of pieces."""
        lines, rest = [], []
        for piece in new:
            (lines if self.line is not None and _LINE.fullmatch(piece) else rest).append(piece)
        for group in (lines[i : i + 2000] for i in range(0, len(lines), 2000)):
            ids = np.array(self.encode([b"\n".join(group).decode()])[0], np.uint32)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(ends) != len(group):
                rest += group
                continue
            for piece, a, b in zip(group, np.append(0, ends[:-1] + 1).tolist(), ends.tolist(), strict=True):
                self.keep(piece, ids[a:b].tolist())
        for group in (rest[i : i + 500] for i in range(0, len(rest), 500)):
            for piece, ids in zip(group, self.encode([p.decode(errors="replace") for p in group]), strict=True):
                self.keep(piece, ids)

    def keep(self, piece: bytes, ids: list[int]) -> None:
        self.slots[piece] = len(self.first) - 1
        self.pool.extend(ids)
        self.first.append(len(self.pool))

    def stretches(self, data: np.ndarray, limit: int):
        """(begin, end) of parts of one text of about ``limit`` bytes, cut where the tokenizer is certain to cut."""
        at, longest = 0, max(map(len, self.special), default=0)
        while self.cuttable and len(data) - at > 2 * limit:
            reach = limit
            while at + reach < len(data):
                # A special token that goes on behind the window is not cut.
                sure = np.flatnonzero(self.cuts(data[at : at + reach])[: max(0, reach - longest - 1)])
                if len(sure):
                    break
                reach *= 2
            else:
                break
            yield at, at + int(sure[-1]) + 1
            at += int(sure[-1]) + 1
        yield at, len(data)

    def texts(self, data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has.  A single long text is taken in stretches."""
        if len(offsets) == 2 and len(data) > 2 * limit:
            parts = [self.ids_of(data[a:b], np.array([0, b - a]))[0] for a, b in self.stretches(data, limit)]
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        return self.ids_of(data, offsets)

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > PIECES or len(self.pool) > POOL:
            self.clear()
        at = np.zeros(len(data) + 1, bool)
        at[1:-1] = self.cuts(data)
        at[offsets] = True
        ends = np.flatnonzero(at)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        self.learn([p for p in distinct if p not in self.slots])
        first, pool = np.frombuffer(self.first, np.int64), np.frombuffer(self.pool, np.uint32)
        slots = np.array([self.slots[p] for p in distinct], np.int64)[pieces.indices.to_numpy()]
        begin, n = first[slots], first[slots + 1] - first[slots]
        before = np.append(0, np.cumsum(n))
        ids = pool[np.repeat(begin - before[:-1], n) + np.arange(before[-1])] if len(slots) else np.zeros(0, np.uint32)
        return ids, np.diff(before[np.searchsorted(ends, offsets)])


_WORKER: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """A worker's tokenizer, kept from task to task."""
    if path not in _WORKER:
        _WORKER[path] = Pieces(path)
    return _WORKER[path]


class IdWriter(Committed):
    """Writes rows (doc_id, text) in their order; a task's files are numbered by its partition and their order in it."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.tokenizer, self.end = options["tokenizer"], int(options["end_id"])

    def write(self, batches):
        pieces, files, held, size = pieces_of(self.tokenizer), [], [], 0
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            doc_ids = batch.column("doc_id")
            for i, j in chunks(offsets, CHUNK):
                ids, n = pieces.texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, np.cumsum(n), self.end)
                own = doc_ids.slice(i, j - i)
                held.append((ids, own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), n + 1))
                size += len(ids)
                if size >= FILE_IDS:
                    files.append(self.save(held, len(files)))
                    held, size = [], 0
        if held:
            files.append(self.save(held, len(files)))
        return Written(files)

    def save(self, held: list, number: int) -> tuple[str, str]:
        fs, file = self.fresh()
        with fs.open_output_stream(file) as out:
            out.write(encode_file(*map(np.concatenate, zip(*held, strict=True))))
        return file, f"part-{TaskContext.get().partitionId():07d}-{number:05d}.ids"

    def place(self, files):
        # A folder holds the files of one write.
        fs, at = store_of(self.path)
        for old in fs.get_file_info(pa.fs.FileSelector(at)):
            if old.is_file:
                fs.delete_file(old.path)
        super().place(files)


class TokenIds(DataSource):
    @classmethod
    def name(cls):
        return "tokenids"

    def schema(self):
        return "doc_id bigint, text string"

    def writer(self, schema, overwrite):
        return IdWriter(self.options, overwrite)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Token ids of every row of docs (doc_id, text) as files below path, in ascending doc_id order."""
    docs.sparkSession.dataSource.register(TokenIds)
    ranges = part_count(text_size(docs), RANGE_BYTES)
    # Rows that repeat are told apart by their place, so that no key is larger than a range.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__key"), F.monotonically_increasing_id().alias("__place"))
    order = [F.col("doc_id").asc_nulls_last(), "__key", "__place"]
    ordered = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.write.format("tokenids").option("tokenizer", tokenizer).option("end_id", end_id).mode("overwrite").save(path)


def documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Documents of the files below path, each file read by one task: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (of the ids as little-endian 32-bit integers); with ``ids`` also the ids."""

    def read(batches):
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                buffer = content.as_buffer()
                file = TokenFile(pa.BufferReader(buffer), buffer.size)
                every, ends = file.ids(), np.append(0, np.cumsum(file.lengths))
                cut = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                raw = memoryview(every.astype("<u4").tobytes())
                name = where.rsplit("/", 1)[-1]
                columns = {
                    "file": pa.array([name] * len(cut), pa.string()),
                    "place": pa.array(range(len(cut)), pa.int64()),
                    "doc_id": pa.array(file.doc_ids, mask=~file.known),
                    "first": pa.array(ends[:-1], pa.int64()),
                    "n_tokens": pa.array(file.lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in cut], pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(every, pa.int64()))
                yield from pa.table(columns).to_batches()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(path).select("path", "content")
    schema = "file string, place bigint, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else "")
    rows = materialise(files.mapInArrow(read, schema), "token-documents")
    # Running sums of the files: inside runs of partitions, and over the runs.
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("run", F.floor(F.substring("file", 6, 7).cast("int") / 512))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = totals.select("file", "run", before(W.partitionBy("run").orderBy("file")).alias("inside"))
    runs = totals.groupBy("run").agg(F.sum("n").alias("n")).select("run", before(W.orderBy("run")).alias("over"))
    starts = inside.join(runs, "run").select("file", (F.col("inside") + F.col("over")).alias("before"))
    out = rows.join(starts, "file").withColumn("start", (F.col("before") + F.col("first")).cast("long"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))
