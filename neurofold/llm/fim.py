"""Fill-in-middle: a text is cut into prefix, middle and suffix, which change places around sentinels.

A text is decoded to an array of its code points.  Where the classes of two neighbours
differ there is a boundary (``unit`` says which classes: every code point its own, runs of
white space and of other characters, or lines); two boundaries, chosen by rank from a hash
of the doc_id, end the prefix and the middle, and the pieces are encoded again.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle and
``plain`` the text itself: empty texts, texts that hold a sentinel, and a share by hash.
As texts with a sentinel stay plain and no sentinel overlaps itself, ``restore`` finds the
pieces again from output and form alone.

Defined results: a null text is empty; a null doc_id is hashed as no digits; repeated rows
and ids give the same result each; bytes that are not UTF-8 count as a code point each and
come back as they were; an empty table gives an empty result; extra columns are ignored.
Batches that reach Python are bounded by spark.sql.execution.arrow.maxBytesPerBatch, or
one text; rewriting is inside the row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, flat

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 hash values, how many are rewritten, and how many of those as spm.
REWRITTEN, SPM = 90, 20
SPACES = np.array([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20], np.uint32)


def code_points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")


def encoded(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """Neighbours of different classes belong to different units."""
    if unit == "codepoint":
        return np.arange(len(points))
    if unit == "word":
        return np.isin(points, SPACES)
    if unit == "line":
        return np.cumsum(np.append(0, points[:-1] == 0x0A)) if len(points) else np.zeros(0, int)
    raise ValueError(f"unit {unit!r} is none of codepoint, word, line")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Begin of every unit, and the end of the text."""
    kind = classes(points, unit)
    return np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(points)]]) if len(points) else np.zeros(1, int)


def rewrite(raw: bytes, doc_id: int | None, unit: str = "codepoint", seed: int = 1) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, code points of prefix and middle, and output of one text."""
    points = code_points(raw)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    marks = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    if not len(points) or h[2] % 100 >= REWRITTEN or any(m in raw for m in marks):
        return len(points), "plain", None, None, raw
    ends = boundaries(points, unit)
    first, second = (int(ends[rank]) for rank in sorted((h[0] % len(ends), h[1] % len(ends))))
    prefix, middle, suffix = (encoded(points[a:b]) for a, b in ((0, first), (first, second), (second, len(points))))
    p, s, m = marks
    spm = h[3] % 100 < SPM
    out = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return len(points), "spm" if spm else "psm", first, second - first, out


def rebuilt(output: bytes, form: str) -> bytes:
    """The text of an output."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    begin, between = (s, p) if form == "spm" else (p, s)
    one, rest = output[len(begin) :].split(between, 1)
    two, middle = rest.split(m, 1)
    return two + middle + one if form == "spm" else one + middle + two


def strings(values: list[bytes]) -> pa.Array:
    """Byte strings as a string column, whatever bytes they hold."""
    return pc.cast(pa.array(values, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))


def fill_in_middle(docs: DataFrame, unit: str = "codepoint", seed: int = 1) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars (null if plain) and output of every row of docs (doc_id, text)."""
    classes(np.zeros(0, np.uint32), unit)

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in chunks(offsets):
                rows = [rewrite(data[offsets[k] : offsets[k + 1]].tobytes(), ids[k], unit, seed) for k in range(i, j)]
                n, form, prefix, middle, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j], pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), strings(out)],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rewritten: DataFrame) -> DataFrame:
    """rewritten with a column ``restored``: the exact text, from output and form."""
    columns = rewritten.columns

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("output"))
            forms = batch.column("form").to_pylist()
            for i, j in chunks(offsets):
                texts = [rebuilt(data[offsets[k] : offsets[k + 1]].tobytes(), forms[k]) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, strings(texts)], [*columns, "restored"])

    return rewritten.mapInArrow(run, T.StructType([*rewritten.schema.fields, T.StructField("restored", T.StringType())]))
