"""Strips and tiles of TIFF images: the coded bytes of one segment to its samples and back."""

from __future__ import annotations

import zlib

import numpy as np

# Compression schemes, predictors and the codes of the variable-width scheme.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NO_PREDICTOR, DIFFERENCES, FLOAT_PLANES = 1, 2, 3
CLEAR, END = 256, 257
SCHEMES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}

#: Code k after a clear has this width: 9 to 12 bits.
_STEP = np.arange(1, 4097)
_WIDTH = np.select([_STEP + 257 < 512, _STEP + 257 < 1024, _STEP + 257 < 2048], [9, 10, 11], 12)
_PLACE = np.append(0, np.cumsum(_WIDTH))


def _codes(bits: np.ndarray, at: int) -> np.ndarray:
    """The codes from bit ``at`` to the next clear or end, or to the end of the data: their widths follow from their number alone."""
    n = int(np.searchsorted(_PLACE, 8 * (len(bits) - 4) - at, "right")) - 1
    where = at + _PLACE[: max(n, 0)]
    byte = where >> 3
    word = (bits[byte].astype(np.int64) << 24) | (bits[byte + 1].astype(np.int64) << 16) | (bits[byte + 2].astype(np.int64) << 8) | bits[byte + 3]
    width = _WIDTH[: len(where)]
    code = (word >> (32 - (where & 7) - width)) & ((1 << width) - 1)
    stop = np.flatnonzero((code == CLEAR) | (code == END))
    if not len(stop) and len(code) == len(_WIDTH):
        raise ValueError("LZW data without a clear code")
    return code[: stop[0] + 1] if len(stop) else code


def unlzw(data: bytes, size: int) -> bytes:
    """A table entry is a stretch of the output so far: what the entry's code gave and the byte after it."""
    bits = np.frombuffer(data + b"\0" * 4, np.uint8)
    out, at = bytearray(), 0
    while len(out) < size:
        codes = _codes(bits, at)
        if not len(codes):
            break
        at += int(_PLACE[len(codes)])
        start, length = [], []
        for code in codes.tolist():
            if code == CLEAR or len(out) >= size:
                break
            if code == END:
                return bytes(out[:size])
            start.append(len(out))
            if code < CLEAR:
                out.append(code)
                length.append(1)
                continue
            source = code - 258
            if source >= len(length):
                raise ValueError("broken LZW data")
            a, n = start[source], length[source] + 1
            out += out[a : a + n]
            if a + n > start[-1]:  # the entry is made by this very code: its last byte is its first
                out.append(out[a])
            length.append(n)
    return bytes(out[:size])


def lzw(data: bytes) -> bytes:
    out, held, table, n_bits, n = bytearray(), 0, {}, 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, n_bits
        held, n_bits = (held << width) | code, n_bits + width
        while n_bits >= 8:
            n_bits -= 8
            out.append(held >> n_bits)
            held &= (1 << n_bits) - 1

    put(CLEAR, 9)
    prefix = b""
    for byte in data:
        longer = prefix + bytes([byte])
        if len(longer) == 1 or longer in table:
            prefix = longer
            continue
        put(table[prefix] if len(prefix) > 1 else prefix[0], int(_WIDTH[n]))
        table[longer] = 258 + n
        n += 1
        prefix = bytes([byte])
        if n == 4094 - 258:
            put(CLEAR, int(_WIDTH[n]))
            table, n = {}, 0
    if prefix:
        put(table[prefix] if len(prefix) > 1 else prefix[0], int(_WIDTH[n]))
        n += 1
    put(END, int(_WIDTH[n]))
    put(0, 7)
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + head + 2]
            i += head + 2
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 2 if head > 128 else 1
    return bytes(out)


def packbits(data: bytes) -> bytes:
    """Runs of three equal bytes or more as runs, the rest as it is."""
    x = np.frombuffer(data, np.uint8)
    cuts = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else [], len(x)).astype(int).tolist()
    out, loose = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(loose), 128):
            out.append(len(loose[k : k + 128]) - 1)
            out.extend(loose[k : k + 128])
        loose.clear()

    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        while b - a >= 3:
            flush()
            n = min(b - a, 128)
            out += bytes([257 - n, data[a]])
            a += n
        loose += data[a:b]
    flush()
    return bytes(out)


def decoded(scheme: int, data: bytes, size: int) -> bytes:
    """The ``size`` bytes of a coded segment."""
    if scheme == NONE:
        out = data[:size]
    elif scheme == LZW:
        out = unlzw(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif scheme == PACKBITS:
        out = unpackbits(data)[:size]
    else:
        raise ValueError(f"TIFF compression {scheme} is not known")
    if len(out) != size:
        raise ValueError(f"a TIFF segment holds {len(out)} of {size} bytes")
    return out


def coded(scheme: int, data: bytes) -> bytes:
    return {NONE: bytes, LZW: lzw, DEFLATE: zlib.compress, PACKBITS: packbits}[scheme](data)


def samples(data: bytes, shape: tuple[int, int, int], kind: np.dtype, predictor: int) -> np.ndarray:
    """Rows x columns x samples of a decoded segment in little-endian order; ``predictor`` is undone."""
    rows, columns, each = shape
    if predictor == FLOAT_PLANES:
        # Each row holds the bytes of its samples by significance, as differences.
        planes = np.frombuffer(data, np.uint8).reshape(rows, -1)
        sums = planes.reshape(rows, -1, each).cumsum(1, dtype=np.uint8).reshape(rows, kind.itemsize, columns * each)
        return np.ascontiguousarray(sums.transpose(0, 2, 1)[:, :, ::-1]).view(kind.newbyteorder("<")).reshape(shape)
    x = np.frombuffer(data, kind).reshape(shape).astype(kind.newbyteorder("<"))
    if predictor == DIFFERENCES:
        bits = x.view(f"<u{kind.itemsize}")
        return bits.cumsum(1, dtype=bits.dtype).view(x.dtype)
    if predictor != NO_PREDICTOR:
        raise ValueError(f"TIFF predictor {predictor} is not known")
    return x


def predicted(x: np.ndarray, predictor: int) -> bytes:
    """The bytes of rows x columns x samples under a predictor: what ``samples`` undoes."""
    x = np.ascontiguousarray(x)
    rows, columns, each = x.shape
    if predictor == DIFFERENCES:
        bits = x.view(f"<u{x.itemsize}")
        return np.concatenate([bits[:, :1], bits[:, 1:] - bits[:, :-1]], 1).tobytes()
    if predictor == FLOAT_PLANES:
        planes = x.view(np.uint8).reshape(rows, columns * each, x.itemsize)[:, :, ::-1].transpose(0, 2, 1).reshape(rows, -1, each)
        return np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], 1).tobytes()
    return x.tobytes()
