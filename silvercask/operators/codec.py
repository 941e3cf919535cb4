"""Run-length frames (PackBits segments) and frame masks, in numpy, a frame a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack_bits(data: bytes) -> bytes:
    """Runs of equal bytes (2 to 128) as a count and the byte, what is between them as literals, padded to even."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return b""
    start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    size = np.diff(np.r_[start, len(b)])
    out, literal = bytearray(), 0  # literal: where the open literal begins

    def flush(to):
        for a in range(literal, to, 128):
            part = data[a : min(a + 128, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):  # runs of two save nothing within literals
        flush(a)
        for c in range(0, n, 128):
            m = min(128, n - c)
            out.extend((257 - m, data[a]) if m > 1 else (0, data[a]))
        literal = a + n
    flush(len(b))
    return bytes(out) + b"\0" * (len(out) % 2)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def encode_rle(frame: bytes, width: int = 1, samples: int = 1) -> bytes:
    """A frame of samples of ``width`` bytes as a header of 16 numbers and a segment for each byte of each sample, high
    bytes first. At most 15 segments; a frame holds whole pixels."""
    if width * samples > 15 or len(frame) % (width * samples):
        raise ValueError("a frame has whole pixels of at most 15 bytes")
    planes = np.frombuffer(frame, np.uint8).reshape(-1, samples, width)
    parts = [pack_bits(planes[:, s, w].tobytes()) for s in range(samples) for w in range(width - 1, -1, -1)]
    header = np.zeros(16, "<u4")
    header[0], header[1 : 1 + len(parts)] = len(parts), 64 + np.cumsum([0, *map(len, parts)])[:-1]
    return header.tobytes() + b"".join(parts)


def decode_rle(data: bytes, size: int, width: int | None = None, samples: int = 1) -> bytes:
    """The ``size`` bytes of a frame. Without width, all segments are bytes of one sample."""
    if len(data) < 64:
        raise ValueError("a frame begins with 64 bytes")
    header = np.frombuffer(data, "<u4", 16)
    n = int(header[0])
    width = width or n
    if n != width * samples or not 1 <= n <= 15 or size % n:
        raise ValueError(f"{n} segments do not make {samples} samples of {width} bytes")
    ends = [*header[2 : n + 1].tolist(), len(data)]
    planes = [np.frombuffer(unpack_bits(data[a:b], size // n), np.uint8) for a, b in zip(header[1 : n + 1].tolist(), ends)]
    if any(len(p) != size // n for p in planes):
        raise ValueError("a segment is too short")
    return np.stack(planes, 1).reshape(-1, samples, width)[:, :, ::-1].tobytes()


@F.pandas_udf(T.BinaryType())
def rle(frame: pd.Series) -> pd.Series:
    """A frame of bytes, packed; null stays null."""
    return frame.map(lambda b: None if b is None else encode_rle(bytes(b)))


@F.pandas_udf(T.BinaryType())
def unrle(data: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else decode_rle(bytes(d), int(n)) for d, n in zip(data, size)])


def sampled_frames(n: Column) -> Column:
    """First, middle, last and every twentieth; none of none."""
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda f: (f % 20 == 0) | (f == F.floor(n / 2)) | (f == n - 1))).otherwise(F.array().cast("array<int>"))


def mask(x: Column, y: Column, w: Column, h: Column, cols: Column, rows: Column, margin: int = 4) -> Column:
    """The first and last column and row of a box with a margin, within the image."""
    lo = lambda c: F.greatest(F.lit(0), F.floor(c - margin)).cast("int")
    hi = lambda c, most: F.least(most - 1, F.ceil(c + margin)).cast("int")
    return F.struct(lo(x).alias("x0"), lo(y).alias("y0"), hi(x + w, cols).alias("x1"), hi(y + h, rows).alias("y1"))
