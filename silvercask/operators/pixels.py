"""Frames of pixels: rendering, text recognition, masks, in numpy, a batch of frames a call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .codec import decode_rle, encode_rle
from .records import EXPLICIT, RLE

# Sizes and thresholds of the search for text.
CELL = 8
MOST_PIXELS = 1024
CONTRAST = 22
LIT, DARK = 180, 80
LEAST_AREA = 140
ACCEPTED = 0.55

#: Letters of five by seven dots, a row each, from the top.
FONT = {
    "A": "01110 10001 10001 11111 10001 10001 10001", "B": "11110 10001 10001 11110 10001 10001 11110", "C": "01110 10001 10000 10000 10000 10001 01110",
    "D": "11110 10001 10001 10001 10001 10001 11110", "E": "11111 10000 10000 11110 10000 10000 11111", "F": "11111 10000 10000 11110 10000 10000 10000",
    "G": "01110 10001 10000 10111 10001 10001 01111", "H": "10001 10001 10001 11111 10001 10001 10001", "I": "11111 00100 00100 00100 00100 00100 11111",
    "J": "00111 00010 00010 00010 00010 10010 01100", "K": "10001 10010 10100 11000 10100 10010 10001", "L": "10000 10000 10000 10000 10000 10000 11111",
    "M": "10001 11011 10101 10101 10001 10001 10001", "N": "10001 11001 10101 10011 10001 10001 10001", "O": "01110 10001 10001 10001 10001 10001 01110",
    "P": "11110 10001 10001 11110 10000 10000 10000", "Q": "01110 10001 10001 10001 10101 10010 01101", "R": "11110 10001 10001 11110 10100 10010 10001",
    "S": "01111 10000 10000 01110 00001 00001 11110", "T": "11111 00100 00100 00100 00100 00100 00100", "U": "10001 10001 10001 10001 10001 10001 01110",
    "V": "10001 10001 10001 10001 10001 01010 00100", "W": "10001 10001 10001 10101 10101 11011 10001", "X": "10001 10001 01010 00100 01010 10001 10001",
    "Y": "10001 10001 01010 00100 00100 00100 00100", "Z": "11111 00001 00010 00100 01000 10000 11111", "0": "01110 10001 10011 10101 11001 10001 01110",
    "1": "00100 01100 00100 00100 00100 00100 01110", "2": "01110 10001 00001 00110 01000 10000 11111", "3": "11110 00001 00001 01110 00001 00001 11110",
    "4": "00010 00110 01010 10010 11111 00010 00010", "5": "11111 10000 11110 00001 00001 10001 01110", "6": "00110 01000 10000 11110 10001 10001 01110",
    "7": "11111 00001 00010 00100 01000 01000 01000", "8": "01110 10001 10001 01110 10001 10001 01110", "9": "01110 10001 10001 01111 00001 00010 01100",
}


@dataclass
class Image:
    """What is known of a frame's pixels."""

    rows: int
    cols: int
    samples: int = 1
    bits: int = 8
    stored: int | None = None
    signed: bool = False
    photometric: str = "MONOCHROME2"
    padding: float | None = None
    center: float | None = None
    width: float | None = None

    def __post_init__(self):
        self.stored = self.stored or self.bits
        if self.bits not in (8, 16) or self.samples not in (1, 3) or self.photometric.upper() not in ("MONOCHROME1", "MONOCHROME2", "RGB"):
            raise ValueError(f"unsupported pixel organization: {self.bits} bits, {self.samples} samples, {self.photometric}")

    @property
    def kind(self) -> str:
        return ("<i" if self.signed else "<u") + str(self.bits // 8)

    @property
    def most(self) -> float:
        return 2.0 ** min(self.stored, 53) - 1


@dataclass
class Box:
    x: int
    y: int
    w: int
    h: int
    text: str = ""
    confidence: float = 0.0
    frame: int = 0
    polygon: list = field(default_factory=list)


def brightness(pixels: np.ndarray, image: Image) -> np.ndarray:
    """Samples of a frame of one sample a pixel in 8 bits, through the window, with low values white where they mean so."""
    low, high = 0.0, image.most
    if image.center is not None and image.width is not None and image.width > 0:
        low, high = image.center - image.width / 2, image.center + image.width / 2
    if pixels.dtype == np.uint8 and pixels.size > 256:  # what each sample becomes, once
        shown = _window(np.arange(256), image, low, high)
        same = (shown == np.arange(256)).all()
        return pixels.reshape(image.rows, image.cols) if same else shown.take(pixels.reshape(image.rows, image.cols))
    return _window(pixels.reshape(image.rows, image.cols), image, low, high)


def _window(values: np.ndarray, image: Image, low: float, high: float) -> np.ndarray:
    grey = np.clip((values.astype(np.float64) - low) / max(1.0, high - low) * 255, 0, 255)
    grey = 255 - grey if image.photometric.upper() == "MONOCHROME1" else grey
    return np.rint(grey).astype(np.uint8)


def rendered(pixels: np.ndarray, image: Image) -> np.ndarray:
    """Samples of a frame as 8-bit red, green and blue."""
    if image.samples == 3:
        return np.clip(pixels.reshape(image.rows, image.cols, 3), 0, 255).astype(np.uint8)
    return np.repeat(brightness(pixels, image)[:, :, None], 3, 2)


def seen(pixels: np.ndarray, image: Image) -> np.ndarray:
    """What text is looked for in: the brightness, or red, green and blue."""
    return rendered(pixels, image) if image.samples == 3 else brightness(pixels, image)


def templates(font: dict[str, str] = FONT) -> tuple[list[str], np.ndarray]:
    """Letters as 49 dots: without empty columns at their sides, sampled at seven by seven as what is read is."""
    grids = [np.array([[int(d) for d in row] for row in rows.split()]) for rows in font.values()]
    return list(font), np.stack([_sampled(g[:, g.any(0).nonzero()[0].min() : g.any(0).nonzero()[0].max() + 1]) for g in grids])


def _sampled(glyph: np.ndarray) -> np.ndarray:
    y, x = (np.arange(7) * n // 7 for n in glyph.shape)
    return glyph[y][:, x].ravel() > 0


_LETTERS, _DOTS = templates()


def match_glyph(glyph: np.ndarray, letters=None, dots=None) -> tuple[str, float]:
    """The letter whose dots are most like a glyph's, sampled at seven by seven, by Jaccard similarity; none under 0.55."""
    return match_glyphs([glyph], letters, dots)[0] if glyph.size else ("", 0.0)


def match_glyphs(glyphs: list[np.ndarray], letters=None, dots=None) -> list[tuple[str, float]]:
    """match_glyph of several, none of them empty, in one product."""
    letters, dots = (_LETTERS, _DOTS) if letters is None else (letters, dots)
    dots, found = dots.astype(np.float64), np.stack([_sampled(g) for g in glyphs]).astype(np.float64)
    both = found @ dots.T
    either = found.sum(1)[:, None] + dots.sum(1) - both
    score = np.where(either > 0, both / np.maximum(either, 1), 0.0)
    best = score.argmax(1)
    return [((letters[i] if x >= ACCEPTED else ""), float(x)) for i, x in zip(best.tolist(), score[np.arange(len(best)), best])]


def is_contour(patch: np.ndarray) -> bool:
    """Whether the strokes of a patch are too long for writing: runs along its rows, by their mean and variance."""
    h, w = patch.shape
    if w < 8 or h < 6:
        return False
    edge = np.diff(np.pad(patch.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    runs = np.flatnonzero(edge.ravel() < 0) - np.flatnonzero(edge.ravel() > 0)
    if not len(runs):
        return True
    return bool(runs.mean() > h * 0.45 or (runs.mean() > 12 and runs.var() > 25))


def read_patch(patch: np.ndarray, letters=None, dots=None) -> tuple[str, float]:
    """The letters in a patch, cut at empty columns, and how sure they are on the whole."""
    some = np.diff(np.r_[0, patch.any(0).astype(np.int8), 0])
    glyphs = [patch[:, a:b] for a, b in zip(np.flatnonzero(some > 0).tolist(), np.flatnonzero(some < 0).tolist()) if b - a >= 2]
    read = [(letter, score) for letter, score in (match_glyphs(glyphs, letters, dots) if glyphs and len(patch) else []) if letter]
    text, sure = "".join(letter for letter, _ in read), [score for _, score in read]
    return text, round(sum(sure) / len(sure), 2) if sure else 0.0


def _groups(active: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of cells that hang together over one row and two columns, in reading order of their first cell."""
    order = list(map(tuple, np.argwhere(active).tolist()))
    left, out = set(order), []
    for first in order:
        if first not in left:
            continue
        left.discard(first)
        todo = [first]
        y0 = y1 = first[0]
        x0 = x1 = first[1]
        while todo:
            y, x = todo.pop()
            y0, y1, x0, x1 = min(y0, y), max(y1, y), min(x0, x), max(x1, x)
            for near in [(v, u) for v in (y - 1, y, y + 1) for u in (x - 2, x - 1, x, x + 1, x + 2) if (v, u) in left]:
                left.discard(near)
                todo.append(near)
        out.append((x0, y0, x1, y1))
    return out


def find_text(rgb: np.ndarray, frame: int = 0, most_pixels: int = MOST_PIXELS, contrast: int = CONTRAST) -> list[Box]:
    """Boxes with writing in a rendered frame, or in its brightness alone. What stands out from the mean brightness is cut into cells, cells that
    hang together are boxes, and of boxes of a fitting size those are kept in which letters are read."""
    height, width = rgb.shape[:2]
    scale = min(1.0, most_pixels / width, most_pixels / height)
    h, w = (max(16, int(height * scale)), max(16, int(width * scale))) if scale < 1 else (height, width)
    sy, sx = height / h, width / w
    work = rgb[(np.arange(h) * sy).astype(int)][:, (np.arange(w) * sx).astype(int)] if scale < 1 else rgb
    light = work if work.ndim == 2 else (work.astype(np.int64) @ np.array([299, 587, 114])) / 1000
    mean, grey = light.mean(), light.astype(np.uint8, copy=False)
    # Whole numbers beyond a limit are those beyond its floor, or below its ceiling.
    marked = grey > int(min(np.floor(mean + contrast), LIT)) if mean < 128 else grey < int(max(np.ceil(mean - contrast), DARK))
    rows, cols = h // CELL, w // CELL
    cells = marked.view(np.uint8)[: rows * CELL, : cols * CELL].reshape(rows, CELL, cols * CELL).sum(1, dtype=np.uint8)
    active = cells.reshape(rows, cols, CELL).sum(2, dtype=np.uint8) >= 2
    round_ = lambda v: int(np.floor(v + 0.5))
    most_h, most_w, most_area = min(60, round_(h * 0.10)), min(600, round_(w * 0.65)), round_(w * h * 0.05)
    out = []
    for x0, y0, x1, y1 in _groups(active):
        x, y = x0 * CELL, y0 * CELL
        bw, bh = min(w - x, (x1 - x0 + 1) * CELL), min(h - y, (y1 - y0 + 1) * CELL)
        if bw < 16 or bh < 8 or bw * bh < LEAST_AREA or bh > most_h or bw > most_w or bw * bh > most_area:
            continue
        patch = marked[y : y + bh, x : x + bw]
        if is_contour(patch):
            continue
        text, sure = read_patch(patch)
        if text:
            a, b, c, d = round_(x * sx), round_(y * sy), round_(bw * sx), round_(bh * sy)
            out.append(Box(a, b, c, d, text, sure, frame, [[a, b], [a + c, b], [a + c, b + d], [a, b + d]]))
    return out


def masked(pixels: np.ndarray, image: Image, boxes: list[tuple[int, int, int, int]], margin: int = 4, color: str = "none", width: int | None = None) -> np.ndarray:
    """A copy of a frame's samples with boxes (x, y, w, h) filled, a margin around them, and a border where one is asked for."""
    out = pixels.reshape(image.rows, image.cols, image.samples).copy()
    fill = image.padding if image.padding is not None else image.most if image.photometric.upper() == "MONOCHROME1" else 0
    border = max(0, width) if width is not None else 2 if color != "none" else 0
    full = 255 if image.samples == 3 else image.most
    for x, y, w, h in boxes:
        x0, y0, x1, y1 = max(0, x - margin), max(0, y - margin), min(image.cols - 1, x + w + margin), min(image.rows - 1, y + h + margin)
        if x0 > x1 or y0 > y1:
            continue
        part = out[y0 : y1 + 1, x0 : x1 + 1]
        part[:] = np.array(fill).astype(out.dtype)
        if border and color in ("red", "double", "white", "black"):
            yy, xx = np.ogrid[: part.shape[0], : part.shape[1]]
            edge = np.minimum(np.minimum(yy, part.shape[0] - 1 - yy), np.minimum(xx, part.shape[1] - 1 - xx))
            if color == "red" and image.samples == 3:
                part[edge < border] = np.array([255, 0, 0], out.dtype)
            elif color in ("red", "double"):
                part[edge < border] = 0
                part[edge == 0] = np.array(full).astype(out.dtype)
            else:
                part[edge < border] = np.array(full if color == "white" else 0).astype(out.dtype)
    return out


#: Decoders and encoders by transfer syntax: (bytes, image) -> samples, (samples, image) -> bytes or None. Native and
#: run-length frames are built in; others are added by a job that has a library for them.
DECODERS: dict[str, Callable] = {RLE: lambda data, image: np.frombuffer(decode_rle(data, image.rows * image.cols * image.samples * image.bits // 8, image.bits // 8, image.samples), image.kind)}
ENCODERS: dict[str, Callable] = {RLE: lambda pixels, image: encode_rle(np.ascontiguousarray(pixels).astype(image.kind).tobytes(), image.bits // 8, image.samples)}


def decode_frame(data: bytes, syntax: str, image: Image) -> np.ndarray:
    if syntax in DECODERS:
        return DECODERS[syntax](data, image)
    if syntax not in ("1.2.840.10008.1.2", EXPLICIT):
        raise ValueError(f"no decoder for {syntax}")
    want = image.rows * image.cols * image.samples
    return np.frombuffer(data, image.kind, want)


def redact_frames(frames: DataFrame, decide: Callable[[list[Box]], list[bool]], method: str = "aggressive", force: bool = False, **mask) -> DataFrame:
    """frames (instance_id, frame, n_frames, rows, cols, samples, bits, photometric, syntax, burned_in, data) -> instance_id,
    frame, n_boxes, syntax, data, error: writing that ``decide`` points out is masked.

    decide(boxes of a frame, in reading order) says which boxes go. Frames without text burned in (unless forced), and, when sampling, frames out
    of the sample, stay as they are. A frame that cannot be decoded comes out unchanged with an error, for quarantine.
    Null data is an error too. A masked frame keeps its syntax where it can be written, else it has run lengths."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_boxes", "syntax", "data", "error")}
            for r in batch.to_pylist():
                boxes, syntax, data, error = 0, r["syntax"], r["data"], None
                n, f = r["n_frames"] or 1, r["frame"]
                sampled = method == "aggressive" or n == 1 or f % 20 == 0 or f in (n // 2, n - 1)
                try:
                    if (force or (r["burned_in"] or "").strip().upper() in ("YES", "Y", "1")) and sampled:
                        image = Image(r["rows"], r["cols"], r["samples"], r["bits"], photometric=r["photometric"])
                        pixels = decode_frame(data, syntax, image)
                        found = find_text(seen(pixels, image), f)
                        gone = [(b.x, b.y, b.w, b.h) for b, yes in zip(found, decide(found)) if yes]
                        if gone:
                            after, boxes = masked(pixels, image, gone, **mask), len(gone)
                            if syntax in ENCODERS or syntax not in ("1.2.840.10008.1.2", EXPLICIT):
                                syntax = syntax if syntax in ENCODERS else RLE
                                data = ENCODERS[syntax](after, image)
                            else:
                                data = after.astype(image.kind).tobytes()
                except Exception as e:  # noqa: BLE001  (any broken frame is a row of its own, not the end of the job)
                    boxes, error = 0, f"{type(e).__name__}: {e}"[:500]
                for k, v in zip(out, (boxes, syntax, data, error)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("instance_id"), batch.column("frame"), pa.array(out["n_boxes"], pa.int32()), pa.array(out["syntax"], pa.string()), pa.array(out["data"], pa.binary()), pa.array(out["error"], pa.string())], names=["instance_id", "frame", "n_boxes", "syntax", "data", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    wanted = ["instance_id", "frame", "n_frames", "rows", "cols", "samples", "bits", "photometric", "syntax", "burned_in", "data"]
    return frames.select(*wanted).mapInArrow(run, f"instance_id {kinds['instance_id']}, frame {kinds['frame']}, n_boxes int, syntax string, data binary, error string")


@cache
def _letter(c: str, scale: int) -> np.ndarray:
    return np.kron(np.array([[int(d) for d in row] for row in FONT[c].split()]), np.ones((scale, scale), np.uint8))


def drawn(text: str, scale: int = 2, rows: int = 128, cols: int = 512, at: tuple[int, int] = (16, 16), light: int = 255) -> np.ndarray:
    """A dark frame with letters of the font, for tests and queries."""
    out = np.zeros((rows, cols), np.uint8)
    y, x = at
    for c in text:
        if c in FONT:
            g = _letter(c, scale)
            if x + g.shape[1] <= cols:
                out[y : y + g.shape[0], x : x + g.shape[1]] = g * light
        x += 6 * scale
    return out
