"""Pictures given as grey or colour values: perceptual hash, colour histogram, their comparison, and boxes on a page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _shrunk(grey: np.ndarray, size: int) -> np.ndarray:
    """Means of size x size areas; a picture smaller than that is repeated up to it."""
    grey = np.repeat(grey, -(-size // grey.shape[0]), 0) if grey.shape[0] < size else grey
    grey = np.repeat(grey, -(-size // grey.shape[1]), 1) if grey.shape[1] < size else grey
    rows = np.add.reduceat(grey, np.arange(size) * grey.shape[0] // size, 0)
    both = np.add.reduceat(rows, np.arange(size) * grey.shape[1] // size, 1)
    count = np.outer(np.diff([*(np.arange(size) * grey.shape[0] // size), grey.shape[0]]), np.diff([*(np.arange(size) * grey.shape[1] // size), grey.shape[1]]))
    return both / count


def perceptual_hash(pixels: bytes | None, w: int | None, h: int | None) -> str | None:
    """16 hex digits: the signs of the 8 x 8 lowest cosine coefficients of a 32 x 32 picture against their median. Null for what is no picture."""
    if not pixels or not w or not h or w <= 0 or h <= 0 or len(pixels) < w * h:
        return None
    small = _shrunk(np.frombuffer(pixels, np.uint8, w * h).reshape(h, w).astype(float), 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def without_text(pixels: bytes | None, w: int | None, h: int | None, boxes: list | None) -> bytes | None:
    """The grey picture with its text boxes (x0, y0, x1, y1) filled by the median of what is just around them."""
    if not pixels or not w or not h or len(pixels) < w * h:
        return pixels
    grey = np.frombuffer(pixels, np.uint8, w * h).reshape(h, w).copy()
    for box in boxes or ():
        x0, y0, x1, y1 = (int(v) for v in box)
        x0, y0, x1, y1 = max(0, x0), max(0, y0), min(w, x1), min(h, y1)
        if x1 > x0 and y1 > y0:
            around = np.concatenate([grey[max(0, y0 - 2) : y0, x0:x1].ravel(), grey[y1 : y1 + 2, x0:x1].ravel(), grey[y0:y1, max(0, x0 - 2) : x0].ravel(), grey[y0:y1, x1 : x1 + 2].ravel()])
            grey[y0:y1, x0:x1] = int(np.median(around)) if len(around) else 255
    return grey.tobytes()


def colour_histogram(pixels: bytes | None, bins: int = 8) -> list[float] | None:
    """Shares of the pixels in ``bins`` equal ranges of red, then green, then blue; null without pixels."""
    if not pixels or len(pixels) < 3:
        return None
    rgb = np.frombuffer(pixels, np.uint8, len(pixels) // 3 * 3).reshape(-1, 3)
    return [float(x) for c in range(3) for x in np.bincount(rgb[:, c] // (256 // bins), minlength=bins) / len(rgb)]


def verified(a: list[float] | None, b: list[float] | None, confidence: float) -> float:
    """A match's confidence after its histograms: kept from a correlation of 0.70, six tenths of it from 0.40, else 0; kept where a histogram is missing."""
    if a is None or b is None or len(a) != len(b):
        return confidence
    x, y = np.asarray(a) - np.mean(a), np.asarray(b) - np.mean(b)
    norm = float(np.sqrt((x * x).sum() * (y * y).sum()))
    r = float((x * y).sum()) / norm if norm else float(np.allclose(a, b))
    return confidence if r >= 0.70 else confidence * 0.6 if r >= 0.40 else 0.0


def merge_boxes(boxes: list | None, gap: float = 10.0) -> list[list[float]]:
    """Boxes (x0, y0, x1, y1) with those at most ``gap`` apart put together until none are; in order of their corners."""
    now = [list(map(float, b)) for b in boxes or () if b is not None and len(b) == 4]
    while True:
        out: list[list[float]] = []
        for b in sorted(now):
            near = [o for o in out if o[0] - gap <= b[2] and b[0] - gap <= o[2] and o[1] - gap <= b[3] and b[1] - gap <= o[3]]
            for o in near:
                out.remove(o)
            group = [b, *near]
            out.append([min(g[0] for g in group), min(g[1] for g in group), max(g[2] for g in group), max(g[3] for g in group)])
        if len(out) == len(now):
            return sorted(out)
        now = out


@F.pandas_udf(T.StringType())
def perceptual_hash_of(pixels: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series([perceptual_hash(*x) for x in zip(pixels, w, h, strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def colour_histogram_of(pixels: pd.Series) -> pd.Series:
    return pixels.map(colour_histogram)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def merged_boxes(boxes: pd.Series) -> pd.Series:
    return boxes.map(lambda b: merge_boxes(None if b is None else list(b)))
