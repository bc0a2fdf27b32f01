"""The perceptual hash of pictures: grey, a windowed-sinc resize in whole numbers, cosine frequencies against their median."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from calibra.operators.batches import pictures_of

#: Fixed values of the published recipe: weights of red, green and blue in 65,536ths; bits of a resize weight; lobes of the sinc.
GREY = (19595, 38470, 7471)
WEIGHT_BITS, LOBES = 22, 3
#: Bits a side, and how many times as large the picture is that the frequencies are taken of.
SIDE, OVERSIZE = 16, 4
#: Pixel rows resized at once.
ROWS = 256


def grey_of(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(np.int32) * np.int32(w) for i, w in enumerate(GREY))
    return (r + g + b + (1 << 15)) >> 16


def _sinc(x: float) -> float:
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)


@functools.lru_cache(maxsize=256)
def resize_weights(size: int, wanted: int) -> np.ndarray:
    """A row of whole-number weights over `size` pixels for each of the wanted ones."""
    scale = size / wanted
    stretch = max(scale, 1.0)
    reach = LOBES * stretch
    out = np.zeros((wanted, size))
    for i in range(wanted):
        centre = (i + 0.5) * scale
        first, last = max(0, int(centre - reach + 0.5)), min(size, int(centre + reach + 0.5))
        at = [(x - centre + 0.5) / stretch for x in range(first, last)]
        weights = [_sinc(v) * _sinc(v / LOBES) if -LOBES <= v < LOBES else 0.0 for v in at]
        total = sum(weights)
        for x, w in zip(range(first, last), weights, strict=True):
            scaled = (w / total if total else w) * (1 << WEIGHT_BITS)
            out[i, x] = int(scaled - 0.5 if scaled < 0 else scaled + 0.5)
    return out


def _along_rows(pixels: np.ndarray, wanted: int) -> np.ndarray:
    """Each row resized and rounded to 0..255. Products and sums are whole numbers far below 2^53, so doubles hold them exactly."""
    if pixels.shape[-1] == wanted:
        return pixels
    weights = resize_weights(pixels.shape[-1], wanted).T
    parts = [pixels[..., a : a + ROWS, :].astype(float) @ weights for a in range(0, pixels.shape[-2], ROWS)]
    sums = np.concatenate(parts, axis=-2).astype(np.int64) + (1 << (WEIGHT_BITS - 1))
    return np.clip(sums >> WEIGHT_BITS, 0, 255)


def resized(grey: np.ndarray, wanted: int) -> np.ndarray:
    """Grey pictures made wanted x wanted: first their rows, then their columns, rounded after each."""
    return _along_rows(_along_rows(grey, wanted).swapaxes(-1, -2), wanted).swapaxes(-1, -2)


@functools.lru_cache(maxsize=4)
def _cosines(side: int, n: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(side)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


def hashes_of(rgb: np.ndarray, side: int = SIDE) -> list[str]:
    """side * side bits in hex for each picture of one size, row by row: whether a low frequency is above the median of all low ones.

    Frequencies below a billionth of the greatest count as 0, so a picture without such has no bits from rounding.
    """
    n = side * OVERSIZE
    cosines = _cosines(side, n)
    low = (cosines @ resized(grey_of(rgb), n).astype(float) @ cosines.T).reshape(len(rgb), -1)
    low[np.abs(low) < 1e-9 * np.abs(low).max(axis=1, initial=0)[:, None]] = 0.0
    bits = low > np.median(low, axis=1)[:, None]
    digits = bits.shape[1] // 4
    # Bits that do not fill a byte are led by zeros.
    led = np.pad(bits, ((0, 0), (-bits.shape[1] % 8, 0)))
    return [row.tobytes().hex().lstrip("0").rjust(digits, "0") for row in np.packbits(led, axis=1)]


def hash_of(rgb: np.ndarray, side: int = SIDE) -> str:
    return hashes_of(rgb[None], side)[0]


#: Pixels of pictures of one size that are hashed together.
TOGETHER = 1 << 16


def perceptual_hash(pictures: DataFrame, side: int = SIDE) -> DataFrame:
    """image and phash of pictures(image, width, height, data as RGB bytes). A picture whose size differs from its data is an error."""

    def hashed(some: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in some], pa.string()), pa.array(hashes_of(np.stack([p for _, p in some]), side), pa.string())], ["image", "phash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[str, np.ndarray]] = []
        for name, rgb, _ in pictures_of(batches):
            if some and (rgb.shape != some[0][1].shape or len(some) * rgb[..., 0].size >= TOGETHER):
                yield hashed(some)
                some = []
            some.append((name, rgb))
        if some:
            yield hashed(some)

    return pictures.select("image", "width", "height", "data").mapInArrow(run, "image string, phash string")
