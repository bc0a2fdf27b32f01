import math
import random

import numpy as np
import pytest
from pictures import png

from calibra.operators import phash as H
from calibra.sources import datasets as D

SCHEMA = "image string, width int, height int, data binary"


def plain_resize(rows, wanted):
    """One axis of the recipe, a number at a time."""
    out = []
    for row in rows:
        scale = len(row) / wanted
        if scale == 1:
            out.append(list(row))
            continue
        stretch = max(scale, 1.0)
        fresh = []
        for i in range(wanted):
            centre = (i + 0.5) * scale
            lo, hi = max(0, int(centre - 3 * stretch + 0.5)), min(len(row), int(centre + 3 * stretch + 0.5))
            weights = []
            for x in range(lo, hi):
                t = (x - centre + 0.5) / stretch
                if t == 0:
                    weights.append(1.0)
                elif -3 <= t < 3:
                    weights.append(math.sin(math.pi * t) / (math.pi * t) * (math.sin(math.pi * t / 3) / (math.pi * t / 3)))
                else:
                    weights.append(0.0)
            total, acc = sum(weights), 1 << 21
            for x, w in zip(range(lo, hi), weights):
                v = w / total * 4194304
                acc += row[x] * (int(v - 0.5) if v < 0 else int(v + 0.5))
            fresh.append(min(255, max(0, acc >> 22)))
        out.append(fresh)
    return out


def plain_hash(rgb):
    grey = [[(19595 * int(r) + 38470 * int(g) + 7471 * int(b) + 32768) >> 16 for r, g, b in row] for row in rgb]
    small = list(zip(*plain_resize(list(zip(*plain_resize(grey, 64))), 64)))
    cosine = [[math.cos(math.pi * k * (2 * n + 1) / 128) for n in range(64)] for k in range(16)]
    part = [[sum(c * v for c, v in zip(cosine[k], column)) for column in zip(*small)] for k in range(16)]
    low = [[sum(c * v for c, v in zip(cosine[k], row)) for k in range(16)] for row in part]
    flat = sorted(v for row in low for v in row)
    median = (flat[127] + flat[128]) / 2
    return f"{int(''.join('1' if v > median else '0' for row in low for v in row), 2):064x}"


def drawn(seed, height, width):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    waves = sum(rng.normal() * np.cos(rng.normal() * x / 9 + rng.normal() * y / 7 + rng.normal()) for _ in range(6))
    return np.clip(128 + 40 * waves[..., None] + rng.normal(0, 12, (height, width, 3)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("seed, height, width", [(1, 64, 64), (2, 48, 64), (3, 200, 131), (4, 30, 40), (5, 64, 300), (6, 1, 1), (7, 257, 513)])
def test_resize_and_hash_against_a_plain_version(seed, height, width):
    rgb = drawn(seed, height, width)
    grey = H.grey_of(rgb)
    assert H.resized(grey, 64).tolist() == [list(r) for r in zip(*plain_resize(list(zip(*plain_resize(grey.tolist(), 64))), 64))]
    if height > 1:
        assert H.hash_of(rgb) == plain_hash(rgb)


def test_flat_pictures_have_no_bits_from_rounding():
    one, two = (H.hash_of(np.full((50, 70, 3), v, np.uint8)) for v in (13, 200))
    assert one == two == "8" + "0" * 63 and H.hash_of(np.zeros((9, 9, 3), np.uint8)) == "0" * 64


def test_hashes_of_a_table_and_of_files(spark, tmp_path):
    pictures = {f"p{i}": drawn(i, random.Random(i).randint(20, 90), 60) for i in range(6)}
    rows = [(n, p.shape[1], p.shape[0], bytearray(p.tobytes())) for n, p in pictures.items()]
    got = {r.image: r.phash for r in H.perceptual_hash(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {n: plain_hash(p) for n, p in pictures.items()}
    with pytest.raises(Exception, match="is not 61"):
        H.perceptual_hash(spark.createDataFrame([("p", 61, *rows[0][2:])], SCHEMA)).collect()
    assert H.perceptual_hash(spark.createDataFrame([], SCHEMA)).count() == 0
    (tmp_path / "grey").mkdir()
    grey = drawn(9, 40, 50)[..., 0]
    (tmp_path / "grey" / "a.png").write_bytes(png(grey))
    (tmp_path / "grey" / "b.png").write_bytes(png(pictures["p1"]))
    read = D.read_pictures(spark, str(tmp_path / "grey"))
    got = {r.image: r.phash for r in H.perceptual_hash(read).collect()}
    assert got == {"a.png": plain_hash(np.stack([grey] * 3, axis=-1)), "b.png": plain_hash(pictures["p1"])}
    (tmp_path / "grey" / "c.png").write_bytes(b"no picture")
    with pytest.raises(Exception, match="cannot be read"):
        D.read_pictures(spark, str(tmp_path / "grey")).collect()


def test_pictures_of_several_sizes_hash_together_as_alone(spark):
    rng = np.random.default_rng(5)
    some = [rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for h, w in ((48, 64), (48, 64), (64, 48), (48, 64), (30, 20))]
    assert H.hashes_of(np.stack([some[0], some[1], some[3]])) == [plain_hash(some[i]) for i in (0, 1, 3)]
    rows = [(str(i), p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in enumerate(some)]
    frame = spark.createDataFrame(rows, "image string, width int, height int, data binary")
    assert {r.image: r.phash for r in H.perceptual_hash(frame).collect()} == {str(i): plain_hash(p) for i, p in enumerate(some)}
