"""Hashes of words and of runs of words, with numpy inside tasks.

A word's hash is a sum of its bytes' random numbers times powers of an odd number, mixed; so all words of a batch of
texts are hashed at once from running sums, and no table of words is kept.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash

#: Bytes of a batch for which powers are kept; a longer text has its own.
BUFFER = 2 << 20
FACTOR = 0x9E3779B97F4A7C15
_FACTORS = np.array([FACTOR, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_BYTES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(FACTOR))
_WHITE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR and of its inverse, modulo 2^64."""
    both = []
    for factor in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        steps = np.full(n, factor, np.uint64)
        steps[:1] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


_kept_powers = functools.lru_cache(maxsize=1)(_powers)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of values that depends on nothing else."""
    up, down = _kept_powers(BUFFER) if len(values) < BUFFER else _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * down[starts])


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a buffer of bytes begin and end: runs between ASCII white space."""
    solid = np.zeros(len(buffer) + 2, bool)
    solid[1:-1] = ~_WHITE[buffer]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return sequence_hashes(_BYTES[buffer], starts, ends)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's words: A-Z in lower case, between ASCII white space."""
    parts = [t.encode("utf-8", "replace").lower() for t in texts]
    buffer = np.frombuffer(b"\n".join(parts), np.uint8)
    starts, ends = word_spans(buffer)
    hashes = hash_spans(buffer, starts, ends)
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    return np.split(hashes, np.searchsorted(starts, np.cumsum(lengths)[:-1])) if texts else []


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words; of the whole sequence if it is shorter; none without words."""
    n = min(size, len(words))
    if n == 0:
        return words
    h = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h += words[i : len(words) - n + 1 + i] * _FACTORS[i % len(_FACTORS)]
    return mixed(h)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles. Equal hashes of 64 bits count as equal shingles."""
    return [np.unique(runs(w, size)) for w in word_hashes(texts)]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return shingle_sets([text or ""], size)[0]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a sorted set."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
