"""Hashing over the characters of a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BASE = 0x100000001B3


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit values chosen by ``seed``."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= MIX_B
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a string column as one array of code points, and the bounds of its rows.

    Nulls are rows without characters.
    """
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
        if isinstance(strings, pa.ChunkedArray):
            strings = pa.concat_arrays(strings.chunks)
    strings = strings.cast(pa.large_string()).fill_null("")
    n = len(strings)
    _, offsets, data = strings.buffers()
    bounds = np.frombuffer(offsets, np.int64, n + 1, strings.offset * 8)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and n else np.zeros(0, np.uint8)
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) == len(raw):
        return codes, bounds - bounds[0]
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return codes, chars[bounds - bounds[0]]


def gram_hashes(codes: np.ndarray, q: int, base: int = BASE) -> np.ndarray:
    """A polynomial hash of the ``q`` codes from each place on (``len(codes) - q + 1`` values)."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, power = mix(codes.astype(np.uint64), 1), 1, base
    out, done = None, 0
    while True:
        if q & size:
            part = level[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += size
        if 2 * size > q:
            return out
        level = level[: len(level) - size] * np.uint64(power) + level[size:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])
