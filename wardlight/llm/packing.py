"""Arrays of numbers as small binaries, so that a shuffle carries a few bytes for each."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in byte planes, compressed; planes of zeros cost nothing."""
    raw = np.ascontiguousarray(values, dtype="<u8")
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T)
    return len(raw).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=max(1, 8 * n)), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys by their differences."""
    keys = np.asarray(keys, np.uint64)
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of two; each step can be undone, so that for a fixed b different a stay different."""
    x = np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += np.asarray(b, np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
