"""Sorted 64-bit numbers as small binaries: byte planes of the differences, compressed."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """`values` must be sorted."""
    if not len(values):
        return b""
    diff = np.diff(values, prepend=np.uint64(0))
    wide = max(1, (int(diff.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(diff.view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : blob[0]] = raw.T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in any order."""
    if not len(values):
        return b""
    wide = max(1, (int(values.max()).bit_length() + 7) // 8)
    room = 4 if wide <= 4 else 8
    planes = np.ascontiguousarray(values.astype(f"<u{room}").view(np.uint8).reshape(-1, room)[:, :wide].T)
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_small(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    room = 4 if blob[0] <= 4 else 8
    out = np.zeros((raw.shape[1], room), np.uint8)
    out[:, : blob[0]] = raw.T
    return out.view(f"<u{room}").ravel()


def part_of(values: np.ndarray, parts: int) -> np.ndarray:
    """Parts are equal ranges of the numbers, so sorted numbers have sorted parts."""
    return ((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def edges(values: np.ndarray, parts: int) -> np.ndarray:
    """Of sorted numbers: where each of the `parts` begins, and the end."""
    return np.searchsorted(part_of(values, parts), np.arange(parts + 1))


def present(values: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of the parts that sorted numbers have."""
    own = part_of(values, parts).astype(np.int64)
    return [(int(own[a]), a, b) for a, b in runs(own)]


def runs(values: np.ndarray) -> zip:
    """(start, end) of each run of equal values."""
    if not len(values):
        return zip((), ())
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return zip([0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True)
