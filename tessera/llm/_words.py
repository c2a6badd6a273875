"""Words of whole Arrow string columns as 64-bit hashes, a megabyte of text at a time.

The text stays in Arrow's UTF-8 buffer. A word's hash is the sum of a table value of each byte times a random number of its place in the word,
modulo 2**64, taken from prefix sums. Two different words share it with a probability of 2**-57 at most, over the choice of the random numbers,
whatever the words are (a polynomial modulo 2**64 would not do: it takes some long words for the same). Runs of words are hashed as
a tree, each node a mixed combination of two halves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1


def _mask(spans) -> np.ndarray:
    out = np.ones(256, bool)
    for a, b in spans:
        out[a : b + 1] = False
    return out


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (the latter after lower-casing) as bytes of a word.
PLAIN = _mask([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _mask([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


@functools.cache
def _table(lower: bool) -> np.ndarray:
    # the lowest bits are the byte, so that the difference of two values isn't a multiple of 256
    table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) << U64(8) | np.arange(256, dtype=np.uint64)
    if lower:
        table[65:91] = table[97:123]
    return table


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, which: str = "up") -> np.ndarray:
    """The first n powers of an odd number modulo 2**64, or of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have) < n:
        step = _ODD if which == "up" else pow(_ODD, -1, 1 << 64)
        size = max(n, 2 * CHUNK)
        have = np.full(size, step, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 16 * CHUNK:
            _POWERS[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows, of about `most` bytes or one longer row."""
    data, offs = buffers(column)
    n, row = len(offs) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        yield row, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def spans(data: np.ndarray, offs: np.ndarray, keep: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; none crosses a row's edge."""
    w = np.zeros(len(data) + 2, bool)
    np.take(keep, data, out=w[1:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    now, before = w[1:], w[:-1]
    return np.flatnonzero(now & (~before | cut)), np.flatnonzero(before & (~now | cut))


@functools.cache
def _factors(n: int) -> np.ndarray:
    """A random number for each place in a word."""
    return mix(mix(np.arange(n, dtype=np.uint64) * U64(_ODD) + U64(0x5851F42D4C957F2D)) + U64(_ODD))


def _hash(data, start, end, lower):
    if not len(start):
        return np.zeros(0, np.uint64)
    gaps = np.diff(start, append=len(data))
    longest = int(gaps.max())
    factors = _factors(1 << 16) if longest <= 1 << 16 else _factors.__wrapped__(longest)
    sums = np.zeros(len(data) + 1, np.uint64)
    first = start[0]
    place = np.arange(first, len(data)) - np.repeat(start, gaps)
    np.cumsum(_table(lower)[data[first:]] * factors[place], out=sums[first + 1 :])
    return mix(sums[end] - sums[start] + (end - start).astype(np.uint64))


def hashes(data: np.ndarray, offs: np.ndarray, keep: np.ndarray = PLAIN, lower: bool = False, edges: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each row). A row over 8 chunks long is taken in parts cut between words. `edges` are what `spans` gives, if known."""
    if len(data) <= 8 * CHUNK:
        start, end = edges or spans(data, offs, keep)
        return _hash(data, start, end, lower), np.diff(np.searchsorted(start, offs))
    parts, counts = [], []
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        had = len(parts)
        while a < b:
            cut = min(a + 4 * CHUNK, b)
            while cut < b and keep[data[cut]]:
                step = np.flatnonzero(~keep[data[cut : cut + CHUNK]])
                cut = cut + int(step[0]) if len(step) else min(cut + CHUNK, b)
            own = data[a:cut]
            start, end = spans(own, np.array([0, len(own)]), keep)
            parts.append(_hash(own, start, end, lower))
            a = cut
        counts.append(sum(map(len, parts[had:])))
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.array(counts)


def _later(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def rolling(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the `size` words from each word on, whether they lie in one row); as many as there are words."""
    out, done, half, now = None, 0, words, 1
    while True:  # runs of 1, 2, 4, ... words; those of the binary digits of `size` make the whole
        if size & now:
            out = half if out is None else mix(out * U64(_ODD) + _later(half, done))
            done += now
        if 2 * now > size:
            break
        half = mix(half * U64(_ODD) + _later(half, now))
        now *= 2
    ends = np.repeat(np.cumsum(counts), counts)
    return mix(out + U64(size)), np.arange(len(words)) + size <= ends


def second(words: np.ndarray, size: int) -> np.ndarray:
    """32 bits of another hash of the `size` words from each word on, by which equal hashes of different words are told apart."""
    n = len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words ^ U64(0xD1B54A32D192ED03)) * powers(n), out=sums[1:])
    at = np.arange(n)
    return (mix((sums[np.minimum(at + size, n)] - sums[at]) * powers(n, "down")) >> U64(32)).astype(np.uint32)
