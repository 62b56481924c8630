"""Vectorised hashing of words and byte windows inside Arrow tasks.

Hashes of short ranges are 64-bit polynomial sums over random byte codes, so any
range's hash is one difference of prefix sums; :func:`mix` spreads the bits
afterwards. Modulo 2**64 such sums collide on long strings of a certain pattern
(Thue-Morse), so ranges over ``SHORT`` units are hashed whole by xxHash.
Everything here is a small helper that a Spark task calls on one Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes hashed at a time; bounds the memory of one step whatever a text's length.
CHUNK = 1 << 19
#: Bytes or code points up to which a range is hashed by a sum.
SHORT = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def long_hashes(out: np.ndarray, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    """Puts the hash of the units themselves in the place of every range over ``SHORT`` units."""
    rows = np.flatnonzero(ends - starts > SHORT)
    if len(rows):
        data, width = memoryview(np.ascontiguousarray(units).view(np.uint8)), units.itemsize
        out[rows] = [xxhash.xxh3_64_intdigest(data[a * width : z * width]) for a, z in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, which must be in order and not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        a, z = int(starts[i]), int(ends[j - 1])
        prefix = np.zeros(z - a + 1, np.uint64)
        np.cumsum(_CODES[raw[a:z]] * powers(_BASE, z - a), out=prefix[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (prefix[e] - prefix[s]) * powers(_INVERSE, z - a)[s]
        i = j
    out = mix(out)
    long_hashes(out, raw, starts, ends)
    return out


def spans(full: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of ``full`` bytes inside the rows; the number of each row's first."""
    start, end = full.copy(), full.copy()
    start[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(full))]
    start[inner] = full[inner]
    end[inner - 1] = full[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all white-space separated, ASCII-lower-cased words; the offset of each row's first."""
    starts, ends, bounds = spans(~_SPACE[raw], offsets)
    return range_hashes(_LOWER[raw], starts, ends), bounds


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes, A-Z lower-cased, and of each run of letters, digits and non-ASCII bytes its start, end and hash; the number of each row's first."""
    raw, offsets = flat(column)
    raw = _LOWER[raw]
    starts, ends, bounds = spans(_TERM[raw], offsets)
    return raw, starts, ends, range_hashes(raw, starts, ends), bounds


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles; a shorter text is one shingle."""
    hashed, bounds = words(*flat(column))
    weights = powers(0xD6E8FEB86659FD93, size + 1)
    n = len(hashed)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        rolled += hashed[k : k + len(rolled)] * weights[k]
    rolled = mix(rolled)
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= size:
            part = np.sort(rolled[a : z - size + 1])
            out.append(part[np.append(True, part[1:] != part[:-1])])
        elif z > a:
            whole = (hashed[a:z] * weights[: z - a]).sum(dtype=np.uint64) + np.uint64(z - a)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same, len(both) - same
