"""Words of many texts at once, as numpy positions and 64-bit hashes."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes that are no word bytes: white space alone, or all but ASCII letters, digits and non-ASCII.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
_K1, _K2 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes with 40 zero bytes behind, so that 8-byte loads never leave the buffer."""
    out = np.zeros(len(data) + 40, np.uint8)
    out[: len(data)] = data
    return out


def loads(buffer: np.ndarray) -> np.ndarray:
    """A view with the little-endian 8-byte number at every byte."""
    return np.ndarray((len(buffer) - 7,), np.dtype("<u8"), buffer, 0, (1,))


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text its first word's number (one more at the end)."""
    inside = word_byte[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts[offsets[full]] = inside[offsets[full]]
    ends[offsets[full + 1] - 1] = inside[offsets[full + 1] - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * _K1
    h = (h ^ (h >> U64(29))) * _K2
    return h ^ (h >> U64(32))


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; the buffer comes from padded()."""
    view = loads(buffer)
    size = ends - starts
    h = mixed(size.astype(U64) + _K2)
    out, rest, at, left, state = h, None, starts, size, h
    while True:
        state = mixed(state ^ (view[at] & _MASKS[np.minimum(left, 8)]))
        if rest is None:
            out = state
        else:
            out[rest] = state
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        rest = more if rest is None else rest[more]
        at, left, state = at[more] + 8, left[more] - 8, state[more]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, one for each start; texts' borders are the caller's."""
    count = max(len(words) - n + 1, 0)
    h = np.full(count, U64(n))
    for k in range(n):
        h = (h ^ words[k : k + count]) * _K1
        h ^= h >> U64(29)
    return mixed(h)


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All word numbers at which n words of one text start, and each text's number of them."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    return ranges(first[:-1], counts), counts


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... count times for each pair, one behind the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def code_points(data: np.ndarray) -> np.ndarray:
    """At each byte, how many code points start before it; one more at the end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
