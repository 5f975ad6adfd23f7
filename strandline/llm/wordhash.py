"""Words of many texts as 64-bit hashes, in numpy, and what is frequent among hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
PART = 1 << 19  # bytes that are hashed together, about
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(301, 557, dtype=np.uint64) * _ODD)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]  # words are compared in lower case
_places: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)]


def _place_factors(n: int) -> np.ndarray:
    """A random odd factor for each of n places in a word at least."""
    if len(_places[0]) < n:
        size = max(n, 2 * PART)
        _places[0] = mix(np.arange(1 << 20, (1 << 20) + size, dtype=np.uint64) * _ODD) | np.uint64(1)
    return _places[0]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """Hashes of data[start:end] for rising spans, ends exclusive: the sum of a random value of each byte times a random factor of its
    place, so no rule makes words that collide.

    Spans are hashed some PART bytes at a time; a longer one by itself."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + PART, side="right")))
        high = int(ends[to - 1])
        begin = starts[at:to] - low
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        place = np.arange(high - low, dtype=np.int32)
        place -= np.repeat(begin.astype(np.int32), np.diff(np.append(begin, high - low)))
        np.multiply(values[data[low:high]], _place_factors(high - low)[place], out=sums[1:])
        np.cumsum(sums, out=sums)
        out[at:to] = mix(sums[ends[at:to] - low] - sums[begin] + (ends[at:to] - starts[at:to]).astype(np.uint64) * _ODD)
        at = to
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, text after text; how many words each text has; the word's last byte).

    A word is a stretch of bytes other than space and ASCII 9 to 13; A-Z count as a-z."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    inside = ~SEPARATOR[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    hashes = hash_spans(data, starts, ends, _VALUES)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(lengths + 1)  # where the next text's separator stands
    counts = np.diff(np.searchsorted(starts, begins), prepend=0)
    return hashes, counts, data[ends - 1]


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its `size`-word shingles; with fewer words, of the whole sequence; without words, none."""
    hashes, counts, _ = words_of(texts)
    rows = np.zeros(max(0, len(hashes) - size + 1), dtype=np.uint64)
    for k in range(size):
        rows += hashes[k : k + len(rows)] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
        rows ^= rows >> np.uint64(29)
    rows = mix(rows)
    at = 0
    for n in counts.tolist():
        if n >= size:
            own = np.sort(rows[at : at + n - size + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = np.full(1, n, dtype=np.uint64)
            for k in range(at, at + n):
                own = mix(own + hashes[k : k + 1] * _ODD)
        else:
            own = rows[:0]
        yield own
        at += n


def frequent_in_chunks(parts: Iterable[np.ndarray], chunk: int = 2_000_000, least: int = 4) -> Iterator[pa.RecordBatch]:
    """(key, count) of keys that occur `least` times (two at least) or more among about `chunk` neighbouring ones, and (null, count) of all.

    A key with a share of more than least/chunk of all occurrences is missed in no task, and the sum of its counts is
    short by less than that share."""
    held, size = np.empty(chunk, dtype=np.uint64), 0

    def out() -> pa.RecordBatch:
        keys = held[:size]
        keys.sort()  # in place: one array of a chunk is all that is held
        again = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
        first, last = np.flatnonzero(again[1:] & ~again[:-1]), np.flatnonzero(again[:-1] & ~again[1:])
        counts = last - first + 1  # of keys that occur twice or more
        often = counts >= least
        return pa.RecordBatch.from_arrays(
            [pa.array([*keys[first[often]].view(np.int64).tolist(), None], pa.int64()), pa.array([*counts[often].tolist(), size], pa.int64())],
            ["key", "count"]
        )

    for p in parts:
        while len(p):
            take = min(len(p), chunk - size)
            held[size : size + take] = p[:take]
            size, p = size + take, p[take:]
            if size == chunk:
                yield out()
                size = 0
    if size:
        yield out()
