"""Sum-of-squares online packing of token sequences into fixed windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import chunk_table
from .common import blocks, task_numbers, texts_of

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class LevelArray:
    """Open windows by fill level. `counts[h]` is the number of windows filled to h, for 0 < h < size.

    A piece of s ids may open a window or go to any level h with counts[h] > 0 and h + s <= size; it goes where
    the sum of squared counts grows least, and among equals to the fullest window."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size)]

    def level_for(self, s: int) -> int:
        n, top = self.counts, self.size - s
        # squares change by 2 (n[h+s] - n[h]) + 2; a filled window leaves the array, which saves what it would add
        gain = 2 * (n[s : self.size + 1] - n[: top + 1]) + 2
        gain[top] -= 1
        gain[0] = 2 * n[s] + 1 if s < self.size else 0
        gain[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(gain[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Puts a piece (…, length last) into a window; gives the window when it is full."""
        s = piece[-1]
        h = self.level_for(s)
        if h:
            window = self.windows[h].pop()
            self.counts[h] -= 1
        else:
            window = []
        window.append(piece)
        if h + s == self.size:
            return window
        self.windows[h + s].append(window)
        self.counts[h + s] += 1
        return None

    def rest(self) -> Iterator[list]:
        """Closes the array without padding. Open windows stay as they were built: the fullest is joined by the fullest others that fit,
        whole. What it then lacks is cut from one window, that with the longest pieces, until that is used up and another takes its place.
        The last window is cut into falling powers of two."""
        pool: list[tuple] = []
        while window := self._take(self.size):
            gap = self.size - sum(p[-1] for p in window)
            while gap and (more := self._take(gap)):
                window += more
                gap -= sum(p[-1] for p in more)
            while gap and (pool or (pool := self._longest())):
                front, back = _cut(pool.pop(), gap)
                window.append(front)
                gap -= front[-1]
                pool += back
            yield from [window] if not gap else _powers(window)
        yield from _powers(pool)

    def _take(self, most: int) -> list:
        """A window of the highest level up to most, taken out of the array; an empty list without any."""
        levels = np.flatnonzero(self.counts[: most + 1])
        if not len(levels):
            return []
        self.counts[levels[-1]] -= 1
        return self.windows[levels[-1]].pop()

    def _longest(self) -> list:
        """The open window with the most ids a piece, taken out of the array."""
        found = [(h / len(w), h, k) for h in np.flatnonzero(self.counts).tolist() for k, w in enumerate(self.windows[h])]
        if not found:
            return []
        _, h, k = max(found)
        self.counts[h] -= 1
        return self.windows[h].pop(k)


def _cut(piece: tuple, most: int) -> tuple[tuple, list[tuple]]:
    """(the first ids of a piece, most at most; the rest of it, if any, in a list)."""
    doc, ids, tokens, start, length = piece
    if length <= most:
        return piece, []
    return (doc, ids, tokens, start, most), [(doc, ids, tokens, start + most, length - most)]


def _powers(pieces: list[tuple]) -> Iterator[list]:
    """Windows of falling powers of two, one of each at most, that hold the pieces."""
    left, total = pieces[::-1], sum(p[-1] for p in pieces)
    for b in range(total.bit_length() - 1, -1, -1):
        room, window = (total >> b & 1) << b, []
        while room:
            front, back = _cut(left.pop(), room)
            window.append(front)
            left += back
            room -= front[-1]
        if window:
            yield window


def _packer(path: str, size: int):
    def run(batches):
        table, numbers, levels, rows = chunk_table(path), task_numbers(), LevelArray(size), []

        def close(window):
            number, offset = next(numbers), 0
            for doc, ids, tokens, start, length in window:
                rows.append((doc, start, length, ids[4 * start : 4 * (start + length)], tokens, number, offset))
                offset += length

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in blocks(batches, 2 << 20):
            docs = batch.column(0).to_pylist()
            for doc, ids in zip(docs, table.encode(batch.column(1).to_pylist()), strict=True):
                ids += b"\0\0\0\0"
                tokens = len(ids) // 4
                whole = tokens - tokens % size
                for start in range(0, whole, size):
                    close([(doc, ids, tokens, start, size)])
                if tokens > whole:
                    full = levels.place((doc, _Tail(ids, whole), tokens, whole, tokens - whole))
                    if full:
                        close(full)
            yield flush()
        for window in levels.rest():
            close(window)
        yield flush()

    return run


class _Tail:
    """The ids of a document from `start` on, sliced by the document's own offsets."""

    __slots__ = ("ids", "start")

    def __init__(self, ids: bytes, start: int):
        self.ids, self.start = ids[4 * start :], 4 * start

    def __getitem__(self, at: slice) -> bytes:
        return self.ids[at.start - self.start : at.stop - self.start]


def pack_documents(docs: DataFrame, size: int = 1024, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its byte-level BPE ids, then id 0. Its whole windows are sequences of their own; the rest is one
    piece, placed by sum of squares. Each task packs its own split with a level array of `size` counters, so no row
    is shuffled, no group exists to be skewed, and a task that is run again gives the same sequences. A task's last
    open windows are joined whole; the ids of few documents are cut to fill what is left, so no sequence has padding.

    Null or empty text: the single id 0. Null, equal or repeated doc_ids: rows of their own. Empty table: no rows.
    Columns other than doc_id and text are not read. `size` must be a power of two."""
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    return texts_of(docs, doc_id, text).mapInArrow(_packer(path or vocabulary(), size), PIECES)
