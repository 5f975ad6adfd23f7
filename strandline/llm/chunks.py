"""Byte-level BPE ids of whole texts, with a table of the pieces between spaces. Special tokens in a text are such, as they are by default in the library."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .wordhash import hash_spans, mix

#: A space or line end that no visible character follows, or a zero byte: such texts are cut the slow way.
_ODD = re.compile(r"[ \n](?=\s|\Z)|\0")
_CUT = re.compile(r"(?= \S)")


#: What keeps the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as numbers; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


class ChunkTable:
    """Ids of chunks by the hash of their bytes and of what stands before them: a sorted table into one flat array of ids.

    The pre-tokeniser's pattern never matches across a space that a visible character follows, nor across a
    single line end between two visible characters, so a text's ids are those of its chunks in turn: the text's head, then
    pieces that begin with a space or a line end. A chunk is also compared with the bytes behind its hash. Bounded: it is emptied when it has `most` chunks.

    The library takes special tokens out of a text before anything else, so the stretches between them are texts of their own."""

    def __init__(self, encode_batch, begins, line_end: int, most: int = 700_000, special: tuple[str, ...] = ()):
        """begins: for each id, whether its bytes begin with a space. line_end: the id of a line end. special: the special tokens' strings."""
        self.encode_batch, self.begins, self.line_end, self.most = encode_batch, begins, line_end, most
        self.special = special
        self.at_special = re.compile(f"({'|'.join(map(re.escape, sorted(special, key=len, reverse=True)))})")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(0, dtype="<u4")
        self.raw = np.zeros(0, dtype=np.uint8)  # the chunks' own bytes, behind one another
        self.raw_starts = np.zeros(0, dtype=np.int64)
        self.raw_sizes = np.zeros(0, dtype=np.int32)

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        """Adds chunks, given with what stands before them, under their sorted keys."""
        ids: list = [None] * len(chunks)
        # many chunks go through the tokeniser as one text; each begins with the one token of its kind that holds a space or line end
        kinds = {" ": [], "\n": [], "": []}
        for i, c in enumerate(chunks):
            kinds[c[0] if c[:1] in (" ", "\n") else ""].append(i)
        for lead, starts in ((" ", lambda x: self.begins[x]), ("\n", lambda x: x == self.line_end)):
            for k in range(0, len(kinds[lead]), 20_000):
                part = kinds[lead][k : k + 20_000]
                every = np.asarray(self.encode_batch(["".join(chunks[i] for i in part)])[0], dtype="<u4")
                at = np.flatnonzero(starts(every))
                if len(at) == len(part) and at[0] == 0:
                    for i, own in zip(part, np.split(every, at[1:]), strict=True):
                        ids[i] = own
                else:
                    kinds[""] += part
        for i, own in zip(kinds[""], self.encode_batch([chunks[i] for i in kinds[""]]), strict=True):
            ids[i] = np.asarray(own, dtype="<u4")
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, *ids])
        raw = [c.encode() for c in chunks]
        raw_sizes = np.array([len(x) for x in raw], dtype=np.int64)
        raw_starts = len(self.raw) + np.cumsum(raw_sizes) - raw_sizes
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(raw), dtype=np.uint8)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.sizes = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)
        self.raw_starts, self.raw_sizes = np.insert(self.raw_starts, at, raw_starts), np.insert(self.raw_sizes, at, raw_sizes)

    def _unlike(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The chunks data[begin:end] whose bytes aren't those of their place in the table: eight bytes of all chunks at a time, of those that have so many."""
        own, known = eights(data), eights(self.raw)
        sizes, other = ends - begins, self.raw_starts[place]
        wrong = sizes != self.raw_sizes[place]
        at = np.flatnonzero(~wrong & (sizes > 0))
        k = 0
        while len(at):
            left = sizes[at] - k
            apart = (own[begins[at] + k] ^ known[other[at] + k]) & _FIRST[np.minimum(left, 8)]
            wrong[at[apart != 0]] = True
            at, k = at[left > 8], k + 8
        return np.flatnonzero(wrong)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the table, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not any(s in t for s in self.special for t in texts):
            return self._encode(texts)
        split = [self.at_special.split(t) for t in texts]
        parts = [p for s in split for p in s[::2]]
        marks = [p for s in split for p in s[1::2]]
        plain, found = iter(self._encode(parts)), iter(self.encode_batch(marks))
        return [b"".join(np.asarray(next(found), dtype="<u4").tobytes() if k % 2 else next(plain) for k in range(len(s))) for s in split]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Of texts without special tokens."""
        odd = [i for i, t in enumerate(texts) if not t or _ODD.search(t)]
        strange = set(odd)
        plain = [i for i in range(len(texts)) if i not in strange]
        out: list[bytes] = [b""] * len(texts)
        if plain:
            raw = b"\0".join([b"", *(texts[i].encode() for i in plain), b""])
            data = np.frombuffer(raw, dtype=np.uint8)
            cuts = np.flatnonzero((data == 32) | (data == 10) | (data == 0))
            lead = data[cuts[:-1]]
            # the hash of a chunk and of the byte before it
            hashes = mix(hash_spans(data, cuts[:-1] + 1, cuts[1:]) + lead.astype(np.uint64))
            unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            begins, ends = cuts[:-1] + (lead == 0), cuts[1:]
            place = self._places(unique)
            new = place < 0
            if new.any():
                if len(self.keys) + int(new.sum()) > self.most:
                    self._clear()
                    new[:] = True
                self._learn(unique[new], [raw[b:e].decode() for b, e in zip(begins[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
                place = self._places(unique)
            place = place[inverse]
            sizes, starts = self.sizes[place], self.starts[place]
            to = np.cumsum(sizes)
            ids = self.flat[np.repeat(starts - (to - sizes), sizes) + np.arange(to[-1])]
            heads = np.flatnonzero(lead == 0)  # the first chunk of each text
            bounds = [*(to[heads] - sizes[heads]).tolist(), int(to[-1])]
            for i, b, e in zip(plain, bounds, bounds[1:], strict=False):
                out[i] = ids[b:e].tobytes()
            wrong = self._unlike(data, begins, ends, place)
            odd += [plain[k] for k in np.unique(np.searchsorted(heads, wrong, side="right") - 1).tolist()]
        for i in odd:
            parts = _CUT.split(texts[i]) if texts[i] else []
            out[i] = b"".join(np.asarray(x, dtype="<u4").tobytes() for x in self.encode_batch(parts))
        return out


@lru_cache(maxsize=2)
def chunk_table(path: str) -> ChunkTable:
    """One table a worker process and vocabulary file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core is all it has
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = tok.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in special):
        raise ValueError("special tokens that take in what stands beside them aren't known here")
    begins = np.array([(tok.id_to_token(i) or "").startswith("Ġ") for i in range(tok.get_vocab_size())])
    return ChunkTable(
        lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else [], begins,
        tok.token_to_id("Ċ"), special=tuple(t.content for t in special)
    )
