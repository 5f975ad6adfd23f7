"""SentencePiece BPE by a prefix table: each prefix's last token, found from automaton matches and pair tests."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, texts_of

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixTable:
    """Ids of a segment by the unique last token of each of its prefixes.

    Merges are by vocabulary: two neighbours merge if their join is a piece, the best score first, then the
    leftmost. A sequence of tokens is what the merges give for its text exactly if each token is what they give
    for its own text and each pair of neighbours is what they give for the pair's text. So a prefix's last token is
    the one that ends there, starts where a shorter prefix ends, and is compatible with that prefix's last token;
    no other can be. The automaton yields the tokens that end at each place; pairs are tested once and kept."""

    def __init__(self, processor):
        import ahocorasick

        sp = processor
        self.sp, self.piece, self.score, self.bytes = sp, {}, {}, {}
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.piece[p], self.score[p] = i, sp.get_score(i)
        self.unknown = sp.unk_id()
        self.by_id = {i: p for p, i in self.piece.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.piece.items():
            if self.merged(p) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.chars = frozenset(p for p in self.piece if len(p) == 1)
        self.pairs: dict[int, bool] = {}
        self.cuts_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.piece)
        self.cuts_at_line = not any("\n" in p for p in self.piece)

    def merged(self, text: str) -> list[str]:
        """What the merges give for a short text, step by step."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= 1_000_000:
            self.pairs.clear()
        one, two = self.by_id[a], self.by_id[b]
        known = self.pairs[a << 32 | b] = self.merged(one + two) == [one, two]
        return known

    def encode(self, segment: str) -> list[int]:
        """Ids of one segment. A character that is no piece ends a stretch and becomes its bytes' ids."""
        if self.chars.issuperset(segment):
            return self.stretch(segment)
        out, start = [], 0
        for i, c in enumerate(segment):
            if c not in self.chars:
                out += self.stretch(segment[start:i])
                out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
                start = i + 1
        return out + self.stretch(segment[start:])

    def stretch(self, text: str) -> list[int]:
        if not text:
            return []
        last = [-1] * (len(text) + 1)  # of each prefix: the id of its last token
        size = [0] * (len(text) + 1)
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                if length == end:
                    last[end], size[end] = token, length
                else:
                    before = last[end - length]
                    fits = pairs.get(before << 32 | token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        last[end], size[end] = token, length
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids


class SegmentMemo(dict):
    """Word between spaces -> little-endian ids, for texts without doubled spaces; bounded, emptied when full."""

    def __init__(self, table: PrefixTable, most: int = 400_000):
        super().__init__()
        self.table, self.most = table, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = np.asarray(self.table.encode(word if word[:1] == "\n" else SPACE + word), dtype="<i4").tobytes()
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<i4")
        t = self.table
        if t.cuts_at_space and SPACE not in text:
            words = (text.replace("\n", " \n") if t.cuts_at_line else text).split(" ")
            if "" not in words:
                return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<i4")
        full = SPACE + text.replace(" ", SPACE)
        segments = _SEGMENT.findall(full) if t.cuts_at_space else [full]
        return np.asarray([i for s in segments for i in t.encode(s)], dtype="<i4")


@lru_cache(maxsize=1)
def _memo(path: str) -> SegmentMemo:
    import sentencepiece

    return SegmentMemo(PrefixTable(sentencepiece.SentencePieceProcessor(model_file=path)))


def _coder(path: str):
    def run(batches):
        memo = _memo(path)
        for batch in blocks(batches, 4 << 20):
            ids = [memo.encode(t) for t in batch.column(1).to_pylist()]
            texts = [memo.table.sp.decode(x.tolist()) if len(x) else "" for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(texts, pa.string())],
                ["doc_id", "ids", "decoded"]
            )

    return run


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids array<int>, decoded string.

    Ids are those of the sentencepiece library without begin or end ids or sampling, for an identity-normalised
    BPE model with a dummy prefix; decoded is the library's decode(ids). A map over the splits, without a shuffle.

    Null or empty text: no ids, empty decoded. Null, equal or repeated doc_ids: rows of their own. Empty table: no rows.
    Columns other than doc_id and text are not read."""
    return texts_of(docs, doc_id, text).mapInArrow(_coder(path or model_path()), "doc_id long, ids array<int>, decoded string")
