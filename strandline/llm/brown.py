"""LM scoring by a Brown class-based bigram model: exchange clustering, class transitions, word emissions, and an add-one base."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_texts, fold, task_numbers, texts_of, written
from .wordhash import frequent_in_chunks, words_of

MOST_FREQUENT = 500_000  # words with a table entry of their own
BLOCK, MOST_DOCS = 2 << 20, 1 << 14
PER_BUCKET = 500_000  # words whose counts one bucket gathers, about
_AT, _SHAPE, _TRAIN = np.uint32((1 << 30) - 1), np.uint32(1 << 30), np.uint32(1 << 31)
WORDS_TOGETHER = 1 << 11  # frequent words whose neighbours one row gathers
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True


@dataclass
class Vocabulary:
    """Sorted hashes of frequent words; the symbol of each: its own for the `words` most frequent, else one of two by whether it ends with a letter."""

    keys: np.ndarray
    symbol: np.ndarray
    words: int

    # symbols after the words: frequent with and without a last letter, rare with and without, text end
    @property
    def size(self) -> int:
        return self.words + 5

    def look(self, hashes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index among the frequent words or -1, symbol) of each word."""
        letter = _LETTERS[last]
        rare = np.where(letter, self.words + 2, self.words + 3)
        if not len(self.keys):
            return np.full(len(hashes), -1), rare
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        own = self.symbol[at]
        own = np.where(own >= 0, own, np.where(letter, self.words, self.words + 1))
        return np.where(hit, at, -1), np.where(hit, own, rare)


def _cut(batches):
    for batch in blocks(batches, BLOCK):
        for at in range(0, batch.num_rows, MOST_DOCS):
            yield batch.slice(at, MOST_DOCS)


def vocabulary(texts: DataFrame, words: int) -> Vocabulary:
    """Words with at least one MOST_FREQUENT-th of all occurrences, so MOST_FREQUENT at most; the `words` most frequent get symbols of their own."""

    def run(batches):
        return frequent_in_chunks(words_of(byte_texts(b))[0] for b in _cut(batches))

    counts = written(texts.mapInArrow(run, "key long, count long").groupBy("key").agg(F.sum("count").alias("count")), "frequent")
    total = counts.where("key IS NULL").select("count").first()
    least = max(8, (total[0] if total else 0) / MOST_FREQUENT)
    rows = counts.where(F.col("key").isNotNull() & (F.col("count") >= least)).toArrow()
    keys, count = rows["key"].to_numpy().astype(np.int64).view(np.uint64), rows["count"].to_numpy()
    order = np.argsort(keys)
    keys, count = keys[order], count[order]
    top = np.lexsort((keys, -count))[:words]
    symbol = np.full(len(keys), -1, dtype=np.int64)
    symbol[top] = np.arange(len(top))
    return Vocabulary(keys, symbol, words)


def _encoder(shared):
    """A block's tokens as int32, text after text: of a frequent word twice its index, and one if a letter ends it; of rare ones -1 with a
    last letter and -2 without; -3 of a text's end."""

    def run(batches):
        v = shared.value
        for batch in _cut(batches):
            hashes, counts, last = words_of(byte_texts(batch))
            index, letter = v.look(hashes, last)[0], _LETTERS[last]
            codes = np.where(index >= 0, 2 * index + letter, np.where(letter, -1, -2))
            yield pa.RecordBatch.from_arrays([pa.array([np.insert(codes, np.cumsum(counts), -3).astype("<i4").tobytes()], pa.binary())], ["data"])

    return run


def _codes(batches):
    for batch in batches:
        for data in batch.column(0).to_pylist():
            yield np.frombuffer(data, dtype="<i4").astype(np.int64)


def _symbols(codes: np.ndarray, own: np.ndarray, after: int) -> np.ndarray:
    """Of each token its word's entry in own; where that is -1, and of other tokens, one of the five numbers from `after`."""
    out = np.where(codes == -3, after + 4, np.where(codes == -1, after + 2, after + 3))
    known = codes >= 0
    mine = own[codes[known] >> 1]
    out[known] = np.where(mine >= 0, mine, np.where(codes[known] & 1, after, after + 1))
    return out


def _before(tokens: np.ndarray, end: int) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[:1] = end
    return out


def _counter(shared):
    """(cell, count): pairs of neighbouring symbols as cell first * size + second, then the frequent words' counts, as size**2 + index."""

    def run(batches):
        v = shared.value
        pairs, single = np.zeros(v.size**2, dtype=np.int64), np.zeros(len(v.keys), dtype=np.int64)
        for codes in _codes(batches):
            tokens = _symbols(codes, v.symbol, v.words)
            single += np.bincount(codes[codes >= 0] >> 1, minlength=len(single))
            pairs += np.bincount(_before(tokens, v.size - 1) * v.size + tokens, minlength=len(pairs))
        yield from _cells(np.concatenate([pairs, single]))

    return run


def _cells(every: np.ndarray):
    at = np.flatnonzero(every)
    for k in range(0, len(at), 1 << 18):
        part = at[k : k + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(every[part], pa.int64())], ["cell", "count"])


GATHERED = "bucket int, salt int, data binary"


def _row(bucket: int, data: bytes, salt: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([salt], pa.int32()), pa.array([data], pa.binary())], ["bucket", "salt", "data"])


def _sparse(bucket: int, cells: np.ndarray, counts: np.ndarray, salt: int) -> pa.RecordBatch:
    return _row(bucket, cells.astype("<i8").tobytes() + counts.astype("<i8").tobytes(), salt)


def _neighbours(shared, total: int, end: int, ways: int):
    """Rows (bucket, salt, data): of WORDS_TOGETHER words, (cell, count) of the classes before and after each free word, as cell (index * 2
    + side) * total + class; bucket -1 has the pairs of classes. The salt is one of `ways`, by the task."""

    def run(batches):
        kinds, free = shared.value
        salt = next(task_numbers()) // (1 << 36) % ways
        grid, held, size = np.zeros(total * total, dtype=np.int64), [], 0

        def flush():
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket = cells // (2 * total * WORDS_TOGETHER)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for b, c, n in zip(bucket[np.concatenate([[0], cuts])].tolist(), np.split(cells, cuts), np.split(counts, cuts), strict=True):
                yield _sparse(b, c, n, salt)

        for codes in _codes(batches):
            tokens = _symbols(codes, kinds, end - 4)
            before = _before(tokens, end)
            grid += np.bincount(before * total + tokens, minlength=len(grid))
            at = np.flatnonzero(codes >= 0)
            at = at[free[codes[at] >> 1]]
            if len(at):
                word = (codes[at] >> 1) * 2 * total
                held += [word + before[at], word + total + tokens[at + 1]]  # an end follows each text's last word
                size += 2 * len(at)
            if size > 1 << 22:
                yield from flush()
                size = 0
        if size:
            yield from flush()
        at = np.flatnonzero(grid)
        yield _sparse(-1, at, grid[at], salt)

    return run


def _gatherer(total: int, last: bool):
    """The sums of each bucket's rows: (cell, count) of those that have any, or, of the last sums, all cells' counts."""
    each = 2 * total * WORDS_TOGETHER

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cells, counts = np.frombuffer(data, dtype="<i8").reshape(2, -1)
                if bucket not in found:
                    found[bucket] = np.zeros(each if bucket >= 0 else total * total, dtype=np.int64)
                found[bucket][cells - max(bucket, 0) * each] += counts  # a row has each cell once
        for bucket in sorted(found):
            sums = found.pop(bucket)
            if last:
                yield _row(bucket, sums.astype("<i8").tobytes())
            else:
                at = np.flatnonzero(sums)
                yield _sparse(bucket, at + max(bucket, 0) * each, sums[at], 0)

    return run


def _best(shared, total: int, classes: int):
    """Of each bucket's words the class that gives their neighbours and them the most likelihood, -1 where nothing was counted."""

    def run(batches):
        transition, tokens = shared.value
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cells = np.frombuffer(data, dtype="<i8").reshape(-1, 2, total)
                n = cells[:, 0].sum(axis=1)
                gain = cells[:, 0] @ transition[:, :classes] + cells[:, 1] @ transition[:classes].T - np.outer(n, tokens[:classes])
                yield _row(bucket, np.where(n > 0, gain.argmax(axis=1), -1).astype("<i2").tobytes())

    return run


def smoothed(grid: np.ndarray) -> np.ndarray:
    """log10 of the transitions. Witten-Bell: a class leaves as much to the classes' own frequencies as it has different successors."""
    tokens = grid.sum(axis=0)
    single = (tokens + 1) / (tokens.sum() + len(grid))
    kinds = (grid > 0).sum(axis=1, keepdims=True) + 1.0
    return np.log10((grid + kinds * single) / (grid.sum(axis=1, keepdims=True) + kinds))


def likelihood(grid: np.ndarray) -> float:
    """Of the class bigrams, but for what no choice of classes changes."""
    xlogx = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return float(xlogx(grid) - xlogx(grid.sum(axis=0)) - xlogx(grid.sum(axis=1)))


BLOCKS_A_WAY = 128  # blocks of text whose sums for a bucket have about the size of the bucket's own


def sweep(codes: DataFrame, kinds: np.ndarray, free: np.ndarray, classes: int, sweeps: int, least_gain: float) -> tuple[np.ndarray, np.ndarray]:
    """(the class of each frequent word, the pairs of classes). Each sweep puts every free word to its best class against the pairs of the
    sweep before, until the likelihood grows by less than the share `least_gain`, or after `sweeps` of them.

    A bucket's neighbours are summed by (bucket, salt), then by bucket. There are about as many salts as the square root of what a bucket
    gets, so that either sum reads about as much in a task, and neither is bounded by the number of buckets alone."""
    context, total, best = codes.sparkSession.sparkContext, classes + 5, None
    ways, buckets = max(1, math.ceil(math.sqrt(codes.count() / BLOCKS_A_WAY))), len(kinds) // WORDS_TOGETHER + 2
    for k in range(sweeps + 1):
        shared = context.broadcast((kinds, free if k < sweeps else np.zeros_like(free)))
        rows = codes.mapInArrow(_neighbours(shared, total, total - 1, ways), GATHERED)
        if ways > 1:
            rows = rows.repartition(max(8, buckets * ways), "bucket", "salt").mapInArrow(_gatherer(total, False), GATHERED)
        rows = written(rows.repartition(max(8, buckets), "bucket").mapInArrow(_gatherer(total, True), GATHERED), "neighbours")
        grid = sum((np.frombuffer(r[0], dtype="<i8") for r in rows.where("bucket < 0").select("data").collect()), np.zeros(total * total)).reshape(total, total)
        now = likelihood(grid)
        if best is not None and now <= best[0] + least_gain * abs(best[0]):
            return (kinds, grid) if now > best[0] else best[1:]
        best = (now, kinds, grid)
        if k < sweeps:
            shared = context.broadcast((smoothed(grid), np.log10(np.maximum(grid.sum(axis=0), 1))))
            kinds = kinds.copy()
            for bucket, _, data in rows.where("bucket >= 0").mapInArrow(_best(shared, total, classes), GATHERED).collect():
                at = bucket * WORDS_TOGETHER
                own = np.frombuffer(data, dtype="<i2")[: len(kinds) - at]
                kinds[at : at + len(own)] = np.where(free[at : at + len(own)] & (own >= 0), own, kinds[at : at + len(own)])
    return best[1:]


def exchange(pairs: np.ndarray, words: int, classes: int, sweeps: int = 12) -> np.ndarray:
    """The class of each symbol. The first `words` symbols are moved among `classes` classes, one by one to where the likelihood of the class bigrams
    grows most, until a sweep moves none; the other symbols keep classes of their own."""
    size = len(pairs)
    own = np.concatenate([np.arange(words) % classes, classes + np.arange(size - words)])
    total = classes + size - words
    grid = np.zeros((total, total))
    np.add.at(grid, (own[:, None].repeat(size, 1), own[None, :].repeat(size, 0)), pairs)
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    seen = np.flatnonzero(pairs[:words].sum(axis=1) + pairs[:, :words].sum(axis=0))
    for _ in range(sweeps):
        moved = 0
        for w in seen.tolist():
            a, self_ = own[w], pairs[w, w]
            right = np.bincount(own, weights=pairs[w], minlength=total)
            left = np.bincount(own, weights=pairs[:, w], minlength=total)
            grid[a] -= right
            grid[:, a] -= left
            grid[a, a] += self_
            right[a] -= self_
            left[a] -= self_
            rows, cols = grid[:classes], grid[:, :classes].T
            gain = (xlogx(rows + right) - xlogx(rows)).sum(axis=1) + (xlogx(cols + left) - xlogx(cols)).sum(axis=1)
            k = np.arange(classes)
            here = grid[k, k]
            gain += xlogx(here + right[k] + left[k] + self_) + xlogx(here) - xlogx(here + right[k]) - xlogx(here + left[k])
            for side, more in ((rows.sum(axis=1), right.sum() + self_), (cols.sum(axis=1), left.sum() + self_)):
                gain -= xlogx(side + more) - xlogx(side)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 * abs(gain[a]):
                b = a
            moved += b != a
            own[w] = b
            grid[b] += right
            grid[:, b] += left
            grid[b, b] += self_
        if not moved:
            break
    return own


@dataclass
class Model:
    """The frequent words, their counts and classes, and log10 of the transitions between classes and of the tokens of each class; of rare
    words only by their last letter."""

    vocabulary: Vocabulary
    counts: np.ndarray
    kinds: np.ndarray
    transition: np.ndarray
    tokens: np.ndarray


def fit(texts: DataFrame, words: int, classes: int, sweeps: int = 3, least_gain: float = 1e-4) -> tuple[Model, int, int]:
    """(the model, training tokens, training texts). All texts are counted; what reaches the driver are MOST_FREQUENT words and a table of
    (words + 5)**2 pairs at most.

    The `words` most frequent words are put into classes by exchange, one by one; then all other frequent ones by sweeps over their
    neighbours' classes."""
    context = texts.sparkSession.sparkContext
    v = vocabulary(texts, words)
    shared = context.broadcast(v)
    codes = written(texts.mapInArrow(_encoder(shared), "data binary"), "codes")
    got = written(codes.mapInArrow(_counter(shared), "cell long, count long").groupBy("cell").agg(F.sum("count").alias("count")), "pairs").toArrow()
    every = np.zeros(v.size**2 + len(v.keys), dtype=np.int64)
    every[got["cell"].to_numpy()] = got["count"].to_numpy()
    pairs, counts = every[: v.size**2].reshape(v.size, v.size), every[v.size**2 :]
    own = exchange(pairs.astype(float), words, classes)
    kinds = np.where(v.symbol >= 0, own[np.maximum(v.symbol, 0)], -1)
    kinds, grid = sweep(codes, kinds, v.symbol < 0, classes, sweeps, least_gain)
    return Model(v, counts, kinds, smoothed(grid), np.log10(np.maximum(grid.sum(axis=0), 1))), int(pairs.sum()), int(pairs[:, -1].sum())


_DOC = np.dtype([("doc", "<i8"), ("known_id", "u1"), ("held", "u1"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
POSTED = "bucket int, block long, kind int, data binary, cell long, count long"


def _posted(bucket, block, kind: int, data=None, cell=None, count=None) -> pa.RecordBatch:
    n = len(bucket)
    columns = [
        pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array([kind] * n, pa.int32()),
        pa.array(data or [None] * n, pa.binary()), pa.array([None] * n if cell is None else cell, pa.int64()),
        pa.array([None] * n if count is None else count, pa.int64())
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "kind", "data", "cell", "count"])


def _poster(shared, buckets: int, classes: int, texts_learnt: int):
    """Rows (bucket, block, kind, data): kind 0 has a block's documents with all that is known of them here and the class of each token,
    kind 1 its rare words of one bucket: hash, place among the block's tokens with marks, classes before and after."""

    def run(batches):
        m, numbers = shared.value, task_numbers()
        v, end = m.vocabulary, classes + 4
        held: list[tuple] = []
        size = 0

        def flush():
            bucket, block, data = [], [], []
            for number, to, *parts in held:
                order = np.argsort(to, kind="stable")
                to = to[order]
                cuts = np.flatnonzero(np.diff(to)) + 1
                for b, *of in zip(to[np.concatenate([[0], cuts])].tolist(), *(np.split(x[order], cuts) for x in parts), strict=True):
                    bucket.append(b)
                    block.append(number)
                    data.append(b"".join(x.tobytes() for x in of))
            held.clear()
            return _posted(bucket, block, 1, data)

        for batch in _cut(batches):
            hashes, counts, last = words_of(byte_texts(batch))
            index = v.look(hashes, last)[0]
            n = len(counts)
            doc_of = np.repeat(np.arange(n), counts)
            rows = np.zeros(n, dtype=_DOC)
            ids = batch.column(0)
            rows["doc"], rows["known_id"] = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            rows["held"] = batch.column(2).to_numpy(zero_copy_only=False)
            rows["tokens"] = counts + 1
            hit = index >= 0
            c = np.where(hit, m.counts[np.maximum(index, 0)] if len(m.counts) else 0, 0)
            rows["score"] = np.bincount(doc_of, weights=np.log10(np.maximum(c, 1)), minlength=n)
            rows["known"] = np.bincount(doc_of[hit & (c > 0)], minlength=n) + (texts_learnt > 0)
            rows["base"] = np.bincount(doc_of, weights=np.log10(c + 1.0), minlength=n) + np.log10(texts_learnt + 1.0)
            own = np.where(hit, m.kinds[np.maximum(index, 0)] if len(m.kinds) else 0, np.where(_LETTERS[last], classes + 2, classes + 3))
            tokens = np.insert(own, np.cumsum(counts), end).astype(np.uint8)
            number = next(numbers)
            yield _posted([number % buckets], [number], 0, [_packed(rows, tokens)])
            rare = np.flatnonzero(~hit)
            if len(rare):
                at = rare + doc_of[rare]
                marks = at.astype(np.uint32)
                marks |= np.where(_LETTERS[last[rare]], _SHAPE, np.uint32(0))
                marks |= np.where(rows["held"][doc_of[rare]] == 0, _TRAIN, np.uint32(0))
                held.append((number, (hashes[rare] % np.uint64(buckets)).astype(np.int64), hashes[rare], marks, _before(tokens, end)[at], tokens[at + 1]))
                size += len(rare)
            if size > 1 << 20:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


_UNSEEN = 255  # in place of a class


def rare_classes(pairs: np.ndarray, starts: np.ndarray, transition: np.ndarray, tokens: np.ndarray, classes: int) -> np.ndarray:
    """The likeliest class of each word; pairs: of its occurrences, class before * total + class after, word after word; starts: where a word's begin."""
    table = (transition[:, None, :classes] + transition[:classes].T[None] - tokens[:classes]).reshape(-1, classes).astype(np.float32)
    out = np.empty(len(starts), dtype=np.uint8)
    ends = np.append(starts[1:], len(pairs))
    k = 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(ends, starts[k] + (1 << 16), side="right")))
        out[k:to] = np.add.reduceat(table[pairs[starts[k] : ends[to - 1]]], starts[k:to] - starts[k], axis=0).argmax(axis=1)
        k = to
    return out


def _joiner(shared, classes: int):
    """Counts each bucket's rare words over the training texts, finds their classes, and sends each block its words' counts and classes; kind 2 has, by cell
    (class * 2 + last letter) * 5, what there is: occurrences, words of counts 1, 2 and 3, and all words."""

    def run(batches):
        transition, tokens = shared.value
        total = classes + 5
        hashes, marks, pairs, origin = [], [], [], []
        for batch in batches:
            cols = [batch.column(k) for k in range(4)]
            for bucket, block, kind, data in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2].to_pylist(), cols[3].to_pylist(), strict=True):
                if kind == 0:
                    yield _posted([bucket], [block], 0, [data])
                else:
                    n = len(data) // 14
                    hashes.append(np.frombuffer(data, dtype="<u8", count=n))
                    marks.append(np.frombuffer(data, dtype="<u4", count=n, offset=8 * n))
                    sides = np.frombuffer(data, dtype="u1", offset=12 * n).reshape(2, n)
                    pairs.append(sides[0].astype(np.uint16) * np.uint16(total) + sides[1])
                    origin.append((bucket, block, n))
        if not hashes:
            return
        h, x = np.concatenate(hashes), np.concatenate(marks)
        hashes.clear()
        order = np.argsort(h)
        h = h[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        del h
        learnt = x[order] & _TRAIN > 0
        count = np.add.reduceat(learnt.astype(np.uint32), starts)
        shape = x[order[starts]] & _SHAPE > 0
        kind_of = np.full(len(starts), _UNSEEN, dtype=np.uint8)
        seen = count > 0
        if seen.any():
            kind_of[seen] = rare_classes(
                np.concatenate(pairs)[order[learnt]], np.append(0, np.cumsum(count[seen].astype(np.int64))[:-1]), transition, tokens,
                classes
            )
        pairs.clear()
        times = np.diff(np.append(starts, len(order)))
        back, own = np.empty(len(order), dtype="<u4"), np.empty(len(order), dtype=np.uint8)
        back[order], own[order] = np.repeat(count, times), np.repeat(kind_of, times)
        at = 0
        for k in range(0, len(origin), 1000):
            data, part = [], origin[k : k + 1000]
            for places, (_, _, n) in zip(marks[k : k + 1000], part, strict=True):
                data.append(back[at : at + n].tobytes() + places.tobytes() + own[at : at + n].tobytes())
                at += n
            yield _posted([o[0] for o in part], [o[1] for o in part], 1, data)
        found = np.zeros((classes * 2, 5), dtype=np.int64)
        to, c = kind_of[seen].astype(np.int64) * 2 + shape[seen], count[seen].astype(np.int64)
        for k in (1, 2, 3):
            found[:, k] = np.bincount(to[c == k], minlength=len(found))
        found[:, 4] = np.bincount(to, minlength=len(found))
        found[:, 0] = np.bincount(to, weights=c, minlength=len(found))
        cells = np.flatnonzero(found.ravel())
        yield _posted([0] * len(cells), [0] * len(cells), 2, None, cells, found.ravel()[cells])

    return run


def rare_emission(tokens: int, n1: int, n2: int, n3: int, types: int):
    """log10 emission of a rare word by its count (an array), by absolute discounts of counts 1 and of greater ones, from the counts of
    counts, each half a count more so that they always exist. As many unseen words as seen ones, and one, share what is taken off, and one
    count more."""
    a, b, c = n1 + 0.5, n2 + 0.5, n3 + 0.5
    y = a / (a + 2 * b)
    cut = np.array([0.0, min(max(1 - 2 * y * b / a, 0.05), 0.95), min(max(2 - 3 * y * c / b, 0.05), 1.95)])
    unseen = (cut[1] * n1 + cut[2] * (types - n1) + 1) / (types + 1)
    return lambda count: np.log10(np.where(count > 0, count - cut[np.minimum(count, 2)], unseen) / (tokens + 1))


def last_transitions(grid: np.ndarray, stats: np.ndarray, classes: int) -> np.ndarray:
    """log10 of what a token adds to a text's score by the class before it and its own, but for the word's share of its class: the
    transition, less the class's tokens and one. A word that was never seen may be of any class: it has the unseen mass of all classes for
    words with its last letter, shared by as many words as were seen with it, and one; what follows it has the mean of the classes'
    transitions by their rare words."""
    known = [*range(classes), classes + 4]
    t = 10 ** smoothed(grid[np.ix_(known, known)])
    all_ = grid.sum(axis=0)[:classes] + 1
    both = stats.sum(axis=1)
    unseen = np.array([(s[4] + 1) * 10 ** float(rare_emission(*s)(np.array([0]))[0]) for s in both.tolist()]) * (both[:, 0] + 1) / all_
    share = (stats[:, :, 4] + 1) / (both[:, 4:] + 2)
    each = unseen[:, None] * share / (stats[:, :, 4].sum(axis=0) + 1)
    out = np.ones((classes + 5, classes + 5))
    out[np.ix_(known, known)] = t / np.append(all_, 1)
    for s in (0, 1):  # without and with a last letter
        out[known, classes + 3 - s] = t[:, :classes] @ each[:, s]
    for s in (0, 1):
        out[classes + 3 - s] = (stats[:, s, 4] + 1) / (stats[:, s, 4] + 1).sum() @ out[:classes]
    return np.log10(out)


def _resolver(stats: np.ndarray, classes: int):
    """Puts each block's rare words to their classes: rows (data) of the blocks, and (cell, count) of the pairs of classes in training texts."""

    def run(batches):
        total, blocks_, rare = classes + 5, {}, []
        for batch in batches:
            for bucket, block, kind, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if kind == 0:
                    blocks_[block] = data
                else:
                    rare.append((block, bucket, data))
        emissions = [rare_emission(*s) for s in stats.sum(axis=1).tolist()]
        mass = np.log10(stats.sum(axis=1)[:, 0] + 1.0)
        most = 1 << 12
        table = np.array([e(np.arange(most)) for e in emissions]) + mass[:, None]
        parts: dict[int, list] = {}
        for block, _, data in sorted(rare, key=lambda r: r[:2]):
            parts.setdefault(block, []).append(data)
        rare.clear()
        grid = np.zeros(total * total, dtype=np.int64)
        for block in sorted(blocks_):
            rows, tokens = _unpacked(blocks_.pop(block))
            doc_of = np.repeat(np.arange(len(rows)), rows["tokens"])
            for data in parts.pop(block, []):
                n = len(data) // 9
                c, at = np.frombuffer(data, dtype="<u4", count=n).astype(np.int64), (np.frombuffer(
                    data, dtype="<u4", count=n, offset=4 * n
                ) & _AT).astype(np.int64)
                own, doc = np.frombuffer(data, dtype="u1", offset=8 * n), doc_of[at]
                rows["known"] += np.bincount(doc[c > 0], minlength=len(rows))
                rows["base"] += np.bincount(doc, weights=np.log10(c + 1.0), minlength=len(rows))
                seen = own != _UNSEEN
                c, at, own, doc = c[seen], at[seen], own[seen], doc[seen]
                value = table[own, np.minimum(c, most - 1)]
                for k in np.flatnonzero(c >= most).tolist():
                    value[k] = emissions[own[k]](c[k : k + 1])[0] + mass[own[k]]
                rows["score"] += np.bincount(doc, weights=value, minlength=len(rows))
                tokens[at] = own
            cells = _before(tokens, total - 1).astype(np.int64) * total + tokens
            grid += np.bincount(cells[rows["held"][doc_of] == 0], minlength=len(grid))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_packed(rows, tokens)], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64())],
                ["data", "cell", "count"]
            )
        for part in _cells(grid):
            yield pa.RecordBatch.from_arrays([pa.nulls(part.num_rows, pa.binary()), part.column(0), part.column(1)], ["data", "cell", "count"])

    return run


def _packed(rows: np.ndarray, tokens: np.ndarray) -> bytes:
    return len(rows).to_bytes(8, "little") + rows.tobytes() + tokens.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, dtype=_DOC, count=n, offset=8).copy(), np.frombuffer(data, dtype=np.uint8, offset=8 + n * _DOC.itemsize).copy()


def _finisher(table: np.ndarray, classes: int, train_tokens: int, types: int):
    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, tokens = _unpacked(data)
                doc_of = np.repeat(np.arange(len(rows)), rows["tokens"])
                rows["score"] += np.bincount(doc_of, weights=table[_before(tokens, classes + 4), tokens], minlength=len(rows))
                out = {
                    "doc_id": pa.array(
                        rows["doc"], pa.int64(), mask=rows["known_id"] == 0
                    ), "held_out": pa.array(rows["held"] > 0), "n_tokens": pa.array(rows["tokens"]), "n_known": pa.array(rows["known"]),
                    "train_tokens": pa.array(np.full(len(rows), train_tokens)), "base_score": pa.array(
                        rows["base"] - rows["tokens"] * np.log10(train_tokens + types + 1.0)
                    ), "score": pa.array(rows["score"]),
                }
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def brown_scores(
    docs: DataFrame, folds: int = 7, held_fold: int = 2, words: int = 1024, classes: int = 128, sweeps: int = 3, least_gain: float = 1e-4,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (add-one), score (log10
    probability under the class model).

    Learnt from all documents outside the held fold; a null id is not held out. p(word | word before) is p(class | class before) times
    p(word | class). The `words` most frequent words are put into `classes` classes by exchange, all other words of the training texts into
    the same classes by their neighbours: frequent ones in at most `sweeps` sweeps, while the likelihood grows by the share `least_gain`,
    rare ones once, in the bucket that counts them. The text's end has a class of its own. A word that no training text has may be of any
    class.

    Frequent words (one in MOST_FREQUENT occurrences at least) have a broadcast table of bounded size, so no word of many occurrences is a
    key of any shuffle. Rare words go once, as 14-byte entries, to a bucket by hash, and back to their block of documents, which also has a
    byte a token. Null or empty text: the end alone. Repeated ids: rows of their own. Empty table: no rows. Other columns are not read."""
    if not 0 < classes < 250:
        raise ValueError("classes: a byte must hold one")
    context = docs.sparkSession.sparkContext
    texts = texts_of(docs, doc_id, text, F.coalesce(fold(docs[doc_id].cast("long"), folds) == held_fold, F.lit(False)).alias("held"))
    model, tokens, learnt = fit(texts.where("NOT held"), words, classes, sweeps, least_gain)
    buckets = max(32, 4 * tokens // PER_BUCKET)
    posted = texts.mapInArrow(_poster(context.broadcast(model), buckets, classes, learnt), POSTED)
    joiner = _joiner(context.broadcast((model.transition, model.tokens)), classes)
    counted = written(posted.repartition(max(8, buckets // 4), "bucket").mapInArrow(joiner, POSTED), "counted")
    stats = _summed(counted.where("kind = 2"), classes * 10).reshape(classes, 2, 5)
    resolved = counted.where("kind < 2").repartition(max(8, buckets // 4), "block").mapInArrow(_resolver(stats, classes), "data binary, cell long, count long")
    resolved = written(resolved, "resolved")
    table = last_transitions(_summed(resolved.where("cell IS NOT NULL"), (classes + 5) ** 2).reshape(classes + 5, classes + 5), stats, classes)
    types = int((model.counts > 0).sum()) + int(stats[:, :, 4].sum()) + (learnt > 0)
    return resolved.where("data IS NOT NULL").select("data").mapInArrow(_finisher(table, classes, tokens, types), SCORES)


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    got = rows.groupBy("cell").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[got["cell"].to_numpy()] = got["count"].to_numpy()
    return out
