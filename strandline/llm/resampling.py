"""Importance resampling towards a target distribution of hashed word features, with an exact draw of the highest scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, byte_texts, texts_of, written

BUCKETS = 10_000
BLOCK = 1 << 20
LONG = 48  # bytes beyond which a word is hashed by itself
BAND = 1024  # neighbouring scores that are summed together
_TEXT_END = 10

#: What a byte of a text counts as: a-z and 0-9 and all above ASCII are parts of words, A-Z are lower-cased, all else is a space.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of data[start:end] of each span, continued from the crc32 `before` it where one is given: byte by byte, over all spans that have so many."""
    out = np.zeros(len(starts), dtype=np.uint32) if before is None else before.copy()
    sizes = ends - starts
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(out[k]))
    short = np.flatnonzero(sizes <= LONG)
    short = short[np.argsort(-sizes[short], kind="stable")]  # those with a further byte stand first
    begin, left = starts[short], np.bincount(sizes[short], minlength=LONG + 1)
    state = ~out[short]
    n = len(short)
    for k in range(LONG):
        n -= int(left[k])
        if not n:
            break
        state[:n] = _CRC[(state[:n] ^ data[begin[:n] + k]) & 255] ^ (state[:n] >> 8)
    out[short] = ~state
    return out


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of each two neighbouring words, words of each text), text after text."""
    data = np.frombuffer(b"\n".join([b"", *(t.translate(_PLAIN) for t in texts), b""]), dtype=np.uint8)
    blank = (data == 32) | (data == _TEXT_END)
    # one space between words: of a run of spaces the last goes before a word, and text ends stay
    keep = ~blank | (data == _TEXT_END)
    keep[:-1] |= (data[:-1] == 32) & ~blank[1:]
    data = data[keep]
    inside = (data != 32) & (data != _TEXT_END)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    counts = np.diff(np.searchsorted(starts, np.flatnonzero(data == _TEXT_END)))
    one = crc32_of(data, starts, ends)
    pair = np.flatnonzero(data[ends[:-1]] != _TEXT_END) if len(ends) else np.zeros(0, dtype=np.int64)
    two = crc32_of(data, ends[pair], ends[pair + 1], one[pair])
    return one % np.uint32(buckets), two % np.uint32(buckets), counts


def _counter(buckets: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, dtype=np.int64)
        for batch in blocks(batches, BLOCK):
            one, two, _ = features(byte_texts(batch), buckets)
            found += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["bucket", "count"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts each bucket has; a task sends its sums, and the driver gets one number a bucket."""
    got = texts.select("text").mapInArrow(_counter(buckets), "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[got["bucket"].to_numpy()] = got["count"].to_numpy()
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Of each bucket the thousandfold log of its share of the target over its share of the source, one count more each, floored."""
    n = len(source)
    share = (target + 1.0) * float(source.sum() + n) / ((source + 1.0) * float(target.sum() + n))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def _weigher(gain: np.ndarray):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, BLOCK):
            one, two, counts = features(byte_texts(batch), len(gain))
            pairs = np.maximum(counts - 1, 0)
            total = np.zeros(len(counts), dtype=np.int64)
            for found, each in ((one, counts), (two, pairs)):
                sums = np.concatenate([[0], np.cumsum(gain[found])])
                ends = np.cumsum(each)
                total += sums[ends] - sums[ends - each]
            n = counts + pairs
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"]
            )

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """A thousandfold Gumbel number of each id, floored: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _offsets(candidates: DataFrame, percent: int) -> DataFrame:
    """score, above (candidates with higher scores), most (how many are drawn): of the scores that are drawn from.

    Weights and noise are logs, so there are some 10**5 different scores at most, whatever the number of rows: their counts are
    suffix-summed within bands of BAND scores, and over the bands."""
    counts = written(candidates.groupBy("score").agg(F.count("*").alias("count")).withColumn("band", F.floor(F.col("score") / F.lit(BAND))), "histogram")
    bands = counts.groupBy("band").agg(F.sum("count").alias("rows"))
    down = Window.orderBy(F.desc("band"))
    all_ = F.sum("rows").over(Window.partitionBy())
    bands = bands.select(
        "band", (F.sum("rows").over(down) - F.col("rows")).alias("higher"),
        F.floor(all_ * F.lit(percent) / F.lit(100)).cast("long").alias("most")
    )
    within = F.sum("count").over(Window.partitionBy("band").orderBy(F.desc("score"))) - F.col("count")
    out = counts.join(F.broadcast(bands), "band").select("score", (F.col("higher") + within).alias("above"), "most")
    return written(out.where(F.col("above") < F.col("most")), "offsets")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (1, 2, 3 ... from the highest score down; null if not drawn).

    Features are words and pairs of neighbouring words, lower-cased, in `buckets` buckets by crc32. A bucket's gain compares its share of
    the target's features with that of all documents'; a document's weight is the mean gain of its features, looked up in the array of all
    gains; its score is the weight and a Gumbel number of its id, so the highest scores are a draw by importance without replacement. Of the
    documents with least_words words or more `percent` in 100 are drawn: exact counts by score, summed from the highest down, give each
    score the rank its documents begin at, and the lowest score that is drawn from; within a score ranks follow doc_id (nulls first), then
    weight and n_features. Rows that are equal in all of these share one entry that holds as many ranks, so repeated ids meet in no task.

    Counts cover all texts of both tables. What is gathered are `buckets` numbers and, at most, one number a score (see _offsets). Texts are
    read twice and never shuffled. Null or empty text: no words, weight 0, never drawn. Null ids: a noise of their own. Empty target: all
    its shares are equal. Empty table: no rows. Other columns are not read."""
    texts = texts_of(docs, doc_id, text)
    source = bucket_counts(texts, buckets)
    gain = gains(bucket_counts(target.select(F.coalesce(target[text], F.lit("")).alias("text")), buckets), source)
    scored = texts.mapInArrow(_weigher(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = written(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    offsets = _offsets(scored.where(F.col("n_words") >= least_words), percent)
    cutoff = offsets.agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    met = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    keys = ["score", "doc_id", "weight", "n_features", "n_words"]
    same = scored.where(met).groupBy(*keys).agg(F.count("*").alias("copies")).join(F.broadcast(offsets), "score")
    within = Window.partitionBy("score").orderBy("doc_id", "weight", "n_features", "n_words")
    # the running sum of copies is the row number among all rows of the score
    same = same.withColumn("last", F.col("above") + F.sum("copies").over(within))
    ranks = same.select(*keys, "most", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, "last")).alias("rank"))
    drawn = ranks.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= F.col("most"), F.col("rank")).alias("rank"))
    rest = scored.where(~met).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)
