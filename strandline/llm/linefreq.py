"""Quality rules over whole texts and over the lines that documents of one host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 8  # words
SALTS = 64


def _words(text: Column) -> Column:
    """The words of a text; a null text has none. One translation and a split on one character, which needs no regular expression."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


def _bound(value: Column, f) -> Column:
    """f(value), with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _zip_shifted(a: Column, by: int, f) -> Column:
    """f(a[i], a[i + by]) for all i that have both."""
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - by, F.lit(0))), F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0))), f)


def _mix(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: the length of the union of those windows."""
    runs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    both = _bound(runs, lambda r: _zip_shifted(r, 1, lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))))
    steps = _bound(F.sort_array(F.flatten(F.array_compact(both))), lambda starts: _zip_shifted(starts, 1, lambda x, y: F.least(y - x, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)


def text_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: row_id, doc_id, host, digest (60 bits of the text's MD5), the counts of the base rules, and lines (hash, words)
    of the lines with a word."""
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[host].cast("string").alias("host"), F.coalesce(docs[text], F.lit("")).alias("text"))
    # each array is used twice in the next step, so that Spark computes it once and doesn't inline it into lambdas
    d = d.withColumns({"words": _words(F.col("text")), "full": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    d = d.withColumns({"n_words": F.size("words").cast("long"), "hashes": F.transform("words", lambda w: F.xxhash64(w))}).drop("words")
    d = d.withColumn("pairs", _zip_shifted(F.col("hashes"), 1, _mix)).drop("hashes")
    d = d.withColumn("fours", _zip_shifted(F.col("pairs"), 2, _mix)).drop("pairs")
    d = d.withColumn(
        "eights", F.when(F.col("n_words") >= WINDOW, _zip_shifted(F.col("fours"), 4, _mix)).otherwise(F.array().cast("array<bigint>"))
    ).drop("fours")
    return d.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "host", F.conv(
            F.substring(F.md5("text"), 1, 15), 16, 10
        ).cast("long").alias("digest"), "n_words",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("eights")) == F.size("eights"), F.lit(0)).otherwise(_covered(F.col("eights"))).cast("long").alias("n_repeat_words"),
        F.transform(
            F.transform("full", lambda x: _words(F.lower(x))), lambda a: F.struct(F.xxhash64(a).alias("hash"), F.size(a).alias("words"))
        ).alias("lines"),
    )


def line_quality(docs: DataFrame, most_documents: int = 10, least_words: int = 20, least_left: float = 0.5, **columns) -> DataFrame:
    """One row per document: doc_id, the base rules' counts and base_failed, removed_words (words in removed lines), kept.

    Lines are lower-cased and their spaces made single, then hashed. For each host the distinct documents of a line are counted;
    copies of one text count as one document, for removing copies is another operator's work. A line with more than
    `most_documents` of them in a host is removed from all that host's documents but the one with the least digest, so one
    carrier of shared matter stays whole. A document fails the base rules with fewer than 20 words, or where more than 30 % of the
    words lie in repeated 8-word windows; it is depleted, and rejected, where removal leaves fewer than `least_words` words or
    less than the share `least_left` of its words.

    Null or empty text: no words, so base_failed. Null host: a host of its own. Null or repeated ids: rows of their own. Empty
    table: no rows. Other columns are not read. The texts are read once and never shuffled; what is shuffled are line hashes.
    A common line's rows meet its verdict by (host, line, salt), and counts are summed before each shuffle."""
    rows = written(text_features(docs, **columns), "lines")
    lines = rows.select(
        "row_id", F.coalesce("host", F.lit("\0null")).alias("host"), "digest", F.explode("lines").alias("line")
    ).select("row_id", "host", "digest", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    texts = lines.groupBy("host", "hash", "digest").agg(F.lit(1).alias("one"))
    common = texts.groupBy("host", "hash").agg(F.count("one").alias("documents"), F.min("digest").alias("first")).where(F.col("documents") > most_documents)
    common = common.select("host", "hash", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = lines.withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int")).join(common, ["host", "hash", "salt"])
    lost = found.where(F.col("digest") != F.col("first")).groupBy("row_id").agg(F.sum("words").alias("removed_words"))
    out = rows.drop("lines").join(lost, "row_id", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    left = F.col("n_words") - F.col("removed_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (left >= least_words) & (left >= least_left * F.col("n_words"))).alias("kept"), "removed_words",
    )
