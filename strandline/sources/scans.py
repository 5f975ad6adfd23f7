"""Readers of stamped lyrics, blocks, anchors, metadata, search results, forced alignments and WAV samples."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.arrays import bound, field
from strandline.functions.text import BAR, NOISE_WORDS, strip, sync_line

# A stamped line (minutes, seconds, fraction, text), and an anchor line (index, time).
STAMP = r"^\[(\d{1,2}):(\d{2})(?:[.:](\d{1,3}))?\](?U)\s*(?-U)(.*)"
ANCHOR = r"^(\d+)\s*(?:=|:|,)\s*([0-9:.]+)\s*$"


def lines_of(df: DataFrame, text: str = "text") -> DataFrame:
    """Explodes a text column into line_no, line."""
    return df.select("*", F.posexplode(F.split(text, r"\R")).alias("line_no", "line"))


def duration_of(probed: Column) -> Column:
    """A probed length in seconds, a tenth at least."""
    return F.greatest(F.lit(0.1), probed.cast("double"))


def _stamped(text: Column) -> Column:
    """Array of (line_no, t, text) of a text's stamped lines; only the first stamp of a line is read."""
    part = lambda line, k: F.regexp_extract(line, STAMP, k)

    def event(r: Column) -> Column:
        digits = part(r["line"], 3)
        fraction = F.when(digits == "", F.lit(0.0)).otherwise(digits.try_cast("double") / F.pow(F.lit(10.0), F.length(digits)))
        return F.struct(
            r["line_no"].alias("line_no"),
            (part(r["line"], 1).try_cast("int") * 60 + part(r["line"], 2).try_cast("int") + fraction).alias("t"),
            strip(part(r["line"], 4)).alias("text")
        )

    lines = F.transform(F.split(text, r"\R"), lambda x, i: F.struct(i.alias("line_no"), strip(x).alias("line")))
    return F.transform(F.filter(lines, lambda r: r["line"].rlike(STAMP)), event)


def lrc_events(df: DataFrame, text: str = "text") -> DataFrame:
    """job_id, duration, line_no, t, text of stamped lines, those without text among them."""
    return df.select("job_id", "duration", F.explode(_stamped(F.col(text))).alias("e")).select("job_id", "duration", "e.*")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def next_greater(values: pd.Series) -> pd.Series:
    """For each number of an array the first later one that is greater, null without one; by a stack of those that still wait, so in linear time."""

    def one(x: np.ndarray) -> list:
        out, waiting = [None] * len(x), []
        for i, v in enumerate(x.tolist()):
            while waiting and x[waiting[-1]] < v:
                out[waiting.pop()] = v
            waiting.append(i)
        return out

    return pd.Series([None if v is None else one(np.asarray(v)) for v in values], dtype=object)


def lrc_items(df: DataFrame, text: str = "text") -> DataFrame:
    """job_id, idx, start, end, text. A line without text only ends the one before. An item ends 0.05 s before the first later line (in file
    order) with a greater time, after 0.2 s at least; the last after 3.5 s. A job's text is one row, and its lines stay arrays of that row
    until they are items: nothing is shuffled."""
    rows = df.select("job_id", "duration", _stamped(F.col(text)).alias("events"))
    rows = rows.withColumn("after", next_greater(field(F.col("events"), "t")))
    both = F.transform("events", lambda e, i: F.struct(e["t"].alias("t"), e["text"].alias("text"), F.get("after", i).alias("next")))
    out = rows.select(
        "job_id", "duration", F.posexplode(F.filter(both, lambda e: e["text"] != "")).alias("idx", "e")
    ).select("job_id", "duration", "idx", "e.*")
    end = F.least(F.col("duration"), F.when(F.col("next").isNull(), F.col("t") + 3.5).otherwise(F.greatest(F.col("t") + 0.2, F.col("next") - 0.05)))
    return out.select("job_id", "idx", F.col("t").alias("start"), end.alias("end"), "text")


def lrc_count(df: DataFrame, text: str = "text") -> DataFrame:
    """job_id, n: stamped lines with text, 0 for jobs without any."""
    return df.select("job_id", stamped_lines(F.col(text)).alias("n"))


def stamped_lines(text: Column) -> Column:
    """How many stamped lines with text a text has."""
    return F.coalesce(F.size(F.filter(_stamped(text), lambda e: e["text"] != "")), F.lit(0))


LINES, BLOCKS = "Every non-empty line", "Blank-line blocks"


def lyric_blocks(df: DataFrame, grouping: str | Column = BLOCKS, choice: str | Column = "Line 1", text: str = "text") -> DataFrame:
    """job_id, idx, text, sync_text, and df's other columns. Bracketed directions are deleted first, across lines too. Blocks are parted by
    blank lines, or every line is one."""
    grouping = F.lit(grouping) if isinstance(grouping, str) else grouping
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\[.*?\]", ""), r"\r\n?", "\n")
    clean = lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != ""), "\n")
    parts = F.when(grouping == LINES, F.split(body, "\n")).otherwise(F.split(strip(body), r"\n\s*\n+"))
    rows = df.select(
        *[c for c in df.columns if c != text], grouping.alias("grouping_"),
        F.posexplode(F.filter(F.transform(parts, clean), lambda b: b != "")).alias("idx", "text")
    )
    return rows.withColumn("sync_text", F.when(F.col("grouping_") == LINES, F.col("text")).otherwise(sync_line(F.col("text"), choice))).drop("grouping_")


def time_value(s: Column) -> Column:
    """Seconds of "s", "m:s" or "h:m:s", of which only the seconds may have a fraction; null for anything else."""
    p = F.split(strip(s), ":")
    whole, last = (lambda k: strip(F.get(p, F.lit(k))).try_cast("int")), strip(F.get(p, F.size(p) - 1)).try_cast("double")
    return F.when(F.size(p) == 1, last).when(F.size(p) == 2, whole(0) * 60 + last).when(F.size(p) == 3, whole(0) * 3600 + whole(1) * 60 + last)


def timing_anchors(df: DataFrame, text: str = "anchors") -> tuple[DataFrame, DataFrame]:
    """(anchors: job_id, idx from 0, t; violations: job_id, line, reason) of df (job_id, n, duration, text), lines "index = time".

    Blank lines and comments are skipped, repeats dropped; the anchors are in order of index. A job with a violation, or without any anchor,
    is reported, not raised. That a text has no anchors is seen by itself, whatever other rows have its job_id."""
    rows = lines_of(
        df.select("job_id", "n", "duration", F.col(text).alias("raw")), "raw"
    ).withColumn("line", strip(F.col("line"))).where("line <> '' AND NOT startswith(line, '#')")
    rows = rows.select(
        "job_id", "n", "duration", "line", F.regexp_extract("line", ANCHOR, 1).try_cast("int").alias("i"),
        time_value(F.regexp_extract("line", ANCHOR, 2)).alias("t")
    )
    bad = F.when(F.col("i").isNull() | F.col("t").isNull(), "not an anchor").when((F.col("i") < 1) | (F.col("i") > F.col("n")), "index out of range").when((F.col("t") < 0) | (F.col("t") > F.col("duration")), "time out of range")
    rows = rows.withColumn("reason", bad)
    good = rows.where("reason IS NULL").select("job_id", (F.col("i") - 1).alias("idx"), "t").distinct()
    back = good.withColumn("before", F.lag("t").over(Window.partitionBy("job_id").orderBy("idx", "t"))).where("t <= before")
    some = F.exists(F.split(text, r"\R"), lambda x: (strip(x) != "") & ~F.startswith(strip(x), F.lit("#")))
    none = df.where(~F.coalesce(some, F.lit(False))).select("job_id", F.lit(None).cast("string").alias("line"), F.lit("no anchors").alias("reason"))
    wrong = rows.where("reason IS NOT NULL").select("job_id", "line", "reason").unionByName(none).unionByName(back.select(
        "job_id", F.format_string("%d = %s", F.col("idx") + 1, F.col("t")).alias("line"), F.lit("times must rise").alias("reason")
    ))
    return good, wrong


METADATA = "artist string, creator string, track string, alt_title string, title string, channel string, uploader string, duration double"


def metadata_fields(payload: Column, artist: Column, title: Column) -> Column:
    """struct(artist, title) from a media description in JSON; unreadable ones give the fallbacks."""
    wanted = {"title": ("title",), "track": ("track", "alt_title"), "artist": ("artist", "creator"), "channel": ("channel", "uploader")}

    def named(m: Column) -> Column:
        first = lambda *names: F.coalesce(*[F.nullif(strip(m[n]), F.lit("")) for n in names], F.lit(""))
        return F.struct(*[first(*names).alias(k) for k, names in wanted.items()])

    def cut(r: Column) -> Column:
        cleaned = strip(F.regexp_replace(r["title"], rf"(?iU)[(\[{{][^)\]}}]*\b(?:{NOISE_WORDS})\b[^)\]}}]*[)\]}}]", ""))
        return bound(cleaned, lambda c: F.struct(c.alias("cleaned"), F.split(c, " - ", 2).alias("halves"), r.alias("r")))

    def judged(x: Column) -> Column:
        r, halves = x["r"], x["halves"]
        split = (r["track"] == "") & (F.size(halves) == 2)
        who = F.when(split & (r["artist"] == ""), strip(halves[0])).otherwise(r["artist"])
        what = F.when(split, strip(F.get(halves, F.lit(1)))).otherwise(r["track"])
        what = bound(what, lambda w: F.when(w == "", x["cleaned"]).otherwise(w))
        what = strip(F.get(F.split(what, BAR, 2), F.lit(0)))
        topic = strip(F.regexp_replace(r["channel"], r"(?iU)\s*-\s*Topic\s*$", ""))
        return F.struct(bound(who, lambda w: F.when(w == "", topic).otherwise(w)).alias("artist"), what.alias("title"))

    pick = lambda v, other: F.coalesce(F.nullif(v, F.lit("")), other)
    # each step's values are computed once, however often the next uses them
    steps = bound(bound(bound(F.from_json(payload, METADATA), named), cut), judged)
    return bound(steps, lambda v: F.struct(pick(v["artist"], artist).alias("artist"), pick(v["title"], title).alias("title")))


def uploaded_path(value: Column) -> Column:
    """The path of an upload: a plain string as it is, or of a JSON object its path, else its name; null where neither is given."""
    m = F.from_json(value, "path string, name string")
    named = F.coalesce(F.nullif(m["path"], F.lit("")), F.nullif(m["name"], F.lit("")))
    return F.when(F.startswith(F.trim(value), F.lit("{")), named).otherwise(value)


def newest_metadata(spark, path: str) -> DataFrame:
    """folder, payload: of each folder under path the newest *.info.json."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.info.json").option("recursiveFileLookup", "true").load(path)
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.max_by(
        F.col("content").cast("string"), F.struct("modificationTime", "path")
    ).alias("payload"))


def search_entries(df: DataFrame, entries: str = "payload") -> DataFrame:
    """Search results exploded: pos, id, title, channel, duration; those without an id or a length are dropped."""
    schema = "entries array<struct<id: string, title: string, channel: string, uploader: string, duration: double>>"
    e = df.select("*", F.posexplode(F.from_json(entries, schema)["entries"]).alias("pos", "e"))
    rows = e.select(
        *df.columns, "pos", F.col("e.id").alias("id"), F.coalesce("e.title", F.lit("")).alias("title"),
        F.coalesce(F.when(F.col("e.channel") != "", F.col("e.channel")), F.col("e.uploader"), F.lit("")).alias("channel"),
        F.col("e.duration").alias("duration")
    )
    return rows.where("id <> '' AND duration > 0").drop(entries)


#: What a forced alignment of one window gives.
FORCED = "segments array<struct<start: double, end: double, words: array<struct<start: double, end: double, probability: double>>>>"


def forced_candidates(windows: DataFrame, captions: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates: job_id, idx, cand_idx, start, end, confidence, collapsed_ratio, source; errors: job_id, source, error) of windows
    (job_id, low, high) of captions (job_id, idx, start, end, duration) and forced results (job_id, low, high, result: JSON with FORCED).

    A window's audio begins 1.5 s before its first caption, within the recording; its segments' times are from there. Their i-th segment
    times its i-th line. A window whose result has another number of segments than it has lines, or none, gives an error. A line's
    candidates are in the order of its windows. Windows, captions and results all grow with the jobs, so they are joined by shuffles: their columns look
    small enough to broadcast long after they no longer are."""
    first = captions.select("job_id", F.col("idx").alias("low"), F.greatest(F.lit(0.0), F.col("start") - 1.5).alias("at"))
    rows = windows.join(first.hint("merge"), ["job_id", "low"]).join(
        results.select("job_id", "low", "high", F.from_json("result", FORCED)["segments"].alias("segments")).hint("merge"),
        ["job_id", "low", "high"], "left"
    )
    rows = rows.withColumns({
        "n": F.coalesce(F.size("segments"), F.lit(0)),
        "source": F.concat((F.col("low") + 1).cast("string"), F.lit("-"), F.col("high").cast("string"))
    })
    fits = F.col("n") == F.col("high") - F.col("low")
    errors = rows.where(~fits).select(
        "job_id", "source", F.format_string("%d segments in place of %d", F.col("n"), F.col("high") - F.col("low")).alias("error")
    )
    found = rows.where(fits).select("job_id", "low", "high", "at", "source", F.posexplode("segments").alias("k", "s"))
    found = word_stats(found.withColumn("words", F.coalesce("s.words", F.array().cast("array<struct<start: double, end: double, probability: double>>"))))
    time = lambda name: (F.col("at") + F.coalesce(F.col(f"s.{name}"), F.lit(0.0))).alias(name)
    found = found.select(
        "job_id", (F.col("low") + F.col("k")).cast("int").alias("idx"), "low", "high", time("start"), time("end"), "confidence",
        "collapsed_ratio", "source"
    )
    order = F.row_number().over(Window.partitionBy("job_id", "idx").orderBy("low", "high")) - 1
    return found.withColumn("cand_idx", order.cast("int")).drop("low", "high"), errors


def word_stats(df: DataFrame, words: str = "words") -> DataFrame:
    """Adds collapsed_ratio (share of words under 0.04 s) and confidence (mean probability) of a words array; both 0 without words."""
    n = F.greatest(F.lit(1), F.size(words))
    time = lambda x, name: F.coalesce(x[name], F.lit(0.0))
    short = F.size(F.filter(words, lambda x: time(x, "end") - time(x, "start") < 0.04))
    total = F.aggregate(words, F.lit(0.0), lambda t, x: t + F.coalesce(x["probability"], F.lit(0.0)))
    return df.withColumns({"collapsed_ratio": F.coalesce(short / n, F.lit(0.0)), "confidence": F.coalesce(total / n, F.lit(0.0))})


def mono(content: bytes, rate: int | None = None) -> np.ndarray:
    """The samples of a 16-bit WAV file between -1 and 1, the mean of its channels, at `rate` a second by linear interpolation (its own by default)."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("not 16-bit samples")
        own, channels = w.getframerate(), w.getnchannels()
        raw = w.readframes(w.getnframes())
        if len(raw) != 2 * channels * w.getnframes():
            raise ValueError("cut off")
        x = np.frombuffer(raw, dtype="<i2").astype(np.float32).reshape(-1, channels).mean(axis=1) / 32768.0
    if not len(x) or rate in (None, own):
        return x
    return np.interp(np.arange(int(len(x) * rate / own)) / rate, np.arange(len(x)) / own, x).astype(np.float32)


def unreadable(files: DataFrame) -> DataFrame:
    """job_id (the path), error: of the files (path, content) that `mono` can't read: no WAV file, cut off, or not of 16-bit samples. Frames
    and features leave them out."""

    def run(batches):
        for pdf in batches:
            errors = [(path, signal(content)[1]) for path, content in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame([e for e in errors if e[1]], columns=["job_id", "error"])

    return files.select("path", "content").mapInPandas(run, "job_id string, error string")


def signal(content: bytes, rate: int | None = None) -> tuple[np.ndarray, str | None]:
    """(the samples of a file, none where it can't be read; why it can't)."""
    try:
        return mono(content, rate), None
    except (wave.Error, EOFError, ValueError, struct.error, TypeError) as e:
        return np.zeros(0, dtype=np.float32), str(e) or type(e).__name__


def wav_frames(files: DataFrame, window: float = 0.20, hop: float = 0.10, rate: int | None = 16_000) -> DataFrame:
    """job_id (the path), frame, t, rms, duration of 16-bit WAV files read by Spark's binaryFile source; one short frame where the signal is
    shorter than a window. Files that can't be read give no frames; `unreadable` lists them."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                x, _ = signal(content, rate)
                if not len(x):
                    continue
                with wave.open(io.BytesIO(content)) as w:
                    own = rate or w.getframerate()
                size, step = max(1, int(own * window)), max(1, int(own * hop))
                starts = np.arange(0, max(1, len(x) - size + 1), step)
                squares = np.concatenate([[0.0], np.cumsum(x.astype(np.float64) ** 2)])
                ends = np.minimum(starts + size, len(x))
                rms = np.sqrt((squares[ends] - squares[starts]) / (ends - starts) + 1e-12)
                yield pd.DataFrame({"job_id": path, "frame": np.arange(len(starts)), "t": starts / own, "rms": rms, "duration": len(x) / own})

    return files.select("path", "content").mapInPandas(run, "job_id string, frame int, t double, rms double, duration double")
