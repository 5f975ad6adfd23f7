"""Choosing and mapping a reference recording: source, compatibility, pitch shift, two candidate time maps, the better one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import strip
from strandline.operators.timeline import interpolate
from strandline.operators.timemap import (
    BINS, axis_stats, build_paths, choose_method, disagreement, feature_cost, music_features, pitch_shifts, time_axis
)
from strandline.sources.scans import unreadable
from strandline.sources.staging import written


def clean_segments(segments: DataFrame) -> DataFrame:
    """Transcript segments with stripped texts, without blank ones, numbered anew per job."""
    rows = segments.withColumn("text", strip(F.col("text"))).where("text <> ''")
    return rows.withColumn("idx", F.expr("cast(row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1 AS int)"))


def prompt(blocks: DataFrame, most: int = 1600) -> DataFrame:
    """job_id, prompt: a job's texts in one line, cut to what a transcriber takes."""
    g = blocks.groupBy("job_id").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda r: F.replace(r["text"], F.lit("\n"), F.lit(" "))), " "
    ).alias("p"))
    return g.select("job_id", F.substring("p", 1, most).alias("prompt"))


def duration_error(found: Column, wanted: Column) -> Column:
    return F.abs(found - wanted) / F.greatest(F.lit(1.0), wanted)


def compatible(one: Column, other: Column, most: float = 1.18, least: float = 1.0) -> Column:
    """Whether two recordings may be of one performance: each a second long at least, lengths within a ratio."""
    return (F.least(one, other) >= least) & (F.greatest(one, other) / F.greatest(F.lit(1e-9), F.least(one, other)) <= most)


def choose_source(jobs: DataFrame, found: DataFrame | None = None, most: float = 0.15) -> DataFrame:
    """job_id, kind, source, error of jobs (job_id, file, url, url_duration, duration): the uploaded file, else the link if its length fits,
    else the recording found by search (job_id, id), else an error."""
    rows = jobs if found is None else jobs.join(found.select("job_id", F.col("id").alias("found")), "job_id", "left")
    rows = rows if found is not None else rows.withColumn("found", F.lit(None).cast("string"))
    has = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    wrong = F.coalesce(duration_error(F.col("url_duration"), F.col("duration")) > most, F.lit(False))
    kind = F.when(has("file"), "file").when(has("url") & ~wrong, "link").when(has("found"), "search")
    source = F.when(kind == "file", F.col("file")).when(kind == "link", F.col("url")).otherwise(F.col("found"))
    error = F.when(kind.isNull(), F.when(has("url"), "the link's length doesn't fit").otherwise("no reference"))
    return rows.select("job_id", kind.alias("kind"), source.alias("source"), error.alias("error"))


def turned(features: DataFrame, shifts: DataFrame) -> DataFrame:
    """Features of jobs that have a shift (job_id, shift), with the performance's chroma and onsets turned by it."""
    turn = lambda v: F.when(
        F.col("side") == "perf",
        F.concat(F.slice(v, F.lit(BINS + 1) - F.col("shift"), F.col("shift")), F.slice(v, F.lit(1), F.lit(BINS) - F.col("shift")))
    ).otherwise(F.col(v))
    return features.join(shifts, "job_id").withColumns({"chroma": turn("chroma"), "onset": turn("onset")}).drop("shift")


def alignment_cost(features: DataFrame, axis: DataFrame, rate: float) -> DataFrame:
    """job_id, cost of a time map by the features (job_id, side, frame, chroma, onset) of the frames it brings together."""
    ref, perf = (features.where(F.col("side") == s).drop("side") for s in ("ref", "perf"))
    count = perf.groupBy("job_id").agg(F.max("frame").alias("top"))
    probes = ref.join(count, "job_id").select(
        "job_id", "frame", "top", F.col("chroma").alias("chroma_a"), F.col("onset").alias("onset_a"), (F.col("frame") / rate).alias("x"),
        ((F.col("top") + 1) / rate).alias("duration")
    )
    met = interpolate(probes.join(axis.select("job_id").distinct(), "job_id", "left_semi"), axis).withColumn(
        "perf_frame", F.least(F.col("top").cast("long"), F.rint(F.col("y") * rate).cast("long"))
    )
    b = perf.select("job_id", F.col("frame").cast("long").alias("perf_frame"), F.col("chroma").alias("chroma_b"), F.col("onset").alias("onset_b"))
    return feature_cost(met.join(b, ["job_id", "perf_frame"]))


def best_map(features: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """(axis: job_id, ref_t, perf_t; report: job_id, method, error, costs, spreads, shift, disagreement) of jobs (job_id, side, frame,
    chroma, onset).

    Recordings of under a second or of lengths that differ by more than 18 % are not compared. Of the others two maps are made: a banded one
    of the chroma as it is, and a multiscale one of chroma and onsets turned to the best pitch. Both are judged on the turned features; one
    without a path, or with too wide a spread of offsets (12 s, or a tenth of the shorter recording), is out; with neither left the method
    is invalid and the job has no axis."""
    one = features.groupBy("job_id", "side").agg(((F.max("frame") + 1) / rate).alias("d")).groupBy("job_id").agg(
        F.max(F.when(F.col("side") == "ref", F.col("d"))).alias("ref"), F.max(F.when(F.col("side") == "perf", F.col("d"))).alias("perf")
    )
    short = F.coalesce(F.least("ref", "perf") < 1.0, F.lit(True)) | F.col("ref").isNull() | F.col("perf").isNull()
    lengths = one.select(
        "job_id", F.least("ref", "perf").alias("shorter"),
        F.when(short, "too short").when(~compatible(F.col("ref"), F.col("perf")), "lengths differ too much").alias("error")
    )
    features = features.join(lengths.where("error IS NULL").select("job_id"), "job_id", "left_semi")
    shifts = pitch_shifts(features)
    even = turned(features, shifts)
    banded, multiscale = time_axis(build_paths(features, rate, "legacy")), time_axis(build_paths(even, rate, "multiscale"))
    report = lengths.join(shifts, "job_id", "left")
    for axis, q, s in ((multiscale, "multiscale_cost", "multiscale_spread"), (banded, "legacy_cost", "legacy_spread")):
        report = report.join(
            alignment_cost(even, axis, rate).withColumnRenamed("cost", q), "job_id", "left"
        ).join(axis_stats(axis).select("job_id", F.col("spread").alias(s)), "job_id", "left")
    report = report.join(disagreement(multiscale, banded).withColumnRenamed("p95", "disagreement"), "job_id", "left")
    most = F.greatest(F.lit(12.0), F.col("shorter") * 0.10)
    report = report.withColumn(
        "method",
        F.when(
            F.col("error").isNull(),
            choose_method(F.col("multiscale_cost"), F.col("legacy_cost"), F.col("multiscale_spread"), F.col("legacy_spread"), most)
        ).otherwise("invalid")
    )
    report = report.withColumn("error", F.coalesce("error", F.when(F.col("method") == "invalid", "no stable time map")))
    pick = lambda axis, name: axis.join(report.where(F.col("method") == name).select("job_id"), "job_id", "left_semi")
    return pick(multiscale, "multiscale").unionByName(pick(banded, "legacy")), report


def audio_map(sides: DataFrame, files: DataFrame, frames_a_second: int = 50, samples_a_second: int = 22_050) -> tuple[DataFrame, DataFrame]:
    """best_map of recordings: (axis, report) of jobs' sides (job_id, side: ref or perf, path) and sound files (path, content), read by Spark's
    binaryFile source. The axis is what plans.pipeline takes.

    A file is decoded once, however many jobs it belongs to. Every job has a report: one with a file that is missing or can't be read has the
    method invalid and says so."""
    found = written(music_features(files, samples_a_second, frames_a_second), "features").withColumnRenamed("job_id", "path")
    features = sides.select("job_id", "side", "path").join(found, "path").drop("path")
    axis, report = best_map(features, float(frames_a_second))
    known = found.select("path").distinct()
    silent = sides.join(known, "path", "left_anti").join(unreadable(files).withColumnRenamed("job_id", "path"), "path", "left")
    reason = F.concat_ws(": ", "path", F.coalesce("error", F.lit("no sound")))
    silent = silent.groupBy("job_id").agg(F.min(reason).alias("why"))
    rows = sides.select("job_id").distinct().join(report, "job_id", "left").join(silent, "job_id", "left")
    method = F.when(F.col("why").isNotNull(), "invalid").otherwise(F.col("method"))
    return axis, rows.withColumns({"method": method, "error": F.coalesce("why", "error")}).drop("why")
