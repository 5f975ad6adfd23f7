"""Active intervals of a sampled level: smoothing, a threshold from percentiles, islands, padding, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW, HOP = 0.20, 0.10


def frame_levels(samples: DataFrame, window: float = WINDOW, hop: float = HOP) -> DataFrame:
    """job_id, frame, t, rms of samples (job_id, t, x): full windows of `window` seconds, one each `hop`. A sample lies in window/hop
    frames, so each is exploded that often."""
    k = round(window / hop)
    last = F.max("t").over(Window.partitionBy("job_id"))
    at = F.floor(F.col("t") / hop + 1e-9).cast("long")
    rows = samples.withColumn("until", last).select(
        "job_id", "x", "until", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), at - (k - 1)), at)).alias("frame")
    )
    rows = rows.where((F.col("frame") == 0) | (F.col("frame") * hop + window <= F.col("until") + hop))
    return rows.groupBy("job_id", "frame").agg(F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-12).alias("rms")).withColumn("t", F.col("frame") * hop)


def smoothed(frames: DataFrame) -> DataFrame:
    """rms as a centred mean of five with zeros beyond the ends, for jobs of five frames or more."""
    w = Window.partitionBy("job_id")
    five = F.sum("rms").over(w.orderBy("frame").rowsBetween(-2, 2)) / 5
    return frames.withColumn("rms", F.when(F.count("*").over(w) >= 5, five).otherwise(F.col("rms")))


def active_frames(frames: DataFrame) -> DataFrame:
    """Adds active: rms of at least max(1.8 p35, p35 + 0.22 (p92 - p35), 0.006), by exact percentiles of the job."""
    p = frames.groupBy("job_id").agg(F.percentile("rms", F.array(F.lit(0.35), F.lit(0.92))).alias("p"))
    low, high = F.col("p")[0], F.col("p")[1]
    return frames.join(
        p.select("job_id", F.greatest(low * 1.8, low + (high - low) * 0.22, F.lit(0.006)).alias("limit")), "job_id"
    ).withColumn("active", F.col("rms") >= F.col("limit")).drop("limit")


def islands(frames: DataFrame, window: float = WINDOW) -> DataFrame:
    """job_id, start, end of runs of active frames. A run ends `window` after the first inactive frame; one that ends with the job `window`
    after its last frame, within duration."""
    w = Window.partitionBy("job_id").orderBy("frame")
    rows = frames.withColumns({"run": F.sum(F.when(F.col("active"), 0).otherwise(1)).over(w), "next": F.lead("t").over(w)}).where("active")
    runs = rows.groupBy("job_id", "run").agg(
        F.min("t").alias("start"), F.max_by("next", "frame").alias("next"), F.max("t").alias("last"), F.max("duration").alias("duration")
    )
    return runs.select("job_id", "duration", "start", F.coalesce(F.col("next") + window, F.least(F.col("duration"), F.col("last") + window)).alias("end"))


def merged(intervals: DataFrame, gap: float = 0.75, before: float = 0.12, after: float = 0.20, least: float = 0.35) -> DataFrame:
    """job_id, idx, start, end: padded within [0, duration], of `least` seconds at least, joined where `gap` or less apart."""
    rows = intervals.withColumns({
        "start": F.greatest(F.lit(0.0), F.col("start") - before), "end": F.least("duration", F.col("end") + after)
    }).where(F.col("end") - F.col("start") >= least)
    w = Window.partitionBy("job_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("start") - reach <= gap, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("job_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(
        "job_id", (F.col("run") - 1).cast("int").alias("idx"), "start", "end"
    )


def activity(frames: DataFrame) -> DataFrame:
    """Active intervals (job_id, idx, start, end) of frames (job_id, frame, t, rms, duration). The job is the only shuffle key."""
    return merged(islands(active_frames(smoothed(frames))))
