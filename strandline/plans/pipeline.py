"""Many jobs at once: each job gets a route, each route is a branch over its jobs, and the branches are one union. Every job gives captions
or one row with an error.

A run has two phases, so that a forced aligner may work in between. `start_jobs` makes everything up to the mapped captions and writes it as
tables below one path, with the windows of audio and text that the aligner is to get. `finish_jobs` reads them again, with the aligner's
results where there are any. It changes nothing below the path, so it may be run again, with other results, from another session or after a
loss."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import language_of, script_counts, strip
from strandline.operators import align, consensus, timeline
from strandline.sources import scans
from strandline.sources.staging import scratch_path, written

COLUMNS = "job_id string, idx int, start double, end double, text string, score double, sync_text string, mode string, method string, error string"
# The names of modes, as users choose them.
MODES = ("Reference audio DTW", "LRCLIB synced lyrics", "Vocal activity sequential", "Whisper fuzzy match", "Manual anchors", "Even spacing")
DTW, SYNCED, VOCAL, WHISPER, ANCHORS, EVEN = MODES
#: What a job has where its table lacks the column.
DEFAULTS = {
    "offset": 0.0, "anchors": "", "use_lyrics": True, "fit": True, "keep_start": True, "grouping": scans.BLOCKS, "choice": "Line 1",
    "refine": True, "language": "auto"
}
ITEMS = "job_id string, idx int, start double, end double, text string"
_CAPTIONS = ITEMS + ", score double, sync_text string, method string"
#: The tables of a started run: routed jobs; their blocks; captions before refinement and offset; what is wrong with jobs or captions;
#: windows for forced alignment.
STATE = {
    "jobs": "job_id string, mode string, duration double, route string, error string, offset double, refine boolean, blocks int", "captions": _CAPTIONS,
    "faults": "job_id string, k int, idx int, error string",
    "windows": "job_id string, low int, high int, at double, until double, lines array<string>, language string",
}


def prepared(jobs: DataFrame) -> DataFrame:
    """Jobs (job_id, mode, duration, text) with all columns of DEFAULTS, whose nulls they fill, reference_duration (by default duration),
    and lengths of a tenth of a second at least."""
    given = lambda c, v: F.coalesce(F.col(c), v) if c in jobs.columns else v
    length, other = scans.duration_of(F.col("duration")), scans.duration_of(given("reference_duration", F.col("duration")))
    return jobs.select(
        F.col("job_id").cast("string").alias("job_id"), "mode", length.alias("duration"), other.alias("reference_duration"),
        F.coalesce("text", F.lit("")).alias("text"), *[given(c, F.lit(v)).alias(c) for c, v in DEFAULTS.items()]
    )


def routed(jobs: DataFrame, lrc: DataFrame, axis: DataFrame) -> DataFrame:
    """Prepared jobs with route (the method's name) or error. Stamped lyrics of a job's own go before any mode; fetched ones go before
    recognised words only where they are an exact match."""
    facts = lrc.groupBy("job_id").agg(F.lit(True).alias("has_lrc"), F.bool_or("exact").alias("exact"))
    rows = jobs.join(facts, "job_id", "left").join(axis.groupBy("job_id").agg(F.lit(True).alias("has_map")), "job_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    taken = F.col("use_lyrics") & yes("exact")
    route = (
        F.when(scans.stamped_lines(F.col("text")) > 0, "stamped text")
        .when(F.col("mode") == EVEN, "even")
        .when(F.col("mode") == ANCHORS, "anchors")
        .when(F.col("mode") == SYNCED, F.when(yes("has_lrc"), "stamped lyrics").otherwise("activity"))
        .when(F.col("mode") == WHISPER, F.when(taken, "stamped lyrics").otherwise("transcript"))
        .when(F.col("mode") == VOCAL, F.when(taken, "stamped lyrics").otherwise("activity"))
        .when(F.col("mode") == DTW, F.when(yes("has_lrc"), "reference lyrics").otherwise("reference transcript"))
    )
    error = F.when(strip(F.col("text")) == "", "no lyrics").when(route.isNull(), "unknown mode").when(
        F.startswith(route, F.lit("reference")) & ~yes("has_map"), "no time map"
    )
    return rows.withColumns({"route": F.when(error.isNull(), route), "error": error}).drop("has_lrc", "exact", "has_map")


def blocks_of(jobs: DataFrame) -> DataFrame:
    """job_id, route, idx, text, sync_text, duration: the blocks of routed jobs' lyrics, without a second copy of the whole. A route through
    the reference has the reference's length."""
    rows = jobs.where("route IS NOT NULL AND route <> 'stamped text'")
    length = F.when(F.startswith("route", F.lit("reference")), F.col("reference_duration")).otherwise(F.col("duration"))
    rows = rows.select("job_id", "route", length.alias("duration"), "grouping", "choice", align.trim_copy(F.col("text"))["text"].alias("text"))
    return scans.lyric_blocks(rows, F.col("grouping"), F.col("choice")).select("job_id", "route", "idx", "text", "sync_text", "duration")


def _captions(df: DataFrame, method: str | Column) -> DataFrame:
    rows = df if "sync_text" in df.columns else df.withColumn("sync_text", F.lit(""))
    return rows.select(
        "job_id", F.col("idx").cast("int").alias("idx"), "start", "end", "text", "score", "sync_text",
        (F.lit(method) if isinstance(method, str) else method).alias("method")
    )


def _windows(mapped: DataFrame, blocks: DataFrame, jobs: DataFrame) -> DataFrame:
    """The windows of jobs whose mapped captions may be refined: job_id, low, high (exclusive), at and until (seconds of the recording, 1.5
    s wider than the captions), lines, language."""
    rows = mapped.join(jobs.where("refine").select("job_id", "language", "blocks"), "job_id").join(
        blocks.select("job_id", "idx", F.col("sync_text").alias("block_text")), ["job_id", "idx"], "left"
    )
    facts = rows.groupBy("job_id").agg(F.count("*").cast("int").alias("n"), F.first("blocks").alias("blocks"))
    chunks = timeline.chunk_windows(facts.where("n >= 3 AND n = blocks").select("job_id", "n"))
    counts = [F.sum(c).alias(f"c{k}") for k, c in enumerate(script_counts(F.col("sync_text")))]
    spoken = blocks.groupBy("job_id").agg(*counts).join(jobs.select("job_id", F.col("language").alias("configured")), "job_id")
    spoken = spoken.select("job_id", language_of(F.col("c0"), F.col("c1"), F.col("c2"), F.col("configured")).alias("language"))
    line = F.struct("idx", "start", "end", F.coalesce(F.nullif("sync_text", F.lit("")), "block_text").alias("line"), "duration")
    inside = chunks.select(
        "job_id", "low", "high", F.explode(F.sequence("low", F.col("high") - 1)).alias("idx")
    ).join(rows.select("job_id", "idx", line.alias("c")), ["job_id", "idx"])
    whole = inside.groupBy("job_id", "low", "high").agg(F.array_sort(F.collect_list("c")).alias("c"))
    first, last = F.get("c", F.lit(0)), F.get("c", F.size("c") - 1)
    whole = whole.select(
        "job_id", "low", "high", F.greatest(F.lit(0.0), first["start"] - 1.5).alias("at"),
        F.least(last["duration"], last["end"] + 1.5).alias("until"), F.transform("c", lambda x: x["line"]).alias("lines")
    )
    return whole.join(spoken, "job_id", "left")


def start_jobs(
    jobs: DataFrame, lrc: DataFrame | None = None, segments: DataFrame | None = None, intervals: DataFrame | None = None, axis: DataFrame | None = None, path: str | None = None
) -> str:
    """The first phase of run_jobs: writes the tables of STATE below path (a new folder in the shared one by default), which must not exist,
    and gives the path."""
    spark = jobs.sparkSession
    path = path or scratch_path(spark, "run")
    none = lambda schema: spark.createDataFrame([], schema)
    lrc = none(ITEMS + ", exact boolean") if lrc is None else lrc if "exact" in lrc.columns else lrc.withColumn("exact", F.lit(True))
    segments = none(ITEMS) if segments is None else segments
    intervals = none("job_id string, idx int, start double, end double") if intervals is None else intervals
    axis = none("job_id string, ref_t double, perf_t double") if axis is None else axis
    jobs = written(routed(prepared(jobs), lrc, axis), "jobs")
    blocks = written(blocks_of(jobs), "blocks")
    on = lambda *routes: jobs.where(F.col("route").isin(*routes))
    of = lambda df, *routes: df.join(on(*routes).select("job_id"), "job_id", "left_semi")
    blocks_on = lambda route: blocks.where(F.col("route") == route).drop("route")
    items = lrc.drop("exact")

    own = scans.lrc_items(on("stamped text")).withColumn("score", F.lit(1.0))
    even = timeline.even_spacing(blocks_on("even"))

    manual = blocks_on("anchors")
    counted = on("anchors").join(manual.groupBy("job_id").agg(F.count("*").alias("n")), "job_id")
    anchors, wrong = scans.timing_anchors(counted.select("job_id", "n", "duration", "anchors"))
    wrong = wrong.select("job_id", F.concat_ws(": ", "reason", "line").alias("error"))
    placed = timeline.anchor_spacing(manual, anchors)

    synced = align.align_to_lrc(blocks_on("stamped lyrics"), of(items, "stamped lyrics")).join(
        on("stamped lyrics").select("job_id", "duration", "fit", "keep_start"), "job_id"
    )
    moved = timeline.fit_to_activity(synced.where("fit"), of(intervals, "stamped lyrics"), F.col("keep_start"))
    synced = synced.where("NOT fit").unionByName(moved)

    heard = align.align_to_segments(blocks_on("transcript"), of(segments, "transcript"))
    active = timeline.place_by_activity(blocks_on("activity"), of(intervals, "activity"))

    on_lines = _captions(align.align_to_lrc(blocks_on("reference lyrics"), of(items, "reference lyrics")), "stamped lyrics")
    on_words = align.align_to_reference(blocks_on("reference transcript"), of(segments, "reference transcript"), of(intervals, "reference transcript"))
    mapped = on_lines.unionByName(_captions(on_words, F.col("method"))).join(jobs.select("job_id", "duration"), "job_id")
    mapped, unfit = timeline.warp_by_map(written(mapped, "reference"), of(axis, "reference lyrics", "reference transcript"))
    unfit = unfit.select("job_id", "idx", F.format_string("caption %d has no length on the map", F.col("idx") + 1).alias("error"))

    counts = blocks.groupBy("job_id").agg(F.count("*").cast("int").alias("blocks"))
    jobs = jobs.join(counts, "job_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    parts = [
        _captions(own, "stamped text"), _captions(even, "even"), _captions(placed, "anchors"), _captions(synced, "stamped lyrics"),
        _captions(heard, "transcript"), _captions(active, "activity"), _captions(mapped, F.col("method"))
    ]
    fault = lambda df, k: df.select(
        "job_id", F.lit(k).alias("k"), (F.col("idx") if "idx" in df.columns else F.lit(0)).cast("int").alias("idx"), "error"
    )
    faults = fault(jobs.where("error IS NOT NULL").select("job_id", "error"), 0).unionByName(fault(wrong, 1)).unionByName(fault(unfit, 2))
    out = {"jobs": jobs, "captions": reduce(DataFrame.unionByName, parts), "faults": faults}
    for name, rows in out.items():
        _put(rows, path, name)
    timed = _state(spark, path, "captions").join(jobs.where(F.startswith("route", F.lit("reference"))).select("job_id", "duration"), "job_id")
    _put(_windows(timed, blocks, jobs), path, "windows")
    return path


def _put(rows: DataFrame, path: str, name: str) -> None:
    rows.select(*[c.split()[0] for c in STATE[name].split(", ")]).write.option("compression", "zstd").parquet(f"{path}/{name}")


def _state(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(STATE[name]).parquet(f"{path}/{name}")


def alignment_windows(spark: SparkSession, path: str) -> DataFrame:
    """What a forced aligner is to get of a started run: job_id, low, high (exclusive), at, until (its part of the recording), lines (its
    texts, in order), language."""
    return _state(spark, path, "windows")


def _refined(spark: SparkSession, path: str, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(mapped captions with windows, refined ones with accepted, their candidates, errors of windows): of the jobs that have windows."""
    windows, jobs = _state(spark, path, "windows"), _state(spark, path, "jobs")
    own = windows.select("job_id").distinct()
    mapped = _state(spark, path, "captions").join(jobs.select("job_id", "duration"), "job_id").join(own, "job_id", "left_semi")
    found, errors = scans.forced_candidates(windows.select("job_id", "low", "high"), mapped, results)
    found = written(found, "candidates")
    return mapped, consensus.refine(mapped, found), found, errors


def finish_jobs(spark: SparkSession, path: str, results: DataFrame | None = None) -> DataFrame:
    """The second phase of run_jobs, from what start_jobs wrote below path: captions or an error of each job.

    results: what forced alignment gave for windows (job_id, low, high, result: JSON, see scans.forced_candidates), times counting from the
    window's begin. Mapped jobs with `refine` whose captions are as many as their blocks, and three at least, are refined by them; a window
    without a result, or with another number of segments than it has lines, gives no candidate (`refinement_notes` lists these). Without
    results nothing is refined."""
    jobs, captions, faults = (_state(spark, path, name) for name in ("jobs", "captions", "faults"))
    if results is not None:
        mapped, refined, _, _ = _refined(spark, path, results)
        captions = captions.join(mapped.select("job_id").distinct(), "job_id", "left_anti").unionByName(refined.drop("duration", "accepted"))
    out = captions.join(jobs.select("job_id", "mode", "route", "offset", "duration"), "job_id")
    out = written(timeline.shifted(out, F.when(F.col("route") == "stamped text", 0.0).otherwise(F.col("offset"))), "captions")

    on_map = F.startswith("route", F.lit("reference"))
    made = out.where(on_map).select("job_id").distinct()
    expected = jobs.where(on_map).join(made, "job_id", "left_semi").select("job_id", F.col("blocks").alias("n"))
    late = timeline.violations(out.where(on_map), expected)
    said = F.when(F.col("idx") < 0, "other captions than blocks").otherwise(F.format_string("caption %d: %s", F.col("idx") + 1, F.col("reason")))
    ranked = faults.unionByName(late.select("job_id", F.lit(3).alias("k"), "idx", said.alias("error")))
    errors = written(ranked.groupBy("job_id").agg(F.min(F.struct("k", "idx", "error"))["error"].alias("error")), "errors")
    good = out.join(errors.select("job_id"), "job_id", "left_anti")
    silent = jobs.join(good.select("job_id").unionByName(errors.select("job_id")).distinct(), "job_id", "left_anti")
    why = F.when(F.col("route").isin("stamped lyrics", "reference lyrics"), "no lyric blocks or no stamped line").otherwise("no lyric blocks")
    errors = errors.unionByName(silent.select("job_id", why.alias("error"))).join(jobs.select("job_id", "mode"), "job_id")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return good.withColumn("error", F.lit(None).cast("string")).select(*names).unionByName(errors, allowMissingColumns=True).select(*names)


def refinement_notes(spark: SparkSession, path: str, results: DataFrame) -> DataFrame:
    """What refining a started run by results does (see consensus.refinement_rows): a row a line with its candidates, a row a window that
    gave none, and a row with an error for each mapped job that is to be refined and can't be, as it has fewer than three captions or other
    captions than blocks."""
    mapped, refined, found, errors = _refined(spark, path, results)
    jobs = _state(spark, path, "jobs").where(F.startswith("route", F.lit("reference")) & F.col("refine") & F.col("error").isNull())
    skipped = jobs.join(_state(spark, path, "windows").select("job_id").distinct(), "job_id", "left_anti")
    skipped = skipped.select(
        "job_id", F.lit(None).cast("string").alias("source"),
        F.lit("not refined: other captions than blocks, or fewer than three").alias("error")
    )
    return consensus.refinement_rows(mapped, refined, found, errors.unionByName(skipped))


def run_jobs(
    jobs: DataFrame, lrc: DataFrame | None = None, segments: DataFrame | None = None, intervals: DataFrame | None = None, axis: DataFrame | None = None
) -> DataFrame:
    """job_id, idx, start, end, text, score, sync_text, mode, method, error: the captions of each job (job_id, mode, duration, text, and
    what DEFAULTS lists), or one row of it with an error and no idx.

    lrc: stamped lyrics that were found (job_id, idx, start, end, text, and exact: whether names and titles agree); segments: recognised
    words; intervals: active time; axis: the map of times of the reference to the performance's. A table that isn't given counts as empty.

    A job whose text is stamped takes its own times, and no offset. Else, by mode: even spacing; anchors; stamped lyrics, which are then
    fitted to the active time (`fit`), or active time; transcript; or the reference's times, from stamped lyrics, its transcript or its
    active time, moved through the map. The offset comes last. To refine mapped captions by forced alignment, call start_jobs and
    finish_jobs in place of this. Errors: no lyrics, no blocks in them, an unknown mode, bad anchors or none, no stamped line, no time map,
    and for a mapped job captions without length, that overlap, or that are not as many as its blocks.

    Routed jobs, their blocks and the captions of all routes are written between the steps, so each is made once and no plan holds all of
    them."""
    return finish_jobs(jobs.sparkSession, start_jobs(jobs, lrc, segments, intervals, axis))
