"""Operators on timed rows: spacing, anchors, interpolation, offsets, repairs, checks. One window or fold per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.arrays import bound
from strandline.operators.scan import rule, states
from strandline.sources.staging import written


def job_window():
    return Window.partitionBy("job_id")


def in_order():
    return job_window().orderBy("idx")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(x, F.lit(high) if not isinstance(high, Column) else high))


def end_before_next(start: Column, following: Column, duration: Column, last: Column) -> Column:
    """0.05 s before the next start, but 0.2 s after its own at least; `last` where none follows; never after duration."""
    return F.least(duration, F.when(following.isNull(), last).otherwise(F.greatest(start + 0.2, following - 0.05)))


def even_spacing(blocks: DataFrame) -> DataFrame:
    """(job_id, idx, text, duration) -> captions spread evenly over [0.5, max(1.5, duration - 0.5)]."""
    n = F.count("*").over(job_window())
    until = F.greatest(F.lit(1.5), F.col("duration") - 0.5)
    step = (until - 0.5) / F.greatest(F.lit(1), n)
    start, following = 0.5 + F.col("idx") * step, 0.5 + (F.col("idx") + 1) * step
    return blocks.select(
        "job_id", "idx", start.alias("start"), F.least(until, F.greatest(start + 0.2, following - 0.05)).alias("end"), "text",
        F.lit(0.0).alias("score")
    )


def anchor_spacing(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Captions through anchors (job_id, idx, t): linear between two, at most 3 s a line before the first, to the end (0.5 s a line at least) after the last.

    Blocks (job_id, idx, text, duration) and anchors are one union, filled forwards and backwards by windows: no range join. Of anchors at one idx the
    last in time counts from there on, the first up to there. Jobs without anchors give no rows."""
    rows = blocks.select("job_id", "idx", "text", "duration", F.lit(None).cast("double").alias("t"), F.lit(1).alias("kind"))
    marks = anchors.groupBy("job_id", "idx").agg(F.max("t").alias("t"))
    both = rows.join(marks.select("job_id", F.col("idx").alias("idx"), F.col("t").alias("mark")), ["job_id", "idx"], "left")
    mark = F.when(F.col("mark").isNotNull(), F.struct(F.col("idx").alias("i"), F.col("mark").alias("t")))
    both = both.withColumns({
        "n": F.count("*").over(job_window()), "left": F.last(mark, True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)),
        "right": F.last(mark, True).over(
            job_window().orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
        ),  # a frame that runs to the end would be read anew for each row
    }).where("left IS NOT NULL OR right IS NOT NULL")
    li, lt, ri, rt, i, d = F.col("left.i"), F.col("left.t"), F.col("right.i"), F.col("right.t"), F.col("idx"), F.col("duration")
    head = F.greatest(F.lit(0.0), rt - (ri - i) * F.least(F.lit(3.0), rt / F.greatest(F.lit(1), ri)))
    middle = lt + (rt - lt) * ((i - li) / F.greatest(F.lit(1), ri - li))
    tail_step = F.greatest(F.lit(0.5), (F.greatest(lt + 0.5, d - 0.5) - lt) / F.greatest(F.lit(1), F.col("n") - 1 - li))
    raw = F.when(F.col("left").isNull(), head).when(F.col("right").isNull(), F.least(d, lt + (i - li) * tail_step)).otherwise(middle)
    out = both.withColumn("raw", raw)
    start = F.least(F.greatest(F.lit(0.0), F.col("raw")), d)
    return out.select(
        "job_id", "idx", start.alias("start"), end_before_next(start, F.lead("raw").over(in_order()), d, start + 3.0).alias("end"), "text",
        F.lit(1.0).alias("score")
    )


ROWS = 1 << 16  # of a job, about, that one task goes through to find neighbours
TASK_ROWS = 1 << 19  # of all jobs, about, that one task sorts to find neighbours, however many rows there are


def neighbours(probes: DataFrame, points: DataFrame) -> DataFrame:
    """probes (job_id, at, row) with below (the last point at or before it) and above (the first after it) of points (job_id, at, p): null
    where there is none.

    Probes and points are one union, so there is no range join; neighbours are fills in order. The stretch of a job with more than ROWS rows
    is cut into equal blocks, and the neighbours that lie in other blocks come from a window over the blocks. Rows that the session's shuffles
    would deal to fewer tasks than one for TASK_ROWS are dealt to as many. Nulls in `at` are before all points."""
    both = probes.select(
        "job_id", "at", F.lit(1).alias("kind"), F.lit(None).alias("p"), "row"
    ).unionByName(points.select("job_id", "at", F.lit(0).alias("kind"), "p", F.lit(None).alias("row")))
    both = written(both, "union")
    extent = both.groupBy("job_id").agg(F.ceil(F.count("*") / F.lit(ROWS)).alias("blocks"), F.min("at").alias("low"), F.max("at").alias("high"))
    several = not extent.where("blocks > 1").isEmpty()
    part = ["job_id", "block"] if several else ["job_id"]
    # forwards, then backwards: a frame from the row to the end would be read anew for each row
    fill = lambda *order: F.last("p", True).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    fills = {"below": fill("at", "kind"), "above": fill(F.desc("at"), F.desc("kind"))}
    tasks = -(-both.count() // TASK_ROWS)
    usual = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(tasks, *part) if tasks > usual else rows
    if not several:
        return dealt(both).withColumns(fills).where("kind = 1").select("job_id", "row", "below", "above")
    share = (F.col("at") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    block = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("blocks")), F.col("blocks") - 1)
    both = both.join(extent, "job_id").select("job_id", "at", "kind", "p", "row", block.alias("block"))
    point = F.when(F.col("kind") == 0, F.col("at"))
    ends = both.groupBy("job_id", "block").agg(F.min_by("p", point).alias("first"), F.max_by("p", point).alias("last"))
    over = lambda order: job_window().orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        "job_id", "block", F.last("last", True).over(over("block")).alias("before"),
        F.last("first", True).over(over(F.desc("block"))).alias("after")
    )
    both = dealt(both).withColumns(fills).where("kind = 1").join(ends, ["job_id", "block"])
    return both.select("job_id", "row", F.coalesce("below", "before").alias("below"), F.coalesce("above", "after").alias("above"))


def interpolate(probes: DataFrame, axis: DataFrame, x: str = "x") -> DataFrame:
    """probes (job_id, x, duration, ...) with y: piecewise linear through the job's axis (ref_t, perf_t), flat beyond its ends, within [0,
    duration]. Without an axis y is x, clamped."""
    points = axis.select("job_id", F.col("ref_t").cast("double").alias("at"), F.struct(F.col("ref_t").alias("x"), F.col("perf_t").alias("y")).alias("p"))
    row = F.struct(*[c for c in probes.columns if c != "job_id"])
    out = neighbours(probes.select("job_id", F.col(x).cast("double").alias("at"), row.alias("row")), points).select("job_id", "row.*", "below", "above")
    v = F.col(x)
    slope = (F.col("above.y") - F.col("below.y")) / F.nullif(F.col("above.x") - F.col("below.x"), F.lit(0.0))
    inside = F.coalesce(F.col("below.y") + slope * (v - F.col("below.x")), F.col("below.y"))
    y = F.when(
        F.col("below").isNull() & F.col("above").isNull(), v
    ).when(F.col("below").isNull(), F.col("above.y")).when(F.col("above").isNull(), F.col("below.y")).otherwise(inside)
    return out.withColumn("y", clamp(y, 0.0, F.col("duration"))).drop("below", "above")


def active_time(fractions: DataFrame, intervals: DataFrame) -> DataFrame:
    """fractions (job_id, fraction, ...) with t: the time at which that fraction of the job's active time has passed.

    It lies in the first interval by whose end so much active time has passed: the neighbour, on the axis of active time, of the probe. A
    time within 1e-9 s of an interval's end is in that interval, so that the order in which spans are summed decides nothing. Jobs without
    intervals: 0."""
    rows = intervals.withColumn(
        "before",
        F.coalesce(F.sum(F.col("end") - F.col("start")).over(job_window().orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    )
    rows = rows.withColumn("upto", F.col("before") + F.col("end") - F.col("start"))
    job = rows.groupBy("job_id").agg(F.max("upto").alias("total"), F.min("start").alias("begin"), F.max_by("end", F.struct("start", "end")).alias("stop"))
    out = fractions.join(job, "job_id", "left").withColumn("target", F.least(F.greatest(F.col("fraction"), F.lit(0.0)), F.lit(1.0)) * F.col("total"))
    # of intervals that end at the same active time, which have no length but for one, the first counts
    points = rows.groupBy("job_id", (-F.col("upto")).alias("at")).agg(F.min(F.struct("start", "end", "before")).alias("p"))
    row = F.struct(*[c for c in out.columns if c != "job_id"])
    out = neighbours(
        out.select("job_id", (1e-9 - F.col("target")).alias("at"), row.alias("row")), points
    ).select("job_id", "row.*", F.col("below").alias("hit"))
    inside = F.coalesce(F.col("hit.start") + F.greatest(F.lit(0.0), F.col("target") - F.col("hit.before")), F.col("stop"))
    t = F.when(F.col("total").isNull(), 0.0).when(F.col("total") <= 0, F.col("begin")).otherwise(inside)
    return out.withColumn("t", t).drop("hit", "total", "begin", "stop", "target")


def shifted(captions: DataFrame, offset: Column) -> DataFrame:
    """Captions moved by offset seconds within [0, duration]; less than a millisecond moves nothing."""
    d, s, e = F.col("duration"), F.col("start"), F.col("end")
    start = clamp(s + offset, 0.0, d)
    still = F.abs(offset) < 0.001
    return captions.withColumns({
        "start": F.when(still, s).otherwise(start), "end": F.when(still, e).otherwise(F.least(F.greatest(start + 0.2, e + offset), d))
    })


def warped(captions: DataFrame, s0: Column, s1: Column, t0: Column, t1: Column) -> DataFrame:
    """Captions mapped from the span [s0, s1] to [t0, t1]; spans are 0.1 s at least, captions 0.2 s."""
    rate = F.greatest(F.lit(0.1), t1 - t0) / F.greatest(F.lit(0.1), s1 - s0)
    at = lambda x: t0 + (x - s0) * rate
    d = F.col("duration")
    start = clamp(at(F.col("start")), 0.0, d)
    return captions.withColumns({"start": start, "end": F.least(F.greatest(start + 0.2, at(F.col("end"))), d)})


def fit_to_activity(captions: DataFrame, intervals: DataFrame, keep_start: bool | Column = True) -> DataFrame:
    """Captions warped to their job's first and last active time, or with keep_start to the last only. Jobs with fewer than two captions, no
    intervals, or a span under 1 s stay."""
    spans = captions.groupBy("job_id").agg(F.count("*").alias("n"), F.min_by("start", "idx").alias("s0"), F.max_by("end", "idx").alias("s1"))
    active = intervals.groupBy("job_id").agg(F.min("start").alias("a0"), F.max("end").alias("a1"))
    rows = captions.join(spans.join(active, "job_id", "left"), "job_id")
    keep_start = F.lit(keep_start) if isinstance(keep_start, bool) else keep_start
    t0 = F.when(keep_start, F.col("s0")).otherwise(F.col("a0"))
    fits = (F.col("n") >= 2) & F.col("a1").isNotNull() & (F.col("s1") - F.col("s0") >= 1) & (F.col("a1") - t0 >= 1)
    moved = warped(rows.withColumns({"old_start": F.col("start"), "old_end": F.col("end")}), F.col("s0"), F.col("s1"), t0, F.col("a1"))
    pick = lambda name: F.when(F.coalesce(fits, F.lit(False)), F.col(name)).otherwise(F.col(f"old_{name}"))
    return moved.withColumns({"start": pick("start"), "end": pick("end")}).select(*captions.columns)


def minimum_gap(rows: DataFrame, gap: float = 0.12, raw: str = "raw") -> DataFrame:
    """Adds start: each at least `gap` after the one before, and no later than duration. A running maximum of raw - gap * idx, so no loop."""
    lead = F.max(F.col(raw) - gap * F.col("idx")).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start", F.least(F.col("duration"), lead + gap * F.col("idx")))


def clipped_ends(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with end cut 0.04 s before the next start; violations: rows whose end isn't after their start)."""
    out = rows.withColumn("end", F.least(F.col("duration"), F.coalesce(F.least("end", F.lead("start").over(in_order()) - 0.04), F.col("end"))))
    return out, out.where("end <= start")


def warp_by_map(captions: DataFrame, axis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captions on the performance's time, violations): both ends through the map, then minimum gaps, 0.2 s at least, and clipped ends."""
    first = interpolate(captions, axis, "start").withColumnRenamed("y", "raw")
    both = interpolate(first.drop("start"), axis, "end").drop("end").withColumnRenamed("y", "end")
    spaced = minimum_gap(both).drop("raw")
    return clipped_ends(spaced.withColumn("end", F.greatest(F.col("start") + 0.2, F.col("end"))))


def violations(captions: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """job_id, idx, reason: ends not after starts, overlaps of more than 1e-6 s, and with expected (job_id, n) jobs of another count. Empty
    where all is well."""
    before = F.lag("end").over(in_order())
    rows = captions.withColumn(
        "reason",
        F.when(F.col("end") <= F.col("start"), "end is not after start").when(F.col("start") < before - 1e-6, "overlaps the one before")
    )
    out = rows.where("reason IS NOT NULL").select("job_id", F.col("idx").cast("int").alias("idx"), "reason")
    if expected is not None:
        n = captions.groupBy("job_id").agg(F.count("*").alias("found"))
        wrong = expected.join(n, "job_id", "left").where(F.coalesce("found", F.lit(0)) != F.col("n"))
        out = out.unionByName(wrong.select("job_id", F.lit(-1).alias("idx"), F.lit("another count").alias("reason")))
    return out


def place_by_activity(blocks: DataFrame, intervals: DataFrame) -> DataFrame:
    """Captions at equal shares of a job's active time, in turn: 0.03 s after the one before at least, 0.8 s long at least. Jobs without
    intervals are spaced evenly."""
    n = F.count("*").over(job_window())
    jobs = intervals.select("job_id").distinct()
    has = blocks.join(jobs, "job_id", "left_semi").withColumn("n", n)
    a = active_time(has.withColumn("fraction", F.col("idx") / F.col("n")), intervals).withColumnRenamed("t", "a").drop("fraction")
    b = active_time(a.withColumn("fraction", (F.col("idx") + 1) / F.col("n")), intervals).withColumnRenamed("t", "b")
    b = b.withColumn("b", F.when(F.col("idx") + 1 < F.col("n"), F.col("b") - 0.04).otherwise(F.col("b")))
    d = lambda r: r["duration"]
    begin = lambda state, r: F.when(r["a"] < state, state + 0.03).otherwise(r["a"])
    stop = lambda start, r: F.least(d(r), F.greatest(r["b"], start + 0.8))
    stopped = lambda start, r: F.when(stop(start, r) <= start, F.least(d(r), start + 0.2)).otherwise(stop(start, r))
    # up to a the end is fixed; beyond it the end is b while that is later, then 0.83 s after the one before
    as_rule = lambda r: rule(r["a"], stopped(r["a"], r), r["b"] - 0.83, stop(r["a"], r), 0.83, d(r))
    rows = b.select("job_id", F.col("idx").cast("int").alias("idx"), "a", "b", "text", "duration")
    out = states(rows, lambda state, r: bound(begin(F.greatest(state, F.lit(0.0)), r), lambda start: stopped(start, r)), as_rule)
    whole = {c: F.col(c) for c in ("a", "duration")}
    out = out.select(
        "job_id", "idx", F.greatest(F.lit(0.0), begin(F.greatest("before", F.lit(0.0)), whole)).alias("start"), F.col("at").alias("end"),
        "text", F.lit(0.0).alias("score")
    )
    rest = even_spacing(blocks.join(jobs, "job_id", "left_anti")).withColumn("idx", F.col("idx").cast("int"))
    return out.unionByName(rest)


def chunk_windows(jobs: DataFrame) -> DataFrame:
    """job_id, low, high (exclusive) of a job's n lines: windows of 6 every 6 and 8 every 4, of 3 lines at least, and one that ends with the last line."""
    parts = []
    for size, stride in ((6, 6), (8, 4)):
        starts = F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1, F.lit(stride))).otherwise(F.array().cast("array<int>")))
        rows = jobs.select("job_id", "n", starts.alias("low")).select("job_id", "low", F.least("n", F.col("low") + size).alias("high"))
        parts += [
            rows.where("high - low >= 3"),
            jobs.where("n >= 3").select("job_id", F.greatest(F.lit(0), F.col("n") - size).alias("low"), F.col("n").alias("high"))
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
