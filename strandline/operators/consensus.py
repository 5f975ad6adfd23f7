"""Reconciling competing timings of a caption: consensus pairs, interlude boundaries, contextual pairs, the first line, then repair.

A caption has a handful of candidates, one a window that holds its line. They are gathered into one sorted array per caption, once, and
every rule is an expression on that array: one aggregation and one join, whatever the number of rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.arrays import bound, median_of
from strandline.functions.text import source_low
from strandline.operators.scan import rule, states
from strandline.operators.timeline import in_order, job_window

KEY = ["job_id", "idx"]
GAP = 0.12  # seconds between the starts of refined captions, at least


def bundled(captions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Captions with cands (their candidates in order), before (the end of the caption before) and after (the start of the next)."""
    c = candidates.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(
        "cand_idx", "start", "end", "confidence", "collapsed_ratio", "source"
    ))).alias("cands"))
    rows = captions.join(c.hint("merge"), KEY, "left").withColumn(
        "cands",
        F.coalesce(
            "cands",
            F.filter(
                F.array(F.struct(
                    F.lit(0).alias("cand_idx"), *[F.lit(0.0).alias(n) for n in ("start", "end", "confidence", "collapsed_ratio")],
                    F.lit("").alias("source")
                )),
                lambda x: F.lit(False)
            )
        )
    )
    return rows.withColumns({"before": F.lag("end").over(in_order()), "after": F.lead("start").over(in_order())})


def _best_pair(cands: Column, cost: Callable[[Column, Column], Column], ok: Callable[[Column, Column], Column] = lambda a, b: F.lit(True)) -> Column:
    """struct(cost, i, j, l, r) of the cheapest pair of candidates of different sources, the first among equals; null without any."""

    def pairs(c: Column) -> Column:
        return F.flatten(F.transform(
            c, lambda a,
            i: F.transform(
                F.filter(c, lambda b, j: (j > i) & (b["source"] != a["source"]) & ok(a, b)),
                lambda b: F.struct(cost(a, b).alias("cost"), a["cand_idx"].alias("i"), b["cand_idx"].alias("j"), a.alias("l"), b.alias("r"))
            )
        ))

    return bound(cands, lambda c: F.array_min(pairs(c)))


def _apart(a: Column, b: Column, name: str = "start") -> Column:
    return F.abs(a[name] - b[name])


def _middle(p: Column, name: str) -> Column:
    return (p["l"][name] + p["r"][name]) / 2


def _spread(values: Column) -> Column:
    return F.array_max(values) - F.array_min(values)


def _timing(start: Column, end: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"))


def _plain(p: Column) -> Column:
    """A timing to twelve decimals: what means of decimal times leave behind them decides no comparison."""
    return F.when(p.isNotNull(), _timing(F.round(p["start"], 12), F.round(p["end"], 12)))


def consensus_timing() -> Column:
    """Start and end where two windows agree on the start to 0.6 s; how far it may move depends on the support."""
    start, end = F.col("start"), F.col("end")
    valid = F.filter("cands", lambda c: (F.abs(c["start"] - start) <= 3.0) & (c["end"] > c["start"] + 0.08))

    def decide(v: Column) -> Column:
        def judged(p: Column) -> Column:
            l, r, at, stop = p["l"], p["r"], _middle(p, "start"), _middle(p, "end")  # noqa: E741
            collapsed = (F.least(l["collapsed_ratio"], r["collapsed_ratio"]) >= 0.75) & (F.greatest(l["confidence"], r["confidence"]) < 0.04)
            near = F.filter(v, lambda c: (F.abs(c["start"] - at) <= 0.45) & (c["confidence"] >= 0.08) & (c["collapsed_ratio"] < 0.70))
            support = F.size(F.array_distinct(F.transform(near, lambda c: c["source"])))
            strong = (_apart(l, r) <= 0.15) & (F.least(l["confidence"], r["confidence"]) >= 0.25) & (F.greatest(
                l["collapsed_ratio"], r["collapsed_ratio"]
            ) < 0.50)
            most = F.when((support >= 3) | strong, 2.8).otherwise(1.0)
            take = (_apart(l, r, "end") <= 1.0) & (F.least(l["end"], r["end"]) > at + 0.35) & (F.abs(stop - end) <= 3.0)
            return F.when((_apart(l, r) <= 0.60) & ~collapsed & (F.abs(at - start) <= most), _timing(at, F.when(take, stop).otherwise(end)))

        return bound(_best_pair(v, lambda a, b: _apart(a, b) + 0.15 * _apart(a, b, "end")), judged)

    return bound(valid, decide)


def boundary_timing() -> Column:
    """Start and end next to pauses of 4 s: after one by the windows that begin with this line, before one by all windows, where they agree."""
    start = F.col("start")
    after_pause, before_pause = F.coalesce(start - F.col("before") >= 4.0, F.lit(False)), F.coalesce(F.col("after") - F.col("end") >= 4.0, F.lit(False))
    valid = F.filter("cands", lambda c: (c["confidence"] >= 0.015) & (c["collapsed_ratio"] < 0.70) & (c["end"] > c["start"] + 0.35))
    here = F.filter(valid, lambda c: F.coalesce(source_low(c["source"]) == F.col("idx") + 1, F.lit(False)))

    def agreed(cands: Column, least: int, spread: float, most: float) -> Column:
        def judged(c: Column) -> Column:
            s, e = F.transform(c, lambda x: x["start"]), F.transform(c, lambda x: x["end"])
            at = median_of(s)
            return F.when((F.size(c) >= least) & (_spread(s) <= spread) & (F.abs(at - start) <= most), _timing(at, median_of(e)))

        return bound(cands, judged)

    return F.coalesce(F.when(after_pause, agreed(here, 2, 0.35, 3.0)), F.when(before_pause, agreed(valid, 3, 2.0, 2.5)))


def contextual_timing() -> Column:
    """Start and end where two windows that begin before the line agree on a move of more than 1 and at most 2.5 s."""
    valid = F.filter(
        "cands",
        lambda c: F.coalesce(
            source_low(c["source"]) < F.col("idx") + 1, F.lit(False)
        ) & (c["confidence"] >= 0.07) & (c["collapsed_ratio"] < 0.70) & (c["end"] > c["start"] + 0.35)
    )

    def judged(p: Column) -> Column:
        move = F.abs(_middle(p, "start") - F.col("start"))
        return F.when((move > 1.0) & (move <= 2.5), _timing(_middle(p, "start"), _middle(p, "end")))

    return bound(_best_pair(valid, _apart, lambda a, b: _apart(a, b) <= 0.60), judged)


def first_line_timing() -> Column:
    """Start of a first line that begins within 1.5 s but is sung later, by two confident windows; its end stays."""
    start = F.col("start")

    def ok(a: Column, b: Column) -> Column:
        return (F.least(a["confidence"], b["confidence"]) >= 0.15) & (F.greatest(a["collapsed_ratio"], b["collapsed_ratio"]) < 0.60) & (_apart(a, b) <= 0.35)

    def judged(p: Column) -> Column:
        at = _middle(p, "start")
        return F.when((at > start + 0.35) & (at <= start + 4.0) & (at < F.col("after") - 0.35), _timing(at, F.col("end")))

    return F.when((F.col("idx") == 0) & (start <= 1.5), bound(_best_pair(F.col("cands"), _apart, ok), judged))


def _select(captions: DataFrame, candidates: DataFrame, timing: Column, *fields: str) -> DataFrame:
    return bundled(captions, candidates).select(*KEY, timing.alias("t")).where("t IS NOT NULL").select(*KEY, *[F.col(f"t.{f}") for f in fields])


def consensus(captions: DataFrame, candidates: DataFrame) -> DataFrame:
    """job_id, idx, start, end by consensus_timing; other captions give no row. captions: job_id, idx, start, end; candidates: job_id, idx,
    cand_idx, start, end, confidence, collapsed_ratio, source."""
    return _select(captions, candidates, consensus_timing(), "start", "end")


def boundary(captions: DataFrame, candidates: DataFrame) -> DataFrame:
    """job_id, idx, start, end by boundary_timing."""
    return _select(captions, candidates, boundary_timing(), "start", "end")


def contextual(captions: DataFrame, candidates: DataFrame) -> DataFrame:
    """job_id, idx, start, end by contextual_timing."""
    return _select(captions, candidates, contextual_timing(), "start", "end")


def first_line(captions: DataFrame, candidates: DataFrame) -> DataFrame:
    """job_id, idx (0), start by first_line_timing."""
    return _select(captions, candidates, first_line_timing(), "start")


def refine(captions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Captions (with duration) moved to the first of consensus, boundary, contextual pair and, for line 0, the first line's start; then repaired.

    Adds accepted. A start within 0.12 s of the one before falls back to its caption's own, then to 0.12 s after the one before: a rule that each step needs of
    the last, gone through in blocks (see operators.scan). Jobs of fewer than three captions stay as they are."""
    n = F.count("*").over(job_window())
    rows = bundled(captions, candidates).withColumn("n", n)
    rows = rows.withColumn("p", F.when(F.col("n") >= 3, F.coalesce(consensus_timing(), boundary_timing(), contextual_timing(), first_line_timing())))
    rows = rows.withColumn("p", _plain(F.col("p")))
    rest = [c for c in captions.columns if c not in ("job_id", "idx", "start", "end")]
    rows = rows.select(
        "job_id", "idx", F.coalesce("p.start", "start").alias("wish"), F.col("start").alias("own"), "end", "p", "n",
        F.struct(*rest).alias("rest")
    )

    def step(state: Column, r: Column) -> Column:
        last = state + GAP
        at = F.when(r["wish"] <= last, r["own"]).otherwise(r["wish"])
        return F.when(at <= last, last).otherwise(at)

    out = states(rows, step, lambda r: rule(r["wish"] - GAP, r["wish"], r["own"] - GAP, r["own"], GAP))
    out = out.select("job_id", "idx", "own", "end", "p", "n", "at", "next", "rest.*")
    start = F.least(F.col("duration"), F.greatest(F.lit(0.0), F.col("at")))
    following = F.coalesce("next", "duration")
    end = F.least(F.col("duration"), F.coalesce("p.end", "end"), following - 0.05)
    end = F.when(end <= start + 0.20, F.least(F.col("duration"), F.greatest(start + 0.20, following - 0.05))).otherwise(end)
    many = F.col("n") >= 3
    return out.select(
        "job_id", "idx", F.when(many, start).otherwise(F.col("own")).alias("start"), F.when(many, end).otherwise(F.col("end")).alias("end"),
        *rest, F.col("p").isNotNull().alias("accepted")
    )


def refinement_rows(before: DataFrame, after: DataFrame, candidates: DataFrame, errors: DataFrame) -> DataFrame:
    """job_id, idx, source, dtw_start, refined_start, accepted, candidates, error: what a refinement did, a row a line with the candidates
    it had, and a row a window that gave none (idx null)."""
    cand = F.struct("start", "end", "confidence", "collapsed_ratio", "source")
    seen = candidates.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("cand_idx", cand.alias("c")))), lambda x: x["c"]).alias("candidates"))
    rows = before.select(*KEY, F.col("start").alias("dtw_start")).join(
        after.select(*KEY, F.col("start").alias("refined_start"), "accepted").hint("merge"), KEY
    ).join(seen.hint("merge"), KEY, "left")
    lines = rows.select(
        "job_id", F.col("idx").cast("int").alias("idx"), F.lit(None).cast("string").alias("source"), "dtw_start", "refined_start",
        "accepted", "candidates", F.lit(None).cast("string").alias("error")
    )
    return lines.unionByName(errors.select("job_id", "source", "error"), allowMissingColumns=True)
