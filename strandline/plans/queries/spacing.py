"""Spacing, offsets and warps: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import timeline, timemap
from strandline.plans.base import query, rounded
from strandline.plans.fragments import AXIS, EVEN, even
from strandline.plans.inputs import read


@query(f'WITH {EVEN} SELECT job_id, idx, round(start, 6) AS start, round("end", 6) AS "end" FROM ev')
def even_spacing(spark, d):
    return rounded(even(spark, d), "start", "end").select("job_id", "idx", "start", "end")


@query("""WITH b AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM {turns}),
    a AS (SELECT job_id, idx, 2e0 + idx * 4.5e0 AS t FROM b WHERE idx IN (1, 3)),
    x AS (SELECT b.job_id, b.idx, b.n, b.duration, max(a.idx) FILTER (a.idx <= b.idx) AS li, max(a.t) FILTER (a.idx <= b.idx) AS lt,
        min(a.idx) FILTER (a.idx >= b.idx) AS ri, min(a.t) FILTER (a.idx >= b.idx) AS rt
          FROM b JOIN a ON a.job_id = b.job_id GROUP BY b.job_id, b.idx, b.n, b.duration),
    r AS (SELECT *, CASE WHEN li IS NULL THEN greatest(0e0, rt - (ri - idx) * least(3e0, rt / greatest(1, ri)))
        WHEN ri IS NULL THEN least(duration, lt + (idx - li) * greatest(0.5e0, (greatest(lt + 0.5e0, duration - 0.5e0) - lt) / greatest(1,
        n - 1 - li)))
                    ELSE lt + (rt - lt) * (cast(idx - li AS double) / greatest(1, ri - li)) END AS raw FROM x),
    s AS (SELECT *, least(greatest(0e0, raw), duration) AS start, lead(raw) OVER (PARTITION BY job_id ORDER BY idx) AS next FROM r)
    SELECT job_id, idx, round(start, 6) AS start, round(least(duration, CASE WHEN next IS NULL THEN start + 3e0
        ELSE greatest(start + 0.2e0, next - 0.05e0) END), 6) AS "end" FROM s""")
def anchor_spacing(spark, d):
    turns = read(spark, d, "turns")
    anchors = turns.where("idx IN (1, 3)").select("job_id", "idx", (2.0 + F.col("idx") * 4.5).alias("t"))
    return rounded(timeline.anchor_spacing(turns, anchors), "start", "end").select("job_id", "idx", "start", "end")


@query(f"""WITH {EVEN}, o AS (SELECT *, (idx % 5 - 2) * 0.75e0 AS off FROM ev)
    SELECT job_id, idx, round(CASE WHEN abs(off) < 0.001 THEN start ELSE greatest(0e0, least(start + off, duration)) END, 6) AS start,
           round(CASE WHEN abs(off) < 0.001 THEN "end" ELSE least(greatest(greatest(0e0, least(start + off, duration)) + 0.2e0, "end" + off),
               duration) END, 6) AS "end" FROM o""")
def global_offset(spark, d):
    return rounded(timeline.shifted(even(spark, d), (F.col("idx") % 5 - 2) * 0.75), "start", "end").select("job_id", "idx", "start", "end")


@query(f"""WITH {EVEN}, sp AS (SELECT job_id, min(start) AS s0, max("end") AS s1 FROM ev GROUP BY job_id),
    w AS (SELECT ev.job_id, idx, duration, 3e0 + (start - s0) * (47e0 / greatest(0.1e0, s1 - s0)) AS a, 3e0 + ("end" - s0) * (47e0 / greatest(0.1e0,
        s1 - s0)) AS b FROM ev JOIN sp ON sp.job_id = ev.job_id)
    SELECT job_id, idx, round(greatest(0e0, least(a, duration)), 6) AS start, round(least(greatest(greatest(0e0, least(a, duration)) + 0.2e0, b),
        duration), 6) AS "end" FROM w""")
def affine_warp(spark, d):
    c = even(spark, d)
    s = c.groupBy("job_id").agg(F.min("start").alias("s0"), F.max("end").alias("s1"))
    return rounded(
        timeline.warped(c.join(s, "job_id"), F.col("s0"), F.col("s1"), F.lit(3.0), F.lit(50.0)), "start", "end"
    ).select("job_id", "idx", "start", "end")


@query(f"""WITH {AXIS},
    lo AS (SELECT p.event_id, max(a.ref_t) AS x0 FROM {{probes}} p JOIN ax a ON a.job_id = p.job_id AND a.ref_t <= p.x GROUP BY p.event_id),
    hi AS (SELECT p.event_id, min(a.ref_t) AS x1 FROM {{probes}} p JOIN ax a ON a.job_id = p.job_id AND a.ref_t >= p.x GROUP BY p.event_id),
    b AS (SELECT p.*, x0, x1, a.perf_t AS y0, c.perf_t AS y1 FROM {{probes}} p LEFT JOIN lo ON lo.event_id = p.event_id LEFT
        JOIN hi ON hi.event_id = p.event_id LEFT JOIN ax a ON a.job_id = p.job_id AND a.ref_t = x0 LEFT JOIN ax c ON c.job_id = p.job_id
        AND c.ref_t = x1)
    SELECT job_id, event_id, x, round(greatest(0e0, least(duration, CASE WHEN y0 IS NULL AND y1 IS NULL THEN x WHEN y0 IS NULL THEN y1
        WHEN y1 IS NULL THEN y0 WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (x - x0) END)), 6) AS y FROM b""")
def asof_interpolation(spark, d):
    out = timeline.interpolate(read(spark, d, "probes"), timemap.time_axis(read(spark, d, "axis")))
    return rounded(out, "y").select("job_id", "event_id", "x", "y")


@query("""WITH m AS (SELECT *, max(raw - 0.12e0 * idx) OVER (PARTITION BY job_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS lead_ FROM {raw_starts}),
    s AS (SELECT job_id, idx, duration, least(duration, lead_ + 0.12e0 * idx) AS start, least(duration, lead_ + 0.12e0 * idx) + 2e0 AS wish FROM m),
    e AS (SELECT *, least(duration, coalesce(least(wish, lead(start) OVER (PARTITION BY job_id ORDER BY idx) - 0.04e0), wish)) AS "end" FROM s)
    SELECT job_id, idx, round(start, 6) AS start, round("end", 6) AS "end" FROM e""")
def min_gap_spacing(spark, d):
    rows = timeline.minimum_gap(read(spark, d, "raw_starts"))
    return rounded(timeline.clipped_ends(rows.withColumn("end", F.col("start") + 2.0))[0], "start", "end").select("job_id", "idx", "start", "end")


@query(f"""WITH {EVEN}, x AS (SELECT job_id, idx, start, CASE WHEN idx % 7 = 3 THEN start - 1 WHEN idx % 5 = 2 THEN "end" + 1 ELSE "end" END AS e
        FROM ev), y AS (SELECT *, lag(e) OVER (PARTITION BY job_id ORDER BY idx) AS before FROM x)
    SELECT job_id, idx, CASE WHEN e <= start THEN 'end is not after start' ELSE 'overlaps the one before' END AS reason FROM y
        WHERE e <= start OR start < before - 1e-6""")
def sequence_violations(spark, d):
    end = F.when(F.col("idx") % 7 == 3, F.col("start") - 1).when(F.col("idx") % 5 == 2, F.col("end") + 1).otherwise(F.col("end"))
    return timeline.violations(even(spark, d).withColumn("end", end))


@query(f"""WITH {AXIS}, {EVEN},
    pr AS (SELECT job_id, idx, duration, 0 AS side, start AS x FROM ev UNION ALL SELECT job_id, idx, duration, 1, "end" FROM ev),
    lo AS (SELECT p.job_id, idx, side, max(a.ref_t) AS x0 FROM pr p JOIN ax a ON a.job_id = p.job_id AND a.ref_t <= p.x GROUP BY p.job_id, idx, side),
    hi AS (SELECT p.job_id, idx, side, min(a.ref_t) AS x1 FROM pr p JOIN ax a ON a.job_id = p.job_id AND a.ref_t >= p.x GROUP BY p.job_id, idx, side),
    b AS (SELECT p.*, x0, x1, a.perf_t AS y0, c.perf_t AS y1 FROM pr p LEFT JOIN lo ON lo.job_id = p.job_id AND lo.idx = p.idx AND lo.side = p.side
          LEFT JOIN hi ON hi.job_id = p.job_id AND hi.idx = p.idx AND hi.side = p.side
          LEFT JOIN ax a ON a.job_id = p.job_id AND a.ref_t = x0 LEFT JOIN ax c ON c.job_id = p.job_id AND c.ref_t = x1),
    y AS (SELECT *, greatest(0e0, least(duration, CASE WHEN y0 IS NULL AND y1 IS NULL THEN x WHEN y0 IS NULL THEN y1
        WHEN y1 IS NULL THEN y0 WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (x - x0) END)) AS y FROM b),
    m AS (SELECT f.job_id, f.idx, f.duration, l.y AS e, max(f.y - 0.12e0 * f.idx) OVER (PARTITION BY f.job_id ORDER BY f.idx ROWS UNBOUNDED PRECEDING) AS lead_
          FROM y f JOIN y l ON l.job_id = f.job_id AND l.idx = f.idx AND f.side = 0 AND l.side = 1),
    s AS (SELECT *, least(duration, lead_ + 0.12e0 * idx) AS start FROM m),
    w AS (SELECT *, greatest(start + 0.2e0, e) AS wish, lead(start) OVER (PARTITION BY job_id ORDER BY idx) - 0.04e0 AS next FROM s)
    SELECT job_id, idx, round(start, 6) AS start, round(least(duration, coalesce(least(wish, next), wish)), 6) AS "end" FROM w""")
def warped_captions(spark, d):
    """Evenly spaced captions through the axis of the user that has their job's number."""
    c, axis = even(spark, d), timemap.time_axis(read(spark, d, "axis"))
    return rounded(timeline.warp_by_map(c, axis)[0], "start", "end").select("job_id", "idx", "start", "end")
