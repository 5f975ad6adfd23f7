"""Active time: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import activity, timeline
from strandline.plans.base import query, rounded
from strandline.plans.fragments import EVEN, MERGE, SHARES, SPELLS, even
from strandline.plans.inputs import read


_ACTIVITY = """
    m AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY job_id) >= 5 THEN sum(rms) OVER (PARTITION BY job_id ORDER BY frame ROWS BETWEEN 2 PRECEDING
        AND 2 FOLLOWING) / 5 ELSE rms END AS level FROM {frames}),
    p AS (SELECT job_id, quantile_cont(level, 0.35) AS lo, quantile_cont(level, 0.92) AS hi FROM m GROUP BY job_id),
    f AS (SELECT m.*, level >= greatest(lo * 1.8e0, lo + (hi - lo) * 0.22e0, 0.006e0) AS active FROM m JOIN p ON p.job_id = m.job_id),
    r AS (SELECT *, sum(CASE WHEN active THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY frame) AS run,
        lead(t) OVER (PARTITION BY job_id ORDER BY frame) AS next FROM f),
    s AS (SELECT job_id, duration, min(t) AS s, coalesce(arg_max(next, frame) FILTER (next IS NOT NULL
        AND frame = top) + 0.2e0, least(duration, max(t) + 0.2e0)) AS e
          FROM (SELECT *, max(frame) OVER (PARTITION BY job_id, run) AS top FROM r WHERE active) GROUP BY job_id, duration, run),"""


@query(f'WITH {_ACTIVITY} {MERGE} SELECT job_id, idx, round(s, 6) AS start, round(e, 6) AS "end" FROM iv')
def activity_intervals(spark, d):
    return rounded(activity.activity(read(spark, d, "frames")), "start", "end")


@query(f'WITH {SPELLS} {MERGE} SELECT job_id, idx, round(s, 6) AS start, round(e, 6) AS "end" FROM iv')
def merged_intervals(spark, d):
    return rounded(activity.merged(read(spark, d, "spells")), "start", "end")


@query(f"""WITH {SPELLS} {MERGE},
    c AS (SELECT *, sum(e - s) OVER (PARTITION BY job_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS upto, sum(e - s) OVER (PARTITION BY job_id) AS total
        FROM iv),
    q AS (SELECT job_id, k / 10e0 AS fraction, total * (k / 10e0) AS target FROM (SELECT DISTINCT job_id, total FROM c), range(0, 11) t(k)),
    x AS (SELECT q.job_id, fraction, min(s + greatest(0e0, target - (upto - (e - s)))) FILTER (upto >= target - 1e-9) AS t FROM q
        JOIN c ON c.job_id = q.job_id GROUP BY q.job_id, fraction)
    SELECT job_id, fraction, round(t, 6) AS t FROM x""")
def active_time_lookup(spark, d):
    iv = activity.merged(read(spark, d, "spells"))
    fractions = iv.select("job_id").distinct().select(
        "job_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k")
    ).select("job_id", (F.col("k") / 10).alias("fraction"))
    return rounded(timeline.active_time(fractions, iv), "t")


@query(f"""WITH {EVEN}, sp AS (SELECT job_id, count(*) AS n, min(start) AS s0, max("end") AS s1 FROM ev
        GROUP BY job_id), iv AS (SELECT job_id, 2e0 AS a0, 40e0 AS a1 FROM (SELECT DISTINCT job_id FROM {{turns}}) WHERE cast(job_id AS int) % 3 > 0),
    x AS (SELECT ev.*, n, s0, s1, a1, n >= 2 AND a1 IS NOT NULL AND s1 - s0 >= 1 AND a1 - s0 >= 1 AS fits, s0 + (start - s0) * (greatest(0.1e0,
        a1 - s0) / greatest(0.1e0, s1 - s0)) AS a, s0 + ("end" - s0) * (greatest(0.1e0, a1 - s0) / greatest(0.1e0, s1 - s0)) AS b
          FROM ev JOIN sp ON sp.job_id = ev.job_id LEFT JOIN iv ON iv.job_id = ev.job_id)
    SELECT job_id, idx, round(CASE WHEN fits THEN greatest(0e0, least(a, duration)) ELSE start END, 6) AS start, round(CASE
        WHEN fits THEN least(greatest(greatest(0e0, least(a, duration)) + 0.2e0, b), duration) ELSE "end" END, 6) AS "end" FROM x""")
def activity_fit(spark, d):
    iv = read(spark, d, "turns").select("job_id").distinct().where("cast(job_id AS int) % 3 > 0").select(
        "job_id", F.lit(2.0).alias("start"), F.lit(40.0).alias("end")
    )
    return rounded(timeline.fit_to_activity(even(spark, d), iv), "start", "end").select("job_id", "idx", "start", "end")


@query(f"""WITH RECURSIVE {SPELLS} {MERGE}, {EVEN}, b AS (SELECT job_id, idx, text, duration, count(*) OVER (PARTITION BY job_id) AS n
        FROM {{turns}}), {SHARES}
    SELECT b.job_id, b.idx, round(CASE WHEN f.start IS NULL THEN ev.start ELSE greatest(0e0, f.start) END, 6) AS start, round(coalesce(f."end",
        ev."end"), 6) AS "end", b.text, 0e0 AS score
    FROM b LEFT JOIN f ON f.job_id = b.job_id AND f.idx = b.idx JOIN ev ON ev.job_id = b.job_id AND ev.idx = b.idx""")
def activity_placement(spark, d):
    iv = activity.merged(read(spark, d, "spells"))
    return rounded(timeline.place_by_activity(read(spark, d, "turns"), iv), "start", "end")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new
        FROM events),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, cast(min(ts) AS varchar) AS start, count(*) AS events FROM r GROUP BY user_id, run""")
def session_spells(spark, d):
    from strandline.streaming.spells import sessions

    return sessions(read(spark, d, "events")).select("user_id", F.col("start").cast("string").alias("start"), "events")


@query("""WITH s AS (SELECT cast(user_id AS varchar) AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value / 100e0 AS x
        FROM events),
    f AS (SELECT job_id, frame, x FROM (SELECT job_id, n, x, unnest(range(greatest(0, n // 10 - 1), n // 10 + 1)) AS frame FROM s)),
    l AS (SELECT job_id, max(n) * 0.01e0 AS until FROM s GROUP BY job_id)
    SELECT f.job_id, frame, round(sqrt(avg(x * x) + 1e-12), 6) AS rms FROM f JOIN l ON l.job_id = f.job_id
        WHERE frame = 0 OR frame * 0.1e0 + 0.2e0 <= until + 0.1e0 GROUP BY f.job_id, frame""")
def level_frames(spark, d):
    """Levels of the events' values as a hundred samples a second."""
    samples = read(spark, d, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        (F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1") * 0.01).alias("t"), (F.col("value") / 100).alias("x")
    )
    return rounded(activity.frame_levels(samples), "rms").select("job_id", "frame", "rms")
