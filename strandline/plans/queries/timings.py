"""Competing timings: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import consensus, timeline
from strandline.plans.base import ORACLE, query, rounded
from strandline.plans.inputs import read
from strandline.sources import scans
from strandline.sources.staging import written


@query("""WITH j AS (SELECT job_id, cast(count(*) AS int) AS n FROM {turns} GROUP BY job_id),
    w AS (SELECT job_id, n, s.size, k * s.stride AS low FROM j, (VALUES (6, 6), (8, 4)) s(size, stride), range(0, 200) t(k) WHERE k * s.stride < n)
    SELECT job_id, cast(low AS int) AS low, cast(least(n, low + size) AS int) AS high FROM w WHERE least(n, low + size) - low >= 3
    UNION SELECT job_id, greatest(0, n - size), n FROM j, (VALUES (6), (8)) s(size) WHERE n >= 3""")
def forced_chunks(spark, d):
    return timeline.chunk_windows(read(spark, d, "turns").groupBy("job_id").agg(F.count("*").cast("int").alias("n")))


_VALID = """va AS MATERIALIZED (SELECT cand.*, c.start AS cs, c."end" AS ce FROM {candidates} cand JOIN {captions} c ON c.job_id = cand.job_id AND c.idx = cand.idx),"""


_PAIR = lambda where, cost: f"""pr AS (SELECT l.job_id, l.idx, l.cs, l.ce, l.start AS s1, r.start AS s2, l."end" AS e1, r."end" AS e2, l.confidence AS c1, r.confidence AS c2, l.collapsed_ratio AS k1, r.collapsed_ratio AS k2,
            row_number() OVER (PARTITION BY l.job_id, l.idx ORDER BY {cost}, l.cand_idx, r.cand_idx) AS rn FROM ok l JOIN ok r ON r.line = l.line
                AND r.cand_idx > l.cand_idx AND r.source <> l.source {where}),
    best AS (SELECT * FROM pr WHERE rn = 1)"""  # noqa: E731


@query(f"""WITH {_VALID} ok AS MATERIALIZED (SELECT *, concat(job_id, ':', idx) AS line FROM va WHERE abs(start - cs) <= 3 AND "end" > start + 0.08e0),
        {_PAIR('', 'abs(l.start - r.start) + 0.15e0 * abs(l."end" - r."end")')},
    b AS (SELECT *, (s1 + s2) / 2 AS at_, (e1 + e2) / 2 AS e FROM best WHERE abs(s1 - s2) <= 0.6e0 AND NOT (least(k1, k2) >= 0.75e0
        AND greatest(c1, c2) < 0.04e0)),
    su AS (SELECT b.job_id, b.idx, count(DISTINCT source) AS n FROM b JOIN ok ON ok.job_id = b.job_id AND ok.idx = b.idx
        WHERE abs(start - at_) <= 0.45e0 AND confidence >= 0.08e0 AND collapsed_ratio < 0.7e0 GROUP BY b.job_id, b.idx)
    SELECT b.job_id, b.idx, round(at_, 6) AS start, round(CASE WHEN abs(e1 - e2) <= 1 AND least(e1, e2) > at_ + 0.35e0 AND abs(e - ce) <= 3 THEN e
        ELSE ce END, 6) AS "end" FROM b LEFT JOIN su ON su.job_id = b.job_id AND su.idx = b.idx
    WHERE abs(at_ - cs) <= CASE WHEN coalesce(n, 0) >= 3 OR (abs(s1 - s2) <= 0.15e0 AND least(c1, c2) >= 0.25e0
        AND greatest(k1, k2) < 0.5e0) THEN 2.8e0 ELSE 1e0 END""")
def consensus_pair(spark, d):
    return rounded(consensus.consensus(read(spark, d, "captions"), read(spark, d, "candidates")), "start", "end")


@query("""WITH c AS (SELECT *, start - lag("end") OVER (PARTITION BY job_id ORDER BY idx) >= 4 AS gb,
        lead(start) OVER (PARTITION BY job_id ORDER BY idx) - "end" >= 4 AS ga FROM {captions}),
    v AS (SELECT c.job_id, c.idx, c.start AS cs, coalesce(gb, false) AS gb, coalesce(ga, false) AS ga, k.start, k."end" AS e,
        try_cast(split_part(source, '-', 1) AS int) = c.idx + 1 AND regexp_matches(source, '^[0-9]+-[0-9]+$') AS here
          FROM c JOIN {candidates} k ON k.job_id = c.job_id AND k.idx = c.idx WHERE (gb OR ga) AND confidence >= 0.015e0 AND collapsed_ratio < 0.7e0
              AND k."end" > k.start + 0.35e0),
    g AS (SELECT job_id, idx, cs, gb, ga, count(*) AS n, max(start) - min(start) AS sp, median(start) AS s, median(e) AS e,
        count(*) FILTER (here) AS n1, max(start) FILTER (here) - min(start) FILTER (here) AS sp1, median(start) FILTER (here) AS s1,
        median(e) FILTER (here) AS e1 FROM v GROUP BY ALL),
    h AS (SELECT *, coalesce(gb AND n1 >= 2 AND sp1 <= 0.35e0 AND abs(s1 - cs) <= 3, false) AS f1, coalesce(ga AND n >= 3 AND sp <= 2
        AND abs(s - cs) <= 2.5e0, false) AS f2 FROM g)
    SELECT job_id, idx, round(CASE WHEN f1 THEN s1 ELSE s END, 6) AS start, round(CASE WHEN f1 THEN e1 ELSE e END, 6) AS "end" FROM h WHERE f1 OR f2""")
def boundary_timing(spark, d):
    return rounded(consensus.boundary(read(spark, d, "captions"), read(spark, d, "candidates")), "start", "end")


@query(f"""WITH {_VALID} ok AS MATERIALIZED (SELECT *, concat(job_id, ':', idx) AS line FROM va WHERE regexp_matches(source, '^[0-9]+-[0-9]+$') AND try_cast(split_part(source, '-', 1) AS int) < idx + 1
        AND confidence >= 0.07e0 AND collapsed_ratio < 0.7e0 AND "end" > start + 0.35e0),
    {_PAIR('AND abs(l.start - r.start) <= 0.6e0', 'abs(l.start - r.start)')}
    SELECT job_id, idx, round((s1 + s2) / 2, 6) AS start, round((e1 + e2) / 2, 6) AS "end" FROM best WHERE abs((s1 + s2) / 2 - cs) > 1
        AND abs((s1 + s2) / 2 - cs) <= 2.5e0""")
def contextual_pair(spark, d):
    return rounded(consensus.contextual(read(spark, d, "captions"), read(spark, d, "candidates")), "start", "end")


@query(f"""WITH {_VALID} ok AS MATERIALIZED (SELECT *, concat(job_id, ':', idx) AS line FROM va WHERE idx = 0),
        {_PAIR('AND abs(l.start - r.start) <= 0.35e0 AND least(l.confidence, r.confidence) >= 0.15e0 AND greatest(l.collapsed_ratio, r.collapsed_ratio) < 0.6e0', 'abs(l.start - r.start)')},
    nx AS (SELECT job_id, idx, lead(start) OVER (PARTITION BY job_id ORDER BY idx) AS next FROM {{captions}})
    SELECT best.job_id, best.idx, round((s1 + s2) / 2, 6) AS start FROM best JOIN nx ON nx.job_id = best.job_id AND nx.idx = best.idx
        WHERE cs <= 1.5e0 AND (s1 + s2) / 2 > cs + 0.35e0 AND (s1 + s2) / 2 <= cs + 4 AND (s1 + s2) / 2 < next - 0.35e0""")
def first_line_anchor(spark, d):
    return rounded(consensus.first_line(read(spark, d, "captions"), read(spark, d, "candidates")), "start")


def finer(name: str) -> str:
    """A query's SQL with its times in brackets, rounded where that doesn't matter to what is made of them."""
    return "(" + ORACLE[name].replace(", 6)", ", 12)") + ")"


@query(f"""WITH RECURSIVE c AS (SELECT *, cast(row_number() OVER (PARTITION BY job_id ORDER BY idx) AS int) AS k, count(*) OVER (PARTITION BY job_id) AS n
        FROM {{captions}}),
    p AS (SELECT c.*, coalesce(a.start, b.start, x.start, f.start) AS ps, coalesce(a."end", b."end", x."end", CASE
        WHEN f.start IS NOT NULL THEN c."end" END) AS pe
          FROM c LEFT JOIN {finer('consensus_pair')} a ON a.job_id = c.job_id AND a.idx = c.idx LEFT
              JOIN {finer('boundary_timing')} b ON b.job_id = c.job_id AND b.idx = c.idx
          LEFT JOIN {finer('contextual_pair')} x ON x.job_id = c.job_id AND x.idx = c.idx LEFT
              JOIN {finer('first_line_anchor')} f ON f.job_id = c.job_id AND f.idx = c.idx),
    w AS (SELECT *, coalesce(ps, start) AS wish FROM p),
    r AS (SELECT job_id, k, wish AS at_ FROM w WHERE k = 1
          UNION ALL SELECT w.job_id, w.k, greatest(CASE WHEN w.wish <= r.at_ + 0.12e0 THEN w.start ELSE w.wish END, r.at_ + 0.12e0) FROM r
              JOIN w ON w.job_id = r.job_id AND w.k = r.k + 1),
    s AS (SELECT w.*, least(w.duration, greatest(0e0, at_)) AS s, coalesce(lead(at_) OVER (PARTITION BY w.job_id ORDER BY w.k), w.duration) AS next
        FROM w JOIN r ON r.job_id = w.job_id AND r.k = w.k),
    e AS (SELECT *, least(duration, coalesce(pe, "end"), next - 0.05e0) AS e FROM s)
    SELECT job_id, idx, round(CASE WHEN n >= 3 THEN s ELSE start END, 6) AS start,
           round(CASE WHEN n < 3 THEN "end" WHEN e <= s + 0.2e0 THEN least(duration, greatest(s + 0.2e0, next - 0.05e0))
               ELSE e END, 6) AS "end", duration, n >= 3 AND ps IS NOT NULL AS accepted FROM e""")
def refined_captions(spark, d):
    return rounded(consensus.refine(read(spark, d, "captions").drop("o_orderkey"), read(spark, d, "candidates")), "start", "end")


def _forced(spark, d):
    """Windows of the captions' jobs and, of most of them, a forced result: a segment of two words a line; of every seventh window one segment less."""
    captions = read(spark, d, "captions").select("job_id", "idx", "start", "end", "duration")
    windows = written(timeline.chunk_windows(captions.groupBy("job_id").agg(F.count("*").cast("int").alias("n"))), "windows")
    key = F.col("job_id") * 31 + F.col("low") * 7 + F.col("high")
    lines = F.sequence(F.lit(0), F.col("high") - F.col("low") - F.when(key % 7 == 0, 2).otherwise(1))
    word = lambda k, j: F.struct(
        (k * 6.0 + j).alias("start"), (k * 6.0 + j + F.when(key % 3 == j, 0.01).otherwise(0.5)).alias("end"),
        F.when(key % 5 > 0, (k + j + 1) / 20).alias("probability")
    )
    segments = F.transform(
        lines,
        lambda k: F.struct((k * 6.0 + 1.5).alias("start"), (k * 6.0 + 4.0).alias("end"), F.array(word(k, 0), word(k, 1)).alias("words"))
    )
    return windows, captions, windows.where(key % 11 > 0).select("job_id", "low", "high", F.to_json(F.struct(segments.alias("segments"))).alias("result"))


_FORCED = """cp AS (SELECT * FROM {captions}), j AS (SELECT job_id, cast(count(*) AS int) AS n FROM cp GROUP BY job_id),
    wi AS (SELECT job_id, cast(low AS int) AS low, cast(least(n, low + size) AS int) AS high FROM (SELECT job_id, n, s.size, k * s.stride AS low
        FROM j, (VALUES (6, 6), (8, 4)) s(size, stride), range(0, 20) t(k) WHERE k * s.stride < n) WHERE least(n, low + size) - low >= 3
           UNION SELECT job_id, cast(greatest(0, n - size) AS int), n FROM j, (VALUES (6), (8)) s(size) WHERE n >= 3),
    wk AS (SELECT wi.*, job_id * 31 + low * 7 + high AS key, cast(low + 1 AS varchar) || '-' || cast(high AS varchar) AS source FROM wi)"""


@query(f"""WITH {_FORCED}, s AS (SELECT wk.*, k, greatest(0e0, cp.start - 1.5e0) AS at_ FROM wk JOIN cp ON cp.job_id = wk.job_id
        AND cp.idx = low, range(0, 8) t(k) WHERE k < high - low AND key % 11 > 0 AND key % 7 > 0)
    SELECT job_id, cast(low + k AS int) AS idx, cast(row_number() OVER (PARTITION BY job_id, low + k ORDER BY low, high) - 1 AS int) AS cand_idx,
        round(at_ + k * 6e0 + 1.5e0, 6) AS start, round(at_ + k * 6e0 + 4e0, 6) AS "end",
           round(CASE WHEN key % 5 > 0 THEN ((k + 1) / 20e0 + (k + 2) / 20e0) / 2 ELSE 0e0 END, 6) AS confidence, CASE WHEN key % 3 < 2 THEN 0.5e0
               ELSE 0e0 END AS collapsed_ratio, source FROM s""")
def forced_candidates(spark, d):
    return rounded(scans.forced_candidates(*_forced(spark, d))[0], "start", "end", "confidence")


@query(
    f"""WITH {_FORCED} SELECT job_id, source, CASE WHEN key % 11 = 0 THEN '0' ELSE cast(high - low - 1 AS varchar) END || ' segments in place of ' || cast(high - low AS varchar) AS error FROM wk WHERE key % 11 = 0 OR key % 7 = 0"""
)
def forced_errors(spark, d):
    return scans.forced_candidates(*_forced(spark, d))[1]


@query()
def refinement_rows(spark, d):
    """What refining by forced results did, a row a line with its candidates and a row a failed window."""
    windows, captions, results = _forced(spark, d)
    found, errors = scans.forced_candidates(windows, captions, results)
    found = written(found, "forced")
    return consensus.refinement_rows(captions, consensus.refine(captions, found), found, errors)
