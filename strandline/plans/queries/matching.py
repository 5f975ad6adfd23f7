"""Matching blocks with segments and stamped lines: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import activity, align
from strandline.plans.base import query, rounded
from strandline.plans.fragments import KEY, LINES
from strandline.plans.inputs import read
from strandline.sources import scans


@query(f"""WITH b AS (SELECT job_id, {LINES('text')} AS ls FROM {{texts}}), i AS (SELECT job_id, k - 1 AS idx, ls[k] AS text, len(ls) AS m
        FROM (SELECT job_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM b)),
    s AS (SELECT job_id, m, slot, CASE WHEN 3 < m THEN cast(round_even(slot * m / 3e0, 0) AS bigint) ELSE slot END AS lo, CASE
        WHEN 3 < m THEN cast(round_even((slot + 1) * m / 3e0, 0) AS bigint) ELSE slot + 1 END AS hi FROM (SELECT DISTINCT job_id, m
        FROM i), range(0, 3) t(slot) WHERE slot < m)
    SELECT s.job_id, cast(slot AS int) AS idx, round(min(i.idx) * 2e0, 6) AS start, round(max(i.idx) * 2e0 + 1, 6) AS "end", string_agg(text,
        ' ' ORDER BY i.idx) AS text FROM s JOIN i ON i.job_id = s.job_id AND i.idx >= lo AND i.idx < greatest(lo + 1, hi) GROUP BY s.job_id, slot""")
def compress_rows(spark, d):
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "")
    items = read(spark, d, "texts").select("job_id", F.posexplode(lines).alias("idx", "text")).select(
        "job_id", "idx", (F.col("idx") * 2.0).alias("start"), (F.col("idx") * 2.0 + 1).alias("end"), "text"
    )
    return rounded(align.compress(items, items.select("job_id").distinct().withColumn("n", F.lit(3))), "start", "end")


@query(f"""WITH l AS (SELECT job_id, {LINES('text')} AS ls FROM {{texts}}),
    i AS (SELECT job_id, k - 1 AS idx, greatest(1, length({KEY('ls[k]')}))::DOUBLE AS size, greatest(0.2e0, 0.5e0 + k * 7 % 5) AS time, len(ls) AS m
          FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM l)),
    j AS (SELECT job_id, greatest(1e0, median(size)) AS ms, greatest(0.2e0, median(time)) AS mt FROM i GROUP BY job_id),
    v AS (SELECT i.job_id, idx, p, size / p / ms + 0.2e0 * least(2e0, time / p / mt) AS value, m + 9 AS extra FROM i JOIN j ON j.job_id = i.job_id, range(1, 400) t(p) WHERE p <= m + 9),
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY value DESC, idx) AS k FROM v)
    SELECT job_id, cast(idx AS int) AS idx, cast(1 + count(*) FILTER (k <= extra) AS int) AS parts FROM r GROUP BY job_id, idx""")
def split_counts(spark, d):
    """Into how many parts the lines of each text are split to fill twice as many slots and nine."""
    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda x: x != "")
    items = read(spark, d, "texts").select("job_id", F.posexplode(lines).alias("idx", "text"))
    items = items.select("job_id", "idx", F.lit(0.0).alias("start"), (0.5 + (F.col("idx") + 1) * 7 % 5).alias("end"), "text")
    return align.expand_counts(items, items.groupBy("job_id").agg((2 * F.count("*") + 9).alias("n")))


@query()
def transcript_align(spark, d):
    turns = read(spark, d, "turns")
    segments = turns.where("role = 'assistant'").select("job_id", "idx", F.col("sync_text").alias("text"))
    segments = segments.withColumn("idx", F.expr("row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1")).select(
        "job_id", "idx", (F.col("idx") * 4.0 + 1).alias("start"), (F.col("idx") * 4.0 + 3.5).alias("end"), "text"
    )
    blocks = turns.where("role = 'user'").select(
        "job_id", F.expr("row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1").alias("idx"), "text", "sync_text", "duration"
    )
    return rounded(align.align_to_segments(blocks, segments), "start", "end", "score")


@query()
def lrc_group_align(spark, d):
    blocks = read(spark, d, "turns").select("job_id", "idx", "text", "sync_text", "duration")
    return rounded(align.align_to_lrc(blocks, scans.lrc_items(read(spark, d, "lyrics"))), "start", "end", "score", "average")


@query()
def adaptive_lines(spark, d):
    turns = read(spark, d, "turns")
    segments = turns.where("role = 'assistant'").select(
        "job_id", F.expr("row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1").alias("idx"), F.col("sync_text").alias("text")
    )
    return align.choose_lines(turns.where("role = 'user'").select("job_id", "idx", "text", "sync_text"), segments).select("job_id", "idx", "sync_text")


@query()
def reference_transcript(spark, d):
    """Captions on a transcript where it fits, else on active time."""
    turns = read(spark, d, "turns")
    segments = turns.where("cast(job_id AS int) % 2 = 0").select(
        "job_id", "idx", (F.col("idx") * 4.0 + 1).alias("start"), (F.col("idx") * 4.0 + 3.5).alias("end"), F.col("sync_text").alias("text")
    )
    blocks = turns.select("job_id", "idx", "text", "sync_text", "duration")
    return rounded(align.align_to_reference(blocks, segments, activity.merged(read(spark, d, "spells"))), "start", "end", "score")
