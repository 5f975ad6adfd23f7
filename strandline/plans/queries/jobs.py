"""Whole jobs: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import activity
from strandline.plans.base import query, rounded
from strandline.plans.fragments import LINES, LRC, MERGE, SHARES, SPELLS, even
from strandline.plans.inputs import read, select
from strandline.plans.queries.timings import finer
from strandline.sources import scans


_SONG_LINES = f"""sg AS (SELECT *, cast(job_id AS int) % 7 AS k, {LINES('text')} AS ls FROM {{songs}}),
    b AS (SELECT job_id, k, mode, duration, len(ls) AS n, cast(i - 1 AS int) AS idx, ls[i] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i
        FROM sg WHERE k IN (0, 1, 3)))"""


@query(f"""WITH RECURSIVE {SPELLS} {MERGE}, {_SONG_LINES}, {LRC.replace('{lyrics}', "(SELECT * FROM {songs} WHERE mode = 'Even spacing')")}, {SHARES},
    ev AS (SELECT *, 0.5e0 + idx * (59e0 / n) AS start, least(59.5e0, greatest(0.5e0 + idx * (59e0 / n) + 0.2e0,
        0.5e0 + (idx + 1) * (59e0 / n) - 0.05e0)) AS "end" FROM b),
    an AS (SELECT *, CASE WHEN idx <= 2 THEN 2e0 + 18.5e0 * (idx / 2e0) ELSE least(60e0, 20.5e0 + (idx - 2) * greatest(0.5e0, 39e0 / greatest(1,
        n - 3))) END AS raw FROM b WHERE k = 1 AND n >= 3),
    al AS (SELECT *, lead(raw) OVER (PARTITION BY job_id ORDER BY idx) AS next FROM an),
    m AS (SELECT job_id, idx, text, 0e0 AS score, mode, 'even' AS method, start, "end" FROM ev WHERE k = 0
          UNION ALL SELECT job_id, idx, text, 1e0, mode, 'anchors', raw, least(60e0, CASE WHEN next IS NULL THEN raw + 3e0
              ELSE greatest(raw + 0.2e0, next - 0.05e0) END) FROM al
          UNION ALL SELECT b.job_id, b.idx, b.text, 0e0, b.mode, 'activity', CASE WHEN f.start IS NULL THEN ev.start
              ELSE greatest(0e0, f.start) END, coalesce(f."end", ev."end")
                    FROM b LEFT JOIN f ON f.job_id = b.job_id AND f.idx = b.idx JOIN ev ON ev.job_id = b.job_id AND ev.idx = b.idx WHERE b.k = 3),
    o AS (SELECT * REPLACE (greatest(0e0, least(start + 0.5e0, 60e0)) AS start, least(greatest(greatest(0e0, least(start + 0.5e0, 60e0)) + 0.2e0,
        "end" + 0.5e0), 60e0) AS "end") FROM m
          UNION ALL SELECT items.job_id, items.idx, items.text, 1e0, 'Even spacing', 'stamped text', items.start, items."end" FROM items
              JOIN sg ON sg.job_id = items.job_id AND sg.k = 4)
    SELECT job_id, idx, round(start, 6) AS start, round("end", 6) AS "end", text, score, '' AS sync_text, mode, method, NULL AS error FROM o
    UNION ALL SELECT job_id, NULL, NULL, NULL, NULL, NULL, NULL, mode, NULL, CASE k WHEN 1 THEN 'index out of range: 3: 0:20.5'
        WHEN 2 THEN 'not an anchor: 1 = 1.5:20' WHEN 5 THEN 'unknown mode' ELSE 'no lyrics' END
    FROM sg WHERE k IN (2, 5, 6) OR (k = 1 AND len(ls) < 3)""")
def mode_dispatch(spark, d):
    """Captions or an error of every job: even, anchored, stamped and active ones, bad anchors, an unknown mode, no lyrics."""
    from strandline.plans.pipeline import run_jobs

    captions = run_jobs(read(spark, d, "songs"), intervals=activity.merged(read(spark, d, "spells")))
    return rounded(captions.withColumn("sync_text", F.coalesce("sync_text", F.when(F.col("idx").isNotNull(), ""))), "start", "end")


@query()
def mode_dispatch_aligned(spark, d):
    """Jobs of the modes that match texts: fetched stamped lyrics, a transcript, and a reference with its time map."""
    from strandline.plans.pipeline import run_jobs

    k = F.col("job_id").cast("int") % 3
    jobs = read(spark, d, "songs").select(
        "job_id", "duration", "grouping",
        F.when(k == 0, "LRCLIB synced lyrics").when(k == 1, "Whisper fuzzy match").otherwise("Reference audio DTW").alias("mode")
    )
    turns = read(spark, d, "turns")
    texts = turns.groupBy("job_id").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", F.replace("sync_text", F.lit("\n"), F.lit(" ")).alias("line")))), lambda r: r["line"]),
        "\n"
    ).alias("text"))
    jobs = jobs.join(texts, "job_id").withColumn("use_lyrics", F.lit(False))
    segments = turns.select("job_id", "idx", (F.col("idx") * 4.0 + 1).alias("start"), (F.col("idx") * 4.0 + 3.5).alias("end"), F.col("sync_text").alias("text"))
    axis = jobs.select("job_id", F.explode(F.array(F.lit(0.0), F.lit(60.0))).alias("ref_t")).withColumn("perf_t", F.col("ref_t") * 0.9 + 1.5)
    return rounded(run_jobs(jobs, scans.lrc_items(read(spark, d, "lyrics")), segments, axis=axis), "start", "end", "score")


def _sung(spark, d):
    """Jobs of the mapped mode whose lines are stamped lyrics: (jobs, stamped lines, axis)."""
    lines = read(spark, d, "ballads")
    stamp = F.format_string("[%02d:%02d.%d] %s", F.floor(F.col("t") / 60), F.floor(F.col("t")) % 60, F.col("idx") % 2 * 5, F.col("line"))
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", c.alias("x")))), lambda r: r["x"]), "\n")
    songs = lines.groupBy("job_id").agg(whole(F.col("line")).alias("text"), whole(stamp).alias("stamped"), F.first("duration").alias("duration"))
    jobs = songs.select(
        "job_id", "text", "duration", F.lit("Reference audio DTW").alias("mode"), F.lit("Every non-empty line").alias("grouping"),
        F.lit(0.5).alias("offset"), F.lit(False).alias("use_lyrics")
    )
    axis = songs.select("job_id", F.explode(F.array(F.lit(0.0), F.lit(200.0))).alias("ref_t")).withColumn("perf_t", F.col("ref_t") * 0.9 + 1.5)
    return jobs, scans.lrc_items(songs.select("job_id", "duration", F.col("stamped").alias("text"))), axis


def _aligned(windows):
    """A forced result for most windows: a segment of two words a line, some tenths of a second off; of every seventh window one segment less."""
    key = F.col("job_id").cast("int") * 31 + F.col("low") * 7 + F.col("high")
    lines = F.sequence(F.lit(0), F.col("high") - F.col("low") - F.when(key % 7 == 0, 2).otherwise(1))
    own = (F.col("low") * F.col("low") + 3 * F.col("high") * F.col("high")) % 89 / 1000  # so that no two pairs of windows are equally far apart
    at = lambda k: 1.5 + k * 3.15 + ((key + k * 3) % 11 - 5) / 8 + own
    word = lambda k, j: F.struct(
        (at(k) + j).alias("start"), (at(k) + j + F.when(key % 3 == j, 0.01).otherwise(0.5)).alias("end"),
        F.when(key % 5 > 0, (k + j + 1) / 20).alias("probability")
    )
    segments = F.transform(lines, lambda k: F.struct(at(k).alias("start"), (at(k) + 2.5).alias("end"), F.array(word(k, 0), word(k, 1)).alias("words")))
    return windows.where(key % 11 > 0).select("job_id", "low", "high", F.to_json(F.struct(segments.alias("segments"))).alias("result"))


_SUNG = """cp AS (SELECT job_id, idx, 0.9e0 * t + 1.5e0 AS start, 0.9e0 * (t + CASE WHEN lead(t) OVER (PARTITION BY job_id ORDER BY idx) IS NULL THEN 3.5e0 ELSE 3.45e0 END) + 1.5e0 AS stop,
               line, duration, count(*) OVER (PARTITION BY job_id) AS n, lead(0.9e0 * t + 1.5e0) OVER (PARTITION BY job_id ORDER BY idx) AS next FROM {ballads}),
    mp AS (SELECT job_id, idx, start, least(stop, coalesce(next - 0.04e0, stop)) AS "end", duration FROM cp),
    j AS (SELECT DISTINCT job_id, cast(n AS int) AS n FROM cp),
    wi AS (SELECT job_id, cast(low AS int) AS low, cast(least(n, low + size) AS int) AS high FROM (SELECT job_id, n, s.size, k * s.stride AS low
        FROM j, (VALUES (6, 6), (8, 4)) s(size, stride), range(0, 20) t(k) WHERE k * s.stride < n) WHERE least(n, low + size) - low >= 3
           UNION SELECT job_id, cast(greatest(0, n - size) AS int), n FROM j, (VALUES (6), (8)) s(size) WHERE n >= 3),
    wk AS (SELECT wi.*, cast(job_id AS int) * 31 + low * 7 + high AS key, cast(low + 1 AS varchar) || '-' || cast(high AS varchar) AS source FROM wi),
    sg AS (SELECT wk.*, k, greatest(0e0, mp.start - 1.5e0) + 1.5e0 + k * 3.15e0 + ((key + k * 3) % 11 - 5) / 8e0 + (low * low + 3 * high * high) % 89 / 1000e0 AS at_ FROM wk JOIN mp ON mp.job_id = wk.job_id
        AND mp.idx = low, range(0, 8) t(k) WHERE k < high - low AND key % 11 > 0 AND key % 7 > 0),
    cd AS (SELECT job_id, cast(low + k AS int) AS idx, cast(row_number() OVER (PARTITION BY job_id, low + k ORDER BY low, high) - 1 AS int) AS cand_idx, at_ AS start, at_ + 2.5e0 AS "end",
           CASE WHEN key % 5 > 0 THEN ((k + 1) / 20e0 + (k + 2) / 20e0) / 2 ELSE 0e0 END AS confidence, CASE WHEN key % 3 < 2 THEN 0.5e0 ELSE 0e0 END AS collapsed_ratio, source FROM sg)"""


@query(f"""WITH RECURSIVE {_SUNG}, r AS (SELECT * FROM {finer('refined_captions').replace(select('candidates'), 'cd').replace(select('captions'), 'mp')}),
    o AS (SELECT job_id, idx, greatest(0e0, least(start + 0.5e0, duration)) AS s, "end" + 0.5e0 AS e, duration FROM r)
    SELECT o.job_id, o.idx, round(s, 6) AS start, round(least(greatest(s + 0.2e0, e), o.duration), 6) AS "end", line AS text, 'stamped lyrics' AS method, NULL AS source, NULL AS error
    FROM o JOIN cp ON cp.job_id = o.job_id AND cp.idx = o.idx
    UNION ALL SELECT job_id, NULL, NULL, NULL, NULL, NULL, source, CASE WHEN key % 11 = 0 THEN '0' ELSE cast(high - low - 1 AS varchar) END || ' segments in place of ' || cast(high - low AS varchar)
    FROM wk WHERE key % 11 = 0 OR key % 7 = 0
    UNION ALL SELECT job_id, NULL, NULL, NULL, NULL, NULL, NULL, 'not refined: other captions than blocks, or fewer than three' FROM j WHERE n < 3""")
def refined_jobs(spark, d):
    """From songs to refined captions: the first phase writes the windows, a stand-in for the aligner times them, the second phase resumes
    from the written tables. A row a caption, and a row a window that gave nothing or a job that can't be refined."""
    from strandline.plans.pipeline import alignment_windows, finish_jobs, refinement_notes, start_jobs

    jobs, lyrics, axis = _sung(spark, d)
    path = start_jobs(jobs, lyrics, axis=axis)
    results = _aligned(alignment_windows(spark, path))
    captions = finish_jobs(spark, path, results).select("job_id", "idx", "start", "end", "text", "method", F.lit(None).cast("string").alias("source"), "error")
    notes = refinement_notes(spark, path, results).where("idx IS NULL").select("job_id", "source", "error")
    return rounded(captions.unionByName(notes, allowMissingColumns=True), "start", "end")
