"""Readers: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans.base import query, rounded
from strandline.plans.fragments import LRC, NAMES, STRIP
from strandline.plans.inputs import read
from strandline.sources import scans


@query(f'WITH {LRC} SELECT job_id, idx, round(start, 6) AS start, round("end", 6) AS "end", text FROM items')
def lrc_scan(spark, d):
    return rounded(scans.lrc_items(read(spark, d, "lyrics")), "start", "end")


@query(f"WITH {LRC} SELECT ly.job_id, cast(count(items.idx) AS int) AS n FROM {{lyrics}} ly LEFT JOIN items ON items.job_id = ly.job_id GROUP BY ly.job_id")
def lrc_line_count(spark, d):
    return scans.lrc_count(read(spark, d, "lyrics"))


@query(f"""WITH b AS (SELECT job_id, list_filter(list_transform(string_split(replace(replace(regexp_replace(text, '\\[.*?\\]', '', 'gs'), chr(13) || chr(10),
        chr(10)), chr(13), chr(10)), chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '') AS ls FROM {{texts}})
    SELECT job_id, cast(i - 1 AS int) AS idx, ls[i] AS text, ls[i] AS sync_text FROM (SELECT job_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM b)""")
def block_scan_lines(spark, d):
    return scans.lyric_blocks(read(spark, d, "texts").select("job_id", "text"), scans.LINES)


@query(f"WITH {NAMES} SELECT job_id, artist, title FROM names")
def metadata_projection(spark, d):
    return read(spark, d, "payloads").select(
        "job_id", scans.metadata_fields(F.col("payload"), F.col("artist"), F.col("title")).alias("m")
    ).select("job_id", "m.*")


@query("""WITH w AS (SELECT job_id, idx, string_split(sync_text, ' ') AS ws FROM {turns}), p AS (SELECT job_id, idx, length(x) / 100e0 AS span,
        (length(x) % 10) / 10e0 AS prob FROM (SELECT job_id, idx, unnest(ws) AS x FROM w))
    SELECT job_id, idx, round(avg(CASE WHEN round(span, 6) < 0.04e0 THEN 1e0 ELSE 0e0 END), 6) AS collapsed_ratio, round(avg(prob), 6) AS confidence
        FROM p GROUP BY job_id, idx""")
def word_stats(spark, d):
    words = F.transform(
        F.split("sync_text", " "),
        lambda x: F.struct(F.lit(0.0).alias("start"), (F.length(x) / 100).alias("end"), (F.length(x) % 10 / 10).alias("probability"))
    )
    return rounded(scans.word_stats(read(spark, d, "turns").select("job_id", "idx", words.alias("words"))), "collapsed_ratio", "confidence").drop("words")


@query("""WITH j AS (SELECT cast(o_orderkey AS varchar) AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'a.wav' ELSE ' ' END AS file, CASE
        WHEN o_orderkey % 2 = 0 THEN 'http://x' END AS url, cast(o_custkey % 100 + 150 AS double) AS ud, 200e0 AS d,
              CASE WHEN o_orderkey % 5 = 0 THEN 'id' END AS found FROM orders),
    k AS (SELECT *, CASE WHEN trim(file) <> '' THEN 'file' WHEN url IS NOT NULL AND abs(ud - d) / greatest(1e0, d) <= 0.15e0 THEN 'link'
        WHEN found IS NOT NULL THEN 'search' END AS kind FROM j)
    SELECT job_id, kind, CASE kind WHEN 'file' THEN file WHEN 'link' THEN url ELSE found END AS source, CASE WHEN kind IS NULL THEN CASE
        WHEN url IS NOT NULL THEN 'the link''s length doesn''t fit' ELSE 'no reference' END END AS error FROM k""")
def reference_choice(spark, d):
    from strandline.operators.reference import choose_source

    o = read(spark, d, "orders")
    key = F.col("o_orderkey")
    jobs = o.select(
        key.cast("string").alias("job_id"), F.when(key % 3 == 0, "a.wav").otherwise(" ").alias("file"),
        F.when(key % 2 == 0, "http://x").alias("url"), (F.col("o_custkey") % 100 + 150).cast("double").alias("url_duration"),
        F.lit(200.0).alias("duration")
    )
    return choose_source(jobs, o.where("o_orderkey % 5 = 0").select(key.cast("string").alias("job_id"), F.lit("id").alias("id")))


@query(
    """SELECT job_id, cast(row_number() OVER (PARTITION BY job_id ORDER BY idx) - 1 AS int) AS idx, text FROM (SELECT job_id, idx, trim(CASE WHEN idx % 3 = 1 THEN '  ' ELSE ' ' || role || ' ' END) AS text FROM {turns}) WHERE text <> ''"""
)
def clean_segments(spark, d):
    from strandline.operators.reference import clean_segments

    return clean_segments(read(spark, d, "turns").select(
        "job_id", "idx", F.when(F.col("idx") % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), "role", F.lit(" "))).alias("text")
    ))


@query(f"""WITH t AS (SELECT job_id, string_split(text, '. ') AS ps FROM {{texts}}),
    p AS (SELECT job_id, cast(i - 1 AS int) AS idx, list_filter(list_transform(string_split(ps[i], chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '') AS ls FROM (SELECT job_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM t)),
    k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY idx) AS rn FROM p WHERE len(ls) > 0)
    SELECT job_id, cast(rn - 1 AS int) AS idx, array_to_string(ls, chr(10)) AS text, ls[1] AS sync_text FROM k""")
def block_scan_blank(spark, d):
    """Blocks parted by blank lines: the texts' sentences, with a blank line after each."""
    parts = read(spark, d, "texts").select(
        "job_id",
        F.array_join(
            F.transform(F.split("text", r"\. "), lambda x: F.regexp_replace(F.regexp_replace(x, r"\n(\s*\n)+", "\n"), r"\[", "")), "\n\n"
        ).alias("text")
    )
    return scans.lyric_blocks(parts)


_ANCHORS = """a AS (SELECT job_id, idx, CASE WHEN cast(job_id AS int) % 4 = 3 AND idx = 2 THEN 'x'
        ELSE cast(idx + 1 AS varchar) || ' = ' || cast(idx // 6 AS varchar) || ':' || lpad(cast(idx * 10 % 60 AS varchar), 2, '0') || '.5' END AS line
        FROM {turns} WHERE idx % 2 = 0),
    n AS (SELECT job_id, count(*) AS n FROM {turns} GROUP BY job_id)"""


@query(f"""WITH {_ANCHORS} SELECT job_id, idx, CASE WHEN line <> 'x' THEN (idx * 10 % 60) + 60e0 * (idx // 6) + 0.5e0 END AS t, CASE
        WHEN line = 'x' THEN 'not an anchor' WHEN idx * 10 + 0.5e0 > 60 THEN 'time out of range' END AS reason FROM a
    UNION ALL SELECT cast(1000 + k AS varchar), NULL, NULL, 'no anchors' FROM range(0, 3) t(k)""")
def anchor_scan(spark, d):
    """Anchors of jobs, a bad line in some; and three jobs without any."""
    turns = read(spark, d, "turns")
    seconds = F.concat(F.floor(F.col("idx") / 6).cast("string"), F.lit(":"), F.lpad((F.col("idx") * 10 % 60).cast("string"), 2, "0"), F.lit(".5"))
    line = F.when(
        (F.col("job_id").cast("int") % 4 == 3) & (F.col("idx") == 2), "x"
    ).otherwise(F.concat((F.col("idx") + 1).cast("string"), F.lit(" = "), seconds))
    jobs = turns.groupBy("job_id").agg(
        F.count("*").alias("n"), F.lit(60.0).alias("duration"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.when(F.col("idx") % 2 == 0, F.struct("idx", line.alias("line"))))), lambda r: r["line"]),
            "\n"
        ).alias("anchors")
    )
    none = spark.range(3).select(
        (F.col("id") + 1000).cast("string").alias("job_id"), F.lit(5).alias("n"), F.lit(60.0).alias("duration"),
        F.lit("# none").alias("anchors")
    )
    good, wrong = scans.timing_anchors(jobs.unionByName(none))
    bad = wrong.select(
        "job_id", F.when(F.col("line") == "x", 2).otherwise(F.regexp_extract("line", r"^(\d+)", 1).try_cast("int") - 1).alias("idx"),
        F.when(F.col("line") != "x", scans.time_value(F.regexp_extract("line", r"= (.*)", 1))).alias("t"), "reason"
    )
    return good.select("job_id", "idx", "t", F.lit(None).cast("string").alias("reason")).unionByName(bad)


@query(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '/x/' || o_orderkey WHEN o_orderkey % 4 = 1 THEN '/p/' || o_orderkey WHEN o_orderkey % 4 = 2 THEN 'n' || o_orderkey END AS path FROM orders"""
)
def uploaded_paths(spark, d):
    key = F.col("o_orderkey")
    text = F.when(key % 4 == 0, F.concat(F.lit("/x/"), key)).when(
        key % 4 == 1, F.concat(F.lit('{"path": "/p/'), key, F.lit('", "name": "other"}'))
    ).when(key % 4 == 2, F.concat(F.lit('{"path": "", "name": "n'), key, F.lit('"}'))).otherwise("{}")
    return read(spark, d, "orders").select(key.alias("k"), scans.uploaded_path(text).alias("path"))
