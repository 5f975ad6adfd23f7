"""Texts and keys: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import align
from strandline.plans.base import query, rounded
from strandline.plans.fragments import ALPHABET, KEY, LINES
from strandline.plans.inputs import read


@query(f"""WITH b AS (SELECT job_id, {LINES('text')} AS ls FROM {{texts}})
    SELECT job_id, coalesce(ls[1], '') AS line_1, coalesce(ls[least(2, len(ls))], '') AS line_2, coalesce(ls[len(ls)], '') AS last_line,
        array_to_string(ls, ' ') AS joined FROM b""")
def sync_text_choice(spark, d):
    t = F.col("text")
    return read(spark, d, "texts").select(
        "job_id", X.sync_line(t, "Line 1").alias("line_1"), X.sync_line(t, "Line 2").alias("line_2"),
        X.sync_line(t, "Last line").alias("last_line"), X.sync_line(t, "All lines").alias("joined")
    )


@query(f"SELECT job_id, {KEY('text')} AS key, trim(regexp_replace(lower(text), '[^{ALPHABET}]+', ' ', 'g')) AS spaced FROM {{texts}}")
def text_keys(spark, d):
    return read(spark, d, "texts").select("job_id", X.match_key(F.col("text")).alias("key"), X.spaced_key(F.col("text")).alias("spaced"))


@query(r"""WITH c AS (SELECT job_id, sum(len(regexp_extract_all(t, '[\x{ac00}-\x{d7a3}]'))) AS h, sum(len(regexp_extract_all(t,
        '[\x{3040}-\x{30ff}]'))) AS k, sum(len(regexp_extract_all(t, '[A-Za-z]'))) AS l
              FROM (SELECT job_id, text || CASE WHEN cast(job_id AS int) % 3 = 0 THEN repeat('가', length(text))
                  WHEN cast(job_id AS int) % 3 = 1 THEN repeat('か', 20) ELSE '' END AS t FROM {texts}) GROUP BY job_id)
    SELECT job_id, CASE WHEN h >= greatest(1, k, l) THEN 'ko' WHEN k >= greatest(1, h) THEN 'ja' WHEN l > 0 THEN 'en' END AS language FROM c""")
def lyric_language(spark, d):
    kind = F.col("job_id").cast("int") % 3
    rows = read(spark, d, "texts").select(
        "job_id",
        F.concat("text", F.when(kind == 0, F.expr("repeat('가', length(text))")).when(kind == 1, "か" * 20).otherwise("")).alias("t")
    )
    g = rows.groupBy("job_id").agg(*[F.sum(c).alias(n) for c, n in zip(X.script_counts(F.col("t")), "hkl", strict=True)])
    return g.select("job_id", X.language_of(F.col("h"), F.col("k"), F.col("l")).alias("language"))


@query()
def text_similarity(spark, d):
    turns = read(spark, d, "turns").select("job_id", "idx", "text")
    following = turns.select("job_id", (F.col("idx") - 1).alias("idx"), F.col("text").alias("next"))
    return rounded(
        turns.join(following, ["job_id", "idx"]).select("job_id", "idx", X.similarity(F.col("text"), F.col("next")).alias("similarity")),
        "similarity"
    )


@query()
def near_duplicate_trim(spark, d):
    jobs = read(spark, d, "turns").groupBy("job_id").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda r: r["text"]), "\n"
    ).alias("text"))
    twice = F.when(F.col("job_id").cast("int") % 2 == 0, F.concat("text", F.lit("\n"), "text")).otherwise(F.col("text"))
    return jobs.select("job_id", align.trim_copy(twice).alias("r")).select("job_id", "r.text", "r.removed")
