"""Subtitle files and JSON: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans.base import query
from strandline.plans.fragments import EVEN, even
from strandline.plans.inputs import read
from strandline.sources import subtitles


_SRT = lambda c: f"(lpad(cast(n_{c} // 3600000 AS varchar), 2, '0') || ':' || lpad(cast(n_{c} // 60000 % 60 AS varchar), 2, '0') || ':' || lpad(cast(n_{c} // 1000 % 60 AS varchar), 2, '0') || ',' || lpad(cast(n_{c} % 1000 AS varchar), 3, '0'))"


_ASS = lambda c: f"(cast(c_{c} // 360000 AS varchar) || ':' || lpad(cast(c_{c} // 6000 % 60 AS varchar), 2, '0') || ':' || lpad(cast(c_{c} // 100 % 60 AS varchar), 2, '0') || '.' || lpad(cast(c_{c} % 100 AS varchar), 2, '0'))"


_STAMPS = f"""{EVEN}, z AS (SELECT *, cast(round_even(start * 1000, 0) AS bigint) AS n_s, cast(round_even("end" * 1000, 0) AS bigint) AS n_e, cast(round_even(start * 100, 0) AS bigint) AS c_s, cast(round_even("end" * 100, 0) AS bigint) AS c_e FROM ev)"""


@query(
    f"""WITH {_STAMPS} SELECT job_id, string_agg(cast(idx + 1 AS varchar) || chr(10) || {_SRT('s')} || ' --> ' || {_SRT('e')} || chr(10) || text || chr(10), chr(10) ORDER BY idx) AS content FROM z GROUP BY job_id"""
)
def srt_export(spark, d):
    return subtitles.srt(even(spark, d))


# Fixed values of the format, as one literal.
_HEADER = """'[Script Info]\nTitle: song\nScriptType: v4.00+\nWrapStyle: 0\nScaledBorderAndShadow: yes\nPlayResX: 1920\nPlayResY: 1080\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Default,Malgun Gothic,48,&H00FFFFFF,&H000000FF,&H00000000,&H88000000,0,0,0,0,100,100,0,0,1,2.5,1.0,2,90,90,70,1\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n'"""


@query(
    f"""WITH {_STAMPS} SELECT job_id, chr(65279) || {_HEADER} || string_agg('Dialogue: 0,' || {_ASS('s')} || ',' || {_ASS('e')} || ',Default,,0,0,0,,' || replace(replace(replace(replace(text, '\\', '\\\\'), '{{', '\\{{'), '}}', '\\}}'), chr(10), '\\N'), chr(10) ORDER BY idx) || chr(10) AS content FROM z GROUP BY job_id"""
)
def ass_export(spark, d):
    return subtitles.ass(even(spark, d), "song")


@query(f"""WITH {EVEN} SELECT job_id, cast(to_json(struct_pack(job_id := job_id, duration := 60e0, captions := list(struct_pack(start := round(start, 3),
        "end" := round("end", 3), "text" := text, score := 0e0, sync_text := '') ORDER BY idx))) AS varchar) AS content
    FROM ev GROUP BY job_id""")
def manifest_json(spark, d):
    c = even(spark, d).withColumns({"sync_text": F.lit(""), "start": F.round("start", 3), "end": F.round("end", 3)})
    return subtitles.manifest(c.groupBy("job_id").agg(F.max("duration").alias("duration")), c)


@query(f"""WITH {_STAMPS} SELECT job_id, string_agg({_SRT('s')} || ' --> ' || {_SRT('e')} || '  ' || text, chr(10) ORDER BY idx) FILTER (idx < 4) ||
    CASE WHEN count(*) > 4 THEN chr(10) || '... ' || cast(count(*) - 4 AS varchar) || ' more lines' ELSE '' END AS preview FROM z GROUP BY job_id""")
def caption_preview(spark, d):
    return subtitles.preview(even(spark, d), 4)


@query(
    """SELECT cast(user_id AS varchar) AS job_id, cast(to_json(list(struct_pack(cost := round(value, 3), frame := event_id) ORDER BY round(value, 3), event_id)) AS varchar) AS content FROM events GROUP BY user_id"""
)
def dtw_diagnostics(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.round("value", 3).alias("cost"), F.col("event_id").alias("frame"))
    return subtitles.diagnostics(rows, ["job_id"])
