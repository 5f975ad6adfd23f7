"""Writers of SRT, ASS and JSON: one output text per job, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import ass_color, ass_escape, ass_time, srt_time

# Fixed values of the format: alignment numbers, and the field lists of styles and events.
POSITIONS = {"Bottom center": 2, "Middle center": 5, "Top center": 8}
STYLE_FIELDS = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def _joined(captions: DataFrame, piece: Column, between: str, name: str = "content") -> DataFrame:
    rows = captions.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("idx", piece.alias("piece")))).alias("rows"))
    return rows.select("job_id", F.array_join(F.transform("rows", lambda r: r["piece"]), between).alias(name))


def srt(captions: DataFrame) -> DataFrame:
    """job_id, content of captions (job_id, idx, start, end, text)."""
    return _joined(
        captions,
        F.concat(
            (F.col("idx") + 1).cast("string"), F.lit("\n"), srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("\n"),
            F.col("text"), F.lit("\n")
        ),
        "\n"
    )


def ass_header(
    title: Column, font: str = "Malgun Gothic", size: int = 48, position: str = "Bottom center", primary: str = "#FFFFFF",
    outline: str = "#000000", width: float = 2.5, shadow: float = 1.0, margin: int = 70
) -> Column:
    """Fixed format: script, style and event headers for a 1920 x 1080 picture."""
    values = [
        F.lit(f"Default,{font},{size},"), ass_color(F.lit(primary)), F.lit(",&H000000FF,"), ass_color(F.lit(outline)),
        F.lit(f",&H88000000,0,0,0,0,100,100,0,0,1,{width},{shadow},{POSITIONS[position]},90,90,{margin},1")
    ]
    head = F.concat(
        F.lit("[Script Info]\nTitle: "), title,
        F.lit("\nScriptType: v4.00+\nWrapStyle: 0\nScaledBorderAndShadow: yes\nPlayResX: 1920\nPlayResY: 1080\n\n")
    )
    return F.concat(head, F.lit(f"[V4+ Styles]\nFormat: {STYLE_FIELDS}\nStyle: "), *values, F.lit(f"\n\n[Events]\nFormat: {EVENT_FIELDS}\n"))


def ass(captions: DataFrame, title: str | Column = "", **style) -> DataFrame:
    """job_id, content, with a byte order mark, as players expect of this format."""
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start")), F.lit(","), ass_time(F.col("end")), F.lit(",Default,,0,0,0,,"), ass_escape(F.col("text")))
    title = F.lit(title) if isinstance(title, str) else title
    return _joined(captions, line, "\n").withColumn("content", F.concat(F.lit("﻿"), ass_header(title, **style), F.col("content"), F.lit("\n")))


def finite(x: Column) -> Column:
    """The number, or null where it is infinite or not a number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def manifest(jobs: DataFrame, captions: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """job_id, content: a job's columns with its captions and segments as nested arrays, in JSON."""
    fold = lambda df, name, cols: df.groupBy("job_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("idx", *cols))), lambda r: F.struct(*[r[c].alias(c) for c in cols])
    ).alias(name))
    out = jobs.join(fold(captions, "captions", ["start", "end", "text", "score", "sync_text"]), "job_id", "left")
    if segments is not None:
        out = out.join(fold(segments, "segments", ["start", "end", "text"]), "job_id", "left")
    return out.select("job_id", F.to_json(F.struct(*out.columns)).alias("content"))


def diagnostics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content: the other columns of each group as a JSON array; infinite numbers become null."""
    cols = [finite(F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in rows.dtypes if n not in keys]
    return rows.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*cols)))).alias("content"))


def preview(captions: DataFrame, most: int = 12) -> DataFrame:
    """job_id, preview: the first captions with their times, and how many more there are."""
    line = F.concat(srt_time(F.col("start")), F.lit(" --> "), srt_time(F.col("end")), F.lit("  "), F.col("text"))
    rows = captions.groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", line.alias("l")))), lambda r: r["l"]).alias("rows"))
    more = F.when(F.size("rows") > most, F.concat(F.lit("\n... "), (F.size("rows") - most).cast("string"), F.lit(" more lines"))).otherwise("")
    return rows.select("job_id", F.concat(F.array_join(F.slice("rows", 1, most), "\n"), more).alias("preview"))


def write_texts(contents: DataFrame, path: str, folders: bool = False) -> None:
    """Writes (job_id, content) below path: as one table, which holds any id as it is and has few files whatever the number of jobs; with
    `folders` as text files in a folder a job, for players that want files. There, ids are Spark's folder names (a null one's is
    __HIVE_DEFAULT_PARTITION__), and the writer ends a row with a line end, so a content's own last one is left to it."""
    if not folders:
        contents.select("job_id", "content").write.option("compression", "zstd").parquet(path)
        return
    body = F.when(F.endswith("content", F.lit("\n")), F.substring("content", F.lit(1), F.length("content") - 1)).otherwise(F.col("content"))
    contents.select("job_id", body.alias("value")).write.partitionBy("job_id").text(path)
