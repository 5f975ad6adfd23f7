"""Files and JSON: writers, diagnostics, metadata files, search results, autocompletion."""

import json

from pyspark.sql import functions as F

from strandline.operators import catalog, timeline
from strandline.sources import scans, subtitles


def test_written_subtitles(spark, tmp_path):
    c = spark.createDataFrame(
        [("a", 1, 2.0, 3.5, "zwei"), ("a", 0, 0.0, 1.0, "eins\nzwei"), ("b", 0, 1.0, 2.0, "한국어")],
        "job_id string, idx int, start double, end double, text string"
    )
    subtitles.write_texts(subtitles.srt(c), str(tmp_path / "srt"), folders=True)
    got = {r["job_id"]: r["value"] for r in spark.read.text(str(tmp_path / "srt"), wholetext=True).collect()}
    assert got["a"] == "1\n00:00:00,000 --> 00:00:01,000\neins\nzwei\n\n2\n00:00:02,000 --> 00:00:03,500\nzwei\n" and "한국어" in got["b"]
    ass = {r["job_id"]: r["content"] for r in subtitles.ass(c, "t", position="Top center").collect()}
    assert ass["a"].startswith("﻿[Script Info]\nTitle: t\n") and ",8,90,90,70,1" in ass["a"] and "eins\\Nzwei" in ass["a"]
    assert ass["a"].index("eins") < ass["a"].index("0:00:02.00")


def test_written_texts_keep_ids_and_contents(spark, tmp_path):
    rows = [(None, "a\n"), ("x/y =%", "b"), ("", ""), ("1", None)]
    subtitles.write_texts(spark.createDataFrame([(*r, 5) for r in rows], "job_id string, content string, other int"), str(tmp_path / "all"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "all")).collect()), key=str) == sorted(rows, key=str)


def test_infinite_numbers_become_null(spark):
    df = spark.createDataFrame([("j", float("inf"), 1.5), ("j", float("nan"), 2.5)], "job_id string, quality double, cost double")
    assert json.loads(subtitles.diagnostics(df, ["job_id"]).first()["content"]) == [{"cost": 1.5}, {"cost": 2.5}]


def test_manifest_and_preview(spark):
    c = spark.createDataFrame(
        [("a", i, float(i), i + 0.5, f"l{i}", 1.0, "") for i in range(14)],
        "job_id string, idx int, start double, end double, text string, score double, sync_text string"
    )
    jobs = spark.createDataFrame([("a", "가수", None), ("none", "x", 1.0)], "job_id string, artist string, duration double")
    got = {r["job_id"]: json.loads(r["content"]) for r in subtitles.manifest(jobs, c).collect()}
    assert got["a"]["artist"] == "가수" and [x["text"] for x in got["a"]["captions"]] == [f"l{i}" for i in range(14)] and "captions" not in got["none"]
    text = subtitles.preview(c).first()["preview"]
    assert text.startswith("00:00:00,000 --> 00:00:00,500  l0\n") and text.count("\n") == 12 and text.endswith("... 2 more lines")


def test_newest_metadata_file(spark, tmp_path):
    import os

    for name, title, when in (("a.info.json", "old", 1_000_000_000), ("b.info.json", "new", 1_600_000_000), ("c.txt", "other", 1_700_000_000)):
        (tmp_path / name).write_text(json.dumps({"title": title}))
        os.utime(tmp_path / name, (when, when))
    rows = scans.newest_metadata(spark, str(tmp_path)).collect()
    assert [json.loads(r["payload"])["title"] for r in rows] == ["new"]


def test_search_entries_and_pick(spark):
    entries = [
        {"id": "x", "title": "Song", "channel": "", "uploader": "Band", "duration": 100}, {"id": "", "duration": 100},
        {"id": "y", "title": "Other", "channel": "C", "duration": 101},
        {"id": "z", "title": "Song", "channel": "Band - Topic", "duration": 102}, {"id": "w", "title": "none"}
    ]
    df = spark.createDataFrame([("j", json.dumps({"entries": entries}))], "job_id string, payload string")
    e = scans.search_entries(df)
    assert sorted(r["id"] for r in e.collect()) == ["x", "y", "z"]
    target = spark.createDataFrame([("j", "band", "song", 101.0)], "job_id string, artist string, title string, target double")
    assert catalog.pick_recording(e, target).first()["id"] == "z"
    assert catalog.pick_recording(e, target.withColumn("target", F.lit(300.0))).count() == 0


def test_autocompletion_takes_the_first_sure_source(spark):
    rows = [
        ("a", 0, 0.89, "A", "one"), ("a", 1, 0.95, "B", "two"), ("b", 0, 0.5, "A", "one"), ("b", 1, 0.5, "B", "two"),
        ("c", 0, 0.4, "A", "one"), ("c", 1, 0.6, "B", "two")
    ]
    df = spark.createDataFrame(rows, "job_id string, priority int, score double, artistName string, trackName string")
    assert {r["job_id"]: r["artistName"] for r in catalog.autocomplete(df).collect()} == {"a": "A", "b": "A", "c": "B"}


def test_upsert_keeps_the_last_in_the_first_order(spark):
    rows = [("j", 0, 7, "old", "a", "x", 1.0), ("j", 1, None, "p", "a", "x", 1.0), ("j", 2, 7, "new", "a", "x", 2.0), ("j", 3, None, "p", "a", "x", 1.0)]
    df = spark.createDataFrame(rows, "job_id string, seq int, id long, trackName string, artistName string, albumName string, duration double")
    assert [(r["seq"], r["trackName"]) for r in catalog.upsert(df).orderBy("seq").collect()] == [(0, "new"), (1, "p")]


def test_active_time(spark):
    iv = spark.createDataFrame([("j", 0, 10.0, 12.0), ("j", 1, 20.0, 28.0), ("zero", 0, 5.0, 5.0)], "job_id string, idx int, start double, end double")
    f = spark.createDataFrame([("j", 0.0), ("j", 0.2), ("j", 0.5), ("j", 1.0), ("j", 7.0), ("zero", 0.5), ("none", 0.5)], "job_id string, fraction double")
    got = {(r["job_id"], r["fraction"]): r["t"] for r in timeline.active_time(f, iv).collect()}
    assert got == {("j", 0.0): 10.0, ("j", 0.2): 12.0, ("j", 0.5): 23.0, ("j", 1.0): 28.0, ("j", 7.0): 28.0, ("zero", 0.5): 5.0, ("none", 0.5): 0.0}
