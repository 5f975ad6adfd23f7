"""Reference recordings: pitch shift, costs and the choice of a time map."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import reference, timemap


def features(spark, shift, lead=3):
    rnd = np.random.default_rng(4)
    a = np.abs(rnd.normal(size=(60, 12))) + np.linspace(2, 0, 12)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.roll(np.concatenate([np.repeat(a[:1], lead, axis=0), a]), -shift, axis=1)
    rows = [("j", side, i, x.tolist(), x.tolist()) for side, m in (("ref", a), ("perf", b)) for i, x in enumerate(m)]
    return spark.createDataFrame(rows, "job_id string, side string, frame int, chroma array<double>, onset array<double>")


def test_pitch_shift_is_found(spark):
    f = features(spark, 5)
    shifts = timemap.pitch_shifts(f)
    assert shifts.first()["shift"] == 5
    even = reference.turned(f, shifts)
    got = {r["frame"]: r["chroma"] for r in even.where("side = 'perf'").collect()}
    want = {r["frame"]: r["chroma"] for r in even.where("side = 'ref'").collect()}
    assert got[10] == pytest.approx(want[7])


def test_turned_map_wins_on_a_transposed_performance(spark):
    axis, report = reference.best_map(features(spark, 5), 10.0)
    r = report.first()
    assert r["method"] == "multiscale" and r["multiscale_cost"] < r["legacy_cost"] and r["shift"] == 5 and r["error"] is None
    late = axis.where("ref_t BETWEEN 1 AND 5").select(F.avg(F.col("perf_t") - F.col("ref_t"))).first()[0]
    assert late == pytest.approx(0.3, abs=0.1)


def test_recordings_that_do_not_fit_are_reported(spark):
    lengths = (("short", 5, 60), ("unlike", 60, 90), ("fits", 60, 60))
    unit = lambda i: [float(i % 12 == k) for k in range(12)]
    rows = [(j, side, i, unit(i)) for j, n, m in lengths for side, size in (("ref", n), ("perf", m)) for i in range(size)] + [("alone", "ref", i, [1.0] * 12) for i in range(50)]
    f = spark.createDataFrame(rows, "job_id string, side string, frame int, chroma array<double>").withColumn("onset", F.col("chroma"))
    axis, report = reference.best_map(f, 10.0)
    got = {r["job_id"]: (r["method"], r["error"]) for r in report.collect()}
    assert got["short"] == ("invalid", "too short") and got["alone"] == ("invalid", "too short") and got["unlike"] == ("invalid", "lengths differ too much") and got["fits"][1] is None
    assert {r["job_id"] for r in axis.select("job_id").distinct().collect()} == {"fits"}


def test_features_of_recordings(spark, tmp_path):
    import wave

    rate = 8000
    tone = lambda f: np.sin(2 * np.pi * f * np.arange(rate) / rate)
    x = (np.concatenate([tone(440), tone(523.25)]) * 20_000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.repeat(x, 2).astype("<i2").tobytes())
    rows = timemap.music_features(spark.read.format("binaryFile").load(str(tmp_path)), rate).orderBy("frame").collect()
    assert len(rows) == 101 and [
        int(np.argmax(rows[k]["chroma"])) for k in (20, 80)
    ] == [9, 0] and set(np.unique(rows[20]["chroma"])) <= {0.0, 0.25, 0.5, 0.75, 1.0}
    assert all(np.linalg.norm(r["onset"]) <= 1 + 1e-9 for r in rows) and np.argmax(rows[50]["onset"]) == 0


def test_sound_files_to_captions(spark, tmp_path):
    """From two recordings and stamped lyrics to captions on the performance, which begins 0.6 s later; a job with a broken file says so."""
    import wave

    from strandline.plans.pipeline import DTW, run_jobs

    rate, rnd = 22_050, np.random.default_rng(3)
    notes = np.concatenate([np.sin(2 * np.pi * f * np.arange(rate // 2) / rate) for f in rnd.choice([262, 294, 330, 349, 392, 440, 494], 12)])
    for name, lead in (("ref", 0.0), ("perf", 0.6)):
        x = np.concatenate([0.001 * rnd.normal(size=int(lead * rate)), notes])
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes((x * 20_000).astype("<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    path = {r["path"].rpartition("/")[2]: r["path"] for r in files.select("path").collect()}
    own = [("good", "ref", "ref.wav"), ("good", "perf", "perf.wav"), ("broken", "ref", "ref.wav"), ("broken", "perf", "bad.wav"), ("lost", "ref", "ref.wav"), ("lost", "perf", None)]
    sides = spark.createDataFrame([(j, side, path.get(f, "gone")) for j, side, f in own], "job_id string, side string, path string")
    axis, report = reference.audio_map(sides, files)
    got = {r["job_id"]: r for r in report.collect()}
    assert got["good"]["error"] is None and got["good"]["method"] != "invalid"
    assert got["broken"]["method"] == got["lost"]["method"] == "invalid" and "bad.wav" in got["broken"]["error"] and got["lost"]["error"] == "gone: no sound"
    lines = ["first line here", "second line there", "third and last"]
    jobs = spark.createDataFrame([(j, DTW, 6.6, 6.0, "\n\n".join(lines)) for j in got], "job_id string, mode string, duration double, reference_duration double, text string")
    lrc = spark.createDataFrame([(j, i, 1.0 + 1.5 * i, 2.2 + 1.5 * i, t) for j in got for i, t in enumerate(lines)], "job_id string, idx int, start double, end double, text string")
    rows = run_jobs(jobs, lrc, axis=axis).collect()
    starts = [r["start"] for r in sorted((r for r in rows if r["job_id"] == "good"), key=lambda r: r["idx"])]
    assert starts == pytest.approx([1.6, 3.1, 4.6], abs=0.25)
    assert {r["job_id"]: r["error"] for r in rows if r["error"]} == {"broken": "no time map", "lost": "no time map"}


def test_compatibility(spark):
    df = spark.createDataFrame([(100.0, 117.0), (100.0, 119.0), (0.5, 0.5)], "a double, b double")
    assert [r[0] for r in df.select(reference.compatible(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_prompt_is_cut(spark):
    b = spark.createDataFrame([("j", i, "x\ny" * 300) for i in range(3)], "job_id string, idx int, text string")
    text = reference.prompt(b).first()["prompt"]
    assert len(text) == 1600 and text == " ".join(["x y" * 300] * 3)[:1600]
