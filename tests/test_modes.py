"""Every mode gives the captions of its method, and every job captions or an error."""

import json

import pytest

from strandline.plans.pipeline import ANCHORS, DTW, EVEN, SYNCED, VOCAL, WHISPER, alignment_windows, finish_jobs, refinement_notes, run_jobs, start_jobs

LINES = ["over the hills", "and far away", "the rain comes down"]
# job, mode, text, anchors, lyrics found (exact or not), method, or None and the error
JOBS = [
    (
        "stamped", EVEN, "[00:05.00] a\n[00:09.00] b", "", None, "stamped text", None
    ), ("even", EVEN, None, "", True, "even", None), ("anchors", ANCHORS, None, "1=4\n3=20", None, "anchors", None),
    ("synced", SYNCED, None, "", False, "stamped lyrics", None), ("synced-none", SYNCED, None, "", None, "activity", None), (
        "words-exact", WHISPER, None, "", True, "stamped lyrics", None
    ),
    ("words-near", WHISPER, None, "", False, "transcript", None), ("active", VOCAL, None, "", None, "activity", None), (
        "active-exact", VOCAL, None, "", True, "stamped lyrics", None
    ),
    ("mapped", DTW, None, "", True, "stamped lyrics", None), (
        "mapped-words", DTW, None, "", None, "transcript", None
    ), ("unmapped", DTW, None, "", True, None, "no time map"),
    (
        "flat", DTW, None, "", True, None, "caption 2 has no length on the map"
    ), ("unknown", "Karaoke", None, "", None, None, "unknown mode"), ("blank", EVEN, " \n", "", None, None, "no lyrics"),
    ("no-blocks", EVEN, "[intro]", "", None, None, "no lyric blocks"), ("no-anchors", ANCHORS, None, "# none", None, None, "no anchors"), (
        "bad-anchors", ANCHORS, None, "1=4\n4=20", None, None, "index out of range: 4=20"
    ),
    ("null-anchors", ANCHORS, None, None, None, None, "no anchors"), (
        "twice", EVEN,
        "\n\n".join([f"{a} {b} goes by the {c} way" for a in ("one", "two", "six") for b in ("bird", "boat") for c in ("long", "short", "old")] * 2),
        "", None, "even", None
    ),
]


@pytest.fixture(scope="module")
def rows(spark):
    table = lambda schema, rows: spark.createDataFrame(rows, schema)
    jobs = table(
        "job_id string, mode string, offset double, duration double, text string, anchors string",
        [(j, mode, 0.5, 40.0, "\n\n".join(LINES) if text is None else text, anchors) for j, mode, text, anchors, *_ in JOBS]
    )
    timed = lambda j, *more: [(j, i, 5.0 + 5 * i, 9.0 + 5 * i, t, *more) for i, t in enumerate(LINES)]
    lrc = table(
        "job_id string, idx int, start double, end double, text string, exact boolean",
        [r for j, _, _, _, exact, *_ in JOBS if exact is not None for r in timed(j, exact)]
    )
    segments = table("job_id string, idx int, start double, end double, text string", [(j, i, s + 1, e + 1, t) for j, *_ in JOBS for _, i, s, e, t in timed(j)])
    intervals = table("job_id string, idx int, start double, end double", [(j, 0, 10.0, 25.0) for j, *_ in JOBS if j != "words-exact"])
    axis = table(
        "job_id string, ref_t double, perf_t double",
        [(j, t, t + 2.0) for j in ("mapped", "mapped-words") for t in (0.0, 30.0)] + [("flat", 0.0, 39.9), ("flat", 40.0, 40.0)]
    )
    out: dict = {}
    for r in run_jobs(jobs, lrc, segments, intervals, axis).collect():
        out.setdefault(r["job_id"], []).append(r)
    return {j: sorted(own, key=lambda r: r["idx"] or 0) for j, own in out.items()}


def test_every_job_comes_out(rows):
    assert set(rows) == {j[0] for j in JOBS}


@pytest.mark.parametrize("job, mode, method, error", [(j[0], j[1], j[5], j[6]) for j in JOBS])
def test_mode(rows, job, mode, method, error):
    got = rows[job]
    assert {r["mode"] for r in got} == {mode} and {r["error"] for r in got} == {error}
    if error:
        assert len(got) == 1 and got[0]["idx"] is None and got[0]["start"] is None
    else:
        assert {r["method"] for r in got} == {method} and [r["idx"] for r in got] == list(range(len(got)))
        assert [r["text"] for r in got] == LINES or job in ("stamped", "twice")


def test_times(rows):
    start = {j: [r["start"] for r in own] for j, own in rows.items()}
    assert start["stamped"] == [5.0, 9.0]  # its own stamps take no offset
    assert start["words-near"] == pytest.approx([6.5, 11.5, 16.5]) and start["words-exact"] == pytest.approx([5.5, 10.5, 15.5])
    assert start["synced"] == pytest.approx([5.5, 5.5 + 5 * 20 / 14, 5.5 + 10 * 20 / 14])  # fitted: its end, 19 s, goes to the last active second, 25 s
    assert start["anchors"] == pytest.approx([4.5, 12.5, 20.5]) and start["active"][0] == pytest.approx(10.5)
    assert start["mapped"] == pytest.approx([7.5, 12.5, 17.5]) and start["mapped-words"] == pytest.approx([8.5, 13.5, 18.5])
    assert len(rows["twice"]) == 18  # a second copy of the whole is dropped


@pytest.fixture(scope="module")
def started(spark):
    """Three mapped jobs: one with twelve lines, one of two lines, one that is not to be refined."""
    lines = {
        "long": [f"line {i} of {w} song" for i, w in enumerate("one two red blue old new hot cold big small low high".split())],
        "short": ["first of two", "second of them"], "asis": ["some words here", "other words there", "third words now"]
    }
    schema = "job_id string, mode string, duration double, text string, refine boolean, offset double, language string, idx int"
    jobs = spark.createDataFrame([(j, DTW, 100.0, "\n\n".join(t), j != "asis", 1.0, None, 3) for j, t in lines.items()], schema)
    lrc = spark.createDataFrame(
        [(j, i, 4.0 * i + 2, 4.0 * i + 5, t) for j, own in lines.items() for i, t in enumerate(own)],
        "job_id string, idx int, start double, end double, text string"
    )
    axis = spark.createDataFrame([(j, t, t + 2) for j in lines for t in (0.0, 90.0)], "job_id string, ref_t double, perf_t double")
    return lines, start_jobs(jobs, lrc, axis=axis)


def forced(spark, windows, late=0.4, short=()):
    """Every window's lines at their mapped times, `late` seconds later; the windows in `short` have a segment less."""
    rows = []
    for w in windows:
        n = w["high"] - w["low"] - ((w["low"], w["high"]) in short)
        segments = [{"start": 1.5 + 4 * k + late, "end": 4.5 + 4 * k + late, "words": [{"start": 1.0, "end": 2.0, "probability": 0.5}]} for k in range(n)]
        rows.append((w["job_id"], w["low"], w["high"], json.dumps({"segments": segments})))
    return spark.createDataFrame(rows, "job_id string, low int, high int, result string")


def by_job(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r["job_id"], []).append(r)
    return {j: sorted(own, key=lambda r: -1 if r["idx"] is None else r["idx"]) for j, own in out.items()}


def test_windows_of_a_started_run(spark, started):
    lines, path = started
    windows = alignment_windows(spark, path).collect()
    assert {w["job_id"] for w in windows} == {"long"} and {(w["low"], w["high"]) for w in windows} == {(0, 6), (6, 12), (0, 8), (4, 12), (8, 12)}
    for w in windows:
        assert w["lines"] == lines["long"][w["low"] : w["high"]] and w["language"] == "en"
        assert w["at"] == pytest.approx(4.0 * w["low"] + 2.5) and w["until"] == pytest.approx(4.0 * w["high"] + 3 + 1.5)


def test_finish_resumes_from_what_is_written(spark, started):
    lines, path = started
    plain = by_job(finish_jobs(spark, path).collect())
    assert {j: [r["start"] for r in own] for j, own in plain.items()} == {j: pytest.approx([4.0 * i + 5 for i in range(len(t))]) for j, t in lines.items()}
    windows = alignment_windows(spark, path).collect()
    results = forced(spark, windows, 0.4, {(4, 12)})
    for _ in range(2):  # the written tables stay as they are
        got = by_job(finish_jobs(spark, path, results).collect())
        assert [r["start"] for r in got["short"]] == [r["start"] for r in plain["short"]] and [r["start"] for r in got["asis"]] == [r["start"] for r in plain["asis"]]
        assert [r["start"] for r in got["long"]] == pytest.approx([4.0 * i + 5.4 for i in range(12)]) and all(r["error"] is None for r in got["long"])
    notes = refinement_notes(spark, path, results).collect()
    assert sorted((r["job_id"], r["source"], r["error"]) for r in notes if r["idx"] is None) == sorted(
        [("long", "5-12", "7 segments in place of 8"), ("short", None, "not refined: other captions than blocks, or fewer than three")],
        key=str
    )
    assert [r["refined_start"] for r in sorted(
        (r for r in notes if r["idx"] is not None), key=lambda r: r["idx"]
    )] == pytest.approx([4.0 * i + 4.4 for i in range(12)])


def test_lost_captions_are_errors_and_are_not_refined(spark, started, tmp_path):
    import shutil

    lines, path = started
    other = f"{tmp_path}/run"
    shutil.copytree(path.removeprefix("file://"), other)
    shutil.rmtree(f"{other}/captions")
    spark.read.parquet(f"{path}/captions").where("NOT (job_id = 'asis' AND idx = 1)").write.parquet(f"{other}/captions")
    got = by_job(finish_jobs(spark, other).collect())
    assert set(got) == set(lines) and [r["error"] for r in got["asis"]] == ["other captions than blocks"] and got["asis"][0]["idx"] is None
    assert len(got["long"]) == 12 and got["long"][0]["error"] is None


def test_empty_run(spark):
    none = spark.createDataFrame([], "job_id string, mode string, duration double, text string")
    path = start_jobs(none)
    results = spark.createDataFrame([], "job_id string, low int, high int, result string")
    assert finish_jobs(spark, path, results).count() == 0 and alignment_windows(spark, path).count() == 0 and refinement_notes(spark, path, results).count() == 0
