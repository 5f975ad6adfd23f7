"""Operators on inputs of our own, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.operators import align, catalog, consensus, timeline, timemap
from strandline.sources import scans

ITEMS = "job_id string, idx int, start double, end double, text string"


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def captions(spark, *times, first=0):
    return table(spark, "job_id string, idx int, start double, end double", *[("c", first + i, float(s), float(e)) for i, (s, e) in enumerate(times)])


def candidates(spark, **lines):
    """line_3=[(start, end, confidence, collapsed, source), ...]"""
    rows = [("c", int(name[5:]), k, *map(float, r[:4]), r[4]) for name, own in lines.items() for k, r in enumerate(own)]
    return table(spark, "job_id string, idx int, cand_idx int, start double, end double, confidence double, collapsed_ratio double, source string", *rows)


def stamped(spark, text, duration=100.0):
    return scans.lrc_items(table(spark, "job_id string, duration double, text string", ("s", float(duration), text)))


def blocks(spark, *texts, duration=100.0):
    return table(
        spark, "job_id string, idx int, text string, sync_text string, duration double",
        *[("s", i, t, t.split("\n")[0], duration) for i, t in enumerate(texts)]
    )


def one(spark, column, **values):
    """The value of a column expression over one row."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


# reading


def test_stamped_lines(spark):
    got = stamped(
        spark,
        "[ar: nobody]\n[01:30] walking home\r\n [01:34.5]\n[01:32:250] earlier but later in the file\n[02:00.125][02:10.00] twice stamped\nno stamp",
        124
    ).orderBy("idx").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == [
        (90.0, pytest.approx(94.45), "walking home"),  # a stamp without text ends it
        (92.25, pytest.approx(120.075), "earlier but later in the file"),
        (120.125, pytest.approx(123.625), "[02:10.00] twice stamped"),
    ]
    n = scans.lrc_count(table(spark, "job_id string, text string", ("a", "[00:01.00] x\n[00:02.00] \n[0:3] y"), ("b", "plain"), ("c", None)))
    assert {r["job_id"]: r["n"] for r in n.collect()} == {"a": 1, "b": 0, "c": 0}


@pytest.mark.parametrize(
    "text, seconds",
    [("12.5", 12.5), (" 2:03.25", 123.25), ("1:00:01", 3601.0), ("1.5:20", None), ("1:2.5:3", None), ("", None), ("1:2:3:4", None), ("a", None)]
)
def test_time_values(spark, text, seconds):
    assert one(spark, scans.time_value(F.col("t")), t=text) == seconds


def test_anchors_are_read_or_reported(spark):
    jobs = table(
        spark, "job_id string, n int, duration double, anchors string", ("ok", 4, 90.0, "# two\n\n4 = 1:20\n 1: 7.5 \n4 = 1:20"),
        ("bad", 4, 90.0, "0 = 1\n5 = 2\n2 = 1:31\nthree = 3\n3 = 1.5:20"), ("back", 4, 90.0, "1=9\n2,9"), ("none", 4, 90.0, "  \n# nothing")
    )
    good, wrong = scans.timing_anchors(jobs)
    assert sorted((r["idx"], r["t"]) for r in good.where("job_id = 'ok'").collect()) == [(0, 7.5), (3, 80.0)]
    assert sorted((r["job_id"], r["line"] or "", r["reason"]) for r in wrong.collect()) == [
        ("back", "2 = 9.0", "times must rise"), ("bad", "0 = 1", "index out of range"), ("bad", "2 = 1:31", "time out of range"), ("bad", "3 = 1.5:20", "not an anchor"), ("bad", "5 = 2", "index out of range"),
        ("bad", "three = 3", "not an anchor"), ("none", "", "no anchors"),
    ]


def test_a_text_without_anchors_is_reported_beside_others_of_its_job(spark):
    jobs = table(spark, "job_id string, n int, duration double, anchors string", ("a", 2, 60.0, "1 = 5"), ("a", 2, 60.0, "# none"), ("b", 2, 60.0, None))
    good, wrong = scans.timing_anchors(jobs)
    assert [tuple(r) for r in good.collect()] == [("a", 0, 5.0)]
    assert sorted((r["job_id"], r["line"], r["reason"]) for r in wrong.collect()) == [("a", None, "no anchors"), ("b", None, "no anchors")]


def test_blocks(spark):
    df = table(spark, "job_id string, text string", ("s", "  up \r\ndown\r\n\r\n[bridge,\nquiet]\n \t\nleft\nright\nback\n\n\n"))
    rows = lambda *how: [(r["text"], r["sync_text"]) for r in scans.lyric_blocks(df, *how).orderBy("idx").collect()]
    assert rows(scans.BLOCKS, "Line 3") == [("up\ndown", "down"), ("left\nright\nback", "back")]
    assert rows(scans.BLOCKS, "Last line") == [("up\ndown", "down"), ("left\nright\nback", "back")]
    assert rows(scans.BLOCKS, "All") == [("up\ndown", "up down"), ("left\nright\nback", "left right back")]
    assert [t for t, _ in rows(scans.LINES)] == ["up", "down", "left", "right", "back"]


@pytest.mark.parametrize("payload, want", [
    ('{"track": " Harbour ", "creator": "The Gulls", "title": "x - y"}', ("The Gulls", "Harbour")), (
        '{"title": "Gulls - Harbour [Official Video] | 4K", "uploader": "someone"}', ("Gulls", "Harbour")
    ),
    ('{"title": "Harbour", "channel": "Gulls - Topic"}', ("Gulls", "Harbour")), ("[1", ("who", "what")), (None, ("who", "what")),
])
def test_metadata(spark, payload, want):
    m = one(spark, scans.metadata_fields(F.col("p").cast("string"), F.col("a"), F.col("t")), p=payload, a="who", t="what")
    assert (m["artist"], m["title"]) == want


@pytest.mark.parametrize("value, want", [("/a/b.mp4", "/a/b.mp4"), ('{"path": "/p", "name": "n"}', "/p"), ('{"name": "n"}', "n"), ("{}", None), (None, None)])
def test_uploaded_paths(spark, value, want):
    assert one(spark, scans.uploaded_path(F.col("v").cast("string")), v=value) == want


def test_lengths_have_a_floor(spark):
    assert [one(spark, scans.duration_of(F.col("d")), d=d) for d in (0.0, -3.0, 7.25)] == [0.1, 0.1, 7.25]


# texts


def test_similarity_depends_on_order(spark):
    df = table(spark, "a string, b string", ("tide", "diet"), ("diet", "tide"), ("", "x"), ("Ab!", "a b"))
    assert [r[0] for r in df.select(X.similarity(F.col("a"), F.col("b"))).collect()] == [0.25, 0.5, 0.0, 1.0]


def test_title_variants(spark):
    got = one(spark, X.title_variants(F.col("t")), t="灯台 (Lighthouse live) | MV")
    assert got == ["灯台 (Lighthouse live) |", "灯台 (Lighthouse live)", "Lighthouse live"]


@pytest.mark.parametrize("a, b, want", [("Harbour (live)", "harbour feat. Someone", 1.0), ("Harbour", "Harbourside", 7 / 11), ("(x)", "x", 0.0)])
def test_metadata_similarity(spark, a, b, want):
    assert one(spark, X.metadata_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


@pytest.mark.parametrize(
    "text, configured, want",
    [("바다 seas", "auto", "en"), ("바다와 파도", "auto", "ko"), ("うみ 바", "auto", "ja"), ("바다", "ja", "ja"), ("sea", "auto", "en"), ("123", "auto", None)]
)
def test_language(spark, text, configured, want):
    h, k, l = X.script_counts(F.col("t"))  # noqa: E741
    assert one(spark, X.language_of(h, k, l, F.lit(configured)), t=text) == want


def test_literals(spark):
    srt = [one(spark, X.srt_time(F.col("t")), t=t) for t in (0.0005, 0.0015, 3661.25, 59.9999)]
    assert srt == ["00:00:00,000", "00:00:00,002", "01:01:01,250", "00:01:00,000"]
    assert [one(spark, X.ass_time(F.col("t")), t=t) for t in (0.005, 0.015, 3661.25)] == ["0:00:00.00", "0:00:00.02", "1:01:01.25"]
    assert [one(spark, X.ass_color(F.col("c")), c=c) for c in ("#12ab34", "red")] == ["&H0034AB12", "&H00FFFFFF"]
    assert one(spark, X.ass_escape(F.col("t")), t="a{b}\\\n") == "a\\{b\\}\\\\\\N" and one(spark, X.slug(F.col("t")), t="a b/c!") == "a_b_c"


# alignment


def test_blocks_on_stamped_lines(spark):
    """One block on two lines, a line nobody has, and two blocks on one line, which share its time by the roots of their key lengths."""
    text = "[00:04.00] over the hills\n[00:08.00] and far away\n[00:12.00] (whistling)\n[00:20.00] rain rain rain go\n[00:30.00] "
    got = align.align_to_lrc(blocks(spark, "over the hills and far away", "rain rain rain", "go"), stamped(spark, text)).orderBy("idx").collect()
    assert [(r["start"], r["end"]) for r in got] == [
        (4.0, pytest.approx(11.95)), (20.0, pytest.approx(20 + 9.95 * 12**0.5 / (12**0.5 + 2**0.5))),
        (pytest.approx(20 + 9.95 * 12**0.5 / (12**0.5 + 2**0.5)), pytest.approx(29.95))
    ]
    assert got[0]["sync_text"] == "over the hills and far away" and {r["lrc_count"] for r in got} == {4} and got[0]["average"] > 0.9


def test_transcript_or_active_time(spark):
    b = blocks(spark, "the morning bell\nla cloche du matin", "the evening bell")
    heard = table(spark, ITEMS, ("s", 0, 21.0, 24.0, "la cloche du matin"), ("s", 1, 31.0, 34.0, "the evening bell"))
    active = table(spark, "job_id string, idx int, start double, end double", ("s", 0, 50.0, 60.0))
    got = align.align_to_reference(b, heard, active).orderBy("idx").collect()
    assert [(r["start"], r["end"], r["method"]) for r in got] == [(21.0, 24.0, "transcript"), (31.0, 34.0, "transcript")]
    got = align.align_to_reference(b, heard.withColumn("text", F.lit("zzz qqq")), active).orderBy("idx").collect()
    assert [(r["start"], r["end"], r["method"]) for r in got] == [(50.0, pytest.approx(54.96), "activity"), (55.0, 60.0, "activity")]


# rules of timing


def test_the_last_line_has_a_length_of_its_own(spark):
    b = blocks(spark, "a", "b", "c", duration=60.0)
    got = timeline.anchor_spacing(b, table(spark, "job_id string, idx int, t double", ("s", 0, 4.0), ("s", 2, 20.0))).orderBy("idx").collect()
    assert [(r["start"], r["end"]) for r in got] == [(4.0, pytest.approx(11.95)), (12.0, pytest.approx(19.95)), (20.0, 23.0)]


def test_two_windows_agree(spark):
    c = captions(spark, (30, 33), (40, 43), (50, 53), (60, 63))
    found = candidates(spark,
        line_0=[(30.4, 33.6, 0.3, 0, "1-6"), (30.8, 34.2, 0.2, 0, "1-8")],  # both ends
        line_1=[(41.7, 44, 0.1, 0, "1-6"), (41.8, 44, 0.1, 0, "1-8")],  # too far for two windows of little confidence
        line_2=[(52.2, 55, 0.3, 0.1, "1-6"), (52.3, 55.5, 0.4, 0.2, "1-8")],  # as far, but sure
        line_3=[(60.2, 63, 0.02, 0.9, "1-6"), (60.2, 63, 0.03, 0.8, "1-8")])  # collapsed words
    assert {r["idx"]: (r["start"], r["end"]) for r in consensus.consensus(c, found).collect()} == {
        0: (pytest.approx(30.6), pytest.approx(33.9)), 2: (pytest.approx(52.25), pytest.approx(55.25))
    }


def test_lines_next_to_a_pause(spark):
    c = captions(spark, (5, 8), (20, 24), (24.2, 27))
    found = candidates(
        spark, line_0=[(5.5, 9, 0.1, 0, "1-6"), (6.1, 9.2, 0.1, 0, "1-8"), (5.9, 9.1, 0.1, 0, "2-9")],
        line_1=[(21.0, 25, 0.1, 0, "2-7"), (21.2, 25.4, 0.1, 0, "2-9"), (23.5, 26, 0.9, 0, "1-6")]
    )
    assert {r["idx"]: (r["start"], r["end"]) for r in consensus.boundary(c, found).collect()} == {
        0: (pytest.approx(5.9), pytest.approx(9.1)), 1: (pytest.approx(21.1), pytest.approx(25.2))
    }


def test_windows_that_begin_before(spark):
    c = captions(spark, (70, 73), first=9)
    near = [(71.2, 74, 0.2, 0, "5-12"), (71.6, 74.4, 0.3, 0, "3-11"), (75, 78, 0.9, 0, "10-14")]
    assert consensus.contextual(c, candidates(spark, line_9=near)).first()["start"] == pytest.approx(71.4)
    assert consensus.contextual(c, candidates(spark, line_9=[(r[0] - 0.8, *r[1:]) for r in near])).count() == 0  # moves it by less than a second


@pytest.mark.parametrize("following, confidence, want", [(9.0, 0.3, 3.1), (3.3, 0.3, None), (9.0, 0.1, None)])
def test_late_first_line(spark, following, confidence, want):
    c = captions(spark, (0.8, 6), (following, following + 2))
    got = consensus.first_line(c, candidates(spark, line_0=[(3.0, 7, confidence, 0, "1-6"), (3.2, 7, confidence, 0, "1-8")])).first()
    assert (got and got["start"]) == (want and pytest.approx(want))


def test_forced_results_become_candidates(spark):
    c = captions(spark, (1.0, 3.0), (4.0, 6.0), (8.0, 9.0)).withColumn("duration", F.lit(30.0))
    windows = table(spark, "job_id string, low int, high int", ("c", 0, 2), ("c", 1, 3), ("c", 0, 3))
    result = '{"segments": [{"start": 0.5, "end": 2, "words": [{"start": 0.5, "end": 0.52, "probability": 0.4}, {"start": 0.6, "end": 2.0}]}, {"start": 3, "end": 4.5}]}'
    found, errors = scans.forced_candidates(
        windows, c,
        table(spark, "job_id string, low int, high int, result string", ("c", 0, 2, result), ("c", 1, 3, result), ("c", 0, 3, result))
    )
    assert sorted((r["idx"], r["cand_idx"], r["start"], r["end"], r["confidence"], r["collapsed_ratio"], r["source"]) for r in found.collect()) == [
        (0, 0, 0.5, 2.0, 0.2, 0.5, "1-2"), (1, 0, 3.0, 4.5, 0.0, 0.0, "1-2"), (1, 1, 3.0, 4.5, 0.2, 0.5, "2-3"), (2, 0, 5.5, 7.0, 0.0, 0.0, "2-3"),
    ]
    assert [tuple(r) for r in errors.collect()] == [("c", "1-3", "2 segments in place of 3")]
    rows = consensus.refinement_rows(c, consensus.refine(c, found), found, errors).collect()
    assert sorted(
        (r["idx"], len(r["candidates"])) for r in rows if r["idx"] is not None
    ) == [(0, 1), (1, 2), (2, 1)] and [r["source"] for r in rows if r["error"]] == ["1-3"]


@pytest.mark.parametrize(
    "costs, spreads, want",
    [
        ((0.30, 0.28), (3, 4), "multiscale"), ((0.30, 0.27), (3, 4), "legacy"), ((0.1, 0.9), (13, 4), "legacy"),
        ((0.9, 0.1), (4, 13), "multiscale"), ((0.1, 0.1), (13, 14), "invalid"), ((0.1, None), (3, None), "multiscale")
    ]
)
def test_method_choice(spark, costs, spreads, want):
    value = lambda x: F.lit(x).cast("double")
    assert one(spark, timemap.choose_method(*map(value, costs), *map(value, spreads), F.lit(12.0))) == want


def test_warped_captions_keep_a_length(spark):
    axis = table(spark, "job_id string, ref_t double, perf_t double", ("c", 0.0, 0.0), ("c", 10.0, 10.0), ("c", 20.0, 10.0), ("c", 30.0, 20.0))
    got, wrong = timeline.warp_by_map(captions(spark, (2, 5), (12, 12.05), (24, 26)).withColumn("duration", F.lit(18.0)), axis)
    assert [(r["start"], r["end"]) for r in got.orderBy("idx").collect()] == [(2.0, 5.0), (10.0, pytest.approx(10.2)), (14.0, 16.0)]
    assert wrong.count() == 0
    _, wrong = timeline.warp_by_map(captions(spark, (25, 26), (27, 29), (29, 30)).withColumn("duration", F.lit(17.0)), axis)
    assert sorted(r["idx"] for r in wrong.collect()) == [1, 2]


# catalog

RECORDS = "job_id string, seq int, id long, trackName string, artistName string, duration double, syncedLyrics string"
QUERY = "job_id string, artist string, title string, duration double, lines int"
TWO = "[00:01.00] a\n[00:04.00] b"


def test_ranking(spark):
    records = table(
        spark, RECORDS, ("q", 0, 1, "Harbour", "Gulls", 300.0, TWO), ("q", 1, 2, "Harbour (Live)", "Gulls", 181.0, TWO),
        ("q", 2, 3, "Harbour", "Gulls", 181.0, " "), ("q", 3, 4, "Desert", "Gulls", 181.0, TWO)
    )
    got = catalog.rank(records, table(spark, QUERY, ("q", "Gulls", "Harbour", 180.0, 2))).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 1] and got[0]["score"] == pytest.approx(0.56 + 0.24 + 0.15 * (1 - 1 / 14.4) + 0.05)


def test_synced_lyrics_have_a_status(spark):
    records = table(
        spark, RECORDS,
        *[
            (j, 0, 1, t, a, 180.0, TWO) for j, t,
            a in (("exact", "Harbour", "Gulls"), ("near", "Harbour", "The Gulls"), ("unnamed", None, "Gulls"), ("blank", "Harbour", "Gulls"))
        ]
    )
    queries = table(
        spark, QUERY,
        *[(j, a, "Harbour", 180.0, 2) for j, a in (("exact", "Gulls"), ("near", "Gulls"), ("unnamed", "Gulls"), ("blank", " "), ("lost", "Gulls"))]
    )
    got = {r["job_id"]: (r["status"], r["lrc_lines"]) for r in catalog.synced_lyrics(records, queries).collect()}
    assert got == {"exact": ("exact", 2), "near": ("auto-matched", 2), "unnamed": ("not found", None), "blank": ("skipped", None), "lost": ("not found", None)}


def test_lookups_that_share_records_find_what_each_finds_alone(spark):
    shelves = [
        ("s", 0, 1, "Harbour", "Gulls", 300.0, TWO), ("s", 1, 2, "Harbour", "Gulls", 181.0, TWO), ("s", 2, 3, "Harbour", "Gulls", 181.0, TWO + " again"),
        ("s", 3, 4, "Harbor", None, 181.0, TWO), ("s", 4, 5, "Harbour", "Gulls", 180.0, " "), ("t", 5, 6, "Harbour", "Terns", None, TWO), ("t", 6, 7, "Desert", "Gulls", 180.0, TWO)
    ]
    asked = [
        (f"{shelf}{k}", shelf, artist, title, d, n) for shelf in "st" for k, (artist, title, d, n) in enumerate([
            ("Gulls", "Harbour", 180.0, 2), ("Gulls", "Harbour", 180.0, 2), ("Gulls", "Harbour (Live)", None, None), ("x", "Harbour", 181.0, 2), ("Gulls", "Dessert", 180.0, 9)
        ])
    ]
    queries = table(spark, "job_id string, shelf string, artist string, title string, duration double, lines int", *asked)
    records = table(spark, RECORDS, *shelves).withColumnRenamed("job_id", "shelf")
    alone = catalog.synced_lyrics(records.join(queries.select("job_id", "shelf"), "shelf").drop("shelf"), queries.drop("shelf"))
    got = sorted(map(tuple, catalog.synced_lyrics(records, queries, "shelf").collect()), key=str)
    assert got == sorted(map(tuple, alone.collect()), key=str) and {r[1] for r in got} >= {"exact", "not found"}
    assert {r[0]: r[-1] for r in got}["s0"] == TWO


def test_completion_asks_the_description_first(spark):
    inputs = table(
        spark, "job_id string, artist string, title string", ("same", "Gulls", "Harbour"), ("other", "gul", "harb"), ("none", "x", "y"),
        ("unsure", "Gulls", "Harbour")
    )
    detected = table(
        spark, "job_id string, artist string, title string, duration double", ("same", "Gulls", "Harbour (Official Video)", 180.0),
        ("other", "Gulls", "Harbour", 180.0), ("unsure", "Gulls", "Harbor", 400.0)
    )
    assert sorted((r["job_id"], r["source"]) for r in catalog.lookups(inputs, detected).collect()) == [
        ("none", "input"), ("other", "description"), ("other", "input"), ("same", "input"), ("unsure", "description"), ("unsure", "input")
    ]
    rows = [("same", "input"), ("other", "description"), ("unsure", "description"), ("unsure", "input")]
    records = table(spark, "source string, " + RECORDS, *[(s, j, 0, 1, "Harbour", "Gulls", 180.0, TWO) for j, s in rows])
    got = {r["job_id"]: (r["artist"], r["title"], r["source"]) for r in catalog.completed(inputs, detected, records).collect()}
    assert got == {
        "same": ("Gulls", "Harbour", "input"), "other": ("Gulls", "Harbour", "description"), "none": ("x", "y", None),
        "unsure": ("Gulls", "Harbour", "input")
    }


def test_empty_tables(spark):
    b, c, k = blocks(spark, "x").where("false"), captions(spark, (1, 2)).where("false"), candidates(spark, line_0=[(1, 2, 0.1, 0, "1-6")]).where("false")
    items = stamped(spark, "")
    for df in (
        items, timeline.even_spacing(b), align.align_to_lrc(b, items), align.align_to_segments(b, items),
        consensus.refine(c.withColumn("duration", F.lit(9.0)), k), timeline.violations(c)
    ):
        assert df.count() == 0


def test_searches_are_dealt_by_jobs(spark):
    blocks = spark.createDataFrame([(str(j), 0, "one two", "one two", 60.0) for j in range(9)], "job_id string, idx int, text string, sync_text string, duration double")
    heard = spark.createDataFrame([(str(j), 0, 1.0, 2.0, "one two") for j in range(9)], "job_id string, idx int, start double, end double, text string")
    for found in (align.transcript_paths(blocks, heard), align.group_paths(blocks, heard), align.choose_lines(blocks, heard)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression [job_id")
    assert len(align.transcript_paths(blocks, heard).collect()) == 9
