"""Every registered query of the timeline engine against its SQL, and properties of those without."""

import difflib
import itertools
import re
from functools import cache

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.operators import timeline, timemap
from strandline.plans import registry
from strandline.plans.inputs import read
from strandline.plans.registry import ORACLE, QUERIES
from strandline.sources import scans
from tests.test_paths import key, ratio
from tests.test_search import brute_lookup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "documents", "conversations", "embeddings", "lineitem", "orders", "part", "customer", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cells(df):
    df = df[sorted(df.columns)]
    one = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    show = lambda v: str([one(float(x)) for x in v]) if hasattr(v, "__len__") and not isinstance(v, str) else one(v)
    return sorted(tuple(show(v) for v in r) for r in df.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, name):
    a, b = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    num = lambda df: df.apply(lambda c: c.astype(float) if str(c.dtype).lower().startswith(("int", "float", "uint")) else c)
    assert cells(num(a)) == cells(num(b))


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SF).collect()]


def turns(spark):
    """job_id -> its turns in order."""
    out: dict = {}
    for r in read(spark, SF, "turns").orderBy("job_id", "idx").collect():
        out.setdefault(r["job_id"], []).append(r)
    return out


def test_text_similarity(spark):
    known = turns(spark)
    got = {(r["job_id"], r["idx"]): r["similarity"] for r in rows(spark, "text_similarity")}
    want = {(j, a["idx"]): ratio(a["text"], b["text"]) for j, own in known.items() for a, b in itertools.pairwise(own)}
    assert got == pytest.approx(want, abs=1e-6)


def test_adaptive_lines(spark):
    known, got = turns(spark), {(r["job_id"], r["idx"]): r["sync_text"] for r in rows(spark, "adaptive_lines")}
    for j, own in known.items():
        heard = [r["sync_text"] for r in own if r["role"] == "assistant"]
        runs = [" ".join(heard[i:k]) for i in range(len(heard)) for k in range(i + 1, min(i + 3, len(heard)) + 1)]
        for r in own:
            if r["role"] != "user":
                continue
            lines = [x.strip() for x in r["text"].split("\n") if x.strip()]
            lines += [r["sync_text"]] * (r["sync_text"] not in lines)
            best, top = r["sync_text"], max((ratio(r["sync_text"], x) for x in runs), default=0)
            for line in lines if runs else []:
                score = max(ratio(line, x) for x in runs)
                if score > top + 0.03:
                    best, top = line, score
            assert got[j, r["idx"]] == best


def test_transcript_align(spark):
    """The score is that of the chosen run of segments, and no other way through a job's segments gains more."""
    known, got = turns(spark), {}
    for r in sorted(rows(spark, "transcript_align"), key=lambda r: (r["job_id"], r["idx"])):
        got.setdefault(r["job_id"], []).append(r)
    for j, own in known.items():
        asked, heard = ([r["sync_text"] for r in own if r["role"] == role] for role in ("user", "assistant"))
        m = len(heard)
        score = cache(lambda i, a, b, asked=asked, heard=heard: ratio(asked[i], " ".join(heard[a:b])))
        gain = lambda i, a, b, score=score: score(i, a, b) - min(0.18, abs((b - a) * 4 - 1.5 - 3.2) * 0.015)

        @cache
        def best(i, a, asked=asked, m=m, gain=gain):
            return -0.03 * (m - a) if i == len(asked) else max([
                best(i + 1, a) - 0.18, *(gain(i, a, b) + best(i + 1, b) for b in range(a + 1, min(m, a + 6) + 1))
            ])

        at, total = 0, 0.0
        for i, r in enumerate(got[j]):
            ends = [b for b in range(at, min(m, at + 6) + 1) if (r["score"] == 0 and b == at) or (b > at and abs(score(i, at, b) - r["score"]) < 1e-6)]
            step = max(ends, key=lambda b, i=i, at=at: (gain(i, at, b) if b > at else -0.18) + best(i + 1, b))
            total += gain(i, at, step) if step > at else -0.18
            assert step == at or r["start"] >= 4.0 * at + 1
            at = step
        assert total - 0.03 * (m - at) == pytest.approx(best(0, 0), abs=1e-5)
        assert all(b["start"] >= a["end"] - 1e-6 or b["start"] == pytest.approx(a["end"] + 0.03) for a, b in itertools.pairwise(got[j]))


def test_lrc_group_align(spark):
    """Stamped lines are the turns' own first sentences, so each block that has one is on it."""
    known, items = turns(spark), {}
    for r in scans.lrc_items(read(spark, SF, "lyrics")).collect():
        items.setdefault(r["job_id"], []).append(r)
    for r in rows(spark, "lrc_group_align"):
        own = next(x for x in known[r["job_id"]] if x["idx"] == r["idx"])
        assert r["text"] == own["text"] and r["score"] == pytest.approx(
            ratio(own["sync_text"], r["sync_text"]), abs=1e-6
        ) and r["lrc_count"] == len(items[r["job_id"]])
        twin = [x for x in items[r["job_id"]] if x["text"] == own["sync_text"].replace("\n", " ").strip()]
        assert not twin or r["score"] < 1 or any(x["start"] - 1e-6 <= r["start"] <= x["end"] + 1e-6 for x in twin)  # two blocks may share a line
    assert sum(r["score"] == 1 for r in rows(spark, "lrc_group_align")) >= 0.6 * sum(map(len, items.values()))


def test_near_duplicate_trim(spark):
    known = turns(spark)
    for r in rows(spark, "near_duplicate_trim"):
        text = "\n".join(x["text"] for x in known[r["job_id"]])
        doubled = int(r["job_id"]) % 2 == 0 and len(key(text)) >= 120
        assert (r["text"], r["removed"]) == ((text.rstrip(), True) if doubled and r["removed"] else (
            text if not int(r["job_id"]) % 2 == 0 else text + "\n" + text, False
        ))
        assert r["removed"] or not doubled


def test_catalog_rank_top1(spark):
    records, got = {}, {r["job_id"]: r for r in rows(spark, "catalog_rank_top1")}
    for r in read(spark, SF, "records").orderBy("seq").collect():
        own = records.setdefault(r["job_id"], {})
        k = r["id"] if r["id"] is not None else (r["artistName"], r["trackName"], r["albumName"], r["duration"])
        own[k] = r
    parts: dict = {}
    for r in read(spark, SF, "part").orderBy("p_partkey").collect():
        parts.setdefault(str(r["p_size"]), r)
    simple = lambda x: key(re.sub(
        r"\b(?:feat(?:uring)?|ft|official|audio|video|lyrics?|mv)\b.*", " ", re.sub(r"[(\[{].*?[)\]}]", " ", x.lower())
    ))

    def alike(a, b):
        a, b = simple(a), simple(b)
        return 0.0 if not a or not b else min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()

    for job, own in records.items():
        asked, best = parts[job], []
        for r in own.values():
            if not r["syncedLyrics"].strip():
                continue
            title, artist = alike(asked["p_name"], r["trackName"]), alike(asked["p_brand"], r["artistName"])
            length = max(0.0, 1 - abs(r["duration"] - 201) / max(12.0, 201 * 0.08))
            if title < 0.42 or (artist < 0.2 and title < 0.82 and not (title >= 0.58 and length >= 0.7)):
                continue
            best.append(0.56 * title + 0.24 * artist + 0.15 * length + 0.05)
        assert (job in got) == bool(best)
        assert not best or got[job]["score"] == pytest.approx(max(best), abs=1e-6)


def test_warped_captions(spark):
    axis: dict = {}
    for r in timemap.time_axis(read(spark, SF, "axis")).orderBy("ref_t").collect():
        axis.setdefault(r["job_id"], []).append((r["ref_t"], r["perf_t"]))
    got, before = {}, {}
    for r in sorted(rows(spark, "warped_captions"), key=lambda r: (r["job_id"], r["idx"])):
        got.setdefault(r["job_id"], []).append(r)
    for r in sorted(rows(spark, "even_spacing"), key=lambda r: (r["job_id"], r["idx"])):
        before.setdefault(r["job_id"], []).append(r)
    for job, own in before.items():
        to = lambda t, job=job: min(60.0, max(0.0, float(np.interp(t, *zip(*axis[job], strict=True))) if job in axis else t))
        starts: list = []
        for r in own:
            starts.append(min(60.0, to(r["start"]) if not starts else max(to(r["start"]), starts[-1] + 0.12)))
        ends = [min(60.0, max(s + 0.2, to(r["end"]))) for s, r in zip(starts, own, strict=True)]
        ends = [min(e, starts[i + 1] - 0.04) if i + 1 < len(starts) else e for i, e in enumerate(ends)]
        assert [(r["start"], r["end"]) for r in got[job]] == [
            (pytest.approx(s, abs=1e-5), pytest.approx(e, abs=1e-5)) for s, e in zip(starts, ends, strict=True)
        ]


def recordings(spark):
    out: dict = {}
    for r in registry.maps._recordings(spark, SF).orderBy("frame").collect():
        out.setdefault(r["job_id"], {"ref": [], "perf": []})[r["side"]].append(r["chroma"])
    return {j: [np.array(x[s]) for s in ("ref", "perf")] for j, x in out.items()}


@pytest.mark.parametrize("name", ["warping_paths", "multiscale_paths"])
def test_maps_are_medians_of_paths(spark, name):
    got: dict = {}
    for r in rows(spark, name):
        got.setdefault(r["job_id"], []).append((r["ref_t"], r["perf_t"]))
    for job, (a, b) in recordings(spark).items():
        path = timemap.banded_path(
            timemap.smooth(a, 41, 1), timemap.smooth(b, 41, 1)
        ) if name == "warping_paths" else timemap.rising(timemap.multiscale_path(timemap.unit(a), timemap.unit(b), a, b))
        at: dict = {}
        for i, j in path.tolist():
            at.setdefault(i, []).append(j)
        want = list(zip([i / 10 for i in sorted(at)], np.maximum.accumulate([np.median(at[i]) / 10 for i in sorted(at)]).tolist(), strict=True))
        assert sorted(got.get(job, [])) == [(pytest.approx(x), pytest.approx(y)) for x, y in want]


def test_time_map_choice(spark):
    """Every job with its verdict; the chosen map is the one that its costs and spreads choose."""
    got: dict = {}
    for r in rows(spark, "time_map_choice"):
        got.setdefault(r["job_id"], []).append(r)
    assert set(got) == set(recordings(spark))
    for own in got.values():
        r = own[0]
        ok = [x is not None and x <= 12 for x in (r["multiscale_spread"], r["legacy_spread"])]
        want = "invalid" if r["error"] in ("too short", "lengths differ too much") or not any(ok) else "multiscale" if ok[0] and (
            not ok[1] or r["multiscale_cost"] <= r["legacy_cost"] + 0.025
        ) else "legacy"
        assert r["method"] == want and (want == "invalid") == (r["ref_t"] is None) == (r["error"] is not None)
        if want != "invalid":
            offsets = [x["perf_t"] - x["ref_t"] for x in own]
            assert np.percentile(offsets, 95) - np.percentile(offsets, 5) == pytest.approx(r[f"{want}_spread"], abs=1e-5)


def test_mode_dispatch_aligned(spark):
    """Every job comes out, with all its lines in order and no errors but those that it must have."""
    known, got = turns(spark), {}
    for r in rows(spark, "mode_dispatch_aligned"):
        got.setdefault(r["job_id"], []).append(r)
    assert set(got) == set(known)
    for job, own in got.items():
        lines = [x["sync_text"].replace("\n", " ").strip() for x in known[job]]
        if own[0]["error"]:
            assert len(own) == 1 and own[0]["mode"] == "Reference audio DTW" and "caption" in own[0]["error"]
            continue
        own.sort(key=lambda r: r["idx"])
        assert [r["text"] for r in own] == [x for x in lines if x] and all(0 <= r["start"] <= r["end"] <= 60 for r in own)
        assert {r["method"] for r in own} == {"stamped lyrics" if own[0]["mode"] != "Whisper fuzzy match" else "transcript"}


def test_reference_transcript(spark):
    known, got = turns(spark), {}
    for r in rows(spark, "reference_transcript"):
        got.setdefault(r["job_id"], set()).add(r["method"])
    assert got == {j: {"transcript" if int(j) % 2 == 0 else "activity"} for j in known}


def test_lookups(spark):
    status = {r["job_id"]: r for r in rows(spark, "synced_lyrics_lookup")}
    for job, r in status.items():
        assert (r["status"] == "skipped") == (int(job) % 4 == 0) and (r["score"] is None) == (
            r["status"] in ("skipped", "not found")
        ) and (r["lrc_lines"] == 2) == (r["score"] is not None)
        assert r["status"] != "exact" or r["score"] > 0.9
    assert {r["status"] for r in status.values()} >= {"skipped", "auto-matched"}
    done = {r["job_id"]: r for r in rows(spark, "field_completion")}
    assert set(done) == set(status) and all(
        r["source"] in (None, "input", "description") and (r["score"] is None) == (r["source"] is None) for r in done.values()
    )
    assert all(r["source"] != "description" for j, r in done.items() if int(j) % 2)


def test_refinement_rows(spark):
    found = {(r["job_id"], r["idx"]): r for r in rows(spark, "refinement_rows") if r["idx"] is not None}
    failed = {(r["job_id"], r["source"]): r["error"] for r in rows(spark, "refinement_rows") if r["idx"] is None}
    want: dict = {}
    for r in rows(spark, "forced_candidates"):
        want.setdefault((r["job_id"], r["idx"]), []).append((r["cand_idx"], r["source"]))
    assert {k: [c["source"] for c in r["candidates"] or []] for k, r in found.items()} == {k: [s for _, s in sorted(want.get(k, []))] for k in found}
    assert failed == {(r["job_id"], r["source"]): r["error"] for r in rows(spark, "forced_errors")}
    assert all(r["accepted"] or abs(r["dtw_start"] - r["refined_start"]) < 30 for r in found.values()) and any(r["accepted"] for r in found.values())


def test_catalog_lookup(spark):
    """Every query against a scan of the whole catalog."""
    from strandline.operators import catalog

    asked, records = ([r.asDict() for r in read(spark, SF, name).collect()] for name in ("wanted", "catalog"))
    attempts = [r.asDict() for r in catalog.search_attempts(read(spark, SF, "wanted")).collect()]
    want = brute_lookup({"queries": asked, "attempts": attempts}, records)
    got = {r["job_id"]: (r["status"], r["score"], (r["artistName"], r["trackName"]) if r["score"] is not None else None) for r in rows(spark, "catalog_lookup")}
    assert got == want and sum(v[0] == "exact" for v in want.values()) > 30


def test_all_queries_are_tested():
    import inspect
    import sys

    source = inspect.getsource(sys.modules[__name__])
    assert all(f'"{name}"' in source for name in set(QUERIES) - set(ORACLE))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 90), min_size=1, max_size=30))
def test_minimum_gap_is_the_loop(raw):
    best, loop, closed = float("-inf"), [], []
    for i, r in enumerate(raw):
        loop.append(min(100.0, r if not loop else max(r, loop[-1] + 0.12)))
        best = max(best, r - 0.12 * i)
        closed.append(min(100.0, best + 0.12 * i))
    assert loop == pytest.approx(closed, abs=1e-9)


def test_wav_frames_and_activity(spark, tmp_path):
    import wave

    from strandline.operators import activity

    rate = 1000
    x = np.zeros(10 * rate)
    x[3 * rate : 6 * rate] = 0.5 * np.sin(np.arange(3 * rate))
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    frames = scans.wav_frames(spark.read.format("binaryFile").load(str(tmp_path)), rate=None)
    good = (tmp_path / "a.wav").read_bytes()
    (tmp_path / "cut.wav").write_bytes(good[:5001])
    (tmp_path / "text.wav").write_bytes(b"no sound")
    with wave.open(str(tmp_path / "bytes.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(rate)
        w.writeframes(bytes(100))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    bad = {r["job_id"].rpartition("/")[2]: r["error"] for r in scans.unreadable(files).collect()}
    assert set(bad) == {"cut.wav", "text.wav", "bytes.wav"} and bad["cut.wav"] == "cut off" and "16-bit" in bad["bytes.wav"]
    assert timemap.music_features(files).select("job_id").distinct().count() == 1
    frames = scans.wav_frames(files, rate=None)
    (got,) = activity.activity(frames).collect()
    assert 2.5 < got["start"] < 3.1 and 5.9 < got["end"] < 6.6


def test_session_stream(spark, tmp_path):
    from strandline.streaming.spells import sessions

    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(src)
    stream = sessions(spark.readStream.schema(events.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("spells").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {tuple(r) for r in sessions(events).collect()}
    got = {tuple(r) for r in spark.table("spells").collect()}
    assert got and got <= batch


def test_validation_reports_counts(spark):
    c = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 0.5, 0.4)], "job_id string, idx int, start double, end double")
    n = spark.createDataFrame([("a", 3), ("b", 0)], "job_id string, n int")
    assert sorted((r["idx"], r["reason"]) for r in timeline.violations(c, n).collect()) == [(-1, "another count"), (1, "end is not after start")]


@pytest.mark.parametrize("name", ["refinement_rows", "forced_candidates", "forced_errors"])
def test_forced_windows_are_joined_by_shuffles(spark, name):
    """Windows, captions and results grow with the jobs, so none may go to the driver whole, however small its columns look."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_keys_replace_once(spark):
    """Both keys come from one replacement, which is computed once a row."""
    found = set(re.findall(r"regexp_replace\(lower\([^)]*\)[^)]*\)", _optimized(QUERIES["text_keys"](spark, SF))))
    assert len(found) == 1


def test_search_attempts_parse_and_cut_once(spark):
    """A payload is parsed once for the filter and once for the attempts, and what they are made of isn't made anew for each of them."""
    plan = _optimized(QUERIES["search_attempts"](spark, SF))
    assert plan.count("from_json") <= 2
    assert plan.count("regexp_extract_all") <= 2
