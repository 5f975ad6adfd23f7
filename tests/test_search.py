"""Catalog search by the inverted index against a scan of all pairs."""

import difflib
import math
import random
import re
from functools import cache

import pytest
from pyspark.sql import functions as F

from strandline.functions.text import ALPHABET
from strandline.operators import catalog, search

RECORD = "seq long, id long, trackName string, artistName string, albumName string, duration double, syncedLyrics string, job_id string, word int"
LRC = "[00:01.00] la\n[00:05.00] la"


@cache
def words_of(name):
    key = re.sub(f"[^{ALPHABET}]+", " ", (name or "").lower()).strip()
    out = re.findall("[0-9a-z]+", key)
    for run in re.findall(f"[{ALPHABET.removeprefix('0-9a-z')}]+", key):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return set(out)


@cache
def track(name):
    x = re.sub(r"[(\[{].*?[)\]}]", " ", (name or "").casefold(), flags=re.S)
    x = re.sub(r"\b(?:feat(?:uring)?|ft|official|audio|video|lyrics?|mv)\b.*", " ", x)
    return re.sub(f"[^{ALPHABET}]+", "", x)


def standing(records):
    found = {}
    for r in sorted(records, key=lambda r: r["seq"]):
        names = [r["artistName"] or "", r["trackName"] or "", r["albumName"] or ""]
        duration = "" if r["duration"] is None else str(r["duration"])
        found[str(r["id"]) if r["id"] is not None else "\x1f".join(["-", *names, duration])] = r
    return found


def scan(attempts, records, share=0.6):
    """Every attempt with every record."""
    out = set()
    for a in attempts:
        free = a["q"] is not None
        name = a["q"] if free else a["track_name"]
        own, who = words_of(name), None if a["artist_name"] is None else words_of(a["artist_name"])
        for key, r in standing(records).items():
            theirs = words_of(" ".join(x for x in (r["trackName"], r["artistName"], r["albumName"]) if x is not None)) if free else words_of(r["trackName"])
            shared = len(own & theirs)
            same = not free and track(name) != "" and track(name) == track(r["trackName"])
            ok = same or shared >= max(1, math.ceil(len(own) * share))
            if who is not None:
                artist = words_of(r["artistName"])
                ok &= len(who & artist) >= max(1, math.ceil(len(who) * share)) or (
                    track(a["artist_name"]) != "" and track(a["artist_name"]) == track(r["artistName"])
                )
            if ok:
                out.add((a["job_id"], a["pos"], key, shared))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    words = ["love", "the", "night", "song", "don't", "夜に駆ける", "夢", "of", "blue", "rain", "a"] + [f"w{i}" for i in range(40)]
    title = lambda: " ".join(rnd.choice(words[: rnd.choice([4, 11, 51])]) for _ in range(rnd.randrange(1, 5)))
    rows = [(
        k, None if k % 5 == 0 else k % 160, title() + rnd.choice(["", " (feat. X)", " Official Video"]),
        rnd.choice(["Ann", "The Bees", "初音", None]), None, 200.0, LRC if k % 4 else " ", None, 1
    ) for k in range(220)]
    rows += [
        (300, 900, "Dont Stop", "Ann", None, 100.0, LRC, None, 1), (301, 901, None, None, None, None, LRC, "j1", 1),
        (302, None, "", "", "", None, LRC, None, 1), (303, 902, "!!!", "Ann", None, 5.0, LRC, None, 1)
    ]
    records = spark.createDataFrame(rows, RECORD)
    asked = [(
        f"j{k}", rnd.choice(["ann", "Bees", " ", "初音ミク", "nobody"]),
        (rows[rnd.randrange(220)][2] if k % 2 else title()) + rnd.choice(["", " | live", " [夢]"]), 201.0, 2
    ) for k in range(60)]
    asked += [
        ("same", "Ann", "don't STOP (Official Audio)", None, None), ("blank", "Ann", " ", None, None), ("none", None, None, None, None),
        ("marks", "Ann", "!!!", None, None)
    ]
    return records, spark.createDataFrame(asked, "job_id string, artist string, title string, duration double, lines int")


@pytest.mark.parametrize("a_way", [4096, 7])
def test_search_finds_what_a_scan_finds(spark, tables, monkeypatch, a_way):
    monkeypatch.setattr(search, "ROWS_A_WAY", a_way)
    records, asked = tables
    attempts = catalog.search_attempts(asked)
    index = search.catalog_index(records)
    if a_way == 7:  # hot lists lie in many salts
        assert index.words.agg(F.max("ways")).first()[0] > 10 and index.postings.where("word = 'the'").select("salt").distinct().count() > 5
    got = [tuple(r) for r in search.search(attempts, index).select("job_id", "pos", "key", "shared").collect()]
    want = scan([r.asDict() for r in attempts.collect()], [r.asDict() for r in records.collect()])
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert ("same", 0, "900", 1) in want  # an equal key, whatever its words


def test_order_of_found_records(spark, tables):
    records, asked = tables
    index = search.catalog_index(records)
    hits = scan([r.asDict() for r in catalog.search_attempts(asked).collect()], [r.asDict() for r in records.collect()])
    best = {}
    for job, pos, key, shared in hits:
        best[job, key] = min(best.get((job, key), (9, 0)), (pos, -shared))
    got = {}
    for r in search.search_records(asked, index).collect():
        key = next(iter(standing([r.asDict() | {"seq": 0}])))
        got.setdefault(r["job_id"], []).append((r["seq"], key))
    for job, own in got.items():
        assert [k for _, k in sorted(own)] == [k for _, _, k in sorted((*v, k) for (j, k), v in best.items() if j == job)]
        assert sorted(s for s, _ in own) == list(range(len(own)))
    assert {j for j, _ in best} == set(got)


def test_search_of_empty_tables(spark, tables):
    records, asked = tables
    index = search.catalog_index(records.limit(0))
    assert search.search_records(asked, index).count() == 0
    assert search.search_records(asked.limit(0), search.catalog_index(records)).count() == 0


def similar(a, b):
    x, y = track(a), track(b)
    if not x or not y:
        return 0.0
    return min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else difflib.SequenceMatcher(None, x, y).ratio()


def brute_lookup(asked, records):
    """(status, score, names) of each query, from a scan of the whole catalog."""
    tries, known = {}, standing(records)
    for a in asked["attempts"]:
        tries.setdefault(a["job_id"], []).append(a)
    out = {}
    for q in asked["queries"]:
        if not (q["artist"] or "").strip() or not (q["title"] or "").strip():
            out[q["job_id"]] = ("skipped", None, None)
            continue
        order = {}
        for _, pos, key, shared in scan(tries.get(q["job_id"], []), records):
            order[key] = min(order.get(key, (9, 0)), (pos, -shared))
        best = None
        for key in sorted(order, key=lambda k: (*order[k], k)):
            r = known[key]
            if not (r["syncedLyrics"] or "").strip():
                continue
            t, w = similar(q["title"], r["trackName"] or ""), similar(q["artist"], r["artistName"] or "")
            d = 0.5
            if (q["duration"] or 0) > 0 and (r["duration"] or 0) > 0:
                d = max(0.0, 1 - abs(r["duration"] - q["duration"]) / max(12.0, q["duration"] * 0.08))
            if t < 0.42 or (w < 0.2 and t < 0.82 and not (q["duration"] is not None and t >= 0.58 and d >= 0.7)):
                continue
            n = r["syncedLyrics"].count("[")
            line = max(0.0, 1 - abs(n - q["lines"]) / max(n, q["lines"])) if q["lines"] else 0.5
            score = 0.56 * t + 0.24 * w + 0.15 * d + 0.05 * line
            if best is None or score > best[0] + 1e-12:
                best = (score, r)
        if best is None:
            out[q["job_id"]] = ("not found", None, None)
        else:
            names = best[1]["artistName"] or q["artist"], best[1]["trackName"] or q["title"]
            exact = similar(q["artist"], names[0]) >= 0.98 and similar(q["title"], names[1]) >= 0.98
            out[q["job_id"]] = ("exact" if exact else "auto-matched", pytest.approx(best[0], abs=1e-5), names)
    return out


def test_lookup_by_scan(spark, tables):
    records, asked = tables
    rows = catalog.synced_lyrics(search.search_records(asked, search.catalog_index(records)), asked).collect()
    want = brute_lookup(
        {"queries": [r.asDict() for r in asked.collect()], "attempts": [r.asDict() for r in catalog.search_attempts(asked).collect()]},
        [r.asDict() for r in records.collect()]
    )
    assert {r["job_id"]: (r["status"], r["score"], (r["artistName"], r["trackName"]) if r["score"] is not None else None) for r in rows} == want
    assert {v[0] for v in want.values()} == {"skipped", "not found", "exact", "auto-matched"}



@pytest.mark.parametrize("short", [4096, 0])
def test_best_records_keep_few_pairs(spark, tables, monkeypatch, short):
    """The best record of each query is the one of a scan, though most of the found pairs never leave the join."""
    records, asked = tables
    kept, plain = [], search.written

    def counted(df, tag):
        out = plain(df, tag)
        if tag == "near":
            kept.append(out.count())
        return out

    monkeypatch.setattr(search, "written", counted)
    monkeypatch.setattr(search, "SHORT", short)
    best = search.best_records(asked.where(~catalog.unasked()), search.catalog_index(records, stamped=True))
    rows = catalog.told(best, asked).collect()
    attempts = [r.asDict() for r in catalog.search_attempts(asked).collect()]
    want = brute_lookup({"queries": [r.asDict() for r in asked.collect()], "attempts": attempts}, [r.asDict() for r in records.collect()])
    assert {r["job_id"]: (r["status"], r["score"], (r["artistName"], r["trackName"]) if r["score"] is not None else None) for r in rows} == want
    found = search.search_records(asked, search.catalog_index(records)).count()
    assert short == 0 or kept[0] * 2 < found


def test_titles_are_compared_after_equal_pairs_went(spark, monkeypatch):
    plans, real = {}, catalog.written
    monkeypatch.setattr(catalog, "written", lambda df, tag: plans.update({tag: df._jdf.queryExecution().optimizedPlan().toString()}) or real(df, tag))
    queries = spark.createDataFrame([("1", "s", "who", "one two", 200.0, 2), ("2", "s", "who", "zzzz", 200.0, 2)], "job_id string, shelf string, artist string, title string, duration double, lines int")
    records = spark.createDataFrame([("s", 1, "one two three", "who", 200.0, "[00:01.00] x")], "shelf string, seq long, trackName string, artistName string, duration double, syncedLyrics string")
    assert [r["job_id"] for r in catalog.shared_best(records, queries).collect()] == ["1"]
    assert plans["titles"].count("ArrowEvalPython") == 1 and plans["titles"].index("ArrowEvalPython") < plans["titles"].index("Aggregate")


def test_bits_and_bags_bound_what_texts_share(spark):
    """Letters in common bound a similarity from above, long and foreign names included, and no found pair lacks bits."""
    draw = random.Random(5)
    names = ["", "a", "z" * 140, "ab" * 90, "もしも星", "x1 y2 1 1", *("".join(draw.choices("abcde 19", k=draw.randint(1, 40))) for _ in range(20))]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "artist string, title string")
    side = lambda c: search._with_facts(rows.select("artist", "title").withColumn("n", F.col(c)), "n", "n").select(*rows.columns, F.col("facts").alias("f"))
    pairs = side("artist").withColumnRenamed("f", "asker").join(side("title").withColumnRenamed("f", "about"), ["artist", "title"])
    pairs = search._flat(search._flat(pairs, "asker"), "about").select("asker.track", "about.track", search._at_most("track"), search._in_common("track")).collect()
    assert len(pairs) == len(rows.collect())
    for a, b, most, common in pairs:
        ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0
        assert most >= ratio - 1e-12 and common <= min(len(a), len(b))
    sets = [draw.sample([f"w{k}" for k in range(300)], draw.randint(1, 90)) for _ in range(60)]
    words = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<string>, b array<string>")
    few = F.size("a") - F.bit_count(search._sign("a"))
    got = words.select(F.bit_count(search._sign("a").bitwiseAND(search._sign("b"))) + few >= F.size(F.array_intersect("a", "b"))).collect()
    assert all(r[0] for r in got)


def test_a_query_of_frequent_words_gets_a_floor(spark, monkeypatch):
    """Where all lists are longer than SHORT, one salt of a list still gives a floor, and far records don't leave the join."""
    kept, plain = [], search.written
    monkeypatch.setattr(search, "written", lambda df, tag: (lambda out: kept.append(out.count()) or out if tag == "near" else out)(plain(df, tag)))
    monkeypatch.setattr(search, "SHORT", 8)
    monkeypatch.setattr(search, "ROWS_A_WAY", 8)
    row = lambda k: (k, k, "one two", "who", "album", 60.0 + 20 * (k % 50), LRC, "1", 0)
    records = spark.createDataFrame([row(k) for k in range(200)], RECORD)
    asked = spark.createDataFrame([(str(j), "who", "one two", 60.0 + 20 * j, 2) for j in range(50)], "job_id string, artist string, title string, duration double, lines int")
    best = search.best_records(asked, search.catalog_index(records.drop("job_id", "word"), stamped=True)).collect()
    assert len(best) == 50 and all(r["score"] > 0.8 for r in best)
    assert kept[0] < 50 * 200
