"""Sequential rules over blocks against the plain loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import consensus, scan, timeline

INF = float("inf")


def plain(rules):
    out, last = [], -INF
    for low, first, high, second, shift, cap in rules:
        last = first if last < low else second if last < high else min(cap, last + shift)
        out.append(last)
    return out


def rules(rnd, n, cap=INF):
    """Monotone rules: each number lies between those before and after it."""
    out, at = [], 0.0
    for _ in range(n):
        at += rnd.choice([0.0, 0.05, 0.5, 2.0])
        shift = rnd.choice([0.12, 0.83])
        low = at + rnd.choice([-3.0, -0.3, 0.0, 1.0])
        high = low + rnd.choice([0.0, 0.0, 0.4, 2.0])
        first = min(cap, low + rnd.choice([0.0, shift]))
        second = min(cap, max(first, high + rnd.choice([0.0, shift]) if high > low else first))
        out.append((low, first, high, second, shift, cap))
    return out


@pytest.mark.parametrize("block, cap", [(2, INF), (3, 9.0), (5, 25.0), (256, INF)])
def test_states_are_those_of_the_loop(spark, monkeypatch, block, cap):
    monkeypatch.setattr(scan, "BLOCK", block)
    rnd = random.Random(block)
    jobs = {f"j{k}": rules(rnd, rnd.choice([1, 2, 7, 30, 45]), cap) for k in range(25)}
    rows = [(j, i, *r) for j, own in jobs.items() for i, r in enumerate(own)]
    df = spark.createDataFrame(rows, "job_id string, idx int, low double, first double, high double, second double, shift double, cap double").repartition(3)
    as_rule = lambda r: scan.rule(r["low"], r["first"], r["high"], r["second"], r["shift"], r["cap"])
    got = {}
    for r in scan.states(df, lambda state, r: scan.applied(r, state), as_rule).orderBy("job_id", "idx").collect():
        got.setdefault(r["job_id"], []).append((r["before"], r["at"], r["next"]))
    for j, own in jobs.items():
        want = plain(own)
        assert [x[1] for x in got[j]] == pytest.approx(want) and [x[0] for x in got[j]] == pytest.approx([-INF, *want[:-1]])
        assert got[j][-1][2] is None and [x[2] for x in got[j][:-1]] == pytest.approx(want[1:])


def test_composition_is_the_rules_in_turn(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(60):
        a, b, c = rules(rnd, 3, rnd.choice([INF, 4.0]))
        rows += [(k, a, b, c, x) for x in (-INF, *(rnd.uniform(-4, 8) for _ in range(12)))]
    three = "low double, first double, high double, second double, shift double, cap double"
    df = spark.createDataFrame(rows, ", ".join(["k int", *(f"{n} struct<{three.replace(' double', ': double')}>" for n in "abc"), "x double"]))
    df = df.withColumn("rules", F.array("a", "b", "c")).withColumn("whole", F.aggregate("rules", scan.rule(*[F.lit(-INF)] * 4, 0.0), scan.composed))
    turn = F.aggregate("rules", F.col("x"), lambda state, f: scan.applied(f, state))
    for r in df.select("x", scan.applied(F.col("whole"), F.col("x")).alias("got"), turn.alias("want")).collect():
        assert r["got"] == pytest.approx(r["want"]), r


@pytest.mark.parametrize("block", [2, 4, 256])
def test_refined_starts_are_those_of_the_loop(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    rnd = random.Random(3)
    captions, candidates, want = [], [], {}
    for job in ("a", "b", "two"):
        n, t = 2 if job == "two" else 25, 0.0
        own = []
        for i in range(n):
            t += rnd.choice([0.05, 0.4, 2.0])
            own.append(t)
            captions.append((job, i, t, t + 1.0, 60.0))
            if rnd.random() < 0.7:
                at = t + rnd.uniform(-0.9, 0.9)
                candidates += [(job, i, k, at, at + 1.5, 0.5, 0.0, s) for k, s in enumerate(("1-6", "2-9"))]
        moved = {(j, i): at for j, i, k, at, *_ in candidates if k == 0}
        starts = [moved.get((job, i), s) if n >= 3 else s for i, s in enumerate(own)]
        for i in range(1, n if n >= 3 else 0):
            if starts[i] <= starts[i - 1] + 0.12:
                starts[i] = own[i]
            if starts[i] <= starts[i - 1] + 0.12:
                starts[i] = starts[i - 1] + 0.12
        want[job] = [min(60.0, max(0.0, s)) for s in starts]
    c = spark.createDataFrame(captions, "job_id string, idx int, start double, end double, duration double")
    k = spark.createDataFrame(
        candidates,
        "job_id string, idx int, cand_idx int, start double, end double, confidence double, collapsed_ratio double, source string"
    )
    got = {}
    for r in consensus.refine(c, k).orderBy("job_id", "idx").collect():
        got.setdefault(r["job_id"], []).append(r["start"])
    assert {j: pytest.approx(v) for j, v in want.items()} == got


@pytest.mark.parametrize("block", [2, 4, 256])
def test_active_places_are_those_of_the_loop(spark, monkeypatch, block):
    monkeypatch.setattr(scan, "BLOCK", block)
    rnd = random.Random(5)
    blocks, intervals, want = [], [], {}
    for job in ("a", "b", "tight", "one"):
        n, duration = (1 if job == "one" else 30), (12.0 if job == "tight" else 80.0)
        spans, t = [], rnd.uniform(0, 3)
        for k in range(4):
            spans.append((t, t + rnd.uniform(0.5, 6)))
            t = spans[-1][1] + rnd.uniform(1, 4)
        blocks += [(job, i, f"t{i}", duration) for i in range(n)]
        intervals += [(job, k, s, e) for k, (s, e) in enumerate(spans)]
        total = sum(e - s for s, e in spans)

        def at(fraction, spans=spans, total=total):
            left = fraction * total
            for s, e in spans:
                if left <= e - s + 1e-9:
                    return s + max(0.0, left)
                left -= e - s
            return spans[-1][1]

        last, out = 0.0, []
        for i in range(n):
            a, b = at(i / n), at((i + 1) / n) - (0.04 if i + 1 < n else 0)
            start = last + 0.03 if a < last else a
            end = min(duration, max(b, start + 0.8))
            if end <= start:
                end = min(duration, start + 0.2)
            out.append((max(0.0, start), end))
            last = end
        want[job] = out
    b = spark.createDataFrame(blocks, "job_id string, idx int, text string, duration double")
    i = spark.createDataFrame(intervals, "job_id string, idx int, start double, end double")
    got = {}
    for r in timeline.place_by_activity(b, i).orderBy("job_id", "idx").collect():
        got.setdefault(r["job_id"], []).append((r["start"], r["end"]))
    for job, own in want.items():
        assert [x for pair in got[job] for x in pair] == pytest.approx([x for pair in own for x in pair]), job


def test_a_long_job_is_many_blocks(spark):
    n = 60_000
    rows = spark.range(n).select(
        F.lit("one").alias("job_id"), F.col("id").cast("int").alias("idx"),
        (F.floor(F.col("id") / 3) * 0.36 + F.col("id") % 3 * 0.01).alias("wish")
    )
    gap = lambda state, r: F.greatest(r["wish"], state + 0.12)
    out = scan.states(rows, gap, lambda r: scan.rule(r["wish"] - 0.12, r["wish"], r["wish"] - 0.12, r["wish"], 0.12))
    got = [r["at"] for r in out.orderBy("idx").select("at").collect()]
    last, want = -math.inf, []
    for k in range(n):
        last = max(k // 3 * 0.36 + k % 3 * 0.01, last + 0.12)
        want.append(last)
    assert got == pytest.approx(want)
    sizes = [r["count"] for r in out.groupBy(F.expr(f"idx div {scan.BLOCK}").alias("block")).count().collect()]
    assert len(sizes) == -(-n // scan.BLOCK) and max(sizes) == scan.BLOCK


@pytest.mark.parametrize("rows", [1, 4, 1 << 16])
def test_neighbours_by_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(timeline, "ROWS", rows)
    rnd = random.Random(rows)
    points = {j: sorted(rnd.sample(range(40), n)) for j, n in (("a", 9), ("b", 1), ("c", 25))} | {"same": [3]}
    probes = [
        (j, rnd.choice([float(rnd.randrange(-3, 45)), rnd.uniform(-3, 45)]), k) for k, j in enumerate(["a", "b", "c", "none"] * 20)
    ] + [("a", None, 90), ("same", 3.0, 91), ("same", 3.0, 92)]
    p = spark.createDataFrame([(j, float(x), x) for j, own in points.items() for x in own], "job_id string, at double, p int")
    q = spark.createDataFrame(probes, "job_id string, at double, row int")
    got = {r["row"]: (r["below"], r["above"]) for r in timeline.neighbours(q, p).collect()}
    want = {}
    for j, at, k in probes:
        own = points.get(j, [])
        below, above = [x for x in own if at is not None and x <= at], [x for x in own if at is None or x > at]
        want[k] = (max(below, default=None), min(above, default=None))
    assert got == want


@pytest.mark.parametrize("rows", [2, 1 << 16])
def test_active_time_by_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(timeline, "ROWS", rows)
    spans = {"a": [(1.0, 2.5), (4.0, 4.0), (4.0, 7.0), (9.0, 9.5)], "flat": [(2.0, 2.0), (3.0, 3.0)]}
    probes = [(j, k / 10 - 0.2) for j in ("a", "flat", "none") for k in range(15)]
    i = spark.createDataFrame([(j, s, e) for j, own in spans.items() for s, e in own], "job_id string, start double, end double")
    got = {(r["job_id"], r["fraction"]): r["t"] for r in timeline.active_time(spark.createDataFrame(probes, "job_id string, fraction double"), i).collect()}
    for j, f in probes:
        own, total = spans.get(j, []), sum(e - s for s, e in spans.get(j, []))
        left, want = min(1.0, max(0.0, f)) * total, (own[-1][1] if own else 0.0)
        if own and total <= 0:
            want = own[0][0]
        elif own:
            for s, e in own:
                if e - s >= left - 1e-9:
                    want = s + max(0.0, left)
                    break
                left -= e - s
        assert got[j, f] == pytest.approx(want), (j, f)


def test_rests_of_means_decide_no_end(spark):
    """The mean of these two ends is a rest more than 0.2: a caption from 0 that ends there is as short as one that ends at 0.2."""
    captions = spark.createDataFrame([("a", i, i * 6.0, i * 6.0 + 3, 60.0) for i in range(3)], "job_id string, idx int, start double, end double, duration double")
    candidates = spark.createDataFrame(
        [("a", 0, 0, -0.3, 0.15, 0.5, 0.0, "1-6"), ("a", 0, 1, -0.3, 0.25000000000000017, 0.5, 0.0, "2-9")],
        "job_id string, idx int, cand_idx int, start double, end double, confidence double, collapsed_ratio double, source string"
    )
    got = consensus.refine(captions, candidates).where("idx = 0").collect()[0]
    assert got["accepted"] and got["end"] == pytest.approx(5.95)


@pytest.mark.parametrize("rows", [1 << 16, 4])
def test_neighbours_go_to_as_many_tasks_as_they_need(spark, monkeypatch, rows):
    """What one task sorts is bounded, however many jobs there are; the neighbours are the same."""
    probes = spark.range(300).selectExpr("cast(id % 30 AS string) AS job_id", "cast(id AS double) AS at", "id AS row")
    points = spark.range(300).selectExpr("cast(id % 30 AS string) AS job_id", "id + 0.5e0 AS at", "id AS p")
    monkeypatch.setattr(timeline, "ROWS", rows)
    plain = {tuple(r) for r in timeline.neighbours(probes, points).collect()}
    monkeypatch.setattr(timeline, "TASK_ROWS", 50)
    out = timeline.neighbours(probes, points)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString() and {tuple(r) for r in out.collect()} == plain and len(plain) == 300
