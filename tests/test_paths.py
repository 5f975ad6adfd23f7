"""Best paths, warping paths and trimmed copies against exhaustive search on small inputs, and the captions made of them."""

import difflib
import itertools
import random
import re
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import similar
from strandline.operators import align, paths, timemap
from strandline.sources import scans


def key(text):
    return re.sub("[^0-9a-z぀-ヿ㐀-鿿가-힣]+", "", text.lower())


def ratio(a, b):
    a, b = key(a), key(b)
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def plain_ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.text("abc", max_size=40), st.text("abc", max_size=40)), max_size=12),
    st.lists(st.tuples(st.text(max_size=30), st.text(max_size=30)), max_size=6)
)
def test_ratios_are_the_librarys(few, many):
    pairs = few + many + [(a, a) for a, _ in few] + [(b, a) for a, b in few]
    got = similar.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [plain_ratio(a, b) for a, b in pairs]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz한글かな漢字"])
def test_ratios_of_long_texts(letters):
    rnd = random.Random(letters)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 60, 198, 199, 200, 201, 202, 300, 420]))) for _ in range(60)]
    texts += [t[:50] + "zz" + t[60:] for t in texts[:20]]  # long, and much alike
    pairs = [(rnd.choice(texts), rnd.choice(texts)) for _ in range(150)] + list(zip(texts[:20], texts[60:], strict=True))
    assert similar.ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [plain_ratio(a, b) for a, b in pairs]
    table = similar.bound(similar.bags(texts), similar.bags(texts))
    bags = similar.bags(texts)
    assert (similar.bound(bags[:30], bags[30:]) == table[:30, 30:]).all()
    assert all(table[i, j] >= plain_ratio(texts[i], texts[j]) - 1e-12 for i, j in [(rnd.randrange(80), rnd.randrange(80)) for _ in range(200)])


def verse(rnd):
    return "".join(rnd.choice("the of and love night rain blue song heart wild river stone".split()) for _ in range(rnd.randrange(0, 8)))


@pytest.mark.parametrize("seed", range(30))
def test_paths_of_few_comparisons_are_the_best(seed):
    """The same paths as of all similarities, ties included."""
    rnd = random.Random(seed)
    blocks, m = [verse(rnd) for _ in range(rnd.randrange(1, 12))], rnd.randrange(1, 12)
    lines = [rnd.choice(blocks) if rnd.random() < 0.5 else verse(rnd) for _ in range(m)] if seed % 3 else [*blocks, verse(rnd)]
    m = len(lines)
    whole = lambda texts, k, n: "".join(texts[k : k + n])
    score = cache(lambda b, bc, i, ic: plain_ratio(whole(blocks, b, bc), whole(lines, i, ic)))
    row = lambda g, b: np.array([score(
        b, paths.GROUPS[g][0], i, paths.GROUPS[g][1]
    ) - 0.04 * (sum(paths.GROUPS[g]) - 2) for i in range(m - paths.GROUPS[g][1] + 1)])
    ((got, compared, pairs),) = paths.together([paths.best_groups(blocks, lines)])
    want = paths.cover(len(blocks), m, row)
    assert got.tolist() == [
        [b, paths.GROUPS[g][0], i, paths.GROUPS[g][1], score(b, paths.GROUPS[g][0], i, paths.GROUPS[g][1])] for g, b, i in want
    ] and compared <= pairs
    starts = np.arange(m) * 3.0
    ends = starts + np.array([rnd.random() * 4 for _ in range(m)])
    less = lambda d: np.minimum(0.18, np.abs(np.maximum(0.1, ends[d - 1 :] - starts[: m - d + 1]) - 3.2) * 0.015)
    ((got, compared, pairs),) = paths.together([paths.best_path(blocks, lines, starts, ends)])
    want = paths.follow(len(blocks), m, min(m, 6), lambda d, b: np.array([score(b, 1, j, d) for j in range(m - d + 1)]) - less(d))
    assert got.tolist() == [[j, k, score(b, 1, j, k - j) if k > j else 0.0] for b, (j, k) in enumerate(want)]
    ((got, _, _),) = paths.together([paths.best_scores(blocks, lines)])
    assert got.tolist() == [max(score(b, 1, j, d) for d in range(1, min(3, m) + 1) for j in range(m - d + 1)) for b in range(len(blocks))]


def test_jobs_together_have_their_own_results():
    rnd = random.Random(9)
    jobs = [([verse(rnd) for _ in range(rnd.randrange(1, 6))], [verse(rnd) for _ in range(rnd.randrange(1, 6))]) for _ in range(40)]
    alone = [paths.together([paths.best_groups(a, b)])[0] for a, b in jobs]
    for cells in (1, 50, 1 << 22):
        paths.CELLS, before = cells, paths.CELLS
        got = list(paths.in_turn((len(a) * len(b), lambda a=a, b=b: paths.best_groups(a, b)) for a, b in jobs))
        paths.CELLS = before
        assert [(x.tolist(), c, p) for x, c, p in got] == [(x.tolist(), c, p) for x, c, p in alone]
    assert list(paths.in_turn([])) == []


def test_long_songs_compare_few_pairs():
    rnd = random.Random(2)
    blocks = [f"{verse(rnd)}{i}" for i in range(700)]
    lines = [part for b in blocks for part in ([b] if rnd.random() < 0.8 else [b[: len(b) // 2], b[len(b) // 2 :]])]
    ((rows, compared, pairs),) = paths.together([paths.best_groups(blocks, lines)])
    assert rows[:, 0].tolist() == list(range(700)) and compared < pairs / 500 and rows[:, 4].mean() > 0.95


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 7), st.randoms(use_true_random=False))
def test_best_path_has_the_most_gain(n, m, rnd):
    gain = {(i, j, k): rnd.random() - 0.2 for i in range(n) for j in range(m) for k in range(j + 1, min(m, j + 6) + 1)}

    @cache
    def best(i, j):
        return -0.03 * (m - j) if i == n else max([best(i + 1, j) - 0.18, *(gain[i, j, k] + best(i + 1, k) for k in range(j + 1, min(m, j + 6) + 1))])

    most = min(m, 6)
    steps = paths.follow(n, m, most, lambda d, i: np.array([gain[i, j, j + d] for j in range(m - d + 1)]))
    assert len(steps) == n and steps[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(steps))
    assert sum(-0.18 if j == k else gain[i, j, k] for i, (j, k) in enumerate(steps)) - 0.03 * (m - steps[-1][1]) == pytest.approx(best(0, 0))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.randoms(use_true_random=False))
def test_best_groups_have_the_most_gain(n, m, rnd):
    gain = {(b, i, bc, ic): rnd.random() for b in range(n) for i in range(m) for bc, ic in paths.GROUPS if b + bc <= n and i + ic <= m}

    @cache
    def best(b, i):
        ways = [0.0] if (b, i) == (n, m) else []
        ways += [best(b, i + 1) - 0.12] if i < m else []
        ways += [gain[b, i, bc, ic] + best(b + bc, i + ic) for bc, ic in paths.GROUPS if (b, i, bc, ic) in gain]
        return max(ways, default=-np.inf)

    got = [
        (b, *paths.GROUPS[g], i) for g, b,
        i in paths.cover(n, m, lambda g, b: np.array([gain[b, i, *paths.GROUPS[g]] for i in range(m - paths.GROUPS[g][1] + 1)]))
    ]
    if best(0, 0) == -np.inf:
        assert len(got) == 0
        return
    groups = [(b, bc, i, ic) for b, bc, ic, i in got]
    assert [b for b, *_ in groups] == list(itertools.accumulate([0, *(bc for _, bc, _, _ in groups)]))[:-1] and sum(bc for _, bc, _, _ in groups) == n
    assert sum(gain[b, i, bc, ic] for b, bc, i, ic in groups) - 0.12 * (m - sum(ic for *_, ic in groups)) == pytest.approx(best(0, 0))


def cheapest(cost, steps):
    """The least sum of any path from the first pair to the last, by exhaustive recursion; steps: (di, dj, factor, extra)."""
    n, m = cost.shape

    @cache
    def to(i, j):
        if i < 0 or j < 0 or not np.isfinite(cost[i, j]):
            return np.inf
        return cost[0, 0] if i == j == 0 else min(to(i - di, j - dj) + f * cost[i, j] + e for di, dj, f, e in steps)

    return to(n - 1, m - 1)


@pytest.mark.parametrize("n, m", [(1, 1), (7, 7), (9, 12), (14, 9), (20, 23), (3, 9), (12, 2)])
def test_banded_path_is_the_cheapest_in_its_band(n, m):
    rnd = np.random.default_rng(n * 31 + m)
    a, b = (timemap.unit(np.abs(rnd.normal(size=(k, 12)))) for k in (n, m))
    for band in (None, 0.5, 1.0):
        share = min(0.20, max(0.08, abs(n - m) / max(n, m) + 0.04)) if band is None else band
        radius = max(1, round(share * min(n, m)))
        gap = np.arange(m)[None, :] - np.arange(n)[:, None]
        cost = np.where((gap > -radius - max(0, n - m)) & (gap < radius + max(0, m - n)), 1 - a @ b.T, np.inf)
        want = cheapest(cost, [(1, 1, 1, 0.0), (1, 2, 1, 0.08), (2, 1, 1, 0.08)])
        path = timemap.banded_path(a, b, band)
        if not np.isfinite(want):
            assert len(path) == 0  # and no diagonal is made up
            continue
        assert tuple(path[0]) == (0, 0) and tuple(path[-1]) == (n - 1, m - 1)
        moves = np.diff(path, axis=0)
        assert cost[path[:, 0], path[:, 1]].sum() + 0.08 * (moves.sum(axis=1) == 3).sum() == pytest.approx(want)


@pytest.mark.parametrize("n, m", [(1, 1), (6, 9), (15, 12)])
def test_small_multiscale_path_is_the_cheapest(n, m):
    rnd = np.random.default_rng(n + m)
    a, b = (timemap.unit(np.abs(rnd.normal(size=(k, 12)))) for k in (n, m))
    path = timemap.multiscale_path(a, b)
    cost = 1 - a @ b.T
    weight = {(1, 0): 1.5, (0, 1): 1.5, (1, 1): 2.0}
    sums = cost[0, 0] + sum(weight[tuple(d)] * cost[tuple(p)] for d, p in zip(np.diff(path, axis=0).tolist(), path[1:].tolist(), strict=True))
    assert sums == pytest.approx(cheapest(cost, [(1, 0, 1.5, 0), (0, 1, 1.5, 0), (1, 1, 2.0, 0)]))


def test_long_multiscale_path_follows_a_stretch():
    rnd = np.random.default_rng(2)
    a = timemap.unit(np.abs(np.cumsum(rnd.normal(size=(600, 12)), axis=0)))
    at = np.clip(np.round(np.arange(660) * 599 / 659), 0, 599).astype(int)
    path = timemap.multiscale_path(a, a[at], a, a[at])
    assert np.abs(path[:, 0] - at[path[:, 1]]).mean() < 2
    kept = timemap.rising(path)
    assert (np.diff(kept, axis=0) > 0).all()


def test_pitch_shift_is_that_of_the_cheapest_turn():
    rnd = np.random.default_rng(5)
    a = np.abs(np.cumsum(rnd.normal(size=(400, 12)), axis=0))
    for k in (0, 4, 11):
        assert timemap.best_shift(a, np.roll(a, -k, axis=1), 21, 5) == k


def brute_copy(flat):
    """By trying every start in the middle fifth."""
    n = len(flat)
    size = min(300, max(100, n // 5))
    piece = min(48, max(24, size // 6))
    low, found = int(n * 0.4), []
    for s in range(low, int(n * 0.6) + 1):
        even = min(s, n - s) / max(s, n - s)
        if even < 0.92:
            continue
        seen = any(flat[s + k : s + k + piece] == flat[k : k + piece] for k in range(0, size - piece + 1, max(12, piece // 2)))
        seen = seen or ((s - low) % max(4, size // 50) == 0 and difflib.SequenceMatcher(None, flat[:size], flat[s : s + size]).ratio() >= 0.88)
        r = difflib.SequenceMatcher(None, flat[:s], flat[s:]).ratio() if seen else 0
        if r >= 0.97:
            found.append((r + 0.1 * even, -s))
    return -max(found)[1] if found else None


def song(rnd, lines, words=5):
    return "\n".join(" ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(words)) for _ in range(lines))


def test_second_copy_by_brute_force(spark):
    rnd, texts = random.Random(3), ["", "short", "İ" * 300]
    for k in range(8):
        s = song(rnd, 12)
        other = list(s)
        for _ in range(k):
            other[rnd.randrange(len(other))] = rnd.choice("abcdefghij")
        texts += [s, s + "\n" + "".join(other), s + "\n\n『" + s, s + "\n" + s[: len(s) // 3]]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", align.trim_copy("t").alias("r")).collect()
    for r in got:
        text = texts[r["k"]]
        at = brute_copy(key(text)) if len(key(text)) >= 240 else None
        assert r["r"]["removed"] == (at is not None)
        assert key(r["r"]["text"]) == (key(text)[:at] if at else key(text)) and text.startswith(r["r"]["text"])
        assert not r["r"]["removed"] or r["r"]["text"][-1] not in " \n『"
    assert sum(r["r"]["removed"] for r in got) >= 8


def test_next_greater_by_brute_force(spark):
    rnd = random.Random(1)
    rows = [(i, [float(rnd.randint(0, 9)) for _ in range(rnd.randint(0, 30))]) for i in range(60)] + [(99, None)]
    for r in spark.createDataFrame(rows, "k int, v array<double>").select("v", scans.next_greater("v").alias("g")).collect():
        assert r["g"] == (None if r["v"] is None else [next((y for y in r["v"][i + 1 :] if y > x), None) for i, x in enumerate(r["v"])])


def test_captions_follow_the_path(spark):
    """Blocks laid out on a transcript: matched ones at their segments' times, others after the one before, none before the last ended."""
    rnd = random.Random(7)
    rows, segments = [], []
    for job in range(12):
        lines = [song(rnd, 1) for _ in range(6)]
        rows += [(str(job), i, t, t, 40.0) for i, t in enumerate(lines)]
        heard = [t for t in lines if rnd.random() < 0.7]
        segments += [(str(job), i, 3.0 + 4 * i, 5.5 + 4 * i + rnd.random() * 3, t) for i, t in enumerate(heard)]
    b = spark.createDataFrame(rows, "job_id string, idx int, text string, sync_text string, duration double")
    s = spark.createDataFrame(segments, "job_id string, idx int, start double, end double, text string")
    edges, out = {}, {}
    for job in range(12):
        own, lines = sorted(x[1:] for x in segments if x[0] == str(job)), [x[3] for x in rows if x[0] == str(job)]
        for i, j in itertools.product(range(6), range(len(own))):
            for k in range(j + 1, min(len(own), j + 6) + 1):
                score = ratio(lines[i], " ".join(x[3] for x in own[j:k]))
                edges.setdefault(str(job), {})[i, j, k] = score, score - min(0.18, abs(max(0.1, own[k - 1][2] - own[j][1]) - 3.2) * 0.015)
    for r in align.align_to_segments(b, s).orderBy("job_id", "idx").collect():
        out.setdefault(r["job_id"], []).append(r)
    assert len(out) == 12
    for job, got in out.items():
        assert [r["idx"] for r in got] == list(range(6))
        if job not in edges:
            continue
        own, last = sorted(x[1:4] for x in segments if x[0] == job), None
        m, known = len(own), edges[job]
        steps = paths.follow(6, m, min(m, 6), lambda d, i: np.array([known[i, j, j + d][1] for j in range(m - d + 1)]))  # noqa: B023
        for r, (j, k) in zip(got, steps, strict=True):
            score = known[int(r["idx"]), j, k][0] if k > j else 0.0
            if k > j:
                start, end = own[j][1], min(40.0, own[k - 1][2])
            else:
                start = 0.5 if last is None else last
                later = [x[1] for x in own[j:] if x[1] > start]
                end = min(40.0, start + min(2.8, max(1.2, (later[0] if later else 39.5) - start)))
            start = last + 0.03 if last is not None and start < last else start
            end = min(40.0, start + 1.4) if end <= start else end
            assert (r["start"], r["end"], r["score"]) == (pytest.approx(start), pytest.approx(end), pytest.approx(score))
            last = end


def test_slots_where_no_groups_fit(spark):
    """Unlike texts: lines are split by the roots of key lengths, or joined."""
    b = spark.createDataFrame(
        [("more", i, t, t, 60.0) for i, t in enumerate(["aaaa", "aaaaaaaaa", "a", "aa"])] + [("fewer", i, t, t, 60.0) for i, t in enumerate(["aa", "aaa"])],
        "job_id string, idx int, text string, sync_text string, duration double"
    )
    items = [("more", 0, 10.0, 20.0, "zzzz zzzz zzzz"), ("more", 1, 20.0, 22.0, "z")] + [("fewer", i, 5.0 + 5 * i, 9.0 + 5 * i, f"zz{i}") for i in range(5)]
    got = {(r["job_id"], r["idx"]): r for r in align.align_to_lrc(
        b, spark.createDataFrame(items, "job_id string, idx int, start double, end double, text string")
    ).collect()}
    # sizes 12 and 1, times 10 and 2: both further parts go to the first line, whose three blocks have roots 2, 3 and 1
    assert [(got["more", i]["start"], got["more", i]["end"]) for i in range(4)] == [
        (10.0, pytest.approx(10 + 20 / 6)), (pytest.approx(10 + 20 / 6), pytest.approx(10 + 50 / 6)), (pytest.approx(10 + 50 / 6), 20.0),
        (20.0, 22.0)
    ]
    assert [(
        got["fewer", i]["start"], got["fewer", i]["end"], got["fewer", i]["sync_text"]
    ) for i in range(2)] == [(5.0, 14.0, "zz0 zz1"), (15.0, 29.0, "zz2 zz3 zz4")]
    assert {r["lrc_count"] for k, r in got.items() if k[0] == "fewer"} == {5}


def test_expand_counts_by_brute_force(spark):
    rnd, items, counts, want = random.Random(4), [], [], {}
    for job in range(20):
        m, n = rnd.randint(1, 6), rnd.randint(1, 14)
        own = [(f"{job}", i, 2.0 * i, 2.0 * i + rnd.random() * 3, "x" * rnd.randint(0, 20)) for i in range(m)]
        items += own
        counts.append((f"{job}", n))
        size, time = [max(1, len(x[4])) for x in own], [max(0.2, x[3] - x[2]) for x in own]
        parts = [1] * m
        for _ in range(n - m):
            each = [s / p / max(1.0, np.median(size)) + 0.2 * min(2.0, t / p / max(0.2, np.median(time))) for s, t, p in zip(size, time, parts, strict=True)]
            parts[int(np.argmax(each))] += 1
        want[str(job)] = parts
    df = spark.createDataFrame(items, "job_id string, idx int, start double, end double, text string")
    got = {}
    for r in align.expand_counts(df, spark.createDataFrame(counts, "job_id string, n long")).orderBy("job_id", "idx").collect():
        got.setdefault(r["job_id"], []).append(r["parts"])
    assert got == want


def test_similarity_is_the_ratio_of_keys(spark):
    rnd = random.Random(0)
    rows = [(
        song(rnd, 1, 2) if rnd.random() < 0.8 else rnd.choice(["", "Ab!", "가 나", None]), song(rnd, 1, 2) if rnd.random() < 0.8 else "a b"
    ) for _ in range(200)]
    from strandline.functions.text import similarity

    for r in spark.createDataFrame(rows * 2, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r["s"] == pytest.approx(ratio(r["a"] or "", r["b"] or ""))


def test_equal_halves_need_no_matcher(monkeypatch):
    """Of an exact copy nothing is matched: no other start can be better."""
    asked = []
    ratio_of = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: asked.append(1) or ratio_of(self))
    song = "".join(f"line{k}ofasongthatgoeson" for k in range(60))
    assert align.second_copy(song + song) == len(song)
    assert not asked


def test_ratios_hold_few_characters_at_once(monkeypatch):
    """However many pairs are asked for, only so many characters are held as arrays, and the similarities are the same."""
    rng = random.Random(5)
    first, second = (["".join(rng.choices("abc", k=rng.randrange(40))) for _ in range(300)] for _ in range(2))
    want, coded, seen = similar.ratios(first, second), similar._coded, []
    monkeypatch.setattr(similar, "CHARACTERS", 500, raising=False)
    monkeypatch.setattr(similar, "_coded", lambda texts: seen.append(sum(map(len, texts))) or coded(texts))
    assert (similar.ratios(first, second) == want).all()
    assert max(seen) <= 500 + 80


def test_few_searches_are_held_at_once(monkeypatch):
    """Small jobs count for what their searches hold, too, so a batch of many isn't held whole."""
    together, held = paths.together, []
    monkeypatch.setattr(paths, "together", lambda searches: held.append(len(searches)) or together(searches))
    got = list(paths.in_turn((1, lambda: paths.best_scores(["ab"], ["abc"])) for _ in range(1200)))
    assert len(got) == 1200 and {float(g[0][0]) for g in got} == {ratio("ab", "abc")}
    assert max(held) <= 600


def test_lines_that_cannot_be_chosen_are_not_compared():
    """With the places of lines in their blocks the choice is the same, and a block whose first line is a segment has no further line compared."""
    draw = random.Random(3)
    text = lambda n: "".join(draw.choices("abcdefgh", k=n))
    for _ in range(40):
        segments = [text(draw.randint(1, 30)) for _ in range(draw.randint(1, 6))]
        lines, pos = [], []
        for _ in range(5):
            n = draw.randint(1, 4)
            lines += [draw.choice([text(12), draw.choice(segments), draw.choice(segments)[:9] + text(3)]) for _ in range(n)]
            pos += range(n)
        (every, compared, _), = paths.together([paths.best_scores(lines, segments)])
        (some, fewer, _), = paths.together([paths.best_scores(lines, segments, pos=pos)])
        chosen = []
        for scores in (every, some):
            best = []
            for k, p in enumerate(pos):
                if p == 0:
                    best.append((scores[k], k))
                elif scores[k] > best[-1][0] + paths.BETTER:
                    best[-1] = scores[k], k
            chosen.append(best)
        assert chosen[0] == chosen[1] and fewer <= compared
    (_, all_, _), (_, few, _) = paths.together([paths.best_scores(["abcdef", "abcdeg", "bbcdef"], ["abcdef"], pos=at) for at in (None, [0, 1, 2])])
    assert all_ == 3 and few == 1
