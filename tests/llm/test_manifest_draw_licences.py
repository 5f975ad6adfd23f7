"""Merkle manifest, importance resampling and license scan against brute-force versions, and their results on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandline.llm import licences, merkle, resampling
from tests.llm.helpers import DOCS, awkward, empty, prose

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def brute_tree(leaves):
    """(root, siblings of each leaf as pairs of left and right)."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for nodes in levels[:-1]:
            k = i // 16 * 16
            path.append(("".join(nodes[k:i]), "".join(nodes[i + 1 : k + 16])))
            i //= 16
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))
    by = defaultdict(list)
    for r in rows:
        chosen = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        low = None if r["text"] is None else r["text"].translate(LOWER)
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, low) if chosen else None, r["doc_id"]))
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: brute_tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in keys}
    root, above = brute_tree([trees[k][0] for k in keys]) if keys else (None, [])
    out = []
    for k, up in zip(keys, above, strict=True):
        for (_, _, own, tampered, doc), path in zip(sorted(by[k], key=lambda x: x[:3]), trees[k][1], strict=True):
            h = tampered or own
            for left, right in [*path, *up]:
                h = H(left + h + right)
            out.append((doc, own, trees[k][0], root, H("".join(a + b for a, b in [*path, *up])), h, h == root))
    return out


def shown(df):
    return sorted(
        (tuple(r) for r in merkle.verified(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()),
        key=str
    )


@pytest.mark.parametrize("sizes", [(1,), (16,), (17,), (256, 1), (257, 16, 1), (4500, 300, 40) + (1,) * 20])
def test_manifest_by_brute_force(spark, sizes):
    rows = [
        (i * 7 % 5003, f"Text {i}" if i % 4 else "low", "en", None if s == 1 else f"s{s}", i, None, None, None) for s,
        n in enumerate(sizes) for i in range(n)
    ]
    df = spark.createDataFrame(rows, DOCS)
    got = shown(merkle.manifest(df.repartition(5)))
    assert got == sorted(brute_manifest(df.collect()), key=str)
    assert any(not r[-1] for r in got) or len(rows) < 30


def test_manifest_of_awkward_rows(spark):
    df = awkward(spark)
    assert shown(merkle.manifest(df)) == sorted(brute_manifest(df.collect()), key=str)
    assert merkle.manifest(empty(spark)).count() == 0


def test_manifest_order_of_sources_is_bytewise(spark):
    names = ["", "é", "z", "Z", "\U0001f642", "￿", None, "a b"]
    df = spark.createDataFrame([(i, "T", None, s, 1, None, None, None) for i, s in enumerate(names)], DOCS)
    assert shown(merkle.manifest(df)) == sorted(brute_manifest(df.collect()), key=str)


# 12


def test_crc_of_spans():
    rnd = random.Random(2)
    parts = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 2, 7, 47, 48, 49, 300]))) for _ in range(300)]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    one = resampling.crc32_of(data, starts, ends)
    assert one.tolist() == [zlib.crc32(p) for p in parts]
    assert resampling.crc32_of(data, starts, ends, one).tolist() == [zlib.crc32(p, zlib.crc32(p)) for p in parts]


def grams(t):
    w = words(t)
    return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]


def brute_draw(rows, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for r in rows for f in grams(r["text"])), Counter(bucket(f) for x in target for f in grams(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for r in rows:
        f = grams(r["text"])
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(H(f"7:{'' if r['doc_id'] is None else r['doc_id']}")[:8], 16)
        out.append([r["doc_id"], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted(
        (x for x, r in zip(out, rows, strict=True) if len(words(r["text"])) >= least),
        key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[2], x[1])
    )
    for k, x in enumerate(order[: len(order) * percent // 100]):
        x[4] = k + 1
    return sorted(map(tuple, out), key=str)


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("copies", [1, 40])
def test_draw_by_brute_force(spark, copies):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice([
        "Alpha", "beta", "gamma-delta", "É", "x1", "漢字", "a" * 60, "tau, ", "\n"
    ]) for _ in range(rnd.randrange(70))) for _ in range(120)]
    rows = [
        (k, t, None, None, None, None, None, None) for k, t in enumerate(texts)
    ] + [(500, texts[0] + " w" * 30, None, None, None, None, None, None)] * copies
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    target = ["beta gamma", None, "alpha É beta", ""]
    got = resampling.resample(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"))
    assert drawn(got) == brute_draw(docs.collect(), target)


def test_draw_of_awkward_rows(spark):
    docs, target = awkward(spark), spark.createDataFrame([(1, "x y", 5)], "item_id long, text string, score long")
    assert drawn(resampling.resample(docs, target)) == brute_draw(docs.collect(), ["x y"])
    assert drawn(resampling.resample(docs, target.limit(0), percent=100)) == brute_draw(docs.collect(), [], 100)
    assert resampling.resample(empty(spark), target).count() == 0
    few = docs.where("doc_id < 4")
    assert all(r[-1] is None for r in drawn(resampling.resample(few, target)))


def test_scores_far_apart_keep_their_ranks(spark):
    rows = spark.createDataFrame([(s,) for s in [5, 5, 5000, -3, 1024, 1023, 99_999, -40_000, 5, 1024]], "score long")
    got = {r["score"]: (r["above"], r["most"]) for r in resampling._offsets(rows, 70).collect()}
    assert got == {99_999: (0, 7), 5000: (1, 7), 1024: (2, 7), 1023: (4, 7), 5: (5, 7)}


# 13


def brute_scan(rows, given=licences.NOTICES, rare=6, votes=2, least=0.5):
    known = licences.notices(given)
    texts = [words(r["text"]) for r in rows]
    vocabulary = {w for n in known for w in n.words}
    files = Counter(w for t in texts for w in set(t) & vocabulary)
    out = []
    for r, t in zip(rows, texts, strict=True):
        places = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(t)) if t[i : i + len(p.split())] == p.split()]
        base, more, score = {x[1] for x in places}, set(), 1.0 if places else 0.0
        at = defaultdict(list)
        for i, w in enumerate(t):
            at[w].append(i)
        for n in known:
            if any(n.words[k] not in at for k in n.must):
                continue
            own = sorted({w for w in n.words if w in at}, key=lambda w: (files[w], w))[:rare]
            shifts = Counter(i - k for k, w in enumerate(n.words) if w in own for i in at[w])
            for shift in (s for s, c in shifts.items() if c >= votes):
                there = [k for k, w in enumerate(n.words) if 0 <= shift + k < len(t) and t[shift + k] == w]
                if n.must <= set(there) and len(there) / len(n.words) >= least:
                    more.add(n.label)
                    score = max(score, len(there) / len(n.words))
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        out.append((r["doc_id"], len(t), len(places), first, last, sorted(base), sorted(base | more), pytest.approx(score)))
    return out


def scanned(df, **how):
    return sorted((tuple(r) for r in licences.license_labels(df, **how).collect()), key=lambda r: str(r[:-1]))


def test_licences_by_brute_force(spark):
    rnd = random.Random(8)
    notices = [t for _, t, _ in licences.NOTICES] + [
        "cc by", "All Rights Reserved.", "GNU GENERAL public license", "MIT license", "rights reserved all rights reserved all"
    ]
    rows = []
    for k in range(150):
        parts = []
        for _ in range(rnd.randrange(4)):
            own = rnd.choice(notices).split()
            if rnd.random() < 0.4:
                own[rnd.randrange(len(own))] = rnd.choice(["foo", "license", "all"])
            parts += [" ".join(own), prose(rnd.randrange(50), rnd.randrange(12))]
        rows.append((k, ", ".join(parts), None, None, None, None, None, None))
    docs = spark.createDataFrame(rows, DOCS)
    got = scanned(docs)
    assert got == sorted(brute_scan(docs.collect()), key=lambda r: str(r[:-1]))
    assert len({x for r in got for x in r[6]}) > 12 and any(0.5 < r[7] < 1 for r in got)


def test_licences_of_awkward_rows(spark):
    many = " ".join(["license"] * 3000 + ["mit license"] * 300 + ["under the"] * 2000)
    more = spark.createDataFrame(
        [
            (70, many, None, None, None, None, None, None),
            (71, "ALL RIGHTſ reserved; all RIGHTS reserved", None, None, None, None, None, None),
            (72, "marK all\trights\nreserved", None, None, None, None, None, None)
        ],
        DOCS
    )
    docs = awkward(spark).unionByName(more)
    assert scanned(docs) == sorted(brute_scan(docs.collect()), key=lambda r: str(r[:-1]))
    assert licences.license_labels(empty(spark)).count() == 0


def test_own_notices(spark):
    given = (("zlib", "this software is provided as is without any express or implied warranty", ("as is without any express or implied warranty",)),)
    docs = spark.createDataFrame(
        [(1, "This software is provided 'as-is', without any express or implied warranty."), (2, "as is without warranty")],
        "doc_id long, text string"
    )
    assert [r[6] for r in scanned(docs, given=given)] == [["zlib"], []]
    for bad in ((("x", "some words", ()),), (("x", "some words", ("other",)),)):
        with pytest.raises(ValueError):
            licences.notices(bad)


def test_license_scan_runs_no_python(spark):
    docs = awkward(spark)
    for df in (licences.known_words(docs, ["license"]), merkle.verified(merkle.manifest(docs)), licences.license_labels(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
