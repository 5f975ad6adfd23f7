"""Each training-data operator against a brute-force version, and its results on awkward tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import brown, chunks, components, jaccard, jpeg, kneserney, language, linefreq, packing, pieces, secrets, warc, wordhash
from strandline.llm.queries import QUERIES
from tests.llm.helpers import awkward, empty, lowered, prose, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}


# 1


def test_warc_pages(spark):
    pages = spark.createDataFrame(
        [
            (1, "u", "x" * 1000), (5, "u", "x" * 1000), (3, None, "x" * 1000), (4, "v", None), (6, "v", ""), (7, "w", "x" * 999),
            (8, "w", "x" * 999), (9, "é", "é" * 600)
        ],
        "page_id long, url string, html string"
    )
    got = {r["answer"]["page_id"]: r["answer"] for r in warc.archive_pages(pages).collect()}
    assert {k: v["record_type"] for k, v in got.items()} == {
        1: "revisit", 3: "revisit", 5: "response", 4: "response", 6: "response", 7: "response", 8: "response", 9: "response"
    }
    assert bytes(got[9]["payload"]).decode() == "é" * 600 and got[9]["payload_bytes"] == 1200
    assert got[3]["payload_digest"] == hashlib.sha1(b"x" * 1000).hexdigest()


def test_warc_ids_of_any_long(spark):
    ids = [1234567890123456789, (1 << 63) - 1, -(1 << 63), 0, -5]
    pages = spark.createDataFrame([(k, "u", "x" * 1000) for k in ids], "page_id long, url string, html string")
    got = {r["answer"]["page_id"]: {f["name"]: f["value"] for f in r["answer"]["fields"]}.get("x-refers-to-page") for r in warc.archive_pages(pages).collect()}
    assert got == dict.fromkeys(ids, str((1 << 63) - 1)) | {(1 << 63) - 1: None}
    assert warc._long("9223372036854775808") is None and warc._long("12345678901234567890") is None and warc._long("-") is None


def record(i, kind, to=(), **more):
    base = dict.fromkeys([
        "target_uri", "refers_to_id", "profile", "page_id", "block_bytes", "payload_bytes", "payload_digest", "http_status", "fields",
        "payload", "error"
    ])
    return {"record_id": i, "record_type": kind, "concurrent_to": list(to)} | base | more


def captures(spark, rows):
    return [
        (
            r["answer"] and r["answer"]["record_id"], r["request"] and r["request"]["record_id"],
            sorted(str(m["record_id"]) for m in r["metadata"]), sorted(str(o["record_id"]) for o in r["others"]), r["capture_id"]
        )
        for r in warc.assemble(spark.createDataFrame(rows, warc.RECORDS)).collect()
    ]


def test_warc_assembly(spark):
    rows = [
        record("r", "response"), record("q", "request", ["r"]), record("m", "metadata", ["q"]), record("m2", "metadata", ["r"]),
        record("lone", "resource"), record(None, "metadata", ["r"]), record("s", "response", ["s"])
    ]
    got = captures(spark, rows)
    assert sorted(got, key=str) == sorted([("r", "q", ["None", "m", "m2"], [], "r"), ("s", None, [], [], "s"), (None, None, [], ["lone"], "lone")], key=str)


def test_warc_links_in_both_directions_and_over_many_hops(spark):
    chain = [record(f"c{k}", "metadata", [f"c{k + 1}"]) for k in range(9)] + [record("c9", "request", ["cr"]), record("cr", "response")]
    mutual = [record("r", "response", ["q"]), record("q", "request", ["r"])]
    several = [record("x", "response"), record("y", "request", ["x", "z"]), record("z", "metadata"), record("w", "metadata", ["z", "x"])]
    got = captures(spark, chain + mutual + several + [record("lost", "request", ["nowhere"])])
    assert sorted(got, key=str) == sorted(
        [("cr", "c9", [f"c{k}" for k in range(9)], [], "cr"), ("r", "q", [], [], "r"), ("x", "y", ["w", "z"], [], "x"), (None, "lost", [], [], "nowhere")],
        key=str
    )


def test_warc_captures_are_components(spark):
    rnd = random.Random(4)
    rows = [record(f"n{i}", "metadata", {f"n{rnd.randrange(60)}" for _ in range(rnd.choice([0, 0, 1, 1, 2]))}) for i in range(60)]
    root = {r["record_id"]: r["record_id"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in rows:
        for to in r["concurrent_to"]:
            root[find(r["record_id"])] = find(to)
    want = defaultdict(list)
    for x in root:
        want[find(x)].append(x)
    assert sorted(m for _, _, m, _, _ in captures(spark, rows)) == sorted(sorted(m) for m in want.values())


def test_warc_foreign_archives(spark, tmp_path):
    import gzip

    def raw(kind, i, body, *more):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {i}", *more, f"Content-Length: {len(body)}", "", body, "", ""]).encode()

    good = raw("response", "<a>", "plain") + raw(
        "request", "<b>", "GET", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <c>"
    ) + raw("metadata", "<c>", "about")
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (
        raw("response", "<m>", "one"), raw("metadata", "<n>", "two", "X-Page-ID: none", "WARC-Concurrent-To:\r\n <m>")
    )))
    (tmp_path / "plain.warc").write_bytes(good)
    (tmp_path / "cut.warc").write_bytes(raw("response", "<d>", "whole") + raw("response", "<e>", "cut off")[:-8])
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(raw("response", "<f>", "x" * 5000))[:-20])
    (tmp_path / "no.warc").write_bytes(b"something else")
    (tmp_path / "none.warc").write_bytes(b"")
    records = warc.read_records(spark, str(tmp_path)).cache()
    assert sorted(r["record_id"] for r in records.collect() if not r["error"]) == ["<a>", "<b>", "<c>", "<d>", "<m>", "<n>"]
    assert sorted(re.sub(".*/", "", r["error"]).split(":")[0] for r in records.collect() if r["error"]) == ["cut.warc", "cut.warc.gz", "no.warc"]
    got = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert got["<a>"]["request"]["concurrent_to"] == ["<a>", "<c>"] and [m["record_id"] for m in got["<a>"]["metadata"]] == ["<c>"]
    assert [m["record_id"] for m in got["<m>"]["metadata"]] == ["<n>"] and sum(o["error"] is not None for r in got.values() for o in r["others"]) == 3


def test_warc_revisits_name_their_response(spark):
    pages = spark.createDataFrame(
        [(k, "u", "x" * 1000) for k in (1, 5, 3)] + [(k, "u", "y" * 1000) for k in (2, 7, 7)], "page_id long, url string, html string"
    )
    rows = [r["answer"] for r in warc.archive_pages(pages).collect()]
    (five,) = [r for r in rows if r["page_id"] == 5]
    assert len(rows) == 6 and all(r["refers_to_id"] == five["record_id"] for r in rows if r["page_id"] in (1, 3))
    assert [r["refers_to_id"] for r in rows if r["page_id"] == 2] == [None]  # two records could be meant
    assert {f["value"] for r in rows for f in r["fields"] if f["name"] == "x-refers-to-page" and r["page_id"] == 2} == {"7"}


# 2


def test_chunks_are_the_tokenizers_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    end = "<|endoftext|>"
    more = [
        "", "a, b", "a,  b ,", "x,\n\ny", "\n", ",", "A.,b .c.", "é, ß.\nñ,", "don't, I'm.", "１２. 3, 4.5,", "  lead", "tab\t, x,\r\n y",
        "\0 a", f"{end} x", end, f"a  {end}  b {end}{end}\n", f"x{end}y <|endoftext|", f"{end} "
    ]
    many = [*texts.values(), *more]
    table = chunks.chunk_table(packing.vocabulary())
    table.most = 3000
    table._clear()
    for k in range(0, len(many), 50):
        for t, got in zip(many[k : k + 50], table.encode(many[k : k + 50]), strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    chunks.chunk_table.cache_clear()


def test_chunks_of_equal_hash_are_told_apart(monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    chunks.chunk_table.cache_clear()
    table = chunks.chunk_table(packing.vocabulary())
    monkeypatch.setattr(chunks, "hash_spans", lambda data, starts, ends: (data[np.minimum(ends, len(data) - 1) - 1] % 3).astype(np.uint64))
    many = ["one two three", "two one", "bad bed bid bud bod", "", "a\nb c"]
    for part in (many, many[::-1], ["other " * 5, "two one"]):
        for t, got in zip(part, table.encode(part), strict=True):
            assert np.frombuffer(got, dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    chunks.chunk_table.cache_clear()


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_constructed_words_have_hashes_of_their_own():
    words_ = [thue_morse(n, *ab) for n in (512, 1024, 2048, 1 << 20) for ab in ("ab", "ba")] + ["a" * n for n in range(1, 70)]
    assert len(set(wordhash.words_of([" ".join(words_).encode()])[0].tolist())) == len(words_)
    lone = [int(wordhash.words_of([w.encode()])[0][0]) for w in words_]  # wherever a word stands
    assert lone == wordhash.words_of([" ".join(words_).encode()])[0].tolist()


def test_constructed_words_in_queries(spark, tmp_path):
    from tokenizers import Tokenizer

    one, other = thue_morse(2048), thue_morse(2048, "b", "a")
    rows = [(1, one), (2, other), (3, f"x {one} y"), (4, f"x {other} y")]
    spark.createDataFrame(
        [(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in QUERIES["op8_jaccard_join"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    tok = Tokenizer.from_file(packing.vocabulary())
    ids = {d: np.asarray([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for d, t in rows}
    for r in QUERIES["op2_sum_of_squares_packing"](spark, str(tmp_path)).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(part.tobytes())
    learnt = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 != 2}
    count = Counter(w for d, t in rows if d in learnt for w in [*t.split(), None])
    for r in QUERIES["op4_brown_class_model"](spark, str(tmp_path)).collect():
        own = [*dict(rows)[r["doc_id"]].split(), None]
        assert r["n_known"] == sum(w in count for w in own)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (sum(count.values()) + len(count) + 1)) for w in own))


def test_packing_covers_every_id_once(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary())
    rows = packing.pack_documents(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, t in texts.items():
        own = sorted(by_doc[d], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(bytes(r["ids"]), dtype="<u4") for r in own]).tolist()
        assert ids == [*tok.encode(t, add_special_tokens=False).ids, 0] and own[0]["doc_tokens"] == len(ids)
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own[:-1]]]).tolist()
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own[:-1]]]).tolist()
        size = sum(r["length"] for r in own)
        assert 0 < size <= 1024
        padding += 0 if size & (size - 1) == 0 else 1024 - size
    assert padding <= 0.01 * sum(r["length"] for r in rows)


def test_level_array_is_the_best_choice():
    levels, rnd = packing.LevelArray(16), random.Random(1)
    for i in range(400):
        s = rnd.randint(1, 15)
        before = levels.counts.copy()

        def cost(h, n=before, s=s):
            c = n.copy()
            if h:
                c[h] -= 1
            if h + s < 16:
                c[h + s] += 1
            return int((c[1:16] ** 2).sum())

        options = [h for h in range(17 - s) if h == 0 or before[h]]
        assert cost(levels.level_for(s)) == min(map(cost, options))
        levels.place((i, b"", s, 0, s))


@pytest.mark.parametrize("n", [3, 20, 250, 1000, 4000])
def test_open_windows_are_joined_whole(n):
    rnd, levels, full = random.Random(n), packing.LevelArray(1024), []
    pieces = [(i, b"", s, 0, s) for i, s in enumerate(rnd.choice([rnd.randint(1, 1023), rnd.randint(1, 200), 77]) for _ in range(n))]
    for p in pieces:
        full += [w for w in [levels.place(p)] if w]
    kept = {tuple(p[0] for p in w) for level in levels.windows for w in level}
    closed = list(levels.rest())
    sizes = [sum(p[-1] for p in w) for w in closed]
    assert all(s & (s - 1) == 0 for s in sizes) and sum(s < 1024 for s in sizes) <= 10
    total = Counter()
    for w in full + closed:
        for p in w:
            total[p[0]] += p[-1]
    assert total == Counter({p[0]: p[-1] for p in pieces})
    if n >= 250:  # of all pieces at least 95 % leave in the window that sum of squares put them into
        whole = sum(len(w) for w in full)
        for w in closed:
            own, at = [p[0] for p in w], 0
            while at < len(own):
                step = next((k for k in range(1, len(own) - at + 1) if tuple(own[at : at + k]) in kept and all(p[-1] == p[2] for p in w[at : at + k])), 0)
                whole += step
                at += step or 1
        assert whole >= 0.95 * n


def test_most_documents_ends_are_placed_whole(spark):
    rows = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1))
    ends = rows.where("start >= doc_tokens - doc_tokens % 1024").groupBy("doc_id").count()
    assert ends.where("count = 1").count() >= 0.94 * ends.count()


# 3


def test_pieces_are_the_librarys(spark, docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    more = spark.createDataFrame([(-1, "  two  spaces ▁ and 漢字 🙂 x"), (-2, None), (-3, ""), (-4, "\t\n a"), (-5, "aaaa" * 500)], "doc_id long, text string")
    known = texts | {r[0]: r[1] or "" for r in more.collect()}
    for r in pieces.encode_decode(docs.select("doc_id", "text").unionByName(more)).collect():
        ids = sp.encode(known[r["doc_id"]])
        assert r["ids"] == ids and r["decoded"] == sp.decode(ids)


# 4


def test_brown_base_is_exact(spark, docs, texts):
    rows = QUERIES["op4_brown_class_model"](spark, SF).collect()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    tokens = {d: [*lowered(t), None] for d, t in texts.items()}
    count = Counter(w for d in texts if not held[d] for w in tokens[d])
    n, v = sum(count.values()), len(count)
    for r in rows:
        d = r["doc_id"]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(tokens[d]), sum(w in count for w in tokens[d]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[d]))


def test_brown_beats_its_base_on_held_out_documents(spark):
    held = [r for r in QUERIES["op4_brown_class_model"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_exchange_finds_classes():
    rnd = np.random.default_rng(0)
    pairs = np.zeros((24, 24))
    for a in range(20):  # words of one kind are followed by the other kind
        for b in range(20):
            if a % 2 != b % 2:
                pairs[a, b] = rnd.integers(20, 60)
    own = brown.exchange(pairs, 20, 2)
    assert len(set(own[:20:2])) == 1 and len(set(own[1:20:2])) == 1 and own[0] != own[1]


def test_transitions_and_emissions_are_distributions(spark, docs):
    held = brown.texts_of(docs, "doc_id", "text", F.lit(False).alias("held"))
    model, tokens, learnt = brown.fit(held, 64, 8)
    assert (10**model.transition).sum(axis=1) == pytest.approx(1)
    assert learnt == docs.count() and tokens > learnt
    for counts in ([1] * 300 + [2] * 100 + [3] * 40 + [38] * 10, [1], [5, 5], [2, 2, 1], []):  # one rule at every size
        f = brown.rare_emission(sum(counts), *(counts.count(k) for k in (1, 2, 3)), len(counts))
        assert (10 ** f(np.array([*counts, *[0] * (len(counts) + 1)]))).sum() == pytest.approx(1)


def test_brown_score_by_brute_force(spark, monkeypatch):
    """Every word is frequent here, so that the classes found can be read from the model; all else is counted anew."""
    rnd, found = random.Random(6), []
    rows = [(i, " ".join(rnd.choice("a b c d e f g h i j k l".split()[(j % 2) * 6 :][:6]) for j in range(rnd.randint(0, 40)))) for i in range(120)]
    real = brown.fit
    monkeypatch.setattr(brown, "fit", lambda *a: found.append(real(*a)) or found[-1])
    got = {r["doc_id"]: r for r in brown.brown_scores(spark.createDataFrame(rows, "doc_id long, text string"), words=6, classes=3).collect()}
    model = found[0][0]
    hashes = wordhash.words_of([b"a b c d e f g h i j k l"])[0]
    kind = dict(zip("abcdefghijkl", model.kinds[np.searchsorted(model.vocabulary.keys, hashes)].tolist(), strict=True)) | {None: "end"}
    learnt = [[*t.split(), None] for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    count, pairs = Counter(w for t in learnt for w in t), Counter((kind[a], kind[b]) for t in learnt for a, b in itertools.pairwise([None, *t]))
    classes = sorted(set(range(3)) | {"end"}, key=str)
    tokens = {c: sum(pairs[a, c] for a in classes) for c in classes}
    total = sum(tokens.values())

    def p(a, b):
        left, kinds = sum(pairs[a, c] for c in classes), sum(pairs[a, c] > 0 for c in classes) + 1
        return (pairs[a, b] + kinds * (tokens[b] + 1) / (total + len(classes))) / (left + kinds)

    for i, t in rows:
        w = [*t.split(), None]
        want = sum(math.log10(p(kind[a], kind[b])) + (math.log10(count[b] / (tokens[kind[b]] + 1)) if b else 0) for a, b in itertools.pairwise([None, *w]))
        assert got[i]["score"] == pytest.approx(want, abs=1e-6)


def test_brown_puts_all_words_into_classes(spark):
    rnd = random.Random(1)
    kind = [
        [f"{k}w{i}" for i in range(60)] + [f"{k}rare{i}" for i in range(300)] for k in "ab"
    ]  # each kind is followed by the other; rare words come about five times
    draw = lambda k: kind[k][rnd.randrange(60)] if rnd.random() < 0.8 else kind[k][60 + rnd.randrange(300)]
    rows = [(i, " ".join(draw((i + j) % 2) for j in range(100))) for i in range(150)]
    got = brown.brown_scores(spark.createDataFrame(rows, "doc_id long, text string"), words=8, classes=2).collect()
    for held in (True, False):
        mine = [r for r in got if r["held_out"] is held]
        assert sum(r["score"] - r["base_score"] for r in mine) / sum(r["n_tokens"] for r in mine) > 0.2  # log10 2 is what the kinds tell


def test_rare_words_have_a_distribution():
    counts = np.array([1] * 300 + [2] * 100 + [3] * 40 + [10] * 10)
    stats = np.zeros((2, 2, 5), dtype=np.int64)
    stats[0, 0] = stats[1, 1] = [counts.sum(), 300, 100, 40, len(counts)]
    grid = np.zeros((7, 7))
    grid[:2, :2], grid[:2, 6], grid[6, :2] = [[100, 2000], [1500, 300]], [50, 60], [70, 40]
    table = 10 ** brown.last_transitions(grid, stats, 2)
    rare = (10 ** brown.rare_emission(*stats[0, 0].tolist())(counts)).sum() * (counts.sum() + 1)
    each = grid.sum(axis=0)[:2] - counts.sum() + rare
    for before in (0, 1, 4, 5, 6):
        assert table[before, :2] @ each + table[before, 6] + table[before, 4:6] @ (stats[:, ::-1, 4].sum(axis=0) + 1) == pytest.approx(1, abs=1e-4)


# 5


def test_line_quality(spark):
    shared = [" ".join(f"s{k}y{i}" for i in range(11)) for k in range(5)]
    own = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(i, "\n".join([*shared, own(i, 90)]), "h") for i in range(12)] + [(100 + i, "\n".join([*shared, own(i + 50, 12)]), "h") for i in range(3)] + [(200, shared[0] + "\n" + own(90, 60), "other"), (300, own(5, 25) + " " + own(5, 25), "h")]
    got = {r["doc_id"]: r for r in linefreq.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert sum(r["removed_words"] > 0 for d, r in got.items() if d < 12) >= 11 and all(got[d]["kept"] for d in range(12))
    assert sum(not got[100 + i]["base_failed"] and not got[100 + i]["kept"] for i in range(3)) >= 2 and got[200]["removed_words"] == 0
    assert got[300]["base_failed"]


def test_repeat_words_by_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("ab") if i % 2 else rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in linefreq.line_quality(spark.createDataFrame(
        [(*r, "h") for r in rows], "doc_id long, text string, source string"
    )).collect()}
    for i, t in rows:
        w = words(t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        assert got[i] == len({p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)})


# 6


def test_language_on_held_out_documents(spark, docs):
    rows = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["rejected"] for r in rows]) < 0.05


def test_language_forward_pass_by_brute_force(spark):
    docs = spark.createDataFrame(
        [(i, prose(i, 30) if i % 2 else "der die das und nicht " * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)],
        "doc_id long, text string, lang string"
    )
    model = language.fit_language(docs, dim=4)
    for t in ("one Two, three", "nicht und", "é", "a", " \n ", "漢字 x"):
        data = b" " + t.lower().encode() + b"   " if t.isascii() else b" " + t.encode() + b"   "
        total, n = np.zeros(len(model.langs)), 0
        for k in language.ORDERS:
            for at in range(len(data) - 3):  # framed by one space in front and as many windows as the text and its frame have
                if at + k > len(data):
                    continue
                code = data[at]
                for j in range(1, k):
                    code = (code * 0x01000193 & 0xFFFFFFFF) ^ data[at + j]
                bucket = ((code * 0x9E3779B1 + k - 1) & 0xFFFFFFFF) >> 16
                total += model.table[:, bucket % language.BUCKETS]
                n += 1
        z = (total / n + model.bias) / model.temperature
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert model.probabilities(model.logits([t.encode()]))[0] == pytest.approx(want, rel=1e-4)


def test_languages_are_bounded_and_letters_are_letters(spark):
    rows = [(i, f"some words of text {i} ab cd", f"free{i}" if i % 3 else "en") for i in range(300)]
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=5)
    assert len(model.langs) == 5 and "en" in model.langs
    none = ["½ ² 3", "Ⅷ ①", "12 _", "🙂"]
    got = language.predict_language(spark.createDataFrame([*enumerate(none), (9, "½ é")], "doc_id long, text string"), model).collect()
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {0, 1, 2, 3}


def test_language_sample_is_bounded_for_any_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = docs.withColumn("doc_id", F.lit(17).cast("long"))
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    same = docs.limit(1).crossJoin(spark.range(3000)).select(*docs.columns)
    for rows, least in ((docs, 100), (one, 100), (none, 0), (same, 0)):
        sizes = [r["count"] for r in language._sample(rows, 30, 200, 20_000, 3, 1).groupBy("lang").count().collect()]
        assert all(n <= 30 for n in sizes) and sum(sizes) >= least
    assert language._sample(same, 30, 200, 20_000, 3, 1).count() <= 1
    got = language.predict_language(one, language.fit_language(one)).collect()
    assert np.mean([r["lang_pred"] == d["lang"] for r, d in zip(got, one.collect(), strict=True) if d["lang"]]) > 0.9
    assert all(r["rejected"] and r["lang_pred"] == "und" for r in language.predict_language(docs, language.fit_language(none)).collect())


# 7


def brute_kneser_ney(texts):
    """p(byte | four bytes) by the definitions, over dictionaries."""
    counts = {5: Counter(x[k : k + 5] for t in texts for x in [b"\n" * 4 + t + b"\n"] for k in range(len(x) - 4))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, total, left = {}, defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        cut[k] = kneserney.discounts(*n)
        for g, v in c.items():
            total[g[:-1]] += v
            left[g[:-1]] += cut[k][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        if not total[g[:-1]]:
            return p(g[1:])
        v = counts[len(g)][g]
        return ((v - cut[len(g)][min(v, 3) - 1]) / total[g[:-1]] if v else 0) + left[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


def test_kneser_ney_by_brute_force(spark):
    learnt = [prose(i, 60).encode() for i in range(6)] + ["é\nß".encode(), b"a"]
    model = kneserney.train(spark.createDataFrame([(i, t.decode()) for i, t in enumerate(learnt)], "doc_id long, text string"))
    p = brute_kneser_ney(learnt)
    for t in (learnt[0], b"alpha beta unheard of", b"x", b"a", "é".encode()):
        x = b"\n" * 4 + t + b"\n"
        logs = [math.log10(p(x[k : k + 5])) for k in range(len(x) - 4)]
        assert kneserney._scores(model, None, [t])[0][0] == pytest.approx(10 ** (-sum(logs) / len(logs)))


def test_discounts_exist_at_every_size():
    for n in ((0, 0, 0, 0), (5, 0, 0, 0), (0, 3, 0, 1), (1000, 400, 200, 100)):
        assert all(0 < d < k for k, d in enumerate(kneserney.discounts(*n), 1))


def test_quality_limits_are_shrunk_means(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    c = kneserney.fit_classifier(docs, labels, per_language=40)
    learnt = {r[0] for r in kneserney._sample(docs, kneserney._trusted(labels), 40, 20_000).select("doc_id").collect()}
    trusted = {r[0] for r in labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").collect()} - learnt
    rows = [r for r in c.scores.collect() if r["doc_id"] in trusted and r["perplexity"] is not None]
    top = lambda v: sorted(v)[math.ceil(0.99 * len(v)) - 1]
    assert len(c.limits["perplexity"]) == 4
    for lang, limit in c.limits["perplexity"].items():
        own = [r["perplexity"] for r in rows if r["lang"] == lang]
        logs = [math.log10(top(v)) for v in (own, [r["perplexity"] for r in rows])]
        assert limit == pytest.approx(10 ** ((len(own) * logs[0] + 50 * logs[1]) / (len(own) + 50)), rel=1e-6)


def test_models_learn_from_every_labelled_document(spark):
    texts = [(i, f"text {i * i} of {i}") for i in range(1500)] + [(1500 + i, "~" * 25_000 + f" long {i}") for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts] + [(3, "again", "en"), (None, "null", "en"), (4, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i, _ in texts] * 2, "doc_id long, quality int, toxic int")
    c = kneserney.fit_classifier(docs, labels)
    learnt = docs.where("text IS NOT NULL").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) != 0).join(labels.distinct(), "doc_id")
    for model, which in zip(c.models.value, ("quality = 1 AND toxic = 0", "toxic = 1"), strict=True):
        want = kneserney.train(learnt.where(which).select("doc_id", "text"))
        for got, of in zip(model.grams + model.contexts, want.grams + want.contexts, strict=True):
            assert (got[0] == of[0]).all() and got[1] == pytest.approx(of[1])
    held = {r[0] for r in docs.select("doc_id").join(learnt, "doc_id", "left_anti").join(labels.where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").collect()}
    seen = [r["perplexity"] for r in c.scores.collect() if r["doc_id"] in held and r["perplexity"] is not None]
    assert c.overall["perplexity"] == pytest.approx(sorted(seen)[math.ceil(0.99 * len(seen)) - 1])


def test_training_is_bounded_for_repeated_ids(spark):
    rows = spark.range(500).selectExpr(
        "cast(6 AS long) AS doc_id", "concat('text number ', id) AS text", "'en' AS lang"
    ).unionByName(spark.range(500).selectExpr("cast(6 AS long) AS doc_id", "'the same' AS text", "'en' AS lang"))
    wanted = spark.createDataFrame([(6,)], "doc_id long")
    sample = kneserney._sample(rows, wanted, 20, 1000)
    assert sample.count() <= 20 and kneserney._learnt(rows, sample).count() == sample.count()


def test_kneser_ney_is_a_distribution(spark):
    df = spark.createDataFrame([(i, prose(i, 200)) for i in range(20)], "doc_id long, text string")
    model = kneserney.train(df)
    for context in (b"alph", b"zzzz", b"\n\n\n\n", b"eta "):
        base = int.from_bytes(context, "big") << 8
        assert (10 ** model.score(np.arange(base, base + 256, dtype=np.uint64))).sum() == pytest.approx(1, abs=1e-9)


def test_quality_separates(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op7_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1 and not r["toxic"]]) > 0.95
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.3


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    toxic = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0)  # never learnt from
    rows = QUERIES["op7_quality_classifier"](spark, sf).join(labels, "doc_id").cache()
    unseen = rows.where("quality = 1").join(toxic, "doc_id", "left_semi").collect()
    assert len(unseen) > 100 and np.mean([r["kept"] for r in unseen]) < 0.3
    assert np.mean([r["kept"] for r in rows.where("quality = 1 AND coalesce(toxic, 0) = 0").collect()]) > 0.97


def test_worst_window_by_brute_force():
    rnd = np.random.default_rng(5)
    sizes = np.array([1, 3, kneserney.WINDOW - 1, kneserney.WINDOW, kneserney.WINDOW + 1, 200, 2])
    odds = rnd.normal(size=sizes.sum())
    for x, text in zip(kneserney._worst(odds, sizes), np.split(odds, np.cumsum(sizes)[:-1]), strict=True):
        w = min(len(text), kneserney.WINDOW)
        assert x == pytest.approx(max(text[k : k + w].mean() for k in range(len(text) - w + 1)), abs=1e-6)


# 8


def brute_components(known, size, share):
    sets = {}
    for d, t in known.items():
        w = lowered(t)
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= share * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("size, share, small, salt", [(4, 85, 48, 4096), (5, 80, 48, 7), (4, 85, 3, 5)])
def test_jaccard_join_is_exact(spark, monkeypatch, size, share, small, salt):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "A_SALT", salt)
    rnd, known = random.Random(size + small), {}
    for g in range(6):  # clusters of near copies of one text, and a passage that all share
        base = (prose(g, 40) + " " + " ".join(f"w{g}{rnd.randint(0, 999)}" for _ in range(60))).split()
        for k in range(25):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 10**6)}"
            known[100 * g + k] = " ".join(w)
    for k in range(60):
        known[1000 + k] = prose(77, 50) + " " + " ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.choice([5, 20, 60])))
    known |= {2000: "", 2001: "one two", 2002: "ONE  two", 2003: None, 2004: "one two three"}
    df = spark.createDataFrame(list(known.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, size, share).collect()}
    assert got == brute_components(known, size, share)


def test_one_of_each_by_brute_force(spark, monkeypatch):
    rnd, rows = random.Random(11), []
    for g in range(40):
        base = [f"w{g}x{i}" for i in range(60)]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(60)] = f"n{rnd.randrange(10**6)}"
            rows += [(rnd.choice([None, *range(50)]), " ".join(w), "x")] * rnd.choice([1, 1, 1, 3])
    rows += [(None, None, "x"), (None, None, "y"), (3, "", "x"), (3, "", "x"), (3, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string").repartition(5)
    parts = brute_components({k: t for k, (_, t, _) in enumerate(rows)}, 5, 80)
    want, empty_ = {}, []
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for k, (d, t, x) in enumerate(rows):
        if not words(t):
            empty_.append((d, t, x))
        else:
            want.setdefault(parts[k][1], []).append((d is None, d or 0, hashed[t], (d, t, x)))
    expect = Counter([min(v)[3] for v in want.values()] + empty_)
    for bits in (64, 1 << 28):  # full bit tables leave most rows to the join
        monkeypatch.setattr(jaccard, "MOST_BITS", bits)
        assert Counter(tuple(r) for r in jaccard.one_of_each(df, size=5, share=80).collect()) == expect


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103)] + [(200, 200 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100, **{200 + k: 200 for k in range(30)}}


def test_word_hashes_are_of_words():
    texts = ["One two  three\n", "", "one TWO", " x", "é one"]
    h, counts, last = wordhash.words_of([t.encode() for t in texts])
    assert counts.tolist() == [3, 0, 2, 1, 2]
    assert h[0] == h[3] == h[7] and h[1] == h[4] and len(set(h.tolist())) == 5
    assert bytes(last.tolist()) == bytes([ord("e"), ord("o"), ord("e"), ord("e"), ord("O"), ord("x"), "é".encode()[-1], ord("e")])


# 9

RULES = {
    "assign": r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+"
}


def brute_secrets(t):
    out = []
    for k, (kind, p) in enumerate(RULES.items()):
        for m in re.finditer(p, t):
            if len(m[1] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_secrets_by_regular_expressions(spark, texts):
    rnd = random.Random(2)
    parts = [
        "password", "passwd", "Secret", "TOKEN", "api_key", "apikey", " ", "=", ":", "'", '"', "abc123", "AKIA", "ABCDEFGH12345678",
        "deadbeef", "é", "_", "-", "\n", "0f"
    ]
    more = {10_000 + i: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for i in range(400)}
    known = texts | more
    rows = secrets.find_secrets(spark.createDataFrame(list(known.items()), "doc_id long, text string"), redact=True).collect()
    for r in rows:
        base = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] in secrets.BASE_KINDS)
        assert base == brute_secrets(known[r["doc_id"]])
    assert any("[github]" in r["redacted"] or "[assign]" in r["redacted"] for r in rows)


# 10


def test_jpeg_round_trip(spark, docs, texts):
    rows = jpeg.read_media(jpeg.text_media(docs)).collect()
    for r in rows:
        t = texts[r["doc_id"]].encode()
        size = max(576, -(-len(t) // 576) * 576)
        assert bytes(r["thumbnail"]) == t.ljust(size, b"\xff") and r["n_bytes"] == len(t)
        assert bytes(r["media"])[:2] == b"\xff\xd8" and bytes(r["media"])[-2:] == b"\xff\xd9"
        assert r["width"] * r["height"] == 64 * size


def test_jpeg_of_a_very_long_text():
    payload = bytes(i * i % 251 for i in range(576 * 400))
    (media,) = jpeg.encode_payloads([payload])
    assert b"".join(i.tobytes() for i in jpeg.thumbnails([media])[0]) == payload


def coded(rnd, width, height, sampling, interval=0, apart=False, wide_tables=False):
    """(a baseline JPEG of random coefficients, the luminance samples its DC values stand for), coded bit by bit. apart: a scan for each component."""
    dc, ac = list(range(10)), [0, 0xF0, *(r << 4 | s for r in range(0, 15, 3) for s in range(1, 6))]
    length = {s: 5 for s in dc} if wide_tables else {s: 4 for s in dc}
    code = {0: {s: (length[s], k) for k, s in enumerate(dc)}, 1: {s: (6, k) for k, s in enumerate(ac)}}
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + bytes(b)
    table = lambda kind, of, size: seg(0xC4, bytes([kind << 4]) + bytes([len(of) if k == size else 0 for k in range(1, 17)]) + bytes(of))
    hmax, vmax, q = max(h for h, _ in sampling), max(v for _, v in sampling), 3
    out = b"\xff\xd8" + seg(0xFE, b"made by a test") + seg(0xDB, bytes([0] + [q] * 64)) + seg(0xDB, bytes([0x11] + [0, 9] * 64))
    out += seg(
        0xC0,
        bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(
            bytes([k + 1, h << 4 | v, k > 0]) for k, (h, v) in enumerate(sampling)
        )
    )
    out += table(0, dc, length[0]) + table(1, ac, 6) + (seg(0xDD, interval.to_bytes(2, "big")) if interval else b"")
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    grids = [np.array([[rnd.randint(-200, 200) for _ in range(across * h)] for _ in range(down * v)]) for h, v in sampling]

    def scan(parts):
        single = len(parts) == 1
        if single:
            h, v = sampling[parts[0]]
            wide, high = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
            units = [[(parts[0], y, x)] for y in range(high) for x in range(wide)]
        else:
            units = [[(
                c, y * sampling[c][1] + j, x * sampling[c][0] + i
            ) for c in parts for j in range(sampling[c][1]) for i in range(sampling[c][0])] for y in range(down) for x in range(across)]
        data = seg(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([0, 63, 0]))
        bits, pred = "", {}
        put = lambda kind, s, value, n: format(code[kind][s][1], f"0{code[kind][s][0]}b") + (format(
            value if value >= 0 else value + (1 << n) - 1, f"0{n}b"
        ) if n else "")

        def flushed():
            raw = bits + "1" * (-len(bits) % 8)
            return bytes(int(raw[k : k + 8], 2) for k in range(0, len(raw), 8)).replace(b"\xff", b"\xff\0")

        for k, unit in enumerate(units):
            if interval and k and k % interval == 0:
                data += flushed() + bytes([0xFF, 0xD0 + (k // interval - 1) % 8])
                bits, pred = "", {}
            for c, y, x in unit:
                diff = int(grids[c][y, x]) - pred.get(c, 0)
                pred[c] = int(grids[c][y, x])
                n = abs(diff).bit_length()
                bits += put(0, n, diff, n)
                at = 0
                while at < 63 and rnd.random() < 0.6:
                    if at + 16 < 63 and rnd.random() < 0.1:
                        bits += put(1, 0xF0, 0, 0)
                        at += 16
                        continue
                    run, n = rnd.choice(range(0, 15, 3)), rnd.randint(1, 5)
                    if at + run + 1 > 63:
                        break
                    value = rnd.choice([-1, 1]) * rnd.randint(1 << n - 1, (1 << n) - 1)
                    bits += put(1, run << 4 | n, value, n)
                    at += run + 1
                if at < 63:
                    bits += put(1, 0, 0, 0)
        return data + flushed()

    order = [[c] for c in range(len(sampling))] if apart else [list(range(len(sampling)))]
    for parts in order:
        out += scan(parts)
    h, v = sampling[0]
    seen = np.clip((grids[0] * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return out + b"\xff\xd9", seen[: -(-height * v // (8 * vmax)), : -(-width * h // (8 * hmax))]


def test_jpeg_of_any_baseline_kind():
    rnd, media, want = random.Random(8), [], []
    for sampling in (
        [(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1)], [(1, 1), (1, 1), (1, 1)],
        [(4, 1), (1, 1), (2, 1), (1, 1)]
    ):
        for interval in (0, 3):
            for apart in (False, True):
                for width, height in ((8, 8), (37, 50), (90, 17)):
                    m, w = coded(rnd, width, height, sampling, interval, apart, wide_tables=interval > 0)
                    media.append(m)
                    want.append(w)
    for got, w in zip(jpeg.thumbnails(media), want, strict=True):
        assert isinstance(got, list) and len(got) == 1 and got[0].tolist() == w.tolist()


def test_bad_media_are_rows(spark):
    good = jpeg.encode_payloads([bytes(range(192)) * 3])[0]
    other, _ = coded(random.Random(1), 40, 40, [(2, 2), (1, 1), (1, 1)])
    head = other.index(b"\xff\xda")
    bad = {
        2: b"", 3: b"no image", 4: good[:-2], 5: good[: len(good) // 2], 6: b"\xff\xd8\xff\xd9", 7: other[: head + 20] + b"\xff\xd9",
        8: good + other, 9: other.replace(b"\xff\xc0", b"\xff\xc2"), 10: good[:-40] + good[-2:]
    }
    rows = [(0, good), (1, None), *bad.items(), (20, other)]
    got = {r["k"]: r for r in jpeg.read_media(spark.createDataFrame(rows, "k int, media binary").coalesce(1)).collect()}
    assert bytes(got[0]["thumbnail"]) == bytes(range(192)) * 3 and got[0]["error"] is None and got[20]["error"] is None and got[20]["width"] == 40
    assert got[1]["error"] is None and got[1]["thumbnail"] is None
    assert all(got[k]["error"] and got[k]["thumbnail"] is None and got[k]["width"] is None for k in bad), {k: got[k]["error"] for k in bad}


def test_mean_hash_by_brute_force():
    rnd = np.random.default_rng(3)
    for shape in ((24, 24), (48, 24), (9, 13), (8, 8), (3, 5)):
        x = rnd.integers(0, 256, shape)
        edge = lambda n: [k * n // 8 for k in range(9)]
        rows, cols = edge(shape[0]), edge(shape[1])
        means = [
            np.mean([x[i][j] for i in range(a, max(a + 1, b)) for j in range(c, max(c + 1, d))]) for a, b in itertools.pairwise(rows) for c,
            d in itertools.pairwise(cols)
        ]
        assert jpeg.mean_hash(x) == int("".join("1" if m > np.mean(means) + 1e-9 else "0" for m in means), 2)


# awkward and empty tables


def labels_for(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 1, 0), (8, 1, None), (9, 0, 1), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "packing": lambda s, d: packing.pack_documents(d).groupBy("doc_id", "doc_tokens").count(), "pieces": lambda s, d: pieces.encode_decode(d), "brown": lambda s, d: brown.brown_scores(d), "lines": lambda s, d: linefreq.line_quality(d),
    "language": lambda s, d: language.predict_language(d, language.fit_language(d)), "quality": lambda s, d: kneserney.classify_quality(d, labels_for(s)), "jaccard": lambda s, d: jaccard.jaccard_components(d),
    "secrets": lambda s, d: secrets.find_secrets(d), "jpeg": lambda s, d: jpeg.read_media(jpeg.text_media(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_all_come_back(spark, name):
    d = awkward(spark)
    rows = OPERATORS[name](spark, d).collect()
    ids = Counter(r["doc_id"] for r in rows)
    if name == "packing":
        assert set(ids) == {r["doc_id"] for r in d.collect()}
    else:
        assert ids == Counter(r["doc_id"] for r in d.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_no_rows(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(none).count() == 0


def test_awkward_pages(spark):
    pages = spark.createDataFrame(
        [(None, None, None, 1), (2, None, "x" * 1000, 2), (2, "u v", "x" * 1000, 3), (None, "u", "x" * 1000, 4)],
        "page_id long, url string, html string, payload int"
    )
    rows = warc.archive_pages(pages).collect()
    assert len(rows) == 4 and all(r["request"] and len(r["metadata"]) == 1 for r in rows)
