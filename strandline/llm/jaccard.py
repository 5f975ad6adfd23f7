"""Exact n-gram Jaccard join: a grouped prefix join whose links make components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_texts, texts_of, written
from .components import components
from .wordhash import frequent_in_chunks, mix, shingle_sets

SMALL = 8  # members of a list whose pairs are all tried
MOST_FREQUENT = 4_000_000  # bound of the set of frequent shingles: 32 MB
A_SALT = 4096  # rows of a list, about, that meet in one task
BLOCK = 1 << 20


def _sets(batches, size: int):
    for batch in blocks(batches, BLOCK):
        yield batch, list(shingle_sets(byte_texts(batch), size))


def frequent_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """The sorted hashes of shingles that have at least one MOST_FREQUENT-th of all (document, shingle) pairs, so MOST_FREQUENT at most; all
    texts are counted."""

    def run(batches):
        return frequent_in_chunks((s for _, sets in _sets(batches, size) for s in sets), MOST_FREQUENT, 2)

    counts = written(texts.mapInArrow(run, "key long, count long").groupBy("key").agg(F.sum("count").alias("count")), "frequent")
    total = counts.where("key IS NULL").select("count").first()
    least = max(24, (total[0] if total else 0) / MOST_FREQUENT)
    rows = counts.where(F.col("key").isNotNull() & (F.col("count") >= least)).select("key").toArrow()
    return np.sort(rows["key"].to_numpy().astype(np.int64).view(np.uint64))


def _digest(own: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _parity(own: np.ndarray) -> list[int]:
    """A power of two of bits, at least as many as the set has members: each member flips one. Two sets differ in at least as many members
    as their bits differ."""
    size = 64
    while size < len(own):
        size *= 2
    bits = np.bincount((mix(own) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8").tolist()


def _describe(size: int, share: int, frequent):
    def run(batches):
        often = frequent.value
        for batch, sets in _sets(batches, size):
            rows = {k: [] for k in ("n", "s1", "s2", "group", "prefix", "bits")}
            for own in sets:
                n = len(own)
                if n and len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    last = often[at] == own
                    own_order = np.concatenate([own[~last], own[last]])
                else:
                    own_order = own
                prefix = own_order[: n - (share * n + 99) // 100 + 1] if n else own
                s1, s2 = _digest(own)
                for k, v in (
                    ("n", n), ("s1", s1), ("s2", s2), ("group", _digest(prefix)[0]), ("prefix", prefix.view(np.int64)),
                    ("bits", _parity(own) if n else [])
                ):
                    rows[k].append(v)
            types = {"n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "group": pa.int64(), "prefix": pa.list_(pa.int64()), "bits": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(rows[k], t) for k, t in types.items()]], ["doc_id", "text_hash", *types]
            )

    return run


def _distinct_sets(size: int):
    """The sets of texts, each once a task."""

    def run(batches):
        seen = set()
        for part in blocks(batches):
            found = []
            for own in shingle_sets(byte_texts(part), size):
                key = _digest(own)
                if key not in seen:
                    seen.add(key)
                    found.append((*key, own.view(np.int64)))
            if found:
                a, b, c = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.int64()))], ["s1", "s2", "members"])

    return run


LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27  # 16 MB at most; a fuller table lets more through to the exact join


def _bit_words(df: DataFrame, column: str, each: int = 16) -> tuple[DataFrame, int]:
    """(word, bits: the words of a table with a bit for each number in the column that have any; the table's size in bits, at least `each` a
    number up to MOST_BITS)."""
    size = min(MOST_BITS, max(LEAST_BITS, each << df.count().bit_length()))
    at = df.select(F.expr(f"{column} & {size - 1}").alias("at"))
    return at.selectExpr("at >> 6 AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")), size


def _bit_table(df: DataFrame, column: str, each: int = 16) -> np.ndarray:
    """Such a table's bytes. Its words are made in Spark; the table is all that is gathered."""
    words, size = _bit_words(df, column, each)
    got = words.toArrow()
    table = np.zeros(size // 64, dtype="<i8")
    table[got["word"].to_numpy()] = got["bits"].to_numpy()
    return table.view(np.uint8)


def _with_hit(rows: DataFrame, words: DataFrame, size: int, name: str) -> DataFrame:
    """rows with a column that says whether the bit of their hash is in the table, whose words are bounded by MOST_BITS and broadcast."""
    table = F.broadcast(words.select(F.col("word").alias("word_"), F.col("bits").alias("bits_")))
    met = rows.join(table, F.expr(f"(hash & {size - 1}) >> 6") == F.col("word_"), "left")
    return met.withColumn(name, F.coalesce(F.getbit("bits_", F.expr("cast(hash & 63 AS int)")) == 1, F.lit(False))).drop("word_", "bits_")


def _hits(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers & (8 * len(table) - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _postings(wanted):
    """Rows (row_id, n, pos, token) of the prefix shingles whose bit is set."""

    def run(batches):
        table = wanted.value
        for batch in batches:
            prefix = batch.column(2)
            sizes = np.diff(prefix.offsets.to_numpy())
            tokens = prefix.flatten().to_numpy()
            keep = np.flatnonzero(_hits(table, tokens))
            row = np.repeat(np.arange(len(sizes)), sizes)[keep]
            pos = keep - (np.cumsum(sizes) - sizes)[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(pos, pa.int32()), pa.array(tokens[keep], pa.int64())],
                ["row_id", "n", "pos", "token"]
            )

    return run


def _differ(a: Column, b: Column) -> Column:
    """At least how many members two sets differ in, by their parity bits; the longer table is folded."""
    q = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda v: F.when(F.size(v) > q, F.zip_with(F.slice(v, F.lit(1), q), F.slice(v, q + 1, q), xor)).otherwise(v)
    return F.aggregate(F.zip_with(fold(a), fold(b), xor), F.lit(0), lambda total, x: total + F.bit_count(x))


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column, share: int) -> Column:
    """Whether sets of sizes n1, n2 whose first common shingle has places p1, p2 in them can be linked: what follows must hold the whole overlap.

    A linked pair fits at its first common shingle, so the test may be made at each common shingle alone."""
    return (100 + share) * F.least(n1 - p1, n2 - p2) >= share * (n1 + n2)


def _ways(rows) -> Column:
    """Salts of a list of so many rows."""
    return F.ceil(rows / F.lit(A_SALT)).cast("int")


def _salt(cid: str = "cid") -> Column:
    return F.pmod(F.xxhash64(cid), F.col("ways")).cast("int")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("ways") - 1))


def _resolve(lists: DataFrame, classes: DataFrame, fetch: Callable[[DataFrame], DataFrame], share: int) -> DataFrame | None:
    """Links (a, b) that connect all classes which any pair of linked members of any list (key, ways, cid, n, pos) connects.

    Only pairs from different components need a test, and only those that size and place allow. Lists with SMALL members or fewer have all of
    those tried. In a longer one the members outside its largest component are outliers. First the member with the least place, which
    has the fewest shingles of its own, meets all others; in later rounds outliers do, as many as the list's length allows, four times as many
    each round, and then leave it. A list ends when all its outliers have met everyone or its members are in one component. Nothing is
    dropped otherwise, so the result is exact, and near copies by the thousand cost a few comparisons each. `fetch` gives
    whole sets (cid, members) of the classes asked for: those of pairs that pass the filters.

    A list may hold a third of all classes: it has `ways` salts, by its length, so its rows meet their list's sums and pivots by (key, salt)."""
    links, roots, turn = None, None, 0
    side = lambda name: classes.select(F.col("cid").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    while True:
        if roots is None:
            now = lists.withColumn("root", F.col("cid"))
        else:
            now = lists.join(roots, lists["cid"] == roots["node"], "left").select("key", "ways", "cid", "n", "pos", F.coalesce("root", "cid").alias("root"))
        shares = now.groupBy("key", "root").agg(F.count("*").alias("c"), F.max("ways").alias("ways"))
        tops = shares.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"), F.max("ways").alias("ways"))
        tops = tops.where(F.col("m") > F.col("top.c")).select(
            "key", "m", F.col("top.root").alias("top"), (F.col("m") - F.col("top.c")).alias("out"), _salts().alias("salt")
        )
        now = written(now.withColumn("salt", _salt()).join(tops, ["key", "salt"]), "lists")
        if now.isEmpty():
            return links
        small, large = now.where(F.col("m") <= SMALL), now.where(F.col("m") > SMALL)
        part = lambda df, i: df.select(
            "key", "ways", F.col("cid").alias(f"c{i}"), F.col("n").alias(f"n{i}"), F.col("pos").alias(f"p{i}"), F.col("root").alias(f"r{i}")
        )
        may = (F.col("r1") != F.col("r2")) & _may_link(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"), share)
        pairs = part(small, 1).join(part(small, 2).drop("ways"), "key").where(may & (F.col("c1") < F.col("c2"))).select(
            F.col("c1").alias("a"), F.col("c2").alias("b")
        )
        order = F.struct("pos", F.xxhash64("cid"))
        if turn == 0:
            first = large.groupBy("key").agg(F.min_by("cid", order).alias("first"))
            pivots, left = large.join(first, "key").where("cid = first"), large
        else:
            most = F.greatest(F.lit(2 * 4**turn), F.floor(2_000_000 / F.col("m")))
            pivots = large.where((F.col("root") != F.col("top")) & (F.pmod(F.xxhash64("cid", F.lit(turn)), F.ceil(F.col("out") / most)) == 0))
            left = large.where(F.col("out") > most)
        met = part(large, 1).withColumn("salt", _salt("c1")).join(
            part(pivots, 2).withColumn("salt", _salts()).drop("ways"), ["key", "salt"]
        ).where(may).select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"))
        pairs = pairs.unionByName(met).distinct()
        pairs = pairs.join(side("a"), "a").join(side("b"), "b")
        apart = F.greatest(F.abs(F.col("n_a") - F.col("n_b")), _differ(F.col("bits_a"), F.col("bits_b")))
        # intersection <= (both - apart) / 2 and union >= (both + apart) / 2
        pairs = pairs.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both"), apart.alias("apart"))
        likely = written(pairs.where(100 * (F.col("both") - F.col("apart")) >= share * (F.col("both") + F.col("apart"))).select("a", "b", "both"), "likely")
        if not likely.isEmpty():
            sets = fetch(likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
            full = likely.join(
                sets.select(F.col("cid").alias("a"), F.col("members").alias("set_a")), "a"
            ).join(sets.select(F.col("cid").alias("b"), F.col("members").alias("set_b")), "b")
            common = F.size(F.array_intersect("set_a", "set_b"))
            found = written(full.where(100 * common >= share * (F.col("both") - common)).select("a", "b"), "links")
            links = found if links is None else links.unionByName(found)
            roots = components(links)
        lists = left.select("key", "ways", "cid", "n", "pos").join(pivots.select("key", "cid"), ["key", "cid"], "left_anti")
        turn += 1


def jaccard_components(docs: DataFrame, size: int = 4, share: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row_id, doc_id, text_hash, n_shingles, component_id (the least doc_id of those reached by links of a Jaccard
    similarity of share/100 or more), component (a number that only they share; null without shingles).

    Documents are sets of distinct `size`-word shingles (64-bit hashes), put in one global order: frequent shingles last, otherwise by hash.
    Equal sets are one class; classes with equal prefixes and sizes are one group. Groups that share a prefix shingle are paired and
    filtered by size and position, the remaining pairs and the groups themselves are expanded into their members, and members are filtered
    by parity bits and verified on whole sets.

    Null or empty text, or none but separators: no shingles, linked with nothing, component_id = doc_id. Null doc_ids: rows of their own; a
    component whose ids are all null has a null id. Repeated ids and rows: copies like others. Empty table: no rows. Other columns are not
    read. Texts are never shuffled: two maps read them, and one more for each round of candidates, which shingles those alone. What is
    shuffled are prefixes, and the sets of candidates. Joins on a token or a component are plain, for adaptive execution to split; a long
    list's own joins are salted."""
    spark = docs.sparkSession
    texts = texts_of(docs, doc_id, text)
    frequent = spark.sparkContext.broadcast(frequent_shingles(texts, size))
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    described = hashed.mapInArrow(
        _describe(size, share, frequent),
        "doc_id long, text_hash long, n long, s1 long, s2 long, `group` long, prefix array<long>, bits array<long>"
    )
    rows = written(described.withColumn("row_id", F.monotonically_increasing_id()), "sets")
    classes = written(rows.where("n > 0").groupBy("n", "s1", "s2", "group").agg(F.min("row_id").alias("cid"), F.min("doc_id").alias("first_doc")), "classes")
    groups = classes.groupBy("n", "group").agg(F.min("cid").alias("gid"), F.count("*").alias("k"))
    members = written(classes.join(groups, ["n", "group"]).select("gid", "cid", "n", "k"), "members")
    leads = members.where("gid = cid").select("gid", "k")
    # most shingles are in one prefix only, and go before anything else is joined
    twice = written(rows.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "twice")
    table = spark.sparkContext.broadcast(_bit_table(twice, "token", 4))
    shown = rows.where("n > 0").select("row_id", "n", "prefix").mapInArrow(_postings(table), "row_id long, n long, pos int, token long")
    shown = written(shown.join(leads, shown["row_id"] == leads["gid"]).select("gid", "n", "pos", "token", "k"), "postings")
    often = shown.groupBy("token").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.sum("k").alias("size")).where("m > 1")
    shared = shown.join(often, "token")
    # who can't be linked with any member of the list, whose sizes are `least` or more, needs no place in it
    partner = F.greatest("least", F.ceil(F.col("n") * share / F.lit(100)))
    shared = written(shared.where(_may_link(F.col("n"), F.col("pos"), partner, F.lit(0), share)), "tokens")
    # group pairs of short lists, by size and place
    one = shared.where(F.col("m") <= SMALL)
    x, y = (one.select("token", F.col("gid").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("pos").alias(f"p{i}"), F.col("k").alias(f"k{i}")) for i in (1, 2))
    pairs = x.join(y, "token").where((F.col("g1") < F.col("g2")) & _may_link(
        F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"), share
    )).select("g1", "g2", "k1", "k2").distinct()
    pairs = pairs.select(
        F.xxhash64("g1", "g2").alias("key"), _ways(F.col("k1") + F.col("k2")).alias("ways"), F.explode(F.array("g1", "g2")).alias("gid"),
        F.lit(0).alias("pos")
    )
    long_ = shared.where(F.col("m") > SMALL).select(F.col("token").alias("key"), _ways(F.col("size")).alias("ways"), "gid", "pos")
    alike = members.where("k > 1 AND gid = cid").select(F.col("gid").alias("key"), _ways(F.col("k")).alias("ways"), "gid", F.lit(0).alias("pos"))
    # keys are hashes of unlike things; should two be equal, their lists are one longer list, with the ways of the longer, which loses nothing
    lists = pairs.unionByName(long_).unionByName(alike)
    lists = written(lists.join(members.select("gid", "cid", "n"), "gid").select("key", "ways", "cid", "n", "pos"), "lists")

    def fetch(cids: DataFrame) -> DataFrame:
        wanted = rows.join(cids, rows["row_id"] == cids["cid"]).select("cid", "s1", "s2", "text_hash")  # a class is the row it is named after
        wanted = written(wanted, "wanted")
        if wanted.isEmpty():
            return spark.createDataFrame([], "cid long, members array<long>")
        # of other texts few have a bit of the table; only those that do go to Python
        words, bits = _bit_words(wanted, "text_hash")
        near = _with_hit(hashed.select(F.col("text_hash").alias("hash"), "text"), words, bits, "hit").where("hit").select("text")
        found = near.mapInArrow(_distinct_sets(size), "s1 long, s2 long, members array<long>").dropDuplicates(["s1", "s2"])
        return written(found.join(wanted, ["s1", "s2"]).select("cid", "members"), "members")

    bits = rows.join(lists.select("cid").distinct(), rows["row_id"] == F.col("cid")).select("cid", "n", "bits")
    links = _resolve(lists, written(bits, "bits"), fetch, share)
    if links is None:
        known = classes.select("n", "s1", "s2", F.col("first_doc").alias("component_id"), F.col("cid").alias("component"))
    else:
        roots = components(links)
        least = classes.join(roots, classes["cid"] == roots["node"]).groupBy("root").agg(F.min("first_doc").alias("least"))
        least = written(roots.join(least, "root").select(F.col("node").alias("cid"), "least", "root"), "roots")
        known = classes.join(least, "cid", "left").select(
            "n", "s1", "s2", F.when(F.col("root").isNull(), F.col("first_doc")).otherwise(F.col("least")).alias("component_id"),
            F.coalesce("root", "cid").alias("component")
        )
    out = rows.select("row_id", "doc_id", "text_hash", "n", "s1", "s2").join(known, ["n", "s1", "s2"], "left")
    some = F.col("n") > 0
    return out.select(
        "row_id", "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("component")).alias("component")
    )


def _verdicts(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text_hash, hash (of both), copies, stays: of each component the row with the least doc_id (null ids last) and text hash. Rows
    without shingles all stay, and count as one copy."""
    marked = written(jaccard_components(docs, **how).select("doc_id", "text_hash", "component"), "marked")
    first = marked.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"
    )).alias("first"))
    first = first.select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("text"))
    keys = marked.groupBy("doc_id", "text_hash").agg(F.greatest(F.lit(1), F.count("component")).alias("copies"), F.count("component").alias("some"))
    out = keys.join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("text")), "left")
    return written(
        out.select(
            "doc_id", "text_hash", F.xxhash64("doc_id", "text_hash").alias("hash"), "copies",
            (F.col("text").isNotNull() | (F.col("some") == 0)).alias("stays")
        ),
        "verdicts"
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs, with all columns, but of each component the row with the least doc_id and text hash only (null ids last). Rows without words stay, all of them.

    Verdicts are by doc_id and text hash; of equal rows one stays. Texts aren't shuffled for them: a bit table of the keys that go and one of the keys that
    stay though the first table has their bit, or that several rows share, decide for most rows where they are read; only rows with a bit in the second
    table (of the rows that stay some 3 in 100, of those that go fewer) meet their verdict by a join."""
    keys = _verdicts(docs, **how)
    away = keys.where("NOT stays")
    if away.isEmpty() and keys.where("copies > 1").isEmpty():
        return docs
    gone, gone_size = _bit_words(away, "hash")
    gone = written(gone, "gone")
    near = _with_hit(keys.where("stays"), gone, gone_size, "hit").where("hit OR copies > 1").select("hash")
    doubted, doubted_size = _bit_words(written(near, "doubted"), "hash")
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), text_hash.alias("of")
    ).withColumn("hash", F.xxhash64("id", "of"))
    rows = _with_hit(_with_hit(rows, gone, gone_size, "goes"), written(doubted, "words"), doubted_size, "doubt")
    kept = rows.where("NOT doubt AND NOT goes").select("row")
    keys = keys.drop("hash")
    met = rows.where("doubt").join(keys, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("text_hash"))).where("stays")
    once = met.where("copies = 1").select("row")
    several = met.where("copies > 1").dropDuplicates(["id", "of"]).select("row")
    return kept.unionByName(once.unionByName(several)).select("row.*")
