"""License scans: a positional index of the rarest words of license notices, alignments by relative position, and key phrases. DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Phrases and the labels they stand for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices: label, words, key phrases that must stand where the notice has them. Several notices may share a label.
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted", "any person obtaining a copy")
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this program is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc0-1.0", "released under cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    (
        "bsd", "redistribution and use in source and binary forms with or without modification are permitted",
        ("redistribution and use in source and binary forms",)
    ),
    (
        "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "is hereby granted")
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
)

#: Where A-Z become a-z and all other ASCII that is no letter or digit becomes a space.
_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
_OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
MOST_WORDS = 1_000_000  # of all notices, which every task holds


@dataclass(frozen=True)
class Notice:
    """A notice: its number, label, words in order, and the places of the words of its key phrases."""

    number: int
    label: str
    words: tuple[str, ...]
    must: frozenset[int]


def notices(given=NOTICES) -> list[Notice]:
    """The notices by number. ValueError for one without words or a phrase that it doesn't have, or for more than MOST_WORDS words."""
    out = []
    for k, (label, text, phrases) in enumerate(given):
        own, must = re.findall("[0-9a-z]+", text.lower()), set()
        for phrase in phrases:
            p = re.findall("[0-9a-z]+", phrase.lower())
            at = next((i for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p), None) if p else None
            if at is None:
                raise ValueError(f"{label}: {phrase!r} is no phrase of the notice")
            must.update(range(at, at + len(p)))
        if not must:
            raise ValueError(f"{label}: a notice needs a key phrase")
        out.append(Notice(k, label, tuple(own), frozenset(must)))
    if sum(len(n.words) for n in out) > MOST_WORDS:
        raise ValueError(f"the notices have more than {MOST_WORDS} words")
    return out


def _stands(hits: Column, words: list[str]) -> Column:
    """Places where the words stand one after another; hits are the known words of a text with their places, in order."""

    def start(h: Column, i: Column) -> Column:
        found = h["word"] == words[0]
        for k, w in enumerate(words[1:], 1):
            other = F.get(hits, i + k)
            found = found & (other["word"] == w) & (other["at"] == h["at"] + k)
        return F.when(found, h["at"])

    return F.array_compact(F.transform(hits, start))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER)), " "), "")


def known_words(docs: DataFrame, vocabulary: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, doc_id, n_words, hits: of each text the words of the vocabulary with their places, in order."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.withColumn("words", _words(F.col("text")))  # used twice below, so that Spark computes it once
    hits = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("word"))))
    return rows.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.size("words").cast("long").alias("n_words"),
        F.array_compact(hits).alias("hits")
    )


def _rarity(files: DataFrame) -> dict[str, int]:
    """In how many files each known word is: one number a word of the vocabulary, counted over all files."""
    rows = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in rows.collect()}


def _alignments(files: DataFrame, known: list[Notice], rare_words: int, least_votes: int, least_share: float) -> DataFrame:
    """row_id, number, share of each notice that stands at some place of a file."""
    spark, idf = files.sparkSession, _rarity(files)
    # highest inverse document frequency first; words that no file has can't be looked up
    order = lambda words: sorted({w for w in words if w in idf}, key=lambda w: (idf[w], w))
    names = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    table = [(n, order(n.words), sorted({n.words[k] for k in n.must})) for n in known]
    literal = F.array(*[F.struct(F.lit(n.number).alias("number"), names(own).alias("words"), names(must).alias("must")) for n, own, must in table])
    # a file looks up, for each notice whose key phrases it may have, the rarest words that it shares with it
    words = F.array_distinct(F.transform("hits", lambda h: h["word"]))
    may = files.where(F.size("hits") > 0).select("row_id", "hits", words.alias("own"))
    possible = F.filter(literal, lambda n: F.size(F.array_except(n["must"], F.col("own"))) == 0)
    looked = F.transform(
        possible,
        lambda n: F.struct(n["number"].alias("number"), F.slice(F.array_intersect(n["words"], F.col("own")), 1, rare_words).alias("words"))
    )
    may = written(may.withColumn("looked", looked).where(F.size("looked") > 0).select("row_id", "hits", "looked"), "looked")
    postings = spark.createDataFrame([(w, n.number, k) for n in known for k, w in enumerate(n.words)], "word string, number int, pos int")
    index = F.broadcast(postings)  # MOST_WORDS rows at most
    asked = F.flatten(F.transform("looked", lambda n: n["words"]))
    probes = may.select("row_id", "looked", F.explode(F.filter("hits", lambda h: F.array_contains(asked, h["word"]))).alias("hit"))
    probes = probes.select("row_id", "looked", F.col("hit.at").alias("at"), F.col("hit.word").alias("word")).join(index, "word")
    probes = probes.where(F.exists("looked", lambda n: (n["number"] == F.col("number")) & F.array_contains(n["words"], F.col("word"))))
    # hits that agree on where the notice begins
    votes = probes.groupBy("row_id", "number", (F.col("at") - F.col("pos")).alias("shift")).count().where(F.col("count") >= least_votes)
    votes = written(votes.select("row_id", "number", "shift"), "votes")
    full = [(n.number, k, w, int(k in n.must), len(n.must), len(n.words)) for n in known for k, w in enumerate(n.words)]
    whole = F.broadcast(spark.createDataFrame(full, "number int, pos int, word string, must int, musts int, size int"))
    wanted = votes.join(whole, "number").withColumn("at", F.col("shift") + F.col("pos"))
    there = may.join(votes.select("row_id").distinct(), "row_id", "left_semi").select("row_id", F.explode("hits").alias("hit")).select(
        "row_id", F.col("hit.at").alias("at"), F.col("hit.word").alias("word")
    )
    found = wanted.join(there, ["row_id", "at", "word"]).groupBy("row_id", "number", "shift", "musts", "size").agg(
        F.sum("must").alias("must"), F.count("*").alias("words")
    )
    share = F.col("words") / F.col("size")
    found = found.where((F.col("must") == F.col("musts")) & (share >= least_share)).groupBy("row_id", "number").agg(F.max(share).alias("share"))
    return found


def license_labels(
    docs: DataFrame, given=NOTICES, phrases: dict[str, str] = PHRASES, rare_words: int = 6, least_votes: int = 2, least_share: float = 0.5, **columns
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word (of the base phrases' places), base_labels, labels (base and
    notices; arrays in order), score.

    A notice stands in a file if at least least_votes of the rarest words they share (rare_words at most, the highest inverse document
    frequency over all files first) agree on where it begins, all words of its key phrases stand where they then must, and at least the
    share least_share of its words do. The score is the greatest such share; a base phrase counts as found whole; 0 without any.

    Null or empty text: no words, no labels, score 0. Null or repeated ids: rows of their own. Empty table: no rows. Other columns are not
    read. Texts are read once and never shuffled: each file keeps only the words that notices have, with their places. Notices (MOST_WORDS
    words at most) are broadcast; what is shuffled are places of rare words of files that may have a notice, by (file, notice, place), so no
    word of many files is a key."""
    known = notices(given)
    base = {tuple(re.findall("[0-9a-z]+", p.lower())): label for p, label in phrases.items()}
    vocabulary = sorted({w for n in known for w in n.words} | {w for p in base for w in p})
    files = written(known_words(docs, vocabulary, **columns), "files")
    label_of = F.create_map(*[F.lit(x) for n in known for x in (n.number, n.label)]) if known else None
    places = [(_stands(F.col("hits"), list(p)), label) for p, label in base.items()]
    rows = files.select("row_id", "doc_id", "n_words", F.array(*[F.struct(at.alias("at"), F.lit(label).alias("label")) for at, label in places]).alias("base"))
    every = F.flatten(F.transform("base", lambda b: b["at"]))
    rows = rows.select(
        "row_id", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"]))).alias("base_labels"),
    )
    none = F.array().cast("array<string>")
    own = _alignments(files, known, rare_words, least_votes, least_share).groupBy("row_id").agg(
        F.collect_set(label_of[F.col("number")]).alias("more"), F.max("share").alias("share")
    )
    out = rows.join(own, "row_id", "left")
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("share", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("more", none))).alias("labels"), score.alias("score")
    )
