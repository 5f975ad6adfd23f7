"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, perplexity limits by language, and limits of how much
likelier a model of toxic texts makes a stretch."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_texts, least_hashed, texts_of, written

ORDER = 5  # bytes; an n-gram is a number of 8 bits a byte
_PAD = b"\n" * (ORDER - 1)
WINDOW = 24  # bytes over which the two models are compared
BLOCK = 1 << 18
KINDS = TRUSTED, TOXIC = 1, 2  # of texts that are learnt from, bits


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the ORDER-gram that ends at each byte and at one line end after the text, text after text; how many each text has)."""
    data = np.frombuffer(b"".join(_PAD + t + b"\n" for t in texts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    code = np.zeros(max(0, len(data) - ORDER + 1), dtype=np.uint64)
    for k in range(ORDER):
        code <<= np.uint64(8)
        code |= data[k : k + len(code)]
    keep = np.ones(len(code), dtype=bool)
    ends = np.cumsum(sizes + ORDER - 1)[:-1]
    for k in range(1, ORDER):
        keep[ends - k] = False  # would begin in one text and end in the next
    return code[keep], sizes


def _count(batches):
    for batch in blocks(batches, 4 << 20):
        codes, counts = np.unique(_codes(byte_texts(batch))[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts, pa.int64())], ["code", "c"])


def _count_kinds(batches):
    """_count of texts with kinds (sets of bits), for each kind by itself."""
    for batch in blocks(batches, 4 << 20):
        for kind in KINDS:
            own = batch.filter(pc.not_equal(pc.bit_wise_and(batch.column(batch.schema.names.index("kinds")), kind), 0))
            if own.num_rows:
                codes, counts = np.unique(_codes(byte_texts(own))[0], return_counts=True)
                columns = [pa.array(np.full(len(codes), kind, dtype=np.int32)), pa.array(codes.astype(np.int64)), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "code", "c"])


@dataclass
class Model:
    """Per order: sorted codes and log10 probabilities; sorted contexts and the log10 weight they leave to the order below. Index 0 is order 1."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each ORDER-gram, given the others."""
        out = np.zeros(len(codes))
        rest = np.arange(len(codes))
        for k in range(len(self.grams) - 1, -1, -1):
            if not len(rest):
                break
            code = codes[rest] & np.uint64((1 << 8 * (k + 1)) - 1)
            hit, value = _find(*self.grams[k], code)
            out[rest[hit]] += value
            rest, code = rest[~hit], code[~hit]
            hit, value = _find(*self.contexts[k], code >> np.uint64(8))
            out[rest[hit]] += value
        out[rest] -= np.log10(256)
        return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), values
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, values[at[hit]]


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, by the counts of counts, each of them half a count more so that the estimate always exists."""
    n = {r[0]: r[1] for r in counts.where("c <= 4").groupBy("c").count().collect()}
    return discounts(*(n.get(k, 0) for k in (1, 2, 3, 4)))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (n + 0.5 for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def train(texts: DataFrame) -> Model:
    """The model of the texts (doc_id, text), all of them. It has as many n-grams as the texts have different ones of ORDER bytes and fewer,
    which are far fewer than their bytes.

    Counts, context totals, discounts and lower orders are sharded tables by n-gram, joined order by order: the highest order has
    plain counts, each lower one the number of distinct bytes before an n-gram."""
    return _model(written(texts.mapInArrow(_count, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")), "counts"))


def _model(grams: DataFrame) -> Model:
    """The model of the counts (code, c) of all ORDER-grams, a written table."""
    counts = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = written(counts[k + 1].groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).agg(F.count("*").alias("c")), "counts")
    model, below = Model(), None
    for k in range(1, ORDER + 1):
        d = _discounts(counts[k])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counts[k].withColumns({"context": F.shiftright("code", 8), "cut": cut, "suffix": F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))})
        totals = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum("cut").alias("left"))
        totals = totals.select("context", "total", (F.col("left") / F.col("total")).alias("weight"))
        rows = rows.join(totals, "context")
        lower = F.lit(1 / 256)
        if below is not None:
            rows, lower = rows.join(below, "suffix"), F.col("lower")
        rows = written(
            rows.select("code", "context", "weight", ((F.col("c") - F.col("cut")) / F.col("total") + F.col("weight") * lower).alias("p")),
            "probabilities"
        )
        below = rows.select(F.col("code").alias("suffix"), F.col("p").alias("lower"))
        for out, key, value in ((model.grams, "code", "p"), (model.contexts, "context", "weight")):
            got = rows.select(key, value).distinct().toArrow() if key == "context" else rows.select(key, value).toArrow()
            keys, values = got[key].to_numpy().astype(np.uint64), got[value].to_numpy()
            order = np.argsort(keys)
            out.append((keys[order], np.log10(values[order])))
    return model


def _values(models: list[Model], codes: np.ndarray) -> list[np.ndarray]:
    """By model the score of each code; a code is looked up once."""
    if len(codes) < 1 << 24:  # sorted together with the places
        both = codes << np.uint64(24) | np.arange(len(codes), dtype=np.uint64)
        both.sort()
        codes, place = both >> np.uint64(24), (both & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        place = np.argsort(codes)
        codes = codes[place]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, dtype=np.int64)
    times, out = np.diff(np.append(first, len(codes))), []
    for m in models:
        value = np.empty(len(codes))
        value[place] = np.repeat(m.score(codes[first]), times)
        out.append(value)
    return out


def _worst(odds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text the largest mean of odds over WINDOW neighbouring bytes, wherever they begin; over the whole text where it has fewer."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sums = np.concatenate([[0.0], np.cumsum(odds)])
    whole = sums[ends] - sums[starts]
    windows = np.full(len(odds), -np.inf)
    if len(odds) >= WINDOW:
        windows[: len(odds) - WINDOW + 1] = sums[WINDOW:] - sums[:-WINDOW]
    for k in range(1, WINDOW):
        at = ends - k
        windows[at[at >= starts]] = -np.inf  # would end in the next text
    windows[starts[sizes < WINDOW]] = whole[sizes < WINDOW]
    return np.round(np.maximum.reduceat(windows, starts) / np.minimum(sizes, WINDOW), 6)


def _scores(good: Model, bad: Model | None, texts: list[bytes]) -> tuple[list[float | None], list[float | None]]:
    """(perplexity, largest log10 odds) of each text; null for an empty one, odds also without a model of toxic texts."""
    codes, sizes = _codes(texts)
    values = _values([good, bad] if bad else [good], codes)
    sums = np.bincount(np.repeat(np.arange(len(texts)), sizes), weights=values[0], minlength=len(texts))
    perplexity = [float(10 ** (-s / n)) if t else None for s, n, t in zip(sums.tolist(), sizes.tolist(), texts, strict=True)]
    if not bad or not texts:
        return perplexity, [None] * len(texts)
    return perplexity, [x if t else None for x, t in zip(_worst(values[1] - values[0], sizes).tolist(), texts, strict=True)]


def _scorer(models):
    def run(batches):
        for batch in blocks(batches, BLOCK):
            texts = byte_texts(batch)
            perplexity, odds = _scores(*models.value, texts)
            columns = [
                batch.column(0), batch.column(2), pa.array([len(t) for t in texts], pa.int64()), pa.array(perplexity, pa.float64()),
                pa.array(odds, pa.float64())
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "n_bytes", "perplexity", "toxic_odds"])

    return run


def _held_out() -> Column:
    """Whether an id is of the third of all ids, by hash, that is never learnt from."""
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0


def _learners(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, kinds (a bit of KINDS each) of all documents to learn from: trusted or toxic, not held out, with a text. Every row counts, as often as it stands."""
    bit = lambda ids, kind: ids.withColumn("kinds", F.lit(kind))
    ids = bit(_trusted(labels), TRUSTED).unionByName(bit(_toxic(labels), TOXIC)).groupBy("doc_id").agg(F.bit_or("kinds").alias("kinds"))
    texts = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~_held_out())
    # by hash at every size: ids that are broadcast while they are few would make the shuffle grow faster than the input
    return texts.join(ids.where(~_held_out()).hint("shuffle_hash"), "doc_id").select("text", "kinds")


def _models(docs: DataFrame, labels: DataFrame) -> list[Model | None]:
    """The models of all trusted and of all toxic documents that aren't held out. Without toxic ones None stands for theirs."""
    counted = _learners(docs, labels).mapInArrow(_count_kinds, "kind int, code long, c long")
    counts = written(counted.groupBy("kind", "code").agg(F.sum("c").alias("c")), "counts")
    of = lambda kind: counts.where(F.col("kind") == kind).drop("kind")
    return [_model(of(TRUSTED)), None if of(TOXIC).isEmpty() else _model(of(TOXIC))]


def _sample(docs: DataFrame, wanted: DataFrame, per_language: int, longest: int) -> DataFrame:
    """doc_id, text_hash, lang of a sample to learn from, where one is asked for: of documents with wanted ids and `longest` characters at most,
    per_language of each language, none of those held out."""
    rows = docs.where(F.length("text").between(1, longest)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("lang", F.lit("")).alias("lang")
    )
    return least_hashed(rows.where(~_held_out()).join(wanted, "doc_id", "left_semi"), "lang", per_language)


def _learnt(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, text of the sample, each text of an id once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    keys = sample.select("doc_id", "text_hash").distinct()
    return texts.join(F.broadcast(keys), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text")


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _toxic(labels: DataFrame) -> DataFrame:
    return labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


MEASURES = ("perplexity", "toxic_odds")


@dataclass
class Classifier:
    """The broadcast models (of trusted texts, and of toxic ones or None), the scores of all documents they were fitted on (row_id, doc_id,
    lang, n_bytes, perplexity, toxic_odds), and by measure the limits by language and overall."""

    models: object
    scores: DataFrame
    limits: dict[str, dict[str, float]]
    overall: dict[str, float]


def fit_classifier(
    docs: DataFrame, labels: DataFrame, per_language: int | None = None, longest: int = 20_000, quantile: float = 0.99, prior: float = 50.0
) -> Classifier:
    """Learns from all trusted and all toxic documents, whole, but for a third of all ids by hash, scores all documents, whole, and sets the limits.
    Only a caller that gives per_language has it learn from samples (as many documents of each language, of `longest` characters at most).

    A language's limit is the quantile of a measure (of perplexities the logarithm) over its n trusted documents that weren't learnt from, with
    weight n, and that over all languages' with weight `prior`: the same rule at every size, so that a language with few trusted documents
    leans on the others."""
    judges = _trusted(labels)
    if per_language is None:
        good, bad = _models(docs, labels)
        judges = judges.where(_held_out())
    else:
        sample, toxic = (written(_sample(docs, ids, per_language, longest), "sample") for ids in (_trusted(labels), _toxic(labels)))
        good, bad = (train(_learnt(docs, ids)) if ids is sample or not ids.isEmpty() else None for ids in (sample, toxic))
        judges = judges.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_anti")
    models = docs.sparkSession.sparkContext.broadcast((good, bad))
    scored = texts_of(docs, "doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(
        _scorer(models), "doc_id long, lang string, n_bytes long, perplexity double, toxic_odds double"
    )
    scored = written(scored.withColumn("row_id", F.monotonically_increasing_id()), "scores")
    judged = scored.where("perplexity IS NOT NULL").join(judges, "doc_id", "left_semi")
    at = [F.percentile_approx(m, quantile, 10_000).alias(m) for m in MEASURES]
    rows = judged.where("lang IS NOT NULL").groupBy("lang").agg(*at, F.count("*").alias("n")).collect()
    overall = judged.agg(*at).first()
    limits = {m: {r["lang"]: shrunk(r[m], overall[m], r["n"], prior, m == "perplexity") for r in rows if r[m] is not None} for m in MEASURES}
    return Classifier(models, scored, limits, {m: float("inf") if overall[m] is None else overall[m] for m in MEASURES})


def shrunk(own: float, all_: float, n: int, prior: float, logarithm: bool) -> float:
    """The mean of two limits, with weights n and prior."""
    if logarithm:
        return float(10 ** ((n * np.log10(own) + prior * np.log10(all_)) / (n + prior)))
    return (n * own + prior * all_) / (n + prior)


def classify_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: row_id, doc_id, lang, n_bytes, perplexity (of a byte, with the line end after the text), most (its language's
    limit), toxic_odds (the largest mean log10 odds of WINDOW neighbouring bytes between the model of toxic documents and that of trusted
    ones), most_odds (its language's limit), kept.

    See fit_classifier. A language without trusted documents that weren't learnt from, and a null one, has the limit over all. A document above
    either limit is rejected.

    Null or empty text: perplexity null, rejected. Without trusted documents nothing can be judged: every text that isn't empty is kept;
    without toxic documents toxic_odds are null and reject nothing. Null or repeated ids: rows of their own. Empty table: no rows. Other
    columns are not read. The models are broadcast: they follow the different n-grams of ORDER bytes of the texts learnt from. Those texts meet the
    labels by doc_id once, to be counted; scoring is a map, and the scores meet the labels by doc_id."""
    c = fit_classifier(docs, labels, **how)
    most: dict[str, Column] = {}
    for m in MEASURES:
        most[m] = F.lit(c.overall[m])
        for name, value in sorted(c.limits[m].items()):
            most[m] = F.when(F.col("lang") == name, F.lit(value)).otherwise(most[m])
    out = c.scores.withColumns({"most": most["perplexity"], "most_odds": most["toxic_odds"]})
    kept = F.coalesce(F.col("perplexity") <= F.col("most"), F.lit(False)) & F.coalesce(F.col("toxic_odds") <= F.col("most_odds"), F.lit(True))
    return out.select("row_id", "doc_id", "lang", "n_bytes", "perplexity", "most", "toxic_odds", "most_odds", kept.alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that classify_quality keeps, with all their columns: a second map over the texts, so that no text is shuffled."""
    c = fit_classifier(docs, labels, **how)
    models, limits, overall = c.models, c.limits, c.overall

    def run(batches):
        within = lambda x, g, m: x <= limits[m].get(g, overall[m])
        for batch in blocks(batches, BLOCK):
            names = batch.schema.names
            texts = [t or b"" for t in byte_texts(batch)]
            langs = batch.column(names.index("lang")).to_pylist()
            keep = [
                p is not None and within(p, g, "perplexity") and (o is None or within(o, g, "toxic_odds")) for p, o,
                g in zip(*_scores(*models.value, texts), langs, strict=True)
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
