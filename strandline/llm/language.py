"""Language ID: averaged hashed subword embeddings and a linear softmax, with calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_texts, fold, least_hashed, texts_of

ORDERS = (2, 3, 4)  # bytes in a subword
BUCKETS = 1 << 16
_PAD = b"   "
_LOWER = bytes(range(256)).lower()  # ASCII letters only


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each order, one row an order; begins of the texts in them; windows of each text).

    A text is lower-cased and framed by spaces, so word ends are part of subwords. Windows that would reach the next text get the bucket BUCKETS."""
    data = np.frombuffer(b"".join(b" " + t.translate(_LOWER) + _PAD for t in texts) + _PAD, dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(t) + 4 for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = int(sizes.sum())
    found = np.empty((len(ORDERS), n), dtype=np.int32)
    code = data[:n].copy()
    for k in range(1, max(ORDERS)):
        code *= np.uint32(0x01000193)
        code ^= data[k : k + n]
        if k + 1 in ORDERS:
            mixed = code * np.uint32(0x9E3779B1) + np.uint32(k)
            found[ORDERS.index(k + 1)] = (mixed >> np.uint32(16)) & np.uint32(BUCKETS - 1)
    for k in range(1, 4):
        found[:, begins + sizes - k] = BUCKETS
    return found, begins, len(ORDERS) * (sizes - 3)


@dataclass
class Model:
    """Scores of each language by bucket (the embeddings times the softmax's weights), temperature and rejection limit."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    limit: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        found, begins, count = subwords(texts)
        out = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            column = self.table[k]
            sums = column[found[0]]
            for other in found[1:]:
                sums += column[other]
            out[:, k] = np.add.reduceat(sums, begins, dtype=np.float64) / count + self.bias[k]
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


SAMPLE = "doc_id long, text_hash long, lang string, windows long, buckets binary, counts binary"


def _features(batches):
    """A document's distinct buckets (two bytes each) and how many of its windows each has (four bytes)."""
    for batch in blocks(batches):
        found, begins, count = subwords(byte_texts(batch))
        buckets, counts = [], []
        for b, n in zip(begins.tolist(), count.tolist(), strict=True):
            u, c = np.unique(found[:, b : b + n // len(ORDERS)], return_counts=True)
            buckets.append(u.astype("<u2").tobytes())
            counts.append(c.astype("<u4").tobytes())
        columns = [
            batch.column(0), batch.column(1), batch.column(3), pa.array(count, pa.int64()), pa.array(buckets, pa.binary()),
            pa.array(counts, pa.binary())
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "lang", "windows", "buckets", "counts"])


def train(
    langs: list[str], label: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray], windows: list[int], held: np.ndarray,
    dim: int = 16, epochs: int = 6, rate: float = 8.0, seed: int = 7, most_error: float = 0.01, most_lost: float = 0.002
) -> Model:
    """Stochastic gradient descent over documents; the rows in `held` set the temperature and the rejection limit instead."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, dim))
    out = rng.normal(0, 0.1, (dim, len(langs)))
    bias = np.zeros(len(langs))
    fit = np.flatnonzero(~held)
    weights = lambda i: (counts[i] / windows[i]).astype(np.float32)
    total, step = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            now = rate * (1 - step / total)
            step += 1
            w = weights(i)
            hidden = w @ emb[ids[i]]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = out @ p
            out -= now * np.outer(hidden, p)
            bias -= 0.01 * now * p
            emb[ids[i]] -= now * w[:, None] * back
    model = Model(langs, np.vstack([emb @ out, np.zeros(len(langs))]).T.astype(np.float32).copy(), bias)
    check = np.flatnonzero(held)
    if len(check):
        z = np.array([weights(i) @ (emb[ids[i]] @ out) + bias for i in check])
        best = np.inf
        for t in np.geomspace(0.05, 20, 60):
            model.temperature = t
            loss = -np.log(np.maximum(model.probabilities(z)[np.arange(len(check)), label[check]], 1e-12)).mean()
            if loss < best:
                best, kept = loss, t
        model.temperature = float(kept)
        p = model.probabilities(z)
        sure, right = p.max(axis=1), p.argmax(axis=1) == label[check]
        order = np.argsort(-sure)
        wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(wrong <= most_error)
        wanted = sure[order][ok[-1]] if len(ok) else 1.0
        model.limit = float(min(wanted, np.quantile(sure[right], most_lost))) if right.any() else 0.0
    return model


def _sample(docs: DataFrame, per_language: int, most_languages: int, longest: int, folds: int, held_fold: int) -> DataFrame:
    """doc_id, text_hash, lang, text of the rows to learn from, per_language of each language at most. Equal rows (id, text and language) count once."""
    learnt = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != held_fold)).groupBy(F.col("lang").cast("string").alias("known")).count()
    learnt = learnt.orderBy(F.desc("count"), "known").limit(most_languages).select("known")  # bounded, so it may be broadcast
    docs = docs.join(F.broadcast(learnt), docs["lang"].cast("string") == F.col("known"), "left_semi")
    known = F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & (F.length("text") <= longest)
    rows = docs.where(known & (fold(F.col("doc_id"), folds) != held_fold)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("lang").cast("string").alias("lang"),
        "text"
    )
    keys = least_hashed(rows, "lang", per_language)  # bounded, so it may be broadcast
    return rows.join(F.broadcast(keys), ["doc_id", "text_hash", "lang"]).dropDuplicates(["doc_id", "text_hash", "lang"])


def fit_language(
    docs: DataFrame, per_language: int = 400, most_languages: int = 200, longest: int = 20_000, folds: int = 3, held_fold: int = 1, **how
) -> Model:
    """A model learnt from `per_language` documents of each language at most: those with the least hash of id and text, of at most `longest`
    characters, outside the held fold. Of more than `most_languages` values of lang those with the most documents are learnt (equal numbers:
    the first by name), as the model has BUCKETS numbers a language. That sample is all that comes to the driver, as bucket weights. Without
    any such document the model knows no language."""
    sample = _sample(docs, per_language, most_languages, longest, folds, held_fold).select("doc_id", "text_hash", "text", "lang")
    got = sorted(sample.mapInArrow(_features, SAMPLE).collect(), key=lambda r: (r["doc_id"], r["text_hash"]))
    if not got:
        return Model()
    langs = sorted({r["lang"] for r in got})
    label = np.array([langs.index(r["lang"]) for r in got])
    ids = [np.frombuffer(r["buckets"], dtype="<u2") for r in got]
    counts = [np.frombuffer(r["counts"], dtype="<u4") for r in got]
    held = np.arange(len(label)) % 4 == 3
    return train(langs, label, ids, counts, [r["windows"] for r in got], held, **how)


def _predict(model: Model, known: list[str | None], texts: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
    n = len(texts)
    lang, score, rejected = ["und"] * n, [0.0] * n, [True] * n
    use = [i for i, t in enumerate(known) if t and any(map(str.isalpha, t))] if model.langs else []
    if use:
        p = model.probabilities(model.logits([texts[i] for i in use]))
        top = p.argmax(axis=1)
        for i, k, s in zip(use, top.tolist(), p.max(axis=1).tolist(), strict=True):
            lang[i], score[i], rejected[i] = model.langs[k], min(1.0, s), s < model.limit
    return lang, score, rejected


def _predictor(model: Model):
    def run(batches):
        for batch in blocks(batches, 2 << 20):
            lang, score, rejected = _predict(model, batch.column(1).to_pylist(), byte_texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"]
            )

    return run


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (calibrated probability of lang_pred), rejected (score below the model's limit).

    Only the text is read. The model is BUCKETS numbers a language, sent with the tasks; the texts aren't shuffled. Null text, no letter,
    or a model without languages: `und`, 0, rejected. Null or repeated ids: rows of their own. Empty table: no rows."""
    return texts_of(docs).mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose prediction isn't rejected, with all their columns. A model without languages rejects nothing, for it knows nothing."""

    def run(batches):
        for batch in blocks(batches, 2 << 20):
            known = batch.column(batch.schema.names.index("text")).to_pylist()
            rejected = _predict(model, known, [t or b"" for t in byte_texts(batch)])[2] if model.langs else [False] * len(known)
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
