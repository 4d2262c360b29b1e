"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word-bounded byte 5-grams (presence in the text) is trained in
numpy on confirmed toxic texts against unlabelled ones, over the features whose rates differ between the
two by `z` standard errors. The risk is  pi R+(1) + max(0, Ru(-1) - pi R+(-1)):
negatives are never asked for, and where the corrected negative risk falls below zero its gradient is
reversed. The class prior pi is the toxic share of the labelled training rows unless given.

At most `max_positive` toxic and `max_unlabelled` other texts are fitted, those with the least hash of their
id; all texts are scored. Null and empty texts have the score of the bias alone. Without a toxic example
all scores are 0. Repeated rows are fitted as often as they come, ids with two labels count as toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb

BITS = 18
GRAM = 5


def features(w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of distinct features, by document."""
    doc = w.doc()
    h = tb.word_hashes(w)
    # bytes of words with a mark before and after: ^word$
    length = w.end - w.start + 2
    at = np.cumsum(length) - length
    flat = np.full(int(length.sum()), 0x5E, np.uint8)
    if len(length):
        inner = w.end - w.start
        begin = np.cumsum(inner) - inner
        move = np.repeat(at + 1 - begin, inner) + np.arange(int(inner.sum()))
        flat[move] = w.data[np.repeat(w.start - begin, inner) + np.arange(int(inner.sum()))]
        flat[at + length - 1] = 0x24
    g = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    if len(flat) >= GRAM:
        packed = np.zeros(len(flat) - GRAM + 1, np.uint64)
        for j in range(GRAM):
            packed = (packed << np.uint64(8)) | flat[j : len(flat) - GRAM + 1 + j]
        word = np.repeat(np.arange(len(length)), length)
        ok = word[: len(packed)] == word[GRAM - 1 :]
        g, owner = tb.mix(packed[ok] + np.uint64(7)), doc[word[: len(packed)][ok]]
    feature = np.concatenate([h, g]) >> np.uint64(64 - BITS)
    composite = np.unique((np.concatenate([doc, owner]).astype(np.uint64) << np.uint64(BITS)) | feature)
    return (composite >> np.uint64(BITS)).astype(np.int64), (composite & np.uint64((1 << BITS) - 1)).astype(np.int64)


def extract(column: pa.Array):
    """Distinct features of each text, as one array each."""
    for lo, hi, data, off in tb.slices(column):
        doc, feature = features(tb.words(tb.LOWER[data], off, tb.ALNUM))
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        yield lo, hi, at, feature


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, at, feature in extract(column):
            total = np.concatenate([[0.0], np.cumsum(self.weights[feature], dtype=np.float64)])
            z = (total[at[1:]] - total[at[:-1]]) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def screened(positive: list[np.ndarray], unlabelled: list[np.ndarray], z: float) -> np.ndarray:
    """Which features toxic and unlabelled texts have at rates that differ by z standard errors or more."""
    size = 1 << BITS
    a, b = (np.bincount(np.concatenate(xs), minlength=size) for xs in (positive, unlabelled))
    n, m = len(positive), len(unlabelled)
    rate = (a + b) / (n + m)
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n + 1 / m))
    return (np.abs(a / n - b / m) / error >= z) & (a + b >= 4)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 30, rate: float = 0.02, batch: int = 512, decay: float = 1e-4, z: float = 5.0, seed: int = 7) -> Classifier:
    """Adam on the non-negative risk with the logistic loss."""
    size = 1 << BITS
    w, bias = np.zeros(size + 1), 0.0
    if not positive or not unlabelled:
        return Classifier(w[:size].astype(np.float32), -500.0, prior)
    known = screened(positive, unlabelled, z)
    positive, unlabelled = ([x[known[x]] for x in xs] for xs in (positive, unlabelled))
    w[size] = bias = np.log(prior / (1 - prior))
    m, v, t = np.zeros(size + 1), np.zeros(size + 1), 0
    rng = np.random.default_rng(seed)
    steps = max(1, -(-len(unlabelled) // batch))
    per_p = -(-len(positive) // steps)
    for _ in range(epochs):
        p, u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for k in range(steps):
            a = [positive[i] for i in p[k * per_p : (k + 1) * per_p]]
            b = [unlabelled[i] for i in u[k * batch : (k + 1) * batch]]
            if not a or not b:
                continue
            rows = a + b
            n = np.array([len(x) for x in rows])
            flat = np.concatenate(rows).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(n)])
            logit = tb.per_doc_sum(w[flat], off) + w[size]
            s = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            loss_neg = np.logaddexp(0, logit)
            negative = loss_neg[len(a) :].mean() - prior * loss_neg[: len(a)].mean()
            if negative >= 0:
                g = np.concatenate([(prior * (s[: len(a)] - 1) - prior * s[: len(a)]) / len(a), s[len(a) :] / len(b)])
            else:
                g = -np.concatenate([-prior * s[: len(a)] / len(a), s[len(a) :] / len(b)])
            grad = np.bincount(flat, np.repeat(g, n), minlength=size + 1)
            grad[size] = g.sum()
            t += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w[:size] *= 1 - decay
    return Classifier(w[:size].astype(np.float32), float(w[size]), prior)


def fit(docs: DataFrame, labels: DataFrame, train_id: Column, prior: float | None = None, max_positive: int = 4000, max_unlabelled: int = 8000) -> Classifier:
    """docs (doc_id, text) and labels (doc_id, toxic); train_id tells training rows by their doc_id."""
    known = labels.where(train_id & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not toxic:
        return train([], [], 0.5)
    prior = float(np.clip(prior if prior is not None else toxic / n, 1e-4, 0.9))
    rank = F.xxhash64("doc_id", F.lit("pu"))
    yes = known.where("toxic = 1").select("doc_id").distinct().orderBy(rank).limit(max_positive).withColumn("kind", F.lit(1))
    rest = docs.where(train_id & F.col("doc_id").isNotNull()).select("doc_id").orderBy(rank).limit(max_unlabelled).distinct().withColumn("kind", F.lit(0))
    chosen = F.broadcast(yes.unionByName(rest))  # at most max_positive + max_unlabelled ids
    picked = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "kind", "text")

    def run(batches):
        for batch in batches:
            for lo, hi, at, feature in extract(batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), tb.list_array(at, feature.astype(np.int32), pa.int32())], ["doc_id", "kind", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held: dict[int, list] = {0: [], 1: []}
    rows = picked.mapInArrow(run, f"doc_id {kind}, kind int, features array<int>").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("kind", "ascending")])
    features_ = rows.column("features").combine_chunks()
    for k, x in zip(rows.column("kind").to_pylist(), features_, strict=True):
        held[k].append(x.values.to_numpy(zero_copy_only=False))
    return train(held[1], held[0], prior)


def score(docs: DataFrame, model: Classifier, keep: list[Column]) -> DataFrame:
    """The kept columns and score for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    names = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held.value.scores(batch.column(len(names))))], [*names, "score"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double")
