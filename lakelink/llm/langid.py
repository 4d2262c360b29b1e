"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered over every training text (one pass, sparse rows per partition, summed by Spark). The
log-probability matrix (languages x 2^bits, 4 bytes each) is broadcast; one over `max_model_bytes` is refused,
as fewer buckets would change results. A batch of texts is scored as sparse (text, bucket) coordinates in numpy.

Texts that are null or hold no letter (Unicode categories L) are `und` with score 0, as is everything if nothing
can be learned. Rows with a null language, text or id are not learned from. Repeated rows are learned from as
often as they come. Of equally likely languages the first by name is named. Long texts are whole, counted piece by
piece; an empty table gives no rows; kept columns may have any name but lang_pred and score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_LETTERS = re.compile(r"[\W\d_]+")
ORDERS = (1, 2, 3, 4)
PIECE = 1 << 19
U64 = np.uint64


def letters(text: str | None) -> str:
    """Lower-cased letters; everything else becomes one space."""
    clean = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if clean and not clean.replace(" ", "").isalpha():  # \w also holds numbers such as ½ and Ⅷ
        clean = " ".join("".join(c if c.isalpha() else " " for c in clean).split())
    return clean


def batches_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Indices and letters of the texts with a letter, about PIECE letters at a time."""
    at, held, size = [], [], 0
    for i, text in enumerate(texts):
        if clean := letters(text):
            at.append(i)
            held.append(clean)
            size += len(clean)
        if size >= PIECE or (held and i + 1 == len(texts)):
            yield np.array(at), held
            at, held, size = [], [], 0


def grams(held: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every n-gram of the padded texts, in pieces; no n-gram spans two texts."""
    codes = np.frombuffer("".join(f" {c} " for c in held).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(held)), [len(c) + 2 for c in held])
    top = max(ORDERS)
    for lo in range(0, len(codes), PIECE):
        part, own = codes[lo : lo + PIECE + top - 1].astype(U64), text[lo : lo + PIECE + top - 1]
        here = min(PIECE, len(codes) - lo)
        h = np.zeros(len(part), U64)
        for n in range(1, top + 1):
            size = min(here, len(part) - n + 1)
            if size <= 0:
                break
            h = h[: len(part) - n + 1] * U64(0x100000001B3) + part[n - 1 :] + U64(n)
            on = own[:size] == own[n - 1 : n - 1 + size]
            yield own[:size][on], ((h[:size][on] * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


@dataclass
class LanguageModel:
    langs: list[str]
    bits: int
    weights: np.ndarray  # languages x buckets, log P(bucket | language)
    prior: np.ndarray


def fit(train: DataFrame, bits: int = 15, alpha: float = 0.1, max_model_bytes: int = 64 << 20) -> LanguageModel:
    """train: (text, lang), both non-null."""
    bound = max_model_bytes // (4 << bits)
    docs = {r[0]: r[1] for r in train.groupBy("lang").count().orderBy("lang").limit(bound + 1).collect()}
    if len(docs) > bound:
        raise ValueError(f"over {bound} languages: the matrix would exceed max_model_bytes")
    langs = sorted(docs)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(1).to_pylist()
            for at, held in batches_of(batch.column(0).to_pylist()):
                names, code = np.unique([lang[i] for i in at], return_inverse=True)
                table = np.zeros(len(names) << bits, np.int64)
                for text, bucket in grams(held, bits):
                    table += np.bincount((code[text] << bits) | bucket, minlength=len(table))
                for name, counts in zip(names.tolist(), table.reshape(len(names), -1), strict=True):
                    total[name] = total.get(name, 0) + counts
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    rows = train.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(langs), 1 << bits))
    code = {lang: i for i, lang in enumerate(langs)}
    table[[code[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    weights = np.log(table + alpha) - np.log(table.sum(1, keepdims=True) + alpha * (1 << bits))
    n = np.array([docs[x] for x in langs], float)
    return LanguageModel(langs, bits, weights.astype(np.float32), np.log(n / max(n.sum(), 1)))


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The likeliest language of each text, and its probability."""
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    if not model.langs:
        return pred, score
    for at, held in batches_of(texts):
        z = np.tile(model.prior, (len(held), 1))
        for text, bucket in grams(held, model.bits):
            for k, weights in enumerate(model.weights):
                z[:, k] += np.bincount(text, weights[bucket], len(held))
        z = np.exp(z - z.max(1, keepdims=True))
        best = z.argmax(1)
        sure = z.max(1) / z.sum(1)
        for i, k, p in zip(at.tolist(), best.tolist(), sure.tolist(), strict=True):
            pred[i], score[i] = model.langs[k], p
    return pred, score


def identify(docs: DataFrame, model: LanguageModel, keep: list[Column]) -> DataFrame:
    """The kept columns, lang_pred and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    names = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            pred, score = predict(shared.value, batch.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", lang_pred string, score double"
    return rows.mapInArrow(run, schema)
