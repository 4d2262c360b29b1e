"""Benchmark decontamination by a broadcast set of normalised n-grams.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters. Each benchmark item gives
its windows of n words; an item of fewer words, but not none, is one window. The 64-bit hashes of the
windows are broadcast in blocks of about `block` windows (one block unless the benchmark is large; more
blocks mean more passes over the documents, which are written once with a key for each row, and whose hits
are united by it before anything is cut). A hit is verified by comparing bytes.

A null or wordless text has no hits; repeated items all count; items with null text or id give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf as tb
from .common import stored

#: Names that no column of the documents has.
KEY, SPANS = "__row_key", "__row_spans"


@dataclass
class Windows:
    """Benchmark windows as flat arrays, by length and hash.

    hashes: the distinct hashes of each length, sorted, and the first row of each (with one more at the end). A row
    is a window of an item: its words lie in `words` from byte at[row] to at[row + 1], its item is names[item[row]].
    """

    hashes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    words: bytes = b""
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    names: list[str] = field(default_factory=list)

    def items(self, size: int, k: int, said: bytes) -> set[str]:
        """Items with the words, among those behind the k-th hash of a length."""
        first = self.hashes[size][1]
        return {self.names[self.item[r]] for r in range(first[k], first[k + 1]) if self.words[self.at[r] : self.at[r + 1]] == said}


def packed(rows: pa.Table) -> Windows:
    """rows: (item, size, words, hash)."""
    if not rows.num_rows:
        return Windows()
    rows = rows.combine_chunks()
    size, hashes = rows.column("size").to_numpy(), rows.column("hash").to_numpy().view(np.uint64)
    order = np.lexsort((hashes, size))
    rows, size, hashes = rows.take(pa.array(order)).combine_chunks(), size[order], hashes[order]
    words, item = rows.column("words").chunk(0), rows.column("item").chunk(0).dictionary_encode()
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    found = Windows({}, words.buffers()[2].to_pybytes(), at, item.indices.to_numpy(), item.dictionary.to_pylist())
    for n in np.unique(size).tolist():
        lo, hi = np.searchsorted(size, [n, n + 1])
        distinct, first = np.unique(hashes[lo:hi], return_index=True)
        found.hashes[n] = distinct, np.append(first, hi - lo) + lo
    return found


def item_windows(text: str | None, n: int) -> list[list[bytes]]:
    raw = tb.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    w = tb.words(raw, np.array([0, len(raw)]), tb.ALNUM)
    found = [w.text(i) for i in range(len(w.start))]
    if not found:
        return []
    return [found[i : i + n] for i in range(max(1, len(found) - n + 1))]


def hash_windows(windows: list[list[bytes]]) -> np.ndarray:
    """The hash that a run of words has in documents."""
    out = np.zeros(len(windows), np.uint64)
    for i, x in enumerate(windows):
        raw = np.frombuffer(b" ".join(x), np.uint8)
        out[i] = tb.rolling(tb.word_hashes(tb.words(raw, np.array([0, len(raw)]), tb.ALNUM)), len(x))[0]
    return out


def blocks(benchmark: DataFrame, n: int = 10, block: int = 1 << 20) -> tuple[int, Iterator[Windows]]:
    """The number of blocks, and the windows of each, about `block` window rows at a time on the driver."""

    def run(batches):
        for batch in batches:
            rows = [(str(i), w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in item_windows(t, n)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.string()), pa.array([len(w) for _, w in rows], pa.int32()), pa.array([b" ".join(w) for _, w in rows], pa.binary()), pa.array(hash_windows([w for _, w in rows]).view(np.int64))], ["item", "size", "words", "hash"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item string, size int, words binary, hash long").distinct()
    count = rows.count()
    parts = max(1, -(-count // block))
    if parts > 1:
        rows = stored(rows)

    def each():
        for k in range(parts):
            part = rows if parts == 1 else rows.where(F.pmod(F.hash("hash"), F.lit(parts)) == k)
            yield packed(part.toArrow())

    return parts, each()


def hits(column: pa.Array, found: Windows):
    """For each document: number of words, hit word indices, items; plus byte spans of the hit words."""
    for lo, hi, data, off in tb.slices(column):
        low = tb.LOWER[data]
        w = tb.words(low, off, tb.ALNUM)
        h = tb.word_hashes(w)
        docs = hi - lo
        hit = np.zeros(len(w.start), bool)
        items: list[set[str]] = [set() for _ in range(docs)]
        doc = w.doc()
        for size, (known, _) in found.hashes.items():
            grams = tb.rolling(h, size)
            if not len(grams):
                continue
            at = np.searchsorted(known, grams)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == grams):
                if doc[i] != doc[i + size - 1]:
                    continue
                said = b" ".join(w.text(j) for j in range(i, i + size))
                ok = found.items(size, at[i], said)
                if ok:
                    hit[i : i + size] = True
                    items[doc[i]] |= ok
        for d in range(docs):
            a, b = w.first[d], w.first[d + 1]
            at = a + np.flatnonzero(hit[a:b])
            yield int(b - a), at - a, items[d], w.start[at] - off[d], w.end[at] - off[d]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[Column], n: int = 10, block: int = 1 << 20) -> DataFrame:
    """The kept columns, n_words, hits (word indices), items and hit_bytes for each row of docs."""
    rows = docs.select(*keep, F.col("text").alias("__text"))
    names = rows.columns[:-1]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    parts, each = blocks(benchmark, n, block)
    if parts > 1:
        rows = stored(rows.withColumn(KEY, F.monotonically_increasing_id()))
    out = None
    for found in each:
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def run(batches, shared=shared):
            for batch in batches:
                held = list(hits(batch.column(len(names)), shared.value))
                key = batch.columns[len(names) + 1 :]
                cols = [pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.list_(pa.int32())), pa.array([sorted(x[2]) for x in held], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols, *key], [*names, "n_words", "hits", "items", *[KEY] * len(key)])

        one = rows.mapInArrow(run, f"{kept}, n_words long, hits array<int>, items array<string>" + (f", {KEY} long" if parts > 1 else ""))
        out = one if out is None else out.unionByName(one)
    if parts == 1:
        return out
    same = [F.first(F.col(f"`{c}`")).alias(c) for c in [*names, "n_words"]]
    return out.groupBy(KEY).agg(*same, united("hits"), united("items")).drop(KEY)


def united(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from scan()'s rows."""
    return found.withColumns({
        "n_hit": F.size("hits").cast("long"),
        "n_items": F.size("items").cast("long"),
        "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256),
        "contaminated": F.size("hits") > 0,
    }).drop("hits", "items")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "document", block: int = 1 << 20) -> DataFrame:
    """Documents without benchmark content: hit ones dropped, or (mode "span") hit words cut out.

    The columns and clean rows stay as they are; n_chars, where present, follows a cut text.
    """
    if mode not in ("document", "span"):
        raise ValueError(f"unknown mode {mode!r}")
    parts, each = blocks(benchmark, n, block)
    if mode == "span" and parts > 1:
        return clean_spans(docs, each)
    out = docs
    at = docs.columns.index("text")
    for found in each:
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def run(batches, shared=shared):
            for batch in batches:
                held = list(hits(batch.column(at), shared.value))
                if mode == "document":
                    yield batch.filter(pa.array([not len(x[1]) for x in held], pa.bool_()))
                else:
                    yield without(batch, [(x[3], x[4]) for x in held])

        out = out.mapInArrow(run, nullable(docs))
    return out


def nullable(docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])


def without(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
    """The batch with the words at these byte spans, (starts, ends) of each row, cut out of its texts."""
    if not any(len(start) for start, _ in spans):
        return batch
    names = batch.schema.names
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else -1
    texts = batch.column(at).to_pylist()
    sizes = batch.column(chars).to_pylist() if chars >= 0 else []
    for i, (start, end) in enumerate(spans):
        if len(start):
            texts[i] = cut_words(texts[i], start, end)
            if sizes:
                sizes[i] = len(texts[i])
    cols = list(batch.columns)
    cols[at] = pa.array(texts, batch.schema.field(at).type)
    if sizes:
        cols[chars] = pa.array(sizes, batch.schema.field(chars).type)
    return pa.RecordBatch.from_arrays(cols, schema=batch.schema)


def clean_spans(docs: DataFrame, each: Iterator[Windows]) -> DataFrame:
    """Hit words of all blocks, found in the texts as they are, and then cut out at once."""
    rows = stored(docs.withColumn(KEY, F.monotonically_increasing_id()))
    out = None
    for found in each:
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def run(batches, shared=shared):
            for batch in batches:
                held = [(k, x) for k, x in zip(batch.column(0).to_pylist(), hits(batch.column(1), shared.value), strict=True) if len(x[1])]
                cols = [pa.array([k for k, _ in held], pa.int64()), pa.array([[{"a": int(a), "b": int(b)} for a, b in zip(x[3], x[4], strict=True)] for _, x in held], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(cols, [KEY, SPANS])

        one = rows.select(KEY, "text").mapInArrow(run, f"{KEY} long, {SPANS} array<struct<a: bigint, b: bigint>>")
        out = one if out is None else out.unionByName(one)
    names = docs.columns

    def cut_out(batches):
        for batch in batches:
            spans = [(np.array([y["a"] for y in x or ()], np.int64), np.array([y["b"] for y in x or ()], np.int64)) for x in batch.column(len(names)).to_pylist()]
            yield without(pa.RecordBatch.from_arrays(batch.columns[: len(names)], names), spans)

    joined = rows.join(out.groupBy(KEY).agg(united(SPANS)), KEY, "left").select(*(F.col(f"`{c}`") for c in names), SPANS)
    return joined.mapInArrow(cut_out, nullable(docs))


def cut_words(text: str, start: np.ndarray, end: np.ndarray) -> str:
    """The text without the words at these byte spans; neighbouring hit words go with what is between."""
    raw, out, pos, i = text.encode(), [], 0, 0
    word = tb.ALNUM
    while i < len(start):
        j = i
        while j + 1 < len(start) and not word[tb.LOWER[np.frombuffer(raw[end[j] : start[j + 1]], np.uint8)]].any():
            j += 1
        out.append(raw[pos : start[i]])
        pos, i = int(end[j]), j + 1
    return b"".join([*out, raw[pos:]]).decode()
