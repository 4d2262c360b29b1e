"""Repeated passages by seed and extend.

Seeds are winnowed word g-grams: in every window of `length` words the g-gram of least hash is the
window's anchor, so equal windows share an anchor at the same place, and about 7 % of the positions are
anchors. Anchors are counted over the corpus. Around each anchor that occurs again the match is extended
both ways over the run of windows that it anchors: occurrences with the same run are matched whole; where
runs differ, each window of the run is compared by its hash, among the occurrences of that anchor. Windows
found twice are joined into maximal repeats, whose words are removed.

No pairs are made: occurrences of an anchor are counted and meet by hash. A run is identified by its
anchor's and its own 64-bit hash, a row by 128 bits of its id and text. The anchors that occur again are handed
out as a bit map of bounded size (`max_bits`) that may let single ones through but loses none, and so are runs
and windows found again, and rows with repeats. Texts under `length` words, empty and null ones have no window
and stay as they are; ids may be null. Rows that repeat as a whole repeat their windows and lose them all. Long
texts are whole. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import cut

WORD_BITS = 15  # bits of an index within a shipped piece of the bit map
ROW = 1 << 16
FEW = 1 << 20  # hashes that the driver takes as they are, 8 MB; beyond, executors pack them


def anchors(w: tb.Words, length: int, gram: int):
    """For each run of windows with one anchor: document, first window, windows, anchor hash.

    Also the word hashes. Of equal least hashes in a window the first counts.
    """
    h = tb.word_hashes(w)
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return h, none, none, none, np.zeros(0, np.uint64)
    g = tb.rolling(h, gram)
    span = length - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    pick = np.empty(len(view), np.int64)
    for lo in range(0, len(view), ROW):
        pick[lo : lo + ROW] = view[lo : lo + ROW].argmin(1)
    pick += np.arange(len(view))
    doc = w.doc()
    valid = doc[: len(view)] == doc[length - 1 :]
    starts = valid.copy()
    starts[1:] &= (pick[1:] != pick[:-1]) | ~valid[:-1] | (doc[1 : len(view)] != doc[: len(view) - 1])
    first = np.flatnonzero(starts)
    stops = valid.copy()
    stops[:-1] &= starts[1:] | ~valid[1:]
    last = np.flatnonzero(stops)
    return h, doc[first], first, last - first + 1, g[pick[first]]


def run_hashes(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of `size` words from `first`."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(h) * _powers(len(h)), dtype=np.uint64)])
    inverse = np.uint64(pow(tb.P, -1, 1 << 64))
    run = (total[first + size] - total[first]) * _power_of(inverse, first)
    return tb.mix(run ^ tb.mix(size.astype(np.uint64)))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, tb.P, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power_of(base: np.uint64, exponent: np.ndarray) -> np.ndarray:
    out, e, b = np.ones(len(exponent), np.uint64), exponent.astype(np.uint64), int(base)
    while e.any():
        out = np.where(e & np.uint64(1), out * np.uint64(b), out)
        b, e = b * b % (1 << 64), e >> np.uint64(1)
    return out


def count_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors found more than once."""

    def run(batches):
        for batch in batches:
            for _, _, data, off in tb.slices(batch.column(0)):
                _, _, _, _, a = anchors(tb.words(data, off), length, gram)
                found, n = np.unique(a, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], ["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def bit_map(found: DataFrame, max_bits: int) -> np.ndarray:
    """One bit for each hash of the one column, in a power of two of bits: 16 a hash, at most max_bits."""
    col = found.columns[0]
    n = found.count()
    bits, goal = 16, min(16 * n, max_bits)
    while 1 << bits < goal:
        bits += 1
    out = np.zeros(1 << (bits - 3), np.uint8)
    index = F.shiftrightunsigned(col, 64 - bits)
    if n <= FEW:
        at = found.select(index.alias("at")).toArrow().column("at").to_numpy()
        np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        return out
    rows = found.select(F.shiftrightunsigned(index, WORD_BITS).alias("piece"), index.bitwiseAND((1 << WORD_BITS) - 1).cast("int").alias("at"))

    def pack(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(piece, kind="stable")
            piece, at = piece[order], at[order]
            for p, part in zip(*_split(piece, at), strict=True):
                held.setdefault(int(p), np.zeros(1 << WORD_BITS, bool))[part] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], ["piece", "bits"])

    # all pieces in one job: they are at most max_bits, and a local iterator runs a job for each partition
    step = 1 << (WORD_BITS - 3)
    pieces = rows.repartition("piece").mapInArrow(pack, "piece long, bits binary").toArrow()
    for piece, part in zip(pieces.column("piece").to_pylist(), pieces.column("bits"), strict=True):
        out[piece * step : (piece + 1) * step] |= np.frombuffer(part.as_buffer(), np.uint8)
    return out


def _split(key: np.ndarray, values: np.ndarray):
    """Runs of an ascending key, and their values."""
    if not len(key):
        return [], []
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.split(values, new[1:])


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    size = (len(bits) * 8).bit_length() - 1
    at = hashes >> np.uint64(64 - size)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def both(anchor: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One hash of an anchor and of what goes with it; together with the anchor it has 128 bits."""
    return tb.mix(anchor ^ tb.mix(other + np.uint64(tb.P)))


def long_array(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def tallied(anchor: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """(anchor, id, n) of a slice."""
    order = np.argsort(ids, kind="stable")
    ids, anchor = ids[order], anchor[order]
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([new, [len(ids)]])).astype(np.int32)
    return pa.RecordBatch.from_arrays([long_array(anchor[new]), long_array(ids[new]), pa.array(n)], ["anchor", "id", "n"])


def runs_of(w: tb.Words, length: int, gram: int):
    """Document, first window, windows, anchor and identity of each run of windows with one anchor."""
    h, doc, first, n, a = anchors(w, length, gram)
    return h, doc, first, n, a, both(a, run_hashes(h, first, n + length - 1)) if len(a) else a


def windows_of(h: np.ndarray, first: np.ndarray, n: np.ndarray, a: np.ndarray, length: int):
    """Run index, first word, anchor and identity of each window of these runs."""
    offs = np.concatenate([[0], np.cumsum(n)])
    run = np.repeat(np.arange(len(n)), n)
    at = first[run] - offs[:-1][run] + np.arange(offs[-1])
    return run, at, a[run], both(a[run], tb.rolling(h, length)[at]) if len(at) else a[run]


def repeats(docs: DataFrame, length: int = 35, gram: int = 10, max_bits: int = 1 << 27) -> DataFrame:
    """Windows found again, as (key, first, windows) with word positions; key identifies id and text.

    Four passes over the texts hand on little: anchors; runs around repeated anchors; windows of the runs
    whose anchor has more than one kind of run; the places of what was found twice. Bit maps keep the passes
    from emitting what is single; equality of hashes decides.
    """
    spark = docs.sparkSession
    repeated = spark.sparkContext.broadcast(bit_map(cut(count_anchors(docs, length, gram)), max_bits))

    def count_runs(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, data, off in tb.slices(batch.column(2)):
                _, doc, _, _, a, ids = runs_of(tb.words(data, off), length, gram)
                on = among(repeated.value, a)
                yield pa.RecordBatch.from_arrays([long_array(a[on]), long_array(ids[on]), pa.array(keys[lo + doc[on]])], ["anchor", "id", "key"])

    keyed = docs.select(*keys_of(), "text")
    runs = cut(keyed.mapInArrow(count_runs, "anchor long, id long, key long").groupBy("anchor", "id").agg(F.count("*").alias("n"), F.min("key").alias("key")))
    whole = runs.where("n > 1").select("anchor", "id")
    kinds = cut(runs.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"))
    # an anchor whose runs all are the same needs no look at single windows
    mixed = spark.sparkContext.broadcast(bit_map(kinds, max_bits))
    is_whole = spark.sparkContext.broadcast(bit_map(whole.select("id"), max_bits))

    def leads(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([long_array(both(*(batch.column(i).to_numpy().view(np.uint64) for i in range(2))))], ["lead"])

    def mistaken(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([long_array(ids[among(is_whole.value, ids)])], ["id"])

    # of a run that occurs again one occurrence, its lead, shows its windows; single runs that the bit map
    # takes for such are told from it by a bit map of their own
    lead = spark.sparkContext.broadcast(bit_map(cut(runs.where("n > 1").select("id", "key").mapInArrow(leads, "lead long")), max_bits))
    single = spark.sparkContext.broadcast(bit_map(cut(runs.where("n = 1").select("id").mapInArrow(mistaken, "id long")), max_bits))

    def count_windows(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            for lo, _, data, off in tb.slices(batch.column(2)):
                h, doc, first, n, a, ids = runs_of(tb.words(data, off), length, gram)
                on = among(mixed.value, a) & (~among(is_whole.value, ids) | among(single.value, ids) | among(lead.value, both(ids, keys[lo + doc])))
                _, _, anchor, wid = windows_of(h, first[on], n[on], a[on], length)
                yield tallied(anchor, wid)

    again = cut(keyed.mapInArrow(count_windows, "anchor long, id long, n int").groupBy("anchor", "id").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "id"))
    is_again = spark.sparkContext.broadcast(bit_map(again.select("id"), max_bits))

    def places(batches):
        for batch in batches:
            keys, more = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, off in tb.slices(batch.column(2)):
                w = tb.words(data, off)
                h, doc, first, n, a, ids = runs_of(w, length, gram)
                on = np.flatnonzero(among(is_whole.value, ids) & among(repeated.value, a))
                part = np.flatnonzero(among(mixed.value, a) & (~among(is_whole.value, ids) | among(single.value, ids)))
                run, at, anchor, wid = windows_of(h, first[part], n[part], a[part], length)
                some = among(is_again.value, wid)
                run, at, anchor, wid = part[run[some]], at[some], anchor[some], wid[some]
                d = np.concatenate([doc[on], doc[run]])
                yield pa.RecordBatch.from_arrays([long_array(np.concatenate([a[on], anchor])), long_array(np.concatenate([ids[on], wid])), pa.array(keys[lo + d]), pa.array(more[lo + d]), pa.array((np.concatenate([first[on], at]) - w.first[d]).astype(np.int32)), pa.array(np.concatenate([n[on], np.ones(len(at), np.int64)]).astype(np.int32))], ["anchor", "id", "key", "key2", "first", "windows"])

    found = keyed.mapInArrow(places, "anchor long, id long, key long, key2 long, first int, windows int")
    return found.join(whole.unionByName(again), ["anchor", "id"]).select("key", "key2", "first", "windows")


def keys_of() -> list[Column]:
    """128 bits of a row's id and text, as two numbers."""
    return [F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"), F.xxhash64(F.lit("text"), F.col("doc_id"), F.col("text")).alias("key2")]


def dedup(docs: DataFrame, length: int = 35, gram: int = 10, max_bits: int = 1 << 27) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) for each row.

    Only rows whose key a bit map of the keys with repeats lets through meet their repeats by a join; the texts
    of the others are not shuffled.
    """
    docs = docs.select("doc_id", "text")
    # a set, as rows that repeat as a whole share a key and its repeats
    found = cut(repeats(docs, length, gram, max_bits).groupBy("key", "key2").agg(F.collect_set(F.struct("first", "windows")).alias("runs")))
    with_runs = docs.sparkSession.sparkContext.broadcast(bit_map(found.select("key"), max_bits))
    keyed = docs.select(*keys_of(), "doc_id", "text")

    def hit(batches, on: bool):
        for batch in batches:
            yield batch.filter(pa.array(among(with_runs.value, batch.column(0).to_numpy().view(np.uint64)) == on))

    def plain(batches):
        for batch in hit(batches, False):
            yield without(batch.column(2), batch.column(3), [None] * batch.num_rows, length)

    def run(batches):
        for batch in batches:
            yield without(batch.column(0), batch.column(1), batch.column(2), length)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_removed long, kept binary"
    some = keyed.mapInArrow(lambda batches: hit(batches, True), f"key long, key2 long, doc_id {kind}, text string")
    rows = some.join(found, ["key", "key2"], "left").select("doc_id", "text", F.expr("flatten(transform(runs, r -> sequence(r.first, r.first + r.windows - 1)))").alias("at"))
    return keyed.mapInArrow(plain, out).unionByName(rows.mapInArrow(run, out)).withColumn("kept", F.decode("kept", "UTF-8"))


def without(ids: pa.Array, texts: pa.Array, at, length: int) -> pa.RecordBatch:
    """ids, n_words, n_removed and kept (bytes); at: the first words of each text's repeated windows, or null."""
    removed, total, kept = [], [], []
    for lo, hi, data, off in tb.slices(texts):
        w = tb.words(data, off)
        for d in range(lo, hi):
            a, b = w.first[d - lo], w.first[d - lo + 1]
            begins = at[d].values if at[d] is not None else None
            n = int(b - a)
            if begins is None or not len(begins):
                total.append(n)
                removed.append(0)
                kept.append(join(data, w.start[a:b], w.end[a:b]))
                continue
            gone = np.zeros(n + 1, np.int64)
            first = np.unique(begins.to_numpy())
            np.add.at(gone, first, 1)
            np.add.at(gone, first + length, -1)
            gone = np.cumsum(gone)[:n] > 0
            left = np.flatnonzero(~gone) + a
            total.append(n)
            removed.append(int(gone.sum()))
            kept.append(join(data, w.start[left], w.end[left]))
    return pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def join(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words at these spans with one space between."""
    if not len(start):
        return b""
    n = end - start + 1
    offs = np.cumsum(n) - n
    out = np.full(int(n.sum()), 0x20, np.uint8)
    src = np.repeat(start - offs, n) + np.arange(len(out))
    src[offs + n - 1] = 0
    out[:] = data[src]
    out[offs + n - 1] = 0x20
    return out[:-1].tobytes()
