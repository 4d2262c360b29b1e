"""Near-duplicate groups by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its runs of five words (digits, ASCII letters in lower case, non-ASCII
characters); a shorter text, if it has a word, is one run. Weights are counts, discretised at whole numbers;
the levels are split into dyadic blocks (0,1], (1,2], (2,4], ... Each block of an element is a Poisson
process of points with a signature slot and a level; points above the weight are thinned out. A slot keeps
its least point, so two signatures agree in a slot with the probability of the weighted Jaccard similarity.
Points come in ascending order and stop once no slot can change.

Texts with the same multiset count once. Bands of the signature give buckets. Each bucket's least member is
compared with the others by exact overlap (sum of minima over sum of maxima), and classes that are linked are
united. Buckets that still hold more than one class are compared whole: large ones in blocks of about `block`
members or `block_bytes` bytes, each pair of blocks a task, which hands on a spanning set of the links and no
pairs. Every pair of classes that meet in a bucket is compared; there is no cap on members or partners.

Results: every row has the class_id, the least doc_id of its class (null if none has an id). A text without a
word is in a class with its exact copies; null and empty texts are classes of their own. Rows that repeat id
and text count as copies; a text of any length is used whole, and where a class has ties the least id, then the
least key stands for it. An empty table gives no rows. Other columns of the documents may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf as tb
from .common import free, small, stored

U64 = np.uint64
SLOTS, BAND_ROWS = 128, 5
BANDS = SLOTS // BAND_ROWS
SHINGLE = 5
#: Rows of two or three numbers that may be broadcast: some 10 MB.
PLAIN_ROWS = 400_000


def elements(w: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash of 48 bits, count), by document and hash."""
    h = tb.word_hashes(w)
    n = w.per_doc
    grams = tb.rolling(h, SHINGLE)
    doc = w.doc()
    ok = doc[: len(grams)] == doc[SHINGLE - 1 : SHINGLE - 1 + len(grams)]
    composite = [(doc[: len(grams)][ok].astype(U64) << U64(48)) | (grams[ok] >> U64(16))]
    brief = [(d, xxhash.xxh3_64_intdigest(b" ".join(w.text(i) for i in range(w.first[d], w.first[d + 1]))) >> 16) for d in np.flatnonzero((n > 0) & (n < SHINGLE))]
    if brief:
        composite.append(np.array([(int(d) << 48) | x for d, x in brief], U64))
    sorted_ = np.sort(np.concatenate(composite))
    if not len(sorted_):
        return np.zeros(0, np.int64), sorted_, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    count = np.diff(np.concatenate([new, [len(sorted_)]]))
    unique = sorted_[new]
    return (unique >> U64(48)).astype(np.int64), unique & U64((1 << 48) - 1), count


def signatures(docs: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """docs x slots, the least Poisson point of each slot; infinite for a document without elements."""
    sig = np.full(docs * slots, np.inf)
    if not len(doc):
        return sig.reshape(docs, slots)
    # dyadic blocks: block 0 is (0, 1], block b > 0 is (2^(b-1), 2^b]
    top = np.ceil(np.log2(weight)).astype(np.int64)
    of = np.repeat(np.arange(len(doc)), top + 1)
    block = np.arange(len(of)) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    size = np.where(block > 0, low, 1)
    seed = tb.mix(shingle[of] ^ (block.astype(U64) << U64(50)))
    row, room = doc[of] * slots, weight[of] - low
    rate = size * float(slots)
    x = np.zeros(len(of))
    limit = np.full(docs, np.inf)
    r = 0
    while len(seed):
        r += 1
        seed = tb.mix(seed + U64(tb.P))
        x = x - np.log(tb.unit(seed)) / rate
        pick = tb.mix(seed ^ U64(0xD6E8FEB86659FD93))
        slot = row + (pick >> U64(40)).astype(np.int64) % slots
        level = (pick & U64(0xFFFFFFFF)).astype(np.int64) % size  # below the size, in this block
        hit = (level < room) & (x < sig[slot])
        np.minimum.at(sig, slot[hit], x[hit])
        if r < 4 or r % 4 == 0:
            at = np.unique(row // slots) if r > 16 else np.arange(docs)
            limit[at] = sig.reshape(docs, slots)[at].max(1)
        on = x < limit[row // slots]
        if not on.all():
            seed, x, row, room, rate, size = seed[on], x[on], row[on], room[on], rate[on], size[on]
    return sig.reshape(docs, slots)


def bands(sig: np.ndarray) -> np.ndarray:
    """docs x BANDS hashes; equal where all rows of a band agree."""
    bits = sig[:, : BANDS * BAND_ROWS].copy().view(U64).reshape(len(sig), BANDS, BAND_ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(tb.P), (len(sig), BANDS)).copy()
    for k in range(BAND_ROWS):
        h = tb.mix(h ^ bits[:, :, k])
    return h.view(np.int64)


def text_keys(data: np.ndarray, raw: np.ndarray, off: np.ndarray) -> tuple[list[str | None], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """128 bits of each text's multiset, or of its bytes where it has no word; null if empty. And the elements."""
    found = elements(tb.words(data, off, tb.ALNUM))
    doc, shingle, count = found
    at = np.searchsorted(doc, np.arange(len(off)))
    keys = []
    for d, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if b > a:
            keys.append(xxhash.xxh3_128_hexdigest(shingle[a:b].tobytes() + count[a:b].tobytes()))
        else:
            keys.append("=" + xxhash.xxh3_128_hexdigest(raw[off[d] : off[d + 1]].tobytes()) if off[d + 1] > off[d] else None)
    return keys, found


def keys_of(column: pa.Array) -> list[str | None]:
    return [k for _, _, data, off in tb.slices(column) for k in text_keys(tb.LOWER[data], data, off)[0]]


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key (128 bits of the shingle multiset, null for an empty text), bands (none without words)."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in tb.slices(batch.column(1)):
                keys, (doc, shingle, count) = text_keys(tb.LOWER[data], data, off)
                b = bands(signatures(hi - lo, doc, shingle, count))
                has = np.diff(np.searchsorted(doc, np.arange(hi - lo + 1))) > 0
                offs = np.concatenate([[0], np.cumsum(has * BANDS)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(keys, pa.string()), tb.list_array(offs, b[has].ravel(), pa.int64())], ["doc_id", "key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key string, bands array<long>")


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingle multisets, row by row."""
    out = np.zeros(len(a))
    lo = 0
    sizes = np.diff(tb.buffer(a)[1]) + np.diff(tb.buffer(b)[1])
    total = np.concatenate([[0], np.cumsum(sizes)])
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + tb.SLICE_BYTES, "right")) - 1)
        hi = min(hi, lo + tb.SLICE_DOCS)
        sides = []
        for side in (a, b):
            raw, off = tb.buffer(side.slice(lo, hi - lo))
            doc, shingle, count = elements(tb.words(tb.LOWER[raw[off[0] : off[-1]]], off - off[0], tb.ALNUM))
            sides.append(((doc.astype(U64) << U64(48)) | shingle, doc, count))
        (ka, da, ca), (kb, db, cb) = sides
        _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        common = np.bincount(da[ia], np.minimum(ca[ia], cb[ib]), minlength=hi - lo)
        both = np.bincount(da, ca, minlength=hi - lo) + np.bincount(db, cb, minlength=hi - lo) - common
        out[lo:hi] = common / np.maximum(both, 1)
        lo = hi
    return out


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts overlap enough."""
    left = texts.select(F.col("k").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("k").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            ok = pa.array(overlap(batch.column(2), batch.column(3)) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(k, label): the least node of each connected component, by label exchange and pointer jumps.

    Each round reads written tables, so that all rounds have plans of the same size.
    """
    ends = [edges.select(F.col(x).alias("k"), F.col(y).alias("other")) for x, y in ("ab", "ba", "aa", "bb")]
    near = stored(ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).distinct())  # each node is near itself
    labels = stored(near.groupBy("k").agg(F.min("other").alias("label")))
    n = labels.count()
    while True:
        told = near.join(small(labels.select(F.col("k").alias("other"), "label"), n, PLAIN_ROWS), "other")
        told = told.groupBy("k").agg(F.min("label").alias("label"), F.min(F.when(F.col("other") == F.col("k"), F.col("label"))).alias("old"))
        jump = small(labels.select(F.col("k").alias("label"), F.col("label").alias("far")), n, PLAIN_ROWS)
        step = stored(told.join(jump, "label").select("k", "old", F.col("far").alias("label")))
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("k", "label")
        if not changed:
            return labels


def compare(threshold: float):
    """A function of one group of block members that gives links (a, b) between classes, at most one less than there are."""

    def links(group: pa.Table) -> pa.Table:
        group = group.sort_by("k").combine_chunks()
        bucket, lo, hi = (group.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
        m = group.num_rows
        block, cls = group.column("block").to_numpy(), group.column("cls").to_numpy()
        signature = np.array(group.column("bands").to_pylist(), np.int64)
        band = int(np.flatnonzero(signature[0] == bucket)[0])
        texts = group.column("text").combine_chunks()
        owner, shingle, count = [], [], []
        for at, _, data, off in tb.slices(texts):
            d, x, n = elements(tb.words(tb.LOWER[data], off, tb.ALNUM))
            owner.append(d + at)
            shingle.append(x)
            count.append(n)
        owner, count = np.concatenate(owner), np.concatenate(count)
        of = np.unique(np.concatenate(shingle), return_inverse=True)[1]
        own = np.searchsorted(owner, np.arange(m + 1))
        order = np.argsort(of, kind="stable")
        by_owner, by_count = owner[order], count[order]
        begin = np.searchsorted(of[order], np.arange(int(of.max(initial=-1)) + 2))
        size = np.bincount(owner, count, minlength=m)
        now, out = cls.copy(), []
        for i in range(m):
            other = np.zeros(m, bool)
            other[i + 1 :] = True
            if lo != hi:
                other &= block != block[i]
            other &= (now != now[i]) & (np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i]))
            # a pair that met in an earlier band is compared there
            other &= ~(signature[:, :band] == signature[i, :band]).any(1)
            if not other.any():
                continue
            mine = slice(own[i], own[i + 1])
            a, b = begin[of[mine]], begin[of[mine] + 1]
            n = b - a
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            common = np.bincount(by_owner[at], np.minimum(np.repeat(count[mine], n), by_count[at]), minlength=m)
            for j in np.flatnonzero(other & (common >= threshold * (size + size[i] - common))):
                if now[j] != now[i]:
                    out.append((cls[i], cls[j]))
                    now[now == now[j]] = now[i]
        return pa.table([pa.array([int(x) for x, _ in out], pa.int64()), pa.array([int(y) for _, y in out], pa.int64())], ["a", "b"])

    return links


def link(docs: DataFrame, threshold: float = 0.8, block: int = 256, block_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key), and keys (key, doc_id: the least, label: the least k of the class)."""
    docs = docs.select("doc_id", "text")
    rows = stored(sketch(docs))
    keys = stored(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")).withColumn("k", F.monotonically_increasing_id()))
    rows, lone = rows.select("doc_id", "key"), keys.select("key", "doc_id", F.col("k").alias("label"))
    each = keys.select("k", F.explode("bands").alias("bucket"))
    full = stored(each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("k").alias("rep")).where("n > 1").select("bucket", "rep"))
    n = full.count()
    if not n:
        return rows, lone
    member = stored(each.join(small(full, n, PLAIN_ROWS), "bucket").select("bucket", "k", "rep"))
    want = stored(member.select("k").distinct().join(keys, "k"))
    texts = candidate_texts(docs, want)
    # each bucket's least member against the others
    pairs = member.where("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b")).distinct()
    labels = components(stored(verified(pairs, texts, threshold)))
    # buckets that still hold more than one class are compared whole, in blocks
    count = labels.count()
    of = member.join(small(labels, count, PLAIN_ROWS), "k", "left").select("bucket", "k", F.coalesce("label", "k").alias("cls"))
    sized = stored(of.join(texts.select("k", F.octet_length("text").alias("size")), "k"))
    mixed = stored(sized.groupBy("bucket").agg(F.min("cls").alias("least"), F.max("cls").alias("most"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("least <> most").select("bucket", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("blocks")))
    part = sized.drop("size").join(small(mixed, mixed.count(), PLAIN_ROWS), "bucket").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    part = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "k", "cls")
    more = stored(part.join(texts, "k").groupBy("bucket", "lo", "hi").applyInArrow(compare(threshold), "a long, b long"))
    again = components(more).select(F.col("k").alias("label"), F.col("label").alias("cls"))
    known = keys.select("key", "doc_id", "k").join(small(labels, count, PLAIN_ROWS), "k", "left").select("key", "doc_id", F.coalesce("label", "k").alias("label"))
    known = known.join(small(again, again.count(), PLAIN_ROWS), "label", "left").select("key", "doc_id", F.coalesce("cls", "label").alias("label"))
    return rows, stored(known)


def candidate_texts(docs: DataFrame, want: DataFrame) -> DataFrame:
    """(k, bands, text) of the wanted keys: found by the id, then by the key that the text gives, as an id may repeat."""
    n, nameless = want.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    some = docs.join(small(want.select("doc_id").where("doc_id is not null").distinct(), n), "doc_id", "left_semi")
    if nameless:
        some = some.unionByName(docs.where("doc_id is null"))
    texts = named(some).join(small(want.select("k", "key"), n), "key").groupBy("k").agg(F.min("text").alias("text"))
    return stored(texts.join(want.select("k", "bands"), "k"))


def named(docs: DataFrame) -> DataFrame:
    """key, text: the key of each text, without its signature."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(batch.column(0)), pa.string()), batch.column(0)], ["key", "text"])

    return docs.select("text").mapInArrow(run, "key string, text string").where("key is not null")


def classes(docs: DataFrame, threshold: float = 0.8, **how) -> DataFrame:
    """doc_id, key, label and class_id for each row; key and label are null for an empty text."""
    rows, known = link(docs, threshold, **how)
    least = stored(known.groupBy("label").agg(F.min("doc_id").alias("class_id")))
    by_key = stored(known.join(least, "label").select("key", "label", "class_id"))
    # empty texts stay out of the join: their key is null, and all would meet in one task
    alone = rows.where("key is null").select("doc_id", "key", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("class_id"))
    return rows.where("key is not null").join(small(by_key, by_key.count()), "key").select("doc_id", "key", "label", "class_id").unionByName(alone)


def dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class (the least id, then key), with all of its columns; empty texts all stay."""
    found = stored(classes(docs, threshold))
    names = [F.col(f"`{c}`") for c in docs.columns]
    if not found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        # ids tell rows apart: drop those of the other members
        gone = found.where("key is not null and doc_id <> class_id").select("doc_id")
        return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*names)
    # else the rows of each class's least id and key, one of those that are the same
    key = free(docs, "row_key")
    keyed = with_key(docs, key)
    best = found.where("key is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m")).select(F.col("m.doc_id").alias("best_id"), F.col("m.key").alias("best_key"))
    one = keyed.join(best, F.col(f"`{key}`").eqNullSafe(F.col("best_key")) & keyed["doc_id"].eqNullSafe(F.col("best_id")), "left_semi").dropDuplicates([key])
    return one.unionByName(keyed.where(f"`{key}` is null")).select(*names)


def with_key(docs: DataFrame, key: str) -> DataFrame:
    """All columns, and the key of the text under this name."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys_of(batch.column(at)), pa.string())], [*batch.schema.names, key])

    return docs.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType, True) for f in docs.schema.fields), T.StructField(key, T.StringType(), True)]))
