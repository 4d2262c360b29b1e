"""Language-model scoring with a probabilistic suffix tree.

Symbols are the UTF-8 bytes of a text's words (ASCII letters in lower case) with one space between words
and an end mark. Runs of `depth` + 1 symbols are counted over all training texts; all shorter contexts
follow by summation. A context is kept if its next-symbol distribution diverges from that of its suffix
(count times Kullback-Leibler divergence of at least `gain` nats), or if a longer kept one needs it.
Distributions are smoothed towards the suffix's (Witten-Bell), down to uniform. A symbol is scored in the
state of the longest kept suffix of what precedes it. The whole tree is broadcast, in parts of about
`max_rows` next-symbol counts each: a part has the longer contexts that end in a range of two bytes, which
each symbol's own context picks, and all contexts of less than two bytes. Any number of parts gives the same
scores.

Word counts are gathered for all training tokens as well, keyed by 64-bit word hashes; words above a count
that at most `head` words reach are broadcast, the rest are joined by shuffling. A null text is empty, and
its only token is the end. With nothing to learn from, symbols are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import cut

U64 = np.uint64
END, START, SPACE = 0xFF, 0xFE, 0x20
END_WORD = 0x5DEECE66D1234567
PENDING = 4_000_000


def stream(w: tb.Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all documents, `depth` start marks before each, and each document's first index."""
    docs = len(w.off) - 1
    length = w.end - w.start
    n = w.per_doc
    used = np.concatenate([[0], np.cumsum(length + 1)])
    sizes = np.maximum(used[w.first[1:]] - used[w.first[:-1]], 1) + depth
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(first[-1], START, np.uint8)
    out[first[1:] - 1] = END
    if len(length):
        doc = np.repeat(np.arange(docs), n)
        to = first[doc] + depth + used[:-1] - used[w.first[doc]]
        at = np.cumsum(length) - length
        move = np.repeat(to - at, length) + np.arange(int(length.sum()))
        src = np.repeat(w.start - at, length) + np.arange(int(length.sum()))
        out[move] = w.data[src]
        gap = to + length
        inner = gap < first[doc + 1] - 1
        out[gap[inner]] = SPACE
    return out, first


def codes(symbols: np.ndarray, size: int) -> np.ndarray:
    """The last `size` symbols up to each index, packed; the first size - 1 entries are short."""
    out = np.zeros(len(symbols), U64)
    for j in range(size):
        back = size - 1 - j
        out <<= U64(8)
        out[back:] |= symbols[: len(symbols) - back]
    return out


@dataclass
class Tree:
    depth: int
    #: By context length: packed context and symbol, ascending, and log10 probability.
    pairs: list[tuple[np.ndarray, np.ndarray]]
    #: By context length: packed context, ascending, and log10 of the weight of its suffix.
    states: list[tuple[np.ndarray, np.ndarray]]
    #: The last two bytes, as one number, of the contexts that the tree is whole for.
    lo: int = 0
    hi: int = 0xFFFF

    def score(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each document's symbols."""
        return score_symbols([self], symbols, first)

    def fill(self, full: np.ndarray, idx: np.ndarray, value: np.ndarray) -> None:
        """log10 probability of the last symbol of full[idx], each after the symbols before it."""
        for k in range(self.depth, -1, -1):
            if not len(idx):
                break
            want = full[idx] & U64((1 << (8 * (k + 1))) - 1)
            known, logp = self.pairs[k]
            at, hit = _find(known, want)
            value[idx[hit]] += logp[at[hit]]
            idx, context = idx[~hit], want[~hit] >> U64(8)
            known, weight = self.states[k]
            at, hit = _find(known, context)
            value[idx[hit]] += weight[at[hit]]
        value[idx] -= np.log10(256)


def score_symbols(parts: list[Tree], symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each document's symbols, each looked up in the part that has its context."""
    depth = parts[0].depth
    on = np.ones(len(symbols), bool)
    for k in range(depth):
        on[first[:-1] + k] = False
    # equal runs have equal scores
    full, inverse = np.unique(codes(symbols, depth + 1)[on], return_inverse=True)
    ends = (full >> U64(8)) & U64(0xFFFF)
    each = np.zeros(len(full))
    for part in parts:
        part.fill(full, np.flatnonzero((ends >= part.lo) & (ends <= part.hi)), each)
    value = np.zeros(len(symbols))
    value[on] = each[inverse]
    return tb.per_doc_sum(value, first)


def _find(known: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.searchsorted(known, want)
    at[at == len(known)] = 0
    return at, known[at] == want


def counted(train: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(word hash, n) with the end token, and (code, n) of symbol runs."""

    def run(batches):
        held: dict[int, list] = {0: [], 1: []}
        size = 0

        def flush():
            for kind, parts in held.items():
                if parts:
                    v = np.concatenate([p[0] for p in parts])
                    n = np.concatenate([p[1] for p in parts])
                    u, inverse = np.unique(v, return_inverse=True)
                    total = np.bincount(inverse, n).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int8)), pa.array(u.view(np.int64)), pa.array(total)], ["kind", "code", "n"])
                    parts.clear()

        for batch in batches:
            for lo, hi, data, off in tb.slices(batch.column(0)):
                w = tb.words(tb.LOWER[data], off)
                s, first = stream(w, depth)
                c = codes(s, depth + 1)
                on = np.ones(len(s), bool)
                for k in range(depth):
                    on[first[:-1] + k] = False
                words_ = np.concatenate([tb.word_hashes(w), np.full(hi - lo, END_WORD, U64)])
                for kind, v in ((0, words_), (1, c[on])):
                    held[kind].append(np.unique(v, return_counts=True))
                    size += len(held[kind][-1][0])
                if size > PENDING:
                    yield from flush()
                    size = 0
        yield from flush()

    rows = cut(train.select("text").mapInArrow(run, "kind byte, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")))
    return rows.where("kind = 0").select(F.col("code").alias("word"), "n"), rows.where("kind = 1").select("code", "n")


def low_bytes(n: str) -> Column:
    """Mask of the last n bytes."""
    return F.expr(f"shiftleft(1L, cast(8 * ({n}) as int)) - 1")


def grow(grams: DataFrame, depth: int, gain: float = 4.0, max_rows: int = 600_000) -> Iterator[Tree]:
    """Count contexts of every length, keep those that diverge, and collect the tree part by part."""
    level = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("k")
    if not 0 <= depth <= 6:
        raise ValueError("contexts of 0 to 6 symbols are packed into 64 bits")
    mask = low_bytes("k + 1")
    pairs = grams.select("code", "n", level).select("k", F.col("code").bitwiseAND(mask).alias("code"), "n").groupBy("k", "code").agg(F.sum("n").alias("n"))
    pairs = cut(pairs.withColumn("context", F.shiftrightunsigned("code", 8)))
    totals = pairs.groupBy("k", "context").agg(F.sum("n").alias("total"))
    p = cut(pairs.join(totals, ["k", "context"]))
    up = p.select((F.col("k") + 1).alias("k"), F.col("code").alias("suffix"), F.col("n").alias("n_up"), F.col("total").alias("total_up"))
    cut_code = F.col("code").bitwiseAND(low_bytes("k"))
    term = F.col("n") * F.log((F.col("n") / F.col("total")) / (F.col("n_up") / F.col("total_up")))
    gains = p.where("k > 0").withColumn("suffix", cut_code).join(up, ["k", "suffix"]).groupBy("k", "context").agg(F.sum(term).alias("gain"), F.count("*").alias("rows"))
    gains = cut(gains)
    kept = gains.where(F.col("gain") >= gain)
    # suffixes of a kept context are kept
    down = kept.select("context", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("j")).select(F.col("j").alias("k"), F.col("context").bitwiseAND(low_bytes("j")).alias("context")).distinct()
    rows = cut(p.join(cut(down), ["k", "context"], "left_semi").unionByName(p.where("k = 0")).select("k", "code", "n", F.col("context").bitwiseAND(F.lit(0xFFFF)).alias("ends")))
    for lo, hi in ranges(rows, max_rows):
        table = rows.where((F.col("k") < 2) | F.col("ends").between(lo, hi)).select("k", "code", "n").toArrow()
        k, code, n = (table.column(c).to_numpy() for c in ("k", "code", "n"))
        yield replace(smooth(k.astype(np.int64), code.view(U64), n.astype(np.float64), depth), lo=lo, hi=hi)


def ranges(rows: DataFrame, max_rows: int) -> list[tuple[int, int]]:
    """Ranges that cover all pairs of last bytes, of at most `max_rows` rows each or a single pair."""
    sizes = rows.where("k >= 2").groupBy("ends").count().toArrow()  # at most 65,536 rows
    out, lo, held = [], 0, 0
    for end, n in sorted(zip(sizes.column("ends").to_pylist(), sizes.column("count").to_pylist(), strict=True)):
        if held and held + n > max_rows:
            out.append((lo, end - 1))
            lo, held = end, 0
        held += n
    return [*out, (lo, 0xFFFF)]


def smooth(k: np.ndarray, code: np.ndarray, n: np.ndarray, depth: int) -> Tree:
    """Witten-Bell: a context with t kinds of next symbols gives its suffix the weight t / (n + t)."""
    pairs, states = [], []
    for level in range(depth + 1):
        on = np.flatnonzero(k == level)
        on = on[np.argsort(code[on])]
        c, m = code[on], n[on]
        context = c >> U64(8)
        new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(c) else np.zeros(0, np.int64)
        total = np.add.reduceat(m, new) if len(c) else np.zeros(0)
        kinds = np.diff(np.concatenate([new, [len(c)]]))
        each = np.repeat(np.arange(len(new)), kinds)
        if level:
            lower = c & U64((1 << (8 * level)) - 1)
            at, hit = _find(pairs[-1][0], lower)
            below = np.where(hit, 10.0 ** pairs[-1][1][at], 0.0)
        else:
            below = np.full(len(c), 1 / 256)
        p = (m + kinds[each] * below) / (total + kinds)[each] if len(c) else np.zeros(0)
        pairs.append((c, np.log10(p)))
        states.append((context[new], np.log10(kinds / (total + kinds)) if len(c) else np.zeros(0)))
    return Tree(depth, pairs, states)


def head_words(words: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words with at least a count that at most `head` words reach."""
    # counts are binned by powers of 2^(1/4), so that the histogram is short at any size
    rung = F.floor(F.log2("n") * 4).cast("int")
    sizes = sorted(((r["rung"], r["count"]) for r in words.groupBy(rung.alias("rung")).count().toLocalIterator()), reverse=True)
    total, least = 0, None
    for at, size in sizes:
        total += size
        if total > head:
            break
        least = at
    if least is None:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    table = words.where(rung >= least).select("word", "n").toArrow()
    h = table.column("word").to_numpy().view(U64)
    order = np.argsort(h)
    return h[order], table.column("n").to_numpy()[order]


def score(docs: DataFrame, train: DataFrame, keep: list[Column], depth: int = 5, gain: float = 4.0, max_rows: int = 600_000, head: int = 1 << 18) -> DataFrame:
    """The kept columns, n_tokens, n_known, train_tokens, base_score and score for each row."""
    words, grams = counted(train, depth)
    context = docs.sparkSession.sparkContext
    parts = [context.broadcast(part) for part in grow(grams, depth, gain, max_rows)]
    n, v = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
    known, counts = head_words(words, head)
    floor = n + 0.5 * (v + 1)
    held = context.broadcast((known, counts))
    rows = docs.select(*keep, F.col("text").alias("__text"))
    names = rows.columns[:-1]

    def run(batches):
        trees = [part.value for part in parts]
        h, c = held.value
        log = np.log10((c + 0.5) / floor)
        for batch in batches:
            for lo, hi, data, off in tb.slices(batch.column(len(names))):
                w = tb.words(tb.LOWER[data], off)
                symbols, first = stream(w, depth)
                total = score_symbols(trees, symbols, first)
                hashes = np.insert(tb.word_hashes(w), w.first[1:], U64(END_WORD))
                tokens = w.first + np.arange(hi - lo + 1)
                at, hit = _find(h, hashes)
                base = tb.per_doc_sum(np.where(hit, log[at] if len(log) else 0.0, 0.0), tokens)
                seen = tb.per_doc_sum(hit, tokens)
                rest = np.concatenate([[0], np.cumsum(~hit)])[tokens]
                yield pa.RecordBatch.from_arrays([*(col.slice(lo, hi - lo) for col in batch.columns[:-1]), pa.array(np.diff(tokens)), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(total), tb.list_array(rest, hashes[~hit].view(np.int64), pa.int64())], [*names, "n_tokens", "n_known", "base", "score", "rest"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = cut(rows.mapInArrow(run, f"{schema}, n_tokens long, n_known long, base double, score double, rest array<long>").withColumn("__rid", F.monotonically_increasing_id()))
    tail = out.select("__rid", F.explode("rest").alias("word")).groupBy("__rid", "word").agg(F.count("*").alias("m")).join(words, "word")
    tail = tail.groupBy("__rid").agg(F.sum("m").alias("more"), F.sum(F.col("m") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))).alias("extra"))
    return out.join(tail, "__rid", "left").select(
        *(F.col(f"`{c}`") for c in names),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.size("rest") * F.log10(F.lit(0.5 / floor)) + F.coalesce("extra", F.lit(0.0))).alias("base_score"),
        "score",
    )
