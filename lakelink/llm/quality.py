"""Quality rules: exact base rules, and robust multivariate outliers.

Each text gives a vector of four statistics, on scales that make clean texts near-normal: logarithm of the mean
word length, square roots of the shares of symbols and of capitals, and logarithmic variety of words. (Digits,
doubled lines and repeated words are absent from most clean texts: they have no scatter to estimate, and the base
rules judge repeats.) Each language and source with `min_rows` texts is a group; the texts of a language's
smaller sources form one, and what is left then another; a group under `min_rows` has no estimate.

Minimum-covariance-determinant of each group, over all of its rows: three deterministic starts (quartiles,
covariance of bounded scores, of spatial signs), and from each concentration steps until the determinant no
longer falls: squared distances are summed up in logarithmic bins together with the moments of their rows, the bins
below the median give the next centre and scatter. The start of least determinant counts; its scatter has the
consistency factor of the half's share, and the mean sampling variance of the statistics (at most 1/4n for a share
of n) is added, so that a statistic that is the same in all texts has a spread. A text goes if its squared
Mahalanobis distance is beyond the chi-square 0.999 point and beyond the group's own fence: `FENCE` times the
logarithm of median over first quartile above the median (54 for normal rows), which like the estimate
itself depends on the inner half alone.

Null and wordless texts fail the base rules and take no part in the estimates. Null languages and sources are
values of their own. Repeated rows are rows; rows with equal distances go or stay together; texts are measured
whole. An empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf as tb
from .common import free, small, stored

#: Characters that count as symbols.
SYMBOLS = tb._table(b"#*$%&|<>")
UPPER, LOWER = tb._table(range(65, 91)), tb._table(range(97, 123))
#: Statistics, in order; see vectors().
STATS = ("word_length", "symbols", "capitals", "variety")
P = len(STATS)
#: The 0.999 point of the chi-square distribution with P = 4 degrees of freedom.
LEAST_CUT = 18.467
#: A group's cut-off: so many times the logarithmic distance from first quartile to median, beyond the median.
FENCE = 5.0
MIN_ROWS = 10 * P
#: Bins of squared distances by powers of two.
BINS = 8
#: Groups whose estimates (some 400 bytes each, for three starts) may be broadcast.
MODEL_ROWS = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _mid_bytes(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def repeat_words(w: tb.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document: words in 3-word windows found twice or more; distinct words."""
    docs, doc = len(w.off) - 1, w.doc()
    if not len(h):
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    # 16 bits of document and 48 of hash: one sort of plain numbers puts equal values of a text together
    place = doc.astype(np.uint64) << np.uint64(48)
    distinct = np.bincount((_runs(place | (h >> np.uint64(16)))[0] >> np.uint64(48)).astype(np.int64), minlength=docs)
    g = tb.rolling(h, 3)
    begin = np.flatnonzero(doc[: len(g)] == doc[2 : 2 + len(g)]) if len(g) else np.zeros(0, np.int64)
    if not len(begin):
        return np.zeros(docs, np.int64), distinct
    grams = place[begin] | (g[begin] >> np.uint64(16))
    value, n = _runs(grams)
    twice = value[n > 1]
    if not len(twice):
        return np.zeros(docs, np.int64), distinct
    at = np.searchsorted(twice, grams)
    at[at == len(twice)] = 0
    again = begin[twice[at] == grams]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(doc[covered], minlength=docs), distinct


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs."""
    v = np.sort(values)
    new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return v[new], np.diff(np.concatenate([new, [len(v)]]))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Base counts and further raw counts of each text."""
    held: dict[str, list] = {k: [] for k in (*BASE, "upper", "letters", "distinct")}
    for _, _, data, off in tb.slices(column):
        w = tb.words(data, off)
        h = tb.word_hashes(w)
        total = lambda mask: tb.per_doc_sum(mask, off)
        space = ~tb.NOT_SPACE[data]
        repeated, distinct = repeat_words(w, h)
        held["n_words"].append(w.per_doc)
        held["word_chars"].append(total(_mid_bytes(data) & ~space))
        held["n_symbols"].append(total(SYMBOLS[data]))
        held["n_repeat_words"].append(repeated)
        held["distinct"].append(distinct)
        held["upper"].append(total(UPPER[data]))
        held["letters"].append(total(UPPER[data] | LOWER[data] | (data >= 0xC0)))
        raw = data.tobytes()
        held["n_dup_lines"].append(np.array([dup_lines(raw[a:b].decode("utf-8", "surrogatepass")) if b > a else 0 for a, b in zip(off[:-1], off[1:], strict=True)], np.int64))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in held.items()}


def vectors(m: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of STATS, each followed by their sampling variances."""
    n, chars, letters = (np.maximum(m[k], 1.0) for k in ("n_words", "word_chars", "letters"))
    size = np.log(n + 1)
    return np.column_stack([
        np.log(chars / n), np.sqrt(m["n_symbols"] / chars), np.sqrt(m["upper"] / letters), np.log(np.maximum(m["distinct"], 1)) / size,
        0.25 / n, 0.25 / chars, 0.25 / letters, 0.25 / (n * size * size),
    ])


def measured(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The kept columns, and under the name: s (base counts) and v (the vector) of the text."""
    at = docs.columns.index("text")
    index = [docs.columns.index(c) for c in keep]

    def run(batches):
        for batch in batches:
            m = measure(batch.column(at))
            each = [tb.list_array(np.arange(batch.num_rows + 1) * x.shape[1], x.ravel(), kind) for x, kind in ((np.column_stack([m[k] for k in BASE]), pa.int64()), (vectors(m), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in index), pa.StructArray.from_arrays(each, ["s", "v"])], [*keep, name])

    fields = [T.StructField(c, docs.schema[c].dataType, True) for c in keep]
    stats = T.StructType([T.StructField("s", T.ArrayType(T.LongType())), T.StructField("v", T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, stats)]))


def failed(stats: str) -> Column:
    n, repeated = F.col(stats)["s"][0], F.col(stats)["s"][4]
    return (n < 50) | (100 * repeated > 50 * n)


def cell() -> Column:
    """A row's language and source, values told from their absence."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.struct(part("lang").alias("lang"), part("source").alias("source"))


def grouped(cells: DataFrame, min_rows: int) -> DataFrame:
    """(cell, g) from (cell, n): the number of each cell's group; none for a group that is too small."""
    cells = cells.withColumn("own", F.col("n") >= min_rows)
    langs = cells.where("not own").groupBy(F.col("cell.lang").alias("lang")).agg(F.sum("n").alias("pool"))
    cells = cells.join(stored(langs), F.col("cell.lang") == F.col("lang"), "left")
    place = F.when(F.col("own"), F.to_json("cell")).when(F.col("pool") >= min_rows, F.to_json(F.struct("cell.lang"))).otherwise("{}")
    cells = stored(cells.select("cell", "n", place.alias("place")))
    sizes = stored(cells.groupBy("place").agg(F.sum("n").alias("size")).where(F.col("size") >= min_rows).select("place", F.monotonically_increasing_id().alias("g")))
    return stored(cells.join(sizes, "place", "left").select("cell", "g"))


def distance(v: Column, centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; inverse is the flattened matrix."""
    d = [F.get(v, i) - F.get(centre, i) for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        row = F.lit(0.0)
        for j in range(P):
            row = row + F.get(inverse, i * P + j) * d[j]
        total = total + row * d[i]
    return total


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MODEL = "g long, start int, centre array<double>, inverse array<double>, logdet double, noise array<double>, cut double, inside long, settled boolean"


def chi4(x: float) -> float:
    """Distribution function of chi-square with 4 degrees of freedom."""
    return 1 - np.exp(-x / 2) * (1 + x / 2)


def consistency(share: float) -> float:
    """What the scatter of the `share` innermost of normal rows is to be multiplied by."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi4(mid) < share else (lo, mid)
    return share / (1 - np.exp(-lo / 2) * (1 + lo / 2 + lo * lo / 8))  # chi-square with 6 degrees below


def symmetric(sums: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sums[0, 0]), P, P))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = sums[i, j]
    return out


def model_rows(g, start, centre, scatter, noise, cut=None, inside=None, settled=None) -> pa.RecordBatch:
    n = len(centre)
    whole = scatter + noise[:, None, :] * np.eye(P)
    lists = lambda x: tb.list_array(np.arange(n + 1) * (x.size // max(n, 1)), x.ravel(), pa.float64())
    cols = [pa.array(g, pa.int64()), pa.array(start, pa.int32()), lists(centre), lists(np.linalg.inv(whole)), pa.array(np.linalg.slogdet(whole)[1]), lists(noise)]
    cols += [pa.array(np.full(n, np.inf) if cut is None else cut), pa.array(np.zeros(n, np.int64) if inside is None else inside), pa.array(np.zeros(n, bool) if settled is None else settled)]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in MODEL.split(", ")])


def starts(rows: DataFrame) -> DataFrame:
    """Three first estimates of each group; rows: g, v."""
    v = [F.get("v", i) for i in range(P)]
    first = stored(rows.groupBy("g").agg(*(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, c in enumerate(v)), *(F.avg(F.get("v", P + i)).alias(f"e{i}") for i in range(P))))
    spread = [F.greatest((F.get(f"q{i}", 2) - F.get(f"q{i}", 0)) / 1.349, F.sqrt(f"e{i}")) for i in range(P)]
    first = stored(first.select("g", F.array(*(F.get(f"q{i}", 1) for i in range(P))).alias("middle"), F.array(*spread).alias("spread"), F.array(*(F.col(f"e{i}") for i in range(P))).alias("noise")))
    z = [(v[i] - F.get("middle", i)) / F.get("spread", i) for i in range(P)]
    scored = rows.join(small(first, first.count(), MODEL_ROWS), "g").select("g", *(c.alias(f"z{i}") for i, c in enumerate(z)))
    norm = F.greatest(sum((F.pow(f"z{i}", F.lit(2.0)) for i in range(P)), F.lit(0.0)), F.lit(1e-300))
    sums = [F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in PAIRS] + [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / norm).alias(f"u{i}_{j}") for i, j in PAIRS]
    both = scored.groupBy("g").agg(*sums).join(first, "g")

    def run(batches):
        for f in batches:
            n = len(f)
            middle, spread, noise = (np.array(f.column(c).to_pylist(), float).reshape(n, P) for c in ("middle", "spread", "noise"))
            scale = spread[:, :, None] * spread[:, None, :]
            for k, name in enumerate(("", "t", "u")):
                shape = symmetric({(i, j): f.column(f"{name}{i}_{j}").to_numpy() for i, j in PAIRS}) * (P if name == "u" else 1) if name else np.broadcast_to(np.eye(P), (n, P, P))
                yield model_rows(f.column("g").to_numpy(), np.full(n, k), middle, shape * scale, noise)

    return stored(both.mapInArrow(run, MODEL))


def concentrate(bins: pa.Table) -> pa.Table:
    """The next estimate of one group and start, from the moments of its rows by bin of distance."""
    bins = bins.sort_by("bin")
    n = bins.column("n").to_numpy()
    total = np.cumsum(n)
    at = [int(np.searchsorted(total, total[-1] * q)) for q in (0.25, 0.5)]
    inside = slice(0, at[1] + 1)
    h = int(total[at[1]])
    mean = np.array([bins.column(f"s{i}").to_numpy()[inside].sum() for i in range(P)]) / h
    old = {c: bins.column(c)[0].as_py() for c in ("g", "start", "centre", "logdet", "noise", "inside")}
    # moments are about the former centre
    cov = symmetric({(i, j): np.array([bins.column(f"s{i}_{j}").to_numpy()[inside].sum() / h - mean[i] * mean[j]]) for i, j in PAIRS}) * consistency(h / total[-1])
    edge = bins.column("bin").to_numpy()
    low, middle = (edge[at[0]] + 0.5) / BINS, (edge[at[1]] + 0.5) / BINS
    cut = max(LEAST_CUT, 2.0 ** (middle + FENCE * (middle - low)))
    centre = np.array(old["centre"])[None] + mean[None]
    noise = np.array(old["noise"])[None]
    now = np.linalg.slogdet(cov[0] + np.diag(noise[0]))[1]
    # concentration lowers the determinant; bins hold more or less than half, so it may also turn in a circle
    settled = old["inside"] > 0 and now > old["logdet"] - 1e-6
    return pa.Table.from_batches([model_rows([old["g"]], [old["start"]], centre, cov, noise, np.array([cut]), np.array([h]), np.array([settled]))])


def fit(rows: DataFrame, max_steps: int = 40) -> DataFrame:
    """(g, centre, inverse, cut) of each group; rows: g, v.

    A start whose steps have not settled after `max_steps` (in which determinants fall) counts as it is then.
    """
    rows = rows.where("g is not null")
    model = starts(rows)
    done = None
    for _ in range(max_steps):
        n = model.count()
        if not n:
            break
        d = rows.join(small(model.select("g", "start", "centre", "inverse"), n, MODEL_ROWS), "g")
        d = d.withColumn("bin", F.floor(F.log2(distance(F.col("v"), F.col("centre"), F.col("inverse")) + 1e-12) * BINS).cast("int"))
        x = [F.get("v", i) - F.get("centre", i) for i in range(P)]
        moments = d.groupBy("g", "start", "bin").agg(F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(P)), *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in PAIRS))
        step = stored(moments.join(small(model.select("g", "start", "centre", "logdet", "noise", "inside"), n, MODEL_ROWS), ["g", "start"]).groupBy("g", "start").applyInArrow(concentrate, MODEL))
        over = step.where("settled")
        done = over if done is None else done.unionByName(over)
        model = step.where("not settled")
    done = model if done is None else done.unionByName(model)
    best = done.groupBy("g").agg(F.min(F.struct("logdet", "start", "centre", "inverse", "cut")).alias("m"))
    return stored(best.select("g", "m.centre", "m.inverse", "m.cut"))


def modelled(stats: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """(cell, g) of each language and source, and the estimates; stats: x (s and v), cell."""
    good = stats.where(~failed("x"))
    cells = grouped(stored(good.groupBy("cell").agg(F.count("*").alias("n"))), min_rows)
    rows = stored(good.join(small(cells, cells.count()), "cell").select("g", F.col("x")["v"].alias("v")))
    return cells, fit(rows)


def judged(stats: DataFrame, x: str, at: str, cells: DataFrame, model: DataFrame, name: str) -> DataFrame:
    """stats with a struct of d2, the squared distance, and kept; x and at name the columns of measures and cell."""
    pick = small(cells, cells.count()).join(small(model, model.count(), MODEL_ROWS), "g").select(F.col("cell").alias(f"{name}_cell"), F.struct("centre", "inverse", "cut").alias(f"{name}_model"))
    pick = stored(pick)
    out = stats.join(small(pick, pick.count(), MODEL_ROWS), F.col(at) == F.col(f"{name}_cell"), "left")
    d2 = distance(F.col(x)["v"], F.col(f"{name}_model")["centre"], F.col(f"{name}_model")["inverse"])
    kept = ~failed(x) & F.coalesce(d2 <= F.col(f"{name}_model")["cut"], F.lit(True))
    return out.withColumn(name, F.struct(d2.alias("d2"), kept.alias("kept"))).drop(f"{name}_cell", f"{name}_model")


def assess(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance for each row."""
    stats = stored(measured(docs.select("doc_id", "text", "lang", "source"), ["doc_id", "lang", "source"], "x").select("doc_id", "x", cell().alias("cell")))
    cells, model = modelled(stats, min_rows)
    out = judged(stats, "x", "cell", cells, model, "verdict")
    return out.select("doc_id", *(F.col("x")["s"][i].alias(c) for i, c in enumerate(BASE)), failed("x").alias("base_failed"), F.col("verdict")["kept"].alias("kept"), F.round(F.col("verdict")["d2"], 6).alias("distance"))


def clean(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The documents that are kept, with their own columns."""
    stats = stored(measured(docs.select("text", "lang", "source"), ["lang", "source"], "x").select("x", cell().alias("cell")))
    cells, model = modelled(stats, min_rows)
    x, at, verdict = free(docs, "quality_x"), free(docs, "quality_at"), free(docs, "quality_verdict")
    out = judged(measured(docs, docs.columns, x).withColumn(at, cell()), x, at, cells, model, verdict)
    return out.where(F.col(verdict)["kept"]).select(*(F.col(f"`{c}`") for c in docs.columns))
