"""Nearest vectors of a block: which rows of one block have the best cosine with each row of another."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores held at a time, and pairs whose vectors are gathered at a time.
SCORES, PAIRS = 1 << 21, 1 << 14


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up in the order of the elements, as similarity.cosine does."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounded like Spark's round: halves of the decimal form go away from zero."""
    unit = 10.0**digits
    scaled = np.abs(x) * unit
    out = np.copysign(np.floor(scaled + 0.5) / unit, x)
    close = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6 if digits < 9 else np.isfinite(x)
    for i in np.flatnonzero(close):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors by their length; without vectors that are null, empty or hold a null."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    gaps = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))]) if values.null_count else None
    numbers = pc.fill_null(values.cast(pa.float64(), safe=False), 0.0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out = {}
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        at = at if gaps is None else at[gaps[ends[at]] == gaps[ends[at] - n]]
        rows = numbers if len(at) * n == len(numbers) else numbers[((ends[at] - n)[:, None] + np.arange(n)).ravel()]
        out[int(n)] = at, rows.reshape(-1, n)
    return out


def kinds(rows: np.ndarray) -> np.ndarray:
    """0 for vectors without a direction, 1 for usual ones, 2 for those whose cosine with any other is NaN or 0."""
    squares = dots(rows, rows)
    return np.where(squares == 0, 0, np.where(np.isfinite(squares), 1, 2))


def units(rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of length 1; NaN where the length is beyond what can be divided by, so that the pair is looked at."""
    fit = np.where((norms > 1e-150) & (norms < 1e150), norms, np.nan)
    return rows / fit[:, None]


def distinct(rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` of each group of equal rows: more of them cannot be among so many best."""
    _, group = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.sort(order[nth < most])


def best(q: np.ndarray, c: np.ndarray, own: dict[int, list[int]], k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, cosine) of the k best of each row of q, equal ones by row of c; own: pairs left out.

    Products of matrices find which pairs can be among the best; their cosines are then added up in order.
    """
    slack = 1e-9 + (0.0 if digits is None else 10.0**-digits)
    nq, nc = np.sqrt(dots(q, q)), np.sqrt(dots(c, c))
    uq, uc = units(q, nq), units(c, nc).T
    found = []
    step = max(1, SCORES // len(c))
    for start in range(0, len(q), step):
        near = uq[start : start + step] @ uc
        odd = np.isnan(near)
        near[odd] = -np.inf
        for row in range(start, min(start + step, len(q))):
            if row in own:
                near[row - start, own[row]], odd[row - start, own[row]] = -np.inf, False
        least = np.partition(near, len(c) - k, axis=1)[:, len(c) - k] - slack if len(c) > k else np.full(len(near), -np.inf)
        rows, cols = np.nonzero((near >= np.maximum(least, -1e300)[:, None]) | odd)
        rows += start
        score = np.empty(len(rows))
        for i in range(0, len(rows), PAIRS):
            r, j = rows[i : i + PAIRS], cols[i : i + PAIRS]
            score[i : i + PAIRS] = dots(q[r], c[j]) / (nq[r] * nc[j])
        shown = score if digits is None else half_up(score, digits)
        order = np.lexsort((cols, -np.where(np.isnan(shown), np.inf, shown), rows))  # NaN is above all, as in Spark
        rows, cols, score = rows[order], cols[order], score[order]
        counts = np.bincount(rows - start, minlength=len(near))
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        found.append((rows[nth < k], cols[nth < k], score[nth < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cell(k: int, digits: int | None, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of queries (query_id, q_vec, own_id) and corpus rows (parameter_id, c_vec) that gives the k best of each query.

    Order is by cosine, then id. Pairs without a cosine come last, by id, with a null score.
    """

    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):
            corpus = corpus.take(pc.array_sort_indices(corpus["parameter_id"], null_placement="at_start"))  # from here places are the order of ids
            ids = corpus["parameter_id"].to_pylist()
            mine = {x: i for i, x in enumerate(queries["own_id"].to_pylist()) if x is not None}
            owned: dict = {}  # places of the rows that a query leaves out, by their id
            for i, x in enumerate(ids):
                if x in mine:
                    owned.setdefault(x, []).append(i)
            out = [owned.get(x, []) for x in queries["own_id"].to_pylist()]
            spare = max(map(len, out), default=0)
            vectors = by_length(corpus["c_vec"])
            rows, cols, score = [], [], []
            open_, groups = np.full(len(out), k), []
            for n, (at, q) in by_length(queries["q_vec"]).items():
                places, c = vectors.get(n, (np.array([], int), np.zeros((0, n))))
                asked, there = kinds(q), kinds(c)
                for kind in np.unique(asked):
                    of, to = asked == kind, (there > 0, there > 1)[int(kind == 0)] if kind < 2 else there >= 0  # pairs that have a cosine
                    groups.append((at[of], places[to]))
                    if to.any():
                        some, vs, ps = at[of], c[to], places[to]
                        kept = distinct(vs, k + spare)
                        where = {p: i for i, p in enumerate(ps[kept])}
                        own = {i: [where[p] for p in out[a] if p in where] for i, a in enumerate(some) if out[a]}
                        r, j, s = best(q[of], vs[kept], own, k, digits)
                        rows.append(some[r])
                        cols.append(ps[kept[j]])
                        score.append(s)
                        open_[some] -= np.bincount(r, minlength=len(some))
            groups.append((np.setdiff1d(np.arange(len(out)), np.concatenate([np.array([], int), *(a for a, _ in groups)])), np.array([], int)))
            for at, places in groups:  # pairs without a cosine fill up what is left
                rest = np.setdiff1d(np.arange(len(ids)), places)[: k + spare] if (open_[at] > 0).any() else ()
                for a in at[open_[at] > 0] if len(rest) else ():
                    more = [p for p in rest if p not in out[a]][: open_[a]]
                    rows.append(np.full(len(more), a))
                    cols.append(np.array(more, int))
                    score.append(np.full(len(more), -np.inf))
        r, j, s = (np.concatenate([np.array([], t), *x]) for x, t in ((rows, int), (cols, int), (score, float)))
        table = [queries["query_id"].take(pa.array(r.astype(int))), corpus["parameter_id"].take(pa.array(j.astype(int))), pa.array(s, mask=s == -np.inf)]
        return pa.table(table, names=schema.names).cast(schema)

    return run
