"""Nearest vectors by blocks against scores of all pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lakelink.functions import nearest
from lakelink.operators import retrieval


def frames(spark):
    rng = random.Random(11)
    one = lambda: [rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(3)]
    vectors = [one() for _ in range(150)] + [[1.0, 0.5, 0.5]] * 40 + [[1e-170, 0.0, 1e-170], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], [1.0, None, 0.0], [], None, [0.0] * 3]
    rng.shuffle(vectors)
    corpus = spark.createDataFrame([(f"{i:04d}" if i else None, v) for i, v in enumerate(vectors)], "parameter_id string, c_vec array<double>")
    asked = [(i, vectors[i], f"{i:04d}") for i in range(1, len(vectors), 3)] + [(1000 + i, v, None) for i, v in enumerate((None, [0.0] * 3, [2.0, 1.0], [float("nan")] * 3, [1.0, 1.0, 1.0], [3.0, None, 1.0]))]
    return spark.createDataFrame(asked, "query_id int, q_vec array<double>, own_id string"), corpus


def test_blocks_give_what_all_pairs_give(spark):
    queries, corpus = frames(spark)
    own = ~F.coalesce(F.col("own_id") == F.col("parameter_id"), F.lit(False))
    pairs = retrieval.dense_scores(queries, corpus).join(queries.select("query_id", "own_id"), "query_id").where(own).drop("own_id")
    shown = lambda df: sorted(((r.query_id, r["rank"], r.parameter_id, str(r.score)) for r in df.collect()), key=str)
    for k, digits, block in ((5, 6, 16), (3, None, 1000), (300, 2, 50)):
        assert shown(retrieval.dense_nearest(queries, corpus, k, digits, block=block)) == shown(retrieval.dense_top_k(pairs, k, digits))


def test_no_row_for_a_pair(spark):
    """Rows that are handed on grow with the queries, not with the pairs."""
    queries, corpus = frames(spark)
    assert retrieval.dense_nearest(queries.limit(0), corpus, 5).count() == 0 and retrieval.dense_nearest(queries, corpus.limit(0), 5).count() == 0
    plan = retrieval.dense_nearest(queries, corpus, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    rows = np.random.default_rng(1).normal(size=(500, 8))
    r, _, _ = nearest.best(rows[:20], rows, {}, 5, 6)
    assert len(r) == 100


def test_half_up(spark):
    x = [0.1234565, -0.1234565, 0.1234564999, 1.0, -1.0, 0.0, 0.9999995, 2.5e-7, 5e-7]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert nearest.half_up(np.array(x), 6).tolist() == want
