"""Queries give the rows of their SQL where an entry of the ontology has the id that else stands for no entry."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lakelink import catalog
from test_queries import SF, TABLES, rows


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """The smallest tables with part keys from 100, so that the first entry is Q100."""
    folder = tmp_path_factory.mktemp("shifted")
    for t in TABLES:
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(t)
        if key:
            spark.read.parquet(f"{SF}/{t}.parquet").withColumn(key, F.col(key) + 100).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        else:
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if (folder / f'{t}.parquet').is_dir() else ''}'")
    return str(folder), con


@pytest.mark.parametrize("name", [
    "evaluation_inputs",
    "hard_negatives",
    "random_negatives",
    "training_pairs",
    "label_distribution",
    "mrr_recall",
    "dense_retrieve",
    "ontology_embed_feature",
    "runs_by_source",
])
def test_same_rows_with_an_entry_q100(spark, shifted, name):
    folder, con = shifted
    df = catalog.QUERIES[name](spark, folder)
    got = con.execute(catalog.ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in got.description], got.fetchall())
