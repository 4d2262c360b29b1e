"""Every query with a SQL equivalent gives the same rows, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from lakelink import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 6) if v.__class__.__name__ in ("float", "Decimal") else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


def test_every_query_has_an_equivalent():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_streaming_link(spark, tmp_path):
    from lakelink.streaming.linking import link_stream

    mentions = spark.createDataFrame([("the CL was", [(4, 6)])], "text string, spans array<struct<start:int,end:int>>")
    mentions.write.parquet(str(tmp_path / "in"))
    index = spark.createDataFrame([("cl", ["cl"], ["Q2"])], "token_key string, tokens array<string>, param_ids array<string>")
    stream = link_stream(spark.readStream.schema(mentions.schema).parquet(str(tmp_path / "in")), index)
    q = stream.select("status", "y_pred").writeStream.format("memory").queryName("linked").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM linked").collect()] == [("linked", "Q2")]


@pytest.mark.parametrize("name", ["dense_threshold", "dense_retrieve", "pk_rules", "category_rules", "exact_ambiguous", "fuzzy_index_order", "jsonl_files", "ontology_csv"])
def test_rows_that_can_fail(spark, name):
    """Queries whose rows would compare nothing if they were empty."""
    assert catalog.QUERIES[name](spark, SF.replace("0.001", "0.01")).count() > 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from lakelink.session import scratch

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError):
        scratch(Session())
