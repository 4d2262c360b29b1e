"""Rules and patterns are tried once for a row, whatever is asked of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakelink.functions import text
from lakelink.operators import exact, metrics, subset


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ontology_text_reads_rows_once(spark):
    rows = spark.createDataFrame([(1, "auc t"), (2, "zz ratio"), (3, "zz"), (4, None), (5, "v k")], "i int, t string")
    entries = spark.createDataFrame([(2, "G1", "Q88", "B"), (1, "G1", "Q87", "A"), (3, "G8", "Q9", "C"), (4, "G2", "Q21", "D"), (5, None, "Q31", "E"), (6, "G6", "Q9", "F")], "ord long, category_id string, parameter_id string, parameter_name string")
    entries = entries.withColumns({"parameter_description": F.lit(""), "units": F.lit(""), "parameter_synonyms": F.array().cast("array<string>"), "parameter_category": F.lit("c")})
    out = subset.with_ontology_text(subset.with_subset(rows, entries, "t", "t"), entries)
    names = {r.i: [x.split("\n")[0][-1] for x in r.ontology_subset.split("\n\n")] for r in out.collect()}
    assert names == {1: ["A", "B"], 2: ["D", "E"], 3: list("ABCDEF"), 4: list("ABCDEF"), 5: ["C", "F"]}
    assert out.columns == ["i", "t", "categories", "subsetted_concepts", "subset_matched", "ontology_subset"]
    marked = subset.with_ontology_text(subset.with_subset(rows, entries, "t", "t", (("G1", "MARK"),)), entries)
    assert plan(marked).count("MARK") == 1  # before, also below each filter on the sets


def test_filter_on_status_leaves_the_rules_once(spark):
    rows = spark.createDataFrame([("the CL was", [(4, 6)], "CL", ["cl"]), ("AUC/MIC", [(0, 3)], "AUC", ["auc"]), ("zz", [(0, 2)], "zz", ["zz"])], "text string, spans array<struct<start:int,end:int>>, mention string, tokens array<string>")
    index = spark.createDataFrame([("cl", ["cl"], ["Q2"])], "token_key string, tokens array<string>, param_ids array<string>")
    out = exact.link_exact(rows, index)
    assert {r.text: r.status for r in exact.linked(out).collect()} == {"the CL was": "linked", "AUC/MIC": "excluded"}
    assert [r.text for r in exact.unlinked(out).collect()] == ["zz"]
    for kept in (exact.linked(out), exact.unlinked(out)):
        assert plan(kept).count("pharmacodynamic") == plan(out).count("pharmacodynamic") and plan(kept).count("nfkc(") == plan(out).count("nfkc(")


def test_matched_metrics_reads_rows_once(spark):
    rows = spark.range(9).select((F.col("id") % 2 == 0).alias("m"), F.lit("a").alias("label"), F.lit("a").alias("top_pred"))
    assert plan(metrics.matched_metrics(rows, F.col("m"))).count("Range (0, 9") == 1


def test_tokens_are_made_of_distinct_texts(spark):
    """What a join or an explode asks of tokens does not go below the distinct texts."""
    from lakelink.plans import linking

    df = linking.constrained(spark, "/root/testdata/sf0.001")
    lines = plan(df.join(df.select("tokens").distinct(), "tokens")).splitlines()
    assert not [x for x in lines if "Filter" in x and "regexp_replace" in x]


def test_normalising_holds_few_strings():
    import tracemalloc

    import pyarrow as pa

    rows = pa.array(["ﬁü" * 500] * 2000 + [None])
    tracemalloc.start()
    out = text.nfkc.func(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == ["fiü" * 500] * 2000 + [None] and len(text.nfkc.func(rows.slice(0, 0))) == 0
    assert peak < 1_000_000  # before, every string of a batch and its new form
