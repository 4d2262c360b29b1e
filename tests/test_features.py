from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakelink.functions import html, spans
from lakelink.operators import ontology as onto
from lakelink.sources import tables


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_span_and_tags(spark):
    text, s, e = F.lit("α the t1/2 was"), F.lit(6), F.lit(10)
    row = one(spark, m=spans.mention(text, s, e), t=spans.tagged(text, s, e), u=spans.untagged(spans.tagged(text, s, e)))
    assert (row.m, row.t, row.u) == ("t1/2", "α the [MENTION]t1/2[/MENTION] was", "α the t1/2 was")


def test_window(spark):
    text = F.lit("a b\nc the-t1/2, d e f")
    w = lambda s, e, n, tag=True: one(spark, x=spans.mention_window(text, F.lit(s), F.lit(e), n, tag)).x
    assert w(10, 14, 2) == "\n c [MENTION] the-t1/2, [/MENTION] d e"
    assert w(10, 14, 0) == "[MENTION] t1/2 [/MENTION]"
    assert w(10, 14, 50, False) == "a b \n c the-t1/2, d e f"
    with pytest.raises(PySparkException):
        w(1, 2, 2)


PAGE = "<p>x</p><table><tr><th></th><th>0</th><th>1</th></tr><tr><td>0</td><td>a<br>b</td><td> c </td></tr><tr><td>1</td><td>d &amp; e</td></tr></table><table><tr><td>no</td></tr></table>"


def test_table(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "no table"), (3, None)], "i int, table_html string")
    rows = {r.i: r for r in html.parse_table(df).collect()}
    assert rows[1].table_data == [["ab", "c"], ["d & e"]]
    assert rows[1].markdown == "| ab | c |\n| d & e |"
    assert rows[2].table_data == [] and rows[2].markdown == "" and rows[3].table_data == []


def test_index_detection(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    row = one(spark, a=html.is_index(arr("0", "1", "2")), b=html.is_index(arr("", "00", "1"), blank=True), c=html.is_index(arr("1", "2")), d=html.is_index(F.array().cast("array<string>")), e=html.is_index(arr("", "0")))
    assert tuple(row) == (True, True, False, False, False)


def test_cell_contexts(spark):
    rows = F.lit(None).cast("array<array<string>>")
    rows = F.from_json(F.lit(json.dumps([["h0", "h1", "h2"], ["r1", "x", "y"], ["r2", "z"]])), "array<array<string>>")
    cell = F.lit("<X>")
    row = one(
        spark, r=html.row_context(rows, F.lit(1), F.lit(1), cell, 1), c=html.col_context(rows, F.lit(1), F.lit(2), cell, 1), none=html.row_context(rows, F.lit(-1), F.lit(-1), cell),
        h=html.headers_feature(rows, F.lit(1), F.lit(1), cell), h0=html.headers_feature(rows, F.lit(0), F.lit(0), cell), rc=html.row_col_feature(rows, F.lit(2), F.lit(1), cell),
        f=html.footer_caption_feature(cell, F.lit(None).cast("string"), F.lit(" foot ")),
    )
    assert row.r == "| r1 | <X> | y |" and row.c == "| h2 | <X> |" and row.none is None
    assert row.h == "[TABLE CELL] <X> [ROW-HEADER] r1 [COL-HEADER] h1" and row.h0 == "[TABLE CELL] <X>"
    assert row.rc == "[CELL] <X> [ROW] r2 | z [COL] h1 | x | z" and row.f == "[CELL] <X> [FOOTER] foot"


def test_prep_table(spark):
    df = spark.createDataFrame([("c", [(0, 1)], "Q1", PAGE, 0, 1, None, "ft")], "text string, spans array<struct<start:int,end:int>>, label string, table_html string, row_idx int, col_idx int, caption string, footer string")
    row = html.prep_table(df).first()
    assert row.row_context == "| ab | [MENTION]c[/MENTION] |" and row.col_context == "| [MENTION]c[/MENTION] |"
    assert row.table_context_llm.endswith("[FOOTER] ft")


ONTOLOGY = '''category_id,parameter_category,parameter_id,parameter_name,parameter_synonyms,parameter_description,units
G1,Exposure,Q88,AUC ,"[""area under the curve"", ""exposure"",]","Two
lines",mass
G5,Half-life,Q57,t1/2z,"[""t1/2"", ""terminal t1/2""]",,h
G5,Half-life,Q60,t1/2 beta,t1/2 , ,
G9,Metabolism,Q1,Km,,x,y
G100,NIL,Q100,NIL,,,
'''


@pytest.fixture()
def ontology(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.write_text(ONTOLOGY.replace("t1/2 , ,", '"t1/2, half life",,'))
    return tables.load_ontology(spark, str(path))


def test_ontology(spark, ontology):
    rows = {r.parameter_id: r for r in ontology.collect()}
    assert set(rows) == {"Q88", "Q57", "Q60", "Q1"}
    assert rows["Q88"].parameter_synonyms == ["area under the curve", "exposure"] and rows["Q88"].parameter_name == "AUC"
    assert rows["Q60"].parameter_synonyms == ["t1/2", "half life"] and rows["Q1"].parameter_synonyms == []
    index = {tuple(r.tokens): r.param_ids for r in onto.token_index(ontology, __import__("lakelink.functions.text", fromlist=["x"]).pk_tokens).collect()}
    assert index[("t1/2",)] == ["Q57", "Q60"] and index[("auc",)] == ["Q88"]
    text = onto.llm_block(ontology.where("parameter_id = 'Q60'")).first().ontology_subset
    assert text == "[PARAM_NAME] t1/2 beta\n        [DESC] N/A\n        [SYN] t1/2 | half life\n        [UNIT] N/A\n        [CATEGORY] Half-life"
    features = {r.parameter_id: r.text_feature for r in onto.for_embedding(ontology, include_units=False).collect()}
    assert features["Q60"] == "[PARAM] t1/2 beta [SYN] t1/2 | half life" and features["Q1"] == "[PARAM] km [DESC] x"


def test_jsonl(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"text": "a/b", "spans": [{"start": 0, "end": 1}], "label": "Q1"}\nnot json\n\n{"text": "c"}\n')
    df = tables.read_jsonl(spark, str(path))
    assert [(r.text, r.label) for r in df.orderBy("text").collect()] == [("a/b", "Q1"), ("c", None)]
    tables.write_jsonl(df, str(tmp_path / "out"))
    tables.append_jsonl(df, str(tmp_path / "out"))
    assert tables.read_jsonl(spark, str(tmp_path / "out")).count() == 4


def test_no_fixed_length_cuts_long_tables(spark):
    assert "1000000" not in str(html.without_index(F.col("t")))
