"""Tokens of parameter mentions, family by family; our own cases, with the outputs that linking relies on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakelink.functions import text

CASES = {
    "Area under the curve": "auc", "AUC0-24h": "auc t", "AUC(0-inf)": "auc inf", "AUC to infinity": "auc inf", "AUC last": "auc last", "AUC/dose": "auc dosenorm", "AUC ratios": "auc ratio", "steady-state AUC": "auc ss", "AUMC": "aumc",
    "oral bioavailability": "f", "relative bioavailability": "frel", "hepatic bioavailability": "fh",
    "total clearance": "cl", "CL/F": "bionorm cl", "apparent oral clearance": "bionorm cl", "renal clearance": "clr", "hepatic clearance": "clh", "intrinsic clearance": "clint", "θCL": "cl",
    "intercompartmental clearance": "q", "Q2": "q2",
    "peak concentration": "cmax", "Cmax": "cmax", "trough concentration": "ctrough", "Cmin": "cmin", "peak concentration ratio": "cmax ratio",
    "half-life": "t1/2", "half lives": "t1/2", "t½": "t1/2", "terminal half-life": "t1/2", "distribution half-life": "alpha t1/2",
    "absorption half life": "kabs t1/2",
    "absorption rate constant": "kabs", "elimination rate constant": "kel", "λz": "kel", "λ1": "1 lambda", "kout": "kout", "k12": "kcomp",
    "time to maximum concentration": "tmax", "mean residence time": "mrt", "mean transit time": "mtt", "mrtinf": "inf mrt",
    "volume of distribution": "v", "Vss": "ss v", "central volume": "v1", "Vd/F": "bionorm v", "peripheral volume of distribution": "v2",
    "Michaelis-Menten constant": "km", "protein binding": "fu", "extraction ratio": "e", "blood flow": "blood flow",
    "": "", "plasma": "", "glucose": "", "12-24": "",
}


@pytest.fixture(scope="module")
def tokens(spark):
    rows = spark.createDataFrame([(k,) for k in CASES], "t string")
    return {r.t: r for r in rows.select("t", text.pk_tokens(F.col("t")).alias("once"), text.pk_tokens(text.preprocess(F.col("t"))).alias("twice")).collect()}


@pytest.mark.parametrize("mention", CASES)
def test_tokens(tokens, mention):
    assert tokens[mention].once == sorted(CASES[mention].split())


def test_preprocessing_twice_changes_nothing_here(tokens):
    assert all(r.once == r.twice for r in tokens.values())


def test_preprocess_order(spark):
    said = "The Half-lives of <b>Drugs</b> and ½ ﬁelds"
    assert spark.range(1).select(text.preprocess(F.lit(said)).alias("x")).first().x == " half life  drug  1/2 field"


def test_plural_exceptions(spark):
    row = spark.range(1).select(text.preprocess(F.lit("mass meas michaelis volumes")).alias("x")).first()
    assert row.x == "mass meas michaelis volume"


def test_removals(spark):
    row = spark.range(1).select(text.remove_words(F.lit(" a  Drug b "), ("drug",)).alias("w"), text.remove_chemicals(F.lit("Glucose  clearance of total protein")).alias("c")).first()
    assert (row.w, row.c) == ("a b", "clearance of")


def test_registry():
    assert text.tokenizer("PK") is text.pk_tokens
    with pytest.raises(NameError):
        text.tokenizer("none")


def test_distinct_first_keeps_nulls_and_repeats(spark):
    df = spark.createDataFrame([("CL/F",), ("CL/F",), (None,)], "m string")
    rows = text.tokenised(df, "m", text.pk_tokens).collect()
    assert sorted((r.m or "", tuple(r.tokens or ())) for r in rows) == [("", ()), ("CL/F", ("bionorm", "cl")), ("CL/F", ("bionorm", "cl"))]
