from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakelink.functions.embedding import embedded
from lakelink.functions.similarity import cosine, indel, indel_ratio, token_set_score
from lakelink.operators import exact, metrics, ontology, prompt, retrieval, subset, training

MENTION = "text string, spans array<struct<start:int,end:int>>, mention string, tokens array<string>, label string"
INDEX = "token_key string, tokens array<string>, param_ids array<string>"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcdé", max_size=20), st.text("abcdé", max_size=20))
def test_indel_properties(a, b):
    r = indel(a, b)
    assert r == indel(b, a) and 0 <= r <= 100 and (r == 100) == (a == b)
    if a or b:
        assert r == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))


def test_similarity_columns(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    row = spark.range(1).select(
        indel_ratio(F.lit("kitten"), F.lit("sitting")).alias("r"), indel_ratio(F.lit(None).cast("string"), F.lit("a")).alias("n"), token_set_score(arr("auc", "ratio"), arr("auc"), 80).alias("t"),
        token_set_score(F.array().cast("array<string>"), F.array().cast("array<string>"), 80).alias("e"), cosine(arr(3.0, 4.0), arr(4.0, 3.0)).alias("c"), cosine(arr(0.0), arr(1.0)).alias("z"),
    ).first()
    assert row.r == pytest.approx(800 / 13) and row.n is None and row.t == 50 and row.e is None and row.c == pytest.approx(0.96) and row.z is None


def mention(spark, *rows):
    """(sentence, mention, tokens)."""
    return spark.createDataFrame([(t, [(t.index(m), t.index(m) + len(m))], m, k, "Q57") for t, m, k in rows], MENTION)


def test_exact_cascade(spark):
    key = lambda *t: "\u0001".join(sorted(t))
    index = spark.createDataFrame([(key("cl"), ["cl"], ["Q2"]), (key("t1/2"), ["t1/2"], ["Q57", "Q60", "Q89"]), (key("km"), ["km"], ["Q1", "Q51"]), (key("x"), ["x"], ["Q7", "Q8"])], INDEX)
    rows = mention(
        spark, ("the CL was", "CL", ["cl"]), ("AUC/MIC here", "AUC", ["auc"]), ("effective half-life", "effective half-life", ["t1/2"]), ("t1/2 in a two-compartment model", "t1/2", ["t1/2"]),
        ("t1/2 here", "t1/2", ["t1/2"]), ("t1/2 of a biphasic and triphasic", "t1/2", ["t1/2"]), ("Km alone", "Km", ["km"]), ("Km of the enzyme", "Km", ["km"]), ("x here", "x", ["x"]), ("M + CL", "CL", ["cl"]), ("zz", "zz", ["zz"]), ("a\\Eb/MIC", "a\\Eb", ["cl"]),
    )
    got = {r.text: (r.status, r.y_pred, r.potential_candidates) for r in exact.link_exact(rows, index).collect()}
    assert got["the CL was"] == ("linked", "Q2", None)
    assert got["AUC/MIC here"][:2] == ("excluded", "Q100") and got["effective half-life"][0] == "excluded" and got["M + CL"][0] == "excluded" and got["a\\Eb/MIC"][0] == "excluded"
    assert got["t1/2 in a two-compartment model"][:2] == ("disambiguated", "Q60") and got["t1/2 here"][:2] == ("disambiguated", "Q57")
    assert got["t1/2 of a biphasic and triphasic"] == ("multi", "Q100", ["Q60", "Q89"])
    assert got["Km alone"] == ("multi", "Q100", ["Q1"]) and got["Km of the enzyme"][:2] == ("disambiguated", "Q1")
    assert got["x here"] == ("unlinked", "Q100", ["Q7", "Q8"]) and got["zz"] == ("unlinked", "Q100", None)
    other = {r.text: (r.status, r.y_pred) for r in exact.link_exact(rows, index, table_mentions=True, resolve_km_default=True).collect()}
    assert other["t1/2 of a biphasic and triphasic"] == ("linked", "Q57") and other["Km alone"] == ("disambiguated", "Q1")


def test_subset(spark):
    df = spark.createDataFrame([("auc t", "auc0-t"), ("v c", "v and c"), ("km", "km"), ("zz ratio", "zz"), ("zz", "zz")], "t string, m string")
    ontology = spark.createDataFrame([("G1", "Q88"), ("G4", "Q32"), ("G6", "Q51"), ("G9", "Q1"), ("G8", "Q9")], "category_id string, parameter_id string")
    got = {r.t: (r.categories, r.subsetted_concepts, r.subset_matched) for r in subset.with_subset(df, ontology, "t", "m").collect()}
    assert got["auc t"] == (["G1"], ["Q88"], True) and got["v c"] == (["G4"], ["Q32"], True) and got["km"] == (["G9"], ["Q1"], True)
    assert got["zz ratio"] == ([], ["Q21", "Q31", "Q33", "Q35", "Q58", "Q93"], True) and got["zz"] == ([], [], False)
    labelled = subset.with_subset(df, ontology, "t", "m").withColumn("label", F.when(F.col("t") == "zz", "Q100").otherwise("Q88"))
    m = subset.evaluate_subsets(labelled, ontology).first()
    assert (m.total, m.matched, m.correct_matched, m.correct_unmatched, m.total_nil) == (5, 4, 1, 1, 1) and m.overall_accuracy == 0.4


def test_fuzzy(spark):
    index = spark.createDataFrame([("a", ["clr"], ["Q2", "Q10"]), ("b", ["cl"], ["Q3"]), ("c", ["auc", "t"], ["Q4"])], INDEX)
    rows = spark.createDataFrame([(1, ["cl"], ["Q3"]), (2, ["clr"], []), (3, ["zzz"], ["Q4"]), (4, ["t", "auc"], ["Q4"])], "i int, tokens array<string>, subsetted_concepts array<string>")
    ids = lambda df: {r.i: [x.parameter_id for x in (r.retrieved or [])] for r in df.collect()}
    assert ids(retrieval.retrieve_fuzzy(rows, index, 10, 80, "string")) == {1: ["Q3", "Q10", "Q2"], 2: ["Q10", "Q2", "Q3"], 3: [], 4: ["Q4"]}
    assert ids(retrieval.retrieve_fuzzy(rows, index, 1, 80, "string")) == {1: ["Q3"], 2: ["Q10"], 3: [], 4: ["Q4"]}
    assert ids(retrieval.retrieve_fuzzy(rows, index, 10, 80, "string", constrained=True)) == {1: ["Q3"], 2: [], 3: [], 4: ["Q4"]}
    assert ids(retrieval.retrieve_fuzzy(rows, index, 10, 80, "token"))[4] == ["Q4"]
    ordered = index.withColumn("ord", F.when(F.col("token_key") == "b", 0).otherwise(1).cast("long"))
    first = retrieval.top_k_in_order(retrieval.scored(retrieval.pairs(rows, ordered), "token", 80), ["m_key"], 2, 80)
    assert {(r["rank"], r.parameter_id) for r in first.where("m_key = 'cl'").collect()} == {(1, "Q3"), (2, "Q2")}
    with pytest.raises(ValueError):
        retrieval.retrieve_fuzzy(rows, index, mode="other")
    # by tokens "cl" and "clr" reach 80, so that all three ids score 100 and the order of ids decides
    for mode, best in (("string", "Q3"), ("token", "Q10")):
        swept = {(r.threshold, r.m_key): r.parameter_id for r in retrieval.sweep(retrieval.pairs(rows, index), [50, 80], mode).collect()}
        assert swept[(80.0, "cl")] == best and (80.0, "zzz") not in swept


def test_dense(spark):
    corpus = spark.createDataFrame([("Qa", [1.0, 0.0]), ("Qb", [0.0, 1.0]), ("Qc", [1.0, 0.0])], "parameter_id string, c_vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [-1.0, -1.0]), (3, None)], "query_id int, q_vec array<double>")
    rows = spark.createDataFrame([(1, ["Qc"]), (2, ["Qa"]), (3, ["Qa"])], "query_id int, subsetted_concepts array<string>")
    got = {r.query_id: r for r in retrieval.retrieve_dense(rows, queries, corpus, 2, 0.5).collect()}
    assert got[1].top_pred == "Qc" and got[2].top_pred == "Q100" and got[2].retrieved[0].parameter_id == "Q100" and 3 not in got


def test_metrics(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice("abcd")) for _ in range(200)]
    m = metrics.classification(spark.createDataFrame(rows, "y_true string, y_pred string")).first()
    acc = sum(t == p for t, p in rows) / len(rows)
    f1 = [2 * sum(t == p == x for t, p in rows) / (sum(t == x for t, _ in rows) + sum(p == x for _, p in rows)) for x in "abcd"]
    assert m.mic_f1 == m.accuracy == pytest.approx(acc) and m.mac_f1 == pytest.approx(sum(f1) / 4) and m.n == 200
    assert metrics.classification(spark.createDataFrame([], "y_true string, y_pred string")).count() in (0, 1)


def test_retrieval_metrics_nil(spark):
    df = spark.createDataFrame([("Q1", []), ("Q100", []), ("Q2", [(1, "Q9", 0.9), (2, "Q2", 0.8)])], "label string, retrieved array<struct<rank:int,parameter_id:string,score:double>>")
    fuzzy = metrics.retrieval(retrieval.judged(df)).first()
    dense = metrics.retrieval(retrieval.judged(df, explicit_nil=True)).first()
    assert fuzzy.mrr == pytest.approx(0.5 / 3) and dense.mrr == pytest.approx(1.5 / 3) and fuzzy.nil_prop == 66.67


def test_moving_average(spark):
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate([1, 2, 4])], "run string, step_no int, value double")
    assert [round(r.ema, 4) for r in metrics.moving_average(df, "run", "step_no", "value", 0.5).orderBy("step").collect()] == [1.0, 1.5, 2.75]


def test_sets_and_pairs(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), (None, None)], "text string, start int")
    b = spark.createDataFrame([(None, None)], "text string, start int")
    kept = training.without(a, b, ["text", "start"])
    assert sorted(map(tuple, kept.collect()), key=str) == [("x", 1), (None, 2)] or kept.count() == 2
    assert training.partition_check(a, b, kept).first().ok
    entries = spark.createDataFrame([("Q1", "G1"), ("Q2", "G1"), ("Q3", "G2")], "parameter_id string, category_id string")
    m = spark.createDataFrame([(1, "m", "Q1"), (2, "n", " q100 ")], "mention_id int, mention string, label string")
    pairs = training.training_pairs(m, entries, hard=5, rand=1).collect()
    assert sorted((r.kind, r.parameter_id) for r in pairs if r.kind != "random") == [("hard", "Q2"), ("positive", "Q1")] and all(r.parameter_id != "Q1" for r in pairs if r.label == 0)


def test_prompts(spark):
    names = spark.createDataFrame([("Q1", "Km"), ("Q2", "CL/F")], "parameter_id string, parameter_name string")
    rows = spark.createDataFrame([(i,) for i in range(4)], "i int").withColumn("prompt", F.col("i").cast("string"))
    said = ["{param: km}", "param: CL/F ", "{param: N/A}", "what"]
    out = prompt.grounded(prompt.answered(rows, lambda ps: [said[int(p)] for p in ps], "gpt-4o"), names)
    assert [(r.llm_pred, r.no_answer) for r in out.orderBy("i").collect()] == [("Q1", False), ("Q2", False), ("Q100", False), ("Q100", True)]
    for model in (None, "other"):
        with pytest.raises(ValueError):
            prompt.answered(rows, list, model)
    text = spark.range(1).select(prompt.user_prompt(F.lit("m"), F.lit("o"), None, F.lit("e")).alias("p")).first().p
    assert text == "---\nMention:\nm\n---\n\n---\nTask Examples:\ne\n---\n\n---\nOntology:\n\no\n---"
    cost = prompt.cost(rows, "gpt-4o", F.lit(1000)).first()
    assert cost.average_cost == pytest.approx(0.00257) and math.isclose(cost.total_cost, 0.01028)


def test_moving_average_of_a_long_series(spark):
    rng = random.Random(5)
    values = [rng.uniform(-5, 5) for _ in range(3000)]
    df = spark.createDataFrame([(k, i, v) for k in ("a", None) for i, v in enumerate(values)] + [("a", 4000, None)], "run string, at int, value double")
    for alpha in (0.1, 0.9, 1.0):
        want = []
        for v in values:
            want.append(v if not want else alpha * v + (1 - alpha) * want[-1])
        got = metrics.moving_average(df, "run", "at", "value", alpha).collect()
        for run in ("a", None):
            assert [r.ema for r in sorted((r for r in got if r.run == run), key=lambda r: r.step)] == pytest.approx(want, rel=1e-9, abs=1e-9)
    with pytest.raises(ValueError):
        metrics.moving_average(df, "run", "at", "value", 0.0)


def test_matched_metrics(spark):
    rows = spark.createDataFrame([("a", "a", True), ("b", "a", True), ("Q100", "Q100", False), ("a", None, None)], "label string, top_pred string, is_matched boolean")
    got = {r.part: (r.n, r.matched_pct, r.mic_f1) for r in metrics.matched_metrics(rows, F.col("is_matched")).collect()}
    assert got == {"combined": (4, 100.0, 0.5), "matched": (2, 50.0, 0.5), "unmatched": (2, 50.0, 0.5)}
    none = {r.part: (r.n, r.matched_pct, r.mic_f1) for r in metrics.matched_metrics(rows.limit(0), F.col("is_matched")).collect()}
    assert none == {p: (0, 0.0, None) for p in ("combined", "matched", "unmatched")}
    assert spark.range(1).select(metrics.percent(F.lit(0.875)).alias("p")).first().p == "87.50%"


def test_runs_by_source(spark):
    rows = [(0, "x", "a", "a", False), (0, None, "a", "b", True), (1, "x", "a", "b", False), (1, None, "a", "a", False)]
    got = {r.source: (r.mean_f1, r.std_f1, r.mean_matched, r.runs) for r in metrics.runs_by_source(spark.createDataFrame(rows, "run int, source string, label string, llm_pred string, no_answer boolean")).collect()}
    assert got == {"all": (0.5, 0.0, 1, 2), "x": (0.5, 0.5, 1, 2), "unknown": (0.5, 0.5, 0, 2)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), max_size=3), st.lists(st.text("abc", min_size=1, max_size=6), max_size=3), st.integers(1, 100))
def test_lengths_never_drop_a_match(a, b, threshold):
    """The bound on lengths is no less than the score, by characters and by tokens."""
    x, y = " ".join(a), " ".join(b)
    assert indel(x, y) <= (200.0 * min(len(x), len(y)) / (len(x) + len(y)) if x or y else 100.0)
    hits = sum(max((indel(s, t) for t in b), default=0.0) >= threshold for s in a)
    assert hits <= len(a)


def test_length_bound(spark):
    index = spark.createDataFrame([("a", ["abcd"], ["Q1"]), ("b", ["abcdefghij"], ["Q2"]), ("c", [], ["Q3"])], INDEX)
    rows = spark.createDataFrame([(["abcd"],), ([],)], "tokens array<string>")
    kept = {(r.m_key, r.parameter_id): r.score for r in retrieval.scored(retrieval.pairs(rows, index), "string", 60).collect()}
    assert kept == {("abcd", "Q1"): 100.0, ("", "Q3"): 100.0}


def test_texts_by_embedding(spark):
    entries = spark.createDataFrame([(0, "Q1", "abc"), (1, "Q2", "abc"), (2, "Q3", "zzz")], "ord int, parameter_id string, text_feature string")
    rows = spark.createDataFrame([(1, "cab", "Q2", ["Q2"]), (2, "zz", "Q2", ["Q3"]), (3, "abc", "Q2", []), (4, None, "Q2", ["Q2"]), (5, "abc", "Q2", ["Q2"]), (6, "", "Q100", ["Q2"])], "i int, said string, label string, subsetted_concepts array<string>")
    got = {r.i: (r.top_pred, r.outcome) for r in retrieval.retrieve_texts(rows, "said", entries, k=2, threshold=0.9).collect()}
    assert got == {1: ("Q2", "right"), 2: ("Q3", "incorrect"), 3: ("Q100", "not_matched"), 5: ("Q2", "right"), 6: ("Q100", "right")}


def test_embedding_keeps_rows_and_loads_in_the_worker(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None), (4, "")], "i int, t string")
    got = {r.i: r.vector for r in embedded(df, "t", batch=1).collect()}
    assert got[1] == got[2] and got[3] is None and got[4] == [0.0] * 16 and sum(x * x for x in got[1]) == pytest.approx(1)
    assert {r.i: r.v for r in embedded(df, "t", name="v", normalise=False).collect()}[1] == [0.0, 1.0, 1.0] + [0.0] * 13


def test_negatives_are_distinct_and_spread(spark):
    ontology = spark.createDataFrame([(f"Q{i}", f"G{i % 4}") for i in range(40)], "parameter_id string, category_id string")
    m = spark.createDataFrame([(i, "m", f"Q{i % 45}") for i in range(900)], "mention_id int, mention string, label string")
    rows = training.training_pairs(m, ontology, hard=3, rand=5).collect()
    by = {}
    for r in rows:
        by.setdefault((r.mention_id, r.kind), []).append(r.parameter_id)
    for i in range(900):
        gold, known = f"Q{i % 45}", i % 45 < 40
        hard, rand = by.get((i, "hard"), []), by[(i, "random")]
        assert len(set(rand)) == 5 and gold not in rand and by[(i, "positive")] == [gold]
        assert len(set(hard)) == (3 if known else 0) and gold not in hard and all(int(h[1:]) % 4 == i % 45 % 4 for h in hard)
    drawn = [x for (_, kind), ids in by.items() if kind == "random" for x in ids]
    counts = [drawn.count(f"Q{i}") for i in range(40)]
    assert min(counts) > 60 and max(counts) < 170
    everything = training.training_pairs(m.limit(1), ontology, hard=99, rand=99).collect()
    assert sorted(r.parameter_id for r in everything if r.kind == "random") == sorted(f"Q{i}" for i in range(40) if f"Q{i}" != everything[0].parameter_id)


def test_evaluation_inputs(spark):
    entries = spark.createDataFrame([("Q1", "one")], "parameter_id string, text_feature string")
    m = spark.createDataFrame([(1, "a", "Q1"), (2, "b", "Q100"), (3, "c", None)], "mention_id int, mention string, label string")
    queries, corpus, relevant = training.evaluation_inputs(m, entries)
    assert queries.count() == 3 and [tuple(r) for r in corpus.collect()] == [("Q1", "one")] and [tuple(r) for r in relevant.collect()] == [("mention_1", "Q1")]


def test_index_order(spark):
    rows = spark.createDataFrame([(5, "Q10", "b a", ["c"]), (2, "Q2", "a b", []), (1, "Q3", "d", ["c"])], "ord int, parameter_id string, parameter_name string, parameter_synonyms array<string>")
    got = {r.token_key.replace("\u0001", " "): (r.ord, r.param_ids) for r in ontology.token_index(rows, lambda c: F.split(c, " "), ordered=True).collect()}
    assert got == {"d": (0, ["Q3"]), "c": (1, ["Q3", "Q10"]), "a b": (2, ["Q2", "Q10"])}
