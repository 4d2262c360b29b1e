"""Queries of linkers, retrieval and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.embedding import embedded
from ..functions.similarity import indel_ratio
from ..operators import exact, metrics, prompt, retrieval, subset, training
from ..operators import ontology as onto
from .cases import AMBIGUOUS, CATEGORY_MATCHES, EXCLUSIONS, dealt, dealt_sql
from .data import MENT, NO_ENTRY, ONTO, lcs, mentions, ontology, table, toks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ascii_tokens(col):
    """Basic tokens of text known to be ASCII."""
    return text.basic_tokens(col, unicode=False)


def tokenised(spark: SparkSession, d: str) -> DataFrame:
    return text.tokenised(mentions(spark, d), "mention", ascii_tokens)


def index(spark: SparkSession, d: str) -> DataFrame:
    return onto.token_index(ontology(spark, d), ascii_tokens)


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Mentions in sentences; some are followed by what excludes them."""
    tail = F.when(F.col("l_linenumber") % 3 == 0, "/MIC here").when(F.col("l_quantity") > 45, "/fe effect").otherwise(" was seen")
    df = tokenised(spark, d).withColumn("text", F.concat(F.lit("here "), F.col("mention"), tail))
    return df.withColumn("spans", F.array(F.struct(F.lit(5).alias("start"), (F.length("mention") + 5).alias("end"))))


INDEX = f"""variants AS (SELECT ord, parameter_id, unnest(list_concat([parameter_name], parameter_synonyms)) AS v FROM onto),
idx AS (SELECT key, list(parameter_id ORDER BY ord) AS ids FROM (SELECT {toks('v')} AS key, parameter_id, min(ord) AS ord FROM variants GROUP BY 1, 2) GROUP BY key)"""
LINKED = f"""{ONTO}, {MENT}, {INDEX}, linked AS (
  SELECT ment.*, CASE WHEN l_linenumber % 3 = 0 OR l_quantity > 45 THEN 'excluded' WHEN ids IS NULL THEN 'unlinked' ELSE 'linked' END AS status,
         CASE WHEN l_linenumber % 3 = 0 OR l_quantity > 45 OR ids IS NULL THEN 'Q100' ELSE ids[1] END AS y_pred
  FROM ment LEFT JOIN idx ON {toks('mention')} = key)"""


@query(f"WITH {ONTO}, {INDEX} SELECT array_to_string(key, ' ') AS key, array_to_string(ids, ',') AS ids FROM idx")
def exact_index(spark, d):
    return index(spark, d).select(F.array_join("tokens", " ").alias("key"), F.array_join("param_ids", ",").alias("ids"))


@query(f"WITH {LINKED} SELECT l_orderkey, l_linenumber, label, status, y_pred FROM linked")
def exact_link(spark, d):
    return exact.link_exact(sentences(spark, d), index(spark, d)).select("l_orderkey", "l_linenumber", "label", "status", "y_pred")


@query(f"WITH {LINKED} SELECT status, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM linked) AS pct FROM linked GROUP BY status")
def exact_status_counts(spark, d):
    return exact.status_counts(exact_link(spark, d))


@query(f"""WITH {LINKED}, c AS (SELECT label AS t, y_pred AS p FROM linked WHERE status <> 'unlinked'),
f AS (SELECT l, 2.0 * count(*) FILTER (t = l AND p = l) / (count(*) FILTER (t = l) + count(*) FILTER (p = l)) AS f1 FROM c, (SELECT t AS l FROM c UNION SELECT p FROM c) GROUP BY l)
SELECT round((SELECT avg(f1) FROM f), 6) AS mac_f1, round(avg((t = p)::INT), 6) AS mic_f1, count(*) AS n FROM c""")
def exact_eval(spark, d):
    done = exact.linked(exact_link(spark, d))
    return metrics.classification(done, "label", "y_pred").select(F.round("mac_f1", 6).alias("mac_f1"), F.round("mic_f1", 6).alias("mic_f1"), "n")


@query(f"SELECT l_orderkey, l_linenumber, {dealt_sql(EXCLUSIONS, 'l_partkey')} AS said, {dealt_sql(EXCLUSIONS.values(), 'l_partkey')} AS excluded FROM lineitem")
def nil_filter(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dealt(EXCLUSIONS, "l_partkey").alias("said"))
    return lines.withColumn("excluded", exact.is_excluded(F.col("said")))


@query(f"WITH {ONTO}, {MENT} SELECT l_orderkey, l_linenumber, l_orderkey % 8 < 6 AS invalid FROM ment")
def invalid_context(spark, d):
    k = F.col("l_orderkey") % 8
    before = F.when(k == 4, "  M+ ").when(k == 5, "m  + ").otherwise("here ")
    after = F.when(k == 0, "/MIC was").when(k == 1, "-cr was").when(k == 2, "pharmacodynamic").when(k == 3, "/FE was").when(k == 6, " was creatinine and MIC").otherwise(" was")
    rows = mentions(spark, d).withColumn("text", F.concat(before, "mention", after))
    return rows.select("l_orderkey", "l_linenumber", exact.in_invalid_context(F.col("text"), F.lit(5), F.length("mention") + 5).alias("invalid"))


def parts_sql(rows: str) -> str:
    """SQL for the figures of all, matched and unmatched rows of (t, p, m): truth, prediction, whether matched."""
    return f"""c AS (SELECT t, p, m, count(*) AS n FROM ({rows}) GROUP BY ALL), parts AS (SELECT 'combined' AS part, t, p, n FROM c UNION ALL SELECT CASE WHEN m THEN 'matched' ELSE 'unmatched' END, t, p, n FROM c),
sides AS (SELECT part, t AS l, n AS a, CASE WHEN t = p THEN n ELSE 0 END AS hit FROM parts UNION ALL SELECT part, p, n, 0 FROM parts),
f AS (SELECT part, 2.0 * sum(hit) / sum(a) AS f1 FROM sides GROUP BY part, l), mac AS (SELECT part, round(avg(f1), 6) AS mac_f1 FROM f GROUP BY part),
mic AS (SELECT part, round(sum(CASE WHEN t = p THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS mic_f1, sum(n)::BIGINT AS n FROM parts GROUP BY part)
SELECT part, mic_f1, mac_f1, coalesce(n, 0) AS n, round(coalesce(n * 100.0::DOUBLE / (SELECT sum(n) FROM c), 0), 6) AS matched_pct FROM (SELECT unnest(['combined', 'matched', 'unmatched']) AS part) LEFT JOIN mic USING (part) LEFT JOIN mac USING (part)"""


def parted(out: DataFrame) -> DataFrame:
    return out.select("part", F.round("mic_f1", 6).alias("mic_f1"), F.round("mac_f1", 6).alias("mac_f1"), "n", F.round("matched_pct", 6).alias("matched_pct"))


@query(f"WITH {LINKED}, {parts_sql("SELECT label AS t, y_pred AS p, status <> 'unlinked' AS m FROM linked")}")
def exact_matched(spark, d):
    return parted(metrics.matched_metrics(exact_link(spark, d), F.col("status").isin("excluded", "linked", "disambiguated"), pred="y_pred"))


@query(f"""SELECT n_nationkey, {dealt_sql([t for t, _ in AMBIGUOUS], 'n_nationkey')} AS text, {dealt_sql([s for s, _, _ in AMBIGUOUS.values()], 'n_nationkey')} AS status,
  {dealt_sql([p for _, p, _ in AMBIGUOUS.values()], 'n_nationkey')} AS y_pred, {dealt_sql([c for _, _, c in AMBIGUOUS.values()], 'n_nationkey')} AS candidates FROM nation""")
def exact_ambiguous(spark, d):
    known = {"cl": ["Q2"], "t1/2": ["Q57", "Q60", "Q89"], "km": ["Q1", "Q51"], "x": ["Q7", "Q8"]}
    shared = spark.createDataFrame([(key, [key], ids) for key, ids in known.items()], "token_key string, tokens array<string>, param_ids array<string>")
    rows = table(spark, d, "nation").select("n_nationkey", dealt([t for t, _ in AMBIGUOUS], "n_nationkey").alias("text"), dealt([m for _, m in AMBIGUOUS], "n_nationkey").alias("mention"))
    rows = rows.withColumns({"tokens": F.array(F.lower("mention")), "spans": F.array(F.struct(F.lit(0).alias("start"), F.length("mention").alias("end")))})
    out = exact.link_exact(rows, shared)
    return out.select("n_nationkey", "text", "status", "y_pred", F.coalesce(F.array_join("potential_candidates", ","), F.lit("")).alias("candidates"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN CASE n_nationkey % 5 WHEN 1 THEN 'Q1' WHEN 2 THEN 'Q51' END
  ELSE CASE n_nationkey % 5 WHEN 0 THEN 'Q60' WHEN 3 THEN 'Q89' ELSE 'Q57' END END AS param_id FROM nation""")
def disambiguate(spark, d):
    k = F.col("n_nationkey") % 5
    said = F.when(k == 0, "a two compartment model").when(k == 1, "the enzyme").when(k == 2, "rate 1/h").when(k == 3, "triphasic decline").otherwise(F.col("n_name"))
    ids = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("Q1"), F.lit("Q51"))).otherwise(F.array(F.lit("Q57"), F.lit("Q60"), F.lit("Q89")))
    rows = table(spark, d, "nation").select("n_nationkey", exact.disambiguate(ids, text.preprocess(said)).alias("x"))
    return rows.select("n_nationkey", "x.param_id")


# --- sets ---


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def remove_unlinked(spark, d):
    gone = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return training.without(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, ["o_orderkey"])


@query("SELECT doc_id, 'dev' AS source, lang, NULL::INTEGER AS toxic FROM documents UNION ALL SELECT doc_id, 'unlinked', NULL, toxic::INTEGER FROM labels")
def union_sources(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return training.union_sources(dev=table(spark, d, "documents").select("doc_id", "lang"), unlinked=labels).select("doc_id", "source", "lang", "toxic")


@query("""SELECT (SELECT count(*) FROM orders) AS n_all, (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) AS n_removed,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)) AS n_kept, true AS ok""")
def assert_partition(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    gone = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return training.partition_check(orders, orders.join(gone, "o_orderkey", "left_semi"), training.without(orders, gone, ["o_orderkey"]))


# --- subsets: languages are categories, sources are parameters ---

EDGE_L, EDGE_R = r"(^|[ .,\n])", r"([ .,\n]|$)"
CATEGORIES = tuple((lang, f"{EDGE_L}({words}){EDGE_R}") for lang, words in (("de", "und|der|nicht"), ("en", "the|and|with"), ("es", "los|para|por"), ("fr", "les|dans|une")))
TIERS = (("de", "es"), ("fr",), ("en",))
GROUPS = (("idiot", ("en:src1", "en:src2")), ("license", ("en:src3",)))


def _has(pattern: str) -> str:
    return f"regexp_matches(text, '(?i){pattern}')".replace("\\n", "' || chr(10) || '")


PARAMS = f"list_concat({', '.join(f'CASE WHEN {_has(p)} THEN {list(ids)} ELSE [] END' for p, ids in GROUPS)})"
CATS = f"""cats AS (SELECT doc_id, source, text, list_filter([{', '.join(f"CASE WHEN {_has(p)} THEN '{c}' END" for c, p in CATEGORIES)}], lambda c: c IS NOT NULL) AS hits FROM documents),
prio AS (SELECT *, CASE WHEN list_has_any(hits, ['de', 'es']) THEN list_filter(hits, lambda c: c IN ('de', 'es')) WHEN list_contains(hits, 'fr') THEN ['fr'] ELSE hits END AS categories,
  CASE WHEN len(hits) > 0 THEN [] ELSE {PARAMS} END AS params FROM cats),
concepts AS (SELECT p.*, CASE WHEN len(categories) > 0 THEN (SELECT list_sort(list(DISTINCT d.lang || ':' || d.source)) FROM documents d WHERE list_contains(p.categories, d.lang)) ELSE params END AS subset
  FROM (SELECT DISTINCT categories, params FROM prio) p)"""


def subset_ontology(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("category_id"), F.concat_ws(":", "lang", "source").alias("parameter_id")).distinct()


def subset_docs(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 11 == 0, rules.NIL).otherwise(F.concat_ws(":", "lang", "source")).alias("label"))
    out = subset.with_subset(df, subset_ontology(spark, d), "text", "text", CATEGORIES, GROUPS, TIERS)
    return out.drop("text")


@query(f"""SELECT p_partkey, {dealt_sql([c for c, _ in CATEGORY_MATCHES.values()], 'p_partkey')} AS categories,
  {dealt_sql([','.join('Q' + x for x in c.split(',') if x) or p for c, p in CATEGORY_MATCHES.values()], 'p_partkey')} AS concepts, {dealt_sql([bool(c or p) for c, p in CATEGORY_MATCHES.values()], 'p_partkey')} AS subset_matched FROM part""")
def category_rules(spark, d):
    entries = spark.createDataFrame([(c, "Q" + c) for c, _ in rules.CATEGORIES], "category_id string, parameter_id string")
    rows = table(spark, d, "part").select("p_partkey", dealt([t for t, _ in CATEGORY_MATCHES], "p_partkey").alias("said"), dealt([m for _, m in CATEGORY_MATCHES], "p_partkey").alias("mention"))
    out = subset.with_subset(rows, entries, "said", "mention")
    return out.select("p_partkey", F.array_join("categories", ",").alias("categories"), F.array_join("subsetted_concepts", ",").alias("concepts"), "subset_matched")


@query(f"WITH {CATS} SELECT doc_id, array_to_string(hits, ',') AS hits FROM cats")
def category_match(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(subset.match_categories(c, c, CATEGORIES), ",").alias("hits"))


@query(f"WITH {CATS} SELECT doc_id, array_to_string(categories, ',') AS categories FROM prio")
def category_priority(spark, d):
    return subset_docs(spark, d).select("doc_id", F.array_join("categories", ",").alias("categories"))


@query(f"WITH {CATS} SELECT doc_id, array_to_string({PARAMS}, ',') AS params FROM cats")
def parameter_match(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(subset.match_parameters(c, c, GROUPS), ",").alias("params"))


@query(f"WITH {CATS} SELECT p.doc_id, array_to_string(c.subset, ',') AS subset, len(c.subset) > 0 AS subset_matched FROM prio p JOIN concepts c ON p.categories = c.categories AND p.params = c.params")
def subset_concepts(spark, d):
    return subset_docs(spark, d).select("doc_id", F.array_join("subsetted_concepts", ",").alias("subset"), "subset_matched")


@query(f"""WITH {CATS}, ids AS (SELECT list(DISTINCT lang || ':' || source) AS known FROM documents),
kinds AS (SELECT categories, params, subset, len(list_distinct(list_transform(subset, lambda s: CASE WHEN list_contains(known, s) THEN split_part(s, ':', 1) ELSE 'G100' END))) AS kinds FROM concepts, ids),
x AS (SELECT d.lang || ':' || d.source AS label, d.doc_id % 11 = 0 AS nil, c.subset, c.kinds FROM prio p JOIN kinds c ON p.categories = c.categories AND p.params = c.params JOIN documents d ON p.doc_id = d.doc_id),
n AS (SELECT count(*) AS total, count(*) FILTER (len(subset) > 0) AS matched, count(*) FILTER (len(subset) = 0) AS unmatched, count(*) FILTER (NOT nil AND list_contains(subset, label)) AS correct_matched,
  count(*) FILTER (nil AND len(subset) = 0) AS correct_unmatched, count(*) FILTER (NOT nil) AS total_non_nil, count(*) FILTER (nil) AS total_nil, count(*) FILTER (nil AND len(subset) > 0) AS nil_with_subset,
  count(*) FILTER (len(subset) > 1 AND kinds > 1) AS multi_category, round(100 * avg(CASE WHEN len(subset) > 1 THEN 1 - len(subset) / (SELECT len(known) FROM ids)::DOUBLE END), 6) AS avg_reduction FROM x)
SELECT *, correct_matched + correct_unmatched AS correct_total, round((correct_matched + correct_unmatched)::DOUBLE / total, 6) AS overall_accuracy, round(coalesce(correct_matched::DOUBLE / nullif(matched, 0), 0), 6) AS matched_accuracy,
  round(coalesce(correct_unmatched::DOUBLE / nullif(unmatched, 0), 0), 6) AS unmatched_accuracy, round(coalesce(correct_matched::DOUBLE / nullif(total_non_nil, 0), 0), 6) AS subset_recall_non_nil, round(coalesce(nil_with_subset::DOUBLE / nullif(total_nil, 0), 0), 6) AS nil_false_positive_rate FROM n""")
def subset_eval(spark, d):
    out = subset.evaluate_subsets(subset_docs(spark, d), subset_ontology(spark, d))
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"})


@query(f"""WITH {CATS}, o AS (SELECT lang, source, '[PARAM_NAME] ' || lang || ':' || source || chr(10) || '        [DESC] N/A' || chr(10) || '        [SYN] N/A' || chr(10) || '        [UNIT] N/A' || chr(10) || '        [CATEGORY] ' || lang AS entry FROM (SELECT DISTINCT lang, source FROM documents)),
picks AS (SELECT categories, params, o.* FROM (SELECT DISTINCT categories, params FROM prio) JOIN o ON list_contains(categories, lang) OR list_contains(params, lang || ':' || source)),
texts AS (SELECT categories, params, string_agg(entry, chr(10) || chr(10) ORDER BY lang, source) AS t FROM picks GROUP BY ALL)
SELECT doc_id, md5(coalesce(t, (SELECT string_agg(entry, chr(10) || chr(10) ORDER BY lang, source) FROM o))) AS ontology_subset FROM prio p LEFT JOIN texts x ON p.categories = x.categories AND p.params = x.params""")
def ontology_subset(spark, d):
    ids = subset_ontology(spark, d)
    place = F.row_number().over(Window.orderBy("lang", "source"))  # some dozen rows
    o = table(spark, d, "documents").select("lang", "source").distinct().withColumn("ord", place)
    o = o.select("ord", F.col("lang").alias("category_id"), F.col("lang").alias("parameter_category"), F.concat_ws(":", "lang", "source").alias("parameter_id"))
    o = o.withColumns({"parameter_name": F.col("parameter_id"), "parameter_description": F.lit(""), "units": F.lit(""), "parameter_synonyms": F.array().cast("array<string>")})
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = subset.with_subset(docs, ids, "text", "text", CATEGORIES, GROUPS, TIERS)
    return subset.with_ontology_text(out, o).select("doc_id", F.md5("ontology_subset").alias("ontology_subset"))


# --- fuzzy retrieval ---

K, T = 3, 60.0
SCORES = f"""{ONTO}, {MENT}, keys AS (SELECT DISTINCT {toks('mention')} AS mt FROM ment), names AS (SELECT {toks('parameter_name')} AS kt, parameter_id, category_id FROM onto),
strs AS (SELECT mt, kt, parameter_id, category_id, array_to_string(mt, ' ') AS a, array_to_string(kt, ' ') AS b FROM keys, names),
str AS (SELECT a, parameter_id, category_id, {lcs('a', 'b')} AS score FROM strs)"""


def best_sql(rows: str) -> str:
    return f"SELECT a AS mention, parameter_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, parameter_id) AS rank FROM ({rows})) WHERE rank <= {K}"


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Distinct token sets of the mentions; no row is joined back to its tokens."""
    return mentions(spark, d).select("mention").distinct().select(text.once(ascii_tokens(F.col("mention"))).alias("tokens")).distinct()


def ranked(rows: DataFrame, k: int = K, t: float = T) -> DataFrame:
    out = retrieval.top_k(rows, ["m_key"], k, t)
    return out.select(F.replace("m_key", F.lit(text.KEY_SEPARATOR), F.lit(" ")).alias("mention"), "parameter_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {ONTO}, {MENT}, p AS (SELECT DISTINCT mention AS a, parameter_name AS b FROM ment, onto) SELECT a AS mention, b AS name, round({lcs('a', 'b')}, 6) AS score FROM p")
def indel_ratios(spark, d):
    pairs = mentions(spark, d).select("mention").distinct().crossJoin(ontology(spark, d).select(F.col("parameter_name").alias("name")))  # distinct mentions against the fixed list
    return pairs.select("mention", "name", F.round(indel_ratio(F.col("mention"), F.col("name")), 6).alias("score"))


@query(f"WITH {SCORES} {best_sql(f'SELECT * FROM str WHERE score >= {T}')}")
def fuzzy_string_topk(spark, d):
    return ranked(retrieval.scored(retrieval.pairs(keyed(spark, d), index(spark, d)), "string", T))


TOKEN = f"""{SCORES}, tok AS (SELECT array_to_string(mt, ' ') AS a, mt, kt, parameter_id, category_id, unnest(mt) AS s FROM strs), tk AS (SELECT a, mt, kt, parameter_id, category_id, s, unnest(kt) AS t FROM tok),
hit AS (SELECT a, parameter_id, category_id, len(any_value(mt)) AS n, len(any_value(kt)) AS m, s, max({lcs('s', 't')}) AS best FROM tk GROUP BY a, parameter_id, category_id, s),
token AS (SELECT a, parameter_id, category_id, 100.0 * count(*) FILTER (best >= {T}) / greatest(any_value(n), any_value(m)) AS score FROM hit GROUP BY a, parameter_id, category_id)"""


@query(f"WITH {TOKEN} {best_sql(f'SELECT * FROM token WHERE score >= {T}')}")
def fuzzy_token_topk(spark, d):
    return ranked(retrieval.scored(retrieval.pairs(keyed(spark, d), index(spark, d)), "token", T))


def constrained(spark: SparkSession, d: str) -> DataFrame:
    """Mention keys with the ids of the categories that their tokens name."""
    o = ontology(spark, d).select("parameter_category", "parameter_id")
    rows = keyed(spark, d).withColumn("parameter_category", F.explode_outer("tokens")).join(o, "parameter_category", "left")
    return rows.groupBy("tokens").agg(F.array_sort(F.collect_set("parameter_id")).alias("subsetted_concepts"))


@query(f"WITH {SCORES} {best_sql(f'''SELECT * FROM str WHERE score >= {T} AND list_contains(string_split(a, ' '), substr(category_id, 2))''')}")
def fuzzy_constrained(spark, d):
    return ranked(retrieval.scored(retrieval.pairs(constrained(spark, d), index(spark, d), constrained=True), "string", T))


TOP = f"""{SCORES}, top AS (SELECT a, min_by(parameter_id, (-score, parameter_id)) AS pred, max(score) AS score FROM str GROUP BY a)"""


@query(f"WITH {SCORES} SELECT a AS mention, parameter_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, substr(parameter_id, 2)::BIGINT) AS rank FROM str WHERE score >= {T}) WHERE rank <= {K}")
def fuzzy_index_order(spark, d):
    rows = retrieval.scored(retrieval.pairs(keyed(spark, d), onto.token_index(ontology(spark, d), ascii_tokens, ordered=True)), "string", T)
    out = retrieval.top_k_in_order(rows, ["m_key"], K, T)
    return out.select(F.replace("m_key", F.lit(text.KEY_SEPARATOR), F.lit(" ")).alias("mention"), "parameter_id", F.round("score", 6).alias("score"), "rank")


def with_nil(df: DataFrame) -> DataFrame:
    """Mentions of large quantities belong to no entry."""
    return df.withColumn("label", F.when(F.col("l_quantity") > 48, rules.NIL).otherwise(F.col("label")))


NIL_LABEL = "CASE WHEN l_quantity > 48 THEN 'Q100' ELSE label END"
TOP_MENT = f"ment JOIN top ON array_to_string({toks('mention')}, ' ') = a"


@query(f"WITH {TOP}, {parts_sql(f"SELECT {NIL_LABEL} AS t, CASE WHEN score >= 80 THEN pred ELSE 'Q100' END AS p, score >= 80 AS m FROM {TOP_MENT}")}")
def fuzzy_matched(spark, d):
    out = retrieval.retrieve_fuzzy(with_nil(tokenised(spark, d)), index(spark, d), 10, 80, "string")
    return parted(metrics.matched_metrics(out, F.col("is_matched")))


@query(f"""WITH {TOP} SELECT count(*) AS n, count(*) FILTER (score >= 80) AS n_matched, round(avg((CASE WHEN score >= 80 THEN pred ELSE 'Q100' END = label)::INT), 6) AS micro_f1
FROM ment JOIN top ON array_to_string({toks('mention')}, ' ') = a""")
def fuzzy_eval(spark, d):
    out = retrieval.retrieve_fuzzy(tokenised(spark, d), index(spark, d), 10, 80, "string")
    return out.agg(F.count("*").alias("n"), F.count_if("is_matched").alias("n_matched"), F.round(F.avg((F.col("top_pred") == F.col("label")).cast("int")), 6).alias("micro_f1"))


@query(f"WITH {TOP} SELECT t::DOUBLE AS threshold, count(*) FILTER (score >= t) AS n_matched, count(*) FILTER (score >= t AND pred = label) AS n_right FROM ment JOIN top ON array_to_string({toks('mention')}, ' ') = a, (SELECT unnest([50, 60, 70, 80, 90]) AS t) GROUP BY t")
def fuzzy_sweep(spark, d):
    m = tokenised(spark, d).withColumn("m_key", text.token_key(F.col("tokens"))).groupBy("m_key", "label").agg(F.count("*").alias("c"))
    best = retrieval.sweep(retrieval.pairs(keyed(spark, d), index(spark, d)), [50, 60, 70, 80, 90])
    right = F.when(F.col("parameter_id") == F.col("label"), F.col("c")).otherwise(0)
    return best.join(m, "m_key").groupBy("threshold").agg(F.sum("c").alias("n_matched"), F.sum(right).alias("n_right"))


@query(f"""WITH {SCORES}, r AS (SELECT a, parameter_id, row_number() OVER (PARTITION BY a ORDER BY score DESC, parameter_id) AS rank FROM str WHERE score >= {T})
SELECT l_linenumber % 4 AS kind, round(avg(coalesce(1.0 / r.rank, 0)), 6) AS mrr, round(avg((r.rank IS NOT NULL)::INT), 6) AS recall_at_k, round(avg((coalesce(b.parameter_id, 'Q100') = {NIL_LABEL})::INT), 6) AS micro_f1,
  count(*) FILTER (b.parameter_id IS NULL) AS nil_count, round(count(*) FILTER (b.parameter_id IS NULL) * 100.0::DOUBLE / count(*), 2) AS nil_prop, count(*) AS n
FROM ment LEFT JOIN r ON array_to_string({toks('mention')}, ' ') = r.a AND {NIL_LABEL} = r.parameter_id AND r.rank <= {K} LEFT JOIN r b ON array_to_string({toks('mention')}, ' ') = b.a AND b.rank = 1 GROUP BY 1""")
def mrr_recall(spark, d):
    out = retrieval.retrieve_fuzzy(with_nil(tokenised(spark, d)).withColumn("kind", F.col("l_linenumber") % 4), index(spark, d), K, T, "string")
    return metrics.retrieval(out, ("kind",), nil=~F.col("is_matched")).select("kind", *(F.round(c, 6).alias(c) for c in ("mrr", "recall_at_k", "micro_f1")), "nil_count", "nil_prop", "n")


# --- dense retrieval: vectors with an id divisible by 50 against all others ---

DENSE = """q AS (SELECT vec_id AS qid, label AS ql, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, ql, vec_id, label, round(list_cosine_similarity(v, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, lpad(vec_id::VARCHAR, 12, '0')) AS rank FROM s),
top AS (SELECT * FROM r WHERE rank <= 5)"""


def dense(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"), F.col("label").alias("ql"))
    name = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    corpus = e.select(name("vec_id").alias("parameter_id"), F.col("embedding").alias("c_vec"))
    found = retrieval.dense_nearest(queries.withColumn("own_id", name("query_id")), corpus, k, digits=6)
    labels = e.select(name("vec_id").alias("parameter_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("found"))
    return found.join(labels, "parameter_id").join(queries.select("query_id", F.concat(F.lit("L"), F.col("ql").cast("string")).alias("label")), "query_id")


@query(f"WITH {DENSE} SELECT qid AS query_id, vec_id, rank::INTEGER AS rank, score FROM top")
def dense_topk(spark, d):
    return dense(spark, d).select("query_id", F.col("parameter_id").cast("long").alias("vec_id"), "rank", "score")


@query(f"WITH {DENSE} SELECT qid AS query_id, vec_id, score FROM top WHERE score >= 0.35")
def dense_threshold(spark, d):
    return dense(spark, d).where("score >= 0.35").select("query_id", F.col("parameter_id").cast("long").alias("vec_id"), "score")


def dense_lists(spark: SparkSession, d: str, threshold: float = -1.0) -> DataFrame:
    lists = dense(spark, d).where(F.col("score") >= threshold).groupBy("query_id", "label").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("found").alias("parameter_id"), "score"))).alias("retrieved"))
    return lists.withColumn("source", F.when(F.col("query_id") % 100 == 0, "dev").otherwise("unlinked"))


@query(f"WITH {DENSE} SELECT qid AS query_id, coalesce(min_by('L' || label, rank) FILTER (label % 2 = ql % 2), 'Q100') AS top_pred FROM top GROUP BY qid")
def dense_constrained(spark, d):
    parity = lambda c: F.substring(c, 2, 9).cast("int") % 2
    kept = dense_lists(spark, d).withColumn("retrieved", F.filter("retrieved", lambda r: parity(r["parameter_id"]) == parity(F.col("label"))))
    return retrieval.judged(kept, explicit_nil=True).select("query_id", "top_pred")


@query(f"""WITH {DENSE}, x AS (SELECT q.qid, any_value(CASE WHEN q.qid % 150 = 0 THEN 'Q100' ELSE 'L' || q.ql END) AS gold, list('L' || top.label ORDER BY rank) FILTER (score >= 0.35) AS ids FROM q LEFT JOIN top ON q.qid = top.qid GROUP BY q.qid),
y AS (SELECT qid, gold, coalesce(ids, ['Q100']) AS ids FROM x)
SELECT CASE WHEN qid % 100 = 0 THEN 'dev' ELSE 'unlinked' END AS source, round(avg(CASE WHEN list_contains(ids, gold) THEN 1.0 / list_position(ids, gold) ELSE 0 END), 6) AS mrr, round(avg(list_contains(ids, gold)::INT), 6) AS recall_at_k, round(avg((ids[1] = gold)::INT), 6) AS micro_f1,
  count(*) FILTER (ids[1] = 'Q100') AS nil_count, round(count(*) FILTER (ids[1] = 'Q100') * 100.0::DOUBLE / count(*), 2) AS nil_prop, count(*) AS n FROM y GROUP BY 1""")
def dense_eval_by_source(spark, d):
    queries = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 150 == 0, rules.NIL).otherwise(F.concat(F.lit("L"), F.col("label").cast("string"))).alias("label"))
    lists = queries.join(dense_lists(spark, d, 0.35).select("query_id", "retrieved"), "query_id", "left").withColumn("source", F.when(F.col("query_id") % 100 == 0, "dev").otherwise("unlinked"))
    out = metrics.retrieval(retrieval.judged(lists, explicit_nil=True), ("source",))
    return out.select("source", *(F.round(c, 6).alias(c) for c in ("mrr", "recall_at_k", "micro_f1")), "nil_count", "nil_prop", "n")


def vector_sql(x: str) -> str:
    """SQL for the vector of the provider that needs no model."""
    return f"list_transform(range(0, 16), lambda i: len(list_filter(string_split({x}, ''), lambda c: unicode(c) % 16 = i))::DOUBLE)"


@query(f"""WITH {ONTO}, v AS (SELECT parameter_id, {vector_sql('parameter_name')} AS v FROM onto), u AS (SELECT parameter_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l, unnest(range(0, 16)) AS i FROM v)
SELECT parameter_id, i::INTEGER AS i, round(v[i + 1] / l, 6) AS x FROM u""")
def embed_texts(spark, d):
    out = embedded(ontology(spark, d).select("parameter_id", "parameter_name"), "parameter_name")
    return out.select("parameter_id", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"""WITH {ONTO}, {MENT}, m AS (SELECT DISTINCT mention, {NIL_LABEL} AS label FROM ment), e AS (SELECT parameter_id, category_id, {vector_sql('parameter_name')} AS v FROM onto), t AS (SELECT mention, {vector_sql('mention')} AS v FROM (SELECT DISTINCT mention FROM m)),
s AS (SELECT mention, parameter_id, category_id, round(list_cosine_similarity(t.v, e.v), 6) AS score FROM t, e), r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, parameter_id) AS rank FROM s),
k AS (SELECT m.mention, m.label, list(parameter_id ORDER BY rank) FILTER (length(m.mention) % 5 > 0 AND rank <= 5 AND score >= 0.9 AND upper(substr(category_id, 2, 1)) IN (upper(left(m.mention, 1)), upper(left(split_part(m.mention, ' ', 2), 1)))) AS ids FROM m JOIN r ON m.mention = r.mention GROUP BY ALL)
SELECT mention, label, coalesce(len(ids), 1)::INTEGER AS n, coalesce(ids[1], 'Q100') AS top_pred, CASE WHEN coalesce(ids[1], 'Q100') = label THEN 'right' WHEN ids IS NULL THEN 'not_matched' ELSE 'incorrect' END AS outcome FROM k""")
def dense_retrieve(spark, d):
    o = ontology(spark, d)
    m = with_nil(mentions(spark, d)).select("mention", "label").distinct()
    # allowed: entries of categories that start like one of the mention's words, none for every fifth length
    starts = F.array_distinct(F.transform(F.split("mention", " "), lambda w: F.upper(F.left(w, F.lit(1)))))
    letters = o.select(F.upper(F.substring("category_id", 2, 1)).alias("letter"), "parameter_id").groupBy("letter").agg(F.collect_set("parameter_id").alias("ids"))
    allowed = m.where(F.length("mention") % 5 > 0).select("mention").distinct().select("mention", F.explode(starts).alias("letter")).join(letters, "letter").groupBy("mention").agg(F.flatten(F.collect_list("ids")).alias("subsetted_concepts"))
    rows = m.join(allowed, "mention", "left").withColumn("subsetted_concepts", F.coalesce("subsetted_concepts", F.array().cast("array<string>")))
    entries = o.select("ord", "parameter_id", F.col("parameter_name").alias("text_feature"))
    out = retrieval.retrieve_texts(rows, "mention", entries, k=5, threshold=0.9, digits=6)
    return out.select("mention", "label", F.size("retrieved").alias("n"), "top_pred", retrieval.outcome(nil=~F.col("is_matched")).alias("outcome"))


# --- training pairs ---


def part_mentions(spark: SparkSession, d: str) -> DataFrame:
    ids = ontology(spark, d).select(F.col("parameter_name").alias("p_name"), F.col("parameter_id").alias("label"))
    return table(spark, d, "part").join(ids, "p_name").select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("mention"), "label")


def draw_sql(*parts: str) -> str:
    return f"('0x' || left(md5({" || '|' || ".join(parts)}), 8))::BIGINT"


def negative_sql(kind: str, pool: str, n: int) -> str:
    """SQL for n negatives: one rank from each stretch of the pool's ranks without the gold one."""
    return f"""SELECT mention_id, parameter_id, '{kind}' AS kind, 0.0::DOUBLE AS label FROM (
    WITH ranked AS (SELECT pool, parameter_id, row_number() OVER (PARTITION BY pool ORDER BY {draw_sql(f"'0:{kind}'", 'pool', 'parameter_id')}, parameter_id) - 1 AS rank, count(*) OVER (PARTITION BY pool) - 1 AS others FROM (SELECT {pool} AS pool, parameter_id FROM onto)),
    wanted AS (SELECT mention_id, pool, rank AS own, others, least(others, {n}) AS take, unnest(range(least(others, {n}))) AS j FROM trained JOIN ranked ON label = parameter_id),
    places AS (SELECT mention_id, pool, own, j * others // take + {draw_sql(f"'0:{kind}'", 'mention_id', 'j')} % ((j + 1) * others // take - j * others // take) AS place FROM wanted)
    SELECT mention_id, r.parameter_id FROM places p JOIN ranked r ON r.pool = p.pool AND r.rank = p.place + (p.place >= p.own)::INT)"""


def trained(spark: SparkSession, d: str) -> DataFrame:
    """Parts as mentions; every seventh belongs to no entry."""
    return part_mentions(spark, d).withColumn("label", F.when(F.col("mention_id") % 7 == 0, f" {NO_ENTRY.lower()} ").otherwise(F.col("label")))


GOLD = f"{ONTO}, gold AS (SELECT p_partkey AS mention_id, p_name AS mention, parameter_id AS label, category_id FROM part JOIN onto ON p_name = parameter_name)"


TRAINED = f"{GOLD}, trained AS (SELECT * FROM gold WHERE mention_id % 7 <> 0)"


@query(f"WITH {TRAINED} {negative_sql('hard', 'category_id', 2)}")
def hard_negatives(spark, d):
    out = training.training_pairs(trained(spark, d), ontology(spark, d), hard=2, rand=1, nil=NO_ENTRY)
    return out.where("kind = 'hard'").select("mention_id", "parameter_id", "kind", "label")


@query(f"WITH {TRAINED} {negative_sql('random', "''", 3)}")
def random_negatives(spark, d):
    out = training.training_pairs(trained(spark, d), ontology(spark, d), hard=2, rand=3, nil=NO_ENTRY)
    return out.where("kind = 'random'").select("mention_id", "parameter_id", "kind", "label")


@query(f"WITH {TRAINED} SELECT mention_id, label AS parameter_id, 'positive' AS kind, 1.0::DOUBLE AS label FROM trained UNION ALL {negative_sql('hard', 'category_id', 1)} UNION ALL {negative_sql('random', "''", 1)}")
def training_pairs(spark, d):
    return training.training_pairs(trained(spark, d), ontology(spark, d), nil=NO_ENTRY).select("mention_id", "parameter_id", "kind", "label")


@query(f"""WITH {GOLD} SELECT 'query' AS kind, 'mention_' || mention_id AS id, mention AS value FROM gold UNION ALL SELECT 'corpus', parameter_id, parameter_name FROM onto
UNION ALL SELECT 'relevant', 'mention_' || mention_id, label FROM gold WHERE mention_id % 7 <> 0""")
def evaluation_inputs(spark, d):
    rows = part_mentions(spark, d).withColumn("label", F.when(F.col("mention_id") % 7 == 0, NO_ENTRY).otherwise(F.col("label")))
    parts = training.evaluation_inputs(rows, ontology(spark, d).select("parameter_id", F.col("parameter_name").alias("text_feature")), NO_ENTRY)
    named = [p.select(F.lit(kind).alias("kind"), F.col(p.columns[0]).alias("id"), F.col(p.columns[1]).alias("value")) for kind, p in zip(("query", "corpus", "relevant"), parts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


# --- prompts ---


@query(f"""WITH {ONTO}, o AS (SELECT string_agg(parameter_name, ', ' ORDER BY ord) AS names FROM onto)
SELECT conv_id, turn, md5(trim('---' || chr(10) || 'Mention:' || chr(10) || text || chr(10) || '---' || chr(10) || chr(10) || '---' || chr(10) || 'Context:' || chr(10) || role || chr(10) || '---' || chr(10) || chr(10) || '---' || chr(10) || 'Ontology:' || chr(10) || chr(10) || names || chr(10) || '---')) AS prompt FROM conversations, o""")
def prompt_build(spark, d):
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "parameter_name"))), lambda x: x["parameter_name"]), ", ")
    o = ontology(spark, d).agg(names.alias("names"))
    return table(spark, d, "conversations").crossJoin(F.broadcast(o)).select("conv_id", "turn", F.md5(prompt.user_prompt(F.col("text"), F.col("names"), F.col("role"))).alias("prompt"))  # one row


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers as a model might give them: right, NIL, or of no use."""
    k = F.col("mention_id") % 3
    said = F.when(k == 0, F.concat(F.lit("{param: "), F.upper("mention"), F.lit("}"))).when(k == 1, "{param: NIL}").otherwise("do not know")
    return prompt.grounded(part_mentions(spark, d).withColumn("response", said), onto.parameter_names(ontology(spark, d)))


@query(f"WITH {GOLD} SELECT mention_id, CASE WHEN mention_id % 3 = 0 THEN label ELSE 'Q100' END AS llm_pred, mention_id % 3 = 2 AS no_answer FROM gold")
def prompt_parse(spark, d):
    return responses(spark, d).select("mention_id", "llm_pred", "no_answer")


def stub(prompts):
    """A client that needs no model: right for names of an even length, else NIL or of no use."""
    said = ("{{param: {}}}", "{{param: NIL}}", "do not know")
    return [said[len(p) % 3].format(p.upper()) for p in prompts]


@query(f"WITH {GOLD} SELECT mention_id, CASE WHEN length(mention) % 3 = 0 THEN label ELSE 'Q100' END AS llm_pred, length(mention) % 3 = 2 AS no_answer FROM gold")
def llm_link(spark, d):
    asked = prompt.answered(part_mentions(spark, d).withColumn("prompt", F.col("mention")), stub, "gpt-4o")
    return prompt.grounded(asked, onto.parameter_names(ontology(spark, d))).select("mention_id", "llm_pred", "no_answer")


@query(f"""WITH {GOLD}, a AS (SELECT run, CASE WHEN mention_id % 13 = 0 THEN 'unknown' WHEN mention_id % 2 = 0 THEN 'dev' ELSE 'unlinked' END AS source, (mention_id + run) % 3 = 0 AS hit, (mention_id + run) % 3 < 2 AS answered FROM gold, (SELECT unnest([0, 1, 2]) AS run)),
p AS (SELECT * FROM a UNION ALL SELECT run, 'all', hit, answered FROM a), r AS (SELECT run, source, avg(hit::INT) AS f1, count(*) FILTER (answered) AS answered FROM p GROUP BY ALL)
SELECT source, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1, floor(avg(answered))::BIGINT AS mean_matched, count(*) AS runs FROM r GROUP BY source""")
def runs_by_source(spark, d):
    k = (F.col("mention_id") + F.col("run")) % 3
    rows = part_mentions(spark, d).withColumn("run", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.withColumn("source", F.when(F.col("mention_id") % 13 == 0, F.lit(None).cast("string")).when(F.col("mention_id") % 2 == 0, "dev").otherwise("unlinked"))
    said = F.when(k == 0, F.concat(F.lit("{param: "), F.upper("mention"), F.lit("}"))).when(k == 1, "{param: NIL}").otherwise("do not know")
    out = metrics.runs_by_source(prompt.grounded(rows.withColumn("response", said), onto.parameter_names(ontology(spark, d)), nil=NO_ENTRY))
    return out.select("source", F.round("mean_f1", 6).alias("mean_f1"), F.round("std_f1", 6).alias("std_f1"), "mean_matched", "runs")


@query(f"WITH {GOLD} SELECT label AS y_true, CASE WHEN mention_id % 3 = 0 AND mention_id % 2 = 0 THEN label ELSE 'Q100' END AS y_pred, count(*) AS n FROM gold GROUP BY 1, 2")
def prompt_merge(spark, d):
    rows = responses(spark, d).withColumn("subset_matched", F.col("mention_id") % 2 == 0)
    asked, rest = subset.split_matched(rows)
    return prompt.with_unmatched(asked, rest).groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


@query(f"WITH {GOLD}, c AS (SELECT len(regexp_extract_all(mention || ' ' || label, '\\S+')) AS t FROM gold) SELECT 'gpt-4o-mini' AS model, count(*) AS total_examples, round(avg(t), 2) AS average_prompt_tokens, round(avg(t / 1000 * 0.00015 + 0.007 * 0.0006), 6) AS average_cost, round(round(avg(t / 1000 * 0.00015 + 0.007 * 0.0006), 6) * 1000, 6) AS cost_per_1000, round(sum(t / 1000 * 0.00015 + 0.007 * 0.0006), 6) AS total_cost FROM c")
def cost_estimate(spark, d):
    return prompt.cost(part_mentions(spark, d), "gpt-4o-mini", prompt.count_tokens(F.concat_ws(" ", "mention", "label")))
