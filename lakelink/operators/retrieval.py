"""Fuzzy and dense retrieval: candidates, scores, top k.

Candidates are pairs of distinct mention keys and index keys; mentions meet their scores by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import nearest, rules
from ..functions.embedding import Load, embedded, hashed
from ..functions.similarity import best_ratios, cosine, indel_ratio, token_set_score
from ..functions.text import token_key


def pairs(mentions: DataFrame, index: DataFrame, constrained: bool = False) -> DataFrame:
    """(m_key, m_tokens, key, tokens, parameter_id), distinct.

    mentions: tokens and, if constrained, subsetted_concepts: then an equi-join on the exploded parameter id
    takes the place of the product, and an empty subset has no candidates. Without it every distinct mention
    key meets every index row: a stated query set against all rows. If the index has `ord`, its rows' order,
    candidates have `place`, the order of its ids.
    """
    place = ["place"] if "ord" in index.columns else []
    entries = index.select("*", F.posexplode("param_ids").alias("pos", "parameter_id")).withColumns({c: F.col("ord") * 65536 + F.col("pos") for c in place})
    entries = entries.select(F.col("token_key").alias("key"), F.col("tokens").alias("k_tokens"), "parameter_id", *place)
    m = mentions.select(token_key(F.col("tokens")).alias("m_key"), F.array_sort(F.array_distinct("tokens")).alias("m_tokens"), *(["subsetted_concepts"] if constrained else [])).distinct()
    if constrained:
        return m.select("m_key", "m_tokens", F.array_join("subsetted_concepts", ",").alias("subset"), F.explode("subsetted_concepts").alias("parameter_id")).join(entries, "parameter_id")
    return m.withColumn("subset", F.lit("")).crossJoin(entries)


def can_reach(mode: str, threshold: float) -> Column:
    """Whether the best score that the sizes of both sides allow is at the threshold or above."""
    if mode == "string":
        a, b = (F.length(F.array_join(c, " ")) for c in ("m_tokens", "k_tokens"))
        return F.coalesce(F.try_divide(F.least(a, b) * 200.0, a + b), F.lit(100.0)) >= threshold
    if mode == "token":
        a, b = F.size("m_tokens"), F.size("k_tokens")
        return F.try_divide(a * 100.0, F.greatest(a, b)) >= threshold
    raise ValueError("mode must be 'token' or 'string'")


def scored(candidates: DataFrame, mode: str = "string", threshold: float = 80) -> DataFrame:
    """Candidates with score; token mode counts tokens that reach the threshold, string mode joins tokens.

    Candidates whose lengths alone keep them below the threshold are left out before they are scored.
    """
    candidates = candidates.where(can_reach(mode, threshold))
    if mode == "string":
        score = indel_ratio(F.array_join("m_tokens", " "), F.array_join("k_tokens", " "))
    else:
        score = token_set_score(F.col("m_tokens"), F.col("k_tokens"), threshold)
    keys = candidates.select("m_key", "m_tokens", "key", "k_tokens").distinct().withColumn("score", score)
    return candidates.join(keys.select("m_key", "key", "score"), ["m_key", "key"])


def top_k_in_order(rows: DataFrame, by: list[str], k: int, threshold: float, place: str = "place") -> DataFrame:
    """Like top_k, but equal scores keep the order of the index: that of the first place with the best score."""
    best = rows.where(F.col("score") >= threshold).groupBy(*by, "parameter_id").agg(F.max(F.struct("score", (-F.col(place)).alias("back"))).alias("best"))
    order = Window.partitionBy(*by).orderBy(F.desc("best"), "parameter_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "parameter_id", F.col("best.score").alias("score"), "rank")


def top_k(rows: DataFrame, by: list[str], k: int, threshold: float) -> DataFrame:
    """Best score of each (by, parameter_id) at the threshold or above, ranked by score, then id, up to k."""
    best = rows.where(F.col("score") >= threshold).groupBy(*by, "parameter_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "parameter_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve_fuzzy(mentions: DataFrame, index: DataFrame, k: int = 10, threshold: float = 80, mode: str = "token", constrained: bool = False) -> DataFrame:
    """mentions with retrieved (ranked structs), top_pred (NIL if none) and is_matched."""
    ranked = top_k(scored(pairs(mentions, index, constrained), mode, threshold), ["m_key", "subset"], k, threshold)
    lists = ranked.groupBy("m_key", "subset").agg(F.array_sort(F.collect_list(F.struct("rank", "parameter_id", "score"))).alias("retrieved"))
    subset = F.array_join("subsetted_concepts", ",") if constrained else F.lit("")
    out = mentions.withColumn("m_key", token_key(F.col("tokens"))).withColumn("subset", subset).join(lists, ["m_key", "subset"], "left").drop("m_key", "subset")
    return judged(out)


def judged(df: DataFrame, explicit_nil: bool = False) -> DataFrame:
    """top_pred and is_matched from `retrieved`; explicit_nil puts NIL into empty lists, as dense retrieval does."""
    nil = F.array(F.struct(F.lit(1).alias("rank"), F.lit(rules.NIL).alias("parameter_id"), F.lit(0.0).alias("score")))
    empty = F.coalesce(F.size("retrieved"), F.lit(0)) < 1
    df = df.withColumn("is_matched", ~empty).withColumn("top_pred", F.when(empty, F.lit(rules.NIL)).otherwise(F.get("retrieved", F.lit(0))["parameter_id"]))
    return df.withColumn("retrieved", F.when(empty, nil).otherwise(F.col("retrieved"))) if explicit_nil else df


def sweep(candidates: DataFrame, thresholds: list[float], mode: str = "string") -> DataFrame:
    """(threshold, m_key, subset, parameter_id, score): best candidate at each threshold, scored once."""
    if mode == "string":
        base = scored(candidates, "string", min(thresholds))
        rows = base.where(F.col("score") >= min(thresholds)).withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    else:
        candidates = candidates.where(can_reach(mode, min(thresholds)))
        keys = candidates.select("m_key", "m_tokens", "key", "k_tokens").distinct().withColumn("best", best_ratios(F.col("m_tokens"), F.col("k_tokens")))
        keys = keys.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
        n = F.size(F.filter("best", lambda x: x >= F.col("threshold")))
        keys = keys.withColumn("score", F.try_divide(n * 100.0, F.greatest(F.size("m_tokens"), F.size("k_tokens"))))
        rows = candidates.join(keys.select("m_key", "key", "threshold", "score"), ["m_key", "key"])
    best = rows.where(F.col("score") >= F.col("threshold")).groupBy("threshold", "m_key", "subset").agg(F.min(F.struct((-F.col("score")).alias("s"), "parameter_id")).alias("b"))
    return best.select("threshold", "m_key", "subset", "b.parameter_id", (-F.col("b.s")).alias("score"))


def dense_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, parameter_id, score): a stated query set (query_id, q_vec) against all corpus rows (parameter_id, c_vec)."""
    return queries.crossJoin(corpus).select("query_id", "parameter_id", cosine(F.col("q_vec"), F.col("c_vec")).alias("score"))


def dense_top_k(scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Ranked by score, then id. digits rounds first, so that near-ties fall to the id."""
    score: Column = F.round("score", digits) if digits is not None else F.col("score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "parameter_id")
    return scores.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Vectors of a side of a block of pairs: 4 MB of doubles for 64 dimensions.
BLOCK = 8192


def dense_nearest(queries: DataFrame, corpus: DataFrame, k: int, digits: int | None = None, counted: tuple[DataFrame, DataFrame] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of dense_top_k(dense_scores(queries, corpus), k, digits), without a row for each pair.

    All pairs are looked at, block by block as products of matrices; a block hands on k rows of each query at most,
    so that memory depends on the block alone. queries may have own_id, an id that the query does not find.
    counted: frames with as many rows as queries and corpus, where these are dear to make.
    """
    if "own_id" not in queries.columns:
        queries = queries.withColumn("own_id", F.lit(None).cast(corpus.schema["parameter_id"].dataType))
    many = [df.agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).alias(f"n_{side}")) for side, df in zip("qc", counted or (queries, corpus), strict=True)]
    sizes = F.broadcast(many[0].crossJoin(many[1]))  # one row

    def dealt(df: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        rows = df.crossJoin(sizes).withColumn(mine, F.pmod(F.xxhash64(key), F.col(f"n_{mine}"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)))
        return rows.select("q", "c", *df.columns)

    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("parameter_id", corpus.schema["parameter_id"].dataType), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)
    left = dealt(queries.select("query_id", "q_vec", "own_id"), "query_id", "q", "c").groupBy("q", "c")
    right = dealt(corpus.select("parameter_id", "c_vec"), "parameter_id", "c", "q").groupBy("q", "c")
    return dense_top_k(left.cogroup(right).applyInArrow(nearest.cell(k, digits, to_arrow_schema(schema)), schema), k, digits)


def retrieve_dense(mentions: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 10, threshold: float = 0.8, constrained: bool = True, digits: int | None = None, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Threshold and constraint apply after the cut at k; an empty list holds an explicit NIL.

    A mention without a vector is left out. digits: see dense_top_k; counted: see dense_nearest.
    """
    found = dense_nearest(queries.where("q_vec is not null"), corpus, k, digits, counted).where(F.col("score") >= threshold)
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "parameter_id", "score"))).alias("retrieved"))
    out = mentions.join(queries.where("q_vec is not null").select("query_id"), "query_id", "left_semi").join(lists, "query_id", "left")
    if constrained:
        out = out.withColumn("retrieved", F.filter("retrieved", lambda r: F.array_contains("subsetted_concepts", r["parameter_id"])))
    return judged(out, explicit_nil=True)


def retrieve_texts(mentions: DataFrame, feature: str, entries: DataFrame, load: Load = hashed, k: int = 10, threshold: float = 0.8, constrained: bool = True, digits: int | None = None) -> DataFrame:
    """retrieve_dense of texts, with the outcome of each mention.

    entries: (ord, parameter_id, text_feature). Both sides are embedded, each distinct text once; an entry's text
    stands for the last id that has it. mentions: `feature`, label and, if constrained, subsetted_concepts; one
    without a text is left out.
    """
    ids = entries.groupBy("text_feature").agg(F.max_by("parameter_id", "ord").alias("parameter_id"))
    corpus = embedded(ids, "text_feature", load, "c_vec").select("parameter_id", "c_vec")
    texts = mentions.where(F.col(feature).isNotNull()).select(F.col(feature).alias("query_id")).distinct()
    queries = embedded(texts, "query_id", load, "q_vec")
    found = retrieve_dense(mentions.withColumn("query_id", F.col(feature)), queries, corpus, k, threshold, constrained, digits, (texts, ids))
    return found.drop("query_id").withColumn("outcome", outcome())


def outcome(label: str = "label", pred: str = "top_pred", nil: Column | None = None) -> Column:
    """right; not_matched for a wrong NIL; incorrect for another wrong id. A row without a label is wrong.

    nil: see metrics.retrieval.
    """
    nil = F.col(pred) == rules.NIL if nil is None else nil
    return F.when(F.col(label) == F.col(pred), "right").when(nil, "not_matched").otherwise("incorrect")
