"""Narrowing the ontology by category and parameter patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import BOTH
from .ontology import llm_block, llm_entry

NO_IDS = "array<string>"


def matches(text: Column, table) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(BOTH + p), F.lit(c)) for c, p in table)))


def match_categories(tokens: Column, mention: Column, table=rules.CATEGORIES) -> Column:
    """Categories whose pattern the token string holds; only if there is none, those of the mention."""
    first = matches(tokens, table)
    return F.when(F.size(first) > 0, first).otherwise(matches(mention, table))


def hits(text: Column, table) -> Column:
    """Ids of the groups whose pattern the text holds."""
    none = F.array().cast(NO_IDS)
    return F.array_distinct(F.flatten(F.array(*(F.when(text.rlike(BOTH + p), F.array(*map(F.lit, ids))).otherwise(none) for p, ids in table))))


def match_parameters(tokens: Column, mention: Column, table=rules.PARAMETER_GROUPS) -> Column:
    """Parameter ids by pattern, with the same fall-through."""
    first = hits(tokens, table)
    return F.when(F.size(first) > 0, first).otherwise(hits(mention, table))


def prioritised(categories: Column, tiers=rules.PRIORITIES) -> Column:
    """The part of the first tier that the categories meet; all of them if they meet none."""
    out = F.array_sort(F.array_distinct(categories))
    for tier in reversed(tiers):
        level = F.array(*map(F.lit, tier))
        out = F.when(F.arrays_overlap(categories, level), F.array_sort(F.array_intersect(categories, level))).otherwise(out)
    return out


def with_subset(df: DataFrame, ontology: DataFrame, tokens: str, mention: str, categories=rules.CATEGORIES, parameters=rules.PARAMETER_GROUPS, tiers=rules.PRIORITIES) -> DataFrame:
    """df with categories, subsetted_concepts and subset_matched.

    Each pattern is tried once for a row: what it gives is a column before anything refers to it. The ids of the
    table's categories come as one row, a map by category; a row's ids are those of its categories.
    """
    df = df.withColumn("__said", matches(F.col(tokens), categories))
    other = F.col("__said") if tokens == mention else matches(F.col(mention), categories)
    df = df.withColumn("categories", F.when(F.size("__said") > 0, F.col("__said")).otherwise(other))
    df = df.withColumn("categories", prioritised(F.col("categories"), tiers))
    # likewise the parameters, which count where there is no category
    df = df.withColumn("__given", F.when(F.size("categories") == 0, hits(F.col(tokens), parameters)))
    if tokens != mention:
        df = df.withColumn("__given", F.when(F.size("__given") == 0, hits(F.col(mention), parameters)).otherwise(F.col("__given")))
    none = F.array().cast(NO_IDS)
    known = ontology.where(F.col("category_id").isin(*(c for c, _ in categories))).groupBy("category_id").agg(F.collect_set("parameter_id").alias("ids"))
    by_category = known.agg(F.map_from_entries(F.collect_list(F.struct("category_id", "ids"))).alias("__ids"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("categories", lambda c: F.coalesce(F.try_element_at("__ids", c), none)))))
    concepts = F.when(F.size("categories") > 0, ids).otherwise(F.array_sort("__given"))
    out = df.crossJoin(F.broadcast(by_category)).withColumn("subsetted_concepts", concepts)  # one row, as large as the ontology
    return out.withColumn("subset_matched", (F.size("categories") > 0) | (F.size("subsetted_concepts") > 0)).drop("__said", "__given", "__ids")


def with_ontology_text(df: DataFrame, ontology: DataFrame) -> DataFrame:
    """df with ontology_subset, the entries of its categories, else of its ids, in order; the whole ontology where none matched.

    The entries come as one row, a map by category and one by id, so that df is read once and its rows stay where
    they are: few sets occur, and a join on them would put most rows into a few tasks.
    """
    entries = ontology.select("category_id", "parameter_id", F.struct("ord", llm_entry().alias("entry")).alias("e"))

    def mapped(key: str, name: str) -> DataFrame:
        lists = entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list("e").alias("es"))
        return lists.agg(F.map_from_entries(F.collect_list(F.struct(key, "es"))).alias(name))

    known = mapped("category_id", "__by_category").crossJoin(mapped("parameter_id", "__by_id")).crossJoin(llm_block(ontology).select(F.col("ontology_subset").alias("__all")))
    out = df.crossJoin(F.broadcast(known))  # one row, as large as the ontology
    none = F.array().cast(known.schema["__by_id"].dataType.valueType)
    found = lambda keys, table: F.flatten(F.transform(keys, lambda x: F.coalesce(F.try_element_at(table, x), none)))
    picked = F.when(F.size("categories") > 0, found("categories", "__by_category")).when(F.size("categories") == 0, found("subsetted_concepts", "__by_id"))
    out = out.withColumn("__picked", picked)
    text = F.array_join(F.transform(F.array_sort("__picked"), lambda e: e["entry"]), "\n\n")
    text = F.when(F.size("__picked") > 0, text).otherwise(F.col("__all"))
    return out.withColumn("ontology_subset", text).drop("__picked", "__by_category", "__by_id", "__all")


def split_matched(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a subset, and the others, which have llm_pred NIL."""
    return df.where("subset_matched"), df.where("not subset_matched").withColumn("llm_pred", F.lit(rules.NIL))


def evaluate_subsets(df: DataFrame, categories: DataFrame, label: str = "label") -> DataFrame:
    """One row of accuracies and counts; shares of nothing are null (0 for the rates)."""
    size = categories.select(F.countDistinct("parameter_id").alias("__n"))
    cats = categories.select(F.col("parameter_id").alias(label), F.col("category_id").alias("__cat"))
    lists = df.select(F.array_join("subsetted_concepts", ",").alias("__s"), "subsetted_concepts").distinct()
    spread = lists.select("__s", F.explode("subsetted_concepts").alias(label)).join(cats, label, "left").groupBy("__s").agg(F.countDistinct(F.coalesce("__cat", F.lit(rules.NIL_CATEGORY))).alias("__kinds"))
    rows = df.withColumn("__s", F.array_join("subsetted_concepts", ",")).join(cats, label, "left").join(spread, "__s", "left")
    nil = F.coalesce((F.col(label) == rules.NIL) | (F.coalesce("__cat", F.lit(rules.NIL_CATEGORY)) == rules.NIL_CATEGORY), F.lit(True))
    n = F.size("subsetted_concepts")
    matched, hit = n > 0, F.coalesce(F.array_contains("subsetted_concepts", F.col(label)), F.lit(False))
    count = lambda c: F.count_if(c)
    out = rows.crossJoin(F.broadcast(size)).agg(
        F.count("*").alias("total"), count(matched).alias("matched"), count(~matched).alias("unmatched"),
        count(matched & ~nil & hit).alias("correct_matched"), count(~matched & nil).alias("correct_unmatched"),
        count(~nil).alias("total_non_nil"), count(nil).alias("total_nil"), count(matched & nil).alias("nil_with_subset"),
        count((n > 1) & (F.col("__kinds") > 1)).alias("multi_category"),
        (F.avg(F.when(n > 1, 1 - n / F.col("__n"))) * 100).alias("avg_reduction"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumns({
        "correct_total": F.col("correct_matched") + F.col("correct_unmatched"),
        "overall_accuracy": F.try_divide(F.col("correct_matched") + F.col("correct_unmatched"), F.col("total")),
        "matched_accuracy": rate("correct_matched", "matched"), "unmatched_accuracy": rate("correct_unmatched", "unmatched"),
        "subset_recall_non_nil": rate("correct_matched", "total_non_nil"), "nil_false_positive_rate": rate("nil_with_subset", "total_nil"),
    })
