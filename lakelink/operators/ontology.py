"""The ontology side: lookups, texts and the token index.

Ontologies have some hundred rows. No broadcast is forced: Spark measures the side and picks the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import token_key


def parameter_names(ontology: DataFrame, include_nil: bool = False) -> DataFrame:
    """(parameter_id, parameter_name)."""
    out = ontology.where("parameter_id <> '' and parameter_name <> ''").select("parameter_id", "parameter_name").distinct()
    return out.unionByName(out.sparkSession.createDataFrame([(rules.NIL, "NIL")], "parameter_id string, parameter_name string")) if include_nil else out


def category_names(ontology: DataFrame) -> DataFrame:
    return ontology.where("category_id <> '' and parameter_category <> ''").select("category_id", "parameter_category").distinct()


def parameter_categories(ontology: DataFrame) -> DataFrame:
    return ontology.where("parameter_id <> '' and category_id <> ''").select("parameter_id", "category_id").distinct()


def _or_na(col: str) -> Column:
    return F.coalesce(F.when(F.col(col) != "", F.col(col)), F.lit("N/A"))


def llm_entry() -> Column:
    """An entry's five tagged lines; lines after the first are indented by eight spaces."""
    synonyms = F.array_join("parameter_synonyms", " | ")
    lines = F.concat(F.lit("[PARAM_NAME] "), F.col("parameter_name")), F.concat(F.lit("[DESC] "), _or_na("parameter_description")), F.concat(F.lit("[SYN] "), F.coalesce(F.when(synonyms != "", synonyms), F.lit("N/A"))), F.concat(F.lit("[UNIT] "), _or_na("units")), F.concat(F.lit("[CATEGORY] "), _or_na("parameter_category"))
    return F.concat_ws("\n        ", *lines)


def llm_block(ontology: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ontology_subset: the entries in order, joined by a blank line; one row, or one for each value of `by`."""
    entries = F.array_sort(F.collect_list(F.struct("ord", llm_entry().alias("entry"))))
    return ontology.groupBy(*(by or [])).agg(F.array_join(F.transform(entries, lambda e: e["entry"]), "\n\n").alias("ontology_subset"))


def embedding_feature(include_description: bool = True, include_units: bool = True) -> Column:
    """[PARAM] name [SYN] a | b [DESC] ... [UNIT] ..., without the parts that are empty."""
    value = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    part = lambda mark, v: F.when(v != "", F.concat(F.lit(mark + " "), v))
    synonyms = F.array_join(F.transform("parameter_synonyms", lambda s: F.trim(s)), " | ")
    parts = [F.concat(F.lit("[PARAM] "), value("parameter_name")), part("[SYN]", synonyms)]
    if include_description:
        parts.append(part("[DESC]", value("parameter_description")))
    if include_units:
        parts.append(part("[UNIT]", value("units")))
    return F.concat_ws(" ", *parts)


def for_embedding(ontology: DataFrame, include_description: bool = True, include_units: bool = True, nil: str = rules.NIL) -> DataFrame:
    """(parameter_id, text_feature) with lower-cased names; of equal texts the last counts."""
    texts = ontology.where(F.col("parameter_id") != nil).withColumn("parameter_name", F.lower("parameter_name"))
    texts = texts.select("ord", "parameter_id", embedding_feature(include_description, include_units).alias("text_feature"))
    return texts.groupBy("text_feature").agg(F.max_by("parameter_id", "ord").alias("parameter_id")).select("parameter_id", "text_feature")


def token_index(ontology: DataFrame, build: Callable[[Column], Column], ordered: bool = False) -> DataFrame:
    """(token_key, tokens, param_ids): ids of all names and synonyms with the token set, in ontology order.

    ordered adds `ord`, the place of the token set by its first variant.
    """
    names = F.concat(F.array("parameter_name"), F.filter("parameter_synonyms", lambda s: s != ""))
    variants = ontology.select("ord", "parameter_id", F.posexplode(names).alias("pos", "variant"))
    keyed = variants.withColumn("tokens", build(F.col("variant"))).withColumn("token_key", token_key(F.col("tokens")))
    once = keyed.groupBy("token_key", "parameter_id").agg(F.min("ord").alias("ord"), F.min(F.struct("ord", "pos")).alias("at"), F.first("tokens").alias("tokens"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "parameter_id"))), lambda x: x["parameter_id"])
    out = once.groupBy("token_key").agg(F.array_sort(F.array_distinct(F.first("tokens"))).alias("tokens"), ids.alias("param_ids"), F.min("at").alias("at"))
    if ordered:
        out = out.withColumn("ord", F.row_number().over(Window.orderBy("at")) - 1)  # the ontology is a fixed list
    return out.drop("at")
