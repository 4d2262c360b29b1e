"""Stand-ins for mention sets and an ontology, made from the driver's tables, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach

#: The NIL id of queries over the stand-in ontology, where the usual one, Q100, may be the id of an entry.
NO_ENTRY = "NIL"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{d}/{name}.parquet")


def ontology(spark: SparkSession, d: str) -> DataFrame:
    """One entry for each part name; the category is its first word, the synonym its words reversed."""
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    one = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"), F.min("p_type").alias("units"), F.min("p_brand").alias("parameter_description"))
    return one.select("ord", F.concat(F.lit("G"), first).alias("category_id"), first.alias("parameter_category"), F.concat(F.lit("Q"), F.col("ord").cast("string")).alias("parameter_id"), F.col("p_name").alias("parameter_name"), F.array(F.concat(last, F.lit(" "), first)).alias("parameter_synonyms"), "parameter_description", "units")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """One mention for each line item: the part's name, by line number as it is, as an upper-case plural, with
    its words reversed, or without its last letter. The label is the ontology id."""
    ids = ontology(spark, d).select(F.col("parameter_name").alias("p_name"), F.col("parameter_id").alias("label"))
    parts = table(spark, d, "part").select("p_partkey", "p_name").join(ids, "p_name")
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    kind = F.col("l_linenumber") % 4
    noisy = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.concat(F.upper("p_name"), F.lit("S"))).when(kind == 2, F.concat(last, F.lit(" "), first)).otherwise(F.expr("left(p_name, length(p_name) - 1)"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return lines.join(parts, "p_partkey").select("l_orderkey", "l_linenumber", "l_quantity", "p_name", "label", noisy.alias("mention"))


ONTO = """onto AS (
  SELECT min(p_partkey) AS ord, 'G' || split_part(p_name, ' ', 1) AS category_id, split_part(p_name, ' ', 1) AS parameter_category,
         'Q' || min(p_partkey) AS parameter_id, p_name AS parameter_name, [split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)] AS parameter_synonyms,
         min(p_brand) AS parameter_description, min(p_type) AS units
  FROM part GROUP BY p_name)"""
MENT = """ment AS (
  SELECT l_orderkey, l_linenumber, l_quantity, p_name, parameter_id AS label,
         CASE l_linenumber % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || 'S'
              WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE left(p_name, length(p_name) - 1) END AS mention
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN onto ON p_name = parameter_name)"""


def toks(text: str) -> str:
    """SQL for the sorted token set of a mention."""
    return f"list_sort(list_distinct(string_split(regexp_replace(lower({text}), '([^s])s\\b', '\\1', 'g'), ' ')))"


def lcs(a: str, b: str) -> str:
    """SQL for the Indel ratio, by the rows of the subsequence table."""
    codes = lambda s: f"list_transform(string_split({s}, ''), lambda x: ascii(x))"
    inner = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN {codes(b)}[j[1]] = c[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], acc[-1]) END), [0::BIGINT])"
    return f"(200.0 * list_reduce(list_transform({codes(a)}, lambda x: [x::BIGINT]), lambda prev, c: {inner}, list_transform(range(0, length({b}) + 1), lambda j: 0::BIGINT))[-1] / (length({a}) + length({b})))"
