"""Readers and writers: mentions as JSON lines, ontologies as CSV, summaries as appended JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import NIL, NIL_CATEGORY

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

MENTION = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("label", T.StringType()), T.StructField("source", T.StringType()),
])
TABLE_MENTION = T.StructType([
    *MENTION.fields, T.StructField("table_html", T.StringType()), T.StructField("row_idx", T.IntegerType()), T.StructField("col_idx", T.IntegerType()),
    T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("caption", T.StringType()), T.StructField("footer", T.StringType()),
])
ONTOLOGY = T.StructType([T.StructField(c, T.StringType()) for c in ("category_id", "parameter_category", "parameter_id", "parameter_name", "parameter_synonyms", "parameter_description", "units")])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = MENTION) -> DataFrame:
    """One record a line; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def parse_synonyms(col: Column) -> Column:
    """A bracketed list literal, or comma-separated text, as an array; anything else is empty.

    A comma before the closing bracket is allowed. A list that does not parse is empty.
    """
    text = F.trim(col)
    listed = F.from_json(F.regexp_replace(text, r",\s*\]$", "]"), "array<string>", {"allowSingleQuotes": "true"})
    parts = F.transform(F.filter(F.split(text, ","), lambda s: s != ""), lambda s: F.trim(s))
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(text.rlike(r"(?s)^\[.*\]$"), listed).when(text == "", none).otherwise(parts), none)


def read_ontology_csv(spark: SparkSession, path: str) -> DataFrame:
    """The raw records, in file order (`ord`)."""
    raw = spark.read.schema(ONTOLOGY).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return raw.withColumn("ord", F.monotonically_increasing_id())


def load_ontology(spark: SparkSession, path: str, remove_nil: bool = True) -> DataFrame:
    """Synonyms parsed, text trimmed and never null; without the NIL entry unless asked for."""
    df = read_ontology_csv(spark, path).withColumn("parameter_synonyms", parse_synonyms(F.col("parameter_synonyms")))
    df = df.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("parameter_category", "parameter_name", "parameter_description", "units")})
    # rows without an id stay: only what is known to be the NIL entry goes
    return df.where(~F.col("parameter_id").eqNullSafe(NIL) & ~F.col("category_id").eqNullSafe(NIL_CATEGORY)) if remove_nil else df


def scalar_series(df: DataFrame, run: str, tag: str) -> DataFrame:
    """(step, value) of a run and tag from (run, tag, step, value) rows; empty where the tag is missing."""
    return df.where((F.col("run") == run) & (F.col("tag") == tag)).select("step", "value")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by an explicit order."""
    return df.orderBy(*order).limit(n)
