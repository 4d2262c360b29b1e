"""Prompt-based linking: prompts and parsing are columns, only the model call is Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

#: Price of 1000 prompt and 1000 completion tokens by model.
PRICES = {"gpt-4o": (0.0025, 0.01), "gpt-4o-mini": (0.00015, 0.0006), "gpt-4.1": (0.002, 0.008), "gpt-4.1-mini": (0.0004, 0.0016), "gpt-4.1-nano": (0.0001, 0.0004)}

SYSTEM = "You link mentions of measured quantities to one entry of an ontology. Answer with {param: NAME}, where NAME is an entry's name as given, or with {param: NIL} if no entry fits."
SYSTEM_STEPS = SYSTEM + " First settle which category the mention belongs to, then compare the entries of that category, then answer."
SENTENCE_EXAMPLES = "Mention: The [MENTION]half-life[/MENTION] was 4 h.\nAnswer: {param: t1/2}\n\nMention: [MENTION]MIC[/MENTION] of 2 mg/l.\nAnswer: {param: NIL}"
TABLE_EXAMPLES = "Mention: [MENTION]CL/F (l/h)[/MENTION]\n[ROW] | [MENTION]CL/F (l/h)[/MENTION] | 12.3 |\nAnswer: {param: CL/F}"


def _section(title: str, body: Column, gap: str = "\n") -> Column:
    return F.concat(F.lit(f"\n---\n{title}:\n{gap[1:]}"), body, F.lit("\n---\n"))


def user_prompt(mention: Column, ontology: Column, context: Column | None = None, examples: Column | None = None) -> Column:
    """Mention, Context and Task Examples where there are any, Ontology; trimmed."""
    maybe = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", _section(title, c)).otherwise("") if c is not None else F.lit("")
    whole = F.concat(_section("Mention", mention), maybe("Context", context), maybe("Task Examples", examples), _section("Ontology", ontology, "\n\n"))
    return F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")


def parsed(response: Column) -> Column:
    """The name in `{param: NAME}`, lower-cased and trimmed."""
    text = F.replace(response, F.lit("param:"))
    text = F.regexp_replace(text, r"^[{}]+|[{}]+$", "")
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def grounded(df: DataFrame, names: DataFrame, response: str = "response", nil: str = rules.NIL) -> DataFrame:
    """df with llm_pred (NIL without a usable answer) and no_answer."""
    known = names.groupBy(F.lower(F.trim("parameter_name")).alias("__a")).agg(F.max("parameter_id").alias("__id"))
    df = df.withColumn("__a", parsed(F.col(response))).join(known, "__a", "left")
    said = F.when(F.col("__a").isin("nil", "n/a", "none"), F.lit(nil)).otherwise(F.col("__id"))
    return df.withColumns({"llm_pred": F.coalesce(said, F.lit(nil)), "no_answer": said.isNull()}).drop("__a", "__id")


Client = Callable[[Sequence[str]], Sequence[str]]


def answered(df: DataFrame, client: Client, model: str, prompt: str = "prompt") -> DataFrame:
    """df with response: the client is called with batches of prompts, in Python workers."""
    if not model:
        raise ValueError("a model is needed")
    if "gpt" not in model.lower():
        raise ValueError(f"model {model} is not supported")
    from pyspark.sql import types as T

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(response=list(client(frame[prompt].tolist())))

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("response", T.StringType())]))


def with_unmatched(answers: DataFrame, unmatched: DataFrame, label: str = "label") -> DataFrame:
    """(y_true, y_pred) of answered rows and of those that were never asked."""
    take = lambda d: d.select(F.col(label).alias("y_true"), F.col("llm_pred").alias("y_pred"))
    return take(answers).unionByName(take(unmatched))


def count_tokens(text: Column) -> Column:
    """A counter that needs no vocabulary: runs of non-space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def cost(df: DataFrame, model: str, tokens: Column, completion: int = 7) -> DataFrame:
    """One row: examples, average tokens (two digits), average, per-thousand and total cost (six digits)."""
    if model not in PRICES:
        raise ValueError(f"unsupported model: {model}")
    price_in, price_out = PRICES[model]
    each = F.col("__t") / 1000 * price_in + F.lit(completion / 1000 * price_out)
    out = df.select(tokens.alias("__t")).agg(F.count("*").alias("total_examples"), F.round(F.avg("__t"), 2).alias("average_prompt_tokens"), F.round(F.avg(each), 6).alias("average_cost"), F.round(F.sum(each), 6).alias("total_cost"))
    return out.withColumn("cost_per_1000", F.round(F.col("average_cost") * 1000, 6)).withColumn("model", F.lit(model))
