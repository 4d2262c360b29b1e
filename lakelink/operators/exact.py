"""Exact linking: exclusions, token-set lookup, disambiguation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import BOTH, preprocess, token_key

STATUSES = ("excluded", "linked", "disambiguated", "multi", "unlinked")


def is_excluded(mention: Column, patterns=rules.EXCLUDED) -> Column:
    """Whether the mention says something that is no parameter."""
    return F.lower(mention).rlike(BOTH + "|".join(f"(?:{p})" for p in patterns))


def in_invalid_context(text: Column, start: Column, end: Column, window: int = 15) -> Column:
    """Whether the mention stands, within the window, before or after what makes it another thing."""
    low = F.lower(text)
    word = F.substring(low, start + 1, end - start)
    begin = F.greatest(start - window, F.lit(0))
    near = F.substring(low, begin + 1, end + window - begin)
    quoted = F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit(BOTH), quoted, F.lit(r"[\s\-_/:]*(?:mic|pharmacodynamic|creatinine|cr)|"), quoted, F.lit(r"/fe|m\s*\+\s*"), quoted)
    # the pattern is the mention's own and is compiled for each row: only where one fixed pattern says it could match
    return F.coalesce(near.rlike(BOTH + r"mic|pharmacodynamic|cr|/fe|m\s*\+") & F.regexp_like(near, pattern), F.lit(False))


def context_ids(text: Column, contexts) -> Column:
    """Ids whose pattern the text holds, in table order."""
    return F.array_compact(F.array(*(F.when(text.rlike(BOTH + p), F.lit(i)) for i, p in contexts)))


def disambiguate(ids: Column, text: Column, resolve_km_default: bool = False) -> Column:
    """Struct (param_id, candidates): one id where the context settles it, else what is left.

    `text` is preprocessed. Without any context Km candidates stay open as ["Q1"], or become Q1 with
    resolve_km_default; half-lives become Q57. Other ambiguities stay as they are.
    """
    km, half = context_ids(text, rules.KM_CONTEXTS), context_ids(text, rules.HALF_LIFE_CONTEXTS)
    none, no_ids = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    settled = lambda i: F.struct(i.alias("param_id"), no_ids.alias("candidates"))
    still = lambda c: F.struct(none.alias("param_id"), c.alias("candidates"))
    km_none = settled(F.lit("Q1")) if resolve_km_default else still(F.array(F.lit("Q1")))
    return (
        F.when(F.array_contains(ids, "Q1"), F.when(F.size(km) == 1, settled(F.get(km, 0))).when(F.size(km) > 1, still(km)).otherwise(km_none))
        .when(F.array_contains(ids, "Q57"), F.when(F.size(half) == 1, settled(F.get(half, 0))).when(F.size(half) > 1, still(half)).otherwise(settled(F.lit("Q57"))))
        .otherwise(still(ids))
    )


def link_exact(mentions: DataFrame, index: DataFrame, table_mentions: bool = False, resolve_km_default: bool = False) -> DataFrame:
    """mentions (text, spans, mention, tokens) with status, y_pred and potential_candidates.

    A token set that two or more parameters share is "multi" when the context leaves several of the known
    alternatives, "unlinked" when nothing can be said of it.
    """
    start, end = F.col("spans")[0]["start"], F.col("spans")[0]["end"]
    found = mentions.withColumn("__key", token_key(F.col("tokens"))).join(index.select(F.col("token_key").alias("__key"), "param_ids"), "__key", "left")
    excluded = F.coalesce(is_excluded(F.col("mention")), F.lit(False)) | in_invalid_context(F.col("text"), start, end)
    n = F.coalesce(F.size("param_ids"), F.lit(0))
    found = found.withColumn("__n", F.when(excluded, -1).otherwise(F.greatest(n, F.lit(0))))
    # a column of its own, so that the rules run once for a text, and only where they are needed
    found = found.withColumn("__said", F.when(F.col("__n") > 1, F.col("text"))).withColumn("__said", preprocess(F.col("__said")))
    found = found.withColumn("__d", F.when(F.col("__n") > 1, disambiguate(F.col("param_ids"), F.col("__said"), resolve_km_default)))
    n, d, ids = F.col("__n"), F.col("__d"), F.col("param_ids")
    default = F.lit(table_mentions) & F.array_contains(ids, "Q57")
    known = F.array_contains(ids, "Q1") | F.array_contains(ids, "Q57")
    status = F.when(n < 0, "excluded").when(n == 0, "unlinked").when((n == 1) | default, "linked").when(d["param_id"].isNotNull(), "disambiguated").when(known, "multi").otherwise("unlinked")
    pred = F.when(n == 1, F.get(ids, 0)).when((n > 1) & default, F.lit("Q57")).when((n > 1) & d["param_id"].isNotNull(), d["param_id"]).otherwise(F.lit(rules.NIL))
    open_ = F.when((n > 1) & ~default & d["param_id"].isNull(), d["candidates"])
    # an explode of one element: a filter on a result would else go below the rules, with a copy of them for each mention of it
    found = found.withColumn("__r", F.explode(F.array(F.struct(status.alias("status"), pred.alias("y_pred"), open_.alias("potential_candidates")))))
    return found.withColumns({c: F.col(f"__r.{c}") for c in ("status", "y_pred", "potential_candidates")}).drop("__key", "__n", "__said", "__d", "__r", "param_ids")


def linked(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin("excluded", "linked", "disambiguated"))


def unlinked(results: DataFrame) -> DataFrame:
    """Rows for the next linker."""
    return results.where(F.col("status").isin("multi", "unlinked"))


def status_counts(results: DataFrame) -> DataFrame:
    """(status, n, pct)."""
    n = results.groupBy("status").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("status", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))  # one row
