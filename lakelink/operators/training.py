"""Set operations on mention sets, and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, nulls included, do not occur in `gone`."""
    g = gone.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(g, cond, "left_anti")


def union_sources(**parts: DataFrame) -> DataFrame:
    """Bag union, each part with its source; missing columns are null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def partition_check(whole: DataFrame, removed: DataFrame, kept: DataFrame) -> DataFrame:
    """(n_all, n_removed, n_kept, ok): whether removal left as many as it should."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    out = n(whole, "n_all").crossJoin(n(removed, "n_removed")).crossJoin(n(kept, "n_kept"))  # one row each
    return out.withColumn("ok", F.col("n_kept") == F.col("n_all") - F.col("n_removed"))


def draw(*parts: Column) -> Column:
    """A reproducible draw: a whole number below 2^32 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def training_pairs(mentions: DataFrame, ontology: DataFrame, hard: int = 1, rand: int = 1, seed: str = "0", nil: str = rules.NIL) -> DataFrame:
    """(mention_id, mention, parameter_id, kind, label): one positive, hard negatives of the same category,
    random negatives of all; never the gold id, none twice; NIL mentions give none.

    Ids are ranked once in each category and once in all. The ids other than the gold one are cut into as many
    stretches of ranks as negatives are wanted, and one rank is drawn from each, so that mentions meet ids by an
    equi-join on the rank and never all of them. An id in several categories counts in the last.
    """
    ids = ontology.where("parameter_id is not null").groupBy("parameter_id").agg(F.max("category_id").alias("category_id"))
    gold = mentions.where(F.upper(F.trim(F.col("label").cast("string"))) != nil.upper()).select("mention_id", "mention", F.col("label").alias("gold"))
    positive = gold.select("mention_id", "mention", F.col("gold").alias("parameter_id"), F.lit("positive").alias("kind"), F.lit(1.0).alias("label"))

    def negatives(kind: str, n: int, rows: DataFrame, entries: DataFrame) -> DataFrame:
        seeded = F.lit(f"{seed}:{kind}")
        order = Window.partitionBy("pool").orderBy(draw(seeded, F.col("pool"), F.col("parameter_id")), "parameter_id")
        ranked = entries.select("pool", "parameter_id", (F.row_number().over(order) - 1).alias("rank"))
        sizes = ranked.groupBy("pool").agg(F.count("*").alias("size"))
        own = ranked.select("pool", F.col("parameter_id").alias("gold"), F.col("rank").alias("own"))
        rows = rows.join(sizes, "pool").join(own, ["pool", "gold"], "left")
        others = F.col("size") - F.when(F.col("own").isNotNull(), 1).otherwise(0)
        rows = rows.withColumns({"others": others, "take": F.least(others, F.lit(n))}).where("take > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)))
        low, high = F.expr("j * others div take"), F.expr("(j + 1) * others div take")
        place = low + draw(seeded, F.col("mention_id"), F.col("j")) % (high - low)
        rank = place + F.when(place >= F.col("own"), 1).otherwise(0)
        drawn = rows.select("mention_id", "mention", "pool", rank.alias("rank")).join(ranked, ["pool", "rank"])
        return drawn.select("mention_id", "mention", "parameter_id", F.lit(kind).alias("kind"), F.lit(0.0).alias("label"))

    keyed = gold.join(ids.select(F.col("parameter_id").alias("gold"), F.col("category_id").alias("pool")), "gold")
    alike = negatives("hard", hard, keyed, ids.select(F.col("category_id").alias("pool"), "parameter_id"))
    every = negatives("random", rand, gold.withColumn("pool", F.lit("")), ids.select(F.lit("").alias("pool"), "parameter_id"))
    return positive.unionByName(alike).unionByName(every)


def evaluation_inputs(mentions: DataFrame, entries: DataFrame, nil: str = rules.NIL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a retrieval evaluator takes: queries (query_id, text), corpus (parameter_id, text) and relevant
    (query_id, parameter_id) pairs, none for mentions without a label or with NIL."""
    query_id = F.concat(F.lit("mention_"), F.col("mention_id").cast("string")).alias("query_id")
    queries = mentions.select(query_id, F.col("mention").alias("text"))
    relevant = mentions.where(F.col("label") != nil).select(query_id, F.col("label").alias("parameter_id"))
    return queries, entries.select("parameter_id", F.col("text_feature").alias("text")), relevant
