"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of source, language and topic. The cells' token weights are raked in turn to the
target shares of each margin, until no margin is off by more than `TOLERANCE`. Targets are given as shares by
value, or follow from the data: the share of tokens to the power `temper`. A cell's rate is its raked weight over
its tokens, scaled so that the sample has `share` of all tokens; rates over 1 are held at 1 and the rest is scaled
up again until none is over. (Cells at rate 1 hold less than their target: the sample then misses margins by what
these lack.) A document stays if the hash of its id, a number in [0, 1), is below its cell's rate.

Topics are SQL conditions; the default ones tell forms of text by measured shares. Null sources and languages
are values of their own, values without a target have weight 0; a null text has no tokens and the topic of an
empty one. Rows that repeat an id stay or go together; null ids share one number. Long texts count whole. If
nothing has tokens, or the table is empty, nothing is sampled. Columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

MARGINS = ("source", "lang", "topic")
#: Parameters: topics by form, the first that holds; each is a SQL condition on text and n, its words.
TOPICS = (
    ("brief", "n < 100"),
    ("numeric", "10 * (length(text) - length(translate(text, '0123456789', ''))) > n"),
    ("listed", "15 * (length(text) - length(replace(text, '\n', '')) + 1) > n"),
    ("long", "n >= 1000"),
)
REST = "prose"
ROUNDS, TOLERANCE, TEMPER, SHARE, SEED = 100, 1e-9, 0.7, 0.6, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
CELL_ROWS = 100_000
#: Cells that one task rakes; beyond it each margin shuffles them.
TASK_ROWS = 10_000


def topic(topics=TOPICS) -> Column:
    return F.expr("case " + " ".join(f"when {sql} then '{name}'" for name, sql in topics) + f" else '{REST}' end")


def described(docs: DataFrame, topics=TOPICS, columns: list[str] | None = None) -> DataFrame:
    """row (these columns), its cell (source, lang, topic) and tokens."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    row = F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.lit(None)
    out = docs.select(row.alias("row"), value("source").alias("source"), value("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("n", F.regexp_count("text", F.lit(WORD)).cast("long"))
    return out.select("row", "source", "lang", F.concat(F.lit("="), topic(topics)).alias("topic"), F.col("n").alias("tokens"))


def chance(seed: str, doc_id: Column) -> Column:
    """A number in [0, 1) from the id."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with w, raked to targets (value, share) of each margin.

    Each round is one plan over a written table, with a window's sum for each margin; up to `TASK_ROWS` cells stay
    in one partition, as a shuffle for each margin and round costs the driver more than the sums.
    """
    goals = [f"goal_{m}" for m in MARGINS]
    out = cells.withColumn("w", F.col("tokens").cast("double"))
    for m, goal in zip(MARGINS, goals, strict=True):
        out = out.join(targets[m].select(F.col("value").alias(m), F.col("share").alias(goal)), m, "left")
    out = stored(out.fillna(0.0, goals))
    few = out.count() <= TASK_ROWS
    for _ in range(rounds):
        step = out.coalesce(1) if few else out
        for m, goal in zip(MARGINS, goals, strict=True):
            now = F.sum("w").over(Window.partitionBy(m))
            step = step.withColumn("now", now).withColumn("w", F.when(F.col("now") > 0, F.col("w") * (F.col(goal) / F.col("now"))).otherwise(F.lit(0.0))).drop("now")
        out = stored(step)
        last = out.coalesce(1) if few else out
        # a value whose cells all have weight 0 cannot be raked
        off = [last.groupBy(m).agg(F.abs(F.sum("w") - F.max(goal)).alias("off"), F.sum("w").alias("w")).where("w > 0").agg(F.max("off").alias("off")) for m, goal in zip(MARGINS[:-1], goals, strict=False)]
        # read within the query: a local iterator outlasts it, while its shuffle files go with it
        if (off[0].unionByName(off[1]).agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return out.drop(*goals)


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """(value, share): token shares to the power, brought to 1."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("p"))
    total = sums.agg(F.sum("p").alias("all"))
    return sums.crossJoin(F.broadcast(total)).select("value", (F.col("p") / F.col("all")).alias("share"))  # one row


def given(spark, shares: dict[str, float]) -> DataFrame:
    total = sum(shares.values())
    return spark.createDataFrame([(f"={k}" if k is not None else "-", v / total) for k, v in shares.items()], "value string, share double")


def rates(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """cells with p, the probability of their documents."""
    total, weight = cells.agg(F.sum("tokens"), F.sum("w")).first()
    goal = share * (total or 0)
    scale = goal / weight if weight else 0.0
    full = -1
    while scale:
        over = F.col("w") * scale >= F.col("tokens")
        n, held, left = cells.where("w > 0").agg(F.count_if(over), F.sum(F.when(over, F.col("tokens")).otherwise(0)), F.sum(F.when(~over, F.col("w")).otherwise(0.0))).first()
        if n == full or not left:  # no further cell has come to its limit
            break
        full, scale = n, (goal - (held or 0)) / left
    return cells.withColumn("p", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("w") * F.lit(scale) / F.col("tokens"))).otherwise(F.lit(0.0)))


def plan(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, temper: float = TEMPER, topics=TOPICS) -> DataFrame:
    """Cells with tokens, docs, w (raked share) and p."""
    cells = stored(described(docs, topics).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    wanted = {m: given(docs.sparkSession, targets[m]) if targets and m in targets else tempered(cells.where("tokens > 0"), m, temper) for m in MARGINS}
    return stored(rates(rake(cells, wanted), share))


def apply(docs: DataFrame, cells: DataFrame, topics=TOPICS, seed: str = SEED) -> DataFrame:
    """row (all columns), source, lang, topic, tokens, w, p and sampled."""
    cells = cells.select(*MARGINS, "w", "p")
    out = described(docs, topics, docs.columns).join(small(cells, cells.count(), CELL_ROWS), [*MARGINS])
    return out.withColumn("sampled", chance(seed, F.col("row")["doc_id"]) < F.col("p"))


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, topic, n_tokens, cell_weight, probability and sampled for each row."""
    docs = docs.select("doc_id", "text", "source", "lang")
    out = apply(docs, plan(docs, **how))
    return out.select(F.col("row")["doc_id"].alias("doc_id"), F.expr("substring(topic, 2)").alias("topic"), F.col("tokens").alias("n_tokens"), F.round("w", 8).alias("cell_weight"), F.round("p", 8).alias("probability"), "sampled")


def sample(docs: DataFrame, **how) -> DataFrame:
    """The sampled documents, with their own columns."""
    return apply(docs, plan(docs, **how)).where("sampled").select(*(F.col("row")[c].alias(c) for c in docs.columns))
