"""Classification and retrieval metrics, coverage and distributions, as one-pass aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules


def named(df: DataFrame, names: DataFrame, *cols: str) -> DataFrame:
    """Ids by name where there is one."""
    for c in cols:
        look = names.select(F.col("parameter_id").alias(c), F.col("parameter_name").alias("__n"))
        df = df.join(look, c, "left").withColumn(c, F.coalesce("__n", c)).drop("__n")
    return df


def confusion(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))


def classification(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by: tuple[str, ...] = ()) -> DataFrame:
    """mic_p, mic_r, mic_f1, mac_f1, accuracy and n; one row for each value of `by`.

    Each row has one label and one prediction, so micro precision, recall, F1 and accuracy are equal. Macro
    F1 is the mean over labels in either column; a label without hits has 0. Rows shrink to the confusion
    table before anything else.
    """
    return scores(confusion(df, true, pred, by), by)


def scores(c: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The figures of classification() from a confusion table (by, y_true, y_pred, n)."""
    keys = [F.col(b) for b in by]
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = c.select(*keys, F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), hit.alias("tp")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("tp")))).alias("s"))
    labels = sides.groupBy(*keys, "s.label").agg(F.sum("s.support").alias("support"), F.sum("s.said").alias("said"), F.sum("s.tp").alias("tp"))
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("said"))
    out = labels.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"), F.avg(f1).alias("mac_f1"))
    acc = F.try_divide(F.col("tp"), F.col("n"))
    return out.select(*keys, acc.alias("mic_p"), acc.alias("mic_r"), acc.alias("mic_f1"), "mac_f1", acc.alias("accuracy"), "n")


def matched_metrics(df: DataFrame, matched: Column, true: str = "label", pred: str = "top_pred") -> DataFrame:
    """The figures of classification() and matched_pct for three parts: combined, matched and unmatched rows.

    matched_pct is the share of the part in all rows, per cent. A part without rows has n 0, a share of 0 and no
    other figures; so have all three if there are no rows.
    """
    part = F.when(F.coalesce(matched, F.lit(False)), "matched").otherwise("unmatched")
    cells = df.groupBy(part.alias("part"), F.col(true).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))
    cells = cells.withColumn("part", F.explode(F.array(F.lit("combined"), F.col("part")))).groupBy("part", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    parts = df.sparkSession.createDataFrame([("combined",), ("matched",), ("unmatched",)], "part string")
    out = parts.join(scores(cells, ("part",)), "part", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.max("n").over(Window.partitionBy(F.lit(0)))  # three rows; all of df are in "combined"
    return out.withColumn("matched_pct", F.coalesce(F.try_divide(F.col("n") * 100.0, whole), F.lit(0.0)))


def percent(col: Column) -> Column:
    """As shown: 87.50%."""
    return F.format_string("%.2f%%", col * 100)


def normalised_confusion(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Row shares, with the labels' places: by name, NIL last."""
    c = confusion(df, true, pred)
    share = F.col("n") / F.sum("n").over(Window.partitionBy("y_true"))
    place = lambda x: F.when(F.col(x) == "NIL", 1).otherwise(0)
    return c.withColumns({"share": share, "true_last": place("y_true"), "pred_last": place("y_pred")})


def errors(df: DataFrame, order: list[str], n: int = 100, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """The first n wrong rows by an explicit order."""
    return df.where(~F.col(true).eqNullSafe(F.col(pred))).orderBy(*order).limit(n)


def reciprocal_rank(ids: Column, gold: Column) -> Column:
    at = F.coalesce(F.array_position(ids, gold), F.lit(0))
    return F.when(at > 0, 1 / at).otherwise(0.0)


def retrieval(df: DataFrame, by: tuple[str, ...] = (), label: str = "label", nil: Column | None = None) -> DataFrame:
    """mrr, recall_at_k, micro_f1, nil_count, nil_prop (per cent, two digits) and n from retrieved and top_pred.

    nil: what counts as a prediction of NIL, by default its id; for ontologies with an entry of that id.
    """
    rr = reciprocal_rank(F.transform("retrieved", lambda r: r["parameter_id"]), F.col(label))
    nil = F.count_if(F.col("top_pred") == rules.NIL if nil is None else nil)
    return df.withColumn("__rr", F.coalesce(rr, F.lit(0.0))).groupBy(*by).agg(
        F.avg("__rr").alias("mrr"), F.avg((F.col("__rr") > 0).cast("double")).alias("recall_at_k"), F.avg((F.col("top_pred") == F.col(label)).cast("double")).alias("micro_f1"),
        nil.alias("nil_count"), F.round(nil * 100.0 / F.count("*"), 2).alias("nil_prop"), F.count("*").alias("n"),
    )


def run_summary(runs: DataFrame, by: str = "run") -> DataFrame:
    """Mean and population deviation of micro F1 over runs, and the mean number matched, cut to a whole one."""
    return runs.agg(F.avg("mic_f1").alias("mean_f1"), F.stddev_pop("mic_f1").alias("std_f1"), F.floor(F.avg("n")).alias("mean_matched"), F.countDistinct(by).alias("runs"))


def runs_by_source(answers: DataFrame, run: str = "run", true: str = "label", pred: str = "llm_pred") -> DataFrame:
    """One row for each source and one, "all", for all rows: mean and population deviation of micro F1 over runs,
    and the mean number of rows with an answer, cut to a whole one.

    Rows without a source have the source "unknown". One label and one prediction a row: micro F1 is the share of hits.
    """
    hits = F.count_if(F.coalesce(F.col(true) == F.col(pred), F.lit(False)))
    cells = answers.groupBy(F.col(run).alias("run"), F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), hits.alias("hits"), F.count_if(~F.col("no_answer")).alias("answered"))
    cells = cells.withColumn("source", F.explode(F.array(F.lit("all"), F.col("source"))))
    runs = cells.groupBy("run", "source").agg((F.sum("hits") / F.sum("n")).alias("f1"), F.sum("answered").alias("answered"))
    return runs.groupBy("source").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.floor(F.avg("answered")).alias("mean_matched"), F.count("*").alias("runs"))


def coverage(labels: DataFrame, ontology: DataFrame) -> DataFrame:
    """How many ontology ids occur as labels."""
    used = labels.where("label is not null").select(F.col("label").alias("parameter_id")).distinct()
    ids = ontology.select("parameter_id").distinct().join(used.withColumn("__u", F.lit(1)), "parameter_id", "left")
    return ids.agg(F.count("__u").alias("covered"), F.count("*").alias("total")).withColumn("coverage_pct", F.try_divide(F.col("covered") * 100.0, F.col("total")))


def coverage_by_category(labels: DataFrame, ontology: DataFrame, nil: bool = True) -> DataFrame:
    """Coverage of each category; NIL is one of its own."""
    ids = ontology.select("parameter_category", "parameter_id").distinct()
    if nil:
        ids = ids.unionByName(ids.sparkSession.createDataFrame([("NIL", rules.NIL)], "parameter_category string, parameter_id string"))
    used = labels.where("label is not null").select(F.col("label").alias("parameter_id")).distinct().withColumn("__u", F.lit(1))
    out = ids.join(used, "parameter_id", "left").groupBy("parameter_category").agg(F.count("__u").alias("covered"), F.count("*").alias("total"))
    return out.withColumn("coverage_pct", F.col("covered") * 100.0 / F.col("total"))


def label_stats(labels: DataFrame, label: str = rules.NIL) -> DataFrame:
    n = F.count_if(F.coalesce(F.col("label") == label, F.lit(False)))
    return labels.agg(n.alias("n"), F.round(F.coalesce(F.try_divide(n * 100.0, F.count("*")), F.lit(0.0)), 2).alias("pct"))


def analysis(labels: DataFrame, ontology: DataFrame) -> DataFrame:
    """Per category: coverage, share of labels, counts by parameter. Labels outside stay in the denominator."""
    counts = labels.where("label is not null").groupBy(F.col("label").alias("parameter_id")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    ids = ontology.select("parameter_category", "parameter_id").distinct().join(counts, "parameter_id", "left")
    out = ids.groupBy("parameter_category").agg(F.count("n").alias("covered"), F.count("*").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("labels"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("parameter_id", "n"))))).alias("parameter_counts"))
    return out.crossJoin(F.broadcast(total)).select("parameter_category", (F.col("covered") * 100.0 / F.col("total")).alias("coverage_pct"), F.try_divide(F.col("labels") * 100.0, F.col("all")).alias("distribution_pct"), "parameter_counts")  # one row


def distribution(labels: DataFrame, ontology: DataFrame, nil: str = rules.NIL) -> DataFrame:
    """Counts of all ontology ids, zero included, without NIL."""
    counts = labels.groupBy(F.col("label").alias("parameter_id")).agg(F.count("*").alias("n"))
    return ontology.select("parameter_id").distinct().where(F.col("parameter_id") != nil).join(counts, "parameter_id", "left").select("parameter_id", F.coalesce("n", F.lit(0)).alias("n"))


def frequency_by_category(labels: DataFrame, ontology: DataFrame) -> DataFrame:
    ids = ontology.select("parameter_category", F.col("parameter_id").alias("label"), "parameter_name").distinct()
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    return counts.join(ids, "label").groupBy("parameter_category", "parameter_name").agg(F.sum("n").alias("n"))


def split_stats(labels: DataFrame, ontology: DataFrame) -> DataFrame:
    """Size and coverage of each split, and of all together."""
    ids = ontology.select(F.col("parameter_id").alias("label")).distinct().withColumn("__in", F.col("label"))
    total = ids.agg(F.count("*").alias("__t"))
    counts = labels.groupBy("split", "label").agg(F.count("*").alias("n")).join(ids, "label", "left")
    out = counts.rollup("split").agg(F.sum("n").alias("n"), F.countDistinct("__in").alias("covered"))
    return out.crossJoin(F.broadcast(total)).select(F.coalesce("split", F.lit("all")).alias("split"), "n", "covered", (F.col("covered") * 100.0 / F.col("__t")).alias("coverage_pct"))  # one row


def moving_average(df: DataFrame, by: str, order: str, value: str, alpha: float = 0.1) -> DataFrame:
    """Exponential moving average seeded with the first value: (by, step, order, value, ema), step from 0.

    The average is a weighted sum of the values so far. Windows over blocks of steps give each block's own part
    of it; what came before a block is the own part at the end of the last one, and that of the one before, which
    weighs 1e-100 or less by then: what is older does not show in a double. Equal orders go by value, rows without
    a value are left out.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha has to be over 0 and at most 1")
    keep = 1 - alpha
    length = max(1, int(-100 * math.log(10) / math.log(keep))) if keep else 1
    step = F.row_number().over(Window.partitionBy(by).orderBy(order, value)) - 1
    rows = df.where(F.col(value).isNotNull()).select(by, order, value, step.alias("step"))
    at = F.col("step") % length
    rows = rows.withColumns({"__block": F.floor(F.col("step") / length), "__x": F.when(F.col("step") == 0, F.col(value)).otherwise(F.col(value) * alpha)})
    upto = Window.partitionBy(by, "__block").orderBy("step")
    later = F.sum(F.when(at > 0, F.col("__x") / F.pow(F.lit(keep), at))).over(upto)
    own = F.pow(F.lit(keep), at) * (F.first("__x").over(upto) + F.coalesce(later, F.lit(0.0)))
    rows = rows.withColumn("__own", own if keep else F.col("__x"))
    ends = rows.where(at == length - 1).select(by, (F.col("__block") + 1).alias("__block"), F.col("__own").alias("__end"))
    before = Window.partitionBy(by).orderBy("__block")
    carried = F.col("__end") + F.lit(keep**length) * F.coalesce(F.lag("__end").over(before), F.lit(0.0))
    # `before` orders the ends of blocks only, one row for each block
    carry = ends.select(F.col(by).alias("__by"), F.col("__block").alias("__next"), carried.alias("__carry"))
    rows = rows.join(carry, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__block") == F.col("__next")), "left")
    ema = F.col("__own") + F.coalesce(F.pow(F.lit(keep), at + 1) * F.col("__carry"), F.lit(0.0))
    return rows.select(by, "step", order, value, ema.alias("ema"))


def selected(log: DataFrame, model: str | None = None, max_step: int | None = None) -> DataFrame:
    """The rows of a model's log up to a step; either may be left out. Rows without a step are not up to any."""
    if model is not None:
        log = log.where(F.col("model") == model)
    return log.where(F.col("step") <= max_step) if max_step is not None else log


def run_record(results: DataFrame, **settings) -> DataFrame:
    """One row for a run: a time stamp, its settings as text, and `results`, the metrics of each source by name."""
    values = F.struct(*(F.col(c) for c in results.columns if c != "source"))
    one = results.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", values.alias("metrics"))))).alias("results"))  # a row for each source
    return one.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *(F.lit(str(v)).alias(k) for k, v in settings.items()), "results")


def threshold_curve(log: DataFrame, by: list[str]) -> DataFrame:
    """Points of each curve, by threshold."""
    return log.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("threshold", "value"))).alias("points"))
