"""Queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, neardup, pii, pst, quality, secrets, substring, toxicity
from .common import read, remainder

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = remainder("doc_id", 4)
    model = langid.fit(docs.where((rest != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull()))
    return langid.identify(docs.select("doc_id", "text"), model, [F.col("doc_id"), F.coalesce(rest == 2, F.lit(False)).alias("held_out")])


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"), [F.col("doc_id")])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rest = remainder("doc_id", 5)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), rest != 0)
    out = toxicity.score(docs, model, [F.col("doc_id"), F.coalesce(rest == 0, F.lit(False)).alias("held_out")])
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"), [F.col("doc_id")])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(read(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return decontam.digest(decontam.scan(docs, read(spark, sf_dir, "benchmark"), [F.col("doc_id")]))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rest = remainder("doc_id", 5)
    return pst.score(docs, docs.where(rest != 1), [F.col("doc_id"), F.coalesce(rest == 1, F.lit(False)).alias("held_out")])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language_id, op2_pii_spans, op3_toxicity, op4_secret_scan, op5_source_mixing, op6_near_duplicates, op7_decontamination, op8_substring_dedup, op9_suffix_tree_lm, op10_quality_rules)}

# --- SQL equivalents, where SQL can express a query ---

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ALNUM = rf"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: What the unrolled SQL does; the operator goes on until it has settled.
SQL_ROUNDS, SQL_LEVELS = 12, 8


def mixing_sql() -> str:
    """The raking unrolled: each step divides by a window's sum."""
    share = f"pow(sum(tokens)::DOUBLE, {mixing.TEMPER})"
    steps = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '-') AS source, coalesce('=' || lang, '-') AS lang, CASE {' '.join(f"WHEN {sql} THEN '{name}'" for name, sql in mixing.TOPICS)} ELSE '{mixing.REST}' END AS topic, n AS tok FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text, len({WORDS}) AS n FROM documents))",
        "c AS (SELECT source, lang, topic, sum(tok) AS tokens FROM d GROUP BY ALL)",
        *(f"t_{m} AS (SELECT {m}, {share} / sum({share}) OVER () AS share FROM c WHERE tokens > 0 GROUP BY {m})" for m in mixing.MARGINS),
        "w0 AS (SELECT *, tokens::DOUBLE AS w FROM c)",
    ]
    n = 0
    for _ in range(SQL_ROUNDS):
        for m in mixing.MARGINS:
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * (coalesce(share, 0) / sum(w) OVER (PARTITION BY {m})) ELSE 0 END AS w FROM w{n} LEFT JOIN t_{m} USING ({m}))")
            n += 1
    steps.append(f"s0 AS (SELECT *, {mixing.SHARE} * sum(tokens) OVER () AS goal, {mixing.SHARE} * sum(tokens) OVER () / sum(w) OVER () AS scale FROM w{n})")
    for k in range(SQL_LEVELS):
        left = "sum(CASE WHEN w > 0 AND w * scale < tokens THEN w ELSE 0 END) OVER ()"
        full = "sum(CASE WHEN w > 0 AND w * scale >= tokens THEN tokens ELSE 0 END) OVER ()"
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w, goal, CASE WHEN {left} > 0 THEN (goal - {full}) / {left} ELSE scale END AS scale FROM s{k})")
    return f"""WITH {', '.join(steps)},
p AS (SELECT source, lang, topic, w, CASE WHEN tokens > 0 THEN least(1.0, w * scale / tokens) ELSE 0 END AS p FROM s{SQL_LEVELS})
SELECT doc_id, topic, tok AS n_tokens, round(w, 8) AS cell_weight, round(p, 8) AS probability, ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT / {1 << 52}::DOUBLE < p AS sampled FROM d JOIN p USING (source, lang, topic)"""


ORACLES: dict[str, str] = {
    "op5_source_mixing": mixing_sql(),
    "op7_decontamination": f"""WITH w AS (SELECT doc_id, {ALNUM} AS ws FROM documents), items AS (SELECT item_id::VARCHAR AS item, {ALNUM} AS ws FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT DISTINCT item, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(2, len(ws) - 8)), lambda i: array_to_string(ws[i:i + 9], ' '))) AS win FROM items WHERE len(ws) > 0),
d AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM b) WHERE len(ws) >= n),
h AS (SELECT doc_id, i, d.n, item FROM d JOIN b ON d.n = b.n AND array_to_string(ws[i:i + d.n - 1], ' ') = win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op8_substring_dedup": f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
one AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS k FROM one ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, (SELECT count(*) FROM gone WHERE gone.r = w.r) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)""",
}
