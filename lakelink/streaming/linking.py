"""Linking as a stream: the linkers keep no state, so a streaming mention source passes through unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import mention
from ..functions.text import pk_tokens
from ..operators.exact import link_exact


def link_stream(mentions: DataFrame, index: DataFrame, **how) -> DataFrame:
    """A streaming (or batch) DataFrame of mentions, linked; index is a batch DataFrame."""
    span = F.col("spans")[0]
    df = mentions.withColumn("mention", mention(F.col("text"), span["start"], span["end"])).withColumn("tokens", pk_tokens(F.col("mention")))
    return link_exact(df, index, **how)


def status_windows(results: DataFrame, time: str, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts by status in tumbling windows, late rows within the watermark included."""
    return results.withWatermark(time, delay).groupBy(F.window(time, width), "status").count()
