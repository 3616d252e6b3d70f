"""Observations as a stream: daily costs of models with a bound on lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(observations: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, model_id, executions, bytes, usd) by windows of a day; state older than `late` is dropped. Works on streams
    and on finished tables alike."""
    rows = observations.withWatermark("window_start", late)
    by = rows.groupBy(F.window("window_start", "1 day").alias("w"), "model_id").agg(F.sum("executions").alias("executions"), F.sum("bytes_processed").alias("bytes"), F.sum("cost_usd").alias("usd"))
    return by.select(F.col("w.start").alias("day"), "model_id", "executions", "bytes", "usd")


def first_sightings(findings: DataFrame, late: str = "30 days") -> DataFrame:
    """A stream of findings without those seen before within `late` (finding_id, seen_at, others)."""
    return findings.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["finding_id"])
