"""Findings as text for other tools: one string column, so that any Spark writer can store it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: levels of annotation and report formats by severity.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def _level() -> Column:
    out = F.lit("none")
    for s, v in LEVELS.items():
        out = F.when(F.col("severity") == s, v).otherwise(out)
    return out


def as_json(findings: DataFrame) -> DataFrame:
    """A JSON object a finding."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


def as_sarif(findings: DataFrame) -> DataFrame:
    """A SARIF result a finding; `line` may be null."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), _level().alias("level"), F.struct(F.coalesce("message", F.lit("")).alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def _escaped(c: Column, more: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.replace(F.replace(out, F.lit(":"), F.lit("%3A")), F.lit(","), F.lit("%2C")) if more else out


def as_workflow_commands(findings: DataFrame) -> DataFrame:
    """Annotation commands of a hosted CI, a line a finding."""
    kind = F.when(_level() == "note", "notice").otherwise(_level())
    return findings.select(F.concat(F.lit("::"), kind, F.lit(" file="), _escaped(F.col("path"), True), F.lit(",line="), F.coalesce("line", F.lit(1)).cast("string"), F.lit(",title="), F.col("rule"), F.lit("::"), _escaped(F.coalesce("message", F.lit("")))).alias("value"))


def as_markdown(findings: DataFrame) -> DataFrame:
    """Table rows."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return findings.select(F.concat_ws(" | ", cell("severity"), cell("rule"), cell("path"), cell("line"), cell("message")).alias("value"))
