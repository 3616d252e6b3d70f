"""One relation of all that a comparison looks at: both sides, targets and context, raw or compiled text.

Rules run once over the union; what a finding means (a target's or only context's, new or known, excepted or not) is told
by columns that travel with the file.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import governance, rules
from tallyforge.operators.evaluation import SEVERITY_RANK
from tallyforge.sources.scratch import written

KEEP = ("side", "is_target", "input")


def united(targets: DataFrame, context: DataFrame) -> DataFrame:
    """(path, text, side, is_target): files of both, one row for each side and path; where both have it, the target's."""
    own = lambda df, flag: df.select("path", "text", "side", F.lit(flag).alias("is_target"))
    both = own(targets, True).union(own(context, False))
    return both.groupBy("path", "side").agg(F.max_by(F.struct("text", "is_target"), F.struct("is_target", "text")).alias("f")).select("path", "f.text", "side", "f.is_target")


def assembled(files: DataFrame, models: DataFrame) -> DataFrame:
    """files (`united`) with model_id, settings and `input`: compiled where the side's model has compiled code, else raw.

    models: (path, side, model_id, compiled_code, settings as in rules.SETTINGS). Files without a model keep their path as
    model_id and null settings; of several models of a path and side, the least id counts.
    """
    settings = [c for c in rules.SETTINGS if c in models.columns]
    one = models.groupBy("path", "side").agg(F.min_by(F.struct("model_id", "compiled_code", *settings), "model_id").alias("m"))
    rows = files.join(one, ["path", "side"], "left")
    compiled = F.coalesce(F.trim("m.compiled_code") != "", F.lit(False))
    return rows.select("path", "side", "is_target", F.coalesce("m.model_id", "path").alias("model_id"), F.when(compiled, F.col("m.compiled_code")).otherwise(F.col("text")).alias("text"), F.when(compiled, "compiled").otherwise("raw").alias("input"), *[f"m.{c}" for c in settings])


def judged(snapshot: DataFrame, platform: str = "generic") -> DataFrame:
    """The located findings of a snapshot in one pass over all sides, with `severity_rank` and the columns in KEEP; written, since many look at them.

    A file that sides have alike, path and settings too, is judged once for all of them.
    """
    rank = F.create_map(*[F.lit(x) for x in chain(*SEVERITY_RANK.items())])
    alike = snapshot.groupBy(*[c for c in snapshot.columns if c != "side"]).agg(F.collect_list("side").alias("sides"))
    found = rules.located(rules.features(alike), platform, ("sides", *[c for c in KEEP if c != "side"]))
    found = found.select(*[c for c in found.columns if c not in ("sides", *KEEP)], F.explode("sides").alias("side"), *[c for c in KEEP if c != "side"])
    return written(found.withColumn("severity_rank", rank[F.col("severity")]), "judged")


def targets_only(found: DataFrame) -> DataFrame:
    return found.where("is_target")


def context_warnings(found: DataFrame) -> DataFrame:
    """(path, rule, n): what was found on the head side in files that are only context."""
    return found.where("not is_target and side = 'head'").groupBy("path", "rule").agg(F.count("*").alias("n"))


def delta(found: DataFrame, excepted: Column | None = None, savings: Column | None = None) -> DataFrame:
    """(finding_id, status) of the targets' findings, base against head; excepted ones are on neither side."""
    rows = targets_only(found) if excepted is None else targets_only(found).where(~F.coalesce(excepted, F.lit(False)))
    rows = rows.select("side", "finding_id", F.col("severity_rank").alias("severity"), (savings if savings is not None else F.lit(0.0)).alias("savings")).groupBy("side", "finding_id").agg(F.max("severity").alias("severity"), F.max("savings").alias("savings"))
    return governance.delta(rows.where("side = 'base'"), rows.where("side = 'head'"))
