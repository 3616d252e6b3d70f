"""Baselines of accepted findings as a table that is merged bucket by bucket.

A finding lies in the bucket of its id's hash. A merge rewrites the buckets that its findings touch and no others, by
dynamic partition overwrite; a merge that is run again after a lost job changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.scratch import written

BUCKETS = 64
#: Fixed by the format of baselines.
VERSION, SCHEME = 3, "semantic-v1"
ROW = "finding_id string, rule string, path string, platform string, policy_digest string, version int, identity_scheme string, bucket int"


def rows_of(findings: DataFrame, platform: str, policy_digest: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Findings (finding_id, rule, path) as rows of a baseline, one for each id: that with the least path, then rule."""
    known = findings.where("finding_id is not null and finding_id <> ''")
    one = known.groupBy("finding_id").agg(F.min(F.struct("path", "rule")).alias("m")).select("finding_id", "m.rule", F.translate("m.path", "\\", "/").alias("path"))
    fixed = {"platform": F.lit(platform), "policy_digest": F.lit(policy_digest).cast("string"), "version": F.lit(VERSION), "identity_scheme": F.lit(SCHEME)}
    return one.withColumns(fixed | {"bucket": F.pmod(F.xxhash64("finding_id"), F.lit(buckets)).cast("int")})


def _put(rows: DataFrame, path: str) -> None:
    """Replaces the buckets that rows have, and leaves all others."""
    rows.repartition("bucket").sortWithinPartitions("path", "rule", "finding_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_baseline(findings: DataFrame, path: str, platform: str, policy_digest: str | None = None) -> None:
    """A new baseline in place of what is at path."""
    rows_of(findings, platform, policy_digest).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


def read_baseline(spark: SparkSession, path: str, platform: str | None = None) -> DataFrame:
    """The rows of a baseline. Another version, scheme or platform, or a row without an id, stops the read."""
    wrong = F.when(F.col("version") != VERSION, "version").when(F.col("identity_scheme") != SCHEME, "identity scheme").when(F.coalesce(F.col("finding_id"), F.lit("")) == "", "finding id")
    wrong = wrong if platform is None else wrong.when(F.col("platform") != platform, "platform")
    rows = spark.read.schema(ROW).parquet(path)
    return rows.withColumn("version", F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("baseline: unsupported "), wrong)).cast("int")).otherwise(F.col("version")))


def merge_baseline(findings: DataFrame, path: str, platform: str, policy_digest: str | None = None) -> None:
    """Adds findings to the baseline at path; of equal ids the least path, then rule, stays. Only touched buckets are read and written."""
    spark = findings.sparkSession
    new = written(rows_of(findings, platform, policy_digest), "new-baseline")
    touched = new.select("bucket").distinct()  # at most BUCKETS rows
    held = read_baseline(spark, path, platform).join(F.broadcast(touched), "bucket", "left_semi")
    both = rows_of(new.select("finding_id", "rule", "path").union(held.select("finding_id", "rule", "path")), platform, policy_digest)
    _put(written(both, "merged-baseline"), path)  # written apart first: a table is not read and replaced in one job
