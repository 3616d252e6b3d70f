"""Readers: project files, compile manifests, catalogs, query history, observation bundles, cost exports, ownership rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FILE_BYTES = 5 * 1024 * 1024
#: Fixed list: directories that are never scanned.
SKIPPED = ".git target dbt_packages node_modules .venv venv __pycache__ logs".split()


def kind_of(path: Column) -> Column:
    """manifest_json, dbt_sql_model, sql, dbt_yaml, python or other, by the first rule that holds."""
    p = F.lower(path)
    return (
        F.when(p.endswith("manifest.json"), "manifest_json")
        .when(p.endswith(".sql") & p.contains("models/") & ~p.contains("/macros/"), "dbt_sql_model")
        .when(p.endswith(".sql"), "sql")
        .when(p.endswith(".yml") | p.endswith(".yaml"), "dbt_yaml")
        .when(p.endswith(".py"), "python")
        .otherwise("other")
    )


def project_files(spark: SparkSession, root: str, most: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): path, kind, text of the files below root; path and reason of those that are too large."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = raw.select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content").where(~F.col("path").rlike("/(" + "|".join(d.replace(".", r"\.") for d in SKIPPED) + ")/"))
    files = rows.where(F.col("bytes") <= most).select("path", kind_of(F.col("path")).alias("kind"), F.decode("content", "UTF-8").alias("text"), "bytes", "modified")
    return files, rows.where(F.col("bytes") > most).select("path", F.lit("oversize").alias("reason"))


def file_kinds(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("n"))


_CONFIG = "materialized STRING, unique_key STRING, incremental_strategy STRING, partition_by STRING, cluster_by STRING, full_refresh BOOLEAN, on_schema_change STRING"
_NODE = f"STRUCT<resource_type: STRING, name: STRING, package_name: STRING, original_file_path: STRING, database: STRING, schema: STRING, alias: STRING, config: STRUCT<{_CONFIG.replace(' STRING', ': STRING').replace(' BOOLEAN', ': BOOLEAN')}>, compiled_code: STRING, tags: ARRAY<STRING>, depends_on: STRUCT<nodes: ARRAY<STRING>>, checksum: STRUCT<name: STRING, checksum: STRING>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one object of a JSON file by an explicit schema; no inference, whatever its size."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(models, edges) of a compile manifest."""
    nodes = _json(spark, path, f"nodes MAP<STRING, {_NODE}>").select(F.explode("j.nodes").alias("model_id", "n"))
    models = nodes.where("n.resource_type = 'model'").select("model_id", "n.name", F.col("n.original_file_path").alias("path"), "n.config.*", "n.compiled_code", "n.tags", "n.checksum.checksum")
    edges = nodes.select(F.col("model_id").alias("child"), F.explode("n.depends_on.nodes").alias("parent"))
    return models, edges


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, num_bytes, row_count) of nodes and sources; a figure of zero or less stops the read."""
    stats = "MAP<STRING, STRUCT<stats: STRUCT<num_bytes: DOUBLE, row_count: DOUBLE>>>"
    j = _json(spark, path, f"nodes {stats}, sources {stats}")
    rows = j.select(F.explode(F.map_concat(F.coalesce("j.nodes", F.create_map().cast(T.MapType(T.StringType(), T.StructType([T.StructField("stats", T.StructType([T.StructField("num_bytes", T.DoubleType()), T.StructField("row_count", T.DoubleType())]))])))), F.coalesce("j.sources", F.create_map().cast(T.MapType(T.StringType(), T.StructType([T.StructField("stats", T.StructType([T.StructField("num_bytes", T.DoubleType()), T.StructField("row_count", T.DoubleType())]))])))))).alias("model_id", "s"))
    check = lambda c: F.when(F.col(c) <= 0, F.raise_error(F.concat(F.lit(f"{c} is not positive for "), "model_id")).cast("double")).otherwise(F.col(c))
    return rows.select("model_id", "s.stats.*").select("model_id", check("num_bytes").alias("num_bytes"), check("row_count").alias("row_count"))


def _aliased(df: DataFrame, names: list[str]) -> Column | None:
    held = {c.strip().lower(): c for c in df.columns}
    return next((F.col(f"`{held[n]}`") for n in names if n in held), None)


def query_history(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, bytes_per_run, runs_per_month) of a CSV export; runs are 30 where absent, and repeated keys an error."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    runs = _aliased(df, ["runs_per_month", "run_count"])
    rows = df.select(_aliased(df, ["model_or_table", "model", "table"]).alias("model_id"), _aliased(df, ["bytes_per_run", "bytes_billed"]).cast("double").alias("bytes_per_run"), F.coalesce(runs.try_cast("double") if runs is not None else F.lit(None).cast("double"), F.lit(30.0)).alias("runs_per_month"))
    by = rows.groupBy("model_id").agg(F.count("*").alias("n"), F.first("bytes_per_run").alias("bytes_per_run"), F.first("runs_per_month").alias("runs_per_month"))
    return by.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated key "), "model_id")).cast("string")).otherwise(F.col("model_id")).alias("model_id"), "bytes_per_run", "runs_per_month")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """The observations of a bundle (JSON, version 1), with times as UTC timestamps."""
    row = "STRUCT<model_id: STRING, window_start: STRING, window_end: STRING, executions: BIGINT, bytes_processed: DOUBLE, compute_seconds: DOUBLE, credits: DOUBLE, cost_usd: DOUBLE>"
    j = _json(spark, path, f"schema_version INT, currency STRING, observations ARRAY<{row}>")
    ok = (F.col("j.schema_version") == 1) & (F.coalesce("j.currency", F.lit("USD")) == "USD")
    rows = j.select(F.explode(F.when(ok, F.col("j.observations")).otherwise(F.raise_error(F.lit("not a version 1 bundle in USD")).cast(f"ARRAY<{row}>"))).alias("o")).select("o.*")
    return rows.withColumn("window_start", F.to_timestamp("window_start")).withColumn("window_end", F.to_timestamp("window_end"))


def cost_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a vendor's export as they are: CSV, a JSON array, an object with `rows`, or one object."""
    if path.lower().endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = spark.read.json(path, multiLine=True)
    return df.select(F.explode("rows").alias("r")).select("r.*") if df.columns == ["rows"] else df


def owner_rules(text: str) -> list[tuple[int, str, str]]:
    """(ord, LIKE pattern, owner) of an ownership file's text, one owner a row; later rules win."""
    out = []
    for line in text.splitlines():
        pattern, *owners = line.split("#")[0].split() or [""]
        if pattern and owners:
            like = pattern.replace("%", r"\%").replace("_", r"\_").replace("**", "%").replace("*", "%").replace("?", "_")
            like = like[1:] if pattern.startswith("/") else "%" + like
            like += "%" if pattern.endswith("/") else ""
            out += [(len(out), like, o) for o in owners]
    return out
