"""Cost exports of warehouses and schedulers as observations: rows as VARIANT, the first alias that a row has.

An alias that is there counts even where its value is null or cannot be read, so a later one never stands in for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest JSON export, which is one value of a row.
MAX_BYTES = 512 << 20
#: Fixed by the formats: the names that a field goes by, in the order in which they are tried; dots lead into objects.
COMMON = {
    "model": ["model_id", "model", "query_tag", "job_name", "resource_name"],
    "start": ["window_start", "start_time", "start", "usage_start_time"],
    "end": ["window_end", "end_time", "end", "usage_end_time"],
    "executions": ["executions", "execution_count", "query_count", "count"],
    "bytes": ["bytes_processed", "bytes_scanned", "bytes_billed", "total_bytes_billed"],
    "seconds": ["compute_seconds", "execution_seconds", "total_cpu_time_seconds"],
    "milliseconds": ["execution_time_ms", "total_slot_ms", "wall_time_ms"],
    "credits": ["credits", "credits_used", "credits_used_compute", "usage_quantity"],
    "usd": ["cost_usd", "usd_cost", "cost", "list_cost"],
}
#: Fixed by the formats: where one has other names.
FORMATS: dict[str, dict[str, list[str]]] = {
    "normalized": {"model": ["model_id"], "executions": ["executions"], "bytes": ["bytes_processed"], "seconds": ["compute_seconds"], "milliseconds": [], "credits": ["credits"], "usd": ["cost_usd"]},
    "generic": {},
    "snowflake": {"model": ["query_tag", "model_id", "model"]},
    "bigquery": {"model": ["labels.model_id", "model_id", "job_id"]},
    "databricks": {"model": ["usage_metadata.job_name", "job_name", "model_id"]},
    "trino": {"model": ["model_id", "query_id", "source"]},
    "pipeline": {
        "model": ["model_id", "model", "relation", "relation_name", "asset_key", "asset", "asset_name", "dbt_model", "dbt_model_id", "resource_name"],
        "executions": ["executions", "run_count", "materialization_count", "execution_count", "count"],
        "seconds": ["compute_seconds", "duration_seconds", "elapsed_seconds", "execution_seconds", "total_cpu_time_seconds"],
        "milliseconds": ["duration_ms", "duration_milliseconds", "elapsed_ms", "execution_time_ms", "wall_time_ms"],
    },
}


def json_rows(texts: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row VARIANT) of JSON texts, and (text, problem) of those that are none: an array, an object with `rows`, or one object.

    The rows of a bundle (`observations`) count too.
    """
    parsed = texts.select(F.col(column).alias("text"), F.try_parse_json(column).alias("v"))
    held = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in ("rows", "observations")], F.col("v").try_cast("array<variant>"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    rows = parsed.select(F.explode(F.when(held.isNotNull(), held).when(is_object, F.array("v"))).alias("row"))
    broken = parsed.where(F.coalesce(held.isNull() & ~is_object, F.lit(True)))
    return rows, broken.select("text", F.lit("not an export in JSON").alias("problem"))


def csv_rows(table: DataFrame) -> DataFrame:
    """(row VARIANT) of a table of text columns."""
    return table.select(F.to_variant_object(F.struct(*[F.col(f"`{c}`").cast("string").alias(c.strip()) for c in table.columns])).alias("row"))


def export_rows(spark: SparkSession, path: str, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(row VARIANT) and rejects (text, problem) of the exports at path: CSV by its name, else JSON; too large ones are not read."""
    if path.lower().endswith(".csv"):
        return csv_rows(spark.read.csv(path, header=True, multiLine=True, escape='"')), spark.createDataFrame([], "text string, problem string")
    raw = spark.read.format("binaryFile").load(path)
    rows, broken = json_rows(raw.where(F.col("length") <= most).select(F.decode("content", "UTF-8").alias("text")))
    return rows, broken.union(raw.where(F.col("length") > most).select("path", F.lit("oversize")))


def _held(names: list[str]) -> Column:
    """The value of the first name that the row has, a JSON null included."""
    found = [F.try_variant_get("row", "$" + "".join(f"['{part}']" for part in n.split(".")), "variant") for n in names]
    return F.coalesce(*found, F.lit(None).cast("variant"))


def _text(names: list[str]) -> Column:
    value, kind = _held(names), F.schema_of_variant(_held(names))
    text = F.when(kind.rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), value.try_cast("string"))
    return F.when(F.trim(text) != "", text)


def _number(names: list[str]) -> Column:
    value, kind = _held(names), F.schema_of_variant(_held(names))
    return F.when(kind == "STRING", F.trim(value.try_cast("string")).try_cast("double")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), value.try_cast("double"))


def normalized(rows: DataFrame, format: str, mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects) of rows (row VARIANT) in one of FORMATS; times without a zone are UTC where the session's zone is.

    mapping: (name, model_id) for names that are not those of models. rejects: (row as JSON text, problem): no model, no or a
    broken window, executions that are no whole number from 0 on, or a figure that is negative or not finite.
    """
    names = COMMON | FORMATS[format]
    executions, seconds = F.coalesce(_number(names["executions"]), F.lit(1.0)), _number(names["seconds"])
    if names["milliseconds"]:
        seconds = F.coalesce(seconds, _number(names["milliseconds"]) / 1000)
    at = lambda field: F.try_to_timestamp(_text(names[field]))
    out = rows.select("row", _text(names["model"]).alias("model_id"), at("start").alias("window_start"), at("end").alias("window_end"), executions.alias("executions"), _number(names["bytes"]).alias("bytes_processed"), seconds.alias("compute_seconds"), _number(names["credits"]).alias("credits"), _number(names["usd"]).alias("cost_usd"))
    if mapping is not None:
        out = out.join(mapping.select(F.col("name").alias("_name"), F.col("model_id").alias("_model")), F.col("model_id") == F.col("_name"), "left").withColumn("model_id", F.coalesce("_model", "model_id")).drop("_name", "_model")
    bad = lambda c: F.coalesce(F.isnan(c) | (F.col(c) < 0) | (F.col(c) == float("inf")), F.lit(False))
    figures = bad("bytes_processed") | bad("compute_seconds") | bad("credits") | bad("cost_usd")
    problem = (
        F.when(F.col("model_id").isNull(), "no model").when(F.col("window_start").isNull() | F.col("window_end").isNull(), "no window").when(F.col("window_end") <= F.col("window_start"), "window ends before it starts")
        .when(bad("executions") | (F.col("executions") != F.floor("executions")), "executions are no count").when(figures, "figure is negative or not finite")
    )
    out = out.withColumn("problem", problem)
    kept = out.where("problem is null").drop("row", "problem").withColumn("executions", F.col("executions").cast("long"))
    return kept, out.where("problem is not null").select(F.to_json("row").alias("row"), "problem")
