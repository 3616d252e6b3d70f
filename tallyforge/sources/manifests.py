"""Compile manifests as relations: one parse of each object into VARIANT, typed extraction for each relation.

A manifest is parsed once and dealt out as (kind, id, node) rows, which are written; models, edges, macros, sources and
exposures read what they need from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.scratch import written

#: Largest manifest that is parsed: one JSON text is one value of a row.
MAX_BYTES = 512 << 20
SECTIONS = ("nodes", "sources", "macros", "exposures")


def manifest_texts(spark: SparkSession, path: str, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects): path and text of the manifests at path, and (path, reason) of those that are too large, never read."""
    raw = spark.read.format("binaryFile").load(path)
    small = raw.where(F.col("length") <= most).select("path", F.decode("content", "UTF-8").alias("text"))
    return small, raw.where(F.col("length") > most).select("path", F.lit("oversize").alias("reason"))


def manifest_objects(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, rejects): (path, kind, id, node VARIANT) of all sections, and (path, reason) of texts that are no JSON object."""
    spark = texts.sparkSession
    parsed = texts.select("path", F.try_parse_json("text").alias("v"))
    parts = [f"SELECT path, '{s}' AS kind, e.key AS id, e.value AS node FROM {{parsed}}, LATERAL variant_explode(try_variant_get(v, '$.{s}', 'variant')) AS e" for s in SECTIONS]
    objects = written(spark.sql(" UNION ALL ".join(parts), parsed=parsed), "manifest")
    broken = parsed.where(F.coalesce(~F.schema_of_variant("v").startswith("OBJECT"), F.lit(True))).select("path", F.lit("not a JSON object").alias("reason"))
    return objects, broken


def _text(*paths: str) -> Column:
    """The first of several members that is there, as text."""
    return F.coalesce(*[F.try_variant_get("node", p, "string") for p in paths])


def _strings(path: str) -> Column:
    return F.coalesce(F.try_variant_get("node", path, "array<string>"), F.array().cast("array<string>"))


def _joined(path: str) -> Column:
    """A text, or a list of texts by commas."""
    many = F.try_variant_get("node", path, "array<string>")
    return F.when(many.isNotNull(), F.array_join(many, ",")).otherwise(F.try_variant_get("node", path, "string"))


def models(objects: DataFrame) -> DataFrame:
    """A row for each model: identity, settings, refs, sources, tags, columns, checksum and compiled code (null if blank)."""
    own = objects.where("kind = 'nodes'").where(_text("$.resource_type") == "model")
    code = _text("$.compiled_code", "$.compiled_sql")
    pairs = F.try_variant_get("node", "$.sources", "array<array<string>>")
    refs = F.try_variant_get("node", "$.refs", "array<array<string>>")
    columns = F.map_keys(F.try_variant_get("node", "$.columns", "map<string,variant>"))
    config = {c: _joined(f"$.config.{c}") for c in ("materialized", "unique_key", "incremental_strategy", "partition_by", "cluster_by", "on_schema_change")}
    return own.select(
        "path", F.col("id").alias("model_id"), F.coalesce(_text("$.name"), "id").alias("name"), _text("$.package_name").alias("package"), _strings("$.fqn").alias("fqn"), _text("$.original_file_path", "$.path").alias("file"), _text("$.database").alias("database"), _text("$.schema").alias("schema"), _text("$.alias").alias("alias"),
        *[c.alias(k) for k, c in config.items()], F.try_variant_get("node", "$.config.full_refresh", "boolean").alias("full_refresh"), F.when(F.trim(code) != "", code).alias("compiled_code"), _strings("$.tags").alias("tags"), F.coalesce(_text("$.group"), _text("$.config.group")).alias("group"),
        F.coalesce(F.sort_array(columns), F.array().cast("array<string>")).alias("columns"), F.transform(F.filter(refs, lambda r: F.size(r) > 0), lambda r: F.element_at(r, -1)).alias("refs"), F.transform(F.filter(pairs, lambda r: F.size(r) > 1), lambda r: F.concat_ws(".", F.get(r, F.lit(0)), F.get(r, F.lit(1)))).alias("source_refs"),
        _text("$.checksum.name").alias("checksum_kind"), _text("$.checksum.checksum").alias("checksum"),
    )


def edges(objects: DataFrame) -> DataFrame:
    """(path, child, parent, kind): what models depend on, nodes and macros, and macros on macros."""
    model = (F.col("kind") == "nodes") & (_text("$.resource_type") == "model")
    on = lambda rows, member, kind: rows.select("path", F.col("id").alias("child"), F.explode(_strings(f"$.depends_on.{member}")).alias("parent"), F.lit(kind).alias("kind"))
    return on(objects.where(model), "nodes", "node").union(on(objects.where(model | (F.col("kind") == "macros")), "macros", "macro"))


def macros(objects: DataFrame) -> DataFrame:
    """(path, macro_id, name, file)"""
    return objects.where("kind = 'macros'").select("path", F.col("id").alias("macro_id"), F.coalesce(_text("$.name"), "id").alias("name"), _text("$.original_file_path", "$.path").alias("file"))


def sources(objects: DataFrame) -> DataFrame:
    """(path, source, table_name)"""
    return objects.where("kind = 'sources'").select("path", F.coalesce(_text("$.source_name", "$.name"), F.lit("")).alias("source"), F.coalesce(_text("$.name"), F.lit("")).alias("table_name"))


def exposures(objects: DataFrame) -> DataFrame:
    """(path, exposure, depends_on, owner) of those with a name."""
    own = objects.where("kind = 'exposures'").where(_text("$.name").isNotNull())
    return own.select("path", _text("$.name").alias("exposure"), _strings("$.depends_on.nodes").alias("depends_on"), _text("$.owner.name", "$.owner.email", "$.meta.owner", "$.config.meta.owner").alias("owner"))
