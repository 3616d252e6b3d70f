"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import readers, sinks
from tallyforge.streaming import observed


def test_project_files(spark, tmp_path):
    for name, text in {"models/marts/a.sql": "select 1", "models/macros/b.sql": "x", "c.py": "y", "target/manifest.json": "{}", "d.yml": "z", "big.sql": "q" * 50}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files, skipped = readers.project_files(spark, str(tmp_path), most=20)
    got = {r.path.removeprefix(f"{tmp_path}/"): (r.kind, r.text) for r in files.collect()}
    assert got == {"models/marts/a.sql": ("dbt_sql_model", "select 1"), "models/macros/b.sql": ("sql", "x"), "c.py": ("python", "y"), "d.yml": ("dbt_yaml", "z")}
    assert [r.path.rsplit("/", 1)[1] for r in skipped.collect()] == ["big.sql"]
    assert {r.kind: r.n for r in readers.file_kinds(files).collect()} == {"dbt_sql_model": 1, "sql": 1, "python": 1, "dbt_yaml": 1}


def test_manifest_and_catalog(spark, tmp_path):
    node = {"resource_type": "model", "name": "a", "original_file_path": "models/a.sql", "config": {"materialized": "table", "unique_key": "id"}, "tags": ["x"], "depends_on": {"nodes": ["model.p.b"]}}
    (tmp_path / "m.json").write_text(json.dumps({"nodes": {"model.p.a": node, "test.p.t": {"resource_type": "test", "name": "t"}}}))
    models, edges = readers.manifest(spark, str(tmp_path / "m.json"))
    r = models.first()
    assert (r.model_id, r.path, r.materialized, r.unique_key, models.count()) == ("model.p.a", "models/a.sql", "table", "id", 1)
    assert [tuple(x) for x in edges.collect()] == [("model.p.a", "model.p.b")]
    (tmp_path / "c.json").write_text(json.dumps({"nodes": {"a": {"stats": {"num_bytes": 5, "row_count": 2}}}}))
    assert [tuple(x) for x in readers.catalog(spark, str(tmp_path / "c.json")).collect()] == [("a", 5.0, 2.0)]
    (tmp_path / "z.json").write_text(json.dumps({"nodes": {"a": {"stats": {"num_bytes": 0}}}, "sources": {}}))
    with pytest.raises(Exception, match="not positive"):
        readers.catalog(spark, str(tmp_path / "z.json")).collect()


def test_history_and_exports(spark, tmp_path):
    (tmp_path / "h.csv").write_text('model,bytes_billed,run_count\n"a, b",10,\nc,20,4\n')
    assert sorted(tuple(r) for r in readers.query_history(spark, str(tmp_path / "h.csv")).collect()) == [("a, b", 10.0, 30.0), ("c", 20.0, 4.0)]
    (tmp_path / "twice.csv").write_text("model,bytes_billed\na,1\na,2\n")
    with pytest.raises(Exception, match="repeated key"):
        readers.query_history(spark, str(tmp_path / "twice.csv")).collect()
    for name, body in {"rows.json": {"rows": [{"model": "a"}, {"model": "b"}]}, "array.json": [{"model": "a"}, {"model": "b"}]}.items():
        (tmp_path / name).write_text(json.dumps(body))
        assert readers.cost_export(spark, str(tmp_path / name)).select("model").count() == 2


def test_bundle(spark, tmp_path):
    o = {"model_id": "a", "window_start": "2024-01-01T00:00:00Z", "window_end": "2024-01-02T00:00:00Z", "executions": 3, "cost_usd": 1.5}
    (tmp_path / "o.json").write_text(json.dumps({"schema_version": 1, "currency": "USD", "observations": [o]}))
    r = readers.observations(spark, str(tmp_path / "o.json")).first()
    assert (r.model_id, r.executions, r.cost_usd, r.credits, str(r.window_end - r.window_start)) == ("a", 3, 1.5, None, "1 day, 0:00:00")


def test_owner_rules_and_sinks(spark):
    assert readers.owner_rules("# c\n*.sql @a @b\n/models/ @c\n") == [(0, "%%.sql", "@a"), (0, "%%.sql", "@b"), (2, "models/%", "@c")]
    rows = spark.createDataFrame([("R001", "high", "a,b.sql", None, "x\ny|z")], "rule string, severity string, path string, line int, message string")
    assert json.loads(sinks.as_sarif(rows).first().value)["level"] == "error"
    assert sinks.as_workflow_commands(rows).first().value == "::error file=a%2Cb.sql,line=1,title=R001::x%0Ay|z"
    assert sinks.as_markdown(rows).first().value == "high | R001 | a,b.sql |  | x y\\|z"
    assert json.loads(sinks.as_json(rows).first().value)["rule"] == "R001"


def test_daily_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 05:00:00", 1, 2.0, None), ("a", "2024-01-01 06:00:00", 2, 3.0, 1.0)], "model_id string, window_start string, executions long, bytes_processed double, cost_usd double").withColumn("window_start", F.to_timestamp("window_start"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = observed.daily(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    r = spark.table("daily").first()
    assert (r.model_id, r.executions, r.bytes, r.usd) == ("a", 3, 5.0, 1.0)
