"""Cost exports: alias order, dotted names, forms of files, rejects; savings that are capped and discounts that are undone."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import attribution, costs
from tallyforge.sources import exports

WINDOW = {"start": "2024-01-01", "end": "2024-01-02"}


def _rows(spark, *rows):
    return exports.json_rows(spark.createDataFrame([(json.dumps(list(rows)),)], "text string"))[0]


def test_a_present_alias_is_not_replaced_by_a_later_one(spark):
    rows = [{"model_id": "a", "model": "b", **WINDOW, "bytes_processed": None, "bytes_scanned": 5, "executions": "x", "count": 4}, {"model": "b", **WINDOW, "bytes_scanned": " 7 ", "cost": 1.5, "execution_time_ms": 20}, {"model": 12, **WINDOW, "count": 2, "credits": {"x": 1}}]
    got = {r.model_id: (r.executions, r.bytes_processed, r.cost_usd, r.compute_seconds, r.credits) for r in exports.normalized(_rows(spark, *rows), "generic")[0].collect()}
    assert got == {"a": (1, None, None, None, None), "b": (1, 7.0, 1.5, 0.02, None), "12": (2, None, None, None, None)}


@pytest.mark.parametrize("format,row", [("bigquery", {"labels": {"model_id": "m"}, "model_id": "x"}), ("databricks", {"usage_metadata": {"job_name": "m"}}), ("snowflake", {"query_tag": "m", "model_id": "x"}), ("trino", {"source": "m"}), ("pipeline", {"dbt_model": "m"}), ("normalized", {"model_id": "m"}), ("generic", {"resource_name": "m"})])
def test_each_format_finds_its_model(spark, format, row):
    times = {"window_start": "2024-01-01T00:00:00+01:00", "window_end": "2024-01-01T12:00:00.5"}
    (r,) = exports.normalized(_rows(spark, row | times), format)[0].collect()
    assert (r.model_id, str(r.window_start), str(r.window_end)) == ("m", "2023-12-31 23:00:00", "2024-01-01 12:00:00.500000")


def test_rejects_name_their_problem(spark):
    rows = [WINDOW, {"model": " ", **WINDOW}, {"model": "a"}, {"model": "a", "start": "2024-01-02", "end": "2024-01-02"}, {"model": "a", **WINDOW, "count": 1.5}, {"model": "a", **WINDOW, "count": -1}, {"model": "a", **WINDOW, "credits": "-3"}, {"model": "a", **WINDOW, "cost": "NaN"}, {"model": "ok", **WINDOW}]
    kept, bad = exports.normalized(_rows(spark, *rows), "generic", spark.createDataFrame([("ok", "mapped")], "name string, model_id string"))
    assert [r.model_id for r in kept.collect()] == ["mapped"]
    assert sorted(r.problem for r in bad.collect()) == sorted(["no model"] * 2 + ["no window", "window ends before it starts"] + ["executions are no count"] * 2 + ["figure is negative or not finite"] * 2)


def test_forms_of_files(spark, tmp_path):
    one = {"model": "a", **WINDOW}
    for name, text in {"array.json": json.dumps([one, one]), "rows.json": json.dumps({"rows": [one]}), "object.json": json.dumps(one), "bundle.json": json.dumps({"observations": [one]}), "broken.json": "[{", "text.json": '"x"', "big.json": json.dumps([one | {"x": "y" * 3000}])}.items():
        (tmp_path / name).write_text(text)
    rows, rejects = exports.export_rows(spark, str(tmp_path), 2000)
    assert rows.count() == 5 and sorted(r.problem for r in rejects.collect()) == ["not an export in JSON"] * 2 + ["oversize"]
    (tmp_path / "t.csv").write_text('model_id,start,end,count\n"a,""b\nc",2024-01-01,2024-01-02,3\n')
    kept, _ = exports.normalized(exports.export_rows(spark, str(tmp_path / "t.csv"))[0], "generic")
    assert [(r.model_id, r.executions) for r in kept.collect()] == [('a,"b\nc', 3)]


def test_savings_are_capped_and_full_scans_undo_the_discount(spark):
    models = spark.createDataFrame([("i", "models/a/i.sql", "incremental", "id", None, None, 1e12), ("v", "models/a/v.sql", "view", None, "d", None, 1e12)], "model_id string, path string, materialized string, unique_key string, partition_by string, cluster_by string, prior_bytes double")
    none = lambda names: spark.createDataFrame([], names)
    seen, history, sizes = none("model_id string, monthly_executions double, monthly_bytes double, monthly_usd double"), none("model_id string, bytes_per_run double, runs_per_month double"), none("model_id string, num_bytes double, row_count double")
    volume = costs.volumes(models, seen, history, sizes, warehouse="bigquery", overrides=spark.createDataFrame([("v", 2.0)], "model_id string, runs_override double"))
    assert {r.model_id: (round(r.bytes), r.runs, r.discount) for r in volume.collect()} == {"i": (5 * 10**10, 30.0, 0.05), "v": (25 * 10**10, 2.0, 1.0)}
    price = costs.cost_index(volume, seen).join(volume.select("model_id", (F.col("bytes") * F.col("runs")).alias("scan_bytes"), "discount"), "model_id")
    found = spark.createDataFrame([("i", "R005", 1.0), ("i", "R001", 1.0), *[("v", "R012", 1.0)] * 9], "model_id string, rule string, structure double")
    fan = none("model_id string, downstream long, exposures long")
    own = {r.rule: r for r in attribution.attributed(found.where("model_id = 'i'"), price, fan, "bigquery").collect()}
    plain = {r.rule: r for r in attribution.attributed(found.where("model_id = 'i'"), price.drop("discount"), fan, "bigquery").collect()}
    assert own["R005"].savings_usd == pytest.approx(20 * plain["R005"].savings_usd) and own["R001"].savings_usd == pytest.approx(plain["R001"].savings_usd)
    many = attribution.attributed(found.where("model_id = 'v'"), price, fan, "bigquery")
    total = attribution.capped(many, "bigquery").agg(F.sum("savings_usd")).first()[0]
    cost = price.where("model_id = 'v'").select(F.exp("cost.mu")).first()[0]
    assert many.agg(F.sum("savings_usd")).first()[0] > cost > total and total == pytest.approx(cost - cost / 20)
