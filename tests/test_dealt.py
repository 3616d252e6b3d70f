"""Texts that come from one small file are judged by many tasks, each once, and what a task holds does not grow with the input."""

import pytest

from tallyforge.operators import governance, snapshot
from tallyforge.plans.project import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["join_keys", "fan_out_joins", "hidden_join_keys", "owners", "owner_summary", "more_rule_findings_trino", "more_rule_findings", "folder_inheritance", "settings_findings", "settings_entities", "inline_settings", "places_behind_templates", "finding_ids", "located_findings"])
def test_texts_are_dealt(spark, name):
    df = QUERIES[name](spark, SF)
    below = _plan(df).split("RepartitionByExpression")
    assert len(below) > 1
    assert "zip_with" not in below[-1] and "regexp_extract_all" not in below[-1]  # nothing is judged before rows are dealt


def _owners(spark):
    files = spark.createDataFrame([("a/x.sql",), ("a/x.sql",), ("b/y.sql",), ("c",), (None,)], "path string")
    rules = spark.createDataFrame([(1, "a/%", "@a"), (2, "%.sql", "@sql"), (3, "b/%", None), (None, "%", "@never"), (4, None, "@none")], "ord int, pattern string, owner string")
    return governance.owned(files, rules)


def test_the_last_matching_rule_owns(spark):
    assert {r.path: r.owner for r in _owners(spark).collect()} == {"a/x.sql": "@sql", "b/y.sql": None, "c": None, None: None}
    assert _owners(spark).count() == 4


def test_no_row_is_made_for_a_match(spark):
    plan = _owners(spark)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "max_by" not in plan


def test_what_sides_have_alike_is_judged_once(spark, monkeypatch):
    rows, judge = [], snapshot.rules.features
    monkeypatch.setattr(snapshot.rules, "features", lambda files: rows.append(files.count()) or judge(files))
    files = [("m.sql", "select * from t", s, True, "m", "raw") for s in ("base", "head")] + [("n.sql", t, s, True, "n", "raw") for s, t in (("base", "select 1"), ("head", "select 1 union select 2"))]
    found = snapshot.judged(spark.createDataFrame(files, "path string, text string, side string, is_target boolean, model_id string, input string"))
    assert rows == [3]
    assert sorted((r.path, r.side, r.rule) for r in found.where("path = 'n.sql'").collect()) == [("n.sql", "head", "R018")]
